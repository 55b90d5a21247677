"""The registered queries, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as x
from ..functions import text as t
from ..operators import clusters, extract, grade, neardup
from ..operators.components import connected_components
from . import adapters
from .durable import new_path, saved

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


def _dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.frame(spark, sf_dir, "dialog")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.frame(spark, sf_dir, "parts")


_D, _P = adapters.sql("dialog"), adapters.sql("parts")
_KEY = r"regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')"


def _masked(c: str, path: str, number: str) -> str:
    masked = rf"regexp_replace(regexp_replace({c}, '[^\s]*/[^\s]*', '{path}', 'g'), '[0-9]+([.:-][0-9]+)*', '{number}', 'g')"
    return f"case when regexp_matches(replace(replace({masked}, '{number}', ''), '{path}', ''), '[\\p{{L}}\\p{{N}}]') then {masked} else {c} end"


def _clipped(c: str, n: int) -> str:
    line = rf"regexp_replace(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g')"
    return f"case when length({line}) <= {n} then {line} else substr({line}, 1, {n - 1}) || '…' end"


_KEYED = f"keyed as (select *, {_KEY} as norm_key from ({_D}) d), matched as (select *, {_masked('norm_key', x.PATH_TOKEN, x.NUMBER_TOKEN)} as match_key from keyed)"
_quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_any = lambda c, words: "(" + " or ".join(f"contains({c}, '" + w.replace("'", "''") + "')" for w in words) + ")"
_word = lambda c, words: f"regexp_matches({c}, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(words)})($|[^\\p{{L}}\\p{{N}}_])')"
_CORRECTION = _any("norm_key", x.CORRECTION_MARKERS)
_CONFIRM = rf"(norm_key in ({_quoted(x.CONFIRM_KEYS)}) or regexp_full_match(norm_key, '[a-z0-9]'))"
_KIND = f"""case when ltrim(text) like '<skill%' or length(norm_key) > 200 then 'template' when {_CORRECTION} then 'constraint'
 when {_word("norm_key", x.TOOL_WORDS)} then 'tooling' when {_word("norm_key", x.WORKFLOW_WORDS)} or {_any("norm_key", x.WORKFLOW_MARKERS)} then 'workflow'
 when {_any("norm_key", x.PREFERENCE_MARKERS)} then 'preference' else 'other' end"""
_SLASH = r"regexp_full_match(trim(text), '/[A-Za-z][A-Za-z0-9_-]*(\s.*)?', 's')"


# --- scalars and predicates -----------------------------------------------------------------------------------------


def _scalar(name: str, adapter: str, columns: dict[str, tuple[Callable[[], Column], str]], keyed: bool = False):
    """A query that maps each row of an adapter; ``columns``: the Spark column and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = adapters.frame(spark, sf_dir, adapter)
        if keyed:
            rows = neardup.keyed(rows)
        return rows.select("seq", *[c().alias(n) for n, (c, _) in columns.items()])

    picked = ", ".join(f"{s} as {n}" for n, (_, s) in columns.items())
    _query(name, f"with {_KEYED} select seq, {picked} from matched" if keyed else f"select seq, {picked} from ({adapters.sql(adapter)}) d")(run)


_text, _norm = (lambda: F.col("text")), (lambda: F.col("norm_key"))
_scalar("p2_strip", "dialog", {"stripped": (lambda: t.strip(F.concat(F.lit(" \t"), _text(), F.lit("\n "))), r"regexp_replace(' ' || chr(9) || text || chr(10) || ' ', '^\s+|\s+$', '', 'g')")})
_scalar("p3_utterance_id", "dialog", {"utterance_id": (lambda: t.utterance_id(F.col("session_id"), F.col("entry_id")), "substr(sha256(session_id || ':' || entry_id), 1, 16)")})
_scalar("p5_char_len", "dialog", {"char_len": (lambda: F.length("text"), "length(text)")})
_scalar("p6_normalize_key", "parts", {"norm_key": (lambda: t.normalize_key("text"), _KEY)})
_scalar("p7_mask_params", "dialog", {"shown": (lambda: t.shown(_text()), _masked("text", x.PATH_SHOWN, x.NUMBER_SHOWN))})
_scalar("p8_match_key", "dialog", {"match_key": (lambda: F.col("match_key"), "match_key")}, keyed=True)
_scalar("p9_bigrams", "parts", {"grams": (lambda: F.array_join(F.array_sort(t.bigrams(F.lower("text"))), "~"), "array_to_string(list_sort(list_distinct(list_transform(generate_series(1, greatest(length(text) - 1, 1)), lambda i: substr(lower(text), i, 2)))), '~')")})
_scalar("p10_phrase_id", "parts", {"phrase_id": (lambda: t.digest(F.lower("text"), 12), "substr(sha256(lower(text)), 1, 12)")})
_scalar("p11_day_span", "dialog", {"span": (lambda: t.day_span(F.lit("2024-01-31T00:00:00Z"), F.col("timestamp")), "date_diff('day', date '2024-01-31', cast(substr(timestamp, 1, 10) as date))")})
_scalar("p12_clip", "dialog", {"clipped": (lambda: t.clip(_text(), 20), _clipped("text", 20))})
_scalar("p14_display_cwd", "dialog", {"cwd": (lambda: t.display_cwd(F.col("cwd")), "regexp_replace(cwd, '^/(Users|home)/[^/]+', '~')")})
_scalar("p15_cell", "dialog", {"cell": (lambda: t.cell(F.concat(_text(), F.lit(" | "), F.col("project_key"))), r"replace(trim(regexp_replace(text || ' | ' || project_key, '\s+', ' ', 'g')), '|', '\|')")})
_scalar("f4_slash", "dialog", {"slash": (lambda: t.is_slash_command(_text()), _SLASH)})
_scalar("f5_confirm", "dialog", {"confirm": (lambda: t.is_confirm_key(_norm()), _CONFIRM)}, keyed=True)
_scalar("f6_correction", "dialog", {"correction": (lambda: t.is_correction_key(_norm()), _CORRECTION)}, keyed=True)
_scalar("f8_fuzzy_eligible", "dialog", {"eligible": (lambda: F.length("match_key").between(*x.FUZZY_CHARS), "length(match_key) between 4 and 200")}, keyed=True)
_scalar("f10_bare_path", "dialog", {"bare": (lambda: t.is_bare_path(_text()), r"regexp_full_match(trim(text), '(/|~/)\S*')")})
_scalar("g1_classify", "dialog", {"kind": (lambda: t.classify_kind(_text(), _norm(), t.is_correction_key(_norm())), _KIND)}, keyed=True)


_CITED = "[seq % 7, seq % 5, seq % 7, seq % 3]"


@_query("f12_valid_evidence", f"select seq, array_to_string(list_sort(list_distinct(list_filter({_CITED}, lambda e: e in (1, 2, 4, 6)))), ',') as evidence from ({_D}) d")
def _(spark, sf_dir):
    from ..operators import synthesis

    cited = F.array(*(F.col("seq") % n for n in (7, 5, 7, 3)))
    allowed = F.array(*(F.lit(n).cast("long") for n in (1, 2, 4, 6)))
    return _dialog(spark, sf_dir).select("seq", F.array_join(synthesis.valid_evidence(cited, allowed), ",").alias("evidence"))


_KINDS = f"kinds as (select seq, {_KIND} as kind, case when seq % 2 = 0 then 'strong' else 'medium' end as confidence from matched)"


@_query(
    "j9_destination",
    f"""with {_KEYED}, {_KINDS} select seq, case {" ".join(f"when kind = '{k}' and confidence = '{c}' then '{d}'" for (k, c), d in x.DESTINATIONS.items())} else 'observe' end as dest,
  case when kind = 'template' then 'template' when confidence = 'medium' then 'medium' else kind end as section from kinds""",
)
def _(spark, sf_dir):
    rows = neardup.keyed(_dialog(spark, sf_dir)).withColumn("kind", t.classify_kind(_text(), _norm(), t.is_correction_key(_norm())))
    rows = rows.withColumn("confidence", F.when(F.col("seq") % 2 == 0, "strong").otherwise("medium"))
    kind, confidence = F.col("kind"), F.col("confidence")
    return rows.select("seq", t.destination(kind, confidence).alias("dest"), t.review_section(kind, confidence).alias("section"))


@_query("p4_project_key", "select page_id, case when contains(p, '/') then split_part(p, '/', 1) else regexp_replace(p, '(.)\\.[^.]*$', '\\1') end as project_key from (select page_id, regexp_replace(url, '^https?://', '') as p from pages)")
def _(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", t.project_key(F.regexp_replace("url", "^https?://", "")).alias("project_key"))


@_query("p21_l2_normalize", "select vec_id, i, round(e / n, 6) as component from (select vec_id, unnest(embedding::double[]) as e, unnest(generate_series(1, len(embedding))) as i, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings)")
def _(spark, sf_dir):
    unit = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", t.normalize_vector(F.col("embedding")).alias("v"))
    return unit.select("vec_id", F.posexplode("v").alias("i", "c")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("c", 6).alias("component"))


@_query("f1_role_filter", "select conv_id, turn, text from conversations where role = 'user'")
def _(spark, sf_dir):
    return adapters.frame(spark, sf_dir, "conv").where("role = 'user'").select("conv_id", "turn", "text")


@_query("w1_sticky_header", "select conv_id, turn, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as header from conversations")
def _(spark, sf_dir):
    rows = adapters.frame(spark, sf_dir, "conv").withColumn("_user", F.when(F.col("role") == "user", F.col("text")))
    return rows.select("conv_id", "turn", extract.sticky("_user", "conv_id", "turn").alias("header"))


# --- extract and near duplicates ------------------------------------------------------------------------------------


@_query("a1_extract_counters", f"with {_KEYED}, disposed as (select project_key, case when trim(text) = '' then 'empty' when {_SLASH} then 'slash' when {_CONFIRM} then 'confirm' else 'kept' end as d from matched) select count(*) filter (d = 'kept') as utterances, count(distinct case when d = 'kept' then project_key end) as projects, 0 as skipped_no_session, count(*) filter (d = 'empty') as skipped_empty, count(*) filter (d = 'slash') as skipped_slash, count(*) filter (d = 'confirm') as skipped_confirm from disposed")
def _(spark, sf_dir):
    return extract.counters(extract.with_disposition(_dialog(spark, sf_dir)))


_L = adapters.sql("lines")
_FIELD = "case when json_type(j, '$.{0}') = 'VARCHAR' then json_extract_string(j, '$.{0}') when coalesce(json_type(j, '$.{0}'), 'NULL') = 'NULL' or json_extract_string(j, '$.{0}') in ('0', 'false') then '' else json_extract_string(j, '$.{0}') end"
_CONTENT = """case json_type(j, '$.message.content') when 'VARCHAR' then json_extract_string(j, '$.message.content')
  when 'ARRAY' then array_to_string(list_transform(list_filter(cast(json_extract(j, '$.message.content') as json[]), lambda i: json_type(i) = 'OBJECT' and json_extract_string(i, '$.type') = 'text' and json_type(i, '$.text') = 'VARCHAR'), lambda i: json_extract_string(i, '$.text')), chr(10)) else '' end"""
_PARSED = f"parsed as (select source_file, line_no, case when json_valid(raw) and json_type(raw) = 'OBJECT' then raw end as j from ({_L}) l where trim(raw) <> '')"
_SO_FAR = "last_value(nullif({0}, '') ignore nulls) over (partition by source_file order by line_no rows between unbounded preceding and current row)"
_ENTRIES = f"""{_PARSED}, typed as (select *, {_FIELD.format("type")} as type, {_FIELD.format("id")} as id, {_FIELD.format("cwd")} as own_cwd from parsed where j is not null),
sticky as (select *, {_SO_FAR.format("case when type = 'session' then id end")} as session_id, coalesce({_SO_FAR.format("case when type = 'session' then own_cwd end")}, '') as cwd from typed where type in ('session', 'message')),
entries as (select source_file, line_no, session_id, cwd, id as entry_id, {_FIELD.format("timestamp")} as timestamp, trim({_CONTENT}) as text from sticky where type = 'message' and json_extract_string(j, '$.message.role') = 'user')"""
_DISPOSED = f"""{_ENTRIES}, keyed as (select *, {_KEY} as norm_key from entries),
disposed as (select *, case when coalesce(session_id, '') = '' then 'no_session' when text = '' then 'empty' when {_SLASH} then 'slash' when {_CONFIRM} then 'confirm' else 'kept' end as disposition from keyed)"""


def _parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.parse_lines(adapters.frame(spark, sf_dir, "lines"))


@_query("s2_parse_lines", f"with {_PARSED} select source_file, line_no, j is null as malformed from parsed")
def _(spark, sf_dir):
    return _parsed_lines(spark, sf_dir).select("source_file", "line_no", "malformed")


@_query("p1_session_entries", f"with {_ENTRIES} select source_file, line_no, session_id, cwd, entry_id, timestamp, text from entries")
def _(spark, sf_dir):
    return extract.session_entries(_parsed_lines(spark, sf_dir)).withColumn("text", t.strip(_text()))


@_query("f2_line_counters", f"with {_DISPOSED} select count(*) filter (disposition = 'kept') as utterances, count(distinct case when disposition = 'kept' then split_part(source_file, '/', 1) end) as projects, {', '.join(f"count(*) filter (disposition = '{s}') as skipped_{s}" for s in extract.SKIPS)} from disposed")
def _(spark, sf_dir):
    disposed = extract.with_disposition(extract.session_entries(_parsed_lines(spark, sf_dir)))
    return extract.counters(disposed.withColumn("project_key", t.project_key(F.col("source_file"))))


@_query("o1_utterance_order", f"with {_DISPOSED} select substr(sha256(session_id || ':' || entry_id), 1, 16) as utterance_id, text, length(text) as char_len, row_number() over (order by string_split(source_file, '/'), line_no) as seq from disposed where disposition = 'kept'")
def _(spark, sf_dir):
    return extract.utterances(extract.session_entries(_parsed_lines(spark, sf_dir))).select("utterance_id", "text", "char_len", "seq")


@_query("s3_tolerant_read", "select turn, conv_id, role || '�' as text from conversations")
def _(spark, sf_dir):
    """Bytes that are no UTF-8 become the replacement character."""
    rows = adapters.frame(spark, sf_dir, "conv")
    return rows.select("turn", "conv_id", F.make_valid_utf8(F.concat(F.encode("role", "UTF-8"), F.unhex(F.lit("FF"))).cast("string")).alias("text"))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialog rows without replayed copies and blank keys."""
    rows = neardup.keyed(_dialog(spark, sf_dir)).withColumn("utterance_id", t.utterance_id(F.col("session_id"), F.col("entry_id")))
    return neardup.drop_forks(rows).where("norm_key <> ''")


_FORKED = f"{_KEYED}, kept as (select * from (select *, row_number() over (partition by timestamp, norm_key order by seq) as rn from matched) r where rn = 1 and norm_key <> '')"


@_query("w2_fork_dedup", f"with {_FORKED} select seq, norm_key from kept")
def _(spark, sf_dir):
    return _kept(spark, sf_dir).select("seq", "norm_key")


@_query("a12_fork_count", f"with {_KEYED} select count(*) - (select count(*) from (select distinct timestamp, norm_key from matched)) as forks from matched")
def _(spark, sf_dir):
    rows = neardup.keyed(_dialog(spark, sf_dir))
    balance = rows.select(F.lit(1).alias("one")).unionAll(neardup.drop_forks(rows).select(F.lit(-1)))
    return balance.agg(F.sum("one").alias("forks"))


@_query("a2_group_match_key", f"with {_FORKED} select match_key, count(*) as n, min(seq) as key_ord, count(distinct project_key) as projects from kept group by match_key")
def _(spark, sf_dir):
    return _kept(spark, sf_dir).groupBy("match_key").agg(F.count("*").alias("n"), F.min("seq").alias("key_ord"), F.count_distinct("project_key").alias("projects"))


def _part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).groupBy(F.lower("text").alias("key")).agg(F.min("seq").alias("ord"))


_PART_KEYS = f"keys as (select lower(text) as key, min(seq) as ord from ({_P}) p group by 1)"
_GRAMS = "list_distinct(list_transform(generate_series(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 2)))"


@_query("a3_bigram_df", f"with {_PART_KEYS} select gram, count(*) as df from (select unnest({_GRAMS.format('key')}) as gram from keys) group by gram")
def _(spark, sf_dir):
    return _part_keys(spark, sf_dir).select(F.explode(t.bigrams(F.col("key"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))


def _pairs_sql(keys: str) -> str:
    return f"{keys}, sets as (select ord, {_GRAMS.format('key')} as g from keys), pairs as (select a, b, k / (n + m - k) as similarity from (select p.ord as a, q.ord as b, len(list_intersect(p.g, q.g))::double as k, len(p.g) as n, len(q.g) as m from sets p join sets q on p.ord < q.ord) where k / (n + m - k) >= 0.85::double)"


_NAME_KEYS = "keys as (select lower(c_name) as key, min(c_custkey) as ord from customer group by 1)"


@_query("j1_jaccard_pairs_parts", f"with {_pairs_sql(_PART_KEYS)} select a, b, round(similarity, 6) as similarity from pairs")
def _(spark, sf_dir):
    return neardup.jaccard_pairs(_part_keys(spark, sf_dir)).select("a", "b", F.round("similarity", 6).alias("similarity"))


@_query("j1_jaccard_pairs_names", f"with {_pairs_sql(_NAME_KEYS)} select a, b, round(similarity, 6) as similarity from pairs")
def _(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.lower("c_name").alias("key")).agg(F.min("c_custkey").alias("ord"))
    return neardup.jaccard_pairs(names).select("a", "b", F.round("similarity", 6).alias("similarity"))


_REACH = "edges as (select a as src, b as dst from pairs union select b, a from pairs), reach as (select src as node, dst as other from edges union select r.node, e.dst from reach r join edges e on r.other = e.src)"


@_query("c5_components", f"with recursive {_pairs_sql(_PART_KEYS)}, {_REACH} select node, least(node, min(other)) as component from reach group by node")
def _(spark, sf_dir):
    return connected_components(neardup.jaccard_pairs(_part_keys(spark, sf_dir)), "a", "b")


def _dialog_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _kept(spark, sf_dir)
    return neardup.phrases(kept, kept.groupBy("match_key").agg(F.min("seq").alias("key_ord")).withColumn("component", F.col("key_ord")))


_PHRASES = f"""{_FORKED}, grouped as (select *, min(seq) over (partition by match_key) as component from kept),
wordings as (select component, text, count(*) as n, min(timestamp || '~' || lpad(cast(seq as varchar), 12, '0')) as first_at from grouped group by 1, 2),
chosen as (select component, text from (select *, row_number() over (partition by component order by n desc, first_at) as best from wordings) w where best = 1),
rolled as (select component, count(*) as count, list_sort(list(distinct project_key)) as project_keys, min(timestamp) as first_timestamp, max(timestamp) as last_timestamp from grouped group by 1),
named as (select r.*, c.text, {_KEY.replace('text', 'c.text')} as norm_key from rolled r join chosen c using (component)),
phrases as (select *, {_CORRECTION} as is_correction, row_number() over (order by count desc, norm_key) - 1 as ord, substr(sha256(norm_key), 1, 12) as phrase_id from named)"""


@_query("a4_phrases", f"with {_PHRASES} select ord, phrase_id, text, norm_key, count, array_to_string(project_keys, ',') as projects, first_timestamp, last_timestamp, is_correction from phrases")
def _(spark, sf_dir):
    return _dialog_phrases(spark, sf_dir).select("ord", "phrase_id", "text", "norm_key", "count", F.array_join("project_keys", ",").alias("projects"), "first_timestamp", "last_timestamp", "is_correction")


@_query("a4_phrase_members", f"with {_PHRASES} select p.phrase_id, g.timestamp, g.component as key_ord, g.seq, substr(sha256(g.session_id || ':' || g.entry_id), 1, 16) as utterance_id from grouped g join phrases p using (component)")
def _(spark, sf_dir):
    kept = saved(_kept(spark, sf_dir), "kept")
    groups = kept.groupBy("match_key").agg(F.min("seq").alias("key_ord")).withColumn("component", F.col("key_ord"))
    return neardup.members(kept, groups, saved(neardup.phrases(kept, groups), "phrases"))


# --- clusters -------------------------------------------------------------------------------------------------------

_TERMS = """clean as (select ord, regexp_replace(substr(key, 1, 300), '\\s\\s+', ' ', 'g') as c from keys),
terms as (select ord, term, count(*) as tf from (select ord, unnest(flatten(list_transform([2, 3, 4], lambda n: list_transform(generate_series(1, length(c) - n + 1), lambda i: substr(c, i, n))))) as term from clean) group by 1, 2),
dfs as (select term, count(*) as df from terms group by 1),
raw as (select ord, t.term, df, (1 + ln(tf)) * (ln((1 + (select count(*) from keys)) / (1 + df)) + 1) as w from terms t join dfs d on t.term = d.term),
weights as (select ord, term, df, w / sqrt(sum(w * w) over (partition by ord)) as weight from raw)"""


@_query("c2_tfidf_weights", f"with {_PART_KEYS}, {_TERMS} select ord, term, df, round(weight, 6) as weight from weights")
def _(spark, sf_dir):
    return clusters.tfidf_weights(_part_keys(spark, sf_dir)).select("ord", "term", "df", F.round("weight", 6).alias("weight"))


_WALK = """numbered as (select ord, row_number() over (order by ord) as i from keys),
near as (select b, list(a order by similarity desc, a) as before from pairs group by b),
walk as (select 0::bigint as i, []::bigint[] as leaders, 0::bigint as ord, 0::bigint as leader union all
  select n.i, case when l.pick is null then list_append(l.leaders, n.ord) else l.leaders end, n.ord, coalesce(l.pick, n.ord)
  from (select w.i, w.leaders, list_filter(coalesce(r.before, []), lambda e: list_contains(w.leaders, e))[1] as pick from walk w join numbered m on m.i = w.i + 1 left join near r on r.b = m.ord) l join numbered n on n.i = l.i + 1)"""
_COSINE = f"{_PART_KEYS}, {_TERMS}, pairs as (select p.ord as a, q.ord as b, sum(p.weight * q.weight) as similarity from weights p join weights q on p.term = q.term and p.ord < q.ord group by 1, 2 having sum(p.weight * q.weight) >= 0.55)"


@_query("c3_tfidf_pairs", f"with {_COSINE} select a, b, round(similarity, 6) as similarity from pairs")
def _(spark, sf_dir):
    pairs = clusters.cosine_pairs(clusters.tfidf_weights(_part_keys(spark, sf_dir)), x.COSINE_TFIDF)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@_query(
    "c1_leaders_tfidf",
    f"with recursive {_COSINE}, {_WALK} select ord, leader from walk where i > 0",
)
def _(spark, sf_dir):
    keys = saved(_part_keys(spark, sf_dir), "keys")
    return clusters.leader_clusters(keys, clusters.cosine_pairs(clusters.tfidf_weights(keys), x.COSINE_TFIDF))


@_query("c4_cosine_pairs", "with u as (select vec_id, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings) select a, b, round(s, 6) as similarity from (select p.vec_id as a, q.vec_id as b, list_dot_product(p.v, q.v) / (p.n * q.n) as s from u p join u q on p.vec_id < q.vec_id) where s >= 0.4")
def _(spark, sf_dir):
    unit = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("ord"), t.normalize_vector(F.col("embedding")).alias("vector"))
    return clusters.dense_pairs(unit, 0.4).select("a", "b", F.round("similarity", 6).alias("similarity"))


_UNIT = "u as (select vec_id as ord, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings), keys as (select ord from u), pairs as (select p.ord as a, q.ord as b, list_dot_product(p.v, q.v) / (p.n * q.n) as similarity from u p join u q on p.ord < q.ord where list_dot_product(p.v, q.v) / (p.n * q.n) >= 0.8)"


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("ord"), t.normalize_vector(F.col("embedding")).alias("vector"))


@_query("c4_cosine_pairs_default", f"with {_UNIT} select a, b, round(similarity, 6) as similarity from pairs")
def _(spark, sf_dir):
    return clusters.dense_pairs(_unit(spark, sf_dir), x.COSINE_EMBEDDING).select("a", "b", F.round("similarity", 6).alias("similarity"))


@_query("c1_leaders_embedding", f"with recursive {_UNIT}, {_WALK} select ord, leader from walk where i > 0")
def _(spark, sf_dir):
    unit = saved(_unit(spark, sf_dir), "unit")
    return clusters.leader_clusters(unit, clusters.dense_pairs(unit, x.COSINE_EMBEDDING))


# --- grading --------------------------------------------------------------------------------------------------------


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phrase its own cluster: what SQL can rank too."""
    phrases = saved(_dialog_phrases(spark, sf_dir), "phrases")
    return grade.candidates(phrases, phrases.select("ord", F.col("ord").alias("leader")))


_RANKED = f"""{_PHRASES}, graded as (select *, len(project_keys) as project_count, date_diff('day', cast(substr(first_timestamp, 1, 10) as date), cast(substr(last_timestamp, 1, 10) as date)) as day_span,
  {_KIND} as kind from phrases where count >= 3 and not regexp_full_match(trim(text), '(/|~/)\\S*')),
confident as (select *, case when project_count >= 3 or (day_span >= 90 and count >= 9) then 'strong' else 'medium' end as confidence from graded),
sectioned as (select *, case when kind = 'template' then 'template' when confidence = 'medium' then 'medium' else kind end as section,
  case {" ".join(f"when kind = '{k}' and confidence = '{c}' then '{d}'" for (k, c), d in x.DESTINATIONS.items())} else 'observe' end as suggested_dest,
  case when kind = 'template' then {_clipped("text", 60)} else {_clipped(_masked("text", x.PATH_SHOWN, x.NUMBER_SHOWN), 60)} end as label from confident),
ranked as (select *, row_number() over (order by list_position([{_quoted(x.SECTIONS)}], section), confidence desc, count desc, project_count desc, phrase_id) as number from sectioned)"""


@_query("g5_candidates", f"with {_RANKED} select number, phrase_id as candidate_id, label, count, project_count, day_span, kind, suggested_dest, confidence, section from ranked")
def _(spark, sf_dir):
    return _ranked(spark, sf_dir).drop("variant_count", "variants", "project_keys")


_TENTHS = f"""with {_PHRASES}, members as (select *, ord % 10 as leader, {_clipped(_masked("text", x.PATH_SHOWN, x.NUMBER_SHOWN), x.VARIANT_CHARS)} as pattern from phrases),
patterns as (select leader, pattern, sum(count)::bigint as n, min(ord) as first_ord from members group by 1, 2),
variants as (select leader, count(*) as variant_count, array_to_string(list(pattern || '*' || n order by n desc, first_ord)[1:{x.VARIANTS_SHOWN}], '; ') as variants from patterns group by 1),
tenths as (select leader, sum(count)::bigint as count, len(list_distinct(flatten(list(project_keys)))) as project_count, date_diff('day', cast(substr(min(first_timestamp), 1, 10) as date), cast(substr(max(last_timestamp), 1, 10) as date)) as day_span from members group by 1)
select p.phrase_id as candidate_id, r.count, r.project_count, r.day_span, v.variant_count, v.variants from tenths r join variants v using (leader) join phrases p on p.ord = r.leader where not regexp_full_match(trim(p.text), '(/|~/)\\S*')"""


@_query("a5_cluster_rollup", _TENTHS)
def _(spark, sf_dir):
    """Counts, projects, days and most frequent patterns of clusters of phrases: every tenth phrase, led by the first."""
    phrases = saved(_dialog_phrases(spark, sf_dir), "phrases")
    found = grade.candidates(phrases, phrases.select("ord", (F.col("ord") % 10).alias("leader")), min_count=1)
    shown = F.array_join(F.transform("variants", lambda v: F.concat(v["text"], F.lit("*"), v["count"].cast("string"))), "; ")
    return found.select("candidate_id", "count", "project_count", "day_span", "variant_count", shown.alias("variants"))


@_query("w6_section_topk", f"with {_RANKED} select section, number from (select section, number, row_number() over (partition by section order by number) as place from ranked) r where place <= 8")
def _(spark, sf_dir):
    return grade.section_top(_ranked(spark, sf_dir)).select("section", "number")


@_query("a7_strong_count", f"with {_RANKED} select count(*) as candidates, count(*) filter (confidence = 'strong') as strong from ranked")
def _(spark, sf_dir):
    return _ranked(spark, sf_dir).agg(F.count("*").alias("candidates"), F.count_if(F.col("confidence") == "strong").alias("strong"))


@_query("a8_correction_share", f"with {_PHRASES} select sum(count)::bigint as total, coalesce(sum(case when {_KIND} = 'constraint' then count end), 0)::bigint as corrections from phrases")
def _(spark, sf_dir):
    return grade.correction_share(_dialog_phrases(spark, sf_dir))


@_query("a9_project_distribution", f"select project_key, regexp_replace(arg_min(cwd, seq), '^/(Users|home)/[^/]+', '~') as cwd, count(*) as n from ({_D}) d group by project_key order by n desc, min(seq) limit 10")
def _(spark, sf_dir):
    return grade.project_distribution(_dialog(spark, sf_dir))


@dataclass
class Mined:
    phrases: DataFrame
    clusters: DataFrame
    candidates: DataFrame
    forks: int


def mine(spark: SparkSession, utterances: DataFrame, min_count: int = 3, min_projects: int = 3, embed: Callable[[DataFrame], DataFrame] | None = None) -> Mined:
    """The whole of mining (M1): phrases, their clusters, and ranked candidates of ``utterances``.

    ``embed`` adds a unit ``vector`` to rows with a ``text``; with it, phrases are clustered by embedding cosine, else by
    TF-IDF.
    """
    keyed = neardup.keyed(utterances)
    rows = saved(neardup.drop_forks(keyed), "rows")
    phrases = saved(neardup.phrases(rows, neardup.key_groups(rows)), "phrases")
    if embed:
        pairs = clusters.dense_pairs(saved(embed(phrases.select("ord", "text")).select("ord", "vector"), "vectors"), x.COSINE_EMBEDDING)
    else:
        keys = phrases.select("ord", t.match_key(F.col("norm_key")).alias("key"))
        pairs = clusters.cosine_pairs(clusters.tfidf_weights(keys), x.COSINE_TFIDF)
    found = clusters.leader_clusters(phrases, pairs)
    return Mined(phrases, found, grade.candidates(phrases, found, min_count, min_projects), keyed.count() - rows.count())


_ADMITTED = f"""admitted as (select seq, session_id, entry_id, timestamp, cwd, project_key, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text from ({_D}) d),
spoken as (select * from (select *, {_KEY} as norm_key from admitted) a where text <> '' and not {_SLASH} and not {_CONFIRM}),
matched as (select *, {_masked('norm_key', x.PATH_TOKEN, x.NUMBER_TOKEN)} as match_key from spoken),
kept as (select * from (select *, row_number() over (partition by timestamp, norm_key order by seq) as rn from matched) r where rn = 1 and norm_key <> '')"""
_MERGED = f"""{_ADMITTED}, every_key as (select match_key as key, min(seq) as ord from kept group by 1),
{_pairs_sql("fuzzy as (select * from every_key where length(key) between 4 and 200)").replace("from keys)", "from fuzzy)").replace("pairs as", "alike as")},
edges as (select a as src, b as dst from alike union select b, a from alike),
reach as (select src as node, dst as other from edges union select r.node, e.dst from reach r join edges e on r.other = e.src),
merged as (select k.key, k.ord as key_ord, least(k.ord, coalesce(min(r.other), k.ord)) as component from every_key k left join reach r on r.node = k.ord group by 1, 2),
grouped as (select k.*, m.key_ord, m.component from kept k join merged m on m.key = k.match_key),
wordings as (select component, text, count(*) as n, min(timestamp || '~' || lpad(cast(key_ord as varchar), 12, '0') || '~' || lpad(cast(seq as varchar), 12, '0')) as first_at from grouped group by 1, 2),
chosen as (select component, text from (select *, row_number() over (partition by component order by n desc, first_at) as best from wordings) w where best = 1),
rolled as (select component, count(*) as count, list_sort(list(distinct project_key)) as project_keys, min(timestamp) as first_timestamp, max(timestamp) as last_timestamp from grouped group by 1),
named as (select r.*, c.text, {_KEY.replace('text', 'c.text')} as norm_key from rolled r join chosen c using (component)),
phrases as (select *, row_number() over (order by count desc, norm_key, component) - 1 as ord, substr(sha256(norm_key), 1, 12) as phrase_id from named)"""
_MINED = f"""{_MERGED}, keys as (select ord, {_masked('norm_key', x.PATH_TOKEN, x.NUMBER_TOKEN)} as key from phrases), {_TERMS},
pairs as (select p.ord as a, q.ord as b, sum(p.weight * q.weight) as similarity from weights p join weights q on p.term = q.term and p.ord < q.ord group by 1, 2 having sum(p.weight * q.weight) >= 0.55), {_WALK},
led as (select p.*, w.leader, {_clipped(_masked("text", x.PATH_SHOWN, x.NUMBER_SHOWN), x.VARIANT_CHARS)} as pattern from phrases p join walk w on w.ord = p.ord and w.i > 0),
patterns as (select leader, pattern, sum(count)::bigint as n, min(ord) as first_ord from led group by 1, 2),
variants as (select leader, count(*) as variant_count, array_to_string(list(pattern || '*' || n order by n desc, first_ord)[1:{x.VARIANTS_SHOWN}], '; ') as variants from patterns group by 1),
sums as (select leader, sum(count)::bigint as count, list_sort(list_distinct(flatten(list(project_keys)))) as project_keys, date_diff('day', cast(substr(min(first_timestamp), 1, 10) as date), cast(substr(max(last_timestamp), 1, 10) as date)) as day_span from led group by 1),
graded as (select s.*, len(s.project_keys) as project_count, v.variant_count, v.variants, p.phrase_id, p.text, p.norm_key, {_KIND.replace("(text)", "(p.text)").replace("norm_key", "p.norm_key")} as kind from sums s join variants v using (leader) join phrases p on p.ord = s.leader where s.count >= 3 and not regexp_full_match(trim(p.text), '(/|~/)\\S*')),
confident as (select *, case when project_count >= 3 or (day_span >= 90 and count >= 9) then 'strong' else 'medium' end as confidence from graded),
sectioned as (select *, case when kind = 'template' then 'template' when confidence = 'medium' then 'medium' else kind end as section,
  case {" ".join(f"when kind = '{k}' and confidence = '{c}' then '{d}'" for (k, c), d in x.DESTINATIONS.items())} else 'observe' end as suggested_dest,
  case when kind = 'template' then {_clipped("text", 60)} else {_clipped(_masked("text", x.PATH_SHOWN, x.NUMBER_SHOWN), 60)} end as label from confident)
select row_number() over (order by list_position([{_quoted(x.SECTIONS)}], section), confidence desc, count desc, project_count desc, phrase_id) as number, phrase_id as candidate_id, label, count, project_count, day_span, kind, suggested_dest, confidence, variant_count, variants, array_to_string(project_keys, ',') as project_keys, section from sectioned"""


@_query("mine_candidates", f"with recursive {_MINED}")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the dialog, with fuzzy merging and clusters."""
    rows = extract.with_disposition(_dialog(spark, sf_dir)).where("disposition = 'kept'").drop("disposition")
    rows = rows.withColumn("utterance_id", t.utterance_id(F.col("session_id"), F.col("entry_id")))
    found = mine(spark, rows).candidates
    shown = F.array_join(F.transform("variants", lambda v: F.concat(v["text"], F.lit("*"), v["count"].cast("string"))), "; ")
    return found.withColumn("variants", shown).withColumn("project_keys", F.array_join("project_keys", ","))


# --- caches and evidence --------------------------------------------------------------------------------------------


@_query("j5_cache_anti", f"select distinct sha256(concat_ws(chr(0), 'm', '8', substr(text, 1, 1000))) as key, substr(text, 1, 1000) as sent from ({_P}) p where text not in (select p_name from part where p_partkey <= 20)")
def _(spark, sf_dir):
    from ..operators import embedding

    parts = _parts(spark, sf_dir)
    return embedding.missing(embedding.with_keys(parts, "m", 8), embedding.with_keys(parts.where("seq <= 20"), "m", 8))


@_query("j8_evidence_rollup", f"with {_RANKED}, cited as (select number % 4 as id, count, project_keys from ranked), sums as (select id, sum(count)::bigint as count from cited group by id), spread as (select id, count(distinct p) as project_count from (select id, unnest(project_keys) as p from cited) u group by id) select id, count, project_count from sums join spread using (id)")
def _(spark, sf_dir):
    from ..operators import synthesis

    ranked = saved(_ranked(spark, sf_dir), "ranked")
    claims = ranked.groupBy((F.col("number") % 4).alias("id")).agg(F.collect_list("number").alias("evidence"))
    return synthesis.evidence_rollup(claims, ranked).select("id", "count", "project_count")


_parts_key = "sha256(concat_ws(chr(0), 'm', '1024', substr(text, 1, 1000)))"


@_query("p18_cache_key", f"select seq, {_parts_key} as key from ({_P}) p")
def _(spark, sf_dir):
    from ..operators import embedding

    return embedding.with_keys(_parts(spark, sf_dir), "m").select("seq", "key")


@_query("j6_embedded", f"select seq, round(n / sqrt(n * n + 1), 6) as first, round(1 / sqrt(n * n + 1), 6) as last from (select seq, length(text)::double as n from ({_P}) p) l")
def _(spark, sf_dir):
    """Vectors of parts by a fetcher that tells a text's length, through the cache table."""
    from ..operators import embedding

    found = embedding.embed(_parts(spark, sf_dir), lambda batch: [[float(len(x)), 1.0] for x in batch], "m", new_path(spark, "cache"), 2)
    return found.select("seq", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.col("vector")[1], 6).alias("last"))


_TITLED = "select seq, case when seq % 3 = 0 then '<skill name=\"plan ' || seq % 5 || '\">' || text when seq % 3 = 1 then chr(10) || '  ## Title of ' || text || chr(10) || 'body' else text end as text, case when seq % 3 < 2 then 'template' else 'other' end as kind from ({0}) d"


@_query("p13_display_label", f"select seq, case when kind = 'template' and regexp_matches(text, '<skill\\s+name=') then 'skill: ' || regexp_extract(text, '<skill\\s+name=\"([^\"]+)\"', 1) when kind = 'template' then {_clipped("regexp_replace(string_split(text, chr(10))[2], '^[# ]+', '')", 60)} else {_clipped(_masked("text", x.PATH_SHOWN, x.NUMBER_SHOWN), 60)} end as label from ({_TITLED.format(_D)}) t")
def _(spark, sf_dir):
    rows = spark.sql(_TITLED.format("{dialog}").replace("chr(10)", "char(10)"), dialog=_dialog(spark, sf_dir))
    return rows.select("seq", t.display_label(_text(), F.col("kind")).alias("label"))


@_query("p16_candidate_line", f"""with {_RANKED} select number, '#' || number || ' [' || kind || '] 次数 ' || count || ' 项目 ' || project_count || ' | ' || label || ' | 变体: ' || {_clipped(_masked("text", x.PATH_SHOWN, x.NUMBER_SHOWN), x.VARIANT_CHARS)} || ' ×' || count as line from ranked""")
def _(spark, sf_dir):
    from ..operators import synthesis

    return _ranked(spark, sf_dir).select("number", synthesis.candidate_line().alias("line"))


_CITING = "number % 3 <> 0 and section <> 'template'"


@_query(
    "o5_conclusions",
    f"""with {_RANKED}, told as (select *, [{_quoted(x.CONCLUSION_DESTS)}][1 + number % 4] as dest, case when section in ('constraint', 'preference', 'tooling') then 1 when section = 'workflow' then 2 else 3 end as part from ranked where {_CITING})
select row_number() over (order by 1 + number % 4, project_count desc, count desc, part, number) as place, 'says ' || number as statement, dest, count, project_count, number as evidence, (select count(*) from ranked where number % 3 = 0 and section <> 'template') as dropped from told""",
)
def _(spark, sf_dir):
    """Conclusions by a chat function that cites each line once, and leaves every third without a statement."""
    import json
    import re

    from ..operators import synthesis

    def chat(system: str, user: str) -> str:
        if system == synthesis.ASK_SUMMARY:
            return '{"summary": []}'
        numbers = [int(n) for n in re.findall(r"^#(\d+) \[", user, re.MULTILINE)]
        told = [{"statement": f"says {n}" if n % 3 else " ", "kind": "style", "dest": x.CONCLUSION_DESTS[n % 4], "evidence": [n, -1, n]} for n in numbers]
        return json.dumps({"conclusions": told})

    _, found, dropped = synthesis.synthesize(saved(_ranked(spark, sf_dir), "ranked"), chat)
    rows = [(i + 1, c["statement"], c["dest"], c["count"], c["project_count"], c["evidence"][0], dropped) for i, c in enumerate(found)]
    return spark.createDataFrame(rows, "place long, statement string, dest string, count long, project_count long, evidence long, dropped long")
