"""The ten operators as queries over whole tables, with their digests, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import new_path, saved
from . import chat, jaccard, language, mixing, multiindex, packing, quantisation, substring, toxicity, warc
from .folds import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.search(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = language.train(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")), "doc_id", "text", "lang")
    return language.predict(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), net, keep=("doc_id", "held_out"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantisation.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scorer = toxicity.train(docs, labels.where(~held_out("doc_id")))
    scored = toxicity.score(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), scorer, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


#: A conversation that says the template's control strings.
CONTROL_CONVERSATION = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string"))
    return chat.read_back(saved(chat.format_conversations(turns, tokenizer_path()), "windows"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = new_path(spark, "archive")
    warc.write_records(_table(spark, sf_dir, "pages"), archive)
    return warc.read_records(spark.read.parquet(archive)).drop("url")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    own = (op1_multi_index, op2_language, op3_substring, op4_quantisation, op5_toxicity, op6_mixing, op7_packing, op8_chat, op9_warc, op10_jaccard)
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

_SUBSTRING = rf"""
with docs as (select doc_id, {_WORDS.format("text")} as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from docs where len(w) >= 13)),
firsts as (select g, min(doc_id) as d from windows group by g),
covered as (select distinct doc_id, i + j as place from (select x.doc_id, x.i from windows x join firsts f on x.g = f.g and f.d < x.doc_id), (select unnest(range(0, 13)) as j)),
words as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as place from docs where len(w) > 0),
kept as (select k.doc_id, count(*) as n, string_agg(k.word, ' ' order by k.place) as t from words k left join covered c on k.doc_id = c.doc_id and k.place = c.place where c.place is null group by k.doc_id)
select d.doc_id, len(d.w)::bigint as n_words, (len(d.w) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from docs d left join kept k on d.doc_id = k.doc_id
"""

_COMPONENTS = """
, edges as (select a as src, b as dst from links union select b, a from links),
reach as (select src as node, src as other from edges union select r.node, e.dst from reach r join edges e on r.other = e.src),
least_one as (select node, min(other) as component from reach group by node)
"""

_JACCARD = rf"""
with recursive docs as (select doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_sort(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))) end as s from docs),
classes as (select s, min(doc_id) as c, len(s) as n from sets where len(s) > 0 group by s),
shingles as (select c, n, unnest(s) as g from classes),
common as (select x.c as a, y.c as b, x.n as n, y.n as m, count(*) as k from shingles x join shingles y on x.g = y.g and x.c < y.c and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) group by all),
links as (select a, b from common where 100 * k >= 80 * (n + m - k))
{_COMPONENTS}
select t.doc_id, len(t.s)::bigint as n_shingles, coalesce(l.component, k.c, t.doc_id) as component_id
from sets t left join classes k on t.s = k.s left join least_one l on l.node = k.c
"""

_NEAR = f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id < y.vec_id
  where list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.95)
{_COMPONENTS},
degrees as (select src, count(*) as n from edges group by src)
select m.vec_id, coalesce(d.n, 0)::bigint as n_links, coalesce(l.component, m.vec_id) as component_id, m.vec_id = coalesce(l.component, m.vec_id) as kept
from embeddings m left join degrees d on d.src = m.vec_id left join least_one l on l.node = m.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring": _SUBSTRING, "op4_quantisation": _NEAR, "op6_mixing": mixing.ORACLE, "op10_jaccard": _JACCARD}
