"""From session lines to utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.durable import saved
from ..plans.numbering import numbered

SKIPS = ("no_session", "empty", "slash", "confirm")


def once(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` whose ``columns`` are worked out once a row: a filter on them is not moved below what they are made of, where
    Spark would write their expressions out at each mention."""
    return rows.select(*[c for c in rows.columns if c not in columns], F.inline(F.array(F.struct(*columns)))).select(*rows.columns)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds ``v`` (variant) and ``malformed``; blank lines go."""
    rows = once(once(lines, "raw").withColumn("raw", t.strip(F.col("raw"))), "raw").where("raw <> ''")
    rows = once(rows.withColumn("v", parse_json(F.col("raw"))), "v")
    return rows.withColumn("malformed", ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))


def parse_json(raw: Column) -> Column:
    """A variant, or null. NaN and infinities outside strings, which writers of JSON leave at times, count as null."""
    marked = F.regexp_replace(raw, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|-?(?:NaN|Infinity)', "$1\x00")  # a mark after each string, and for each token
    mended = F.replace(F.replace(marked, F.lit('"\x00'), F.lit('"')), F.lit("\x00"), F.lit("null"))
    return F.coalesce(F.try_parse_json(raw), F.when(raw.rlike("NaN|Infinity"), F.try_parse_json(mended)))


def sticky(value: str, partition: str = "source_file", order: str = "line_no"):
    """The last non-empty value so far in the file."""
    window = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.nullif(F.col(value), F.lit("")), ignorenulls=True).over(window)


def user_text(content: str):
    """A string content, or the text items of a list joined by newlines."""
    kind = F.schema_of_variant(content)
    items = F.expr(f"filter(try_cast({content} as array<variant>), i -> schema_of_variant(i) like 'OBJECT%' and try_variant_get(i, '$.type', 'string') = 'text' and schema_of_variant(try_variant_get(i, '$.text', 'variant')) = 'STRING')")
    joined = F.array_join(F.transform(items, lambda i: F.try_variant_get(i, "$.text", "string")), "\n")
    return F.when(kind == "STRING", F.col(content).cast("string")).when(kind.startswith("ARRAY"), F.coalesce(joined, F.lit(""))).otherwise("")


def with_disposition(entries: DataFrame) -> DataFrame:
    """``text`` stripped, and ``disposition``: the first of the skips that fits, or kept."""
    rows = once(entries.withColumn("text", t.strip(F.col("text"))), "text")
    rows = once(rows.withColumn("norm_key", t.normalize_key("text")), "norm_key")
    rule = F.when(F.coalesce(F.col("session_id"), F.lit("")) == "", "no_session").when(F.col("text") == "", "empty").when(t.is_slash_command(F.col("text")), "slash").when(t.is_confirm_key(F.col("norm_key")), "confirm")
    return rows.withColumn("disposition", rule.otherwise("kept"))


def said_at(path: str) -> Column:
    """A field as text; what counts as false in Python (missing, null, 0, false, empty) is empty."""
    value, kind = F.try_variant_get("v", path, "string"), F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    hollow = (kind != "STRING") & value.rlike(r"\A(?:false|-?0(?:\.0*)?(?:[eE][+-]?\d+)?|\[\]|\{\})\z")
    return F.when(hollow, "").when(kind == "BOOLEAN", "True").otherwise(F.coalesce(value, F.lit("")))


def session_entries(parsed: DataFrame) -> DataFrame:
    """User messages with their session's id and folder, in order of file (by path component) and line."""
    get = said_at
    rows = once(parsed.where(~F.col("malformed")).select("source_file", "line_no", "v", get("$.type").alias("type")), "type").where("type in ('session', 'message')")
    rows = rows.withColumn("_user", F.coalesce((F.col("type") == "message") & (F.try_variant_get("v", "$.message.role", "string") == "user"), F.lit(False)))
    rows = once(rows, "_user").where("_user or type = 'session'").withColumns({"_content": F.try_variant_get("v", "$.message.content", "variant"), "_said": get("$.id")})
    # fields go to the window, not documents
    field = lambda which, value: F.when(F.col("_user") if which == "user" else ~F.col("_user"), value)
    rows = once(rows.select("source_file", "line_no", "_user", "_said", field("header", get("$.cwd")).alias("_cwd"), field("user", get("$.timestamp")).alias("timestamp"), field("user", user_text("_content")).alias("text")), "_said", "_cwd", "timestamp", "text")
    rows = rows.withColumn("_id", field("header", F.col("_said"))).withColumns({"session_id": sticky("_id"), "cwd": F.coalesce(sticky("_cwd"), F.lit(""))})
    return rows.where("_user").select("source_file", "line_no", "session_id", "cwd", F.col("_said").alias("entry_id"), "timestamp", "text")


def utterances(entries: DataFrame) -> DataFrame:
    """Kept entries in the shape of the utterance file, with their order ``seq``.

    They are saved first: ranges are taken from a sample, for which all would be worked out a second time.
    """
    kept = saved(with_disposition(entries).where("disposition = 'kept'").drop("norm_key", "disposition"), "kept")
    placed = numbered(kept, [F.split("source_file", "/").asc(), F.asc("line_no")], "seq", start=1)
    return placed.select(
        t.utterance_id(F.col("session_id"), F.col("entry_id")).alias("utterance_id"), "session_id", "entry_id", "timestamp", "cwd",
        t.project_key(F.col("source_file")).alias("project_key"), "text", F.length("text").cast("long").alias("char_len"), "source_file",
        "seq",
    )


def counters(disposed: DataFrame, project: str = "project_key") -> DataFrame:
    """One row: kept, distinct projects of kept rows, and each skip (A1)."""
    is_ = lambda d: F.col("disposition") == d
    return disposed.agg(F.count_if(is_("kept")).alias("utterances"), F.count_distinct(F.when(is_("kept"), F.col(project))).alias("projects"), *[F.count_if(is_(s)).alias(f"skipped_{s}") for s in SKIPS])
