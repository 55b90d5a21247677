"""The driver's tables as utterances. Each adapter is one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Every kind of phrase, a bare path, replayed copies and narrow phrases, from event types and ids.
_DIALOG = """
select event_id as seq, 's' || (user_id % 50) as session_id, 'e' || event_id as entry_id, substr(cast(ts as {string}), 1, 19) as timestamp,
  '/home/u' || (user_id % 7) || '/work/p' || (user_id % 20) as cwd, 'p' || (user_id % 20) as project_key,
  case when event_id % 53 = 0 then 'Refactor ' || repeat('the long template text ', 12)
    when event_id % 47 = 0 then '/home/u/' || n
    when event_id % 43 = 0 then 'Always prefer tabs in part ' || n || '!'
    when event_id % 41 = 0 and user_id % 20 = 3 then 'rename the variable'
    when event_id % 37 = 0 then 'run pytest on tests/t' || n || '.py'
    when event_id % 31 = 0 then 'look at item ' || n || '.'
    when event_type = 'view' then 'Read docs/' || n || '.md'
    when event_type = 'click' then '  Commit. '
    when event_type = 'signup' then 'ok'
    when event_type = 'purchase' then 'do not touch #' || n
    else '/compact now' end as text
from (select *, regexp_extract(props, '([0-9]+)', 1) as n from {events}
  union all select event_id + 100000000 as event_id, {rest}, regexp_extract(props, '([0-9]+)', 1) as n from {events} where event_id % 97 = 0) t
"""
_REST = "ts, user_id, event_type, value, props"
_PARTS = "select p_partkey as seq, p_name as text, p_brand as project_key from {part}"
_CONV = "select conv_id, turn, role, text from {conversations}"
# Lines of session files: headers, messages of every shape, broken and empty ones; the first lines of a file have no header.
_LINES = """
select event_id as line_no, 'd' || (user_id % 7) || '/f' || (user_id % 31) || '.jsonl' as source_file,
  case when event_id % 11 = 0 then '{{"type":"session","id":"s' || event_id || '","cwd":"/Users/u' || user_id || '/x"}}'
    when event_id % 13 = 0 then 'not json ' || event_id
    when event_id % 17 = 0 then '"a string"'
    when event_id % 19 = 0 then '  '
    when event_id % 23 = 0 then '{{"type":"session","id":0,"cwd":null}}'
    when event_id % 29 = 0 then '{{"type":"message","id":"e' || event_id || '","timestamp":"t","message":{{"role":"user","content":' || event_id || '}}}}'
    when event_id % 31 = 0 then '{{"type":"message","id":false,"message":{{"role":"user","content":[{{"type":"text","text":"a' || user_id || '"}},{{"type":"image"}},{{"type":"text","text":"b"}},7]}}}}'
    when event_id % 37 = 0 then '{{"type":"message","id":"x","message":{{"role":"assistant","content":"no"}}}}'
    when event_id % 41 = 0 then '{{"type":"message","id":"e' || event_id || '","message":{{"role":"user","content":" /compact it"}}}}'
    when event_id % 43 = 0 then '{{"type":"message","id":"e' || event_id || '","message":{{"role":"user","content":"OK."}}}}'
    else '{{"type":"message","id":"e' || event_id || '","timestamp":"2024","message":{{"role":"user","content":"  say ' || event_type || ' ' || user_id || '"}}}}' end as raw
from {events}
"""


def sql(name: str) -> str:
    """The adapter for DuckDB."""
    text = {"dialog": _DIALOG, "parts": _PARTS, "conv": _CONV, "lines": _LINES}[name]
    return text.format(string="varchar", rest=_REST, events="events", part="part", conversations="conversations")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, table = {"dialog": (_DIALOG, "events"), "lines": (_LINES, "events"), "parts": (_PARTS, "part"), "conv": (_CONV, "conversations")}[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name == "dialog":
        source = source.select("event_id", "ts", "user_id", "event_type", "value", "props")
    text = text.replace("{{", "{{{{").replace("}}", "}}}}")  # Spark fills the text's places in too
    return spark.sql(text.format(string="string", rest=_REST, events="{events}", part="{part}", conversations="{conversations}"), **{table: source})
