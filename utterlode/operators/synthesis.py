"""Conclusions over candidates from a pluggable chat function, with their evidence checked."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as x
from ..functions import text as t
from ..sources.remote import post_json, required_env
from ..sources.sessions import replaced

ChatFn = Callable[[str, str], str]
#: Candidates go in three prompts, each under a title; templates are left out.
GROUPS = (
    ("Rules, preferences and habits with tools, seen in many projects", ("constraint", "preference", "tooling")),
    ("Recurring steps of work, seen in many projects", ("workflow",)),
    ("Unsorted or seen in few projects: mostly noise, keep only clear patterns", ("other", "medium")),
)
ASK = f"""Each line is a cluster of things a developer said to a coding agent: its number, kind, how often and in how many projects, the pattern, and wordings with their counts.
State, one sentence each and in Chinese, what the developer asks for again and again; join clusters that say the same, and leave out what several wordings do not support.
"kind" is one of: {", ".join(x.CONCLUSION_KINDS)}. "dest" says where the statement belongs, one of: {", ".join(x.CONCLUSION_DESTS)}.
"evidence" lists numbers of the lines, one at least. An empty list is a good reply where nothing is certain.
Reply with JSON only: {{"conclusions": [{{"statement": "", "kind": "", "dest": "", "evidence": [1]}}]}}"""
ASK_SUMMARY = """Each line is a conclusion about a developer, with its kind, its place, how often it was seen, and the numbers of its evidence.
Sum up how they work with an agent in three to six sentences in Chinese; "evidence" lists numbers from the lines.
Reply with JSON only: {"summary": [{"statement": "", "evidence": [1]}]}"""
MOST_TOKENS = 16_000


class ReplyError(RuntimeError):
    pass


class ChatError(RuntimeError):
    pass


@dataclass(frozen=True)
class ChatConfig:
    base_url: str
    api_key: str
    model: str

    @classmethod
    def from_env(cls, model: str | None = None, prefix: str = "UTTERLODE_CHAT") -> ChatConfig:
        if model:
            return cls(*required_env(prefix, ("base_url", "api_key"), ChatError), model)
        return cls(*required_env(prefix, ("base_url", "api_key", "model"), ChatError))


def http_chat(config: ChatConfig) -> ChatFn:
    """A chat function for services with the usual ``/chat/completions`` request."""

    def chat(system: str, user: str) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        request = {"model": config.model, "max_tokens": MOST_TOKENS, "messages": messages, "response_format": {"type": "json_object"}}
        reply = post_json(f"{config.base_url}/chat/completions", config.api_key, request, ChatError, attempts=3, timeout=600)
        return str(reply["choices"][0]["message"]["content"])

    return chat


def candidate_line() -> Column:
    """A candidate as a prompt line: patterns and figures, no raw utterances."""
    variants = F.array_join(F.transform("variants", lambda v: F.concat(t.collapse(v["text"]), F.lit(" ×"), v["count"].cast("string"))), "; ")
    return F.concat(F.lit("#"), F.col("number").cast("string"), F.lit(" ["), F.col("kind"), F.lit("] 次数 "), F.col("count").cast("string"), F.lit(" 项目 "), F.col("project_count").cast("string"), F.lit(" | "), t.collapse(F.col("label")), F.lit(" | 变体: "), variants)


def parse_reply(reply: str) -> dict:
    """The JSON object of a reply, without a code fence around it (P20)."""
    body = re.sub(r"\A\s*```[a-z]*\s*\n?|\n?\s*```\s*\Z", "", reply)
    try:
        value = json.loads(body)
    except ValueError as error:
        raise ReplyError(f"the reply is not JSON: {reply[:80]}") from error
    if not isinstance(value, dict):
        raise ReplyError("the reply is not a JSON object")
    return value


def cached_chat(chat: ChatFn, folder: Path, model: str) -> ChatFn:
    """Replies kept in files named by a hash of what was asked."""

    def ask(system: str, user: str) -> str:
        path = folder / f"{hashlib.sha256('\0'.join((model, system, user)).encode()).hexdigest()}.txt"
        if not path.is_file():
            with replaced(path) as out:
                out.write(chat(system, user))
        return path.read_text(encoding="utf-8")

    return ask


def valid_evidence(evidence: Column, allowed: Column) -> Column:
    """Cited numbers that may be cited, once each, in order."""
    return F.array_sort(F.array_distinct(F.array_intersect(evidence, allowed)))


def evidence_rollup(conclusions: DataFrame, candidates: DataFrame) -> DataFrame:
    """``id`` with the summed count and the distinct projects of its evidence."""
    cited = conclusions.select("id", F.explode(F.array_distinct("evidence")).alias("number")).join(candidates.select("number", "count", "project_keys"), "number")
    counts = cited.groupBy("id").agg(F.sum("count").alias("count"), F.array_sort(F.collect_set("number")).alias("evidence"))
    projects = cited.select("id", F.explode("project_keys").alias("p")).groupBy("id").agg(F.count_distinct("p").alias("project_count"))
    return counts.join(projects, "id")


def _claims(items: object, name: str, allowed: list[int]) -> tuple[list[dict], int]:
    if not isinstance(items, list):
        raise ReplyError(f"the reply has no list {name!r}")
    kept = []
    for item in items:
        item = item if isinstance(item, dict) else {}
        statement, evidence = str(item.get("statement", "")).strip(), item.get("evidence")
        numbers = sorted({n for n in evidence if type(n) is int and n in allowed}) if isinstance(evidence, list) else []
        if statement and numbers:
            kept.append({"statement": statement, "kind": item.get("kind") if item.get("kind") in x.CONCLUSION_KINDS else "style", "dest": item.get("dest") if item.get("dest") in x.CONCLUSION_DESTS else "notes", "evidence": numbers})
    return kept, len(items) - len(kept)


def synthesize(candidates: DataFrame, chat: ChatFn) -> tuple[list[dict], list[dict], int]:
    """Summary, conclusions in order of destination and weight, and how many claims were dropped (L1 to L3)."""
    spark = candidates.sparkSession
    rows = candidates.withColumn("line", candidate_line()).orderBy("number").select("number", "section", "line").collect()

    def weighed(claims: list[dict]) -> list[dict]:
        if not claims:
            return []
        frame = spark.createDataFrame([(i, c["evidence"]) for i, c in enumerate(claims)], "id long, evidence array<long>")
        figures = {r["id"]: r for r in evidence_rollup(frame, candidates).collect()}
        return [c | {"count": figures[i]["count"], "project_count": figures[i]["project_count"]} for i, c in enumerate(claims)]

    found, dropped = [], 0
    for title, sections in GROUPS:
        members = [r for r in rows if r["section"] in sections]
        if members:
            kept, lost = _claims(parse_reply(chat(ASK, "\n".join([title, "", *(r["line"] for r in members)]))).get("conclusions"), "conclusions", [r["number"] for r in members])
            found, dropped = found + kept, dropped + lost
    conclusions = sorted(weighed(found), key=lambda c: (x.CONCLUSION_DESTS.index(c["dest"]), -c["project_count"], -c["count"]))
    if not conclusions:
        return [], [], dropped
    lines = [f"[{c['kind']} → {c['dest']}] {c['statement']}（次数 {c['count']} / 项目 {c['project_count']}）依据 " + " ".join(f"#{n}" for n in c["evidence"]) for c in conclusions]
    kept, lost = _claims(parse_reply(chat(ASK_SUMMARY, "\n".join(lines))).get("summary"), "summary", sorted({n for c in conclusions for n in c["evidence"]}))
    return weighed([c | {"kind": "style", "dest": "notes"} for c in kept]), conclusions, dropped + lost
