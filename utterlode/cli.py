"""Command line: extract, mine, synthesize, status."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import fixed as x
from .functions import text as t
from .operators import embedding, extract, grade, synthesis
from .plans.catalogue import mine
from .plans.durable import saved
from .sources import report, sessions

VERSION = "0.2.0"
FILES = {
    "utterances": "utterances.jsonl", "candidates_md": "candidates.md", "candidates_json": "candidates.json", "persona": "persona.md",
    "embeddings": "embeddings", "conclusions_md": "conclusions.md", "conclusions_json": "conclusions.json",
}
REPLIES = "llm-cache"


def run_extract(spark: SparkSession, folder: str, out: Path) -> dict:
    if not Path(folder).is_dir():
        raise FileNotFoundError(f"{folder} is not a folder")
    path = out / FILES["utterances"]
    parsed = saved(extract.parse_lines(sessions.read_session_lines(spark, folder)).drop("v"), "lines").withColumn("v", extract.parse_json(F.col("raw")))
    entries = saved(extract.session_entries(parsed), "entries")
    sessions.write_utterances(extract.utterances(entries), str(path))
    counted = extract.counters(extract.with_disposition(entries).withColumn("project_key", t.project_key(F.col("source_file")))).first().asDict()
    lines = parsed.agg(F.count_distinct("source_file").alias("files"), F.count_if("malformed").alias("malformed")).first()
    return {
        "sessions_dir": folder, "output_path": str(path), "session_file_count": lines["files"], "utterance_count": counted["utterances"], "project_count": counted["projects"],
        **{f"skipped_{s}": counted[f"skipped_{s}"] for s in ("slash", "confirm", "empty", "no_session")}, "skipped_malformed": lines["malformed"],
    }


def run_mine(spark: SparkSession, out: Path, min_count: int = 3, min_projects: int = 3, fetcher: embedding.Fetcher | None = None, model: str = "", dimensions: int = embedding.DIMENSIONS) -> dict:
    """Candidates and persona; with a ``fetcher``, phrases are clustered by the vectors that it gives."""
    path = out / FILES["utterances"]
    if not path.is_file():
        raise FileNotFoundError(f"{path} not found; run extract first")
    rows = saved(sessions.read_utterances(spark, str(path)).withColumn("seq", F.monotonically_increasing_id()), "utterances")
    embed = (lambda texts: embedding.embed(texts, fetcher, model, str(out / FILES["embeddings"]), dimensions)) if fetcher else None
    mined = mine(spark, rows, min_count, min_projects, embed)
    phrases, found = mined.phrases, [r.asDict(True) for r in mined.candidates.orderBy("number").collect()]
    paths = {key: out / FILES[key] for key in ("candidates_md", "candidates_json", "persona")}
    summary = {
        "out_dir": str(out), "min_count": min_count, "min_projects": min_projects, "cluster_backend": "embedding" if fetcher else "tfidf",
        "utterance_count": rows.count(), "phrase_count": phrases.count(), "cluster_count": mined.clusters.select("leader").distinct().count(),
        "candidate_count": len(found), "strong_count": sum(c["confidence"] == "strong" for c in found), "fork_duplicate_count": mined.forks,
        "candidates_md_path": str(paths["candidates_md"]), "candidates_json_path": str(paths["candidates_json"]), "persona_path": str(paths["persona"]),
    }
    share = grade.correction_share(phrases).first()
    kind = t.classify_kind(F.col("text"), F.col("norm_key"), F.col("is_correction"))
    top = [r.asDict() for r in phrases.where(kind == "constraint").orderBy("ord").limit(x.ITEMS_SHOWN).select("text", "count").collect()]
    projects = [r.asDict() for r in grade.project_distribution(rows).collect()]
    written = {"candidates_md": report.candidates_md(found, summary), "candidates_json": report.candidates_json(found, summary), "persona": report.persona_md(found, share["total"] or 0, share["corrections"], top, projects)}
    for key, text in written.items():
        with sessions.replaced(paths[key]) as file:
            file.write(text)
    return summary


def run_synthesize(spark: SparkSession, out: Path, chat: synthesis.ChatFn, model: str) -> dict:
    path = out / FILES["candidates_json"]
    if not path.is_file():
        raise FileNotFoundError(f"{path} not found; run mine first")
    payload = json.loads(path.read_text(encoding="utf-8"))
    candidates = spark.createDataFrame(payload["candidates"], sessions.CANDIDATE).withColumn("section", t.review_section(F.col("kind"), F.col("confidence")))
    backend = str(payload["summary"].get("cluster_backend", "tfidf"))
    summary, conclusions, dropped = synthesis.synthesize(candidates, synthesis.cached_chat(chat, out / REPLIES, model))
    paths = {key: out / FILES[key] for key in ("conclusions_md", "conclusions_json")}
    result = {"model": model, "cluster_backend": backend, "candidate_count": len(payload["candidates"]), "summary": summary, "conclusions": conclusions, "dropped_count": dropped, **{f"{key}_path": str(p) for key, p in paths.items()}}
    written = {"conclusions_md": report.conclusions_md(summary, conclusions, model, backend, len(payload["candidates"])), "conclusions_json": json.dumps(result, ensure_ascii=False, indent=2) + "\n"}
    for key, text in written.items():
        with sessions.replaced(paths[key]) as file:
            file.write(text)
    return result


def lines(command: str, result: dict) -> list[str]:
    """What a person reads."""
    if command == "status":
        files = [f"{key}: {'yes' if f['exists'] else 'no'} ({f['size']} bytes)" for key, f in result["files"].items()]
        return [f"out_dir: {result['out_dir']}", f"out_dir_exists: {result['out_dir_exists']}", *files]
    if command == "mine":
        shown = ("out_dir", "cluster_backend", "utterance_count", "fork_duplicate_count", "phrase_count", "cluster_count", "candidate_count", "strong_count", "candidates_md_path", "candidates_json_path", "persona_path")
        return [f"{key.removesuffix('_path')}: {result[key]}" for key in shown]
    if command == "synthesize":
        counts = {"summary_count": len(result["summary"]), "conclusion_count": len(result["conclusions"])}
        shown = {key: result[key] for key in ("model", "cluster_backend", "candidate_count")} | counts | {"dropped_count": result["dropped_count"], "conclusions_md": result["conclusions_md_path"], "conclusions_json": result["conclusions_json_path"]}
        return [f"{key}: {value}" for key, value in shown.items()]
    return [f"{key}: {value}" for key, value in result.items()]


def _one_or_more(text: str) -> int:
    if not text.strip().lstrip("+").isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError(f"{text!r} is not a number from 1 on")
    return int(text)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="utterlode")
    parser.add_argument("--version", action="version", version=VERSION)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("extract", "mine", "synthesize", "status"):
        command = commands.add_parser(name)
        command.add_argument("--out", default="out")
        command.add_argument("--json", action="store_true")
        if name == "extract":
            command.add_argument("--sessions-dir", default="sessions")
        if name == "mine":
            command.add_argument("--min-count", type=_one_or_more, default=3)
            command.add_argument("--min-projects", type=_one_or_more, default=3)
            command.add_argument("--embedding", action="store_true", help="cluster by embeddings; sends the texts of phrases, needs UTTERLODE_EMBEDDING_*")
        if name == "synthesize":
            command.add_argument("--model", help="sends patterns of candidates, needs UTTERLODE_CHAT_*")
    args = parser.parse_args(argv)
    out = Path(args.out).expanduser().resolve()
    start = SparkSession.builder.appName("utterlode").getOrCreate
    try:
        if args.command == "status":
            result = sessions.status(out, FILES)
        elif args.command == "extract":
            result = run_extract(start(), str(Path(args.sessions_dir).expanduser().resolve()), out)
        elif args.command == "mine":
            config = embedding.EmbeddingConfig.from_env() if args.embedding else None
            extra = (embedding.http_fetcher(config), config.model, config.dimensions) if config else ()
            result = run_mine(start(), out, args.min_count, args.min_projects, *extra)
        else:
            config = synthesis.ChatConfig.from_env(args.model)
            result = run_synthesize(start(), out, synthesis.http_chat(config), config.model)
    except (FileNotFoundError, embedding.EmbeddingError, synthesis.ChatError, synthesis.ReplyError) as error:
        print(error, file=sys.stderr)
        return 1
    print(json.dumps(result, ensure_ascii=False, indent=2) if args.json else "\n".join(lines(args.command, result)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
