"""Session files in, utterances and reports out."""

from __future__ import annotations

import contextlib
import os
import re
from collections.abc import Iterator
from pathlib import Path
from typing import IO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UTTERANCE = "utterance_id string, session_id string, entry_id string, timestamp string, cwd string, project_key string, text string, char_len long, source_file string"
CANDIDATE = "number long, candidate_id string, label string, count long, project_count long, day_span long, kind string, suggested_dest string, confidence string, variant_count long, variants array<struct<text:string,count:long>>, project_keys array<string>"


def read_session_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``source_file`` (relative), ``line_no``, ``raw`` of every line of every ``*.jsonl`` below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(folder).select("path", "content")
    if names := hidden_files(spark, folder):
        files = files.unionByName(spark.createDataFrame([(n,) for n in names], "path string").repartition(len(names)).mapInArrow(_contents, "path string, content binary"))
    root = F.lit(str(folder).rstrip("/") + "/")
    path = F.url_decode(F.regexp_replace(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")), r"\A[a-z]+:/*", "/"))
    relative = F.expr("substring(_path, length(_root) + 1)")
    texts = files.select(path.alias("_path"), F.regexp_replace(root, r"\A[a-z]+:/*", "/").alias("_root"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")).select(relative.alias("source_file"), "text")
    return texts.select("source_file", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "raw"))


def hidden_files(spark: SparkSession, folder: str) -> list[str]:
    """``*.jsonl`` files that Spark passes over: their names, or those of a folder on the way, begin with ``_`` or ``.``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    root, found, each = files.makeQualified(path).toString().rstrip("/"), [], files.listFiles(path, True)
    while each.hasNext():
        name = each.next().getPath().toString()
        if name.endswith(".jsonl") and any(part[0] in "_." for part in name[len(root) :].split("/") if part):
            found.append(name)
    return found


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name in batch.column("path").to_pylist():
            name = name.replace("%", "%25").replace(" ", "%20")  # as Spark names the others
            files, path = pa.fs.FileSystem.from_uri(re.sub(r"\Afile:/+", "file:///", name))
            with files.open_input_file(path) as source:
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([source.read()], pa.binary())], ["path", "content"])


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(UTTERANCE).option("mode", "FAILFAST").json(path)


def write_utterances(utterances: DataFrame, path: str, parts: bool = False) -> None:
    """One JSON object a line, in order of ``seq``. As one file, it streams through the driver, and an older one stays if
    writing fails; with ``parts``, ``path`` is a folder of files whose names are in order, written by the executors."""
    columns = [c.split()[0] for c in UTTERANCE.split(", ")]
    rows = utterances.orderBy("seq").select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))
    if parts:
        rows.write.text(path)
        return
    with replaced(Path(path)) as out:
        for row in rows.toLocalIterator():
            out.write(row["line"] + "\n")


@contextlib.contextmanager
def replaced(path: Path, mode: str = "w") -> Iterator[IO]:
    """A file that takes its place only when it has been written whole (K1)."""
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(f"{path.name}.tmp")
    try:
        with draft.open(mode, encoding=None if "b" in mode else "utf-8") as out:
            yield out
        os.replace(draft, path)
    finally:
        draft.unlink(missing_ok=True)


def status(folder: Path, names: dict[str, str]) -> dict:
    """Presence and size of the files, or tables, that a run leaves."""

    def size(path: Path) -> int:
        return sum(f.stat().st_size for f in path.rglob("*") if f.is_file()) if path.is_dir() else path.stat().st_size if path.exists() else 0

    files = {key: {"path": str(folder / n), "exists": (folder / n).exists(), "size": size(folder / n)} for key, n in names.items()}
    return {"out_dir": str(folder), "out_dir_exists": folder.is_dir(), "files": files}
