import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from utterlode import cli
from utterlode.functions import text as t
from utterlode.operators import clusters, components, embedding, extract, grade, neardup, synthesis
from utterlode.operators.components import connected_components
from utterlode.plans.durable import saved
from utterlode.plans.numbering import numbered
from utterlode.sources import report, sessions


def column(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, c string").select("i", f(F.col("c")).alias("v"))
    return [r["v"] for r in rows.orderBy("i").collect()]


def test_scalars(spark):
    assert column(spark, ["  Git   COMMIT！ ", "ＯＫ。", "…先别改代码，只讨论方案。", "！？"], t.normalize_key) == ["git commit", "ok", "先别改代码,只讨论方案", ""]
    assert column(spark, ["read docs/a.md", "v 0.7.0 x", "docs/plan/a.md", "1"], t.match_key) == ["read §p", "v §n x", "docs/plan/a.md", "1"]
    assert column(spark, ["/resume", "/compact now", "/review a\nb", "/api/v1/novels 参数", "/home/a/b see"], t.is_slash_command) == [True, True, True, False, False]
    assert column(spark, ["好的", "ok", "a", "1", "hi", "执行", "12"], t.is_confirm_key) == [True] * 5 + [False] * 2
    assert column(spark, ["a" * 70, "x  y"], lambda c: t.clip(c, 60)) == ["a" * 59 + "…", "x y"]
    assert column(spark, ['<skill name="plan">x', "# Title\nbody"], lambda c: t.display_label(c, F.lit("template"))) == ["skill: plan", "Title"]
    assert column(spark, ["2024-01-31T00:00", "bad", "2024-13-01"], lambda c: t.day_span(F.lit("2024-01-01"), c)) == [30, 0, 0]
    assert column(spark, ["/Users/me/x", "/home/me", "/opt/x"], t.display_cwd) == ["~/x", "~", "/opt/x"]


def test_classify(spark):
    kinds = column(spark, ["<skill a", "do not push", "run git status", "commit it", "请commit吧", "请用中文", "hm"], lambda c: t.classify_kind(c, c, t.is_correction_key(c)))
    assert kinds == ["template", "constraint", "tooling", "workflow", "other", "preference", "other"]


SESSION = [
    {"type": "session", "id": "s1", "cwd": "/Users/me/demo"},
    {"type": "message", "id": "e1", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "bc"}]}},
    {"type": "message", "id": "e2", "timestamp": "", "message": {"role": "assistant", "content": "no"}},
    {"type": "message", "id": "e3", "message": {"role": "user", "content": " /compact now"}},
    {"type": "message", "id": "e4", "message": {"role": "user", "content": "好的。"}},
    {"type": "message", "id": "e5", "message": {"role": "user", "content": 5}},
    "a string",
]


def test_extract_and_cli(spark, tmp_path):
    folder = tmp_path / "sessions" / "proj"
    folder.mkdir(parents=True)
    lines = [json.dumps(x) for x in SESSION] + ["", "not json"]
    (folder / "1.jsonl").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "sessions" / "lone.jsonl").write_text(json.dumps(SESSION[1]), encoding="utf-8")
    counts = cli.run_extract(spark, str(tmp_path / "sessions"), tmp_path / "out")
    assert {k: v for k, v in counts.items() if isinstance(v, int)} == {"session_file_count": 2, "utterance_count": 1, "project_count": 1, "skipped_no_session": 1, "skipped_empty": 1, "skipped_slash": 1, "skipped_confirm": 1, "skipped_malformed": 2}
    assert counts["output_path"] == str(tmp_path / "out" / "utterances.jsonl")
    rows = sessions.read_utterances(spark, str(tmp_path / "out" / "utterances.jsonl")).collect()
    assert [(r["text"], r["project_key"], r["cwd"], r["char_len"]) for r in rows] == [("a\nbc", "proj", "/Users/me/demo", 4)]
    summary = cli.run_mine(spark, tmp_path / "out", 1, 1)
    assert summary["phrase_count"] == summary["cluster_count"] == summary["candidate_count"] == 1
    assert summary["fork_duplicate_count"] == 0 and summary["persona_path"] == str(tmp_path / "out" / "persona.md")
    assert "fork_duplicate_count: 0" in cli.lines("mine", summary) and cli.lines("mine", summary)[-1].startswith("persona: ")
    assert "# 资产候选" in (tmp_path / "out" / "candidates.md").read_text(encoding="utf-8")
    result = cli.run_synthesize(spark, tmp_path / "out", lambda s, u: '```json\n{"conclusions": [{"statement": "x", "evidence": [1, 9]}, {"statement": ""}], "summary": [{"statement": "y", "evidence": [1]}]}\n```', "m")
    assert (result["conclusions"][0]["count"], result["dropped_count"], result["summary"][0]["evidence"]) == (1, 1, [1])
    assert "簇合计" in (tmp_path / "out" / "conclusions.md").read_text(encoding="utf-8").splitlines()[3]
    assert cli.lines("synthesize", result)[3:6] == ["summary_count: 1", "conclusion_count: 1", "dropped_count: 1"]
    assert cli.main(["status", "--out", str(tmp_path / "none")]) == 0 and cli.main(["mine", "--out", str(tmp_path / "none")]) == 1
    state = sessions.status(tmp_path / "out", cli.FILES)
    assert state["out_dir_exists"] and state["files"]["persona"]["exists"] and not state["files"]["embeddings"]["exists"] and len(state["files"]) == 7


def test_cli_refuses(tmp_path, monkeypatch, capsys):
    for name in ("UTTERLODE_EMBEDDING_BASE_URL", "UTTERLODE_EMBEDDING_API_KEY", "UTTERLODE_EMBEDDING_MODEL", "UTTERLODE_CHAT_BASE_URL", "UTTERLODE_CHAT_API_KEY", "UTTERLODE_CHAT_MODEL"):
        monkeypatch.delenv(name, raising=False)
    assert cli.main(["mine", "--embedding", "--out", str(tmp_path)]) == 1 and "UTTERLODE_EMBEDDING_BASE_URL" in capsys.readouterr().err
    assert cli.main(["synthesize", "--out", str(tmp_path)]) == 1 and "UTTERLODE_CHAT_API_KEY" in capsys.readouterr().err
    for bad in ("0", "-1", "x"):
        with pytest.raises(SystemExit):
            cli.main(["mine", "--min-count", bad, "--out", str(tmp_path)])


def test_hidden_files_and_bare_tokens(spark, tmp_path):
    """Files that Spark passes over are read; NaN outside strings is a null, inside them it stays."""
    (tmp_path / "s" / ".p x").mkdir(parents=True)
    said = {"type": "message", "id": "e1", "timestamp": "", "message": {"role": "user", "content": 'NaN "quoted" -Infinity'}}
    head = json.dumps(SESSION[0])
    (tmp_path / "s" / "_a.jsonl").write_text("\n".join([head, json.dumps(said | {"cost": float("nan"), "other": [float("-inf")]})]), encoding="utf-8")
    (tmp_path / "s" / ".p x" / "b%20.jsonl").write_text("\n".join([head, json.dumps(said)]), encoding="utf-8")
    (tmp_path / "s" / "c.jsonl").write_bytes("\n".join([head, json.dumps(said), "{NaN"]).encode() + b"\xff")
    counts = cli.run_extract(spark, str(tmp_path / "s"), tmp_path / "out")
    assert (counts["session_file_count"], counts["utterance_count"], counts["skipped_malformed"], counts["project_count"]) == (3, 3, 1, 3)
    rows = [json.loads(line) for line in (tmp_path / "out" / "utterances.jsonl").read_text(encoding="utf-8").splitlines()]
    assert [r["source_file"] for r in rows] == [".p x/b%20.jsonl", "_a.jsonl", "c.jsonl"] and {r["text"] for r in rows} == {said["message"]["content"]}
    utterances = sessions.read_utterances(spark, str(tmp_path / "out" / "utterances.jsonl")).withColumn("seq", F.monotonically_increasing_id())
    sessions.write_utterances(utterances, str(tmp_path / "parts"), parts=True)
    assert sorted(r["source_file"] for r in sessions.read_utterances(spark, str(tmp_path / "parts")).collect()) == sorted(r["source_file"] for r in rows)


def test_space_of_python(spark):
    """The separators of ASCII are white space."""
    assert column(spark, ["\x1c a\x1d\x1eb \x1f"], t.strip) == ["a\x1d\x1eb"]
    assert column(spark, ["\x1c A\x1d\x1eb \x1f!", "\x1c Ä\x1d\x1eb \x1f!"], t.normalize_key) == ["a b", "ä b"]
    assert column(spark, ["/go\x1fx", "/a\x1fb"], t.is_bare_path) == [False, False] and column(spark, ["/go\x1fx"], t.is_slash_command) == [True]
    texts = ["", " ", "a", "_a_b_", "$x+", "A\tB\x0bC", "~tilde~", "`q`", "¿Qué?", "ﬁne", "İ", "ß"]
    import unicodedata

    import regex

    noise = regex.compile(r"\A[\p{P}\p{S}\p{Z}]+|[\p{P}\p{S}\p{Z}]+\Z")
    assert column(spark, texts, t.normalize_key) == [noise.sub("", " ".join(unicodedata.normalize("NFKC", v).casefold().split())) for v in texts]


def test_numbers_without_one_task(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v"))
    got = sorted((r["v"], r["n"]) for r in numbered(rows, [F.desc("v")], "n", start=1).collect())
    assert [n for _, n in got] == list(range(1000, 0, -1))
    assert numbered(rows.limit(0), [F.desc("v")], "n").count() == 0


def test_components_spread(spark, monkeypatch):
    """Hubs and large components beyond what one task should hold."""
    monkeypatch.setattr(components, "FEW", 0)
    test_components_against_union_find(spark)
    star = [(5, i) for i in range(6, 300)] + [(1000 + i, 1001 + i) for i in range(9)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(star, "src long, dst long")).collect()}
    assert got == {n: 5 if n < 1000 else 1000 for e in star for n in e}


def test_mine_by_embedding(spark, tmp_path):
    """Phrases that only their vectors bring together form one candidate."""
    said = ["alpha one", "completely different words", "third thing"]
    lines = [{"utterance_id": f"u{i}", "session_id": "s", "entry_id": f"e{i}", "timestamp": f"2024-01-01T00:00:{i:02}", "cwd": "", "project_key": f"p{i % 3}", "text": said[i % 3], "char_len": 1, "source_file": "f"} for i in range(9)]
    (tmp_path / "utterances.jsonl").write_text("\n".join(map(json.dumps, lines)), encoding="utf-8")
    fetcher = lambda batch: [[0.0, 2.0] if x == said[2] else [3.0, 0.1 * len(x) / 30] for x in batch]
    summary = cli.run_mine(spark, tmp_path, 3, 3, fetcher, "m", 2)
    assert (summary["cluster_backend"], summary["phrase_count"], summary["cluster_count"], summary["candidate_count"]) == ("embedding", 3, 2, 2)
    assert json.loads((tmp_path / "candidates.json").read_text(encoding="utf-8"))["candidates"][0]["count"] == 6
    assert cli.run_mine(spark, tmp_path, 3, 3)["cluster_count"] == 3
    assert sessions.status(tmp_path, cli.FILES)["files"]["embeddings"]["size"] > 0


def test_retries():
    import io
    import urllib.error

    from utterlode.sources.remote import retried

    def failing(codes):
        left = list(codes)

        def call():
            if left:
                raise urllib.error.HTTPError("u", left.pop(0), "m", {}, io.BytesIO(b"why"))
            return {"ok": True}

        return call

    waits = []
    assert retried(failing([429, 503]), RuntimeError, 4, waits.append) == {"ok": True} and waits == [2.0, 4.0]
    with pytest.raises(RuntimeError, match="HTTP 400 why"):
        retried(failing([400]), RuntimeError, 4, waits.append)
    with pytest.raises(RuntimeError, match="HTTP 500"):
        retried(failing([500] * 9), RuntimeError, 3, waits.append)


def test_saved_tables_need_a_shared_folder(spark, monkeypatch):
    from utterlode.plans import durable

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        durable.shared_folder(Elsewhere())
    table = saved(spark.range(3), "t")
    assert table.count() == 3 and durable.own_folder(spark) in table._utterlode_path
    durable.discard(table)
    assert not (tmp := __import__("pathlib").Path(table._utterlode_path.removeprefix("file://"))).exists(), tmp


def test_replaced_keeps_the_old_file(tmp_path):
    (tmp_path / "f").write_text("old")
    with pytest.raises(ValueError), sessions.replaced(tmp_path / "f") as out:
        out.write("new")
        raise ValueError
    assert (tmp_path / "f").read_text() == "old" and not (tmp_path / "f.tmp").exists()


def test_jaccard_pairs_against_brute_force(spark):
    rng = random.Random(1)
    keys = sorted({"".join(rng.choice("ab ") for _ in range(rng.randint(1, 12))) for _ in range(120)})
    got = {(r["a"], r["b"]) for r in neardup.jaccard_pairs(spark.createDataFrame(list(enumerate(keys)), "ord long, key string"), 0.6).collect()}
    grams = [{k[i : i + 2] for i in range(len(k) - 1)} or {k} for k in keys]
    assert got == {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.6}


def test_jaccard_pairs_of_numbered_names(spark):
    """Names that differ by a number share every bigram with many others; few of them may meet, in more than one task."""
    names = [f"customer#{i:09}" for i in range(0, 1500)] + ["x" * (i % 3) + "".join(chr(97 + (j * j + j * i) % 26) for j in range(60 + i % 9)) for i in range(60)]
    frame = spark.createDataFrame(list(enumerate(names)), "ord long, key string")
    grams = [{k[i : i + 2] for i in range(len(k) - 1)} for k in names]
    alike = lambda a, b: len(a & b) / len(a | b)
    for threshold in (0.85, 0.7):
        pairs = neardup.jaccard_pairs(frame, threshold)
        got = sorted((r["a"], r["b"], r["similarity"]) for r in pairs.collect())
        assert got == [(i, j, alike(grams[i], grams[j])) for i in range(len(names)) for j in range(i + 1, len(names)) if alike(grams[i], grams[j]) >= threshold]
    assert pairs.rdd.getNumPartitions() > 1
    plan, met = neardup._meetings([len(g) for g in grams], 0.85), Counter()
    df = Counter(g for s in grams[:1500] for g in s)
    for s in grams[:1500]:
        ranked = sorted(s, key=lambda g: (df[g], g))
        met.update((least, *(ranked[i] for i in places)) for n, least, _, places in plan if n == len(s))
    assert sum(n * (n - 1) // 2 for n in met.values()) < 0.25 * 1500 * 1499 / 2


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}

    def find(n):
        return n if root[n] == n else find(root[n])

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_leaders_against_the_sequential_rule(spark):
    rng = random.Random(3)
    sims = {(i, j): rng.random() for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.15}
    want, leaders = {}, []
    for i in range(60):
        near = [(sims[(k, i)], -k) for k in leaders if (k, i) in sims]
        want[i] = -max(near)[1] if near else i
        if not near:
            leaders.append(i)
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a long, b long, similarity double")
    got = {r["ord"]: r["leader"] for r in clusters.leader_clusters(spark.range(60).withColumnRenamed("id", "ord"), pairs).collect()}
    assert got == want


def test_phrases_and_candidates(spark):
    rows = [(i, f"2024-0{1 + i % 5}-01T00:00:0{i % 10}", p, text) for i, (p, text) in enumerate([("p1", "Commit"), ("p2", "commit."), ("p3", "commit."), ("p1", "read docs/a.md"), ("p1", "read docs/b.md"), ("p1", "read docs/c.md"), ("p1", "/x/y")])]
    frame = spark.createDataFrame(rows, "seq long, timestamp string, project_key string, text string").withColumn("utterance_id", F.col("seq").cast("string"))
    kept = neardup.drop_forks(neardup.keyed(frame))
    phrases = saved(neardup.phrases(kept, neardup.key_groups(kept)), "phrases")
    assert [(r["text"], r["count"], r["project_keys"]) for r in phrases.orderBy("ord").collect()][:1] == [("commit.", 3, ["p1", "p2", "p3"])]
    got = grade.candidates(phrases, phrases.select("ord", F.col("ord").alias("leader"))).orderBy("number").collect()
    assert [(r["label"], r["kind"], r["confidence"], r["suggested_dest"]) for r in got] == [("commit.", "workflow", "strong", "skill"), ("read ‹路径›", "workflow", "medium", "prompt")]
    assert [(v["text"], v["count"]) for v in got[1]["variants"]] == [("read ‹路径›", 3)]
    line = grade.candidates(phrases, phrases.select("ord", F.col("ord").alias("leader"))).orderBy("number").select(synthesis.candidate_line()).first()[0]
    assert line == "#1 [workflow] 次数 3 项目 3 | commit. | 变体: commit. ×3"


def test_embed_uses_its_cache(spark, tmp_path):
    texts = spark.createDataFrame([(0, "a"), (1, "bb"), (2, "a")], "ord long, text string")
    fetcher = lambda batch: [[float(len(x)), 1.0] for x in batch]
    first = embedding.embed(texts, fetcher, "m", str(tmp_path / "cache")).orderBy("ord").collect()
    assert [[round(v, 6) for v in r["vector"]] for r in first] == [[0.707107, 0.707107], [0.894427, 0.447214], [0.707107, 0.707107]]

    def fail(batch):
        raise AssertionError

    assert embedding.embed(texts, fail, "m", str(tmp_path / "cache")).count() == 3
    with pytest.raises(embedding.EmbeddingError):  # another size of vector is another key
        embedding.embed(texts, fail, "m", str(tmp_path / "cache"), 7)


def test_embed_keeps_what_came(spark, tmp_path):
    """A batch that fails is told after the others are kept; the next run asks only for what is missing."""
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "ord long, text string").repartition(1)
    asked = str(tmp_path / "asked")

    def fetcher(batch):
        with open(asked, "a") as log:
            log.write(f"{len(batch)}\n")
        if "text 7" in batch and not __import__("os").path.exists(asked + ".mended"):
            raise OSError("no answer")
        return [[1.0, 2.0] for _ in batch]

    with pytest.raises(embedding.EmbeddingError, match="no answer"):
        embedding.embed(texts, fetcher, "m", str(tmp_path / "cache"))
    kept = spark.read.parquet(str(tmp_path / "cache")).count()
    assert 0 < kept < 300
    (tmp_path / "asked.mended").write_text("")
    (tmp_path / "asked").write_text("")
    assert embedding.embed(texts, fetcher, "m", str(tmp_path / "cache")).count() == 300
    assert sum(int(n) for n in (tmp_path / "asked").read_text().split()) == 300 - kept


def test_replies():
    assert synthesis.parse_reply('```json\n{"a": 1}\n```') == {"a": 1}
    for bad in ("[1]", "x"):
        with pytest.raises(synthesis.ReplyError):
            synthesis.parse_reply(bad)


def test_persona():
    text = report.persona_md([], 0, 0, [], [{"cwd": "~/a|b", "n": 2}])
    assert "share: n/a (0)" in text and "| ~/a\\|b | 2 |" in text


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_dense_pairs_in_blocks(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((90, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord long, vector array<double>")
    got = {(r["a"], r["b"]) for r in clusters.dense_pairs(frame, 0.6, block=20).collect()}
    near = x @ x.T >= 0.6
    assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if near[i, j]}
    # vectors in clusters: few cells are visited, nothing is lost
    y = np.random.default_rng(2).standard_normal((6, 8))[np.arange(240) % 6] + 0.1 * np.random.default_rng(3).standard_normal((240, 8))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "ord long, vector array<double>").repartition(3)
    found = [(r["a"], r["b"]) for r in clusters.dense_pairs(frame, 0.9, block=25).collect()]
    close = y @ y.T >= 0.9
    assert len(found) == len(set(found)) and set(found) == {(i, j) for i in range(240) for j in range(i + 1, 240) if close[i, j]}
    assert clusters.dense_pairs(frame.limit(0), 0.9).count() == 0


def test_visitors_pass_a_block_in_steps():
    """What a task holds beside its block doesn't grow with a batch of visitors."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    def rows(n, kind, seed):
        x = np.random.default_rng(seed).standard_normal((n, 8))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        whole = lambda v, t: pa.array(np.full(n, v), t)
        vectors = pa.ListArray.from_arrays(np.arange(0, 8 * n + 1, 8, dtype=np.int32), x.ravel())
        return pa.RecordBatch.from_arrays([whole(0, pa.int32()), whole(kind, pa.int32()), pa.array(np.arange(n) + 10000 * kind), whole(0, pa.int32()), vectors], ["block", "kind", "ord", "home", "vector"]), x

    (held, x), (visitors, y) = rows(2048, 0, 1), rows(10000, 1, 2)
    run = clusters._near_blocks(0.99, np.eye(8)[:1], np.array([np.pi]), np.zeros(1, int))
    tracemalloc.start()
    found = [(a, b) for part in run(iter([held, visitors])) for a, b in zip(part["a"].to_pylist(), part["b"].to_pylist(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [] and peak < 48e6  # a visitor counts where it comes before; 10000 by 2048 scores are 164 MB
    found = [(a, b) for part in clusters._near_blocks(0.9, np.eye(8)[:1], np.array([np.pi]), np.zeros(1, int))(iter([held, held.set_column(1, "kind", pa.array(np.ones(2048), pa.int32()))])) for a, b in zip(part["a"].to_pylist(), part["b"].to_pylist(), strict=True)]
    assert sorted(found) == [(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.9)), strict=True) if i < j]


def test_unit_vectors_take_the_norm_once(spark):
    """A norm for each component is the square of a vector's size: 10 to the power 10 steps here."""
    import time

    rows = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(4096)), lambda i: (i + F.col("id") % 7).cast("float")).alias("v"))
    began = time.time()
    off = rows.select(t.normalize_vector(F.col("v")).alias("u")).select(F.abs(F.aggregate("u", F.lit(0.0), lambda a, b: a + b * b) - 1).alias("off")).agg(F.max("off")).first()[0]
    assert off < 1e-9 and time.time() - began < 30
    zero = spark.sql("select array(0f, 0f) as v union all select array(3f, 4f) union all select cast(null as array<float>)")
    assert [r[0] for r in zero.select(t.normalize_vector(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8], None]


def test_vectors_travel_to_few_blocks(spark, monkeypatch):
    """Blocks are as many for a large table as for a small one, and nothing near is lost between them."""
    import numpy as np

    monkeypatch.setattr(clusters, "BLOCKS", 4)
    x = np.random.default_rng(5).standard_normal((400, 6))
    x[:150] = x[0] + 0.01 * x[:150]  # a cell of several blocks
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord long, vector array<double>")
    pairs = clusters.dense_pairs(frame, 0.6, block=5)
    assert pairs.rdd.getNumPartitions() <= 2 * 4 + 1
    found, near = [(r["a"], r["b"]) for r in pairs.collect()], x @ x.T >= 0.6
    assert len(found) == len(set(found)) and set(found) == {(i, j) for i in range(400) for j in range(i + 1, 400) if near[i, j]}
    for n in (1_000, 100_000):
        _, subs = clusters._grouped(x[:100], np.full(100, n), 100 * n // 32)
        assert subs.sum() <= 65


def test_lines_are_parsed_once(spark):
    """A filter on what a line says doesn't parse it again, nor one on the disposition fold its text again."""
    raw = [json.dumps(x) for x in SESSION] + [" ", "[1]", '{"type": "message", "id": 0, "message": {"role": "user", "content": "ÄB"}}']
    lines = spark.createDataFrame([("d/f", i, x) for i, x in enumerate(raw)], "source_file string, line_no long, raw string").repartition(2)
    kept = extract.with_disposition(extract.session_entries(extract.parse_lines(lines))).where("disposition = 'kept'")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 2 and plan.count("ArrowEvalPython") == 1  # as it stands, and with bare tokens mended
    said = [(r["entry_id"], r["session_id"], r["cwd"], r["text"], r["norm_key"]) for r in kept.orderBy("line_no").collect()]
    assert said == [("e1", "s1", "/Users/me/demo", "a\nbc", "a bc"), ("", "s1", "/Users/me/demo", "ÄB", "äb")]


def test_keys_are_folded_once(spark):
    """Rows that carry their normalized key aren't folded again; a masked text is worked out once."""
    rows = spark.createDataFrame([(1, "Read docs/A.md")], "seq long, text string")
    folded = neardup.keyed(saved(rows.withColumn("norm_key", F.lit("as given docs/a.md"))))
    assert [(r["norm_key"], r["match_key"]) for r in folded.collect()] == [("as given docs/a.md", "as given §p")]
    plan = rows.select(t.match_key(F.col("text")).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2
