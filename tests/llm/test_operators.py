"""Every operator against a brute-force version, and on nulls, empty and long texts, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from utterlode.llm import chat, jaccard, language, mixing, multiindex, packing, quantisation, substring, toxicity, warc
from utterlode.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def corpus(n=60, seed=5):
    """Documents with copies, near copies, shared passages, nulls, empty and very short texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        if i % 4 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage[: rng.randint(13, 40)]
        if i % 5 == 0 and texts:
            w = words(texts[rng.randrange(len(texts))])
            if w and i % 10:
                w[rng.randrange(len(w))] = "edited"
        texts.append(rng.choice([" ", "\n", " \t "]).join(w))
    texts += [None, "", "  \n ", "x", "A b c", "a B c", "É" * 30, "w " * 3000]
    rows = [(i, text, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s2", None]), 0) for i, text in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def odd(spark):
    """A null id, a repeated row, and columns named like the operators' own."""
    rows = [(1, "a b c d e f g", 1, "x"), (1, "a b c d e f g", 1, "x"), (None, "a b c d e f g", 2, "y"), (2, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, size int, n_words string").selectExpr("*", "'en' as lang", "'s' as source", "0L as n_chars", "'q' as score", "1 as copies", "'z' as _seeds")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_substring(docs, odd, empty):
    rows = sorted((r["doc_id"], words(r["text"])) for r in docs.collect())
    first, want = {}, {}
    for i, w in rows:
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in rows:
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = {r["doc_id"]: r for r in substring.dedup_substrings(docs).collect()}
    assert {i: (r["n_words"], r["n_removed"], r["text"] or "") for i, r in got.items()} == want
    assert any(r["n_removed"] for r in got.values())
    assert all(sum(x["end"] - x["start"] for x in r["repeats"]) == r["n_removed"] and all(x["end"] - x["start"] >= 13 for x in r["repeats"]) for r in got.values())
    assert substring.dedup_substrings(odd).count() == 4 and substring.dedup_substrings(empty).count() == 0


def test_jaccard(docs, odd, empty):
    sets = {}
    for r in docs.collect():
        w = words((r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert sum(find(i) != i for i in root) > 3
    rows = jaccard.jaccard_components(odd).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in rows) == [(0, 3, 0), (1, 3, 1), (1, 3, 1), (2, 0, 2)]
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_shared_line(spark):
    """A line that most documents share is answered without its bucket, and links stay exact."""
    rng = random.Random(3)
    line = "this line is in nearly every document of the table".split()
    texts = [line + [f"w{rng.randrange(9)}" for _ in range(rng.choice([0, 1, 1, 2, 2, 6]))] for _ in range(500)] + [[f"x{i}{j}" for j in range(6)] for i in range(60)]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    signed = rows.mapInArrow(jaccard._sign(5, 4), "doc_id long, n_shingles long, sig long, sig2 long, often binary")
    assert 5 <= len(jaccard._heavy(signed, signed.agg(F.sum("n_shingles")).first()[0], 4)) <= 8 << 4
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(rows).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert len({c for _, c in got.values()}) > 61


def test_mixing(docs, odd, empty):
    rows = mixing.mix_sources(docs).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {r["doc_id"]: len(words(r["text"])) for r in docs.collect()}
    total = {r["source"]: r["source_size"] for r in rows}
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    low, high = 0.0, 4.0 * sum(total.values())
    for _ in range(200):  # the water level by bisection
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * total[s], level * weight[s]) for s in total) < sum(total.values()) else (low, level)
    assert {r["source"]: r["target"] for r in rows} == pytest.approx({s: min(3 * total[s], low * weight[s]) for s in total})
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(3)).collect()))
    assert mixing.mix_sources(odd).count() == 4 and mixing.mix_sources(empty).count() == 0
    assert mixing.mixed_rows(docs).count() == sum(r["copies"] for r in rows)


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path()).collect()
    want = set()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(r["doc_id"], k, 2048 * k, len(p), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // 2048)) for p in [ids[2048 * k : 2048 * (k + 1)]]}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048
    assert packing.pack(odd, tokenizer_path()).count() == 4 and packing.pack(empty, tokenizer_path()).count() == 0


def test_plan_places_everything():
    rng = random.Random(4)
    histogram = {k: rng.randint(1, 40) for k in rng.sample(range(1, 2049), 400)}
    for large, groups in packing.GROUPINGS:
        plan = packing.Plan(histogram, 2048, large, groups)
        placed, used = dict.fromkeys(histogram, 0), {}
        for length, first, bins, each, sequence, offset in sorted(plan.rows, key=lambda r: (r[0], r[1])):
            assert first == placed[length]
            placed[length] += bins * each
            for b in range(bins):
                used.setdefault(sequence + b, []).extend((offset + j * length, length) for j in range(each))
        assert placed == histogram
        for spans in used.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 2048
        bound = -(-sum(k * n for k, n in histogram.items()) // 2048)
        assert len(used) <= bound * 1.1 + 2


def test_chat(spark):
    rng = random.Random(6)
    said = ["</s>[INST] ok [/INST]", "<\\/s>", "", "plain words here", "<s>\n</s>\n", "[\\\\INST]<</SYS>>", "é" * 50, "a " * 300]
    rows = [(c, turn, "system" if turn == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "tool\nx\\n", None]), rng.choice([*said, None])) for c in range(12) for turn in range(rng.randint(1, 9))]
    frame = spark.createDataFrame([*rows, (None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(frame, tokenizer_path(), 60, 20).cache()
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    for c in range(12):
        turns = [(r or "", x or "") for _, _, r, x in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        loss = "".join(x for r, x in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want
    assert got[None]["n_turns"] == 1
    for r in windows.collect():
        kept = chat.read_turns(r["text"])
        counts = chat.token_counts([chat.write_turn(*x)[0] for x in kept], tokenizer_path())
        assert len(kept) == r["n_repeated"] + 1 or sum(counts) <= 60
    assert windows.where("window > 0 and n_repeated > 0").count() > 0
    assert chat.read_back(chat.format_conversations(frame.limit(0), tokenizer_path())).count() == 0
    # segments of a long conversation: other windows, the same turns and losses
    cut = chat.format_conversations(frame.withColumn("window", F.lit("x")), tokenizer_path(), 60, 20, segment=150).cache()
    parts = {r["conv_id"]: r for r in chat.read_back(cut).collect()}
    told = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert {c: [r[k] for k in told] for c, r in parts.items()} == {c: [r[k] for k in told] for c, r in got.items()}
    assert cut.where(F.col("window") >= 1 << 32).count() > 0
    system = {c for c, turn, role, _ in rows if turn == 0 and role == "system"}
    for r in cut.where("window > 0").collect():
        assert (chat.read_turns(r["text"])[0][0] == "system") == (r["conv_id"] in system)


def test_chat_counts_tokens(spark):
    """Texts without spaces are as long as their tokens; repeated rows stay."""
    rows = [(1, i, "user" if i % 2 else "assistant", "\u4f60\u597d\u4e16\u754c" * 500) for i in range(3)] + [(2, 0, "user", "x"), (2, 0, "user", "x")]
    windows = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), tokenizer_path()).collect()
    assert sorted(r["conv_id"] for r in windows) == [1, 1, 1, 2]
    assert [len(chat.read_turns(r["text"])) for r in windows if r["conv_id"] == 2] == [2]


def test_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i} x\r\n", ["same", "é" * 5000, f"page {i}", None, ""][i % 5]) for i in range(40)] + [(None, None, "same"), (40, "u", "same"), (40, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_records(pages, str(tmp_path / "a"), chunk=700)
    archive = spark.read.parquet(str(tmp_path / "a"))
    text = b"".join(bytes(r["data"]) for r in archive.orderBy("record_id", "copy", "chunk_no").collect()).decode()
    named, referred = set(re.findall(r"WARC-Record-ID: (<urn:uuid:[0-9a-f-]{36}>)", text)), set(re.findall(r"WARC-Refers-To: (\S+)", text))
    assert referred and referred <= named and len(referred) == len(set(re.findall(r"WARC-Refers-To-Target-URI: (\S+)", text)))
    assert archive.groupBy("record_id").count().agg(F.max("count")).first()[0] > 10
    got = [r for r in warc.read_records(archive).collect()]
    assert len(got) == len(rows)
    body = {i: (h or "").encode() for i, _, h in rows}
    last = {b: max(i for i in body if i is not None and body[i] == b) for b in body.values()}
    for r in got:
        if r["page_id"] is not None:
            payload = body[r["page_id"]]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
            assert (r["record_type"], r["refers_to"]) == (("response", None) if last[payload] == r["page_id"] else ("revisit", last[payload]))
    # many digests: by shuffle instead of broadcast, with the same records
    warc.write_records(pages.withColumn("digest", F.lit(1)).withColumn("copy", F.lit("x")), str(tmp_path / "many"), chunk=700, few=0)
    again = warc.read_records(spark.read.parquet(str(tmp_path / "many")))
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, again.collect())) == sorted(map(key, got))
    damaged = archive.withColumn("data", F.when(F.col("chunk_no") == 3, F.lit(b"x")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="digest|ends before"):
        warc.read_records(damaged).collect()
    warc.write_records(pages, str(tmp_path / "b"), min_bytes=10)
    assert {r["payload_bytes"] for r in warc.read_records(spark.read.parquet(str(tmp_path / "b"))).where("record_type = 'revisit'").collect()} == {10000}
    warc.write_records(pages.limit(0), str(tmp_path / "c"))
    assert warc.read_records(spark.read.schema(archive.schema).parquet(str(tmp_path / "c"))).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"
BAD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [1.0], 1), (None, [1.0] * 16, 1), (905, [float("inf")] * 16, None)]


def vectors(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16)).astype(np.float32)
    x[50:90] = x[:40] + 0.05 * rng.standard_normal((40, 16)).astype(np.float32)
    x[90:120] = x[0]
    return [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)]


def best_of(x, q, top=20):
    score = (x * x[q]).sum(axis=1)
    return [i for i in np.lexsort((np.arange(len(x)), -score)).tolist() if i != q][:top]


def recall(found, x, step=20):
    by_query = {}
    for r in found:
        by_query.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q in range(0, len(x), step):
        own = sorted(by_query[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert own == sorted(own, key=lambda r: (-r["score"], r["vec_id"]))
        assert all(abs(r["score"] - float((x[q] * x[r["vec_id"]]).sum())) < 1e-12 for r in own)
        best = set(best_of(x, q))
        hits, total = hits + len({r["vec_id"] for r in own} & best), total + len(best)
    return hits / total


def test_multi_index(spark):
    rows = vectors()
    x = np.array([v for _, v, _ in rows], np.float64)
    frame = spark.createDataFrame(rows + BAD, VECTORS).selectExpr("*", "'q' as id", "1 as i", "'z' as vector", "2 as salt")
    assert recall(multiindex.search(frame, lambda i: i % 20 == 0).collect(), x) >= 0.9
    assert multiindex.search(spark.createDataFrame([], VECTORS), lambda i: i % 20 == 0).count() == 0
    few = multiindex.search(spark.createDataFrame(rows[:3], VECTORS), lambda i: i % 20 == 0).collect()
    assert [r["vec_id"] for r in few if r["query_id"] == 0] and len(few) == 2
    tied = [(i, [1.0, 0.0], 0) for i in (0, 9, 3, 5)] + [(3, [1.0, 0.0], 0), (20, [2.0, 2.0, 2.0], 0)]
    found = multiindex.search(spark.createDataFrame(tied, VECTORS), lambda i: i % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(0, 1, 3), (0, 2, 5), (0, 3, 9)]


def test_multi_index_is_a_search(spark, monkeypatch):
    """Vectors with structure: a small part of the rows is visited, and blocks stay within their bound."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((300, 32))
    x = (centres[rng.integers(300, size=6000)] + 0.3 * rng.standard_normal((6000, 32))).astype(np.float32)
    monkeypatch.setattr(multiindex, "BLOCK", 500)
    shares = []
    monkeypatch.setattr(multiindex, "needed_share", lambda *a, own=multiindex.needed_share: shares.append(own(*a)) or shares[-1])
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS).repartition(6)
    assert recall(multiindex.search(frame, lambda i: i % 20 == 0).collect(), x.astype(np.float64)) >= 0.9
    assert shares[0] <= 0.3


def test_walk_by_summed_distance():
    rng = np.random.default_rng(2)
    a, b, counts = rng.standard_normal(9), rng.standard_normal(7), rng.integers(0, 4, (9, 7))
    cells = multiindex.walk(a, b, counts, counts.sum())
    total = [a[i] + b[j] for i, j in cells]
    assert total == sorted(total) and sum(counts[c] for c in cells) == counts.sum()
    some = multiindex.walk(a, b, counts, 10)
    assert some == cells[: len(some)] and sum(counts[c] for c in some) >= 10 > sum(counts[c] for c in some[:-1])


def test_multi_index_blocks():
    """A query asks a block once, whatever the number of its first codes there, and finds its visited cells' entries alone."""
    rng = np.random.default_rng(7)
    counts = rng.integers(0, 40, (32, 32))
    counts[5] = 90
    block, salts = multiindex.blocks_of(counts.sum(axis=1), 2000)
    held = np.bincount(block, counts.sum(axis=1))
    assert len(held) < 16 and (np.diff(block) >= 0).all() and salts[5] == 2 and (block == block[5]).sum() == 1
    assert all(n <= 2000 or n == counts[5].sum() for n in held.tolist())
    x, first, second = rng.standard_normal((40, 8)), rng.standard_normal((32, 4)), rng.standard_normal((32, 4))
    batch = pa.RecordBatch.from_pydict({"id": list(range(40)), "set": pa.array([0] * 40, pa.int32()), "vector": [v.tolist() for v in x]})
    made = pa.Table.from_batches(list(multiindex._probe(8, first, second, counts, counts.sum(), block, salts)(iter([batch]))))
    assert made.num_rows == 40 * (len(held) + 1)
    assert sum(map(len, made.filter(pa.compute.equal(made["salt"], 0))["cells"].to_pylist())) == 40 * np.count_nonzero(counts)
    cell, entries = np.sort(rng.integers(0, 50, 600)), rng.standard_normal((600, 8))
    for share in (3, 45):
        wanted = [rng.choice(50, share, replace=False).tolist() + [60] for _ in range(40)]
        made = multiindex._Block([(np.arange(600), cell, entries)]).found(np.arange(40), x, pa.array(wanted, pa.list_(pa.int32())), 5)
        found = list(zip(made[0].to_pylist(), made[1].to_pylist(), strict=True))
        for q in range(40):
            score = np.where(np.isin(cell, wanted[q]) & (np.arange(600) != q), entries @ x[q], -np.inf)
            assert [v for p, v in found if p == q] == np.argsort(-score)[:5].tolist()


def test_quantisation(spark):
    rows = vectors()
    got = {r["vec_id"]: r for r in quantisation.near_duplicates(spark.createDataFrame(rows + BAD, VECTORS)).collect()}
    x = np.array([v for _, v, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    assert len(got) == len(rows + BAD)
    assert [got[i]["n_links"] for i in range(400)] == near.sum(axis=1).tolist()
    label = np.arange(400)
    for _ in range(400):
        after = np.minimum(label, np.where(near, label, 400).min(axis=1))
        if (after == label).all():
            break
        label = after
    assert [got[i]["component_id"] for i in range(400)] == label.tolist()
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(400))
    assert got[90]["component_id"] == 0 and got[901]["n_links"] == 0 and got[904]["component_id"] == 904 and got[None]["component_id"] is None
    assert quantisation.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_quantisation_blocks_and_odd_rows(spark, monkeypatch):
    """Big buckets cut into blocks, repeated ids, vectors of several lengths, clashing columns."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal(12) + 0.05 * rng.standard_normal((60, 12)), rng.standard_normal((40, 12))]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(7, x[7].tolist(), 0), (200, [1.0, 2.0], 0), (201, [2.0, 4.0], 0)]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'q' as id", "1 as n", "'z' as vector", "2 as kept")
    monkeypatch.setattr(quantisation, "BLOCK", 8)
    got = quantisation.near_duplicates(frame).collect()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    links = {r["vec_id"]: r["n_links"] for r in got}
    assert len(got) == len(rows) and [r["n_links"] for r in got if r["vec_id"] == 7] == [links[7]] * 2
    for i in range(100):
        assert links[i] == near[i].sum() - 1 + (near[i, 7] if i != 7 else 1)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] >= 200} == {200: (1, 200), 201: (1, 200)}


def test_quantisation_off_centre(spark):
    """Vectors far from the origin: pairs at the threshold are found."""
    rng = np.random.default_rng(5)
    n, mean = 3000, rng.standard_normal(64) * 0.25
    x = mean + rng.standard_normal((n, 64)) * 0.14
    unit = x[:300] / np.linalg.norm(x[:300], axis=1, keepdims=True)
    toward = (x[1000:1300] - x[2000:2300])
    toward -= (toward * unit).sum(axis=1, keepdims=True) * unit
    toward /= np.linalg.norm(toward, axis=1, keepdims=True)
    x[300:600] = 0.952 * unit + np.sqrt(1 - 0.952**2) * toward
    x = x.astype(np.float32).astype(np.float64)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    assert np.linalg.norm((x / norms).mean(axis=0)) > 0.8
    near = (x / norms) @ (x / norms).T >= 0.95
    np.fill_diagonal(near, False)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in quantisation.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    found, all_ = sum(got.values()), int(near.sum())
    assert all_ >= 600 and 0.99 * all_ <= found <= all_


def labelled(n=400):
    rng = random.Random(9)
    speech = {"aa": ["the", "and", "thing", "over"], "bb": ["über", "nicht", "schön", "zug"]}
    out = []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        w = [rng.choice(speech[lang]) + rng.choice(["", "en", "er"]) for _ in range(rng.randint(3, 60))]
        toxic = int(i % 4 == 0)
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["scum", "idiot"])
        out.append((i, " ".join(w), lang, "s", 0, toxic))
    return out


def test_language(spark, empty):
    docs = spark.createDataFrame(labelled(), DOCS + ", toxic int")
    net = language.train(docs.where("doc_id % 5 <> 0"), "doc_id", "text", "lang")
    rows = language.predict(docs.withColumn("score", F.lit(7)), net, keep=("doc_id", "lang", "score")).where("doc_id % 5 = 0").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (None, "nicht schön")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, net).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] == "bb"
    assert language.train(empty, "doc_id", "text", "lang") is None
    assert [r["lang_pred"] for r in language.predict(odd, None).collect()] == ["und"] * 4 and language.predict(empty, net).count() == 0


def test_toxicity(spark, empty):
    docs = spark.createDataFrame(labelled(), DOCS + ", toxic int")
    labels = docs.select("doc_id", "toxic").union(spark.createDataFrame([(1, None), (None, 1), (3, 0), (9999, 1)], "doc_id long, toxic int"))
    scorer = toxicity.train(docs, labels.where("doc_id % 5 <> 0"))
    rows = toxicity.score(docs, scorer, keep=("doc_id", "toxic")).where("doc_id % 5 = 0").collect()
    assert sum((r["score"] >= 0.5) == r["toxic"] for r in rows) / len(rows) > 0.95
    odd = spark.createDataFrame([(1, None), (2, "12 !"), (None, "a")], "doc_id long, text string")
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score(odd, scorer).collect())
    assert toxicity.train(empty, labels) is None and toxicity.train(docs, labels.where("toxic = 0")) is None
    assert toxicity.score(empty, scorer).count() == 0 and toxicity.score(docs, None).where("score <> 0").count() == 0


def test_pipeline(spark, tmp_path):
    rows = labelled(200)
    spark.createDataFrame(rows, DOCS + ", toxic int").select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame([(900, rows[1][1], "aa", None, 0), (None, None, None, None, None)], DOCS)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, r[5]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = before = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        assert docs.columns == before.columns
    kept = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "s1")).collect()}
    toxic = {r[0] for r in rows if r[5]}
    assert len(kept & toxic) <= 3 and len(kept) > 140 and 900 not in kept and None in kept
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= docs.select("doc_id").distinct().count()


def test_pipeline_odd_rows(spark, tmp_path):
    """Repeated ids with equal and with different texts, clashing columns, empty tables."""
    texts = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "quite another text of the same id here"), (2, "a b c d e f g h"), (3, None), (4, ""), (None, "a b c d e f g h")]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in texts], DOCS).selectExpr("*", "1 as size", "'x' as component_id", "2 as copies", "'y' as score")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, texts[0][1]), (1, texts[0][1]), (1, texts[2][1]), (3, ""), (4, "")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert "component_id" in docs.columns and docs.count() >= 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
