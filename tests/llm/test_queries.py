"""The registered queries themselves, on small tables, against brute force; and edge cases of the learnt operators."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlode.llm import language, mixing, queries, toxicity
from utterlode.llm.queries import tokenizer_path


def folder_of(spark, path):
    rng = random.Random(12)
    speech = {"aa": ["the", "and", "thing", "over"], "bb": ["über", "nicht", "schön", "zug"]}
    docs, labels = [], []
    for i in range(240):
        lang = rng.choice(["aa", "bb"])
        w = [rng.choice(speech[lang]) + rng.choice(["", "en", "er", "'s", "!", " 12"]) for _ in range(rng.randint(3, 60))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["scum", "idiot"])
        docs.append((i, " ".join(w), lang, rng.choice(["s1", "s2", None])))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(240, None, "aa", "s1"), (241, "", None, "s2"), (242, "12 + 3", "bb", None), (243, " ".join(rng.choice(speech["aa"]) for _ in range(9000)), "aa", "s1"), (244, "x" * 30_000, "aa", "s1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = np.random.default_rng(2).standard_normal((300, 12)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    pages = [(i, f"http://h/{i % 7}", ["same", f"page {i}" * 50, None, "", "é" * i][i % 5]) for i in range(60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{path}/pages.parquet")
    said = ["hello", "</s>[INST] ok [/INST]", None, "é " * 40, "你好" * 300]
    turns = [(c, k, ["system", "user", "assistant"][0 if k == 0 and c % 3 == 0 else 1 + k % 2], rng.choice(said)) for c in range(20) for k in range(rng.randint(1, 9))]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return docs, labels, vectors, pages, turns


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    return str(path), folder_of(spark, str(path))


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_op1(spark, tables):
    path, (_, _, vectors, _, _) = tables
    x, hits = vectors.astype(np.float64), 0
    found = queries.op1_multi_index(spark, path).collect()
    for q in range(0, 300, 20):
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        score = (x * x[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(300), -score)).tolist() if i != q][:20]
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(r["score"] == pytest.approx(score[r["vec_id"]], abs=1e-12) for r in own)
        hits += len({r["vec_id"] for r in own} & set(best))
    assert len(found) == 300 and hits / 300 >= 0.9


def test_op2(spark, tables):
    path, (docs, *_) = tables
    got = {r["doc_id"]: r for r in queries.op2_language(spark, path).collect()}
    assert len(got) == len(docs) and all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert [got[i]["lang_pred"] for i in (240, 241, 242)] == ["und"] * 3 and got[243]["lang_pred"] == "aa"
    told = [(lang, got[i]["lang_pred"]) for i, _, lang, _ in docs[:240] if held_out(i)]
    assert sum(a == b for a, b in told) / len(told) > 0.9


def test_op5(spark, tables):
    path, (docs, labels, *_) = tables
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, path).collect()}
    assert len(got) == len(docs) and all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    told = [(toxic, got[i]["predicted"]) for i, _, toxic in labels if held_out(i)]
    assert sum(a == b for a, b in told) / len(told) > 0.9
    assert [got[i]["predicted"] for i in (240, 241, 242, 243, 244)] == [0] * 5


def test_op7(spark, tables):
    from tokenizers import Tokenizer

    path, (docs, *_) = tables
    tokenizer, want = Tokenizer.from_file(tokenizer_path()), set()
    for i, text, _, _ in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, 2048 * k, len(ids[2048 * k : 2048 * (k + 1)]), zlib.crc32(ids[2048 * k : 2048 * (k + 1)].tobytes())) for k in range(-(-len(ids) // 2048))}
    rows = queries.op7_packing(spark, path).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048


def test_op8(spark, tables):
    path, (*_, turns) = tables
    rows = [*turns, *queries.CONTROL_CONVERSATION]
    got = {r["conv_id"]: r for r in queries.op8_chat(spark, path).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        said = [(role, text or "") for _, _, role, text in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        loss = "".join(x for role, x in said if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(said), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()) and r["formatted_chars"] > len(loss)


def test_op9(spark, tables):
    path, (_, _, _, pages, _) = tables
    body = {i: (h or "").encode() for i, _, h in pages}
    last = {b: max(i for i in body if body[i] == b) for b in body.values()}
    got = {r["page_id"]: r for r in queries.op9_warc(spark, path).collect()}
    assert set(got) == set(body)
    for i, r in got.items():
        digest = base64.b32encode(hashlib.sha1(body[i]).digest()).decode()
        keeper = last[body[i]]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(body[i]), digest, *(("response", None) if keeper == i else ("revisit", keeper)))


def test_learners_on_odd_rows(spark):
    """Clashing columns, repeated rows and very long texts."""
    rows = [(i, " ".join([*["calm words here"] * 3, f"w{chr(97 + i % 26)}{chr(97 + i // 26)}", "vile" if i % 2 else "kind"]), i % 2, "l1" if i % 2 else "l2") for i in range(60)]
    rows += [rows[0], rows[1], (100, "calm " * 200_000, 0, "l1"), (101, None, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string").selectExpr("*", "'q' as score", "'z' as lang_pred", "1 as id", "2 as half", "3 as label", "4 as bytes", "5 as _text")
    scorer = toxicity.train(docs, docs.select("doc_id", "toxic"))
    scored = toxicity.score(docs, scorer, keep=tuple(docs.columns))
    assert set(scored.columns) == set(docs.columns) and scored.count() == len(rows)
    assert {r["score"] >= 0.5 for r in scored.where("doc_id = 1").collect()} == {True} and scored.where("doc_id = 100").first()["score"] < 0.5
    net = language.train(docs, "doc_id", "text", "lang")
    told = language.predict(docs, net, keep=tuple(docs.columns))
    assert set(told.columns) == set(docs.columns) and told.count() == len(rows) and len({r["lang_pred"] for r in told.where("doc_id = 1").collect()}) == 1
    assert told.where("doc_id = 101").first()["lang_pred"] == "und"


def test_toxicity_learns_from_all(spark, monkeypatch):
    """No text is too long or too many to be learnt from: the counts are those of all texts, with either join."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}x{chr(97 + rng.randrange(26))}" for _ in range(25_000)) + (" vile" if i % 2 else " kind"), i % 2) for i in range(12)]
    rows += [(20, rows[0][1], 0), (21, "", 1), (22, None, 1)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string, toxic int"), {}
    for _, text, toxic in rows:
        words = re.findall("[a-z]+", text or "")
        cell = want.setdefault(2 * (zlib.crc32((text or "").encode()) % 2) + toxic, {})
        for before, word in zip(["", *words], words, strict=False):
            cell.setdefault(word, set()).add(before)
    words = {w for c in want.values() for w in c}
    expected = sorted(tuple(len(want.get(c, {}).get(w, ())) for c in range(4)) for w in words)
    for most in (1_000_000, 0):
        monkeypatch.setattr(toxicity, "BROADCAST", most)
        monkeypatch.setattr(toxicity, "WHOLE", most)
        scorer = toxicity.train(docs, docs.select("doc_id", "toxic"))
        assert sorted(tuple(r[c] for c in toxicity.CELLS) for r in scorer.models.counts.collect()) == expected
    table = scorer.models.counts.toArrow().sort_by("word")
    ratios = scorer.models.ratios(np.stack([table.column(c).to_numpy() for c in toxicity.CELLS], axis=1).astype(float)).mean(axis=1).astype(np.float32)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, scorer).collect()}
    for i, text, _ in rows:
        own, first = toxicity._words(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len(text or "")]))
        x = toxicity._features(ratios[np.searchsorted(table.column("word").to_numpy(), own.view(np.int64))].astype(float), first)
        assert got[i] == pytest.approx(toxicity._curve(scorer.curve, x)[0], abs=1e-9)


def test_curve_of_separable_features():
    """Perfectly told classes end in a finite curve that tells them."""
    rng = np.random.default_rng(1)
    y = (np.arange(6000) % 2).astype(float)
    x = np.stack([np.where(y == 1, 2.85, 2.0) + 0.1 * rng.random(6000), rng.random(6000), 0.1 * rng.standard_normal(6000)], axis=1)
    curve = toxicity.fit_curve(x, y)
    assert np.isfinite(curve).all() and ((toxicity._curve(curve, x) >= 0.5) == (y == 1)).all()


def test_training_windows_cover_the_text(spark):
    """Any part of a labelled text may be learnt from, not only its start."""
    text = "a" * 5000 + " " + "b" * 5000
    frame = spark.createDataFrame([("x", text)], "label string, text string")
    rows = frame.mapInArrow(language._windows, "label string, window binary, mark long").collect()
    assert len(rows) == len(language.spans(len(text))) and any(set(bytes(r["window"])) == {ord("b")} for r in rows)


def test_mixing_ties(spark):
    """Rows without ids and of one size: the same ones are taken, however the table is dealt."""
    rows = [(None, f"one two w{i}", "s") for i in range(200)] + [(i * 64, "a b", "t") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = [sorted((r["text"], r["doc_id"] or 0) for r in mixing.mixed_rows(frame.repartition(n)).collect()) for n in (1, 7)]
    assert taken[0] == taken[1] and taken[0]
    assert frame.select(F.regexp_count("text", F.lit(mixing.WORD))).first()[0] == len(re.findall(mixing.WORD, rows[0][1]))
