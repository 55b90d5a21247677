"""Words that defeat polynomial hashes, and the paths for frequent and very long ones."""

import hashlib
import random
import zlib

import numpy as np

from utterlode.llm import jaccard, packing, substring
from utterlode.llm import wordstream as ws
from utterlode.llm.queries import tokenizer_path


def thue_morse(n, a, b):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


PAIRS = [(thue_morse(n, "a", "b"), thue_morse(n, "b", "a")) for n in (1024, 4096)]


def bounds(words):
    text = " ".join(words).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = ws.word_bounds(data, np.array([0, len(text)]))
    return data, starts, ends


def test_hashes_tell_words_apart():
    rng = random.Random(1)
    words = [w for pair in PAIRS for w in pair] + ["a" * n for n in range(1, 60)] + ["".join(rng.choice("abcAB\u00e9") for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    words = list(dict.fromkeys(words))
    data, starts, ends = bounds(words)
    hashes, checks = ws.word_hashes(data, starts, ends), ws.word_checks(data, starts, ends)
    assert len(set(hashes.tolist())) == len(words)
    again = bounds(["pad", *reversed(words)])
    assert ws.word_hashes(*again)[1:][::-1].tolist() == hashes.tolist() and ws.word_checks(*again)[1:][::-1].tolist() == checks.tolist()
    folded = ws.word_hashes(*bounds(["ABC", "abc", "aBc"]), ws.LOWER_ASCII).tolist()
    assert len(set(folded)) == 1
    assert all(c == e - s for c, s, e in zip(checks.tolist(), starts.tolist(), ends.tolist(), strict=True) if e - s <= 8)


def test_operators_on_letter_swaps(spark):
    """Documents that differ by such words only share nothing."""
    texts = []
    for pair in PAIRS:
        x, y = ([w] * 13 for w in pair)
        tail = [f"t{len(pair[0])}{i}" for i in range(6)]
        texts += [" ".join(x), " ".join(y), " ".join(x + tail), " ".join(y + tail), " ".join(x)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    removed = {r["doc_id"]: r["n_removed"] for r in substring.dedup_substrings(rows).collect()}
    assert removed == {at + i: n for at in (0, 5) for i, n in enumerate([0, 0, 13, 13, 13])}
    parts = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(rows).collect()}
    assert parts == {at + i: (n, at + c) for at in (0, 5) for i, (n, c) in enumerate([(1, 0), (1, 1), (7, 2), (7, 3), (1, 0)])}

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packing.pack(rows, tokenizer_path()).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k in range(-(-len(ids) // 2048)):
            assert got[i, k] == zlib.crc32(ids[2048 * k : 2048 * (k + 1)].tobytes())


def test_word_table_verifies(monkeypatch):
    """Words of one hash keep their own ids (those of one length of at most 8 bytes cannot share one)."""
    monkeypatch.setattr(ws, "word_hashes", lambda data, starts, ends, fold=None, seed=0: np.full(len(starts), 7 + seed, np.uint64))
    table = packing.WordIds(tokenizer_path())
    words = ["apple", "banana", "cherry pie".replace(" ", "")[:7]]
    data, starts, ends = bounds(words)
    for _ in range(2):
        at, n = table.find(data, starts, ends, None)
        for w, a, k in zip(words, at.tolist(), n.tolist(), strict=True):
            assert table.ids[a : a + k].tolist() == table.tokenizer.encode(w, add_special_tokens=False).ids


def test_substring_hot_anchors(spark, monkeypatch):
    """A phrase in many contexts is dealt by its extensions, with the same result."""
    rng = random.Random(2)
    phrase = "one phrase that stands everywhere".split()
    texts = []
    for i in range(80):
        w = [f"w{rng.randrange(4)}" for _ in range(rng.randint(0, 12))]
        texts.append(w + phrase + [f"w{rng.randrange(3)}" for _ in range(rng.randint(0, 12))])
    rows = list(enumerate(" ".join(w) for w in texts))
    first, want = {}, {}
    for i, w in enumerate(texts):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in enumerate(texts):
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        want[i] = (len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for hot, share in ((substring.HOT, substring.HOT_SHARE), (3, 10_000)):
        monkeypatch.setattr(substring, "HOT", hot)
        monkeypatch.setattr(substring, "HOT_SHARE", share)
        got = {r["doc_id"]: (r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in substring.dedup_substrings(frame).collect()}
        assert got == want
    assert any(n for n, _ in want.values())


def test_jaccard_blocks(spark, monkeypatch):
    """A posting list cut into blocks gives the same links."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(30)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(4)}"
        texts.append(w + [f"t{i % 7}"])
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    label = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[b] = min(label[a], label[b])
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(rows).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) > 1
