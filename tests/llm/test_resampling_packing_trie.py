"""Resampling, packing and the prefix trie against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from reachlake.llm import packing, prefix_trie, resampling
from tests.llm.test_operators import clashing, docs_of, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def weights(docs, target):
    """Brute force: n_features, weight, score and rank of each (id, text), as a list in their order."""
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    runs = lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])]  # noqa: B905, E731
    bucket = lambda v: zlib.crc32(v.encode()) % 10000
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            counts.update(map(bucket, runs(words(x))))
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, x in docs:
        found = runs(words(x))
        weight = sum(map(gain, map(bucket, found))) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((k for k, (_, x) in enumerate(docs) if len(words(x)) >= 20), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for place, k in enumerate(able[: 25 * len(able) // 100]):
        out[k][4] = place + 1
    return [tuple(x) for x in out]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(1, 90)).title() for _ in range(60)]
    return [*base, base[0], None, "", " \n", "one", "Ünï ÀB-c9_d", "x" * 9000, "y" * 100_000 + " z", prose(rng, 9000), "a\x00b", "汉字 123 é", "Z[A`a{z", base[3] + " " + base[4]]


@pytest.mark.parametrize("window", [resampling.WINDOW, 50])
def test_resampling(spark, texts, window, monkeypatch):
    """Small windows cut texts between words; a worker of its own reads the constant, so this one goes by the functions alone."""
    target = texts[5:15] + [None, ""]
    docs = list(enumerate(texts, 10))
    want = weights(docs, target)
    if window == resampling.WINDOW:
        ids = [i for i, _ in docs]
        got = resampling.resample(clashing(docs_of(spark, texts, ids)), docs_of(spark, target))
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect())) == sorted(want)
        return
    import pyarrow as pa

    monkeypatch.setattr(resampling, "WINDOW", window)
    n = Counter()
    for text, _, of_pair, _ in resampling.features(*resampling.buffer_of(pa.array([x or "" for x in texts]))):
        n.update(text.tolist())
        n.update(of_pair.tolist())
    assert [n[i] for i in range(len(texts))] == [w[1] for w in want]


def test_windows_do_not_change_buckets(monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(30)] + ["ab", "cd", "", "e" * 400, "f"]
    array = pa.array(["left out", *texts])[1:]
    words = [WORD.findall(x) for x in texts]
    want = Counter((i, zlib.crc32(v.encode()) % 10000) for i, w in enumerate(words) for v in w + [f"{a} {b}" for a, b in zip(w, w[1:])])  # noqa: B905
    for window in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(resampling, "WINDOW", window)
        got = Counter()
        for text, single, of_pair, pair in resampling.features(*resampling.buffer_of(array)):
            got.update(zip(text.tolist(), single.tolist(), strict=True))
            got.update(zip(of_pair.tolist(), pair.tolist(), strict=True))
        assert got == want


def test_resampling_ties_nulls_and_empty(spark, texts):
    ids = [7, 7, None, None, 9]
    body = [texts[0] + " q" * 30] * 5
    got = resampling.resample(docs_of(spark, body, ids), docs_of(spark, [body[0]]), percent=100).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]
    assert len({(r.doc_id, r.score) for r in got}) == 3
    none = docs_of(spark, [])
    assert resampling.resample(none, none).collect() == []
    assert len(resampling.resample(docs_of(spark, texts[:4]), none).collect()) == 4


def library():
    return tokenizers.Tokenizer.from_file(packing.vocabulary_path())


def test_parts_equal_the_library():
    rng, own, parts = random.Random(5), library(), packing.parts_of(packing.vocabulary_path())
    pieces = [" ", "  ", "\n", "\n\n", "\t", " ", " ", "\x1c", "\x85", "a", "Bc", "é", "'s", "'re", "12", "!?", "<|endoftext|>", "汉", "\U0001f600", "don't", "x" * 70, ".", "\r\n", "é", "　"]
    texts = ["", " ", "\n", " a", "a ", "a  b", "a\n b", "a \nb", "  a", "x <|endoftext|> y"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for text in texts:
        for _ in range(2):  # unseen and cached
            assert np.frombuffer(parts.encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def check_packed(rows, docs, length):
    """rows are a whole and gapless packing of docs; returns the number of sequences."""
    own, pieces, bins = library(), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert {*pieces} == {i for i, _ in docs}
    for i, text in docs:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == length or k == 0
            at += r.length
        assert at == len(ids)
    for own_pieces in bins.values():
        at = 0
        for offset, n in sorted(own_pieces):
            assert offset == at
            at += n
        assert at <= length
    return len(bins)


def test_packing(spark, texts, monkeypatch):
    rng = random.Random(8)
    bodies = texts + [prose(rng, rng.randint(1, 60)) for _ in range(300)]
    docs = list(enumerate(bodies))
    monkeypatch.setattr(packing, "SHARD", 64)
    rows = packing.pack_sequences(clashing(docs_of(spark, bodies)), length=256).collect()
    total = sum(r.length for r in rows)
    assert check_packed(rows, docs, 256) <= math.ceil(total / 256) * 1.05
    assert check_packed(packing.pack_sequences(docs_of(spark, bodies[:40])).collect(), docs[:40], 2048) >= 1


def test_packing_defined_cases(spark):
    assert packing.pack_sequences(docs_of(spark, [])).collect() == []
    got = packing.pack_sequences(docs_of(spark, [None, "", "a", "a"], [None, 3, 3, None])).collect()
    assert sorted(r.length for r in got) == [1, 1, 2, 2] and len({r.sequence_id for r in got}) == 1
    assert sorted(r.offset for r in got)[0] == 0
    one = library().encode("word " * 2047, add_special_tokens=False).ids
    exact = "word" + " word" * 2046
    assert len(library().encode(exact).ids) == 2047 and one
    rows = packing.pack_sequences(docs_of(spark, [exact, exact + " word", exact + " word word"])).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in rows) == [(0, 0, 2048), (1, 0, 1), (1, 1, 2048), (2, 0, 2), (2, 1, 2048)]


def test_place_takes_the_least_sum_of_squares():
    rng = random.Random(2)
    sizes = [rng.randint(1, 20) for _ in range(400)]
    placed, offsets, gaps = packing.place(sizes, 20)
    left, opened = {}, 0
    for size, number, offset in zip(sizes, placed, offsets, strict=True):
        def total(after):
            return sum(n * n for g, n in Counter(after).items() if 0 < g < 20)
        choices = [total([*left.values(), 20 - size])] + [total([g - size if k == b else g for k, g in left.items()]) for b, g in left.items() if g >= size]
        if number not in left:
            assert number == opened and offset == 0
            opened += 1
            left[number] = 20
        else:
            assert offset == 20 - left[number] and left[number] >= size
        left[number] -= size
        assert total(left.values()) == min(choices)
    assert [left[i] for i in range(opened)] == gaps


def trie(rows):
    """Brute force by the definition; rows are (conv_id, turn, role, text) without repeated turns."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = hashlib.sha256(",".join(map(str, sorted(c for c in own if len(built[c]) == len(node)))).encode()).hexdigest()
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), sum(len(n) == len(node) + 1 for n in below), len(leaves), saved, ends))
    return sorted(out, key=str)


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("stretch", [prefix_trie.STRETCH, 3])
def test_prefix_trie(spark, stretch, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    rng, rows = random.Random(4), []
    for c in [*range(0, 30), 35, 36, 38, 41, 97, 1000]:
        if c % 5 == 0 and c % 3 == 0:
            continue
        for turn in [None, *range(rng.choice([1, 2, 4, 9, 12]))]:
            rows.append((c, turn, rng.choice(["user", "user", "system", None]), rng.choice(["", "é", "hello", None]) if turn is None or turn > 2 else "same"))
    rows += [(200 + c, t, "user", f"t{t}") for c in range(12) for t in range(10)]
    got = prefix_trie.prefix_trie(clashing(spark.createDataFrame(rows, CONV)))
    assert sorted(map(tuple, got.collect()), key=str) == trie(rows)


def test_prefix_trie_defined_cases(spark, monkeypatch):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONV)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], CONV)).collect() == []
    # 6 is rebuilt from the first turns of 5, which is absent, and its own after them.
    lost = prefix_trie.prefix_trie(spark.createDataFrame([(6, 0, "user", "x")], CONV)).collect()
    assert zlib.crc32(b"6") % 9 >= 1 and [(r.depth, r.n_convs, r.n_leaves, r.saved_tokens) for r in lost] == [(0, 1, 1, 0)]
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    copies = [(5 * c, t, "user", "same") for c in range(7) for t in range(2)] + [(5, 1, "user", "same")]
    rows = prefix_trie.prefix_trie(spark.createDataFrame(copies, CONV).repartition(3), rebuild=False).orderBy("depth").collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in rows] == [(0, 0, 7, 1, 1, 48), (0, 1, 7, 1, 1, 48), (0, 2, 7, 1, 1, 24), (5, 3, 1, 0, 1, 0)]
    assert rows[2].ends_sha256 == hashlib.sha256(b"0,10,15,20,25,30").hexdigest()
    long = spark.range(5000).select(F.lit(10).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    assert prefix_trie.prefix_trie(long).agg(F.count("*"), F.max("depth"), F.sum("n_convs")).first() == (5001, 5000, 5001)
