"""Language-model scores by a weighted backoff automaton.

Tokens are the words of a text (A-Z lower-cased) and one end per text. The model is a backoff n-gram model with absolute
discounting over smoothed unigrams, (c + 0.1) / (N + 0.1 (V + 1)). Every n-gram of order 1 to 3 that occurs in the training
rows is a state of the automaton, at any size of the corpus; nothing is dropped for being rare. So the automaton grows with
the data and is nowhere held as a whole: its arcs and failure weights are worked out where the texts meet the counts.

1. Words are counted, first within a task. Words are numbers: those of at least the share COMMON of all tokens by rank, from a broadcast dictionary that has at most
   1 / COMMON words, the others by a hash that was checked to tell them all apart. The token numbers of up to FLUSH tokens
   are one row of a written table (a chunk); a text is never cut.
2. For order 3, 2 and 1, each chunk sends its distinct n-grams, with their counts in training rows, to buckets by
   hash, packed. A bucket adds up the counts of its n-grams, answers each chunk, and tells the buckets of the next lower order
   by how much the counts of the n-grams that continue a history exceed 1 each. A history that isn't the end of a text is always continued, so its
   count less that excess is the number of its arcs, which the failure weight needs. However common a word, pair or triple is, a
   chunk sends it once, and the number of buckets grows with the tokens, so no task grows with the corpus.
3. Each chunk meets its answers and its texts are scored.

A state of the automaton is the longest suffix of what was read that the model holds; an arc adds the discounted log-probability, a
failure arc the backoff weight of the state it leaves. With order 3 a state depends on the last two words alone, so no state is carried from
word to word: the states of all positions of a chunk, their arcs, and where these lack the failure arcs to the next shorter states, are taken at once, as
arrays, order by order. This gives what a traversal from left to right gives; one word at a time it would cost more than the tool's limit.

Defined cases: a null text is an empty one, whose only token is the end. Null ids hash as empty text. Rows that
repeat stay rows and count as often as they stand there. With no training rows (or none at all) N and V are 0,
the base gives log10 1 to the end of every text. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from reachlake.llm.common import id_hash, whole, written

ADD = 0.1
DISCOUNT = 0.6
#: Share of all tokens from which a word has its number from the dictionary.
COMMON = 1e-6
FOLDS = 10
#: The end of a text; no word holds a space.
END = " "
#: Tokens of a chunk from which the next text starts another, and tokens per bucket.
FLUSH, PER_BUCKET = 1 << 19, 1 << 20
#: Different words that a task counts before it gives them out.
MOST_WORDS = 1 << 17
#: Hexadecimal digits of the hash that numbers other words, at least and at most.
FEWEST, MOST = 12, 15
CHUNK = ["chunk", "ids", "held", "sizes", "tokens"]
PACKED = "chunk long, bucket long, blob binary"


class Ids(dict):
    """Word to number: the rank of common words, below zero for others."""

    salt, digits = b"0", FEWEST

    def __missing__(self, word: bytes) -> int:
        return (int.from_bytes(md5(self.salt + word).digest()[:8]) >> 64 - 4 * self.digits) - (1 << 4 * self.digits)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c, n): counts in training rows and in all, given out whenever MOST_WORDS different words have come together."""
    trained, held = Counter(), Counter()

    def given() -> pa.RecordBatch:
        found = list({**trained, **held})
        c = [trained[w] for w in found]
        columns = [pa.array([w.decode() for w in found], pa.string()), pa.array(c, pa.int64()), pa.array([a + held[w] for a, w in zip(c, found, strict=True)], pa.int64())]
        trained.clear()
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["word", "c", "n"])

    for batch in batches:
        for text, out in zip(batch.column("text").cast(pa.binary()), batch.column("held_out").to_pylist(), strict=True):
            own = held if out else trained
            own.update(text.as_py().lower().split())
            own[END.encode()] += 1
            if len(trained) + len(held) >= MOST_WORDS:
                yield given()
    yield given()


def number_words(counts: DataFrame, tokens: int) -> Ids:
    """Numbers for the words of counts (word, n), no two of which get the same."""
    common = counts.filter(F.col("n") >= COMMON * tokens).select("word", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])
    ids = Ids({w.encode(): i for i, w in enumerate(common["word"])})
    rest = counts.filter(F.col("n") < COMMON * tokens)
    salt = 0
    while not rest.groupBy(F.substring(F.md5(F.concat(F.lit(str(salt)), "word").cast("binary")), 1, ids.digits)).count().filter("count > 1").isEmpty():
        salt += 1
        ids.digits = min(MOST, ids.digits + 1)
        ids.salt = str(salt).encode()
    return ids


def pack(columns: list[np.ndarray]) -> bytes:
    """Integer columns of one length, byte by byte of their values, compressed."""
    table = np.stack(columns).astype(np.int64)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(table.view(np.uint8).reshape(*table.shape, 8).transpose(0, 2, 1)).tobytes())


def unpack(blob: bytes, columns: int) -> np.ndarray:
    table = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    return np.ascontiguousarray(table.transpose(0, 2, 1)).view(np.int64)[:, :, 0]


@dataclass
class Grams:
    """The distinct n-grams of one order in a chunk: a column of numbers for each word, in ascending order, and which of them ends at each of some tokens."""

    columns: list[np.ndarray]
    at: np.ndarray
    which: np.ndarray

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams' buckets, and the order that puts n-grams of one bucket together."""
        bucket = bucket_of(self.columns, buckets)
        return bucket, np.argsort(bucket, kind="stable")


def mixed(columns: list[np.ndarray] | np.ndarray) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        h = (h ^ x.astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h


def bucket_of(columns: list[np.ndarray] | np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(columns) % np.uint64(buckets)).astype(np.int64)


def gathered(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal n-grams together, and which are the first of theirs in it."""
    h = mixed(columns)
    by = np.argsort(h)
    for exact in (False, True):
        if exact:
            by = np.lexsort(columns[::-1])
        first = np.zeros(len(by), bool)
        first[:1] = True
        for x in columns:
            x = x[by]
            first[1:] |= x[1:] != x[:-1]
        # Different n-grams of one hash may lie mixed; then their own order is taken.
        if not (first[1:] & (h[by[1:]] == h[by[:-1]])).any():
            break
    return by, first


def grams(numbers: np.ndarray, sizes: np.ndarray, order: int) -> list[Grams]:
    """The n-grams of order 1 up to order; none crosses from one text to the next."""
    low = (1 << 32) - 1
    found, word = np.unique(numbers, return_inverse=True)
    out = [Grams([found], np.arange(len(numbers)), word)]
    if order == 1:
        return out
    inside = np.ones(len(numbers), bool)
    inside[np.cumsum(sizes) - sizes] = False
    at = np.flatnonzero(inside)
    key, pair = np.unique(word[at - 1] << 32 | word[at], return_inverse=True)
    out.append(Grams([found[key >> 32], found[key & low]], at, pair))
    if order == 2:
        return out
    ending = np.zeros(len(numbers), np.int64)
    ending[at] = pair
    at = at[inside[at - 1]]
    triple, which = np.unique(ending[at - 1] << 32 | word[at], return_inverse=True)
    out.append(Grams([*(x[triple >> 32] for x in out[1].columns), found[triple & low]], at, which))
    return out


def split(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The slices of equal buckets, which come together."""
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(bucket[a]), slice(a, b)


def chunks_of(rows: DataFrame, ids: Ids) -> DataFrame:
    """rows (id, held_out, text, row) as a written table of chunks: the columns of their rows as arrays, and the numbers of their tokens."""
    shared = rows.sparkSession.sparkContext.broadcast((dict(ids), ids.salt, ids.digits))
    listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ids(shared.value[0])
        own.salt, own.digits = shared.value[1:]
        number, end = own.__getitem__, own[END.encode()]
        for batch in batches:
            numbers: list[int] = []
            sizes: list[int] = []
            begin = 0
            texts = batch.column("text").cast(pa.binary())
            for i in range(len(batch)):
                before = len(numbers)
                numbers.extend(map(number, texts[i].as_py().lower().split()))
                numbers.append(end)
                sizes.append(len(numbers) - before)
                if len(numbers) >= FLUSH or i + 1 == len(batch):
                    part = batch.slice(begin, i + 1 - begin)
                    columns = [part.column("row").slice(0, 1), listed(part.column("id")), listed(part.column("held_out")), listed(pa.array(sizes, pa.int64())), pa.array([pack([np.array(numbers, np.int64)])], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=CHUNK)
                    numbers, sizes, begin = [], [], i + 1

    types = (LongType(), ArrayType(rows.schema["id"].dataType), ArrayType(BooleanType()), ArrayType(LongType()), BinaryType())
    return written(rows.mapInArrow(chunk, StructType([StructField(n, t) for n, t in zip(CHUNK, types, strict=True)])), "chunks")


def sent(chunks: DataFrame, order: int, buckets: int) -> DataFrame:
    """The distinct n-grams of each chunk with their counts in training rows, by bucket."""

    def entries(chunk: int, held: np.ndarray, sizes: np.ndarray, tokens: bytes) -> pd.DataFrame:
        own = grams(unpack(tokens, 1)[0], sizes, order)[-1]
        trains = np.repeat(~held.astype(bool), sizes)[own.at]
        count = np.bincount(own.which[trains], minlength=len(own.columns[0]))
        bucket, by = own.dealt(buckets)
        columns = [x[by] for x in (*own.columns, count)]
        return pd.DataFrame([(chunk, b, pack([x[s] for x in columns])) for b, s in split(bucket[by])], columns=["chunk", "bucket", "blob"])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for row in zip(df["chunk"], df["held"], df["sizes"], df["tokens"], strict=True):
                yield entries(*row)

    return chunks.select("chunk", "held", "sizes", "tokens").mapInPandas(send, PACKED)


def added(order: int, buckets: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What a bucket says: to each chunk the count of its n-grams and the excess of those that continue each, in the chunk's order; and to the
    buckets of their histories (chunk -1) the excess of its own n-grams."""

    def add(df: pd.DataFrame) -> pd.DataFrame:
        size = np.array([zstandard.frame_content_size(x) // (8 * (order + 1)) for x in df["blob"]])
        table, at = np.empty((order + 1, int(size.sum())), np.int64), 0
        for x, m in zip(df["blob"], size.tolist(), strict=True):
            table[:, at : at + m] = unpack(x, order + 1)
            at += m
        value = table[-1]
        by, first = gathered(table[:-1])
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(first) - 1
        of_chunk = np.repeat(df["chunk"].to_numpy() >= 0, size)
        n = int(first.sum())
        sums = [np.bincount(which[own], weights=value[own], minlength=n).astype(np.int64) for own in (of_chunk, ~of_chunk)]
        bucket, rows, at = int(df["bucket"].iloc[0]), [], 0
        for chunk, m in zip(df["chunk"].tolist(), size.tolist(), strict=True):
            if chunk >= 0:
                rows.append((chunk, bucket, pack([x[which[at : at + m]] for x in sums])))
            at += m
        more = sums[0] > 1
        if order > 1 and more.any():
            history, excess = table[:-2, by[first][more]], sums[0][more] - 1
            sort = np.lexsort(history[::-1])
            history, excess = history[:, sort], excess[sort]
            head = np.flatnonzero(np.concatenate(([True], (history[:, 1:] != history[:, :-1]).any(axis=0))))
            told = [*history[:, head], np.add.reduceat(excess, head)]
            to = bucket_of(told[:-1], buckets)
            by = np.argsort(to, kind="stable")
            told = [x[by] for x in told]
            rows += [(-1, b, pack([x[s] for x in told])) for b, s in split(to[by])]
        return pd.DataFrame(rows, columns=["chunk", "bucket", "blob"])

    return add


def traversed(scale: float, buckets: dict[int, int]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The scores of a chunk's texts from its answers."""

    def traverse(df: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        sizes = np.asarray(df["sizes"].iloc[0])
        one, two, three = grams(unpack(df["tokens"].iloc[0], 1)[0], sizes, 3)
        known = []
        for order, own in enumerate((one, two, three), 1):
            rows = answers[answers["order"] == order].sort_values("bucket")
            by = own.dealt(buckets[order])[1]
            got = np.empty((2, len(by)), np.int64)
            got[:, by] = np.concatenate([unpack(x, 2) for x in rows["blob"]], axis=1) if len(rows) else np.zeros((2, 0), np.int64)
            known.append(got)
        # Of each state its count and that of its arcs' excess; of each token the probability after no, one and two words.
        (c1, excess1), (c2, excess2), (c3, _) = known

        def arc(count: np.ndarray, seen: np.ndarray, excess: np.ndarray, shorter: np.ndarray) -> np.ndarray:
            n = np.maximum(seen, 1)
            return np.where(seen > 0, np.maximum(count - DISCOUNT, 0) / n + np.maximum(1e-9, DISCOUNT * (seen - excess) / n) * shorter, shorter)

        p = ((c1 + ADD) / scale)[one.which]
        base = np.log10(p)
        before = one.which[two.at - 1]
        p[two.at] = arc(c2[two.which], c1[before], excess1[before], p[two.at])
        pair = np.zeros(len(p), np.int64)
        pair[two.at] = two.which
        before = pair[three.at - 1]
        p[three.at] = arc(c3[three.which], c2[before], excess2[before], p[three.at])
        start = np.cumsum(sizes) - sizes
        n_known, base, score = (np.add.reduceat(x, start) for x in ((c1[one.which] > 0).astype(np.int64), base, np.log10(p)))
        return pd.DataFrame({"chunk": df["chunk"], "known": [n_known], "base": [base], "score": [score]})

    return traverse


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score and score; rows of fold 0 are held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), (F.pmod(id_hash(id_col), F.lit(FOLDS)) == 0).alias("held_out"), whole(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    counts = rows.select("held_out", "text").mapInArrow(counted, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    counts = written(counts, "unigrams")
    tokens, total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = {order: max(least, math.ceil(tokens / PER_BUCKET / part)) for order, part in ((3, 1), (2, 1), (1, 4))}

    chunks = chunks_of(rows, number_words(counts, tokens))
    answers, told = [], None
    for order in (3, 2, 1):
        entries = sent(chunks, order, buckets[order])
        entries = entries if told is None else entries.union(told)
        said = written(entries.groupBy("bucket").applyInPandas(added(order, buckets.get(order - 1, 0)), PACKED), f"order{order}")
        answers.append(said.filter("chunk >= 0").withColumn("order", F.lit(order)))
        told = said.filter("chunk < 0")
    answered = answers[0].union(answers[1]).union(answers[2]).groupBy("chunk")
    scale = total + ADD * (distinct + 1)
    scored = chunks.select("chunk", "sizes", "tokens").groupBy("chunk").cogroup(answered).applyInPandas(traversed(scale, buckets), "chunk long, known array<long>, base array<double>, score array<double>")
    each = chunks.select("chunk", "ids", "held", "sizes").join(scored, "chunk").select(F.explode(F.arrays_zip("ids", "held", "sizes", "known", "base", "score")).alias("d"))
    return each.select(
        F.col("d.ids").alias(id_col), F.col("d.held").alias("held_out"), F.col("d.sizes").alias("n_tokens"), F.col("d.known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), F.col("d.base").alias("base_score"), F.col("d.score").alias("score"),
    )
