"""Target-distribution importance resampling over hashed word features, by a vectorised byte automaton.

Texts are read as the bytes of Arrow's UTF-8 buffers. A table of 256 entries classifies each byte (it also lowers A-Z), words
begin and end where the classes of neighbours differ or a text does, and the table-driven CRC-32 is advanced by one byte at a time for all
words at once: words stand in the order of their lengths, so those that still have bytes are a prefix. The state of a
word, one space further, is where the word that follows it starts for the run of both. When few words are left, which
are the longest, zlib ends them one by one. Long texts are taken in windows that end between words; the last word's
state goes into the next window, so memory is bounded by a window (or by one longer word) and nothing is left out.

1. Each task adds up how often its texts have each bucket, and sends one row per bucket; documents give s, the target t.
2. A bucket's gain is the floored logarithm of how much more frequent it is in the target. The gains, BUCKETS numbers at any size
   of the corpus, go along with the second pass, which adds them up for each document.
3. A document's score is the floored mean of its gains plus Gumbel noise from its id, and the highest are drawn, which
   samples by importance without replacement. Ranks are given by sorted ranges, not in one task.

Defined cases: a null text has no words. Null ids have the noise of an empty one and are larger than any other; rows that repeat an id are
documents of their own, with ranks of their own. Without target texts every gain follows from the documents alone. An empty
table gives an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from reachlake.llm.common import whole, written
from reachlake.operators.merge import dense_ids

BUCKETS = 10_000
SCALE = 1000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of texts that are taken at a time, and words that are still advanced together.
WINDOW, TOGETHER = 1 << 21, 32
SPACE, FLIP = 0x20, np.uint32(0xFFFFFFFF)


def crc_table() -> np.ndarray:
    """The remainders of CRC-32, reflected."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def classes() -> np.ndarray:
    """Each byte as the words have it, and 0 where no word has it."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    outside = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
    table[outside] = 0
    return table


CRC, CLASS = crc_table(), classes()


def advanced(states: np.ndarray, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC states after the words at these places, each advanced from its own state."""
    # Narrow numbers are sorted by radix.
    narrow = np.uint16 if sizes.max(initial=0) < 1 << 16 else np.int64
    ascending = np.argsort(sizes.astype(narrow), kind="stable")
    by, shortest = ascending[::-1], sizes[ascending]
    state, at, size, k = states[by], starts[by], sizes[by], 0
    while (m := len(by) - int(np.searchsorted(shortest, k, "right"))) >= TOGETHER:
        head = state[:m]
        state[:m] = CRC[(head ^ chars[at[:m] + k]) & np.uint32(0xFF)] ^ (head >> np.uint32(8))
        k += 1
    for i in range(m):
        state[i] = zlib.crc32(chars[at[i] + k : at[i] + size[i]], int(state[i] ^ FLIP)) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[by] = state
    return out


def windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Slices of the bytes with the texts they hold, begin to end of either: whole texts, or a part of one that ends between words."""
    text, n = 0, len(offsets) - 1
    while text < n:
        upto = max(text, int(np.searchsorted(offsets, offsets[text] + WINDOW, "right")) - 1)
        if upto > text:
            yield int(offsets[text]), int(offsets[upto]), text, upto
            text = upto
            continue
        begin, end = int(offsets[text]), int(offsets[text + 1])
        while begin < end:
            cut = min(end, begin + WINDOW)
            while cut < end and CLASS[data[cut]]:
                step = data[cut : min(end, cut + WINDOW)]
                outside = np.flatnonzero(CLASS[step] == 0)
                cut += int(outside[0]) if len(outside) else len(step)
            yield begin, cut, text, text + 1
            begin = cut
        text += 1


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Window by window: the text of each word, the bucket of each word, the text of each pair of words, and its bucket."""
    carried_text, carried = -1, np.uint32(0)
    for begin, end, first, last in windows(data, offsets):
        chars = CLASS[data[begin:end]]
        inside = np.concatenate(([0], (chars > 0).astype(np.int8), [0]))
        edge = np.diff(inside)
        # A text that ends within a word that another goes on with ends it, and the other starts one.
        joints = offsets[first + 1 : last] - begin
        joints = joints[(joints > 0) & (joints < len(chars))]
        joints = np.unique(joints[(inside[joints] > 0) & (inside[joints + 1] > 0)])
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(joints):
            starts, ends = np.sort(np.concatenate((starts, joints))), np.sort(np.concatenate((ends, joints)))
        text = np.searchsorted(offsets[first : last + 1], starts + begin, "right") - 1 + first
        sizes = ends - starts
        single = advanced(np.full(len(starts), FLIP), chars, starts, sizes)
        before = np.concatenate(([carried], single[:-1])) if len(single) else single
        owner = np.concatenate(([carried_text], text[:-1])) if len(text) else text
        follows = owner == text
        spaced = before[follows]
        spaced = CRC[(spaced ^ np.uint32(SPACE)) & np.uint32(0xFF)] ^ (spaced >> np.uint32(8))
        pair = advanced(spaced, chars, starts[follows], sizes[follows])
        if len(single):
            carried_text, carried = int(text[-1]), single[-1]
        yield text, (single ^ FLIP) % np.uint32(BUCKETS), text[follows], (pair ^ FLIP) % np.uint32(BUCKETS)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts without nulls, and where each begins and ends in them."""
    texts = texts.cast(pa.large_string())
    _, places, content = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8), offsets


def bucket_counts(texts: DataFrame, text_col: str) -> np.ndarray:
    """How often the texts have each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, single, _, pair in features(*buffer_of(batch.column("text"))):
                total += np.bincount(single, minlength=BUCKETS) + np.bincount(pair, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    counts = texts.select(whole(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counts.collect():  # at most BUCKETS rows
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = source.astype(float), target.astype(float)
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """id, row, n_words, n_features and weight of each row of docs."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            n_words, n_pairs, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for text, single, of_pair, pair in features(*buffer_of(batch.column("text"))):
                n_words += np.bincount(text, minlength=n)
                n_pairs += np.bincount(of_pair, minlength=n)
                # A text's gains in a window are far below 2^53, so doubles add them exactly.
                total += (np.bincount(text, weights=gains[single], minlength=n) + np.bincount(of_pair, weights=gains[pair], minlength=n)).astype(np.int64)
            every = n_words + n_pairs
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), *map(pa.array, (n_words, every, total // np.maximum(every, 1)))], names=own.names)

    own = StructType([StructField("id", docs.schema[id_col].dataType), *(StructField(c, LongType()) for c in ("row", "n_words", "n_features", "weight"))])
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), whole(text_col).alias("text"))
    return rows.mapInArrow(weigh, own)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_features, weight, score and rank, which is null unless the row is drawn."""
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    rows = weighed(docs, gains, id_col, text_col).withColumn("score", F.col("weight") + noise)
    ordered = rows.withColumns({"short": F.col("n_words") < least_words, "below": -F.col("score"), "unnamed": F.col("id").isNull()})
    ordered = written(ordered, "weighed")
    drawn = percent * ordered.filter("not short").count() // 100
    ranked = dense_ids(ordered, ["short", "below", "unnamed", "id", "row"], "place")
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
