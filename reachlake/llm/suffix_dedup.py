"""Removal of repeated passages: every byte that a LENGTH-byte string covers which also starts earlier.

The order is that of (doc_id, offset), and strings are judged on the input. The suffixes are never sorted as a whole; they
are put in buckets, and buckets are refined by bucket identifiers of later offsets until they hold LENGTH equal bytes:

1. Each LENGTH-byte window belongs to the bucket of one of its Q-grams: the leftmost of the smallest hash in it. Equal windows
   choose the same Q-gram at the same distance. Consecutive windows that share one are a run, a fortieth of the rows that
   positions would be. Runs are grouped by bucket and content (a 128-bit BLAKE2b digest of their bytes); of equal ones the
   first stays and the others' windows are all repeats (a run that a task has seen before doesn't even reach the shuffle).
2. Runs of buckets with different contents are open: their bytes are fetched and refined by bucket pointers. Each position starts
   in the bucket of its GRAM bytes. Sorting positions by their bucket and the bucket GRAM bytes later gives the buckets
   of 2 * GRAM bytes, sorting by these and those 2 * GRAM later the buckets of 4 * GRAM, and so on; each step uses the identifiers
   that the last one gave to all positions, and a position alone in its bucket is settled. The last step joins two overlapping
   identifiers to LENGTH bytes. Only bytes decide here. The first window of a final bucket stays, the others are repeats.
3. Each document's repeats are united, and what remains is digested.

No bucket needs to be in one task. In step 1 buckets that a sixty-fourth of the documents shows to be frequent are dealt by content
too (a statistic that only the plan depends on). In step 2 an open bucket of more than BUCKET runs is split in rounds over the
cluster: its windows by their distance to the Q-gram, in halves, and each half by the bytes that all its windows have beyond the
Q-gram. After at most seven rounds a half is one distance, its key whole windows, and plain grouping with partial aggregation
settles it. Texts cross a shuffle compressed. Every grouping of step 1 streams over sorted rows.

Defined cases: a null text is an empty one; a text shorter than LENGTH bytes loses nothing. A null id comes after
all others. Rows that share an id are ordered by a hash of their texts; rows that repeat both are one document and get the
same result. An empty table gives an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from reachlake.llm.common import whole, written

LENGTH, Q = 100, 20
#: Q-grams of a window, and bytes to one side of the Q-gram at most.
GRAMS, SIDE = LENGTH - Q + 1, LENGTH - Q
#: Window starts handled at a time.
STEP = 1 << 20
#: Bytes of the first buckets, and open runs refined together.
GRAM, BUCKET = 8, 8192
#: One in SHARE documents tells which buckets are frequent: FREQUENT runs there or more, of which at most MOST_FREQUENT are dealt into PARTS.
SHARE, FREQUENT, MOST_FREQUENT, PARTS = 64, 32, 10_000, 64
LAST = np.iinfo(np.int64).max


def odd_power_tables(seed: int) -> tuple[np.ndarray, int, int]:
    """A value for each byte, an odd base and its inverse modulo 2^64."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1, 1 << 62)) * 2 + 1
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), base, pow(base, -1, 1 << 64)


class RangeHash:
    """64-bit hashes of byte ranges from running sums: sum of value[byte] * inverse^position, shifted back by base^start."""

    def __init__(self, seed: int) -> None:
        self.value, self.base, self.inverse = odd_power_tables(seed)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data) + 1:
            n = 1 << (len(data) + 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))), dtype=np.uint64) for x in (self.base, self.inverse))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.value[data] * self.down[: len(data)], dtype=np.uint64)))

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[start]) * self.up[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def runs_of(data: np.ndarray, gram: RangeHash) -> tuple[np.ndarray, ...]:
    """bucket, two halves of the content's digest, first window, number of windows and distance to the Q-gram of each run."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums, at = gram.sums(data), np.arange(len(data) - Q + 1)
    low, where, width = gram.of(sums, at, at + Q), at.astype(np.int32), 1
    while 2 * width <= GRAMS:
        right = low[width:] < low[:-width]
        low, where = np.where(right, low[width:], low[:-width]), np.where(right, where[width:], where[:-width])
        width *= 2
    rest = GRAMS - width
    if rest:
        right = low[rest:] < low[:-rest]
        low, where = np.where(right, low[rest:], low[:-rest]), np.where(right, where[rest:], where[:-rest])
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    count = np.diff(np.concatenate((first, [n])))
    far = where[first] - first
    raw, digest = data.tobytes(), hashlib.blake2b
    ends = (first + count - 1 + LENGTH).tolist()
    digests = b"".join([digest(raw[i:j], digest_size=16).digest() for i, j in zip(first.tolist(), ends, strict=True)])
    body = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return (low[first] >> np.uint64(20)).astype(np.int64), body[:, 0], body[:, 1], first, count, far


def emit(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Repeats as bytes [start, end) of a document, united where they touch."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    if len(doc):
        same = (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (start[1:] <= end[:-1])
        # Pieces of one document have ends in the order of their starts, so neighbours decide.
        head = np.flatnonzero(np.concatenate(([True], ~same)))
        doc, tag, start, end = doc[head], tag[head], start[head], np.maximum.reduceat(end, head)
    return pd.DataFrame({"bucket": (doc * 31 + start) & ((1 << 44) - 1), "body": np.zeros(len(doc), np.int64), "rest": np.zeros(len(doc), np.int64), "part": np.zeros(len(doc), np.int8), "doc": doc, "tag": tag, "start": start, "pack": end, "again": np.ones(len(doc), bool)})


RUNS = "bucket long, body long, rest long, part byte, doc long, tag long, start long, pack long, again boolean"


def scan_runs(frequent: Callable[[], np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Runs, once per batch and content (again false, pack is windows * 128 + distance), and repeats (again true, pack is the end); part deals the runs of frequent buckets."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, often = RangeHash(11), frequent()
        for df in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(8)]
            for doc, tag, text in zip(df["doc"], df["tag"], df["text"], strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                for begin in range(0, max(1, len(data) - LENGTH + 1), STEP):
                    bucket, body, rest, first, count, far = runs_of(data[begin : begin + STEP + LENGTH - 1], gram)
                    for out, x in zip(parts, (bucket, body, rest, np.full(len(first), doc), np.full(len(first), tag), first + begin, count, far), strict=True):
                        out.append(x)
            bucket, body, rest, doc, tag, first, count, far = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts)
            order = np.lexsort((first, tag, doc, rest, body, bucket))
            bucket, body, rest, doc, tag, first, count, far = (x[order] for x in (bucket, body, rest, doc, tag, first, count, far))
            seen = np.zeros(len(bucket), bool)
            seen[1:] = (bucket[1:] == bucket[:-1]) & (body[1:] == body[:-1]) & (rest[1:] == rest[:-1])
            itself = np.zeros(len(bucket), bool)
            itself[1:] = seen[1:] & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (first[1:] == first[:-1])
            new, old = ~seen, seen & ~itself
            part = np.where(np.isin(bucket[new], often), 1 + body[new] % PARTS, 0).astype(np.int8)
            yield pd.DataFrame({"bucket": bucket[new], "body": body[new], "rest": rest[new], "part": part, "doc": doc[new], "tag": tag[new], "start": first[new], "pack": count[new] * 128 + far[new], "again": False})
            yield emit(doc[old], tag[old], first[old], first[old] + count[old] - 1 + LENGTH)

    return scan


def split_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come ordered by bucket, content and position: runs after the first of a content are repeats, and firsts of a bucket of several contents remain open.
    Of a frequent bucket a task sees a part only, so all its firsts do."""
    held: pd.DataFrame | None = None  # the last run seen, then the first run of its bucket if that isn't given out yet
    for df in batches:
        yield df[df["again"]]
        df = df[~df["again"]]
        if not len(df):
            continue
        known = 0 if held is None else 1
        rows = df if held is None else pd.concat([held.iloc[:1], df], ignore_index=True)
        bucket, body, rest, doc, tag, start = (rows[c].to_numpy() for c in ("bucket", "body", "rest", "doc", "tag", "start"))
        pack = rows["pack"].to_numpy()
        near, same = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        near[1:] = bucket[1:] == bucket[:-1]
        same[1:] = near[1:] & (body[1:] == body[:-1]) & (rest[1:] == rest[:-1])
        itself = np.zeros(len(rows), bool)
        itself[1:] = same[1:] & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (start[1:] == start[:-1])
        old = same & ~itself
        old[:known] = False
        yield emit(doc[old], tag[old], start[old], start[old] + pack[old] // 128 - 1 + LENGTH)
        # The first run of each bucket, given out when a second content comes.
        head = np.maximum.accumulate(np.where(near, 0, np.arange(len(rows))))
        second = near & ~same
        mixed = np.zeros(len(rows), bool)
        mixed[head[second]] = True
        opened = second | mixed | ((rows["part"].to_numpy() > 0) & ~same)
        if known:
            # The run that was held has been given out, or it is the first of its bucket and held still.
            opened[0] = False
            if mixed[0]:
                yield held.iloc[1:]
        yield rows[opened]
        last = len(rows) - 1
        if head[last] == 0 and known:
            first = held.iloc[1:] if not mixed[0] else held.iloc[:0]
        else:
            first = rows.iloc[[head[last]]] if not opened[head[last]] else rows.iloc[:0]
        held = pd.concat([rows.iloc[[last]], first], ignore_index=True)


def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the open runs of each document."""
    unpack = zstandard.ZstdDecompressor()
    for df in batches:
        rows = []
        for doc, tag, packed, wanted in zip(df["doc"], df["tag"], df["packed"], df["wanted"], strict=True):
            data = unpack.decompress(packed)
            for x in wanted:
                bucket, start, pack = x["bucket"], x["start"], x["pack"]
                rows.append((bucket, doc, tag, start, pack, x["large"], data[start : start + pack // 128 - 1 + LENGTH]))
        yield pd.DataFrame(rows, columns=["bucket", "doc", "tag", "start", "pack", "large", "bytes"])


def refine(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeats among the windows of open runs that lie lo to hi bytes before the Q-gram, by bucket pointers; rows come ordered by bucket and position, and hold whole buckets."""
    count, far, lo, hi = rows["pack"].to_numpy() // 128, rows["pack"].to_numpy() % 128, rows["lo"].to_numpy(), rows["hi"].to_numpy()
    size = count - 1 + LENGTH
    row_at = np.cumsum(size) - size
    data = np.frombuffer(b"".join(rows["bytes"]), np.uint8)

    def ranked(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket identifiers of the positions at, by their keys, and the positions that aren't alone in theirs."""
        order = np.argsort(keys)
        head = np.ones(len(order), bool)
        head[1:] = keys[order[1:]] != keys[order[:-1]]
        own = np.cumsum(head) - 1
        shared = np.bincount(own)[own] > 1
        ids = np.full(n, -1, np.int64)
        ids[at[order[shared]]] = own[shared]
        return ids, np.flatnonzero(ids >= 0)

    n, width = len(data), GRAM
    grams = np.zeros(max(0, n - GRAM + 1), np.uint64)
    for j in range(GRAM):
        grams |= data[j : j + len(grams)].astype(np.uint64) << np.uint64(8 * j)
    ids, live = ranked(grams, np.arange(len(grams)), n)

    def pointed(step: int) -> tuple[np.ndarray, np.ndarray]:
        """The positions that may share what two identifiers cover, and the pair of identifiers."""
        at = live[live + step < n]
        at = at[ids[at + step] >= 0]
        return at, ids[at] << 32 | ids[at + step]

    while 4 * width <= 2 * LENGTH and len(live):
        at, keys = pointed(width)
        ids, live = ranked(keys, at, n)
        width *= 2
    # Two overlapping identifiers cover a window. Only windows of a run count, in the given distances.
    at, keys = pointed(LENGTH - width)
    row = np.searchsorted(row_at, at, side="right") - 1
    d = far[row] - (at - row_at[row])
    windows = (at - row_at[row] < count[row]) & (d >= lo[row]) & (d <= hi[row])
    at, keys, row = at[windows], keys[windows], row[windows]
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(order), bool)
    again[1:] = keys[order[1:]] == keys[order[:-1]]
    again = np.sort(order[again])
    row, start = row[again], at[again] - row_at[row[again]] + rows["start"].to_numpy()[row[again]]
    return emit(rows["doc"].to_numpy()[row], rows["tag"].to_numpy()[row], start, start + LENGTH)[REFINED]


REFINED = ["doc", "tag", "start", "pack"]


def refine_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for df in batches:
        for begin in range(0, len(df), BUCKET):
            held.append(df.iloc[begin : begin + BUCKET])
            if sum(map(len, held)) < BUCKET:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = rows["bucket"] == rows["bucket"].iloc[-1]
            held = [rows[last]]
            if not last.all():
                yield refine(rows[~last])
    if held and sum(map(len, held)):
        yield refine(pd.concat(held, ignore_index=True))


def refined(opened: DataFrame) -> DataFrame:
    """Repeats of open runs of whole buckets, each of BUCKET runs at most."""
    return opened.repartition("bucket").sortWithinPartitions("bucket", "doc", "tag", "start").mapInPandas(refine_all, "doc long, tag long, start long, pack long")


def halves(large: DataFrame) -> DataFrame:
    """The rows once for each half of their distances that holds windows of theirs, in the bucket of the bytes that all windows of that half have."""
    far, count = F.col("pack") % 128, F.floor(F.col("pack") / 128).cast("long")
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("long")
    each = large.select("*", F.explode(F.array(F.struct(F.col("lo").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("hi").alias("b")))).alias("half"))
    each = each.filter((F.col("half.a") <= F.col("half.b")) & (F.col("half.a") <= far) & (F.col("half.b") > far - count))
    a, b = F.col("half.a"), F.col("half.b")
    common = F.substring("bytes", (far - a + 1).cast("int"), (a + LENGTH - b).cast("int"))
    return each.select(F.xxhash64("bucket", a, b, common).alias("bucket"), *OPEN[1:6], a.alias("lo"), b.alias("hi")).select(*OPEN)


OPEN = ["bucket", "doc", "tag", "start", "pack", "bytes", "lo", "hi"]


def repeats_of_windows(single: DataFrame) -> DataFrame:
    """Repeats among rows that stand for one window each (lo and hi are its distance): by whole windows, the first of each stays."""
    begin = (F.col("pack") % 128 - F.col("lo")).cast("int")
    windows = single.select("doc", "tag", (F.col("start") + begin).alias("start"), F.substring("bytes", begin + 1, F.lit(LENGTH)).alias("window"))
    at = F.struct("doc", "tag", "start")
    first = windows.groupBy("window").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return windows.join(first, "window").filter(at != F.col("first")).select("doc", "tag", "start", (F.col("start") + LENGTH).alias("pack"))


def split_large(large: DataFrame) -> list[DataFrame]:
    """Repeats of open runs of buckets with more than BUCKET runs, as written tables."""
    out = []
    while True:
        rows = written(halves(large), "halves")
        sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET), "sizes")
        single = F.col("lo") == F.col("hi")
        out.append(written(repeats_of_windows(rows.filter(single)), "refined"))
        rows = rows.filter(~single).join(sizes, "bucket", "left")
        out.append(written(refined(rows.filter("n is null").select(*OPEN)), "refined"))
        large = rows.filter("n is not null").select(*OPEN)
        if large.isEmpty():
            return out


@F.pandas_udf(BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=3)
    return pd.Series([pack.compress(x.encode()) for x in texts], dtype=object)


CUT = StructType([StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType()), StructField("kept", BinaryType())])


def cut_with(keep: bool):
    @F.pandas_udf(CUT)
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        unpack, rows = zstandard.ZstdDecompressor(), []
        for text, own in zip(texts, spans, strict=True):
            data = unpack.decompress(text)
            out, at, removed, n = [], 0, 0, 0
            for begin, end in sorted((x["start"], x["pack"]) for x in own) if own is not None else ():
                if begin > at or not n:
                    out.append(data[at:begin])
                    n += 1
                    removed += end - begin
                    at = end
                elif end > at:
                    removed += end - at
                    at = end
            out.append(data[at:])
            kept = b"".join(out)
            rows.append((len(data), removed, n, hashlib.sha256(kept).hexdigest(), kept if keep else None))
        return pd.DataFrame(rows, columns=CUT.names)

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_bytes the remaining bytes."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col), F.lit(int(LAST))).cast("long").alias("doc"), whole(text_col).alias("text")).withColumn("tag", F.xxhash64("text"))
    scanned = rows.select("doc", "tag", "text")
    some = scanned.filter(F.pmod(F.xxhash64("doc", "tag"), F.lit(SHARE)) == 0).mapInPandas(scan_runs(lambda: np.zeros(0, np.int64)), RUNS).filter("not again")
    often = some.groupBy("bucket").count().filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "bucket").limit(MOST_FREQUENT)
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.bucket for r in often.collect()], np.int64)))
    runs = scanned.mapInPandas(scan_runs(lambda: shared.value), RUNS)
    runs = runs.repartition("bucket", "part").sortWithinPartitions("bucket", "body", "rest", "doc", "tag", "start")
    found = written(runs.mapInPandas(split_runs, RUNS), "runs")
    texts = rows.select("id", "doc", "tag", packed("text").alias("packed"))
    open_runs = found.filter("not again")
    sizes = written(open_runs.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET), "sizes")
    some_large = not sizes.isEmpty()
    marked = open_runs.join(sizes, "bucket", "left").withColumn("large", F.col("n").isNotNull()) if some_large else open_runs.withColumn("large", F.lit(False))
    wanted = marked.groupBy("doc", "tag").agg(F.collect_list(F.struct("bucket", "start", "pack", "large")).alias("wanted"))
    opened = texts.join(wanted, ["doc", "tag"]).select("doc", "tag", "packed", "wanted").mapInPandas(fetch, "bucket long, doc long, tag long, start long, pack long, large boolean, bytes binary")
    opened = opened.withColumn("lo", F.lit(0).cast("long")).withColumn("hi", F.lit(SIDE).cast("long"))
    more = []
    if some_large:
        opened = written(opened, "opened")
        more = split_large(opened.filter("large").select(*OPEN))
        opened = opened.filter("not large")
    more.append(written(refined(opened.select(*OPEN)), "refined"))
    spans = reduce(DataFrame.union, more, found.filter("again").select(*REFINED)).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "pack")).alias("spans"))
    out = texts.join(spans, ["doc", "tag"], "left").select(F.col("id").alias(id_col), cut_with(keep_bytes)("packed", "spans").alias("d"))
    return out.select(id_col, "d.n_bytes", "d.n_removed", "d.n_spans", "d.kept_sha256", *(["d.kept"] if keep_bytes else []))
