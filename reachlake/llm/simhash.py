"""SimHash near-dedup: fingerprints, sharded BK-trees, components of the links.

Fingerprint: XXH64 of every 3-word shingle (repeats included); a bit is set if it is set in over half
of them. Two fingerprints link at RADIUS or fewer differing bits.

Search: fingerprints first become distinct, so copies cost nothing. The 64 bits are cut in five blocks;
three differing bits leave at least two blocks untouched, so every linked pair agrees in one of the ten
pairs of blocks. Each (pair of blocks, their bits) is a shard, and within a shard a BK-tree holds the
fingerprints: children are keyed by their Hamming distance to the parent, and a query follows only edges
within RADIUS of its own distance. A shard of more than SHARD_ROWS fingerprints is dealt into chunks, and each
two of its chunks meet in one tree, so no task holds more than 2 * SHARD_ROWS of a shard and no pair is missed.
The trees grow with the data, so shards are dealt to tasks by a shuffle and not broadcast. A tree
gives a spanning forest of its links and not all pairs; that keeps every component whole.

Components: alternating large-star and small-star rounds over the forest's edges, each round written to the
shared folder.

Defined cases: a null text is an empty one; a text without words has fingerprint zero and links like any
other; with one or two words the whole sequence is the one shingle. Rows that repeat an id or a text stay rows of
the result. A null id never names a component unless all its ids are null. An empty table gives an empty
result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from reachlake.llm.common import whole, written

RADIUS, SHINGLE, SEED = 3, 3, 42
BLOCKS = (13, 13, 13, 13, 12)
SHARD_ROWS = 4096
#: Shingles hashed at a time, a multiple of 255 (byte sums can't overflow).
STEP = 255 * 64


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    padded = np.zeros(-(-len(hashes) // 255) * 255, dtype="<u8")
    padded[: len(hashes)] = hashes
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def fingerprint(text: str) -> int:
    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - SHINGLE + 1)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n], ends[min(SHINGLE, len(parts)) - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, STEP):
        pairs = zip(starts[i : i + STEP].tolist(), ends[i : i + STEP].tolist(), strict=True)
        counts += bit_counts(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, min(STEP, n - i)))
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((fingerprint(x) for x in texts), np.uint64, len(texts)).view(np.int64))


class BKTree:
    """Fingerprints by Hamming distance to their parents; nodes are numbered in order of insertion."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, n = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while n:
            below = self.children[at]
            if (at := below.setdefault((self.values[at] ^ value).bit_count(), n)) == n:
                return

    def within(self, value: int, radius: int = RADIUS) -> list[int]:
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if len(below) > 2 * radius + 1:
                stack += [below[k] for k in range(d - radius, d + radius + 1) if k in below]
            else:
                stack += [node for k, node in below.items() if d - radius <= k <= d + radius]
        return found


def forest(values: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links between these fingerprints."""
    tree, parent, edges = BKTree(), [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, value in enumerate(values):
        parent.append(i)
        for j in tree.within(value):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((value, values[j]))
        tree.add(value)
    return edges


def shard_forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come ordered by shard; the last shard of a batch may go on in the next."""
    held: pd.DataFrame | None = None

    def edges(df: pd.DataFrame) -> pd.DataFrame:
        shard, fp = df[["key", "meet"]].to_numpy(), df["fp"].to_numpy()
        same = (shard[1:] == shard[:-1]).all(axis=1)
        starts = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))) == 1)
        ends = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))) == -1) + 1
        out = [e for a, b in zip(starts, ends, strict=True) for e in forest([x & (2**64 - 1) for x in fp[a:b].tolist()])]
        return pd.DataFrame(np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    for df in batches:
        if not len(df):
            continue
        df = df if held is None else pd.concat([held, df], ignore_index=True)
        last = (df["key"] == df["key"].iloc[-1]) & (df["meet"] == df["meet"].iloc[-1])
        held = df[last]
        yield edges(df[~last])
    if held is not None:
        yield edges(held)


def shards(fps: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, meet, fp): fingerprints that share key and meet are compared."""
    at = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    block = [F.shiftrightunsigned("fp", at[i]).bitwiseAND(F.lit((1 << n) - 1).cast("long")) for i, n in enumerate(BLOCKS)]
    keys = [F.lit(k << 26).cast("long") + F.shiftleft(block[i], 13) + block[j] for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = dealt.groupBy("key").agg(F.ceil(F.count("*") / shard_rows).alias("chunks")).filter("chunks > 1")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda x: F.least(chunk, x) * F.col("chunks") + F.greatest(chunk, x))
    return dealt.join(large, "key", "left").select("key", "fp", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(meets)).alias("meet"))


def links(fps: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Distinct edges (a, b) that connect what links; fps has the distinct fingerprints in fp."""
    dealt = shards(fps, shard_rows).repartition("key", "meet").sortWithinPartitions("key", "meet", "fp")
    return dealt.mapInPandas(shard_forests, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the component's smallest node."""
    edges, before = written(edges.filter("a <> b"), "links"), None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        edges = written(small.filter("a <> b").distinct(), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        before = now


def with_component(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """rows (written, with id and fp) and their component_id."""
    fps = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints")
    joined = fps.join(components(links(fps, shard_rows)).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(joined.join(names, "root").select("fp", "root", "component_id"), "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hexadecimal digits), component_id."""
    rows = written(docs.select(F.col(id_col).alias("id"), fingerprints(whole(text_col)).alias("fp")), "simhash")
    return with_component(rows, shard_rows).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one of the smallest id."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    table = written(docs.select(F.struct(*columns).alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), fingerprints(whole(text_col)).alias("fp")), "simhash")
    found = with_component(table.select("row", "id", "fp"))
    first = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row").alias("row"))
    return table.join(first.select("row"), "row", "left_semi").select("doc.*")
