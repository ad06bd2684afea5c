"""Prefix trie of conversations by smallest-member ownership. DataFrame functions only, but for the hashes of member lists.

A node is a distinct sequence of first turns, and a conversation is a path of nodes. Of the conversations that share a node the
smallest owns it. Whoever owns a node owns all that follow it on its own path, so each conversation owns a suffix of its
path (an empty one, if a smaller conversation has it all), and it is enough to know where that suffix begins. Sums over a node's subtree
then need no walk over the trie: each member brings the turns it has below the node, and nodes are counted once, by their owners.

1. Turns are numbered within their conversations and rebuilt (the first turns of a shared stem, then the conversation's own).
2. A prefix gets a name: the sums over its turns of four 32-bit parts of SHA-256 of place, role and text (128 bits in all, and the depth).
   Windows over a conversation add them up. They run over stretches of STRETCH turns, and over the stretches' sums,
   so a conversation of any length is split.
3. One group-by of names gives each node's owner, and one of owners where the owned suffix begins.
4. Windows' sums before and after that mark divide each path into what it owns and what not; one group-by of names adds up occurrences
   less owned ones, children and leaf flags. Both group-bys add up within tasks first, so no prefix is too common.
5. Members that end at a node are listed in the order of their ids: ranges are joined into blocks, of up to BLOCK ids, and one stream over a
   node's blocks hashes them. No list stands in memory.

Defined cases: turns without a conversation id belong to no conversation. Null role and text are empty; a null turn comes first. Turns that repeat a
number are ordered by the digest of role and text. Stems of negative ids are multiples of five below them. A conversation may be rebuilt without turns; it is a member of
the root alone. An empty table has no conversations and no nodes. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachlake.llm.common import whole, written
from reachlake.operators.merge import dense_ids

#: Conversations of a stem are rebuilt from the first of STEM, whose turns before the crc32 of the id modulo TURNS they share.
STEM, TURNS = 5, 9
STRETCH, BLOCK = 1 << 10, 1 << 14
PARTS = ("s1", "s2", "s3", "s4")
NAME = ["depth", *PARTS]


def numbered(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, place (from 1), digest (of role and text) and bytes of each turn."""
    role, text = whole(F.col(role_col).cast("string")), whole(text_col)
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).isNotNull().alias("has"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"),
    )
    turns = dense_ids(written(turns, "turns"), ["conv_id", "has", "turn", "digest", "row"], "number")
    turns = written(turns.select("conv_id", "number", "digest", "bytes"), "numbered")
    first = turns.groupBy("conv_id").agg(F.min("number").alias("first"))
    return turns.join(first, "conv_id").select("conv_id", (F.col("number") - F.col("first") + 1).alias("place"), "digest", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest and bytes of the turns of rebuilt conversations, and a row of depth 0 for each."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TURNS
    stem = F.col("conv_id") - F.pmod("conv_id", F.lit(STEM))
    lengths = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    heads = lengths.select("conv_id", shared.alias("shared"), stem.alias("stem"))
    begin = turns.filter(F.col("place") < TURNS).select(F.col("conv_id").alias("stem"), F.col("place").alias("depth"), "digest", "bytes")
    begun = heads.join(begin, "stem").filter(F.col("depth") <= F.col("shared")).select("conv_id", "depth", "digest", "bytes")
    given = heads.join(lengths.select(F.col("conv_id").alias("stem"), "n"), "stem", "left").select("conv_id", "shared", F.least("shared", F.coalesce("n", F.lit(0))).alias("given"))
    own = turns.join(given, "conv_id").filter(F.col("place") > F.col("shared")).select("conv_id", (F.col("place") - F.col("shared") + F.col("given")).alias("depth"), "digest", "bytes")
    root = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return begun.unionByName(own).unionByName(root)


def named(turns: DataFrame) -> DataFrame:
    """turns with the name of the prefix that each ends, the parent's parts, and upto, the bytes of the conversation up to it."""
    mixed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")), 256)
    values = {p: F.when(F.col("depth") > 0, F.conv(F.substring(mixed, 8 * i + 1, 8), 16, 10).cast("long")).otherwise(0) for i, p in enumerate(PARTS)}
    values["upto"] = F.col("bytes")
    rows = turns.withColumns(values).withColumn("stretch", F.expr(f"depth div {STRETCH}"))
    within = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("conv_id", "depth", "bytes", "stretch", *[F.col(c).alias(f"own_{c}") for c in values], *[F.sum(c).over(within).alias(c) for c in values])
    # Most conversations have one stretch; what came before matters to the others only.
    sums = rows.groupBy("conv_id", "stretch").agg(*[F.sum(f"own_{c}").alias(c) for c in values])
    sums = sums.select("conv_id", "stretch", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in values]).filter("stretch > 0")
    late = rows.filter("stretch > 0").join(sums, ["conv_id", "stretch"]).withColumns({c: F.col(c) + F.col(f"before_{c}") for c in values})
    every = rows.filter("stretch = 0").unionByName(late.select(*rows.columns))
    return every.select("conv_id", "depth", "bytes", *values, *[(F.col(p) - F.col(f"own_{p}")).alias(f"up_{p}") for p in PARTS])


def listed(ends: DataFrame) -> DataFrame:
    """For each name, the SHA-256 of the decimal conv_ids in ascending order, joined by commas."""
    name = NAME

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            runs = (df[name].ne(df[name].shift()).any(axis=1)).cumsum()
            rows = []
            for _, run in df.groupby(runs, sort=False):
                key = run[name].iloc[0].tolist()
                for at in range(0, len(run), BLOCK):
                    ids = run["conv_id"].iloc[at : at + BLOCK]
                    rows.append((*key, int(ids.iloc[0]), zlib.compress(",".join(map(str, ids)).encode(), 1)))
            yield pd.DataFrame(rows, columns=[*name, "first", "block"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, hashlib.sha256()
        for df in batches:
            rows = []
            for *own, _, block in df.itertuples(index=False, name=None):
                if own == key:
                    state.update(b",")
                else:
                    if key is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(zlib.decompress(block))
            yield pd.DataFrame(rows, columns=[*name, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*name, "ends_sha256"])

    keys = ", ".join(f"{c} long" for c in name)
    ranges = ends.select(*name, "conv_id").repartitionByRange(*name, "conv_id").sortWithinPartitions(*name, "conv_id")
    joined = ranges.mapInPandas(blocks, f"{keys}, first long, block binary")
    return joined.repartition(*name).sortWithinPartitions(*name, "first").mapInPandas(hashed, f"{keys}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild: bool = True) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256; rebuild gives conversations of a stem its first turns."""
    turns = numbered(conversations, id_col, turn_col, role_col, text_col)
    if rebuild:
        turns = rebuilt(turns)
    else:
        root = turns.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("bytes"))
        turns = turns.withColumnRenamed("place", "depth").unionByName(root)
    paths = written(named(turns), "paths")
    lengths = paths.groupBy("conv_id").agg(F.max("depth").alias("length"), F.max("upto").alias("whole"))
    paths = written(paths.join(lengths, "conv_id"), "paths")
    nodes = paths.groupBy(*NAME).agg(F.min(F.struct("conv_id", "upto", "bytes", *[f"up_{p}" for p in PARTS])).alias("of"), F.max("length").alias("longest"))
    nodes = nodes.select(*NAME, F.col("of.conv_id").alias("owner"), (F.col("of.upto") - F.col("of.bytes")).alias("above"), *[F.col(f"of.up_{p}").alias(f"up_{p}") for p in PARTS], (F.col("longest") == F.col("depth")).alias("leaf"))
    nodes = written(nodes, "nodes")
    # Where each conversation's own suffix begins, the bytes before it, and whether its last node is a leaf of its own.
    owners = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min(F.struct("depth", "above")).alias("mark"), F.max("leaf").alias("leaf"))
    marked = paths.join(owners, "conv_id", "left").select("*", F.coalesce("mark.depth", F.col("length") + 1).alias("begins"), F.coalesce("mark.above", "whole").alias("shared"), F.coalesce("leaf", F.lit(False)).alias("owns_leaf"))
    ends = F.col("length") == F.col("depth")
    sums = marked.groupBy(*NAME).agg(
        F.count("*").alias("n_convs"), F.count_if((F.col("begins") <= F.col("depth") + 1) & ~ends).alias("n_children"), F.count_if("owns_leaf").alias("n_leaves"),
        F.sum(F.greatest(F.lit(0), F.col("shared") - (F.col("upto") - F.col("bytes")))).alias("saved_tokens"),
    )
    hashes = listed(paths.filter(ends))
    # A node's parent has the same owner, but where the owner's suffix begins.
    begins = owners.select(F.col("conv_id").alias("owner"), F.col("mark.depth").alias("begins"))
    related = nodes.join(begins, "owner")
    inner = related.filter(F.col("depth") > F.col("begins")).select(*NAME, "owner", F.col("owner").alias("parent"))
    top = related.filter(F.col("depth") == F.col("begins")).withColumn("parent_depth", F.col("depth") - 1)
    parents = nodes.select(F.col("depth").alias("parent_depth"), *[F.col(p).alias(f"up_{p}") for p in PARTS], F.col("owner").alias("parent"))
    top = top.join(parents, ["parent_depth", *[f"up_{p}" for p in PARTS]], "left").select(*NAME, "owner", "parent")
    found = inner.unionByName(top).join(sums, NAME).join(hashes, NAME, "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
