"""Exact dedup by distributed MSD radix partitioning.

Texts are equal when they are identical after each run of white space became one space. All
documents start in one group. A round splits every group by the next bytes of the normalised
text: the digit, 64 bytes in the first round and 16 times as many in each later one. A group of one
document is finished; so is a group whose digit is shorter than the round's width, because its
texts have ended, and being equal in every digit they are equal as a whole. No digest decides
equality. Only what is still undecided goes to the next round, so near copies leave it at their
first difference and there are as many rounds as the longest copied text has digits (seven for 2 GB).

Each round counts its groups with map-side partial aggregation (a group of a third of all rows
sends one row per task) and gives the counts back to the rows. Large groups, of which there are few, are broadcast: a
group is large from the share of the rows at which HOT_BYTES hold the digits of all that can be so large. Their rows
leave the other join's key for one of their own, so no task gets a hot group.

Defined cases: a null text is an empty one; all empty texts are one group, and so are texts of
white space only. Of rows that repeat an id within a group one stays. A null id is larger than any
other. An empty table gives an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlake.llm.common import SPACE, whole, written

FIRST_WIDTH, GROWTH = 64, 16
#: Bytes of digits that a round broadcasts at most, and groups.
HOT_BYTES, MOST_HOT = 1 << 24, 1 << 10


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def digit(text: Column, offset: int, width: int) -> Column:
    """Bytes [offset, offset + width) of the normalised text, which is normalised only as far as they need."""
    end = offset + width
    chars = min(4 * end, 2**31 - 1)
    head = normalised(F.substring(text, 1, chars)).cast("binary")
    enough = (F.octet_length(head) >= end) | (F.char_length(text) <= chars)
    return F.substring(F.when(enough, head).otherwise(normalised(text).cast("binary")), offset + 1, width)


def split_groups(active: DataFrame, offset: int, width: int) -> DataFrame:
    """One radix round: each row with its digit, and with its group's count, smallest id and new group id if it isn't alone."""
    keyed = active.withColumn("digit", digit(whole("doc.text"), offset, width))
    groups = keyed.groupBy("gid", "digit").agg(F.count("*").alias("n"), F.min("id").alias("keep_id"), F.min("row").alias("next_gid")).filter("n > 1")
    groups = groups.select("gid", "digit", F.struct("n", "keep_id", "next_gid").alias("group"))
    # At most one in `share` of the rows each: there are no more than share of them.
    share = min(MOST_HOT, HOT_BYTES // width)
    large = F.col("group.n") * share >= active.count()
    hot, rest = groups.filter(large).withColumnRenamed("group", "hot"), groups.filter(~large).select(F.col("gid").alias("key"), "digit", "group")
    spread = keyed.join(F.broadcast(hot), ["gid", "digit"], "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("gid")).otherwise(-1 - F.col("row")))
    found = F.coalesce("hot", "group")
    return spread.join(rest, ["key", "digit"], "left").withColumns({x: found[x] for x in ("n", "keep_id", "next_gid")})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: bool = False, digest: bool = True) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept; text_sha256 with digest; doc, a struct of all columns, with payload."""
    spark = docs.sparkSession
    columns = [F.col(f"`{c}`") for c in docs.columns if payload and c != text_col]
    active = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.lit(0).cast("long").alias("gid"), F.struct(F.col(text_col).alias("text"), F.struct(F.lit(1), *columns).alias("rest")).alias("doc"))
    parts, offset, width = [], 0, FIRST_WIDTH
    while True:
        # Row numbers of the first round hold only once they are written, so texts that end there are settled in the second.
        ended = F.lit(False) if offset == 0 else F.octet_length("digit") < width
        done = F.col("n").isNull() | ended
        sha = F.sha2(normalised(whole("doc.text")).cast("binary"), 256) if digest else F.lit(None).cast("string")
        step = split_groups(active, offset, width).select(
            "id", "row", F.coalesce("next_gid", "row").alias("gid"), F.coalesce("n", F.lit(1)).alias("n"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
            done.alias("done"), F.when(done, sha).alias("sha"), (F.col("doc") if payload else F.when(~done, F.col("doc"))).alias("doc"),
        )
        step = written(step, "radix")
        parts.append(step.filter("done"))
        active = step.filter("not done").select("id", "row", "gid", "doc")
        if active.isEmpty():
            break
        offset, width = offset + width, width * GROWTH
    settled = reduce(DataFrame.unionAll, parts)
    alone, groups = settled.filter("n = 1"), settled.filter("n > 1")
    # Of rows that share the smallest id one stays; it is told by its own number, so that a hot group is no key.
    first = groups.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("gid").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    both = alone.withColumn("kept", F.lit(True)).unionByName(groups.join(first, "row", "left").withColumn("kept", F.coalesce("first", F.lit(False))).drop("first"))
    out = [F.col("id").alias(id_col), "keep_id", F.col("n").cast("long").alias("group_size"), "kept"]
    if digest:
        out.append(F.col("sha").alias("text_sha256"))
    if payload:
        out.append(F.struct(*[(F.col("doc.text") if c == text_col else F.col(f"doc.rest.`{c}`")).alias(c) for c in docs.columns]).alias("doc"))
    return both.select(*out)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops."""
    return exact_dedup(docs, id_col, text_col, payload=True, digest=False).filter("kept").select("doc.*")
