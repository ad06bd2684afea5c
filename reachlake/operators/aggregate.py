"""Line counts by interval union, and ownership summaries of unreachable components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachlake.storage import merged

MEASURED = "file is not null and file <> '' and begin_line > 0 and end_line >= begin_line"


def line_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, lines, members, unmeasured for rows with file, begin_line, end_line: lines of overlapping or touching ranges of a file count once.

    Equal ranges fold before the window, and a group's ranges are ordered within one file, so a partition is a file of a group.
    """
    folded = rows.filter(MEASURED).groupBy(*by, "file", "begin_line").agg(F.max("end_line").alias("end_line"))
    order = Window.partitionBy(*by, "file").orderBy("begin_line")
    before = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = folded.withColumn("opens", F.coalesce((F.col("begin_line") > before + 1).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("opens").over(order)).groupBy(*by, "file", "island").agg((F.max("end_line") - F.min("begin_line") + 1).alias("n"))
    lines = islands.groupBy(*by).agg(F.sum("n").alias("lines"))
    members = rows.groupBy(*by).agg(F.count("*").alias("members"), F.count_if(~F.coalesce(F.expr(MEASURED), F.lit(False))).alias("unmeasured"))
    return members.join(merged(lines), by, "left").select(*by, F.coalesce("lines", F.lit(0)).cast("long").alias("lines"), "members", "unmeasured")


def directory(file: Column) -> Column:
    """The parent of a path; empty for a path without one."""
    return F.when(F.instr(file, "/") > 0, F.regexp_replace(file, "/[^/]*$", "")).otherwise("")


def ownership(members: DataFrame) -> DataFrame:
    """(component, level, label, lines, members, unmeasured): by class, file and directory in one pass; empty labels are left out."""
    levels = F.array(
        F.struct(F.lit("type").alias("level"), F.col("class_name").alias("label")), F.struct(F.lit("file").alias("level"), F.col("file").alias("label")), F.struct(F.lit("directory").alias("level"), directory(F.col("file")).alias("label"))
    )
    rows = members.select("component", "file", "begin_line", "end_line", F.inline(levels)).filter("label is not null and label <> ''")
    return line_counts(rows, ["component", "level", "label"])


def component_members(found: DataFrame) -> DataFrame:
    """One row per weak component: members in key order with their disposition, and the two counts."""
    hidden = F.size("suppressions") > 0
    item = F.struct(F.col("key"), F.when(hidden, "suppressed").otherwise("actionable").alias("disposition"))
    return found.groupBy("component").agg(F.sort_array(F.collect_list(item)).alias("members"), F.count_if(~hidden).alias("actionable"), F.count_if(hidden).alias("suppressed"))
