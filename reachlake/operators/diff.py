"""Comparison of two runs by key, and the policy gate on it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachlake.operators.classify import findings
from reachlake.operators.reach import eligible, with_reach
from reachlake.schema import CHANGE_KINDS, CLASSIFICATIONS, Facts, primary_extent
from reachlake.storage import merged


@dataclass(frozen=True)
class Policy:
    """Which changes fail a run; the default gates new and newly unreachable symbols of every class in every target."""

    changes: Sequence[str] = ("new_symbol", "newly_unreachable")
    classifications: Sequence[str] = CLASSIFICATIONS
    targets: Sequence[str] = ()


@dataclass(frozen=True)
class RunContext:
    configuration_id: str = "default"
    frontend: str = "ast-json"
    target_id: str = ""


def require_compatible(baseline: RunContext, current: RunContext, policy: Policy) -> None:
    """Runs are comparable if configuration, front end and target agree; a policy for targets must name the current one."""
    for field in ("configuration_id", "frontend", "target_id"):
        if getattr(baseline, field) != getattr(current, field):
            raise ValueError(f"incompatible runs: {field} is {getattr(baseline, field)!r} in the baseline and {getattr(current, field)!r} now")
    if policy.targets and current.target_id not in policy.targets:
        raise ValueError(f"the policy doesn't apply to target {current.target_id!r}")


def states(facts: Facts) -> DataFrame:
    """(key, reachable, suppressed, classification, ...): the state of each eligible symbol of a run, computed and never taken from a report."""
    reached = with_reach(facts)
    found = findings(facts, reached).select("key", "classification", "evidence", "suppressions")
    return eligible(reached).join(merged(found), "key", "left").withColumn("suppressed", F.coalesce(F.size("suppressions") > 0, F.lit(False)))


def with_display(rows: DataFrame) -> DataFrame:
    """rows with symbol, what reports show of one."""
    place = primary_extent()["location"] if "source" in rows.columns else F.struct("file", F.col("begin_line").alias("line"))
    linkage = F.col("linkage_name") if "linkage_name" in rows.columns else F.col("identity.linkage_name")
    return rows.withColumn("symbol", F.struct("qualified_name", "signature", linkage.alias("linkage_name"), "kind", "scope", place["file"].alias("file"), place["line"].cast("long").alias("line")))


def changes(baseline: Facts, current: Facts, policy: Policy = Policy(), target: str = "") -> DataFrame:
    """(key, change, symbol, baseline_*, current_*, policy_match) of every symbol whose state changed. symbol shows it as it is now, or as it was if it is gone."""
    old, new = (with_display(states(f)).select("key", F.struct("reachable", "suppressed", "classification", "symbol").alias(side)) for f, side in ((baseline, "old"), (current, "new")))
    both = old.join(merged(new), "key", "full_outer")
    change = (
        F.when(F.col("old").isNull(), "new_symbol").when(F.col("new").isNull(), "removed").when(F.col("old.reachable") & ~F.col("new.reachable"), "newly_unreachable").when(~F.col("old.reachable") & F.col("new.reachable"), "became_reachable")
    )
    rows = both.withColumn("change", change).filter("change is not null")
    applies = F.lit(not policy.targets or target in policy.targets)
    match = applies & F.col("change").isin(*policy.changes) & ~F.coalesce("new.suppressed", F.lit(True)) & F.coalesce(F.col("new.classification").isin(*policy.classifications), F.lit(False))
    return rows.select("key", "change", F.coalesce("new.symbol", "old.symbol").alias("symbol"), *[F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("old", "baseline"), ("new", "current")) for c in ("reachable", "suppressed", "classification")], match.alias("policy_match"))


def counters(changed: DataFrame) -> DataFrame:
    """One row: the number of each kind of change, and of policy matches."""
    return changed.agg(*[F.count_if(F.col("change") == k).alias(k) for k in CHANGE_KINDS], F.count_if("policy_match").alias("policy_matches"))
