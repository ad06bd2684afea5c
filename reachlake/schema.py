"""Fact tables and enumerations. Sorts use an enumeration's ordinal, never its name."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

# The enumerations of the data model, in ordinal order.
SYMBOL_KINDS = ("function", "method", "constructor", "destructor", "synthetic")
SCOPES = ("reportable", "indexed", "external_opaque", "excluded")
EDGE_KINDS = ("direct_call", "constructs", "virtual_dispatch", "callback_registration", "provider")
ROOT_KINDS = ("application_entry_point", "global_initializer", "manual", "callback_registration", "provider", "public_api")
ESCAPE_KINDS = ("address_taken", "callable_object", "provider")
IDENTITY_QUALITIES = ("stable", "fallback")
CLASSIFICATIONS = ("dead", "likely_dead", "possibly_dead", "dynamically_referenced")
EVIDENCE_KINDS = ("no_reachable_path", "internal_linkage", "virtual_dispatch_uncertainty", "escape")
CHANGE_KINDS = ("new_symbol", "newly_unreachable", "removed", "became_reachable")
TARGET_KINDS = ("executable", "static_library", "shared_library", "module_library", "object_library", "interface_library", "utility")
FRONTENDS = ("ast-json", "libtooling")
RUN_STATES = ("complete", "incomplete", "unsupported")
UNIT_STATUSES = ("indexed", "failed", "skipped", "timed_out", "unsupported", "cancelled")

#: Edges and roots that exist because a provider or a registration says so.
PROVIDED = ("callback_registration", "provider")
#: Scopes whose bodies were indexed; symbols of other scopes end a path.
INDEXED_BODIES = ("reportable", "indexed")


def text(name: str, nullable: bool = True) -> StructField:
    return StructField(name, StringType(), nullable)


def number(name: str) -> StructField:
    return StructField(name, LongType())


POINT = StructType([text("file"), number("line"), number("column"), number("offset"), number("token_length")])
EXTENT = StructType([StructField("location", POINT), StructField("begin", POINT), StructField("end", POINT)])
SOURCE = StructType([StructField("spelling", EXTENT), StructField("expansion", EXTENT)])
EVIDENCE = StructType([text("provider"), text("reason")])
IDENTITY = StructType([text("quality"), text("configuration_id"), text("usr"), text("linkage_name"), text("translation_unit"), text("fallback_anchor")])
SYMBOL = StructType([
    text("key"), StructField("identity", IDENTITY), text("name"), text("qualified_name"), text("class_name"), text("signature"), text("kind"), text("scope"),
    StructField("defined", BooleanType()), StructField("internal_linkage", BooleanType()), StructField("is_virtual", BooleanType()), StructField("source", SOURCE),
])
EDGE = StructType([text("src"), text("dst"), text("kind"), StructField("evidence", EVIDENCE)])
ROOT = StructType([text("symbol"), text("kind"), StructField("evidence", EVIDENCE)])
ESCAPE = StructType([text("symbol"), text("from"), text("kind"), StructField("evidence", EVIDENCE)])
SUPPRESSION = StructType([text("symbol"), StructField("evidence", EVIDENCE)])


@dataclass(frozen=True)
class Facts:
    """The five fact tables. Keys may be of any type; columns that an operator doesn't name don't matter to it."""

    symbols: DataFrame
    edges: DataFrame
    roots: DataFrame
    escapes: DataFrame
    suppressions: DataFrame

    def with_(self, **tables: DataFrame) -> Facts:
        return replace(self, **tables)


def ordinal(column: Column, values: tuple[str, ...]) -> Column:
    """The value's place in the enumeration, null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, values)), column), F.lit(0)).cast("int") - 1


def primary_extent(source: str = "source") -> Column:
    """Where a macro was expanded if it was, else where the text stands."""
    return F.coalesce(F.col(f"{source}.expansion"), F.col(f"{source}.spelling"))
