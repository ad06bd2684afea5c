"""Identities and display texts of symbols as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: This engine's own version prefix of stable keys.
KEY_VERSION = "reachlake-symbol-v1"


def component(label: str, value: Column) -> Column:
    """|label=<bytes>:<value>"""
    value = F.coalesce(value, F.lit(""))
    return F.concat(F.lit(f"|{label}="), F.octet_length(value).cast("string"), F.lit(":"), value)


def present(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def stable_key(configuration: Column, linkage: Column, usr: Column, fallback: Column, unit: Column) -> Column:
    """The key of an identity: anchored by linkage name, else by USR, else by the fallback anchor. An identity without a
    configuration or without any anchor is an error."""
    anchor = F.when(present(linkage), "linkage").when(present(usr), "usr").otherwise("fallback")
    value = F.when(present(linkage), linkage).when(present(usr), usr).otherwise(fallback)
    key = F.concat(F.lit(KEY_VERSION), component("configuration", configuration), component("anchor", anchor), component("value", value), component("translation_unit", unit))
    return F.when(~present(configuration), F.raise_error(F.lit("an identity needs a configuration"))).when(~present(value), F.raise_error(F.lit("a fallback identity needs an anchor"))).otherwise(key)


def identity_quality(linkage: Column, usr: Column) -> Column:
    return F.when(present(linkage) | present(usr), "stable").otherwise("fallback")


def length_prefixed(name: str, value: Column) -> Column:
    value = F.coalesce(value, F.lit(""))
    return F.concat(F.lit(f"{len(name.encode())}:{name}"), F.octet_length(value).cast("string"), F.lit(":"), value)


def fallback_anchor(qualified: Column, signature: Column, path: Column, offset: Column) -> Column:
    return F.concat(qualified, F.lit("|"), signature, F.lit("|"), path, F.lit(":"), offset.cast("string"))


def qualified_name(scope: Column, name: Column) -> Column:
    return F.concat_ws("::", F.nullif(scope, F.lit("")), F.nullif(name, F.lit("")))


def normalized_type(spelling: Column) -> Column:
    """A type's spelling without qualifiers, elaborations, and reference, pointer or blank at its end."""
    out = spelling
    # The words that go, in this order; a removal can make a new one appear.
    for word in ("const ", "volatile ", "struct ", "class "):
        for _ in range(3):
            out = F.replace(out, F.lit(word), F.lit(""))
    return F.regexp_replace(out, r"[&*\s]+$|^\s+", "")


def internal_linkage(is_static: Column, mangled: Column, qualified: Column) -> Column:
    return is_static | F.startswith(mangled, F.lit("_ZL")) | F.contains(mangled, F.lit("GLOBAL__N")) | F.contains(qualified, F.lit("(anonymous namespace)"))


def path_contains(root: Column, path: Column) -> Column:
    """Whether a normalised path is root or below it; an empty path or root contains nothing."""
    return present(root) & present(path) & ((path == root) | F.startswith(path, F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))))


def scope_of(path: Column, root: Column, report_paths: Column, excluded_paths: Column) -> Column:
    """The scope of a file, first match wins: excluded, outside the project, under a report path, indexed."""
    under = lambda paths: F.exists(paths, lambda p: path_contains(p, path))
    return F.when(under(excluded_paths), "excluded").when(~path_contains(root, path), "external_opaque").when(under(report_paths), "reportable").otherwise("indexed")


def relative_to(root: Column, path: Column) -> Column:
    """path below root as a relative path, others unchanged."""
    return F.when(path_contains(root, path) & (path != root), F.substr(path, F.char_length(F.rtrim(root, F.lit("/"))) + 2)).otherwise(path)


def display_location(file: Column, line: Column, column: Column) -> Column:
    part = lambda n: F.nullif(n, F.lit(0)).cast("string")
    return F.when(present(file), F.concat_ws(":", file, part(line), F.when(line != 0, part(column)))).otherwise("<unknown>")


def display_symbol(qualified: Column, signature: Column, key: Column) -> Column:
    return F.when(present(qualified), F.concat_ws(" ", qualified, F.nullif(signature, F.lit("")))).otherwise(key)


def rule_id(change: Column, classification: Column) -> Column:
    return F.concat_ws(".", F.lit("reachlake"), change, classification)


def directory_key(path: Column) -> Column:
    """Sorts paths by their components."""
    return F.split(path, "/")


def public_header_reason(header: Column) -> Column:
    return F.concat(F.lit("declared in public header "), header)


def export_visibility(attribute: Column, arguments: Column) -> Column:
    """Whether a symbol is exported: its attribute decides, else the last -fvisibility= argument, else it is."""
    flags = F.filter(arguments, lambda a: F.startswith(a, F.lit("-fvisibility=")))
    last = F.try_element_at(flags, F.when(F.size(flags) > 0, -1).otherwise(F.lit(None).cast("int")))
    return F.when(present(attribute), attribute.isin("default", "protected")).otherwise(F.coalesce(last, F.lit("-fvisibility=default")).isin("-fvisibility=default", "-fvisibility=protected"))
