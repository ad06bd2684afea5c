"""Build descriptions: compilation databases, CMake File API replies, target manifests, make dependency files.

Documents are parsed to VARIANT where their rows are, and what they must hold is asserted on the rows; the driver sees the first few that don't. A compilation database is cut
into its entries by its lines, a manifest or reply is one row.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.functions.text import normal, normalize_command, relative_normal, shell_words
from reachlake.schema import TARGET_KINDS
from reachlake.sources.members import at, checked, is_object, list_members, list_of, lone_surrogate, number_of, parsed, text_of
from reachlake.sources.strict import whole_files
from reachlake.storage import written

COMMANDS = "directory string, file string, output string, arguments array<string>, index long"


def joined(folder: str | Column, path: Column) -> Column:
    """path, below a folder unless it is absolute, in its normal form."""
    return normal(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(folder) if isinstance(folder, str) else folder, F.lit("/"), path)))


def is_text(value: Column, empty: bool = False) -> Column:
    return F.char_length(text_of(value)) >= (0 if empty else 1)


def folder_of(path: str) -> str:
    return posixpath.dirname(re.sub(r"^file:/+", "/", path))


def read_compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """The commands of a compilation database of any size; relative paths are resolved against its folder, and arguments win over a shell command."""
    entries = list_members(spark, path).withColumn("v", parsed(F.col("text")))
    entry = lambda message: F.concat(F.lit("entry "), F.col("index").cast("string"), F.lit(message))
    of = lambda name: at(F.col("v"), f"$.{name}")
    given = of("arguments").isNotNull()
    words = F.when(given, F.transform(list_of(of("arguments")), text_of)).otherwise(shell_words(F.when(~given, text_of(of("command")))))
    checked(entries, "compilation database", (F.col("v").isNotNull(), entry(" is no JSON, or repeats a key")), (~lone_surrogate(F.col("text")), entry(" holds half a character")))
    checked(
        entries, "compilation database", (is_object(F.col("v")), entry(" must be an object")), (is_text(of("directory")), entry(".directory must be a non-empty string")), (is_text(of("file")), entry(".file must be a non-empty string")),
        (given | is_text(of("command")), entry(".command must be a non-empty string")), (~given | F.forall(list_of(of("arguments")), lambda x: text_of(x).isNotNull()), entry(".arguments must be strings")),
        (F.coalesce(F.schema_of_variant(of("output")), F.lit("VOID")).isin("STRING", "VOID"), entry(".output must be a string")),
    )
    directory = joined(folder_of(path), text_of(of("directory")))
    rows = entries.select("index", directory.alias("directory"), text_of(of("file")).alias("file"), text_of(of("output")).alias("output"), words.alias("arguments"))
    output = F.when(F.char_length("output") > 0, joined(F.col("directory"), F.col("output"))).otherwise("")
    rows = written(rows.select("directory", joined(F.col("directory"), F.col("file")).alias("file"), output.alias("output"), "arguments", "index"), "commands")
    return checked(rows, "compilation database", (F.size("arguments") > 0, entry(" has an empty command")))


def normalized_commands(commands: DataFrame, read: Callable[[str], str] | None = None) -> DataFrame:
    """commands with normalised arguments and command_inputs. Response files are read on the executors."""

    def local(path: str) -> str:
        with open(path, encoding="utf-8") as file:
            return file.read()

    reader = read or local

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            done = [normalize_command(d, f, list(a), reader) for d, f, a in zip(df["directory"], df["file"], df["arguments"], strict=True)]
            yield df.assign(arguments=[a for a, _ in done], command_inputs=[i for _, i in done])

    return commands.select("directory", "file", "output", "arguments", "index").mapInPandas(run, COMMANDS + ", command_inputs array<string>")


@dataclass
class Build:
    """Targets with their sources, dependencies, headers and artifacts as tables, all of which have configuration and id (dependencies target instead)."""

    root: str
    targets: DataFrame
    sources: DataFrame
    dependencies: DataFrame
    headers: DataFrame
    artifacts: DataFrame


def one_document(spark: SparkSession, path: str, what: str) -> DataFrame:
    """A document of at most one VARIANT's size as a row (v)."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), parsed(F.col("value")).alias("v"))
    rows = written(rows, "document")
    if rows.count() != 1:
        raise ValueError(f"{path} is not one file")
    checked(rows, what, (F.col("v").isNotNull(), "no JSON, or an object repeats a key"), (~lone_surrogate(F.col("text")), "holds half a character"))
    return checked(rows.select("v"), what, (is_object(F.col("v")), "must be an object"))


def read_target_manifest(spark: SparkSession, path: str) -> Build:
    """The targets of a manifest of version 1 or 2."""
    top, v = one_document(spark, path, "target manifest"), F.col("v")
    version = number_of(at(v, "$.schema_version"))
    roots = [is_text(at(v, f"$.{r}_root")) for r in ("source", "build")]
    checked(top, "target manifest", (version.isin(1, 2), "unsupported schema_version"), (roots[0], "source_root must be a non-empty string"), (roots[1], "build_root must be a non-empty string"), (list_of(at(v, "$.configurations")).isNotNull(), "configurations must be a sequence"))
    source, build, version = top.select(*[joined(folder_of(path), text_of(at(v, f"$.{r}_root"))) for r in ("source", "build")], version).first()
    configurations = top.select(F.explode(list_of(at(v, "$.configurations"))).alias("v"))
    checked(configurations, "target manifest", (is_text(at(v, "$.name"), empty=True), "a configuration's name must be a string"), (list_of(at(v, "$.targets")).isNotNull(), "targets must be a sequence"))
    targets = written(configurations.select(text_of(at(v, "$.name")).alias("configuration"), F.explode(list_of(at(v, "$.targets"))).alias("v")), "targets")
    lists = ("sources", "dependencies", "artifacts", *(["public_headers"] if version == 2 else []))
    strings = lambda key: F.coalesce(F.when(at(v, f"$.{key}").isNull(), F.array().cast("array<variant>")), list_of(at(v, f"$.{key}")))
    checked(
        targets, "target manifest", (is_text(at(v, "$.id")), "target id must be a non-empty string"), (is_text(at(v, "$.name")), "target name must be a non-empty string"), (text_of(at(v, "$.type")).isin(*TARGET_KINDS), f"target type must be one of {', '.join(TARGET_KINDS)}"),
        *[(F.forall(strings(k), lambda x: is_text(x)), f"{k} must be non-empty strings") for k in lists],
    )
    named = [F.col("configuration"), text_of(at(v, "$.id")).alias("id")]
    each = lambda key, base: targets.select(*named, F.explode(strings(key)).alias("x")).select("configuration", "id", joined(base, text_of(F.col("x"))).alias("path")).distinct()
    dependencies = targets.select("configuration", named[1].alias("target"), F.explode(strings("dependencies")).alias("x")).select("configuration", "target", text_of(F.col("x")).alias("dependency"), F.lit(None).cast("string").alias("command"))
    headers = each("public_headers", source)
    return Build(source, targets.select(*named, text_of(at(v, "$.name")).alias("name"), text_of(at(v, "$.type")).alias("kind")).distinct(), each("sources", source), dependencies.distinct(), headers if version == 2 else headers.limit(0), each("artifacts", build))


def is_reply_name(name: Column) -> Column:
    """Whether a reference of a reply is relative, and inside the reply's folder."""
    return (F.char_length(name) > 0) & ~F.startswith(name, F.lit("/")) & ~F.startswith(relative_normal(name), F.lit(".."))


def newest_index(spark: SparkSession, folder: str) -> str:
    """The newest index by time, then by name."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "index-*.json").load(folder).agg(F.max(F.struct("modificationTime", "path"))).first()[0]
    if rows is None:
        raise ValueError(f"no reply index in {folder}")
    return rows["path"]


#: The reply's target types.
CMAKE_KINDS = {"EXECUTABLE": "executable", "STATIC_LIBRARY": "static_library", "SHARED_LIBRARY": "shared_library", "MODULE_LIBRARY": "module_library", "OBJECT_LIBRARY": "object_library", "INTERFACE_LIBRARY": "interface_library", "UTILITY": "utility"}


def read_cmake_replies(spark: SparkSession, folder: str) -> Build:
    """The newest codemodel of a reply folder (major version 2); a target's reply must have the id and name by which it is referred to."""
    v, what = F.col("v"), "CMake reply"
    models = one_document(spark, newest_index(spark, folder), what).select(F.explode(list_of(at(v, "$.objects"))).alias("v"))
    model = models.filter((text_of(at(v, "$.kind")) == "codemodel") & (number_of(at(v, "$.version.major")) == 2)).select(text_of(at(v, "$.jsonFile")).alias("file")).limit(1)
    if model.isEmpty():
        raise ValueError("the reply has no codemodel of version 2")
    outside = "a reply reference must be relative and stay in the reply folder"
    top = one_document(spark, f"{folder}/{checked(model, what, (is_reply_name(F.col('file')), outside)).first()[0]}", what)
    checked(top, what, (is_text(at(v, "$.paths.source")), "source root must be a non-empty string"), (is_text(at(v, "$.paths.build")), "build root must be a non-empty string"))
    source, build = top.select(text_of(at(v, "$.paths.source")), text_of(at(v, "$.paths.build"))).first()
    configurations = top.select(F.explode(list_of(at(v, "$.configurations"))).alias("v"))
    refs = configurations.select(F.coalesce(text_of(at(v, "$.name")), F.lit("")).alias("configuration"), F.explode(list_of(at(v, "$.targets"))).alias("v"))
    refs = written(refs.select("configuration", text_of(at(v, "$.id")).alias("id"), text_of(at(v, "$.name")).alias("name"), text_of(at(v, "$.jsonFile")).alias("file")), "references")
    checked(refs, what, (F.char_length("id") > 0, "target id must be a non-empty string"), (F.char_length("name") > 0, "target name must be a non-empty string"), (is_reply_name(F.col("file")), outside))
    # The replies are read side by side and met by name, however many there are.
    texts = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True, recursiveFileLookup=True).select(normal(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")).alias("path"), F.col("value").alias("text"))
    wanted = refs.withColumn("path", joined(re.sub(r"^file:/+", "/", folder), F.col("file")))
    replies = written(wanted.join(texts, "path", "left").withColumn("v", parsed(F.col("text"))), "replies")
    named = lambda message: F.concat(F.lit("reply "), F.col("file"), F.lit(message))
    checked(replies, what, (v.isNotNull() & is_object(v) & ~lone_surrogate(F.col("text")), named(" is no JSON object")))
    checked(replies, what, ((text_of(at(v, "$.id")) == F.col("id")) & (text_of(at(v, "$.name")) == F.col("name")), F.concat(named(" is not of target "), F.col("name"))), (text_of(at(v, "$.type")).isin(*CMAKE_KINDS), named(" has an unknown type")))

    several = lambda value, path: F.coalesce(list_of(at(value, path)), F.array().cast("array<variant>"))
    files = F.transform(several(v, "$.sources"), lambda x: text_of(at(x, "$.path")))
    replies = replies.withColumns({"files": files, "kind": F.create_map(*[F.lit(x) for pair in CMAKE_KINDS.items() for x in pair])[text_of(at(v, "$.type"))]})
    own = ["configuration", "id"]
    groups = replies.select(*own, "file", "files", F.explode(several(v, "$.compileGroups")).alias("g")).filter(text_of(at(F.col("g"), "$.language")) == "CXX")
    compiled = groups.select(*own, "file", "files", F.explode(several(F.col("g"), "$.sourceIndexes")).alias("i")).select(*own, "file", F.get("files", number_of(F.col("i")).cast("int")).alias("path"))
    checked(compiled, what, (F.char_length("path") > 0, named(" has a source index without a source")))
    public = F.transform(several(v, "$.fileSets"), lambda x: (text_of(at(x, "$.type")) == "HEADERS") & text_of(at(x, "$.visibility")).isin("PUBLIC", "INTERFACE"))
    listed = replies.select(*own, public.alias("public"), F.explode(several(v, "$.sources")).alias("x")).filter(F.get("public", number_of(at(F.col("x"), "$.fileSetIndex")).cast("int")))
    links = replies.select(*own, "file", several(v, "$.backtraceGraph.nodes").alias("nodes"), several(v, "$.backtraceGraph.commands").alias("commands"), F.explode(several(v, "$.dependencies")).alias("x"))
    node = F.get("nodes", number_of(at(F.col("x"), "$.backtrace")).cast("int"))
    links = links.select(*own, "file", text_of(at(F.col("x"), "$.id")).alias("dependency"), text_of(F.get("commands", number_of(at(node, "$.command")).cast("int"))).alias("command"))
    checked(links, what, (F.char_length("dependency") > 0, named(" has a dependency without an id")))
    made = replies.select(*own, "file", F.explode(several(v, "$.artifacts")).alias("x")).select(*own, "file", text_of(at(F.col("x"), "$.path")).alias("path"))
    checked(made, what, (F.char_length("path") > 0, named(" has an artifact without a path")))
    return Build(
        source, replies.select(*own, "name", "kind").distinct(), compiled.select(*own, joined(source, F.col("path")).alias("path")).distinct(), links.select("configuration", F.col("id").alias("target"), "dependency", "command").distinct(),
        listed.select(*own, joined(source, text_of(at(F.col("x"), "$.path"))).alias("path")).distinct(), made.select(*own, joined(build, F.col("path")).alias("path")).distinct(),
    )


def depfile_inputs(text: str) -> list[str]:
    """The prerequisites of a make rule: lines may continue, and a backslash keeps a blank or itself."""
    body = text.replace("\\\r\n", " ").replace("\\\n", " ").partition(":")[2]
    found = [re.sub(r"\\(.)", r"\1", m[0]) for m in re.finditer(r"(?:\\.|[^\s\\])+", body)]
    if not found:
        raise ValueError("a dependency file without prerequisites")
    return found


def dependencies_of(files: DataFrame) -> DataFrame:
    """(path, dependency) for make dependency files (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame([(p, d) for p, t in zip(df["path"], df["text"], strict=True) for d in depfile_inputs(t)], columns=["path", "dependency"])

    return files.select("path", "text").mapInPandas(run, "path string, dependency string")


def read_depfiles(spark: SparkSession, *paths: str) -> DataFrame:
    return dependencies_of(whole_files(spark, *paths))


__all__ = ["Build", "dependencies_of", "depfile_inputs", "newest_index", "normalized_commands", "read_cmake_replies", "read_compile_commands", "read_depfiles", "read_target_manifest"]
