"""The fact store: batches of facts per translation unit, keyed by what they were made from, published whole or not at all.

A unit's key is a digest of its command and configuration; its dependencies' digests are kept beside the facts. A run asks which units
are still valid, extracts the others and publishes; readers see the newest batch of each unit. Batches arrive from batch runs or from
streams, one micro-batch at a time, and any number of writers may share a store.

A publication is a transaction with a key of its own: the writer (a batch run, or a stream by the id in its checkpoint) and that writer's batch number.
It first claims the next run number, by creating a file that must not exist, so no two transactions ever write to one folder. Then it writes its
tables and its part of the manifest below that number, and last it renames its record, which names the run, to the transaction's key. That rename is the
publication: a reader takes the runs that records name and no others, and a transaction that has a record is never published again. Writers in several
applications need a file system that creates and renames without overwriting in one step, as HDFS does.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable, Iterable
from types import ModuleType

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from reachlake.functions.keys import length_prefixed
from reachlake.operators.resolve import stale_units

STORE_VERSION = "1"


def unit_key(fields: dict[str, Column]) -> Column:
    """A digest of named parts; lengths are part of it, so no two lists of parts run together."""
    return F.sha2(F.concat(length_prefixed("store", F.lit(STORE_VERSION)), *[length_prefixed(k, v) for k, v in sorted(fields.items())]).cast("binary"), 256)


def file_digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, digest) of files, each once."""
    return spark.read.format("binaryFile").load(sorted(set(paths))).select("path", F.sha2("content", 256).alias("digest"))


def tool_fingerprint(*modules: ModuleType) -> str:
    """A digest of the code that made the facts, so that facts of other code aren't reused."""
    found = hashlib.sha256(STORE_VERSION.encode())
    for m in sorted(modules, key=lambda m: m.__name__):
        with open(m.__file__, "rb") as file:
            found.update(m.__name__.encode() + hashlib.sha256(file.read()).digest())
    return found.hexdigest()


MANIFEST = "unit string, path string, digest string, is_primary boolean, run long"
#: Hadoop's local file system looks before it creates or renames, in two steps; HDFS does it in one.
ONE_STEP = threading.Lock()
#: Who published which run: the record of a transaction.
RECORD = "run long, writer string, batch long"
#: The writer of batch runs; each of them is a transaction of its own.
BATCH_RUN = "batch run"


class FactStore:
    """Folders by fact table and run under one root; a run that no record names doesn't exist."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.paths = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.paths(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.files.exists(self.paths(f"{self.root}/{name}"))

    def claimed_run(self) -> int:
        """A run number that no other transaction has, above all that were claimed before."""
        folder = self.paths(f"{self.root}/runs")
        self.files.mkdirs(folder)
        number = max((int(x.getPath().getName()) for x in self.files.listStatus(folder) if x.getPath().getName().isdigit()), default=0)
        while True:
            number += 1
            try:
                with ONE_STEP:
                    if self.files.createNewFile(self.paths(f"{self.root}/runs/{number}")):
                        return number
            except Py4JJavaError as error:
                if "AlreadyExists" not in error.java_exception.getClass().getName():
                    raise

    def record_name(self, writer: str, batch: int) -> str:
        return f"transactions/{hashlib.sha256(f'{len(writer)}:{writer}:{batch}'.encode()).hexdigest()}"

    def published(self, writer: str, batch: int) -> bool:
        return self.exists(self.record_name(writer, batch))

    def publish(self, facts: dict[str, DataFrame], dependencies: DataFrame, transaction: tuple[str, int] | None = None) -> int | None:
        """facts by table, each with unit; dependencies has unit, path, digest, is_primary. transaction is (writer, batch); without it this is a batch run.
        Returns the run's number, or None if the transaction was published before, in which case nothing changes."""
        if transaction and self.published(*transaction):
            return None
        run = self.claimed_run()
        writer, batch = transaction or (BATCH_RUN, run)
        for name, table in facts.items():
            table.write.parquet(f"{self.root}/{name}/run={run}")
        dependencies.select("unit", "path", "digest", "is_primary").write.parquet(f"{self.root}/manifest/run={run}")
        draft, record = f"{self.root}/drafts/{run}", f"{self.root}/{self.record_name(writer, batch)}"
        self.files.mkdirs(self.paths(f"{self.root}/transactions"))
        out = self.files.create(self.paths(draft), False)
        out.write(json.dumps({"run": run, "writer": writer, "batch": batch}).encode())
        out.close()
        # FileContext renames in one step and, unlike the file system's own rename, fails where the name is taken.
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            with ONE_STEP:
                context.rename(self.paths(draft), self.paths(record), options)
        except Py4JJavaError as error:
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            self.discard(run, facts)  # another attempt at the same transaction was faster
            return None
        return run

    def discard(self, run: int, tables: Iterable[str]) -> None:
        for name in [*(f"{t}/run={run}" for t in (*tables, "manifest")), f"drafts/{run}"]:
            self.files.delete(self.paths(f"{self.root}/{name}"), True)

    def transactions(self) -> DataFrame | None:
        """(run, writer, batch) of what was published."""
        return self.spark.read.schema(RECORD).json(f"{self.root}/transactions") if self.exists("transactions") else None

    def manifest(self) -> DataFrame | None:
        """(run, unit, path, digest, is_primary) of published runs."""
        runs = self.transactions()
        if runs is None or not self.exists("manifest"):
            return None
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest").join(runs.select("run"), "run", "left_semi").select("run", "unit", "path", "digest", "is_primary")

    def newest(self) -> DataFrame | None:
        """(unit, run): where each unit's current batch is."""
        manifest = self.manifest()
        return None if manifest is None else manifest.groupBy("unit").agg(F.max("run").alias("run"))

    def valid_units(self, current: DataFrame) -> DataFrame | None:
        """(unit) whose newest batch was made from files that still have the digests of current (path, digest)."""
        manifest = self.manifest()
        if manifest is None:
            return None
        last = manifest.withColumn("newest", F.max("run").over(Window.partitionBy("unit"))).filter("run = newest")
        return stale_units(last, current).filter("valid").select("unit")

    def table(self, name: str) -> DataFrame:
        """The current rows of a fact table. Runs are partitions, so the join prunes those without a current unit."""
        newest = self.newest()
        if newest is None:
            raise FileNotFoundError(f"the store {self.root} has no published run")
        rows = self.spark.read.parquet(f"{self.root}/{name}")
        return rows.withColumn("run", F.col("run").cast("long")).join(newest, ["unit", "run"], "left_semi")

    def sweep(self) -> list[int]:
        """Deletes what transactions that never ended have left, and returns their runs. No writer may be at work meanwhile."""
        records = self.transactions()
        named = {r.run for r in records.select("run").collect()} if records is not None else set()  # a number per run
        found: dict[int, list[str]] = {}
        for table in [x.getPath().getName() for x in self.files.listStatus(self.paths(self.root)) if x.isDirectory()]:
            for x in self.files.listStatus(self.paths(f"{self.root}/{table}")):
                name = x.getPath().getName()
                run = name.removeprefix("run=") if name.startswith("run=") else name if table == "drafts" else ""
                if run.isdigit() and int(run) not in named:
                    found.setdefault(int(run), []).append(table)
        for run, tables in found.items():
            self.discard(run, [t for t in tables if t != "drafts"])
        return sorted(found)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint over restarts; it is there before the first batch."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()[0])["id"]


def ingest_stream(batches: DataFrame, store: FactStore, split: Callable[[DataFrame], tuple[dict[str, DataFrame], DataFrame]], checkpoint: str) -> StreamingQuery:
    """Publishes each micro-batch as a transaction of this stream. A batch that is repeated after a failure is published once; other writers of the
    store, streams among them, have transactions of their own. A stream that starts from a new checkpoint is a new writer and publishes anew what it reads."""

    def publish(batch: DataFrame, number: int) -> None:
        transaction = (f"stream {stream_id(store.spark, checkpoint)}", number)
        if store.published(*transaction):
            return
        kept = batch.persist()
        try:
            store.publish(*split(kept), transaction)
        finally:
            kept.unpersist()

    return batches.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
