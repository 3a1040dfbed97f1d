"""The event store: Parquet events by namespace and batch, the registry of indexes, and the ledger of batches.

events/    ns= and batch= folders. A batch is written whole and can be written again, which replaces it: replays are safe.
registry/  (ns, key): ns '*' is the global registry; a namespace copies it when its first event comes.
ledger/    (ns, batch, base, n, sealed): the ids base + 1 to base + n belong to the batch. Ids go on from here, so no event is
           read for them. A sealed batch lies in a compacted one; when it comes again, nothing is written.

There is one writer at a time, as there is one for all commands of an engine.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions.predicates import Layout
from tagmill.lang.tokens import CommandError
from tagmill.plans.numbering import cut_lineage, dense_numbers, empty_like

from .lines import parse_lines

EVENTS = "id long, ts long, entity_str string, entity_i64 long, tags map<string,string>, tags_i64 map<string,long>, tag_order array<string>, ns string, batch string"
LEDGER = "ns string, batch string, base long, n long, sealed boolean"
REGISTRY = "ns string, key string"
MAX_INDEXES = 32
GLOBAL = "*"
#: A table of this many namespaces or fewer is broadcast: some hundred bytes each.
FEW = 10_000


class EventStore:
    """Events under one folder, local or on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.events_path, self.registry_path, self.ledger_path = f"{self.root}/events", f"{self.root}/registry", f"{self.root}/ledger"

    def _read(self, path: str, schema: str, **options: str) -> DataFrame:
        """With the schema given, so that no file is opened to learn it."""
        try:
            return self.spark.read.options(**options).schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return empty_like(self.spark, schema)
            raise

    def namespace(self, ns: str, keys: list[str] | None = None) -> DataFrame:
        """Events of one namespace, with idx_ columns for keys: only its folder is listed, only its files are opened."""
        extra = "".join(f", `idx_{k}` long" for k in keys or [])
        return self._read(f"{self.events_path}/ns={ns}", EVENTS + extra, basePath=self.events_path).where(F.col("ns") == ns)

    def registry(self) -> DataFrame:
        return self._read(self.registry_path, REGISTRY)

    def ledger(self) -> DataFrame:
        """One row for each namespace and batch, the last that was written."""
        rows = self._read(self.ledger_path, LEDGER)
        return rows.groupBy("ns", "batch").agg(F.min("base").alias("base"), F.max("n").alias("n"), F.max("sealed").alias("sealed"))

    def has(self, ns: str) -> bool:
        return not self.registry().where((F.col("key") == "ts") & (F.col("ns") == ns)).isEmpty()

    def indexes(self, ns: str) -> list[str]:
        """Keys indexed in ns ('*': those that the next new namespace gets); ts is one everywhere."""
        got = {r["key"] for r in self.registry().where(F.col("ns") == ns).select("key").distinct().collect()}
        return sorted(got | {"ts"})

    def add_index(self, key: str) -> None:
        have = self.indexes(GLOBAL)
        if key in have:
            raise CommandError("Duplicate index")
        if len(have) >= MAX_INDEXES:
            raise CommandError("Too many indexes")
        self.spark.createDataFrame([(GLOBAL, key)], REGISTRY).coalesce(1).write.mode("append").parquet(self.registry_path)

    def table(self, ns: str) -> tuple[DataFrame, Layout]:
        """The namespace's events, with a column for each of its indexes."""
        keys = [k for k in self.indexes(ns) if k != "ts"]
        return self.namespace(ns, keys), Layout(indexes={k: f"idx_{k}" for k in keys})

    def append(self, lines: DataFrame, batch: str) -> DataFrame:
        """Write the events of lines (line, arrival, source, pos) as one batch; returns the refused lines.

        Ids go on from the namespace's largest, in order of arrival, source and position; a batch that is written
        again, with the same lines, gets the ids that it had.
        """
        parsed = cut_lineage(parse_lines(lines))
        fresh = parsed.where("error is null")
        own = F.col("batch") == batch
        counts = fresh.groupBy("ns").agg(F.count(F.lit(1)).alias("n"))
        before = self.ledger().groupBy("ns").agg(F.min(F.when(own, F.col("base"))).alias("again"), F.max(F.when(~own, F.col("base") + F.col("n"))).alias("last"), F.coalesce(F.max(F.when(own, F.col("sealed"))), F.lit(False)).alias("done"))
        known = self.registry().groupBy("ns").agg(F.collect_set("key").alias("keys"))
        globally = self.indexes(GLOBAL)
        touched = counts.join(before, "ns", "left").join(known, "ns", "left").where("not coalesce(done, false)")
        touched = cut_lineage(touched.select("ns", "n", F.coalesce("again", "last", F.lit(0)).alias("base"), F.coalesce("keys", F.array(*[F.lit(k) for k in globally])).alias("keys"), F.col("keys").isNull().alias("new")))
        some = touched.count()
        if some:
            touched.where("new").select("ns", F.explode("keys").alias("key")).coalesce(1).write.mode("append").parquet(self.registry_path)
            told = touched.select("ns", "base", "keys")
            numbered = dense_numbers(fresh, "ns", ["arrival", "source", "pos"], "_number").join(F.broadcast(told) if some <= FEW else told, "ns")
            out = numbered.withColumn("id", F.col("_number") + F.col("base")).withColumn("ts", F.col("arrival")).withColumn("batch", F.lit(batch))
            promoted = [F.when(F.array_contains("keys", key), F.col("tags_i64").getItem(key)).alias(f"idx_{key}") for key in globally if key != "ts"]
            names = [c.split()[0] for c in EVENTS.split(", ")]
            out.select(*names, *promoted).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ns", "batch").parquet(self.events_path)
            touched.select("ns", F.lit(batch).alias("batch"), "base", "n", F.lit(False).alias("sealed")).coalesce(1).write.mode("append").parquet(self.ledger_path)
        return parsed.where("error is not null").select("line", "error", "source", "pos")

    def compact(self, ns: str, rows_per_file: int = 1_000_000) -> int:
        """Merge the batches of a namespace into files in order of id; the number of batches merged.

        The new batch is written whole before the ledger seals the old ones, and they go last: a failure leaves the
        old batches in place. Readers of the namespace wait meanwhile, as they do for the one writer.
        """
        events = self.namespace(ns, [k for k in self.indexes(ns) if k != "ts"])
        batches = [r["batch"] for r in events.select("batch").distinct().collect()]
        if len(batches) < 2:
            return 0
        files = max(1, -(-events.count() // rows_per_file))
        name, jvm = f"merged-{uuid.uuid4().hex[:12]}", self.spark._jvm
        ready, place = f"{self.root}/merging/{name}", f"{self.events_path}/ns={ns}"
        events.drop("ns", "batch").repartitionByRange(files, "id").sortWithinPartitions("id").write.parquet(ready)
        sealed = self.ledger().where((F.col("ns") == ns) & F.col("batch").isin(batches)).withColumn("sealed", F.lit(True))
        cut_lineage(sealed.select("ns", "batch", "base", "n", "sealed")).coalesce(1).write.mode("append").parquet(self.ledger_path)
        to = jvm.org.apache.hadoop.fs.Path(place)
        fs = to.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.rename(jvm.org.apache.hadoop.fs.Path(ready), jvm.org.apache.hadoop.fs.Path(f"{place}/batch={name}"))
        for b in batches:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{place}/batch={b}"), True)
        return len(batches)


def now_ms() -> int:
    return time.time_ns() // 1_000_000
