"""Helpers that the corpus operators share: shared-folder tables, Arrow text access, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch on its way to a Python worker; keeps memory flat when texts are long.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a local one where it is unset."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="causeway-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Caps Arrow batches by bytes and rows, so that a run of long texts does not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


#: Tables from one collection on the driver to the next. Plans and their metrics are garbage once a table is written; left
#: lying, that of many small steps fills the driver's heap, however little the driver holds.
COLLECT = 8

_scopes: list[list[Tables]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Drops at its end what operators have written within; results that are still wanted must be written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for tables in _scopes.pop():
            tables.clear()


class Tables:
    """Written tables that cut lineage; they outlive a lost executor. An operator drops what its own steps are done with; what
    its result reads stays until the caller's `scratch` ends."""

    #: By all operators of this process.
    written = 0

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        if _scopes:
            _scopes[-1].append(self)

    def put(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        self.n += 1
        Tables.written += 1
        if Tables.written % COLLECT == 0:
            self.spark._jvm.System.gc()
        path = f"{self.root}/{self.n}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._table_path = path
        return out

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._table_path)

    def clear(self) -> None:
        self._delete(self.root)


#: Keys with more than a share of 1 / HOT of all rows, fewer than HOT of them by that share, are dealt over SPREAD tasks.
HOT, SPREAD = 2000, 64


def split_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, deal: list[str], few: int = 0) -> DataFrame:
    """Inner join to a right side of one row a key, without bringing a hot key's rows to one task.

    Column n of right is the number of left rows that have the key, total a bound of their sum. A hot key's right row is
    copied, and its left rows are dealt over the copies by the columns `deal`. The marks of hot keys are broadcast: by
    their share there are fewer than HOT. n is left out of the result. Up to few rows in all, a task can join every one of
    them: nothing is marked or dealt, and the plan is half as long.
    """
    if total <= few:
        return left.join(right.drop(n), keys)
    hot = F.col(n) > max(total // HOT, 1)
    marks = F.broadcast(right.where(hot).select(*keys, F.lit(SPREAD).alias("_ways")))
    dealt = left.join(marks, keys, "left").withColumn("_way", F.pmod(F.xxhash64(*deal), F.coalesce("_ways", F.lit(1)))).drop("_ways")
    ways = F.explode(F.sequence(F.lit(0).cast("long"), F.when(hot, SPREAD - 1).otherwise(0).cast("long")))
    return dealt.join(right.withColumn("_way", ways).drop(n), [*keys, "_way"]).drop("_way")


def octets(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        if batch.num_rows:
            yield batch


def connected_components(tables: Tables, links: DataFrame) -> DataFrame:
    """(node, component) of every node on a link (a, b): component is the smallest node that can be reached.

    Alternates large-star and small-star; each round hooks nodes to the least neighbour and is written to the shared
    folder. Minima are aggregated map-side first, so a hub sends one row a task.
    """
    edges = tables.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = tables.put(small.where("u <> v").distinct())
        tables.drop(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def one_a_group(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group (doc_id, component_id), once each; rows without a doc_id stay."""
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.where("doc_id is not null")
    one = named.join(kept, named.doc_id.cast("long") == kept.kept_id, "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where("doc_id is null"))
