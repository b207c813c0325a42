"""Stage tables in the cluster's shared folder, and connected components over links."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local tests a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows in an Arrow batch from here on in this session: texts are long, and batches stand in memory on both sides of a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


class Scratch:
    """Stage tables of one run: written once, reread by later jobs, so a lost executor costs no lineage."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        # Spark deletes the write's shuffle files when it is done; without this they stay until the driver collects garbage
        cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        was = self.spark.conf.get(cleanup, "false")
        self.spark.conf.set(cleanup, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.at}/{name}")
        finally:
            self.spark.conf.set(cleanup, was)
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, name: str) -> None:
        """Deletes a stage table that no later step reads."""
        jvm, path = self.spark.sparkContext._jvm, f"{self.at}/{name}"
        to = jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_spread(df: DataFrame, counted: DataFrame, key: str, value: str, name: str, total: int, share: int = 1000) -> DataFrame:
    """df with `name`: counted's `value` for its key (not null). counted(key, n, value) has a row for each key of df's `total` rows, n of them its own.

    Keys of more than a share of the rows, `share` keys at most, are joined by broadcast; their rows are spread over
    all partitions in the join of the others, so that no task gets the rows of one key.
    """
    hot = F.col("n") * share > total
    heavy = counted.where(hot).select(F.col(key).alias("_hot"), F.col(value).alias("_heavy"))
    rest = counted.where(~hot).select(F.col(key).alias("_key"), F.col(value).alias("_light"))
    out = df.join(F.broadcast(heavy), F.col(key) == F.col("_hot"), "left")
    out = out.withColumn("_to", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("\0"), F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if df.schema[c].dataType.typeName() in ("long", "integer", "string")]), F.lit(4096)).cast("string"))))
    out = out.join(rest, F.col("_to") == F.col("_key"), "left")
    return out.select(*df.columns, F.coalesce("_heavy", "_light").alias(name))


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Connected components of links(a, b): node and component, the smallest node of its component.

    Alternates a step that hangs every neighbour of a node on the smallest one with a step that
    hangs larger neighbours only; both are grouped aggregations, so a hub with a third of all
    links stays a star of two-column rows and no pairs are made among its neighbours. Nodes
    without links are not in the result. Self links and repeated links are harmless.
    """
    node = links.schema["a"].dataType
    e = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.keep(e, "links0")
    for k in range(1, most_rounds + 1):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        nxt = scratch.keep(small.where("a <> b").distinct(), f"links{k}")
        same = nxt.select(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        was = e.select(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"links{k - 1}")
        e = nxt
        if same == was:
            break
    else:
        raise RuntimeError("components did not settle")
    found = e.groupBy("a").agg(F.min("b").alias("c"))
    tops = e.select(F.col("b").alias("a")).distinct().join(found, "a", "left_anti").select("a", F.col("a").alias("c"))
    return found.unionByName(tops).select(F.col("a").cast(node).alias("node"), F.col("c").cast(node).alias("component"))
