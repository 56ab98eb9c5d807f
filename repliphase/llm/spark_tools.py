"""Helpers shared by the corpus operators: shared storage, row numbering, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that splits words: space and the six ASCII controls around tab.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the session names in ``spark.checkpoint.dir``. Only where nothing is named and
    driver and executors are one process, as in local tests, a new temporary folder is set.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffles, broadcasts and checkpoints that nothing refers to any more.

    Its cleaner only learns of them when the driver's garbage is collected, which in a run of many
    small jobs comes late: until then their files fill disks and their plans the driver's memory.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The same rows, written as Parquet in the shared folder, in a folder for each value of ``by``, and read again.

    This cuts the lineage in a way that survives lost executors; the files go when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """These names with a prefix that no column has, in any case of letters."""
    taken, mark = {c.lower() for c in columns}, "__"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def offsets_within(counts: DataFrame, keys: list[str], bucket: str, value: str, alias: str) -> DataFrame:
    """Exclusive running sums of ``value`` over ``bucket`` within ``keys``; a small table."""
    over = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(alias, F.coalesce(F.sum(value).over(over), F.lit(0)).cast("long"))


def running(df: DataFrame, keys: list[str], order: list[str], size: str | None, alias: str, buckets: int) -> DataFrame:
    """Exclusive running sum of ``size`` (of ones if None) within ``keys``, which are never null, in a fixed order.

    The order is by a hash bucket of the ``order`` columns, then by those columns. A key that
    holds most rows is still split over ``buckets`` tasks: each bucket is summed by itself and
    moved by the total of the buckets before it. One shuffle serves sums and join.
    """
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    df = df.withColumn("__bucket", bucket).withColumn("__size", F.lit(1).cast("long") if size is None else F.col(size).cast("long"))
    totals = df.groupBy(*keys, "__bucket").agg(F.sum("__size").alias("__total"))
    totals = offsets_within(totals, keys, "__bucket", "__total", "__before").drop("__total")
    over = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__inside", F.coalesce(F.sum("__size").over(over), F.lit(0)))
    return df.join(totals, [*keys, "__bucket"]).withColumn(alias, F.col("__before") + F.col("__inside")).drop("__bucket", "__size", "__before", "__inside")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of the edges (``u``, ``v``): rows (``node``, ``component``), the smallest node.

    Alternates large-star and small-star steps, each from a checkpoint, until every component
    is a star around its smallest node. Each step takes a minimum for each node, which is
    combined before the shuffle, and joins it back, which adaptive execution can split: a hub
    node is no hot task. Nodes without edges are not returned. Both columns are long and not null.
    """
    shared_dir(edges.sparkSession)

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("o")).union(e.select(F.col("v").alias("n"), F.col("u").alias("o")))
        low = both.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m")).withColumnRenamed("n", "_n")
        if large:
            out = both.where("o > n").join(low, F.col("n") == F.col("_n")).select(F.col("o").alias("v"), F.col("m").alias("u"))
        else:
            down = both.where("o < n").join(low, F.col("n") == F.col("_n"))
            out = down.select(F.explode(F.array(F.col("o"), F.col("n"))).alias("v"), F.col("m").alias("u"))
        return out.where("u < v").distinct()

    def settled(e: DataFrame) -> bool:
        """Each larger node has one edge, and no node is both the smaller and the larger of edges."""
        ends = e.select(F.col("v").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(e.select("u", F.lit(0), F.lit(1)))
        ends = ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        return not ends.where("below > 1 or (below > 0 and above > 0)").take(1)

    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct().checkpoint()
    for _ in range(most_rounds):
        if settled(e):
            break
        e = star(star(e, True).checkpoint(), False).checkpoint()
        release(e.sparkSession)
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(e.select("u", F.col("u").alias("c")).distinct())
