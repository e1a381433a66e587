"""Streams: new response files merged into a table of current answers, and quality over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_quality(stream: DataFrame, at: str, key: str, value: str, late: str = "35 days", size: str = "1 day") -> DataFrame:
    """Counts and means by tumbling window and key; rows later than `late` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count(F.lit(1)).alias("rows"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), key, "rows", "mean")


def latest_rows(df: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """The newest row of each key."""
    by = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in at))
    return df.withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn")


#: Buckets of a merged table: a batch rewrites only those that its keys fall in.
BUCKETS = 64


def merge_stream(stream: DataFrame, target: str, keys: list[str], at: list[str], checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge every batch into a parquet table, the newest row of a key winning.

    The table is cut into buckets by a hash of the key. A batch merges the buckets that it touches
    and writes each as a folder named by bucket and batch; a manifest per batch says which folder
    of each bucket counts, and is written last. A batch that is run again after a failure reads the
    manifest before its own and writes the same folders anew, so the merge is exactly-once. Folders
    and manifests older than the last two manifests are deleted.
    """

    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = manifest(spark, target, n - 1)
        now = latest_rows(batch, keys, at).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        now.write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/batch{n}")
        fs, path = _fs(spark, target)
        touched = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(path(f"batch{n}")) if "=" in f.getPath().getName()]  # at most `buckets`
        after = dict(before)
        old = [f"{target}/{before[b]}" for b in touched if b in before]
        new = spark.read.schema(batch.schema).parquet(*(f"{target}/batch{n}/_bucket={b}" for b in touched)) if touched else None
        if new is not None:
            both = spark.read.schema(batch.schema).parquet(*old).unionByName(new) if old else new
            merged = latest_rows(both, keys, at).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            merged.write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/data/v{n}")
            after |= {b: f"data/v{n}/_bucket={b}" for b in touched}
        spark.createDataFrame([(b, f) for b, f in after.items()], "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/v{n}")
        fs.delete(path(f"batch{n}"), True)
        if n >= 2:  # what neither this manifest nor the one before names
            used = set(after.values()) | set(before.values())
            for b, f in manifest(spark, target, n - 2).items():
                if f not in used:
                    fs.delete(path(f), True)
            fs.delete(path(f"manifest/v{n - 2}"), True)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fs(spark: SparkSession, target: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(target).getFileSystem(spark._jsc.hadoopConfiguration()), lambda rel: hadoop.Path(f"{target}/{rel}")


def manifest(spark: SparkSession, target: str, n: int) -> dict[int, str]:
    """The folder of every bucket after batch n."""
    fs, path = _fs(spark, target)
    if n < 0 or not fs.exists(path(f"manifest/v{n}")):
        return {}
    return {r["bucket"]: r["folder"] for r in spark.read.parquet(f"{target}/manifest/v{n}").collect()}  # at most as many as buckets


def merged_table(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The table as its last manifest has it."""
    fs, path = _fs(spark, target)
    ns = [int(f.getPath().getName()[1:]) for f in fs.listStatus(path("manifest"))] if fs.exists(path("manifest")) else []
    folders = list(manifest(spark, target, max(ns)).values()) if ns else []
    return spark.read.schema(schema).parquet(*(f"{target}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)
