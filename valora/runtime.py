"""Session helpers shared by all operators: session, shared tables, size-checked broadcast."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a join side may be broadcast; a wider side goes through a shuffled join.
BROADCAST_ROWS = 500_000
#: Bytes that such a side may take, measured over all its rows.
BROADCAST_BYTES = 64 << 20

#: Rows of one join key that one task may get; a key with more is dealt over several.
SALT_ROWS = 200_000


def get_spark(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the engine expects (a cluster brings its own)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("valora")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is read from spark.checkpoint.dir. Only where that is unset and the master is local, as in
    tests, a temporary folder takes its place; on a cluster an unset folder is an error, since a
    machine-local folder would be lost with its machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    at = getattr(spark.sparkContext, "_valora_dir", None)
    if at is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="valora-")
        atexit.register(shutil.rmtree, at, True)
        spark.sparkContext._valora_dir = at
    return at


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, executors may go."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/valora/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._valora_path = at
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by keep() that no later result reads."""
    for t in tables:
        if getattr(t, "_valora_path", None):
            _delete(spark, t._valora_path)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application kept; results made from them can't be read any more."""
    _delete(spark, f"{shared_dir(spark)}/valora/{spark.sparkContext.applicationId}")


_FIXED = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def _bytes_of(c: Column, t: T.DataType) -> Column | int:
    """The bytes of a value: a number where its type tells, else a column that measures it."""
    fixed = _FIXED.get(t.simpleString())
    if fixed is not None:
        return fixed
    if isinstance(t, T.StructType):
        return _sum_bytes([(c[f.name], f.dataType) for f in t.fields])
    if isinstance(t, T.ArrayType):
        one = _bytes_of(F.lit(None), t.elementType)
        if isinstance(one, int):
            return F.coalesce(F.size(c), F.lit(0)).cast("long") * one + 16
        return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda a, x: a + _bytes_of(x, t.elementType)), F.lit(16))
    if isinstance(t, T.MapType):
        return _bytes_of(F.map_entries(c), T.ArrayType(T.StructType([T.StructField("key", t.keyType), T.StructField("value", t.valueType)])))
    if isinstance(t, T.DecimalType):
        return 16
    return F.coalesce(F.octet_length(c.cast("string") if not isinstance(t, (T.StringType, T.BinaryType)) else c), F.lit(0)).cast("long") + 8


def _sum_bytes(fields: list[tuple[Column, T.DataType]]) -> Column | int:
    parts = [_bytes_of(c, t) for c, t in fields]
    fixed, measured = sum(p for p in parts if isinstance(p, int)) + 8 * len(parts), [p for p in parts if not isinstance(p, int)]
    return reduce(lambda a, b: a + b, measured, F.lit(fixed).cast("long")) if measured else fixed


def row_bytes(df: DataFrame) -> Column | int:
    """Bytes of a row of df: a number if all its types have one width, else a column that measures it."""
    out = _sum_bytes([(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    return out + 16


def small_side(df: DataFrame, rows: int | None = None, width: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows and measured bytes prove it small, else df as it is.

    df should be a kept table: counting it reads footers only. Where rows hold texts, binaries or
    arrays, and only if the number of rows is within its bound, their bytes are summed over the
    table too, unless `width` states the bytes that no row exceeds by its making (as of digests).
    """
    n = df.count() if rows is None else rows
    if n > BROADCAST_ROWS:
        return df
    each = width or row_bytes(df)
    size = n * each if isinstance(each, int) else (df.agg(F.sum(each)).first()[0] or 0)
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right on keys; a key of more than SALT_ROWS left rows is dealt over several tasks.

    by: columns of left whose hash deals the rows of such a key; right's rows of it are repeated in
    every part. counts: (keys, n) of left's rows where they are known, else they are counted (kept
    tables make that cheap). The hot keys are at most left's rows / SALT_ROWS.
    """
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = counts.where(f"n > {SALT_ROWS}").select(*keys, F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("_parts"))
    if hot.isEmpty():
        return left.join(right, keys, how)
    hot = keep(hot, "hot")
    n = hot.count()
    parts = F.coalesce("_parts", F.lit(1))
    hot = small_side(hot, n)
    a = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files would keep less than half of them busy, else as it is.

    Only inputs of few files are moved, whose size a few scan partitions bound; large inputs have
    more partitions than cores and are read where they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
