"""Session settings, scratch space and size checks shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# A side is broadcast only after it was measured to be below this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(master: str | None = None, app_name: str = "rankweave",
                  **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables a job writes and reads again.

    Uses the shared folder the cluster names in `spark.checkpoint.dir`; only a local session without
    that setting, as in tests, gets one of its own. The folder is removed when the session's JVM
    ends, since nothing reads it afterwards.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    path = f"{base.rstrip('/')}/rankweave/{name}-{uuid.uuid4().hex[:12]}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


_own: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    """The folder of a local session that names none."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="run-")
    return _own[app]


# A lookup by key hands the keys to the reader as one list; for more of them tables are joined.
PICKED_KEYS = 200_000
# Rows that are looked up by key lie in row groups of this size, with bloom filters on the key.
GROUP_BYTES = 8 * 1024 * 1024


def in_list(key: str, values: list) -> Column:
    """Whether a column is one of many numbers or strings, as a single list."""
    if not values:
        return F.lit(False)
    if isinstance(values[0], str):
        told = [f"CAST(X'{v.encode().hex()}' AS STRING)" for v in values]
    else:
        told = [f"{int(v)}L" for v in values]
    return F.expr(f"`{key}` IN ({', '.join(told)})")


def picked(df: DataFrame, key: str, wanted: DataFrame,
           group_bytes: int | None = None) -> DataFrame:
    """The rows of a stored table with one of the keys in `wanted`.

    Keys go to the Parquet reader as one list, whatever its length a single flat condition: bucket
    numbers leave the files of their buckets to open, bloom filters and ranges the row groups to
    decode. Where the keys are so many that nearly every row group holds one of them, nothing could
    be skipped and the tables are joined: a table bucketed by the key stays where it is and only the
    keys are dealt to its buckets.
    """
    keys = wanted.select(key).filter(F.col(key).isNotNull()).distinct()
    most = min(PICKED_KEYS, estimated_bytes(df) // (group_bytes or GROUP_BYTES))
    values = sorted(r[0] for r in keys.limit(most + 1).collect())
    if len(values) > most:
        return df.join(keys, key, "left_semi")
    return df.filter(in_list(key, values))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system layer sees `path` (local, HDFS or object store)."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def streamable(spark: SparkSession, path: str) -> str:
    """The path of a Parquet table that a file stream can be opened on.

    A stream takes a folder by its name, but a single file only by a pattern that matches it.
    """
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    is_file = fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isFile()
    return f"{path[:-1]}[{path[-1]}]" if is_file else path


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold meanwhile."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def freed_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of what is written meanwhile go when it is written, not when the driver happens
    to collect its plan. For frames that are not read again."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a small intermediate result to the shared folder and read it back.

    What reads it several times does not repeat the work behind it, a lost executor does not
    either, and its true size is known to the planner. For results bounded by queries times `k`.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the folder of a frame made by `materialize` that nothing reads any more."""
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of a frame's size; for plain scans the size of the files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _partition_bytes(spark: SparkSession) -> int:
    value = spark.conf.get("spark.sql.files.maxPartitionBytes").lower()
    units = {"kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    for unit, factor in units.items():
        if value.endswith(unit):
            return int(value[:-len(unit)]) * factor
    return int(value.rstrip("b"))


def scan_tasks(df: DataFrame) -> int:
    """About how many tasks read a frame that is a plain scan."""
    return 1 + estimated_bytes(df) // _partition_bytes(df.sparkSession)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share of an input that comes in too few pieces, such as one small file.

    An input large enough to be read by more tasks than there are cores is never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if scan_tasks(df) > cores else df.repartition(cores, key)


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a frame, counted by one aggregation on the executors."""
    row_bytes = F.lit(16)
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            size = F.octet_length(col)
        elif isinstance(field.dataType, T.ArrayType):
            size = F.size(col) * 8
        else:
            size = F.lit(8)
        row_bytes = row_bytes + F.coalesce(size, F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def split(df: DataFrame, keys: list[str], size: int,
          limit: int = BROADCAST_BYTES) -> list[DataFrame]:
    """Split `df`, measured at `size` bytes, by hash of `keys` into parts below the limit.

    The caller runs its plan once per part and unions the results, so nothing is dropped however
    large the frame is.
    """
    if size <= limit:
        return [df]
    # Twice the parts needed, so that uneven hashing stays below the limit.
    n = 2 * -(-size // limit)
    return [df.filter(F.pmod(F.xxhash64(*keys), F.lit(n)) == i) for i in range(n)]


def chunks(df: DataFrame, key: str, limit: int = BROADCAST_BYTES) -> list[DataFrame]:
    """Measure and `split`."""
    return split(df, [key], measured(df)[1], limit)


def union_all(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner",
                limit: int = BROADCAST_BYTES, salts: int = 64) -> DataFrame:
    """Equi-join a large frame to a lookup table with at most a few rows per key.

    Below the limit the lookup side is broadcast. Beyond it the rows of a frequent key would meet
    in one task, so the large side is spread over `salts` copies of the lookup table.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("lookup_join keeps the large side: inner, left or left_semi")
    _, size = measured(small)
    if size <= limit:
        return big.join(F.broadcast(small), key, how)
    others = [c for c in big.columns if c != key]
    salted = big.withColumn(
        "_salt", F.pmod(F.xxhash64(*others) if others else F.lit(0), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
