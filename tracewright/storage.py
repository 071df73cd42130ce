"""Where plans write what they cut their lineage with, and joins that no key can overload."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_leaves: set[str] = set()

#: Keys of more than one in so many rows are joined by broadcast: there are at most so many of them.
HEAVY = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, as in tests, a local master has one of its own.

    On a cluster without the setting this raises: a folder of one machine would lose the others' parts.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir is not set, and {master} is no local master: name a folder that all executors share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tracewright-")
    return _own[app]


def app_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, which the driver's JVM removes when it ends."""
    path = f"{shared_dir(spark)}/tracewright-{spark.sparkContext.applicationId}"
    if path not in _leaves:
        _leaves.add(path)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)  # only what exists is marked
        files.deleteOnExit(folder)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read from there: a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by written() that nothing will read again."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def once(column: Column) -> Column:
    """column, which Spark then computes once for a row.

    Else a filter on what is made from it moves down and takes copies of it along, also into lambdas, where it is computed for every element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def join_counted(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """rows with per_key's columns, without n; per_key: one row for each key, n the number of rows that have it.

    Keys of over one in HEAVY rows, however common, are broadcast, at most HEAVY rows; all others meet by a shuffle, in which no key is large.
    Both are read twice, so pass tables.  how: inner or left.
    """
    total = per_key.agg(F.sum(n)).first()[0] or 0 if total is None else total
    bound = max(total // HEAVY, HEAVY)
    heavy = per_key.where(F.col(n) > bound)
    rest = per_key.where(F.col(n) <= bound).drop(n)
    if not heavy.head(1):
        return rows.join(rest.hint("shuffle_merge"), keys, how)
    names = [c for c in per_key.columns if c not in (*keys, n)]
    packed = F.broadcast(heavy.select(*keys, F.struct(F.lit(True).alias("__is"), *names).alias("__heavy")))
    marked = rows.join(packed, keys, "left")
    common = marked.where("__heavy is not null").select(*rows.columns, *[F.col("__heavy")[c].alias(c) for c in names])
    others = marked.where("__heavy is null").drop("__heavy").join(rest.hint("shuffle_merge"), keys, how)
    return common.unionByName(others.select(*common.columns))
