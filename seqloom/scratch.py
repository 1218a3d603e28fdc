"""Shared-folder materialisation and skew-safe joins used by the multi-stage operators."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or an own local one where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="seqloom-")
        atexit.register(shutil.rmtree, folder, True)
        _OWN[app] = "file://" + folder
    return _OWN[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and not a recomputation of every earlier stage. The rows are
    counted on the way (``rows_of``), which spares the joins below a count of tables too small to hold a hot key.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/seqloom-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rows = seen.get["n"]
    return out


def rows_of(df: DataFrame) -> int | None:
    """The number of rows of a table that ``materialize`` gave, else None."""
    return getattr(df, "_rows", None)


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a materialised table that is no longer needed."""
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/seqloom-" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot_rows: int = 200_000, at_most: int | None = None, hot: list | None = None) -> DataFrame:
    """Equi-join on ``key``, where ``right`` has each key once and ``left`` may hold most of its rows under a few keys.

    Keys with more than ``hot_rows`` rows on the left are joined against a broadcast of their own right rows; everything
    else is an ordinary shuffle join. Of the hot keys, at most ``rows / hot_rows``, the 10,000 largest are split off: any
    other one holds less than 1/10,000 of the rows, which is no skew.
    ``left`` is read twice and should be materialised or cheap. Null keys match nothing. ``at_most`` is an upper bound of the
    rows of ``left`` where it is known (a materialised table brings its own): up to ``hot_rows`` no key can be hot.
    ``hot`` are the keys to split off where the caller has counted them already.
    """
    if hot is None:
        hot = [r[0] for r in _hot(left, key, hot_rows, at_most)]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.where(~is_hot).join(right, key, how)
    warm = left.where(is_hot).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how)
    return cold.unionByName(warm)


def _hot(df: DataFrame, key: str, rows: int, at_most: int | None) -> list:
    """The keys with more than ``rows`` rows and their counts, the 10,000 largest at most."""
    known = rows_of(df) if at_most is None else at_most
    if known is not None and known <= rows:
        return []
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    return counts.orderBy(F.desc("_n"), key).limit(10_000).collect()


def spread_join(left: DataFrame, right: DataFrame, key: str, per: int = 100_000, at_most: int | None = None) -> DataFrame:
    """Inner equi-join on ``key`` where both sides may hold many rows under one key.

    A key with more than ``per`` rows on the right is cut by hash into chunks of about that size, and its left rows meet
    each chunk apart, so that no task holds a whole hot group. ``right`` is read twice. Null keys match nothing.
    ``at_most`` bounds the rows of ``right`` where that is known.
    """
    hot = _hot(right, key, per, at_most)
    if not hot:
        return left.join(right, key)
    spark, kind = right.sparkSession, right.schema[key].dataType.simpleString()
    cuts = F.broadcast(spark.createDataFrame([(r[0], math.ceil(r[1] / per)) for r in hot], f"`{key}` {kind}, _m int"))
    many = F.coalesce("_m", F.lit(1))
    a = left.join(cuts, key, "left").withColumn("_c", F.explode(F.sequence(F.lit(0), many - 1))).drop("_m")
    b = right.join(cuts, key, "left").withColumn("_c", F.pmod(F.xxhash64(*[F.col(c) for c in right.columns]), many).cast("int")).drop("_m")
    return a.join(b, [key, "_c"]).drop("_c")


def pairs_within(df: DataFrame, group: str, item: str, per: int = 1024, at_most: int | None = None) -> DataFrame:
    """Rows ``(group, a, b)``, a < b: the pairs of different items of every group; rows of ``df`` must be distinct.

    A group of more than ``per`` items is cut by hash into chunks, and each pair of its chunks is a join key of its own:
    no task ever pairs more than two chunks, however large the group. Null groups and items make no pair.
    """
    rows = df.select(F.col(group), F.col(item).alias("a")).where(F.col(group).isNotNull() & F.col("a").isNotNull())
    big = rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > per).select(group, F.ceil(F.col("_n") / per).cast("int").alias("_m"))
    cut = skew_join(rows, big, group, "left", at_most=rows_of(df) if at_most is None else at_most).withColumn("_m", F.coalesce("_m", F.lit(1))).withColumn("_c", F.pmod(F.xxhash64("a"), F.col("_m")).cast("int"))
    x = cut.select(group, "a", F.col("_c").alias("_x"), F.explode(F.sequence(F.col("_c"), F.col("_m") - 1)).alias("_y"))
    y = cut.select(group, F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_c"))).alias("_x"), F.col("_c").alias("_y"))
    met = x.join(y, [group, "_x", "_y"]).where((F.col("_x") < F.col("_y")) | (F.col("a") < F.col("b")))
    return met.select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
