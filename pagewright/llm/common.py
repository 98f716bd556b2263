"""What the operators of this subpackage share: tables, scratch space in the shared folder, exact
distributed ranks and prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
import weakref
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

_HELD: dict[str, object] = {}
_LAST: list[str] = []


def hold(name: str, clear) -> None:
    """Called in a worker before it fills the memory called `name`: workers serve several operators one after the
    other, so what others have remembered is cleared and handed back to the system."""
    _HELD.setdefault(name, clear)
    for other, forget in _HELD.items():
        if other != name:
            forget()
    if _LAST and _LAST[0] != name:
        release()
    _LAST[:] = [name]


def release() -> None:
    """Hands a process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch at most: texts can be long, and a batch is held several times on its way.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to these bounds; each task holds only a few batches of texts."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset in a session of one machine (as in tests) a folder of our own is set; on a cluster, whose
    executors would not see it, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session is gone: the folder's owner cleans up
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/pagewright/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


#: Paths of the tables that `stored` has written, by their DataFrames.
_STORED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str, *over: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: cuts lineage and survives lost executors. over: earlier results of
    `stored` that nothing needs once this one is written."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED[out] = path
    forget(*over)
    return out


def forget(*over: DataFrame) -> None:
    """Deletes tables that `stored` has written and nothing will read again."""
    for df in over:
        if path := _STORED.pop(df, None):
            _remove(df.sparkSession, path)


#: Of all rows, a key's share from which it is heavy; fewer keys than that are.
HEAVY = 1000


def join_counted(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int, how: str = "left") -> DataFrame:
    """rows joined (left or inner) to groups (key, n, ...: a row for each key, n of the `total` rows having it), without
    `key` of groups.

    Keys of more than 1/HEAVY of all rows, of which there are fewer than HEAVY, come to the driver and go into the plan
    as a literal; their rows and those of null keys aren't shuffled, so no key's rows meet in one task. Names in
    groups other than `key` are to be new to rows.
    """
    more, of = [c for c in groups.columns if c != key], F.col(f"`{key}`")
    own = free_name(rows, "heavy_key")
    entry = StructType([StructField("k", groups.schema[key].dataType), StructField("v", StructType([groups.schema[c] for c in more]))])
    few = groups.where(F.col(n) * HEAVY > total).select(of.alias("k"), F.struct(*more).alias("v"))
    heavy = few.select("k", F.to_json(F.struct("k", "v")).alias("entry")).collect()  # fewer than HEAVY rows
    known = rows.where(of.isNotNull())
    rest = groups.select(of.alias(own), *more)
    parts = []
    if heavy:
        some = of.isin([r["k"] for r in heavy])
        entries = F.from_json(F.lit("[" + ",".join(r["entry"] for r in heavy) + "]"), ArrayType(entry))
        found = F.element_at(F.map_from_entries(entries), of)
        parts.append(known.where(some).select("*", found.alias(own)).select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col(f"{own}.`{c}`").alias(c) for c in more)))
        known = known.where(~some)
        rest = rest.where(~F.col(own).isin([r["k"] for r in heavy]))
    parts.append(known.join(rest, of == F.col(own), how).drop(own))
    if how == "left":
        parts.append(rows.where(of.isNull()).select("*", *(F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in more)))
    return reduce(DataFrame.unionByName, parts)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for each row, however often body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ordered(df: DataFrame, order: list[str], sums: dict[str, str] | None = None) -> DataFrame:
    """df with `rank` (long, from 0, over all rows by `order`) and, for each out: column of `sums`,
    the sum of that column over all rows before (long).

    Exact and distributed: range partitions, a rank inside each, and the totals of the partitions
    (as many rows as partitions) summed up. `order` should make the rows distinct, as equal keys
    can't be split over range partitions.
    """
    spark, sums = df.sparkSession, sums or {}
    n = partitions(spark)
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in order]
    dealt = df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id())
    here = W.partitionBy("__part").orderBy(*keys)
    before = here.rowsBetween(W.unboundedPreceding, -1)
    local = stored(
        dealt.select(
            "*",
            (F.row_number().over(here) - F.lit(1)).cast("long").alias("__rank"),
            *(F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(f"__{k}") for k, c in sums.items()),
        ),
        "ordered",
    )
    totals = local.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(c).alias(f"__t_{k}") for k, c in sums.items()))
    parts = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # as many rows as partitions
    offsets = totals.select(
        F.col("__part").alias("__p"),
        F.coalesce(F.sum("__n").over(parts), F.lit(0)).alias("__rows_before"),
        *(F.coalesce(F.sum(f"__t_{k}").over(parts), F.lit(0)).alias(f"__b_{k}") for k in sums),
    )
    return (
        local.join(F.broadcast(offsets), local["__part"] == offsets["__p"])  # at most a row for each partition
        .select(
            *(local[c] for c in df.columns),
            (F.col("__rank") + F.col("__rows_before")).cast("long").alias("rank"),
            *((F.col(f"__{k}") + F.col(f"__b_{k}")).cast("long").alias(k) for k in sums),
        )
    )
