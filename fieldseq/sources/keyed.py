"""Partitioned tables with an index from key to partition.

The index is a table of its own, cut into buckets by a hash of the key. An update reads the
buckets of its keys, learns which partitions hold them, and rewrites those and the ones its
rows go to: a row that moves leaves its old partition. Lookups read needed partitions only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseq.operators.skew import stacked
from fieldseq.sources.readers import latest
from fieldseq.sources.tables import _exists, written

BUCKETS = 256
#: Partitions that may be named in a filter; more are found by a join.
NAMED = 1_000


def _paths(path: str) -> tuple[str, str]:
    return f"{path}/rows", f"{path}/keys"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _only(table: DataFrame, places: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of the given partitions; the filter reaches the scan when they are few."""
    few = places.limit(NAMED + 1).collect()
    if len(few) > NAMED:
        return table.join(places, list(columns), "left_semi")
    same = [reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(r[c])) for c in columns]) for r in few]
    return table.filter(reduce(Column.__or__, same, F.lit(False)))


def _of_keys(spark: SparkSession, path: str, keys: Sequence[str], wanted: DataFrame, buckets: int) -> DataFrame:
    """Index rows of the wanted keys; only their buckets are read."""
    named = wanted.select(*keys).distinct().withColumn("bucket", _bucket(keys, buckets))
    numbers = [r.bucket for r in named.select("bucket").distinct().collect()]
    index = spark.read.parquet(_paths(path)[1]).filter(F.col("bucket").isin(numbers))
    return index.join(named, [*keys, "bucket"], "left_semi")


def lookup(spark: SparkSession, path: str, keys: Sequence[str], partition_by: Sequence[str],
           wanted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Stored rows of the wanted keys."""
    at = _of_keys(spark, path, keys, wanted, buckets).select(*partition_by).distinct()
    rows = _only(spark.read.parquet(_paths(path)[0]), at, partition_by)
    return rows.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_paths(path)[0])


def upsert(new: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str],
           version: Column | None = None, keep: Mapping[str, str] | None = None, buckets: int = BUCKETS) -> None:
    """Insert rows, replacing stored ones with the same key wherever they are.

    Rows are written first, then partitions that are left without rows are removed, then the
    index. A job that dies in between is repaired by running it again: until the index is
    written, it still names the old partitions, which are then cleaned. `keep` maps columns
    whose stored value survives an update to a default for new keys. Key and partition
    columns must not be null. `buckets` must stay the same for a table.
    """
    spark, (rows_path, index_path) = new.sparkSession, _paths(path)
    columns = list(partition_by)
    fresh = latest(new, list(keys), version) if version is not None else new.dropDuplicates(list(keys))
    fresh = written(fresh, "fresh")
    gone: list = []
    result = fresh
    if _exists(spark, rows_path):
        stored = spark.read.parquet(rows_path)
        old = written(_of_keys(spark, path, keys, fresh, buckets).select(*columns).distinct(), "places")
        places = written(stacked([old, fresh.select(*columns)]).distinct(), "places")
        nearby = _only(stored, places, columns)
        if keep:
            before = nearby.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
            result = result.join(before, list(keys), "left")
            for c in keep:
                result = result.withColumn(c, F.coalesce(f"_old_{c}", c)).drop(f"_old_{c}")
        left = nearby.join(fresh.select(*keys), list(keys), "left_anti")
        result = written(stacked([result.select(*fresh.columns), left.select(*fresh.columns)]), "rows")
        gone = old.join(result.select(*columns).distinct(), columns, "left_anti").collect()
    _write(result, rows_path, columns)
    for r in gone:
        _remove(spark, rows_path, [(c, r[c]) for c in columns])
    entries = fresh.select(*keys, *columns).withColumn("bucket", _bucket(keys, buckets))
    if _exists(spark, index_path):
        touched = entries.select("bucket").distinct()
        other = _only(spark.read.parquet(index_path), touched, ["bucket"]).join(
            entries.select(*keys), list(keys), "left_anti")
        entries = written(stacked([entries, other.select(*entries.columns)]), "keys")
    _write(entries, index_path, ["bucket"])


def _write(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    (rows.hint("rebalance", *[F.col(c) for c in columns]).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path))


def _remove(spark: SparkSession, path: str, place: Sequence[tuple[str, object]]) -> None:
    """Delete the files of one partition."""
    files = spark.read.parquet(path).filter(reduce(
        Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in place])).select("_metadata.file_path").distinct()
    names = [r.file_path for r in files.collect()]
    for name in names:
        target = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, False)
