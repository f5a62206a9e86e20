"""What the operators of this package share: registry, inputs, stored intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldseq.sources.tables import scratch_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A word: anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Computed once into the shared folder of the cluster and read back."""
    return written(df, name)


def kept_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `stored`, with the folder, for tables that are dropped once the next one is written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/fieldseq-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def n_words(text: Column | str) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """At most `k` rows of each group, by the order of a hash of `key`: the same ones every time.

    Groups are thinned to about 8k rows by the hash alone before they are ordered, so a
    group of any size reaches its task small.
    """
    sizes = stored(rows.groupBy(group).agg(F.count("*").alias("_n")), "group_sizes")
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows.join(sizes, group).filter(place <= F.lit(8.0 * k) / F.col("_n"))
    order = Window.partitionBy(group).orderBy(F.xxhash64(key), key)
    return (near.withColumn("_at", F.row_number().over(order))
            .filter(F.col("_at") <= k).drop("_at", "_n"))
