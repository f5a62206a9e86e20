"""Table sinks: keyed upsert, subset export, prediction and metadata files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldseq.operators.skew import stacked
from fieldseq.sources.readers import latest

_CHECKPOINT = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}  # application id to the folder of a local session


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in `spark.checkpoint.dir`. Only a local session without
    that setting gets a temporary folder of its own.
    """
    named = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT} to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="fieldseq-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    For results several branches of a job read: they are computed once, survive
    lost executors, and keep column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/fieldseq-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def upsert(new: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str],
           version: Column | None = None, keep: Mapping[str, str] | None = None) -> None:
    """Insert rows, replacing stored ones with the same key.

    Only partitions that receive rows are rewritten, and the file commit swaps
    them in as a whole, so a job that dies leaves the table as it was. A key stays in
    its partition; one that would move is an error, and nothing is written. `keep` maps columns whose stored value
    survives an update to a default for new keys.
    """
    spark = new.sparkSession
    fresh = latest(new, list(keys), version) if version is not None \
        else new.dropDuplicates(list(keys))
    if _exists(spark, path):
        stored = spark.read.parquet(path)
        places = [F.col(c).alias(f"_at_{c}") for c in partition_by]
        moved = (stored.select(*keys, *places).join(fresh.select(*keys, *partition_by), list(keys))
                 .filter(~F.expr(" and ".join(f"`_at_{c}` <=> `{c}`" for c in partition_by))))
        if partition_by and not moved.isEmpty():
            raise ValueError("a key would move to another partition; delete its old row first")
        touched = fresh.select(*partition_by).distinct()
        nearby = stored.join(touched, list(partition_by), "left_semi")
        if keep:
            old = nearby.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
            fresh = fresh.join(old, list(keys), "left")
            for c in keep:
                fresh = fresh.withColumn(c, F.coalesce(f"_old_{c}", c)).drop(f"_old_{c}")
        left = nearby.join(fresh.select(*keys), list(keys), "left_anti")
        fresh = stacked([fresh, left.select(*fresh.columns)])
    (fresh.hint("rebalance", *[F.col(c) for c in partition_by])
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def upsert_possessions(new: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Upsert by uid; a rebuilt possession loses its vector until it is computed again."""
    upsert(new.withColumn("embedding", F.lit(None).cast("array<float>")), path, ["uid"],
           partition_by)


def most_recent(matches: DataFrame, n: int | None) -> DataFrame:
    """Ids of the n latest matches, undated ones last; all when n is None."""
    if n is None:
        return matches.select("match_id")
    return matches.orderBy(F.desc_nulls_last("match_date"), "match_id").limit(n).select("match_id")


def subset(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids, "match_id", "left_semi")


def export(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], path: str,
           ids: DataFrame | None = None) -> None:
    """Replace each target table by the named columns of its (restricted) source."""
    for name, (table, columns) in tables.items():
        part = table if ids is None else subset(table, ids)
        part.select(*columns).write.mode("overwrite").parquet(f"{path}/{name}")


def export_sizes(tables: Mapping[str, DataFrame], ids: DataFrame | None = None) -> DataFrame:
    """Rows each table would export, and their total (table name null)."""
    parts = [(table if ids is None else subset(table, ids)).select(F.lit(name).alias("table"))
             for name, table in tables.items()]
    return stacked(parts).rollup("table").agg(F.count("*").alias("n"))


def write_predictions(preds: DataFrame, path: str) -> None:
    preds.write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    schema = ("event_id string, `group` string, is_goal int, p_base double, p_mine double, "
              "p_ref double, distance double, shot_type string, has_freeze_frame boolean")
    return spark.read.schema(schema).option("header", True).csv(path)


def write_split(spark: SparkSession, path: str, test_groups: Sequence[str],
                train_groups: Sequence[str], n_train: int, n_test: int, calibration: str) -> None:
    """One-row metadata of a train/test split."""
    row = [(list(test_groups), list(train_groups), n_train, n_test, calibration)]
    (spark.createDataFrame(row, "test_groups array<string>, train_groups array<string>, "
                                "n_train long, n_test long, calibration string")
     .coalesce(1).write.mode("overwrite").json(path))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def label_table(spark: SparkSession, nested: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """(qid, uid, label) from a mapping qid -> uid -> 0/1."""
    rows = [(q, u, v) for q, items in nested.items() for u, v in items.items()]
    return spark.createDataFrame(rows, "qid string, uid string, label int")


def audit_table(spark: SparkSession, flat: Mapping[str, int]) -> DataFrame:
    """(qid, uid, human) from a mapping 'qid|uid' -> 0/1."""
    rows = [(*key.split("|", 1), v) for key, v in flat.items()]
    return spark.createDataFrame(rows, "qid string, uid string, human int")
