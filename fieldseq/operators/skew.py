"""Building blocks that keep hot groups and hot keys spread over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldseq.spec import ORDER_CHUNK

SPREAD = 64


def order_chunk(order: Column, width: int = ORDER_CHUNK) -> Column:
    """Range of the order column a row falls in: at most `width` values per range."""
    return F.floor(order / F.lit(width)).cast("bigint")


def lead_within(df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str],
                width: int = ORDER_CHUNK, keep: Column | None = None) -> DataFrame:
    """Add, for each row, values of the next row of its group.

    `columns` maps a source column to the name of its led copy. Groups are cut
    into order ranges, so a group holding a third of the table is sorted by many
    tasks; only the first row of each range is carried over to the range before.
    With `keep`, rows failing it stay in the result but are not led to or from.
    """
    sources = list(columns)
    led = list(columns.values())
    cut = df.withColumn("_chunk", order_chunk(F.col(order), width))
    extra: list[Column] = []
    if keep is not None:
        cut = cut.withColumn("_keep", F.coalesce(keep, F.lit(False)))
        extra = [F.col("_keep")]
    inside = Window.partitionBy(*keys, "_chunk", *extra).orderBy(order)
    values = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(sources)])
    stepped = cut.withColumn("_next", F.lead(values).over(inside))

    heads = cut.filter(F.col("_keep")) if keep is not None else cut
    heads = heads.groupBy(*keys, "_chunk").agg(F.min_by(values, F.col(order)).alias("_head"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    heads = heads.select(*keys, "_chunk", F.lead("_head").over(across).alias("_over"))
    heads = heads.filter(F.col("_over").isNotNull())

    joined = stepped.join(heads, [*keys, "_chunk"], "left")
    nxt = F.coalesce(F.col("_next"), F.col("_over"))
    if keep is not None:
        nxt = F.when(F.col("_keep"), nxt)
    return (joined
            .withColumn("_step", nxt)
            .withColumns({name: F.col("_step")[f"v{i}"] for i, name in enumerate(led)})
            .drop("_chunk", "_next", "_over", "_step", "_keep"))


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name.

    Spark 4.1 may take a union of equally partitioned parts as partitioned itself,
    and fails ("Can't zip RDDs with unequal numbers of partitions") when a part is
    re-planned at run time. The session is told not to; the next grouping then
    places the rows by its own keys.
    """
    parts[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank") -> DataFrame:
    """First k rows of each group with a 0-based rank.

    Spark prunes each task to k rows per group before the shuffle
    (WindowGroupLimit), so a group of any size reaches its task already small.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn("_place", F.row_number().over(w))
            .filter(F.col("_place") <= k)
            .withColumn(rank, (F.col("_place") - 1).cast("int"))
            .drop("_place"))


def spread_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], seed: Column,
                how: str = "inner", spread: int = SPREAD) -> DataFrame:
    """Join to a much smaller table on keys of which one may hold a large share of the rows.

    The small side is repeated `spread` times and rows of one key go to as many
    tasks. Spark still broadcasts the small side when its copies turn out to fit; they are
    a product with a range, because Spark estimates an exploded table as large as before.
    """
    cut = rows.withColumn("_spread", F.pmod(F.xxhash64(seed), F.lit(spread)).cast("int"))
    numbers = table.sparkSession.range(spread).select(F.col("id").cast("int").alias("_spread"))
    copies = table.crossJoin(F.broadcast(numbers))
    return cut.join(copies, [*keys, "_spread"], how).drop("_spread")


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, salt_seed: Column,
                  hot: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join `rows` to a table with unique keys, safe against hot keys.

    `hot` is the part of `table` with the frequent keys. It is bounded by
    counting (see the caller) and broadcast; rows with such a key get a spread,
    never-matching key for the shuffled join with the rest, so no task gets
    them all.
    """
    hot_cols = [F.col(c).alias(f"_hot_{c}") for c in columns]
    hot = hot.select(F.col(key).alias("_hot_key"), *hot_cols)
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(salt_seed), F.lit(4096)).cast("string"))
    rows = rows.withColumn("_join_key", F.when(F.col("_hot_key").isNull(), F.col(key))
                           .otherwise(spread))
    rest = table.select(F.col(key).alias("_join_key"),
                        *[F.col(c).alias(f"_cold_{c}") for c in columns])
    joined = rows.join(rest, "_join_key", "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(F.col(f"_hot_{c}"), F.col(f"_cold_{c}")))
    return joined.drop("_join_key", "_hot_key", *[f"_hot_{c}" for c in columns],
                       *[f"_cold_{c}" for c in columns])
