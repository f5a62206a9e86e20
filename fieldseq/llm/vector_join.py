"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are sorted by the grid cells of their leading principal coordinates.
The sorted sequence is cut into blocks, blocks into intervals of 16, those again,
up to one interval per label. The join starts with every interval against itself
and descends: children whose boxes lie further apart than epsilon are skipped, at
the bottom two blocks are compared exactly. Coordinates are projections, which never
lengthen distances, so nothing within epsilon is skipped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldseq.llm.base import query, stored, table
from fieldseq.llm.components import components

AXES, BLOCK, FAN, FIT_ROWS = 8, 512, 16, 4096
_CLOSE = 1e-11


def _unpack(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray | None]]:
    for i, v in enumerate(rows["embedding"]):
        a = None if v is None else np.array(v, dtype=np.float64)
        good = a is not None and len(a) and np.isfinite(a).all() and a.any()
        yield i, (a if good else None)


def _usable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Content key and packed doubles of vectors that can link at all."""
    for rows in batches:
        keys, packed = [None] * len(rows), [None] * len(rows)
        for i, a in _unpack(rows):
            if a is not None and pd.notna(rows["label"].iloc[i]) and pd.notna(rows["vec_id"].iloc[i]):
                a = a / np.abs(a).max()
                packed[i] = (a / math.sqrt(float(a @ a))).tobytes()
                keys[i] = hashlib.blake2b(packed[i], digest_size=16).digest()
        yield pd.DataFrame({"vec_id": rows["vec_id"], "label": rows["label"], "key": keys,
                            "unit": packed}, dtype=object)


def principal_axes(vectors: DataFrame, axes: int = AXES, rows: int = FIT_ROWS) -> np.ndarray:
    """Leading principal directions (dimensions x axes) of a bounded sample, by key order.

    They only decide the order and how much is skipped, never what links.
    """
    sample = [np.frombuffer(r.unit) for r in vectors.orderBy("key").limit(rows)
              .select("unit").collect()]
    if not sample:
        return np.zeros((1, 1))
    dims = max(map(len, sample))
    m = np.zeros((len(sample), dims))
    for i, v in enumerate(sample):
        m[i, :len(v)] = v
    _, _, directions = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
    return directions[:axes].T.copy()


def _project(units: list[bytes], axes: np.ndarray) -> np.ndarray:
    m = np.zeros((len(units), axes.shape[0]))
    for i, u in enumerate(units):
        v = np.frombuffer(u)[:axes.shape[0]]
        m[i, :len(v)] = v
    return m @ axes


def _cells(axes: np.ndarray, epsilon: float):
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            place = _project(list(rows["unit"]), axes) if len(rows) else np.zeros((0, 1))
            rows = rows.assign(place=list(place), cell=list(np.floor(place / epsilon).astype(np.int64)))
            yield rows
    return apply


def _blocks(size: int):
    """Cut a sorted partition into blocks of one label and one length each."""
    def emit(rows: list, part: int, number: int) -> pd.DataFrame:
        place = np.array([r.place for r in rows])
        return pd.DataFrame({
            "label": [rows[0].label], "dims": [rows[0].dims], "part": [part], "number": [number],
            "low": [place.min(axis=0)], "high": [place.max(axis=0)],
            "reps": [np.array([r.rep for r in rows])], "copies": [np.array([r.n for r in rows])],
            "units": [b"".join(r.unit for r in rows)]})

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        part, number = 0, 0
        for rows in batches:
            for r in rows.itertuples(index=False):
                if held and (len(held) == size or (r.label, r.dims) != (held[0].label, held[0].dims)):
                    yield emit(held, part, number)
                    held, number = [], number + 1
                held.append(r)
                part = int(r.part)
        if held:
            yield emit(held, part, number)
    return apply


def descend(blocks: DataFrame, epsilon: float, axes: int, fan: int = FAN) -> DataFrame:
    """(a, b) codes of blocks whose boxes lie within epsilon, a <= b, by recursive descent."""
    low = [F.col("low")[i].alias(f"l{i}") for i in range(axes)]
    high = [F.col("high")[i].alias(f"h{i}") for i in range(axes)]
    level = stored(blocks.select("label", "dims", "code", *low, *high), "boxes")
    levels = [level]
    top = level.agg(F.max("code").alias("m")).first().m or 0
    while top:
        top //= fan
        level = level.groupBy("label", "dims", F.floor(F.col("code") / fan).alias("code")).agg(
            *[F.min(f"l{i}").alias(f"l{i}") for i in range(axes)],
            *[F.max(f"h{i}").alias(f"h{i}") for i in range(axes)])
        levels.append(level)
    pairs = levels[-1].select("label", "dims", F.col("code").alias("a"), F.col("code").alias("b"))
    bound = (epsilon + 1e-9) ** 2
    for below in reversed(levels[:-1]):
        parent = F.floor(F.col("code") / fan)
        side = {}
        for s in "ab":
            side[s] = below.select(
                "label", "dims", parent.alias(s), F.col("code").alias(f"{s}_"),
                F.array(*[F.col(f"l{i}") for i in range(axes)]).alias(f"{s}low"),
                F.array(*[F.col(f"h{i}") for i in range(axes)]).alias(f"{s}high"))
        met = pairs.join(side["a"], ["label", "dims", "a"]).join(side["b"], ["label", "dims", "b"])
        apart = sum((F.pow(F.greatest(F.lit(0.0), F.col("alow")[i] - F.col("bhigh")[i],
                                      F.col("blow")[i] - F.col("ahigh")[i]), 2)
                     for i in range(axes)), F.lit(0.0))
        pairs = stored(met.filter((F.col("a_") <= F.col("b_")) & (apart <= bound))
                       .select("label", "dims", F.col("a_").alias("a"), F.col("b_").alias("b")),
                       "interval_pairs")
    return pairs


def least_labels(mask: np.ndarray, ids: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id connected to each row and column of a link matrix."""
    big = np.iinfo(np.int64).max
    a, b = ids.copy(), other.copy()
    while True:
        b2 = np.minimum(b, np.where(mask, a[:, None], big).min(axis=0, initial=big))
        a2 = np.minimum(a, np.where(mask, b2[None, :], big).min(axis=1, initial=big))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def _links(least: float):
    """Compare the vectors of two blocks; per vector its copies-weighted links and a union edge."""
    def sides(row, s: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        reps = np.asarray(getattr(row, f"{s}_reps"), dtype=np.int64)
        return (np.frombuffer(getattr(row, f"{s}_units")).reshape(len(reps), -1), reps,
                np.asarray(getattr(row, f"{s}_copies"), dtype=np.int64))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                ua, ra, na = sides(row, "a")
                ub, rb, nb = sides(row, "b")
                cos = ua @ ub.T
                for i, j in np.argwhere(np.abs(cos - least) < _CLOSE):
                    cos[i, j] = math.fsum(ua[i] * ub[j])
                mask = cos >= least
                same = row.a == row.b
                if same:
                    np.fill_diagonal(mask, False)
                if not mask.any():
                    continue
                la, lb = least_labels(mask, ra, rb)
                out = [(ra, mask @ nb, la)] + ([] if same else [(rb, mask.T @ na, lb)])
                for ids, links, roots in out:
                    hit = links > 0
                    yield pd.DataFrame({"rep": ids[hit], "links": links[hit], "root": roots[hit]})
    return apply


def near_vectors(vectors: DataFrame, least: float = 0.98, axes: int = AXES, block: int = BLOCK
                 ) -> DataFrame:
    """Links of vectors of equal label with cosine of at least `least`, and their components.

    Returns vec_id, label, n_links, component_id, kept per input row. Null labels, and
    vectors that are null, empty, zero or not finite, link with nothing; lengths only
    link with themselves. Equal vectors are compared once and counted as often as they
    occur, also under one id. A null vec_id links with nothing and is its own component
    (component_id null, kept true). Other columns are ignored; an empty table gives no rows.
    """
    known = stored(vectors.select("vec_id", "label", "embedding").mapInPandas(
        _usable, "vec_id long, label long, key binary, unit binary"), "unit_vectors")
    reps = stored(known.filter("key is not null").groupBy("label", "key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("unit").alias("unit")),
        "distinct_vectors")
    epsilon = math.sqrt(2 - 2 * least)
    directions = principal_axes(reps, axes)
    axes = directions.shape[1]
    grid = reps.withColumn("dims", (F.octet_length("unit") / 8).cast("int")).mapInPandas(
        _cells(directions, epsilon), "label long, key binary, rep long, n long, unit binary, "
        "dims int, place array<double>, cell array<long>")
    order = ["label", "dims", "cell", "key"]
    cut = (grid.repartitionByRange(*order).sortWithinPartitions(*order)
           .withColumn("part", F.spark_partition_id()).drop("key", "cell")
           .mapInPandas(_blocks(block), "label long, dims int, part int, number int, "
                        "low array<double>, high array<double>, reps array<long>, "
                        "copies array<long>, units binary"))
    cut = stored(cut, "blocks")
    widest = (cut.agg(F.max("number").alias("m")).first().m or 0) + 1
    blocks = cut.withColumn("code", F.col("part").cast("long") * widest + F.col("number"))
    pairs = descend(blocks, epsilon, axes)
    side = {s: blocks.select(F.col("label"), F.col("dims"), F.col("code").alias(s),
                             *[F.col(c).alias(f"{s}_{c}") for c in ("reps", "copies", "units")])
            for s in "ab"}
    found = stored(pairs.join(side["a"], ["label", "dims", "a"]).join(side["b"], ["label", "dims", "b"])
                   .mapInPandas(_links(least), "rep long, links long, root long"), "vector_links")
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    degrees = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = (reps.select("label", "key", "rep", "n").join(degrees, "rep", "left")
              .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
              .select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                      F.coalesce("root", "rep").alias("component_id")))
    out = known.select("vec_id", "label", "key").join(groups, ["label", "key"], "left")
    return out.select("vec_id", "label", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id")
                      ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op1_vector_near_duplicates", """
  with recursive v as (
    select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
  u as (
    select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v
    where label is not null and len(e) > 0 and list_bool_and(list_transform(e, lambda x: isfinite(x)))),
  links as materialized (
    select a.vec_id as a, b.vec_id as b from u a join u b
      on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
    where a.norm > 0 and b.norm > 0 and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
  reach as (
    select vec_id as a, vec_id as b from v
    union
    select r.a, l.b from reach r join links l on r.b = l.a),
  comp as (select a as vec_id, min(b) as component_id from reach group by 1),
  deg as (select a as vec_id, count(*) as n_links from links group by 1)
  select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
  from comp left join deg using (vec_id)""")
def op1_vector_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "n_links", "component_id", "kept")
