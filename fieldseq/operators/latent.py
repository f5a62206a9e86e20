"""Dense vectors from the postings: truncated SVD by block power iteration.

The matrix is the postings table itself, one row per item, dealt to chunks of whole items. Each
round multiplies a block of directions by it and by its transpose, and makes the block orthonormal
again with a small matrix of inner products. A chunk meets only the directions of its own grams and
leaves one sum per gram, so what a round moves are numbered grams and weights, and two rows per
chunk and gram. Only matrices of rank by rank numbers pass the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from fieldseq.operators.skew import salted_lookup
from fieldseq.sources.tables import written

RANK, ROUNDS = 16, 8
# Postings that one chunk of items should hold.
CHUNK_ROWS = 2_000_000
# A gram counts as hot when it holds at least this share of all postings.
HOT_LIMIT = 20_000


@dataclass(frozen=True)
class Latent:
    """`grams(gram, v)`: orthonormal directions; `items(id, v)`: the items in them."""

    grams: DataFrame
    items: DataFrame
    singular: tuple[float, ...]
    explained: float


def _as_vector(rows: DataFrame, key: str, rank: int) -> DataFrame:
    return rows.select(key, F.array(*[F.col(f"s{i}") for i in range(rank)]).alias("v"))


def _chunk_product(items: pa.Table, directions: pa.Table, rank: int) -> tuple[np.ndarray, ...]:
    """(numbers of the grams, place of each posting among them, item of each, weights, items times directions)."""
    numbers = directions["number"].to_numpy()
    block = directions["v"].combine_chunks().flatten().to_numpy().reshape(-1, rank)
    order = np.argsort(numbers)
    numbers, block = numbers[order], block[order]
    grams = items["grams"].combine_chunks()
    place = np.searchsorted(numbers, grams.flatten().to_numpy())
    weights = items["weights"].combine_chunks().flatten().to_numpy()
    sizes = grams.value_lengths().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    found = np.stack([np.add.reduceat(weights * block[place, i], starts) for i in range(rank)], axis=1)
    return numbers, place, np.repeat(np.arange(len(sizes)), sizes), weights, found


def _columns(values: np.ndarray) -> dict[str, pa.Array]:
    return {f"s{i}": pa.array(np.ascontiguousarray(values[:, i])) for i in range(values.shape[1])}


def _sums(rank: int) -> list[StructField]:
    return [StructField(f"s{i}", DoubleType()) for i in range(rank)]


def inner_products(rows: DataFrame, rank: int) -> np.ndarray:
    """The rank by rank matrix of inner products of the columns of `v`."""
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
    sums = rows.agg(*[F.sum(F.get("v", F.lit(i)) * F.get("v", F.lit(j))).alias(f"p{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((rank, rank))
    for i, j in pairs:
        out[i, j] = out[j, i] = sums[f"p{i}_{j}"] or 0.0
    return out


def _times(rows: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """v times a small matrix."""
    columns = [sum((F.get("v", F.lit(k)) * float(matrix[k, i]) for k in range(len(matrix))), F.lit(0.0))
               for i in range(matrix.shape[1])]
    return rows.select(key, F.array(*columns).alias("v"))


def orthonormal(rows: DataFrame, key: str, rank: int, name: str) -> tuple[DataFrame, int]:
    """Columns made orthonormal, in two passes as rounding asks; fewer when they depend on each other."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(inner_products(rows, rank))
        order = [i for i in np.argsort(values)[::-1] if values[i] > max(values.max(), 0) * 1e-12]
        rank = len(order)
        rows = written(_times(rows, key, vectors[:, order] / np.sqrt(values[order])), name)
    return rows, rank


@dataclass(frozen=True)
class _Matrix:
    """`items(chunk, id, grams, weights)`, `needed(chunk, number)` and `names(number, gram)`."""

    items: DataFrame
    needed: DataFrame
    names: DataFrame
    item_id: str

    def _meet(self, directions: DataFrame, columns: list[str]):
        sent = self.needed.join(directions, "number").select("chunk", "number", "v")
        return self.items.select("chunk", *columns).groupby("chunk").cogroup(sent.groupby("chunk"))

    def through(self, directions: DataFrame, rank: int) -> DataFrame:
        """The directions times the matrix and its transpose, by number of the gram."""
        def product(items: pa.Table, own: pa.Table) -> pa.Table:
            numbers, place, item, weights, found = _chunk_product(items, own, rank)
            back = np.stack([np.bincount(place, weights * found[item, i], len(numbers)) for i in range(rank)], axis=1)
            return pa.table({"number": pa.array(numbers), **_columns(back)})

        schema = StructType([StructField("number", LongType()), *_sums(rank)])
        parts = self._meet(directions, ["grams", "weights"]).applyInArrow(product, schema)
        return _as_vector(parts.groupBy("number").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(rank)]),
                          "number", rank)

    def projected(self, directions: DataFrame, rank: int) -> DataFrame:
        """The items in the directions."""
        item_id = self.item_id

        def product(items: pa.Table, own: pa.Table) -> pa.Table:
            found = _chunk_product(items, own, rank)[-1]
            return pa.table({item_id: items[item_id], **_columns(found)})

        schema = StructType([self.items.schema[item_id], *_sums(rank)])
        rows = self._meet(directions, [item_id, "grams", "weights"]).applyInArrow(product, schema)
        return _as_vector(rows, item_id, rank)


def _matrix(postings: DataFrame, item_id: str, chunk_rows: int) -> _Matrix:
    """Grams numbered, postings gathered by item, and items dealt to chunks by the hash of their id."""
    counted = written(postings.groupBy("gram").agg(F.count("*").alias("df"))
                      .select(F.monotonically_increasing_id().alias("number"), "gram", "df"), "names")
    total = counted.agg(F.sum("df")).first()[0] or 0
    hot = counted.filter(F.col("df") * HOT_LIMIT >= total)
    known = salted_lookup(postings.select(item_id, "gram", "weight"), counted, "gram", F.col(item_id), hot, ["number"])
    entry = F.struct(F.col("number"), F.col("weight").cast("double").alias("weight"))
    gathered = known.groupBy(item_id).agg(F.collect_list(entry).alias("entries"))
    chunk = F.pmod(F.xxhash64(item_id), F.lit(max(1, -(-total // chunk_rows)))).alias("chunk")
    items = written(gathered.select(chunk, item_id, F.col("entries.number").alias("grams"),
                                    F.col("entries.weight").alias("weights")), "matrix")
    needed = written(items.select("chunk", F.explode("grams").alias("number")).distinct(), "needed")
    return _Matrix(items, needed, counted.select("number", "gram"), item_id)


def fit(postings: DataFrame, item_id: str = "uid", rank: int = RANK, rounds: int = ROUNDS,
        chunk_rows: int = CHUNK_ROWS) -> Latent:
    """Leading directions of (item, gram, weight). The start is a hash of the gram, so reruns agree.

    A chunk holds about `chunk_rows` postings of whole items, and a frequent gram at most one row per chunk.
    """
    matrix = _matrix(postings, item_id, chunk_rows)
    start = [(F.pmod(F.xxhash64("gram", F.lit(i)), F.lit(1 << 20)) / float(1 << 20) - 0.5).alias(f"s{i}") for i in range(rank)]
    grams = _as_vector(matrix.names.select("number", *start), "number", rank)
    grams, rank = orthonormal(written(grams, "start"), "number", rank, "directions")
    for _ in range(rounds):
        back = written(matrix.through(grams, rank), "back")
        grams, rank = orthonormal(back, "number", rank, "directions")
    items = written(matrix.projected(grams, rank), "items")
    values, turn = np.linalg.eigh(inner_products(items, rank))
    turn, values = turn[:, ::-1], np.maximum(values[::-1], 0.0)
    square = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w * w)
    total = matrix.items.agg(F.sum(square)).first()[0] or 1.0
    named = _times(grams, "number", turn).join(matrix.names, "number").select("gram", "v")
    return Latent(written(named, "grams"), written(_times(items, item_id, turn), "items"),
                  tuple(float(x) for x in np.sqrt(values)), float(values.sum() / total))
