"""TF-IDF of the grams that a bounded set of queries asks for, over all documents.

A weight depends on every gram of its document: on its count, and on how many documents hold
it. Documents are packed once, in batches of about `PART_BYTES` of words, as codes of words.
A batch leaves each of its grams once, as a 64-bit hash in sorted blocks of bytes, one block
per range of hashes. Ranges add up the blocks of all batches and give back, in the order of
the block, in how many documents each gram occurs. A batch then knows the length of its
documents, and weighs or ranks what the queries ask for where it lies. So no row is ever
made of a gram, and a frequent gram counts once per batch, not per document.
"""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldseq.operators import dense
from fieldseq.sources.tables import written

# Bytes of words in a batch; they have some 400,000 grams a megabyte.
PART_BYTES = 4 << 20
# Grams, of all batches together, that one range of hashes may hold.
RANGE_GRAMS = 2_000_000
# Scores of a batch held at a time (8 bytes each).
SCORE_CELLS = 4_000_000
SCORE_DIGITS = dense.SCORE_DIGITS

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BLOCKS = "part int, batch long, grams binary, docs binary"
_FOUND = "part int, batch long, df binary"


@dataclass(frozen=True)
class Asked:
    """Grams of the query texts. A gram is the number of the gram without its last word, and that word.

    `keys[n]` are the sorted grams of n + 2 words; gram i of them has number `base[n] + i`.
    """

    numbers: dict[str, int]
    keys: tuple[np.ndarray, ...]
    base: tuple[int, ...]
    texts: list[str]

    @staticmethod
    def of(texts: list[list[str]], longest: int) -> Asked:
        words = sorted({w for t in texts for w in t})
        numbers = {w: i for i, w in enumerate(words)}
        names, keys, base = list(words), [], []
        runs = [[(i, numbers[w]) for i, w in enumerate(t)] for t in texts]
        for n in range(2, longest + 1):
            runs = [[(at, number * len(words) + numbers[t[at + n - 1]]) for at, number in run if at + n <= len(t)]
                    for t, run in zip(texts, runs, strict=True)]
            known = np.unique(np.array([k for run in runs for _, k in run], np.int64))
            base.append(len(names))
            keys.append(known)
            names += [f"{names[k // len(words)]} {words[k % len(words)]}" for k in known.tolist()]
            at_key = {k: base[-1] + i for i, k in enumerate(known.tolist())}
            runs = [[(at, at_key[k]) for at, k in run] for run in runs]
        return Asked(numbers, tuple(keys), tuple(base), names)

    def found(self, words: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, gram numbers) for each length; `words` are numbers of asked words or -1."""
        at = np.flatnonzero(words >= 0)
        number = words[at].astype(np.int64)
        yield at, number
        for n, (known, base) in enumerate(zip(self.keys, self.base, strict=True), start=1):
            inside = at + n < len(words)
            at, number = at[inside], number[inside]
            follows = (row[at] == row[at + n]) & (words[at + n] >= 0)
            at, number = at[follows], number[follows]
            key = number * len(self.numbers) + words[at + n]
            place = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            hit = known[place] == key if len(known) else np.zeros(len(key), bool)
            at, number = at[hit], place[hit] + base
            yield at, number


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass(frozen=True)
class Batch:
    """Documents of a batch: hash and asked number of each word in turn, its row and its document."""

    hashes: np.ndarray
    asked: np.ndarray
    row: np.ndarray
    doc: np.ndarray
    n_docs: int

    @staticmethod
    def of(packed: dict) -> Batch:
        size = np.frombuffer(packed["sizes"], np.int32)
        codes = _codes(packed["codes"])
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        doc = np.frombuffer(packed["docs"], np.int32)
        asked = np.frombuffer(zlib.decompress(packed["asked"]), np.int32)
        return Batch(np.frombuffer(packed["hashes"], np.uint64)[codes], asked[codes],
                     row, doc[row], int(doc[-1]) + 1 if len(doc) else 0)

    def grams(self, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, hash, tf) of every gram of every document, ordered by document and hash."""
        runs, docs = [_mixed(self.hashes)], [self.doc]
        kept = np.arange(len(self.hashes))
        for n in range(1, longest):
            inside = kept + n < len(self.row)
            inside[inside] = self.row[kept[inside]] == self.row[kept[inside] + n]
            kept = kept[inside]
            runs.append(_mixed(runs[-1][inside] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[kept + n]))
            docs.append(self.doc[kept])
        cuts = [np.searchsorted(d, np.arange(self.n_docs + 1)) for d in docs]
        starts = np.sum(cuts, axis=0)
        out = np.empty(starts[-1], np.uint64)
        for i in range(self.n_docs):
            of_doc = out[starts[i]:starts[i + 1]]
            np.concatenate([run[cut[i]:cut[i + 1]] for run, cut in zip(runs, cuts, strict=True)], out=of_doc)
            of_doc.sort()
        del runs, docs, kept
        doc = np.repeat(np.arange(self.n_docs, dtype=np.int32), np.diff(starts))
        first = np.ones(len(out), bool)
        first[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        return doc[at], out[at], np.diff(at, append=len(out))

    def wanted(self, asked: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, gram number, tf) of the asked grams, ordered by document and gram."""
        n = max(len(asked.texts), 1)
        keys = [self.doc[at].astype(np.int64) * n + number for at, number in asked.found(self.asked, self.row)]
        key, tf = np.unique(np.concatenate(keys), return_counts=True)
        return key // n, key % n, tf


def _steps(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(first)
    return at, np.diff(at, append=len(ordered))


def _squeezed(ordered: np.ndarray) -> bytes:
    """Rising 64-bit numbers as steps of 48 bits, or as they are when one is further."""
    apart = np.diff(ordered)
    if not len(apart) or apart.max() >> np.uint64(48):
        return b"\0" + ordered.tobytes()
    return (b"\1" + ordered[:1].tobytes() + apart.astype(np.uint32).tobytes()
            + (apart >> np.uint64(32)).astype(np.uint16).tobytes())


def _unsqueezed(block: bytes) -> np.ndarray:
    if block[0] == 0:
        return np.frombuffer(block, np.uint64, offset=1)
    n = (len(block) - 9) // 6
    out = np.empty(n + 1, np.uint64)
    out[:1] = np.frombuffer(block, np.uint64, 1, 1)
    out[1:] = np.frombuffer(block, np.uint16, n, 9 + 4 * n)
    out[1:] <<= np.uint64(32)
    out[1:] |= np.frombuffer(block, np.uint32, n, 9)
    return np.cumsum(out, out=out)


def _few_bits(counts: np.ndarray) -> bytes:
    """Counts of which most are small."""
    return zlib.compress(np.int32(len(counts)).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()
                         + counts[counts >= 255].astype(np.int32).tobytes(), 1)


def _counts(packed: bytes) -> np.ndarray:
    held = zlib.decompress(packed)
    n = int(np.frombuffer(held, np.int32, 1)[0])
    out = np.frombuffer(held, np.uint8, n, 4).astype(np.int32)
    out[out == 255] = np.frombuffer(held, np.int32, offset=4 + n)
    return out


def _planes(codes: np.ndarray) -> bytes:
    """Codes of which small ones are the most frequent, as three planes of bytes."""
    press = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    planes = [press.compress((codes >> shift).astype(np.uint8).tobytes()) for shift in (0, 8, 16)]
    return b"".join([*planes, press.flush()])


def _codes(packed: bytes) -> np.ndarray:
    low, middle, high = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(3, -1)
    out = high.astype(np.int32)
    for plane in (middle, low):
        out <<= 8
        out |= plane
    return out


def _table(schema: pa.Schema, columns: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
                                 for c, f in zip(columns, schema, strict=True)], schema=schema)


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """What is shuffled meanwhile leaves the disk when its job ends, not when the driver collects garbage."""
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP, before)


class AskedIndex:
    """What queries with at most `sparse.BROADCAST_ROWS` grams need to know of all documents."""

    def __init__(self, docs: DataFrame, id_col: str, words: Column, queries: DataFrame, asked_words: Column,
                 min_df: int, longest: int, size: Column | None = None):
        """`size`: bytes of the words of a row, or more; without it they are counted word by word."""
        self.spark, self.id_col, self.longest, self.min_df = docs.sparkSession, id_col, longest, min_df
        self.id_type = docs.schema[id_col].dataType
        texts = [r[0] for r in queries.select(asked_words).collect() if r[0]]
        self.asked = Asked.of(texts, longest)
        self._shared = self.spark.sparkContext.broadcast(self.asked)
        if size is None:
            size = F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 1)
        self.n_docs, held = docs.agg(F.count("*"), F.sum(size)).first()
        self.parts = max(self.spark.sparkContext.defaultParallelism, -(-(held or 0) // PART_BYTES))
        with _cleaned(self.spark):
            self.packed = written(self._pack(docs, words), "packed")
        n_words = self.packed.agg(F.sum("n")).first()[0] or 0
        self.ranges = max(1, -(-n_words * longest // RANGE_GRAMS))
        self.vocab = self._vocab()

    def _pack(self, docs: DataFrame, words: Column) -> DataFrame:
        """One row per batch. Rows of one document lie in one batch, in the order of ids."""
        shared, id_type = self._shared, self.id_type
        kind = T.StructType([T.StructField("batch", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
                             *[T.StructField(c, T.BinaryType()) for c in ("sizes", "docs", "hashes", "asked", "codes")],
                             T.StructField("n", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = list(batches)
            if not sum(len(b) for b in table):
                return
            table = pa.Table.from_batches(table).combine_chunks()
            ids, lists = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
            coded = lists.flatten().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            if len(coded.dictionary) > 1 << 24:
                raise ValueError("a batch holds more than 2^24 different words")
            order = np.argsort(-np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            names = coded.dictionary.take(pa.array(order)).to_pylist()
            numbers = shared.value.numbers
            own = ids.to_pylist()
            new = np.array([i > 0 and own[i] != own[i - 1] for i in range(len(own))])
            cut = np.flatnonzero(np.concatenate([[True], new[1:]]))
            out = {"batch": TaskContext.get().partitionId(), "ids": ids.take(pa.array(cut)).to_pylist(),
                   "sizes": sizes.tobytes(), "docs": np.cumsum(new).astype(np.int32).tobytes(),
                   "hashes": pd.util.hash_array(np.array([*names, None], object)[:-1], categorize=False).tobytes(),
                   "asked": zlib.compress(np.array([numbers.get(w, -1) for w in names], np.int32).tobytes(), 1),
                   "codes": _planes(place[codes]), "n": int(sizes.sum())}
            yield pa.RecordBatch.from_pylist([out], schema=packed)

        from pyspark.sql.pandas.types import to_arrow_schema
        packed = to_arrow_schema(kind)
        placed = docs.repartition(int(self.parts), self.id_col).sortWithinPartitions(self.id_col)
        return placed.select(self.id_col, words.alias("_words")).mapInArrow(run, kind)

    def _vocab(self) -> pd.DataFrame:
        """(gram, number, df) of the asked grams that occur."""
        shared = self._shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(shared.value.texts), np.int64)
            for b in batches:
                for row in b.to_pylist():
                    number = Batch.of(row).wanted(shared.value)[1]
                    df += np.bincount(number, minlength=len(df))
            held = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["number", "df"])

        found = (self.packed.mapInArrow(run, "number long, df long")
                 .groupBy("number").agg(F.sum("df").alias("df")).toPandas().sort_values("number"))
        found.insert(0, "gram", [self.asked.texts[i] for i in found["number"]])
        return found

    def _frequency(self) -> DataFrame:
        """(part, batch, df): for each block of a batch, the frequency of its grams in their order."""
        longest, ranges = self.longest, int(self.ranges)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edges = np.array([(p << 64) // ranges for p in range(1, ranges)], np.uint64)
            for b in batches:
                for row in b.to_pylist():
                    grams = np.sort(Batch.of(row).grams(longest)[1])
                    at, n = _steps(grams)
                    grams, n = grams[at], n.astype(np.int32)
                    ends = [0, *np.searchsorted(grams, edges).tolist(), len(grams)]
                    held = [p for p in range(ranges) if ends[p] < ends[p + 1]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(held, pa.int32()), pa.array([row["batch"]] * len(held), pa.int64()),
                        pa.array([_squeezed(grams[ends[p]:ends[p + 1]]) for p in held], pa.binary()),
                        pa.array([_few_bits(n[ends[p]:ends[p + 1]]) for p in held], pa.binary())],
                        names=["part", "batch", "grams", "docs"])

        def add(table: pa.Table) -> pa.Table:
            blocks = [_unsqueezed(b) for b in table["grams"].to_pylist()]
            n = np.concatenate([_counts(b) for b in table["docs"].to_pylist()])
            grams = np.concatenate(blocks)
            order = np.argsort(grams)
            at, long = _steps(grams[order])
            df = np.empty(len(grams), np.int32)
            df[order] = np.repeat(np.add.reduceat(n[order], at), long)
            ends = np.cumsum([len(b) for b in blocks])
            del grams, order, n
            return pa.table({"part": table["part"], "batch": table["batch"],
                             "df": pa.array([_few_bits(d) for d in np.split(df, ends[:-1])], pa.binary())})

        blocks = self.packed.mapInArrow(cut, _BLOCKS).repartition(ranges, "part")
        return blocks.groupBy("part").applyInArrow(add, _FOUND)

    def _met(self, schema: T.StructType, give: Callable) -> DataFrame:
        """What `give(ids, documents, gram numbers, tf, weights)` makes of the asked grams of each batch."""
        from pyspark.sql.pandas.types import to_arrow_schema
        kind, longest, min_df, n_docs, shared = to_arrow_schema(schema), self.longest, self.min_df, self.n_docs, self._shared
        found = self.vocab
        idf = np.zeros(len(self.asked.texts))
        idf[found["number"]] = _idf(found["df"].to_numpy(), n_docs, min_df)
        idf = self.spark.sparkContext.broadcast(idf)

        def run(packed: pa.Table, blocks: pa.Table) -> pa.Table:
            (row,) = packed.drop_columns("ids").to_pylist()
            batch = Batch.of(row)
            doc, grams, tf = batch.grams(longest)
            order = np.argsort(grams)
            df = np.zeros(len(grams), np.int32)
            if len(grams):
                of_gram = np.concatenate([_counts(b) for b in blocks.sort_by("part")["df"].to_pylist()])
                df[order] = np.repeat(of_gram, _steps(grams[order])[1])
            raw = (1 + np.log(tf)) * _idf(df, n_docs, min_df)
            length = np.sqrt(np.bincount(doc, raw * raw, minlength=batch.n_docs))
            doc, number, tf = batch.wanted(shared.value)
            known = idf.value[number] > 0
            doc, number, tf = doc[known], number[known], tf[known]
            weight = (1 + np.log(tf)) * idf.value[number] / length[doc]
            return _table(kind, give(packed["ids"].combine_chunks().flatten(), doc, number, tf, weight))

        n = int(self.parts)
        left = self.packed.repartition(n, "batch").groupBy("batch")
        with _cleaned(self.spark):
            frequency = written(self._frequency(), "frequency")
        right = frequency.repartition(n, "batch").groupBy("batch")
        return left.cogroup(right).applyInArrow(run, schema)

    def postings(self) -> DataFrame:
        """(id, gram, tf, weight) of all asked grams."""
        shared = self._shared

        def give(ids: pa.Array, doc: np.ndarray, number: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> list:
            texts = shared.value.texts
            return [ids.take(pa.array(doc)), [texts[i] for i in number], tf, weight]

        return self._met(T.StructType([T.StructField(self.id_col, self.id_type), T.StructField("gram", T.StringType()),
                                       T.StructField("tf", T.LongType()), T.StructField("weight", T.DoubleType())]), give)

    def ranked(self, vectors: DataFrame, k: int, query_id: str = "qid") -> DataFrame:
        """(query, id, score): the best k documents of each batch for each query (query, gram, qw)."""
        at = {g: i for i, g in enumerate(self.asked.texts)}
        ids, grams, qw = (c.to_pylist() for c in vectors.select(query_id, "gram", "qw").toArrow().columns)
        names = {q: i for i, q in enumerate(dict.fromkeys(ids))}
        query, number = np.array([names[q] for q in ids], np.int64), np.array([at[g] for g in grams], np.int64)
        order = np.lexsort((query, number))
        starts = np.searchsorted(number[order], np.arange(len(at) + 1))
        side = self.spark.sparkContext.broadcast((list(names), starts, query[order], np.array(qw, np.float64)[order]))
        kind = vectors.schema[query_id].dataType
        from pyspark.sql.pandas.types import to_arrow_type
        arrow = to_arrow_type(kind)

        def give(ids: pa.Array, doc: np.ndarray, number: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> list:
            names, starts, query, qw = side.value
            n, step, parts = len(names), max(1, SCORE_CELLS // max(len(names), 1)), []
            for first in range(0, len(ids) if n else 0, step):
                here = slice(*np.searchsorted(doc, [first, first + step]))
                gram, rows = number[here], min(step, len(ids) - first)
                times = starts[gram + 1] - starts[gram]
                each = np.repeat(np.arange(len(gram)), times)
                entry = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times) + starts[gram][each]
                cell = (doc[here] - first)[each] * n + query[entry]
                total = np.bincount(cell, weight[here][each] * qw[entry], minlength=rows * n)
                total = total.reshape(rows, n).astype(np.float64)  # counts of nothing are integers
                barred = np.round(total, SCORE_DIGITS) <= 0
                parts.append(dense._best(total, 0, np.arange(first, first + rows), k, barred))
                parts = [dense._merged(parts, k)]
            q, i, s = parts[0] if parts else (np.zeros(0, np.int64),) * 3
            return [pa.array([names[j] for j in q], arrow), ids.take(pa.array(i)), s]

        return self._met(T.StructType([T.StructField(query_id, kind), T.StructField(self.id_col, self.id_type),
                                       T.StructField("score", T.DoubleType())]), give)


def _idf(df: np.ndarray, n_docs: int, min_df: int) -> np.ndarray:
    """0 for grams that too few documents hold."""
    return np.where(df >= min_df, np.log((1.0 + n_docs) / (1.0 + df)) + 1, 0.0)
