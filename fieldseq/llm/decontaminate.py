"""Benchmark decontamination: BM25 over test items with block-max WAND.

Test items form an inverted index of normalised BM25 impacts (an item queried by
itself scores 1) with the largest impact of every block of postings. Each training
text is cut into overlapping passages as long as twice the longest item, and every
passage is a query for all items above a threshold. Found items are verified: the
passage must repeat enough word triples of the item's question and of its answer
(enough words, where that part is short).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldseq.llm.base import n_words, query, stored, table
from fieldseq.llm.language import groups
from fieldseq.llm.words import shingles, text_buffers, words

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, TRIPLE = 0.5, 0.5, 3
FEW_WORDS = 8
GROUP_BYTES = 2 << 20
BLOCK, RANGES, STRIDE, ROWS = 8, 256, 64, 16384
ITEMS_AT_ONCE, BYTES_AT_ONCE = 20_000, 4 << 20
_SENTENCE = re.compile(r"[.!?]+\s+(?=\S)")


def answer_start(text: str) -> int:
    """Words of an item before its answer: after the last question mark with text behind it,
    else the last sentence, else the last third."""
    n = len(text.encode().split())
    asked = text.rstrip().rfind("?", 0, max(len(text.rstrip()) - 1, 0))
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    cut = asked + 1 if asked >= 0 else ends[-1] if ends else -1
    at = len(text[:cut].encode().split()) if cut > 0 else 0
    return at if 3 <= at <= n - 3 else n - n // 3


@dataclass
class Index:
    """Inverted index of items; terms, postings and blocks are flat arrays."""

    item_ids: list[int]
    terms: np.ndarray  # sorted word hashes
    start: np.ndarray  # first posting of each term, one more at the end
    items: np.ndarray  # item of each posting, ascending per term
    impact: np.ndarray
    most: np.ndarray  # largest impact per term
    block_start: np.ndarray  # first block of each term
    block_last: np.ndarray  # last item of each block
    block_most: np.ndarray  # largest impact in each block
    wide: np.ndarray  # terms x item ranges: largest impact in the range
    question: list[np.ndarray]  # triples of each item's question, and of its answer
    answer: list[np.ndarray]
    stride: int

    def wand(self, terms: np.ndarray, threshold: float, first: int, stop: int
             ) -> list[tuple[int, float]]:
        """Items from `first` to `stop` whose impacts over the terms reach the threshold.

        Cursors are kept in item order; the pivot is the first cursor at which the terms'
        maxima add up to the threshold. Before the pivot item is scored, the maxima of its
        blocks must add up as well, else all cursors skip past the nearest block end.
        """
        cursors = []
        for t in terms:
            own = self.items[self.start[t]:self.start[t + 1]]
            a, b = np.searchsorted(own, (first, stop)) + self.start[t]
            if a < b:
                cursors.append([int(a), int(b), int(t)])
        found = []
        while cursors:
            cursors.sort(key=lambda c: self.items[c[0]])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += self.most[c[2]]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = int(self.items[cursors[pivot][0]])
            while pivot + 1 < len(cursors) and self.items[cursors[pivot + 1][0]] == item:
                pivot += 1
            bound, end = 0.0, stop
            for c in cursors[:pivot + 1]:
                lo, hi = int(self.block_start[c[2]]), int(self.block_start[c[2] + 1])
                k = lo + int(np.searchsorted(self.block_last[lo:hi], item))
                if k < hi:
                    bound += self.block_most[k]
                    end = min(end, int(self.block_last[k]))
            if bound >= threshold:
                score, target = 0.0, item + 1
                for c in cursors[:pivot + 1]:
                    at = c[0] + int(np.searchsorted(self.items[c[0]:c[1]], item))
                    if at < c[1] and self.items[at] == item:
                        score += float(self.impact[at])
                if score >= threshold:
                    found.append((item, score))
            else:
                target = end + 1
                if pivot + 1 < len(cursors):
                    target = min(target, int(self.items[cursors[pivot + 1][0]]))
                target = max(target, item + 1)
            for c in cursors[:pivot + 1]:
                c[0] += int(np.searchsorted(self.items[c[0]:c[1]], target))
            cursors = [c for c in cursors if c[0] < c[1]]
        return found


def build_index(item_ids: list[int], texts: list[str], df: dict[int, int], n_items: int,
                mean_words: float, longest: int = 0) -> Index:
    """Index some items with the word statistics of all items.

    `longest` is the number of words of the longest of all items: passages are cut alike
    for all indexes, so what is found does not depend on how items are put together.
    """
    h, owner = words(pa.array(texts, pa.large_string()))
    n = len(texts)
    pairs, counts = np.unique(np.stack((owner.astype(np.uint64), h)), axis=1, return_counts=True) \
        if len(h) else (np.zeros((2, 0), np.uint64), np.zeros(0))
    item, word = pairs[0].astype(np.int64), pairs[1]
    terms = np.unique(word)
    term = np.searchsorted(terms, word)
    rare = np.array([df[int(w.astype(np.int64))] for w in terms], dtype=float)
    idf = np.log1p((n_items - rare + 0.5) / (rare + 0.5))
    size = np.bincount(owner, minlength=n)
    norm = K1 * (1 - B + B * size[item] / max(mean_words, 1.0))
    weight = idf[term] * counts * (K1 + 1) / (counts + norm)
    weight = weight / np.bincount(item, weight, n)[item] if len(item) else weight
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order], weight[order]
    start = np.searchsorted(term, np.arange(len(terms) + 1))
    heads = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(start, start[1:])]) \
        if len(terms) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(item)) if len(heads) else heads
    span = max(1, -(-n // RANGES))
    wide = np.zeros((len(terms), RANGES), np.float32)
    np.maximum.at(wide, (term, item // span), weight.astype(np.float32) * np.float32(1 + 1e-6))
    cut = [answer_start(t) for t in texts]
    first = np.concatenate(([0], np.cumsum(size)))

    def grams(a: int, b: int) -> np.ndarray:
        k = TRIPLE if b - a >= FEW_WORDS else 1
        return shingles(h[a:b], np.zeros(b - a, np.int64), 1, k)[1] if b > a else np.zeros(0, np.uint64)

    return Index(
        item_ids, terms, start, item, weight,
        np.maximum.reduceat(weight, start[:-1]) if len(terms) else np.zeros(0),
        np.searchsorted(heads, start), item[ends - 1] if len(heads) else heads,
        np.maximum.reduceat(weight, heads) if len(heads) else np.zeros(0), wide,
        [grams(first[i], first[i] + cut[i]) for i in range(n)],
        [grams(first[i] + cut[i], first[i + 1]) for i in range(n)],
        max(STRIDE, longest, int(size.max()) if n else 0))


def _share(wanted: np.ndarray, held: np.ndarray) -> float:
    return float(np.isin(wanted, held).mean()) if len(wanted) else 1.0


def _hits(index: Index, h: np.ndarray, doc: np.ndarray, n: int, threshold: float, overlap: float
          ) -> list[list[dict]]:
    """Verified items per text of a group, each with its best passage."""
    out: list[list[dict]] = [[] for _ in range(n)]
    if not len(h) or not len(index.terms):
        return out
    slot = np.searchsorted(index.terms, h)
    slot[slot == len(index.terms)] = 0
    known = np.flatnonzero(index.terms[slot] == h)
    begin = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
    # segments of one stride; a passage is two neighbouring segments of a text
    per_doc = np.maximum(1, -(-np.diff(begin) // index.stride))
    seg_first = np.concatenate(([0], np.cumsum(per_doc)))
    segment = seg_first[doc[known]] + (known - begin[doc[known]]) // index.stride
    keys = np.unique(segment * len(index.terms) + slot[known])
    segment, term = keys // len(index.terms), keys % len(index.terms)
    total = int(seg_first[-1])
    cut = np.searchsorted(segment, np.arange(total + 1))
    last = np.zeros(total, bool)
    last[seg_first[1:] - 1] = True

    def passage(sums: np.ndarray) -> np.ndarray:
        following = np.zeros_like(sums)
        following[:-1] = sums[1:]
        following[last] = 0
        return sums + following

    near = passage(np.bincount(segment, index.most[term], total)) >= threshold - 1e-9
    wanted = near.copy()
    wanted[1:] |= near[:-1]
    by_range = np.zeros((total, RANGES), np.float32)
    rows, at = np.flatnonzero(wanted[segment]), 0
    while at < len(rows):  # some rows at a time, whole segments
        to = int(np.searchsorted(segment[rows], segment[rows[min(at + ROWS, len(rows)) - 1]], "right"))
        part = rows[at:to]
        heads = np.flatnonzero(np.append(True, segment[part][1:] != segment[part][:-1]))
        by_range[segment[part][heads]] = np.add.reduceat(index.wide[term[part]], heads, axis=0)
        at = to
    span = max(1, -(-len(index.item_ids) // RANGES))
    close = passage(by_range) >= threshold - 1e-4
    for s in np.flatnonzero(near & close.any(axis=1)):
        stop = s + 1 if last[s] else s + 2
        own = np.unique(term[cut[s]:cut[stop]])
        found = [x for r in np.flatnonzero(close[s])
                 for x in index.wand(own, threshold, r * span, (r + 1) * span)]
        if not found:
            continue
        d = int(np.searchsorted(seg_first, s, "right")) - 1
        a = int(begin[d] + (s - seg_first[d]) * index.stride)
        b = min(a + 2 * index.stride, int(begin[d + 1]))
        held = np.concatenate([shingles(h[a:b], np.zeros(b - a, np.int64), 1, k)[1]
                               for k in (1, TRIPLE)])
        for item, score in found:
            q, r = _share(index.question[item], held), _share(index.answer[item], held)
            if q >= overlap and r >= overlap:
                out[d].append({"item_id": index.item_ids[item], "score": score,
                               "question_overlap": q, "answer_overlap": r,
                               "first_word": a - int(begin[d])})
    for d, found in enumerate(out):
        if len(found) > 1:
            best: dict[int, dict] = {}
            for x in found:
                if x["item_id"] not in best or x["score"] > best[x["item_id"]]["score"]:
                    best[x["item_id"]] = x
            out[d] = [best[i] for i in sorted(best)]
    return out


_HITS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType()),
    T.StructField("first_word", T.LongType())]))
_HITS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()),
                                  ("question_overlap", pa.float64()),
                                  ("answer_overlap", pa.float64()), ("first_word", pa.int64())]))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, owner = words(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(h.view(np.int64))],
                                         ["item_id", "word"])


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD,
               overlap: float = OVERLAP) -> DataFrame:
    """Add `hits`, the verified items of each text, to all rows.

    Items are taken in blocks of bounded count and bytes, each with its own index that
    travels to the tasks; one pass over the texts per block, with word statistics of all
    items. Items that are null, without words or without id are skipped. Null and empty
    texts have no hits. A column named `hits` is replaced; other columns stay.
    """
    docs = docs.drop("hits")
    items = stored(items.select(F.col("item_id").cast("long"), "text")
                   .filter(F.col("item_id").isNotNull() & F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))),
                   "items")
    all_words = stored(items.mapInArrow(_item_words, "item_id long, word long"), "item_words")
    stats = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"),
                      F.max(n_words("text")).alias("longest")).first()
    mean = all_words.count() / max(stats.n, 1)
    df = all_words.distinct().groupBy("word").agg(F.count("*").alias("df"))
    passes = max(1, -(-stats.n // ITEMS_AT_ONCE), -(-(stats.b or 0) // BYTES_AT_ONCE))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    out = docs.withColumn("hits", F.lit([]).cast(_HITS))
    for k in range(passes):
        part = items.filter(block == k)
        rows = part.orderBy("item_id", "text").collect()
        own = all_words.join(part.select("item_id"), "item_id", "left_semi").select("word").distinct()
        known = {r.word: r.df for r in df.join(own, "word").collect()}
        index = docs.sparkSession.sparkContext.broadcast(  # at most ITEMS_AT_ONCE items
            build_index([r.item_id for r in rows], [r.text for r in rows], known, stats.n, mean,
                        stats.longest or 0))
        out = _one_pass(out, index, threshold, overlap)
    return out


def _one_pass(docs: DataFrame, index, threshold: float, overlap: float) -> DataFrame:
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before = batch.column(names.index("text")), batch.column(names.index("hits"))
            _, offsets = text_buffers(texts)
            hits: list[list[dict]] = []
            for a, b in groups(offsets, GROUP_BYTES):
                h, doc = words(texts.slice(a, b - a))
                hits += _hits(index.value, h, doc, b - a, threshold, overlap)
            for i in np.flatnonzero(pa.compute.list_value_length(before).to_numpy(zero_copy_only=False)):
                hits[i] = sorted(before[int(i)].as_py() + hits[i], key=lambda x: x["item_id"])
            columns = list(batch.columns)
            columns[names.index("hits")] = pa.array(hits, _HITS_ARROW)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(apply, docs.schema)


@query("op10_benchmark_leaks")
def op10_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"),
                       table(spark, sf_dir, "benchmark"))
    return (found.filter(F.size("hits") > 0).select("doc_id", F.explode("hits").alias("h"))
            .select("doc_id", "h.*"))
