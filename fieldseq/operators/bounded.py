"""Exact top k of the sparse ranking without scoring every match.

Items are dealt to blocks by their heaviest gram, so that items of a block are alike. For
each gram and block the largest weight is kept. Summed over the grams of a query, these
bound every score in a block. A query scores its most promising blocks first; the k-th best
score found there is a threshold no other block below it can pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseq.operators import predicate_index, sparse
from fieldseq.operators.asked import AskedIndex
from fieldseq.operators.skew import salted_lookup, stacked, top_k
from fieldseq.operators.sparse import POOL, SCORE_DIGITS, SparseIndex
from fieldseq.sources.tables import written

#: Items per block, on average.
PER_BLOCK = 2_000
#: Blocks a query scores before it has a threshold.
FIRST = 2
#: More than a rounded score can be above its sum.
_SLACK = 1e-9


@dataclass(frozen=True)
class BlockIndex:
    """`postings(id, gram, weight, block)` and `maxima(gram, block, top, n)`, both stored."""

    postings: DataFrame
    maxima: DataFrame
    id_col: str


def in_blocks(index: SparseIndex, per_block: int = PER_BLOCK) -> BlockIndex:
    """Deal items to blocks by their heaviest gram; one that many items share gets several."""
    raw = written(index.postings.select(index.id_col, "gram", "weight"), "raw_postings")
    best = raw.groupBy(index.id_col).agg(F.max_by("gram", F.struct("weight", "gram")).alias("_best"))
    best = written(best, "heaviest")
    n = best.count()
    sizes = best.groupBy("_best").agg(F.count("*").alias("_n"))
    hot = sizes.filter(F.col("_n") * 20_000 >= n)
    parts = salted_lookup(best, sizes, "_best", F.col(index.id_col), hot, ["_n"])
    of_gram = F.pmod(F.xxhash64(index.id_col), F.ceil(F.col("_n") / per_block))
    block = F.pmod(F.xxhash64("_best", of_gram), F.lit(max(1, -(-n // per_block))))
    placed = raw.join(parts.select(index.id_col, block.cast("long").alias("block")), index.id_col)
    postings = written(placed.repartitionByRange("block", "gram").sortWithinPartitions("block", "gram"), "block_postings")
    maxima = written(postings.groupBy("gram", "block").agg(F.max("weight").alias("top"), F.count("*").alias("n")), "maxima")
    return BlockIndex(postings, maxima, index.id_col)


def bounds(vectors: DataFrame, index: BlockIndex, query_id: str = "qid") -> DataFrame:
    """(qid, block, bound, matches): no item of the block scores more; its postings the query has."""
    met = vectors.select(query_id, "gram", "qw").join(index.maxima, "gram")
    return met.groupBy(query_id, "block").agg(F.sum(F.col("top") * F.col("qw")).alias("bound"),
                                              F.sum("n").alias("matches"))


def _scored(vectors: DataFrame, blocks: DataFrame, index: BlockIndex, k: int, held: DataFrame | None,
            query_id: str) -> DataFrame:
    """Best k items of each query in the given blocks (qid, block)."""
    asked = vectors.drop("salts").join(blocks.select(query_id, "block"), query_id)
    met = index.postings.join(asked, ["block", "gram"])
    if held is not None:
        met = met.join(held, index.id_col).filter(predicate_index.admits())
    pairs = (met.groupBy(query_id, index.id_col)
             .agg(F.round(F.sum(F.col("weight") * F.col("qw")), SCORE_DIGITS).alias("score"))
             .filter(F.col("score") > 0))
    return top_k(pairs, [query_id], [F.desc("score"), F.asc(index.id_col)], k).drop("rank")


def visits(vectors: DataFrame, index: BlockIndex, k: int = POOL, first: int = FIRST,
           held: DataFrame | None = None, query_id: str = "qid") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Best k of the first blocks, and the blocks visited first and afterwards."""
    reach = written(bounds(vectors, index, query_id), "bounds")
    promising = top_k(reach, [query_id], [F.desc("bound"), F.asc("block")], first).drop("rank")
    promising = written(promising, "first_blocks")
    early = written(_scored(vectors, promising, index, k, held, query_id), "early")
    least = (early.groupBy(query_id).agg(F.min("score").alias("_least"), F.count("*").alias("_n"))
             .filter(F.col("_n") == k).drop("_n"))
    later = (reach.join(promising.select(query_id, "block"), [query_id, "block"], "left_anti")
             .join(least, query_id, "left")
             .filter(F.col("_least").isNull() | (F.col("bound") + _SLACK >= F.col("_least"))).drop("_least"))
    return early, promising, written(later, "later_blocks")


def best(vectors: DataFrame, index: BlockIndex, k: int = POOL, first: int = FIRST,
         held: DataFrame | None = None, query_id: str = "qid") -> DataFrame:
    """Exactly what ranking all matches gives: (qid, id, score, 0-based rank).

    With `held`, only pairs a predicate index admits count, for the threshold too; the
    vectors carry the `needs` of their query then. A query with fewer than k items in its
    first blocks visits all blocks it matches.
    """
    early, _, later = visits(vectors, index, k, first, held, query_id)
    both = stacked([early, _scored(vectors, later, index, k, held, query_id)])
    return top_k(both, [query_id], [F.desc("score"), F.asc(index.id_col)], k)


def best_asked(docs: DataFrame, id_col: str, words: Column, queries: DataFrame, asked_words: Column,
               k: int = POOL, size: Column | None = None) -> DataFrame:
    """Best k documents of each query text, as the index of all documents ranks them: (qid, id, score, rank).

    While the grams of the queries may be broadcast, each batch of documents ranks its own;
    more of them search the blocks of the whole index. `size` as in `sparse.fit_asked`.
    """
    if not sparse.is_small(queries, asked_words):
        index = sparse.fit_index(docs, id_col, words)
        grams = written(sparse.query_vectors(queries, index.vocab, asked_words), "grams")
        return best(grams, in_blocks(index), k)
    found = AskedIndex(docs, id_col, words, queries, asked_words, sparse.MIN_DF, sparse.LONGEST, size)
    grams = sparse.query_vectors(queries, sparse.asked_vocab(found), asked_words)
    return sparse.rank(found.ranked(grams, k), id_col, k)
