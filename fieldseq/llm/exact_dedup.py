"""Exact copies of texts, found by counting quotient filters of fingerprints.

Every partition counts the fingerprints of its texts in a filter. Filters are cut by
leading bits and merged range by range; the merged ones hold the exact count of every
fingerprint. Texts whose fingerprint was counted once are unique and never leave their
place; the others are grouped by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseq.llm import quotient_filter
from fieldseq.llm.base import query, stored, table
from fieldseq.operators.skew import salted_lookup

#: Bits of a fingerprint; fingerprints in a merged range; fingerprints counted before a filter is sent.
BITS, PER_RANGE, HELD = 56, 1 << 20, 1 << 20
#: Most routes sent to all tasks; groups holding at least one part in so many of the rows are looked up apart.
ROUTES, HOT_PARTS = 1 << 20, 20_000


def normal(text: Column | str) -> Column:
    """The text with each run of the six ASCII blanks as one space; null counts as empty.

    Single spaces, nearly all runs, are not matched.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")),
                            r"\x20*[\x09-\x0D][\x20\x09-\x0D]*|\x20\x20+", " ")


def fingerprint(text: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits)


def _filters(bits: int, cut: int, held: int):
    """Filters of a partition, one per range of leading bits, sent when `held` prints are counted."""
    def emit(prints: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        seen = np.concatenate(prints)
        seen, counts = quotient_filter.summed(seen, np.ones(len(seen), dtype=np.int64))
        ranges, first = np.unique(seen >> (bits - cut), return_index=True)
        ends = np.append(first[1:], len(seen))
        for i in range(0, len(ranges), 1024):
            made = [quotient_filter.build(seen[a:b], counts[a:b], bits)
                    for a, b in zip(first[i:i + 1024], ends[i:i + 1024])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ranges[i:i + 1024], pa.int64()), pa.array(made, pa.binary())], ["range", "filter"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, n = [], 0
        for batch in batches:
            prints.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += len(prints[-1])
            if n >= held:
                yield from emit(prints)
                prints, n = [], 0
        if n:
            yield from emit(prints)
    return apply


def merged_filters(prints: DataFrame, rows: int, bits: int = BITS, per_range: int = PER_RANGE,
                   held: int = HELD) -> DataFrame:
    """(range, filter): merged counting quotient filters of a one-column table of fingerprints.

    `rows` is the number of rows, which sets how many leading bits cut the ranges (8
    ranges at least); a range holds about `per_range` distinct fingerprints, copies add
    to its counts only.
    """
    cut = min(bits, max(3, (max(rows, 1) // per_range).bit_length()))

    def merge(key: tuple, found: pa.Table) -> pa.Table:
        both = quotient_filter.merge((f.as_py() for f in found.column("filter")), bits)
        return pa.table({"range": pa.array([key[0].as_py()], pa.int64()),
                         "filter": pa.array([both], pa.binary())})

    kind = "range long, filter binary"
    return prints.mapInArrow(_filters(bits, cut, held), kind).groupBy("range").applyInArrow(merge, kind)


def fingerprint_counts(filters: DataFrame, least: int = 1) -> DataFrame:
    """(fp, n): fingerprints that merged filters counted at least `least` times."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.column(0):
                prints, counts = quotient_filter.entries(f.as_py())
                hit = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(prints[hit]), pa.array(counts[hit])], ["fp", "n"])
    return filters.select("filter").mapInArrow(apply, "fp long, n long")


def exact_copies(docs: DataFrame, bits: int = BITS, per_range: int = PER_RANGE,
                 routes: int = ROUTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of `docs` (doc_id, text).

    Texts are equal when they are byte for byte, each run of blanks being one space; a
    null text counts as empty. Of equal texts the row with the smallest doc_id stays;
    a null doc_id is larger than all others. Of rows that repeat the doc_id and text that
    stays, exactly one is kept. Other columns are ignored; an empty table gives no rows.

    Up to `routes` repeated fingerprints are sent to the scan as they are; beyond that
    their leading bits are (still at most `routes` values), and some unique texts take
    part in the comparison of bytes, which changes no result. Equal texts are combined
    in each partition before any is shuffled. Rows find their group by SHA-256.
    """
    text = normal(F.col("text"))
    keys = stored(docs.select("doc_id", fingerprint(text, bits).alias("fp"),
                              F.sha2(text, 256).alias("text_sha256")), "fingerprints")
    rows = keys.count()
    repeated = stored(fingerprint_counts(merged_filters(keys.select("fp"), rows, bits, per_range), 2),
                      "repeated_fingerprints")
    exact = repeated.count() <= routes
    away = 0 if exact else max(0, bits - (routes.bit_length() - 1))
    where = repeated.select(F.shiftrightunsigned("fp", away).alias("_route")).distinct()
    at = docs.select("doc_id", normal(F.col("text")).alias("_text")).withColumn(
        "_route", F.shiftrightunsigned(fingerprint(F.col("_text"), bits), away))
    groups = stored(
        at.join(F.broadcast(where), "_route", "left_semi").groupBy("_route", "_text")
        .agg(F.min("doc_id").alias("keep"), F.count("*").alias("size")).filter("size > 1")
        .select(F.sha2("_text", 256).alias("text_sha256"), "keep", "size"), "equal_texts")
    hot = groups.filter(F.col("size") * HOT_PARTS >= rows)
    single = keys.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("_n"))
    found = salted_lookup(single, groups, "text_sha256", F.col("doc_id"), hot, ["keep", "size"])
    alone = F.col("size").isNull()
    return (found.withColumn("keep_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
            .select("doc_id", "keep_id", F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
                    "text_sha256"))


@query("op12_exact_dedup", r"""
  with t as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
  g as (select t, min(doc_id) as keep_id, count(*) as group_size from t group by t)
  select doc_id, keep_id, group_size,
    row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256
  from t join g using (t)""")
def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))
