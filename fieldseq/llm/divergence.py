"""How far sources of one language diverge in their words.

Counts of terms by source are cut into tiles, each a K-squared tree. Two tiles with the
same terms are walked together: what is empty in both is priced without being visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldseq.llm import quadtree
from fieldseq.llm.base import query, stored, table
from fieldseq.operators.skew import spread_join, stacked, top_k

LEAST_DOCS, ADDED, SCALE, TOP = 30, 5, 10 ** 9, 50
#: Most groups and terms in a tile, terms in a range on average, distinct counts held by a scan task.
TILE, RANGE, HELD = 1024, 512, 200_000
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 21

#: A-Z become a-z, other ASCII but a-z becomes a blank; bytes of all other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes, piece: int) -> Iterator[bytes]:
    """Folded pieces of a text, cut at blanks."""
    at, held = 0, b""
    while at < len(text):
        part = held + text[at:at + piece].translate(_FOLD)
        at += piece
        cut = len(part) if at >= len(text) else part.rfind(b" ") + 1
        held = part[cut:]
        yield part[:cut]


def _counts(held: int, piece: int):
    """(lang, source, term, n, docs) of groups of documents."""
    def emit(found: dict) -> pa.RecordBatch:
        langs, sources, terms = zip(*found)
        n, docs = zip(*found.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()),
             pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            columns = [batch.column(i) for i in range(3)]
            for lang, source, text in zip(*(column.to_pylist() for column in columns[:2]), columns[2]):
                own: dict = {}
                for part in _pieces(text.as_py(), piece):
                    for term in part.split():
                        own[term] = own.get(term, 0) + 1
                for term, n in own.items():
                    seen = found.get((lang, source, term))
                    if seen is None:
                        found[lang, source, term] = [n, 1]
                    else:
                        seen[0] += n
                        seen[1] += 1
                if len(found) >= held:
                    yield emit(found)
                    found = {}
        if found:
            yield emit(found)
    return apply


def term_counts(docs: DataFrame, held: int = HELD, piece: int = PIECE) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and documents with it.

    Terms are runs of letters A-Z in either case and of characters beyond ASCII; only A-Z
    are lower-cased. Null lang, source and text count as ''. A task combines equal terms of
    its documents before it sends them.
    """
    none = F.lit("")
    rows = docs.select(F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source"),
                       F.coalesce("text", none).cast("binary").alias("text"))
    return (rows.mapInArrow(_counts(held, piece), "lang string, source string, term binary, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def scaled(count, total, scale: int = SCALE):
    """1 + floor(scale * count / total), exactly, by long division; scale is a power of ten.

    Totals stay below 9 * 10^17.
    """
    whole, rest = count // total, count % total
    for _ in range(len(str(scale)) - 1):
        rest = rest * 10
        whole, rest = whole * 10 + rest // total, rest % total
    return whole + 1


def tiles(counts: DataFrame, groups: DataFrame, least_docs: int = LEAST_DOCS, tile: int = TILE,
          per_range: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Tiles of the group-term matrix of each language, and its numbered groups.

    Groups are lang, source, row block `rb`, `row` in it, `n` (occurrences of kept terms), and
    the language's `v` kept terms and `total` occurrences. Tiles are (lang, cb, rb) with the
    `n` of their groups, `terms` and their `sums` in the language, and the tree: `bits` and
    `cells`. Every column block has a tile per row block, empty ones included, and a language
    has at least one column block. Terms are dealt to column blocks by hash, inside ordered by the number of
    groups that have them, so that frequent ones lie together.
    """
    kept = (counts.groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.sum("n").alias("sum"), F.count("*").alias("spread"))
            .filter(F.col("docs") >= least_docs).drop("docs"))
    kept = stored(kept, "kept_terms")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("sum").alias("total"))
    placed = (spread_join(kept, sizes, ["lang"], F.col("term"))
              .withColumn("range", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / per_range)))
              .groupBy("lang", "range").agg(F.array_sort(F.collect_list(F.struct(
                  (-F.col("spread")).alias("o"), "term", "sum"))).alias("t"))
              .select("lang", "range", F.posexplode("t").alias("p", "t"))
              .select("lang", "t.term", "t.sum", F.struct(
                  "range", F.floor(F.col("p") / tile).alias("part")).alias("cb"),
                  (F.col("p") % tile).alias("column")))
    placed = stored(placed, "placed_terms")
    met = stored(counts.select("lang", "source", "term", "n").join(
        placed.select("lang", "term", "cb", "column"), ["lang", "term"]), "kept_counts")

    per_group = met.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    named = (groups.join(per_group, ["lang", "source"], "left").join(sizes, "lang", "left")
             .groupBy("lang", "v", "total").agg(F.array_sort(F.collect_list(F.struct(
                 "source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
             .select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"),
                     F.posexplode("s").alias("p", "s"))
             .select("lang", "s.source", F.floor(F.col("p") / tile).cast("int").alias("rb"),
                     (F.col("p") % tile).alias("row"), "s.n", "v", "total"))
    named = stored(named, "groups")

    def grow(key: tuple, found: pa.Table) -> pa.Table:
        row, column, n = (found.column(c).to_numpy() for c in ("row", "column", "n"))
        bits, cells = quadtree.build(row, column, n, depth)
        return pa.table({"lang": [key[0].as_py()], "cb": pa.array([key[1].as_py()], block),
                         "rb": pa.array([key[2].as_py()], pa.int32()), "bits": [bits], "cells": [cells]})

    depth = max(0, (tile - 1) // quadtree.LEAF).bit_length()
    block = pa.struct([("range", pa.int64()), ("part", pa.int64())])
    trees = (spread_join(met, named.select("lang", "source", "rb", "row"), ["lang", "source"], F.col("term"))
             .select("lang", "cb", "rb", "row", "column", "n").groupBy("lang", "cb", "rb")
             .applyInArrow(grow, "lang string, cb struct<range:long,part:long>, rb int, bits binary, cells binary"))
    heads = placed.groupBy("lang", "cb").agg(F.array_sort(F.collect_list(F.struct("column", "term", "sum"))).alias("t"))
    band = named.select("lang", "rb", "v", "total", "row", "n").groupBy("lang", "rb", "v", "total").agg(
        F.array_sort(F.collect_list(F.struct("row", "n"))).alias("r")).select(
        "lang", "rb", "v", "total", F.col("r.n").alias("n"))
    wide = spread_join(heads, band, ["lang"], F.xxhash64("cb"))
    bare = band.filter("v = 0").select(
        "lang", F.struct(*[F.lit(0).cast("long").alias(c) for c in ("range", "part")]).alias("cb"),
        F.array().cast("array<struct<column:bigint,term:binary,sum:bigint>>").alias("t"), "rb", "v", "total", "n")
    wide = stacked([wide, bare]).join(trees, ["lang", "cb", "rb"], "left")
    return wide.select("lang", "cb", "rb", "v", "total", "n", F.col("t.term").alias("terms"),
                       F.col("t.sum").alias("sums"), "bits", "cells"), named


def _tree(bits: bytes | None, cells, depth: int) -> tuple:
    return quadtree.read(*(quadtree.EMPTY if bits is None else (bits, cells)), depth)


def _price(totals: np.ndarray, v: int, added: int, scale: int):
    if v == 0:
        return lambda rows, counts: np.zeros(counts.shape, dtype=np.int64)
    n = totals + added * v
    return lambda rows, counts: scaled(counts + added, n[np.minimum(rows, len(n) - 1)], scale)


def _walk(depth: int, added: int, scale: int):
    """Per pair of rows of two tiles the sum of price differences over the tile's terms."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                price = [_price(np.array(r[f"{s}_n"], np.int64), r["v"], added, scale) for s in "ab"]
                heights = (len(r["a_n"]), len(r["b_n"]))
                trees = [_tree(r[f"{s}_bits"], r[f"{s}_cells"], depth) for s in "ab"]
                apart = quadtree.differences(*trees, r["columns"], heights, tuple(price))
                key = (r["lang"], r["a"], r["b"])
                sums[key] = sums[key] + apart if key in sums else apart
                if sum(d.size for d in sums.values()) > 1 << 22:
                    yield from emit(sums)
                    sums = {}
        yield from emit(sums)

    def emit(sums: dict) -> Iterator[pa.RecordBatch]:
        for (lang, a, b), apart in sums.items():
            i, j = np.nonzero(np.ones(apart.shape, bool))
            if a == b:
                i, j = i[i < j], j[i < j]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(i), pa.string()), pa.array([a] * len(i), pa.int32()),
                 pa.array([b] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                 pa.array(apart[i, j])], ["lang", "a", "b", "i", "j", "value"])
    return apply


def _excess(depth: int, added: int, scale: int, top: int):
    """Per group the `top` terms of a tile that it uses more than its language does."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["bits"] is None:
                    continue
                row, column, n = quadtree.leaf_cells(_tree(r["bits"], r["cells"], depth))
                own = _price(np.array(r["n"], np.int64), r["v"], added, scale)(row, n)
                usual = scaled(np.array(r["sums"], np.int64) + added, r["total"] + added * r["v"], scale)
                value = own - usual[column]
                by_term = np.argsort(np.argsort(np.array(r["terms"], dtype=object)))
                order = np.lexsort((by_term[column], -value, row))
                order = order[value[order] > 0]
                first = np.searchsorted(row[order], row[order], side="left")
                order = order[np.arange(len(order)) - first < top]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["lang"]] * len(order), pa.string()), pa.array([r["rb"]] * len(order), pa.int32()),
                     pa.array(row[order], pa.int32()),
                     pa.array([r["terms"][c].decode("utf-8") for c in column[order]], pa.string()),
                     pa.array(value[order])], ["lang", "rb", "row", "item", "value"])
    return apply


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, added: int = ADDED, scale: int = SCALE,
          top: int = TOP, tile: int = TILE, per_range: int = RANGE) -> DataFrame:
    """lang, source, part, item, value, rank: divergence of the sources of each language.

    Kept terms are those in at least `least_docs` documents (rows) of the language. A group's
    price of a term is 1 + floor(scale * (count + added) / (N + added * V)). Part `pair`: the
    sum of price differences to each other source of the language; part `term`: the `top` terms
    that occur in the group and cost more there than in the language. Equal values are ordered
    by item in UTF-8. Null text, lang and source are ''; other columns are ignored, repeated rows
    count as often as they occur, groups without terms are compared too, a lone source has no
    pair, an empty table gives no rows.
    """
    none = F.lit("")
    groups = docs.select(F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source")).distinct()
    counts = stored(term_counts(docs), "term_counts")
    cut, named = tiles(counts, groups, least_docs, tile, per_range)
    depth = max(0, (tile - 1) // quadtree.LEAF).bit_length()
    cut = stored(cut, "tiles")
    side = {s: cut.select("lang", "cb", F.col("rb").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "bits", "cells")])
            for s in "ab"}
    met = (side["a"].join(cut.select("lang", "cb", F.col("rb").alias("a"), "v", F.size("terms").alias("columns")),
                          ["lang", "cb", "a"])
           .join(side["b"], ["lang", "cb"]).filter("a <= b"))
    apart = stored(met.mapInArrow(_walk(depth, added, scale), "lang string, a int, b int, i int, j int, value long")
                   .groupBy("lang", "a", "b", "i", "j").agg(F.sum("value").alias("value")), "pair_sums")
    both = stacked([apart, apart.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("j").alias("i"),
                                        F.col("i").alias("j"), "value")])
    name = named.select("lang", "source", "rb", "row")
    pairs = (both.join(name.toDF("lang", "source", "a", "i"), ["lang", "a", "i"])
             .join(name.toDF("lang", "item", "b", "j"), ["lang", "b", "j"])
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    terms = (cut.select("lang", "rb", "bits", "cells", "n", "v", "total", "terms", "sums")
             .mapInArrow(_excess(depth, added, scale, top), "lang string, rb int, row int, item string, value long")
             .join(name, ["lang", "rb", "row"])
             .select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    order = [F.col("value").desc(), F.col("item")]
    everything = 2 ** 31 - 2
    ranked = stacked([top_k(pairs, ["lang", "source", "part"], order, everything),
                      top_k(terms, ["lang", "source", "part"], order, top)])
    return ranked.withColumn("rank", F.col("rank") + 1).select("lang", "source", "part", "item", "value", "rank")


@query("op13_source_divergence", r"""
  with t as (
    select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
  w as (select rid, lang, source, unnest(terms) as term from t),
  kept as (select lang, term, count(*) as n from w group by all having count(distinct rid) >= 30),
  g as (select distinct lang, source from t),
  l as (select lang, count(*) as v, sum(n) as total from kept group by lang),
  c as (select w.lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
  s as (select lang, source, sum(n) as n from c group by all),
  grid as materialized (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
      (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v))::bigint as p,
      (1 + (1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v))::bigint as q
    from g join kept k using (lang) join l using (lang) left join s using (lang, source)
      left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
  d as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
        from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
  pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
            from g a join g b on a.lang = b.lang and a.source <> b.source
              left join d on d.lang = a.lang and d.source = a.source and d.item = b.source),
  terms as (select lang, source, 'term' as part, term as item, p - q as value from grid where n > 0 and p > q)
  select lang, source, part, item, value::bigint as value,
    (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
  from (select * from pairs union all select * from terms)
  qualify part = 'pair' or rank <= 50""")
def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
