"""The user-facing jobs: tables of requests in, result tables out.

Each job returns DataFrames by name, described when first asked for. Results are ordered by `rank` within
`qid`; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldseq.operators import filters, fuse, notes, phrase_plan, predicate_index, results, shapes
from fieldseq.operators.bounded import BlockIndex
from fieldseq.operators.filters import FILTER_TYPE, Filters
from fieldseq.operators.sparse import SparseIndex
from fieldseq.spec import SUMMARY_COLUMNS, ZONES

SHOWN = ("match_id", "possession", *SUMMARY_COLUMNS[2:])


class Tables(Mapping[str, DataFrame]):
    """Named result tables; a table nobody asks for costs nothing."""

    def __init__(self, **makers: Callable[[], DataFrame]) -> None:
        self._makers = makers
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def _page(ranked: DataFrame, items: DataFrame, shots: DataFrame | None) -> DataFrame:
    page = fuse.hydrate(ranked, items, SHOWN)
    return page if shots is None else results.attach_model_xg(page, shots)


def _shown(page: DataFrame) -> DataFrame:
    return results.summaries(page, ("qid", "rank", "score"))


def translate(texts: DataFrame, items: DataFrame, aggressive: bool = False) -> DataFrame:
    """Texts (qid, text) to filters and hints; names are taken from the items."""
    teams = items.select(F.col("team").alias("name")).filter("name is not null").distinct()
    competitions = (items.select(F.col("competition").alias("name"))
                    .filter("name is not null").distinct())
    return phrase_plan.plan(texts, teams, competitions, aggressive=aggressive)


def with_explicit(plans: DataFrame, explicit: DataFrame) -> DataFrame:
    """Translated queries in which explicitly given filters and hints win.

    `explicit` has qid, `filters` (struct, fields may be null) and `hint`.
    """
    given = explicit.select("qid", F.col("filters").alias("_f"), F.col("hint").alias("_h"))
    joined = plans.join(given, "qid", "left")
    empty = F.lit(None).cast(FILTER_TYPE)
    return joined.select(
        "qid", "text", filters.merged(F.col("filters"), F.coalesce("_f", empty)).alias("filters"),
        F.coalesce("_h", "hint").alias("hint"), "terms", "ignored")


def search(queries: DataFrame, items: DataFrame, index: SparseIndex,
           vectors: DataFrame | None = None, shots: DataFrame | None = None,
           limit: int = fuse.LIMIT, blocks: BlockIndex | None = None) -> Tables:
    """Hybrid search for a table of queries (qid, filters, hint[, embedding]).

    Gives `results`, `rankings` (per ranker), `counts` (items passing each query's
    filters), `notes` and `given`. `shots` with a `my_xg` column adds model totals; `blocks`
    (`bounded.in_blocks` of the index) spares the sparse ranking most matches.
    """
    found = fuse.hybrid(queries, items, index, F.split("hint", " "), vectors, limit, blocks=blocks)
    page = _page(found["fused"], items, shots)
    given = queries.select("qid", filters.given_fields(F.col("filters")).alias("given"))

    def rankings() -> DataFrame:
        return fuse.pooled({k: v.filter(F.col("rank") < limit) for k, v in found.items()
                            if k in ("sparse", "dense")}, index.id_col)
    return Tables(results=lambda: _shown(page), rankings=rankings,
                  counts=lambda: predicate_index.counts(found["needs"], found["held"], index.id_col),
                  notes=lambda: notes.claims(page, given), given=lambda: given,
                  page=lambda: page)


def shape(drawings: Mapping[str, Sequence[str]], items: DataFrame,
          wanted: Mapping[str, Filters] | None = None, shots: DataFrame | None = None,
          limit: int = fuse.LIMIT) -> Tables:
    """Possessions holding drawn zone sequences. A zone off the grid is an error."""
    wanted = wanted or {}
    unknown = sorted({z for zones in drawings.values() for z in zones} - set(ZONES))
    if unknown or not all(drawings.values()):
        raise ValueError(f"unknown zones {unknown} or an empty shape; zones are {list(ZONES)}")
    page = _page(fuse.shape_search(items, drawings, wanted, limit), items, shots)
    given = items.sparkSession.createDataFrame(
        [(q, [*wanted.get(q, Filters()).given(), "end_zone"]) for q in drawings],
        "qid string, given array<string>")
    return Tables(
        results=lambda: _shown(page), notes=lambda: notes.claims(page, given), page=lambda: page,
        counts=lambda: fuse.shape_counts(fuse.shape_matches(items, drawings, wanted)))


def shape_table(drawings: DataFrame, items: DataFrame, shots: DataFrame | None = None,
                limit: int = fuse.LIMIT) -> Tables:
    """As `shape`, for a table of shapes (qid, zones, filters); `unknown` lists unusable ones."""
    found = shapes.matches(items, drawings)
    page = _page(fuse.by_coverage(found, limit), items, shots)
    given = drawings.select("qid", F.concat(filters.given_fields(F.col("filters")), F.array(F.lit("end_zone")))
                            .alias("given"))
    return Tables(results=lambda: _shown(page), notes=lambda: notes.claims(page, given), page=lambda: page,
                  counts=lambda: fuse.shape_counts(found), unknown=lambda: shapes.unknown_shapes(drawings))


def similar(seeds: DataFrame, items: DataFrame, index: SparseIndex,
            vectors: DataFrame | None = None, shots: DataFrame | None = None,
            limit: int = fuse.LIMIT) -> Tables:
    """More like each seed (qid, id[, filters]); `unknown` lists seeds that are not indexed."""
    found = fuse.similar(seeds, index, vectors, limit, items=items)
    page = _page(found["fused"], items, shots)
    return Tables(results=lambda: _shown(page), notes=lambda: notes.claims(page),
                  page=lambda: page, unknown=lambda: fuse.unknown_seeds(seeds, index))


def possession(asked: DataFrame, items: DataFrame, events: DataFrame,
               shots: DataFrame) -> Tables:
    """Everything about the asked possessions (uid): summary, events, steps, frame, shots."""
    rows = items.join(asked.select("uid").distinct(), "uid", "left_semi")
    details = results.detail(events, rows)
    own = shots.join(rows.select("match_id", "possession"), ["match_id", "possession"], "left_semi")
    return Tables(
        summary=lambda: results.summaries(results.attach_model_xg(rows, shots)),
        events=lambda: details, steps=lambda: results.playback(details),
        freeze_frame=lambda: results.last_frame(details, shots),
        shots=lambda: results.shots_of(details, shots), panel=lambda: results.shot_panel(own))
