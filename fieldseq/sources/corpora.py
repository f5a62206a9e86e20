"""Small hand-written corpora: queries, paraphrases and labels."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from fieldseq.operators.filters import Filters
from fieldseq.plans.eval_set import query_table


def read_yaml(path: str) -> Any:
    """Parsed YAML file; needs the optional yaml package."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML corpora needs the yaml package") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def queries(spark: SparkSession, entries: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Query table from entries with id, text, filters and sequence_hint."""
    chosen = {}
    for e in entries:
        given = dict(e.get("filters") or {})
        given["must_include"] = tuple(given.get("must_include") or ())
        chosen[e["id"]] = (e["text"], Filters(**given), e.get("sequence_hint", ""))
    return query_table(spark, chosen)


def paraphrases(spark: SparkSession, entries: Iterable[Mapping[str, Any]]) -> DataFrame:
    rows = [(e["id"], e["text"], bool(e.get("expect_fail", False))) for e in entries]
    return spark.createDataFrame(rows, "qid string, text string, expected_failure boolean")
