"""Registered queries of the package against their SQL twins, and the driver contract."""

import os
import zlib

import pytest
from harness import compare

from fieldseq.llm.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    difference, _, _ = compare(spark, name, QUERIES[name], ORACLES[name], SF)
    assert difference is None, difference


#: Table, id, columns that come first, and divisor and remainder of the held-out rows.
WITHOUT_SQL = {
    "op4_url_filter": ("pages", "page_id", "host string, path string, rule string, verdict string", None),
    "op5_line_crf_quality": ("documents", "doc_id", "held_out boolean, score double, predicted int", (3, 1)),
    "op6_ngram_lm_scores": ("documents", "doc_id", "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                            "base_score double, score double", (5, 1)),
    "op7_language_id": ("documents", "doc_id", "held_out boolean, lang_pred string, score double", (4, 2)),
    "op9_source_mix": ("documents", "doc_id", "size bigint, source_size bigint, target double, taken bigint", None),
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_contract_of_queries_without_sql(spark, name):
    """One row per row of the table, the promised columns with their types, the promised rows held out."""
    table, key, columns, held = WITHOUT_SQL[name]
    out = QUERIES[name](spark, SF)
    types = dict(out.dtypes)
    assert [f"{c} {types[c]}" for c in out.columns][1:1 + columns.count(",") + 1] == columns.split(", ")
    assert out.columns[0] == key
    rows = out.collect()
    ids = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()]
    assert sorted(r[key] for r in rows) == sorted(ids)
    if held:
        assert all(r.held_out == (zlib.crc32(str(r[key]).encode()) % held[0] == held[1]) for r in rows)
    if "score" in types and name != "op6_ngram_lm_scores":
        assert all(0 <= r.score <= 1 for r in rows)


def test_entry_lists_the_queries():
    import __spark_entry__ as entry
    names = entry.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
