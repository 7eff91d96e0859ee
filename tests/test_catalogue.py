"""Every registered query with a twin against DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from loomgraph import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def rows(found):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({catalogue.ORACLE[name]})").fetchall()
    assert rows(map(tuple, df.select(*(f"`{c}`" for c in cols)).collect())) == rows(want)


def test_without_a_twin(spark):
    """What SQL can't say: each of these has a test against a plain loop in test_operators."""
    counts = {name: catalogue.QUERIES[name](spark, str(DATA)).count() for name in set(catalogue.QUERIES) - set(catalogue.ORACLE)}
    assert set(counts) == {"greedy_dedupe", "leader_clusters", "clause_chunks", "rag_retrieve", "graph_summary", "eval_fuzzy"}
    assert 0 < counts["greedy_dedupe"] <= 500 and counts["clause_chunks"] >= 3 * 150 and counts["rag_retrieve"] > 0 and counts["graph_summary"] > 20 and counts["eval_fuzzy"] > 0
