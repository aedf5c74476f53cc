"""Every query of the catalog with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from scriptorium.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted((tuple(map(str, r)) for r in got.select(columns).collect()))
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(str(r[i]) for i in at) for r in found.fetchall())


def test_published_hit_counts(spark):
    rows = {(r.strategy, r.max_lines, r.family): (r.hits, r.total) for r in catalog.eval_strategies(spark, SF).collect()}
    assert rows["fixed_lines", 6, "all"] == (5, 11)
    assert rows["markdown_heading", 6, "all"] == (8, 11)
    assert rows["fixed_lines", 6, "doc_section"] == (2, 5)
    assert rows["markdown_heading", 6, "doc_section"] == (5, 5)


def test_hit_counts_of_the_first_eight(spark):
    from scriptorium.config import ChunkConfig
    from scriptorium.operators import evaluate
    from scriptorium.plans import samples

    cases = spark.createDataFrame(samples.CASES[:8], evaluate.CASE)
    hits = {c.strategy: evaluate.outcomes(cases, c).filter("hit").count() for c in (ChunkConfig("fixed_lines", 3), ChunkConfig("code_ast", 3))}
    assert hits == {"fixed_lines": 4, "code_ast": 7}
