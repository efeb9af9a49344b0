"""A sample of the registered queries against their SQL on the smallest tables.

``tools/check_oracle.py`` compares all of them. The paired delta queries need more
customers than these tables have: a draw with one class is an error there.
"""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, table

SF = "/root/testdata/sf0.001"
SAMPLE = ["a17_monthly_gini", "a16_cramers_v", "b1_pooled_delta", "e2_grouped_blend", "e5_quantile_map",
          "j12_risk_sets", "p10_calendar_features", "p18_quantile_bins", "s9_stratified_sample",
          "v8_submission_check", "w6_trajectory", "w14_causal_target_encoding", "m5_naive_bayes"]
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


def test_every_oracle_belongs_to_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    df = entry.queries()[name](spark, SF)
    assert table(df.columns, df.collect()) == want
