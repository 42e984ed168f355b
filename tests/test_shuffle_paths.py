"""The same queries with broadcasting switched off: the sort-merge / pre-aggregated
paths that large inputs take must give the same answers as the oracle."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, digest

from small_data import SF_SMALL

NAMES = ["select_round0_docs", "vocab_trusted", "leak_free_lines", "leak_matches", "numericalize_pairs",
         "ibm1_scores_pairs", "translate_requests", "spelling_normalise_candidates", "autocorrect_requests"]


@pytest.fixture(scope="module")
def no_broadcast(spark):
    spark.conf.set("corpusforge.broadcast.maxBytes", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("corpusforge.broadcast.maxBytes")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", NAMES)
def test_without_broadcast(no_broadcast, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = entry.queries()[name](no_broadcast, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    orows, ocols = cur.fetchall(), [d[0] for d in cur.description]
    assert digest(rows, df.columns)[0] == digest(orows, ocols)[0]
