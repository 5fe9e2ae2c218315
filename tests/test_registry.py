"""Every registered query runs with a stable schema; a spread of them is compared with its SQL twin."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from tools.check import TABLES, compare

SPREAD = ["s2_read_queue", "b7_detect_platform", "b13_fingerprint", "c2_recall", "c4_label_hits", "d1_top_terms", "d2_dictionary_hits", "e1_coverage", "e10_match_quals", "f5_language_flags", "f9_prose_score",
          "g3_tenure", "g8_unify_profiles", "h6_canonical_location", "i8_scan_payloads", "i10_send_policy", "j1_ingest_trace", "j4_sessions_batch", "j10_pair_spans"]


@pytest.fixture(scope="session")
def db(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def test_oracles_belong_to_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", SPREAD)
def test_query_equals_sql(name, spark, sf, db):
    left = entry_point.queries()[name](spark, sf).toPandas()
    assert compare(left, db.execute(entry_point.oracle_sql()[name]).fetchdf()) == ""


def test_partition_count_does_not_matter(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, entry_point.queries()["d9_classify_roi"](spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
