import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = "collection_digest upsert_items import_report count_platforms clean_original_text extract_keywords heuristic_analysis merge_model_replies export_markdown validate_import page_metadata visible_text merge_pages xhs_metadata".split()


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", NAMES)
def test_query_as_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, found.fetchall()))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
