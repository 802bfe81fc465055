"""Some queries beside their SQL twins on the smallest tables; the driver compares all of them."""

import os

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
NAMES = ["queue_to_read", "stored_states", "delete_cascade", "located_files", "apply_diff", "text_sorted", "highlights", "burst_lines", "burst_components", "best_neighbours", "similar_to", "registered_functions", "item_details"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql_agree(spark, name):
    rows = __spark_entry__.queries()[name](spark, FOLDER).collect()
    db = duckdb.connect()
    for file in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    cursor = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else v
    want = [tuple(plain(v) for v in r) for r in cursor.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in rows]
    assert got and sorted(map(repr, got)) == sorted(map(repr, want))
