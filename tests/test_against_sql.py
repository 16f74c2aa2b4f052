"""Registered queries against their check SQL on small tables made for one case each."""

from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import check
import __spark_entry__ as entry
from vouch.streaming import jobs
from vouch.workload import life


def same(spark, folder, name, **tables):
    """The query's rows on the given tables; they must equal the rows of its SQL."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), folder / f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = entry.queries()[name](spark, str(folder))
    mine = check.rows(df.columns, df.collect())
    rel = con.sql(entry.oracle_sql()[name])
    assert mine == check.rows(rel.columns, rel.fetchall())
    return mine[1]


CUT = ('<html lang="en"><title>Fish &amp; token = &quot;7 &am{}p</title><body><h1>A &amp; B &amp</h1>'
       '<p>x &quot;y&quot; &copy; z &amp &#39;</p></body></html>')
PAGES = {"page_id": [1, 2], "url": ["http://a.example/1", "http://a.example/2"],
         "html": [CUT.format(""), CUT.format(";")]}


@pytest.mark.parametrize("name", ["fn_22_page_text", "sc_14_directory_pages"])
def test_cut_references_stay_text(spark, tmp_path, name):
    assert len(same(spark, tmp_path, name, pages=PAGES)) == 2


EVENTS = {
    "event_id": list(range(30)), "user_id": [1] * 25 + [2] * 5, "event_type": ["error"] * 30,
    "ts": [datetime(2024, 1, 1 + i % 3, 5) for i in range(30)], "value": [1.0] * 30}


@pytest.mark.parametrize(("name", "rows"), [
    ("ss_2_report_threshold", 2), ("ss_3_usage_days", 6), ("ss_3_usage_months", 1)])
def test_streams_tell_all_counts(spark, tmp_path, name, rows):
    # also entities below the threshold and days that are still open
    assert len(same(spark, tmp_path, name, events=EVENTS)) == rows


def test_the_newest_row_of_every_batch_counts(spark, tmp_path):
    # the second file brings a late day and a day that the first one has
    for i, days in enumerate([[3, 3, 4], [1, 3]]):
        ts = [datetime(2024, 1, d, 5) for d in days]
        pq.write_table(pa.table({"user_id": [1] * len(days), "ts": ts}), tmp_path / f"{i}.parquet")
    stream = spark.readStream.schema("user_id long, ts timestamp_ntz").option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path))
    days = life.drain(jobs.usage_days(stream, "user_id", "ts", cap=2, delay=None), "update",
                      ["day", "user_id"])
    assert sorted((r.day.day, r.n, r.over_cap) for r in days.collect()) == [
        (1, 1, False), (3, 3, True), (4, 1, False)]


PLACES = {
    "nation": {"n_nationkey": [0], "n_name": ["A"], "n_regionkey": [0]},
    "part": {"p_partkey": [1, 2, 3], "p_name": ["red gear", "blue ring", "small rod"]},
    "customer": {"c_custkey": [1, 2, 3], "c_nationkey": [0] * 3, "c_mktsegment": ["X"] * 3},
    "supplier": {"s_suppkey": [1, 3], "s_nationkey": [0] * 2}}


@pytest.mark.parametrize("name", ["fn_9_name_similarity", "fn_29_geo_distance"])
def test_all_pairs_are_measured(spark, tmp_path, name):
    # names that are not alike and spots far apart as well
    assert len(same(spark, tmp_path, name, **PLACES)) == 6
