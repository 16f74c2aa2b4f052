"""Registered queries of the corpus operators: names, columns, and check SQL."""

import re

import duckdb
import pytest

from check import rows
from vouch.llm.queries import ORACLES, QUERIES
from vouch.workload.views import TABLES

COLUMNS = {
    1: "doc_id held_out n_tokens n_known train_tokens base_score score",
    2: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    3: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    4: "doc_id n_bytes n_removed n_spans kept_sha256",
    5: "vec_id n_links component_id kept",
    6: "doc_id held_out score predicted",
    7: "doc_id n_pieces ids_digest round_trip",
    8: "doc_id size source_size target taken",
    9: "doc_id fingerprint component_id",
    10: "page_id host path rule verdict",
    11: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    12: "doc_id n_words n_hit n_items items_sha256 contaminated",
    13: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op2_personal_data", "op3_media_columns", "op7_max_plus_pieces",
                                  "op8_systematic_mix", "op10_url_rules", "op11_periodic_runs"])
def test_columns_and_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    number = int(re.match(r"op(\d+)_", name)[1])
    assert set(COLUMNS[number].split()) <= set(df.columns)
    table = "pages" if number == 10 else "documents"
    assert df.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_check_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, want = QUERIES[name](spark, sf), con.sql(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
