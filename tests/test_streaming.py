"""Streams over landed files."""

import json
import os
import random

from pyspark.sql import functions as F

from vouch import schemas
from vouch.plans.index import Tables
from vouch.streaming import jobs


def land(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))


def test_listing_ingest_merges_every_batch(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "tables"
    source.mkdir()
    cities = spark.createDataFrame(
        [(1, "toronto", "CA", "Toronto", -79.70, 43.55, -79.10, 43.95, [], [], True)], schemas.CITY)
    none = spark.createDataFrame([], schemas.BLOCKED)
    schema = schemas.T.StructType([*schemas.LISTING.fields,
                                   schemas.T.StructField("fetched_at", schemas.TS)])

    def row(ident, name, at, lat=43.7):
        return {"source_id": "osm", "external_id": ident, "name": name, "lat": lat, "lng": -79.4,
                "category": "restaurant", "phones": [], "urls": [], "signals": [],
                "texts": [{"kind": "name", "text": name}], "private_location": False,
                "fetched_at": at}

    def ingest():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        q = jobs.listing_ingest(stream, str(root), cities, none,
                                checkpoint=str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    land(source, "a.json", [row("1", "Tehran Market", "2026-01-01T00:00:00"),
                            row("2", "Joe's Pizza", "2026-01-01T00:00:00")])
    ingest()
    land(source, "b.json", [row("1", "Tehran Persian Market", "2026-01-02T00:00:00"),
                            row("3", "Shiraz Grill", "2026-01-02T00:00:00", 43.8)])
    ingest()
    out = Tables.read(spark, jobs.version_path(str(root), 1))
    assert {r.external_id for r in out.records.collect()} == {"1", "3"}
    got = {r.name_latin: r.score for r in out.entities.collect()}
    assert got == {"Tehran Market": 0.72, "Shiraz Grill": 0.3}
    assert Tables.read(spark, jobs.version_path(str(root), 0)).records.count() == 1


def run_stream(spark, df, name):
    q = (df.writeStream.format("memory").queryName(name).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


def test_reports_tell_once(spark, tmp_path):
    """Three batches: one event for each entity, in the batch of its third report."""
    rng = random.Random(3)
    rows = [{"business_id": f"b{rng.randrange(9)}", "reason": rng.choice(["not_iranian", "closed"])}
            for _ in range(60)]
    for i in range(3):
        land(tmp_path, f"{i}.json", rows[i::3])
    stream = spark.readStream.schema("business_id string, reason string").option(
        "maxFilesPerTrigger", 1).json(str(tmp_path))
    got = run_stream(spark, jobs.report_threshold(stream, "not_iranian"), "hidden")
    batch = jobs.report_counts(spark.createDataFrame(rows), "not_iranian").where("hide").collect()
    assert sorted(got) == sorted((r.business_id, 3) for r in batch) and 1 < len(got) < 9


def test_a_key_becomes_due_when_its_timer_fires(spark, tmp_path):
    def check(key, at, retryable=False):
        return {"k": key, "checked_at": f"2026-{at} 00:00:00", "retryable": retryable}

    land(tmp_path, "0.json", [check("old", "01-01"), check("again", "01-01"), check("never", "01-02", True)])
    land(tmp_path, "1.json", [check("again", "01-20"), check("never", "01-21", True)])
    land(tmp_path, "2.json", [check("clock", "02-05"), check("never", "02-05", True)])
    land(tmp_path, "3.json", [check("clock", "02-10")])
    for i in range(4):
        os.utime(tmp_path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("k string, checked_at string, retryable boolean").option(
        "maxFilesPerTrigger", 1).json(str(tmp_path))
    got = run_stream(spark, jobs.recheck_timer(stream, "k", days=30), "due")
    assert sorted((k, str(at)[:10] if at else None) for k, at in got) == [
        ("never", None), ("old", "2026-01-01")]


def test_closed_days_and_late_rows(spark, tmp_path):
    def use(client, at):
        return {"client": client, "ts": f"2026-01-{at}"}

    land(tmp_path, "0.json", [use("a", "01 10:00:00"), use("a", "01 11:00:00"), use("b", "02 09:00:00")])
    land(tmp_path, "1.json", [use("b", "05 00:00:00")])
    # a batch drops what was late to the watermark that the batch before it began with
    land(tmp_path, "2.json", [use("b", "05 12:00:00")])
    land(tmp_path, "3.json", [use("a", "01 12:00:00"), use("c", "01 12:00:00"), use("b", "06 00:00:00")])
    for i in range(4):  # files are taken in the order of their times
        os.utime(tmp_path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    schema = "client string, ts string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    got = run_stream(spark, jobs.usage_days(stream, "client", "ts", cap=1), "days")
    assert sorted((str(d), c, n, over) for d, c, n, over in got) == [
        ("2026-01-01", "a", 2, True), ("2026-01-02", "b", 1, False)]
    late = jobs.late_rows(spark.read.schema(schema).json(str(tmp_path)), spark.table("days"),
                          "client", "ts")
    assert sorted((str(r.day), r.client, r.late) for r in late.collect()) == [
        ("2026-01-01", "a", 1), ("2026-01-01", "c", 1)]
    caps = spark.createDataFrame([("a", 1)], "client string, monthly_cap int")
    assert {tuple(r) for r in jobs.usage_months(spark.table("days"), "client", caps).select(
        "client", "period", "used", "over_cap").collect()} == {
        ("a", "2026-01", 2, True), ("b", "2026-01", 1, False)}
