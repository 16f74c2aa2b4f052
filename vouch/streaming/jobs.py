"""The incremental jobs: listing ingest, report threshold, usage windows, recheck."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vouch import fixed_values as fv
from vouch.functions.signals import Lexicon

Sink = Callable[[DataFrame, int], None]


def fresh_listings(stream: DataFrame, ts: str = "fetched_at", delay: str = "1 day") -> DataFrame:
    """Listings of a stream once per record inside the watermark."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.dropDuplicatesWithinWatermark(["source_id", "external_id"])


def listing_ingest(stream: DataFrame, root: str, cities: DataFrame, block_list: DataFrame, *,
                   lexicon: Lexicon | None = None, checkpoint: str) -> DataStreamWriter:
    """Merge every micro-batch of listings into the tables under ``root``.

    Each batch writes a new version folder named after the batch, from the version before
    it. A batch that is replayed after a failure starts from the same version again, so it
    has the same result. Deduplication is left to the merge, which is keyed.
    """
    from vouch.plans.index import Tables, assign_city, merge_listings, score_all

    lexicon = lexicon or Lexicon.default()

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tables = (Tables.read(spark, version_path(root, batch_id - 1)) if batch_id > 0
                  else Tables.empty(spark))
        latest = batch.groupBy("source_id", "external_id").agg(
            F.max_by(F.struct(*[c for c in batch.columns if c not in (
                "source_id", "external_id")]), "fetched_at").alias("_r"))
        rows = latest.select("source_id", "external_id", "_r.*")
        at = rows.agg(F.max("fetched_at").cast("string")).first()[0] or "1970-01-01"
        out, _ = merge_listings(tables, assign_city(rows, cities), block_list, lexicon, at)
        score_all(out).write(version_path(root, batch_id))

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .outputMode("append"))


def version_path(root: str, batch_id: int) -> str:
    return f"{root}/version={batch_id:012d}"


def report_counts(reports: DataFrame, reason: str, cut: int = fv.HIDE_AFTER_REPORTS) -> DataFrame:
    """Reports per entity for one reason, over a table or a stream (update mode); ``hide`` from the
    cut on."""
    counted = reports.where(F.col("reason") == reason).groupBy("business_id").agg(
        F.count(F.lit(1)).alias("reports"))
    return counted.withColumn("hide", F.col("reports") >= cut)


def report_threshold(stream: DataFrame, reason: str, cut: int = fv.HIDE_AFTER_REPORTS) -> DataFrame:
    """(business_id, reports) once for each entity, in the batch that brings its ``cut``-th report
    of ``reason`` (append mode).

    The state of an entity is a count up to ``cut`` and whether it was told; later reports change
    nothing and write no row. A batch that is replayed starts from the state before it, so the
    event appears once. A null business_id is an entity of its own."""
    rows = stream.where(F.col("reason") == reason).select("business_id")
    kind = rows.schema["business_id"].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, told = state.get if state.exists else (0, False)
        seen = min(cut, seen + sum(len(f) for f in frames))
        if seen >= cut and not told:
            yield pd.DataFrame({"business_id": [key[0]], "reports": [seen]})
        if not told:
            state.update((seen, seen >= cut))

    return rows.groupBy("business_id").applyInPandasWithState(
        step, f"business_id {kind}, reports long", "seen long, told boolean", "append",
        GroupStateTimeout.NoTimeout)


def usage_days(stream: DataFrame, client: str, ts: str, *, cap: int | None = None,
               delay: str | None = "1 day") -> DataFrame:
    """Rows per client and UTC day, once the watermark has passed the day (append mode), when its
    state goes. Rows later than that are dropped; ``late_rows`` counts them on the finished table.
    Without a ``delay`` (update mode) every row counts, however late, and open days show too; the
    state then keeps all days."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    if delay is not None:
        timed = timed.withWatermark(ts, delay)
    counted = timed.groupBy(F.window(ts, "1 day"), client).agg(F.count(F.lit(1)).alias("n"))
    over = [] if cap is None else [(F.col("n") > cap).alias("over_cap")]
    return counted.select(F.to_date("window.start").alias("day"), client, "n", *over)


def late_rows(events: DataFrame, days: DataFrame, client: str, ts: str) -> DataFrame:
    """(day, client, late): how many rows of a closed day are in the landed ``events`` and not in
    its count. Days still open are left out."""
    landed = events.groupBy(F.to_date(F.col(ts).cast("timestamp")).alias("day"), client).agg(
        F.count(F.lit(1)).alias("landed"))
    closed = days.select("day").distinct()
    found = landed.join(closed, "day", "left_semi").join(
        days.select("day", client, "n"), ["day", client], "left")
    late = F.col("landed") - F.coalesce("n", F.lit(0))
    return found.select("day", client, late.alias("late")).where("late > 0")


def usage_months(days: DataFrame, source: str, caps: DataFrame) -> DataFrame:
    """Requests per source and month against the cap of the source, from the closed days: a month
    keeps no state in the stream."""
    counted = days.groupBy(F.date_format("day", "yyyy-MM").alias("period"), source).agg(
        F.sum("n").alias("used"))
    joined = counted.join(caps, source, "left")
    return joined.withColumn("over_cap", F.coalesce(F.col("used") > F.col("monthly_cap"),
                                                    F.lit(False)))


def recheck_timer(checks: DataFrame, key: str, days: int = fv.RECHECK_DAYS, ts: str = "checked_at",
                  delay: str = "0 seconds") -> DataFrame:
    """(key, last_checked) once for each time that a key becomes due (append mode).

    ``checks``: key, checked_at, retryable. A final check sets the key's timer ``days`` later, by
    event time; the key is due when the watermark passes it, without a scan of the others, and its
    state goes. A key whose first outcomes are all retryable is due at once, with a null
    last_checked, and keeps a mark until a final check. A null key is a key of its own."""
    timed = checks.select(key, F.col(ts).cast("timestamp").alias(ts), "retryable").withWatermark(
        ts, delay)
    kind = timed.schema[key].dataType.simpleString()
    wait = int(days) * 86_400_000

    def due(value, last: int | None) -> pd.DataFrame:
        return pd.DataFrame({key: [value], "last_checked": [
            None if last is None else pd.Timestamp(last, unit="us")]})

    def step(value: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield due(value[0], last)
            return
        known = state.exists
        last = state.get[0] if known else None
        for frame in frames:
            final = frame.loc[~frame["retryable"].astype(bool), ts].max()
            if pd.notna(final):
                micros = int(pd.Timestamp(final).value // 1000)
                last = micros if last is None else max(last, micros)
        if last is None:
            if not known:
                state.update((None,))
                yield due(value[0], None)
            return
        at = last // 1000 + wait
        if at <= state.getCurrentWatermarkMs():  # so late a check that it is past already
            if known:
                state.remove()
            yield due(value[0], last)
            return
        state.update((last,))
        state.setTimeoutTimestamp(at)

    return timed.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, last_checked timestamp", "last long", "append",
        GroupStateTimeout.EventTimeTimeout)


def due_for_recheck(checks: DataFrame, key: str, now: str, days: int = fv.RECHECK_DAYS,
                    ts: str = "checked_at") -> DataFrame:
    """(key, last_checked) not checked finally since the cut; a retryable outcome is no check.

    ``checks``: key, checked_at, retryable; a table. ``recheck_timer`` is the stream's form."""
    old = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    final = F.when(~F.col("retryable"), F.col(ts).cast("timestamp"))
    last = checks.groupBy(key).agg(F.max(final).alias("last_checked"))
    return last.where(F.col("last_checked").isNull() | (F.col("last_checked") < old))
