"""Submissions, reports, owner edits, labels."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions.links import listing_links, phone_e164, website_link
from vouch.functions.signals import Lexicon, field_signals, signal_score, strongest
from vouch.operators import upsert
from vouch.operators.filters import drop_blocked
from vouch.operators.matching import link_match
from vouch.operators.ranking import first_by
from vouch.sources.listing import make, signal, source, text_field, texts

DECISIONS = {"hide": "hidden", "close": "closed", "restore": "active",
             "remove": "removed_by_request"}
OWNER_STATUSES = ("active", "closed", "hidden")


@source("user_submission")
def submission_listings(submissions: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Approved submissions as listings with a verified signal."""
    url = F.get("links", F.lit(0))
    who = F.when(F.col("is_owner"), "owner").otherwise("community")
    return make(
        submissions, keep, source_id=F.lit("user_submission"),
        external_id=F.col("submission_id").cast("string"), name="name", url=url,
        address="address", category="category", urls="links",
        phones=F.array_compact(F.array(F.nullif("phone", F.lit("")))),
        texts=texts(text_field("name", F.col("name"), url)),
        signals=F.array(signal(fv.VERIFIED_SIGNAL, F.lit(True),
                               F.concat(F.lit("submitted by the "), who, F.lit(", approved")),
                               url)),
        raw=F.to_json(F.struct("name", who.alias("submitted_by"))))


def score_submissions(submissions: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(submission_id, detected_score): what the name alone says, nothing stored."""
    df = submissions.select("submission_id", F.col("name").alias("text"),
                            F.lit("name").alias("kind"), F.lit(None).cast("string").alias("url"))
    found = field_signals(df, lexicon)
    return found.select("submission_id",
                        signal_score(strongest(F.col("signals"))).alias("detected_score"))


def possible_duplicates(submissions: DataFrame, entities: DataFrame,
                        entity_links: DataFrame) -> DataFrame:
    """(submission_id, business_id) of submissions that share a link with an entity of their
    city, whatever the distance."""
    rows = submissions.select(
        "submission_id", "city_id", F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lng"),
        listing_links("links", F.array_compact(F.array("phone")), "country_code").alias("links"))
    return link_match(rows, entities, entity_links, key=["submission_id"])


def approve_submissions(tables, submissions: DataFrame, block_list: DataFrame,
                        lexicon: Lexicon, at: str) -> dict:
    """Merge approved submissions (with city_id and country_code) like any other listings;
    hidden entities they merge with are shown again; blocked ones are reported."""
    from vouch.plans.index import merge_listings, score_all

    listings = submission_listings(submissions, keep=["city_id", "country_code"])
    out, seen = merge_listings(tables, listings, block_list, lexicon, at)
    mine = out.records.join(
        listings.select("source_id", "external_id"), ["source_id", "external_id"], "left_semi")
    shown = mine.select("business_id").distinct().withColumn("_mine", F.lit(True))
    entities = out.entities.join(shown, "business_id", "left").withColumn(
        "status", F.when(F.col("_mine") & (F.col("status") == "hidden"), "active")
        .otherwise(F.col("status"))).drop("_mine")
    links = listing_links("urls", "phones", "country_code").alias("links")
    with_links = listings.select("source_id", "external_id", links)
    fine = drop_blocked(with_links, block_list, ["source_id", "external_id"])
    blocked = with_links.join(fine, ["source_id", "external_id"], "left_anti").select(
        F.col("external_id").alias("submission_id"))
    return {"tables": score_all(replace(out, entities=entities)), "blocked": blocked,
            "stored": seen}


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision per entity: (business_id, action, decided_at, decision_id)."""
    newest = decisions.groupBy("business_id").agg(F.max(F.struct(
        "decided_at", "decision_id", "action"))["action"].alias("action"))
    return newest


def apply_decisions(entities: DataFrame, reports: DataFrame, links: DataFrame,
                    block_list: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Entities, reports and block list after decisions.

    The last decision of an entity that changes its status wins. Every decided entity has
    all its open reports closed: resolved, or dismissed when its last decision is
    'dismiss'. Removal ever blocks the links of the entity."""
    acting = decisions.where(F.col("action") != "dismiss")
    chain = None
    for action, status in DECISIONS.items():
        chain = (F if chain is None else chain).when(F.col("action") == action, status)
    status = latest_decisions(acting).select("business_id", chain.alias("_status"))
    ent = entities.join(status, "business_id", "left").withColumn(
        "status", F.coalesce("_status", "status")).drop("_status")
    last = latest_decisions(decisions).withColumnRenamed("action", "_action")
    rep = reports.join(last, "business_id", "left")
    closing = (F.col("status") == "open") & F.col("_action").isNotNull()
    rep = rep.withColumn("status", F.when(closing, F.when(
        F.col("_action") == "dismiss", "dismissed").otherwise("resolved")).otherwise(
        F.col("status"))).drop("_action")
    removed = decisions.where(F.col("action") == "remove").select("business_id").distinct()
    fresh = upsert.new_block_entries(removed, links, block_list)
    return {"entities": ent, "reports": rep,
            "block_list": block_list.select("kind", "value").unionByName(fresh)}


def hide_reported(entities: DataFrame, counts: DataFrame) -> DataFrame:
    """Active entities with enough reports become hidden (counts: business_id, hide)."""
    joined = entities.join(counts.where("hide").select("business_id", F.lit(True).alias("_h")),
                           "business_id", "left")
    hide = F.coalesce("_h", F.lit(False)) & (F.col("status") == "active")
    return joined.withColumn("status", F.when(hide, "hidden").otherwise(F.col("status"))).drop(
        "_h")


def apply_owner_edits(entities: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """Entities after owner corrections, and the refused edits with a reason.

    ``edits``: edit_id, business_id, edited_at, country_code and the fields; a blank field
    changes nothing. An edit with a bad website, telephone number or status is refused as a
    whole. The newest valid value of every field wins."""
    site = website_link("website")
    phone = phone_e164("phone", "country_code")
    some = {c: F.nullif(F.trim(c), F.lit("")) for c in
            ("name_fa", "name_latin", "address", "phone", "website", "status")}
    checked = edits.withColumns({
        "_site": F.when(some["website"].isNotNull(), site["url"]),
        "_phone": F.when(some["phone"].isNotNull(), phone)})
    reason = (F.when(some["phone"].isNotNull() & F.col("_phone").isNull(), "not a phone number")
              .when(some["website"].isNotNull() & F.col("_site").isNull(),
                    "not a website address")
              .when(~some["status"].isin(*OWNER_STATUSES),
                    "status must be active, closed or hidden"))
    checked = checked.withColumn("_reason", reason)
    good = checked.where(F.col("_reason").isNull())
    values = {"name_fa": some["name_fa"], "name_latin": some["name_latin"],
              "address": some["address"], "phone_e164": F.col("_phone"),
              "website": F.col("_site"), "status": some["status"]}
    folded = good.groupBy("business_id").agg(
        *[F.max(F.when(v.isNotNull(), F.struct("edited_at", "edit_id", v.alias("v"))))["v"]
          .alias(f"_n_{n}") for n, v in values.items()],
        F.max("edited_at").alias("_verified"))
    out = entities.join(folded, "business_id", "left")
    out = out.withColumns({n: F.coalesce(f"_n_{n}", n) for n in values})
    if "owner_verified_at" in entities.columns:
        out = out.withColumn("owner_verified_at", F.coalesce("_verified", "owner_verified_at"))
    refused = checked.where(F.col("_reason").isNotNull()).select(
        "edit_id", F.col("_reason").alias("reason"))
    return {"entities": out.select(*entities.columns), "refused": refused}


def upsert_labels(labels: DataFrame, verdicts: DataFrame, entities: DataFrame) -> DataFrame:
    """Labels with the newest verdict per entity; the score is frozen when it is labelled."""
    newest = verdicts.groupBy("business_id").agg(F.max(F.struct(
        "labeled_at", "verdict_id", "verdict", "labeled_by")).alias("n"))
    scored = newest.join(entities.select("business_id", "score"), "business_id").select(
        "business_id", "n.verdict", "n.labeled_by", "n.labeled_at",
        F.col("score").alias("score_at_label"))
    return upsert.upsert(labels, scored, ["business_id"])


def review_queue(rows: DataFrame, status: str, cities: DataFrame, categories: DataFrame,
                 cards: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """Rows of one status, oldest first, with city and category names and the entity card."""
    df = rows.where(F.col("status") == status)
    if duplicates is not None:
        df = df.drop("business_id").join(duplicates, "submission_id", "left")
    df = df.join(cities.select("city_id", F.col("name_en").alias("city_name")), "city_id", "left")
    df = df.join(categories.select(F.col("slug").alias("category"),
                                   F.col("name_en").alias("category_name")), "category", "left")
    return df.join(cards, "business_id", "left").orderBy("created_at", "submission_id")


def newest_first(rows: DataFrame, key: list[str], ts: str) -> DataFrame:
    """Newest row per key."""
    return first_by(rows, key, [-F.unix_micros(ts)])
