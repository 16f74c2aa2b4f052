"""Predicates over whole tables, and joins that only keep or drop rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch.functions import signals as sg
from vouch.functions.links import domain_suffixes
from vouch.functions.text import ColumnOrName, col


def drop_listed_domains(rows: DataFrame, domains: DataFrame, host: str = "host") -> DataFrame:
    """Rows whose host is neither a listed domain nor below one, for a domain table of any
    size: the host's own suffixes are matched by equality."""
    listed = domains.select(F.lower("domain").alias("_suffix")).distinct()
    hosts = rows.select(host).distinct()
    hit = hosts.select(host, F.explode(domain_suffixes(host)).alias("_suffix")).join(
        listed, "_suffix", "left_semi").select(host)
    return rows.join(hit, host, "left_anti")


def name_filter(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Case-insensitive containment in any of the columns."""
    needle = F.lower(F.lit(text))
    test: Column = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False))
    return rows.where(test)


def mask_private(rows: DataFrame) -> DataFrame:
    """Split location into match_* (for matching) and public columns, which are null for
    private rows."""
    public = ~F.coalesce("private_location", F.lit(False))
    return rows.withColumns({
        "match_lat": F.col("lat"), "match_lng": F.col("lng"),
        "address": F.when(public, F.col("address")), "lat": F.when(public, F.col("lat")),
        "lng": F.when(public, F.col("lng")),
    })


def drop_excluded_keywords(rows: DataFrame, lexicon: sg.Lexicon) -> DataFrame:
    """Evidence rows (signal, snippet, url, country) without explicit keywords whose snippet
    only holds words excluded in the country. Only keyword rows of such countries are
    tested, each on its own short snippet."""
    norm = F.col("_norm")
    where = F.upper("country")
    df = rows.withColumn("_norm", sg.tx.fold("snippet"))

    def fires(terms_owner: str | None, terms_all: str | None) -> Column:
        product = norm.rlike(lexicon.pattern("product_terms")) if lexicon.get(
            "product_terms") else F.lit(False)
        owner = norm.rlike(terms_owner) if terms_owner else F.lit(False)
        every = norm.rlike(terms_all) if terms_all else F.lit(False)
        return F.when(product, owner).otherwise(every)

    owner, owner_by = lexicon.explicit_patterns(True)
    every, every_by = lexicon.explicit_patterns(False)
    chain = None
    for code in sorted(lexicon.exclusions):
        chain = (F if chain is None else chain).when(
            where == code, fires(owner_by[code], every_by[code]))
    again = fires(owner, every) if chain is None else chain.otherwise(fires(owner, every))
    keep = (F.col("signal") != "explicit_keyword") | F.col("country").isNull() | again
    return df.where(keep).drop("_norm")


def source_enabled(sources: DataFrame) -> DataFrame:
    """Sources that may run: no account, not rejected, not switched off."""
    return sources.where(~F.coalesce("account_required", F.lit(False))
                         & (F.col("status") != "rejected")
                         & F.coalesce("enabled", F.lit(True)))


def blocked(listing_links: DataFrame, block_list: DataFrame, key: list[str]) -> DataFrame:
    """Keys of listings with a link on the block list."""
    return listing_links.join(block_list.select("kind", "value").distinct(), ["kind", "value"],
                              "left_semi").select(*key).distinct()


def drop_blocked(listings: DataFrame, block_list: DataFrame, key: list[str],
                 links: str = "links") -> DataFrame:
    pairs = listings.select(*key, F.explode(links).alias("l")).select(*key, "l.kind", "l.value")
    return listings.join(blocked(pairs, block_list, key), key, "left_anti")


def category_expand(categories: DataFrame, wanted: list[str]) -> DataFrame:
    """The requested slugs and their children."""
    return categories.where(F.col("slug").isin(*wanted) | F.col("parent_slug").isin(*wanted)
                            ).select("slug").distinct()


def unknown_categories(categories: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(categories.select("slug"), "slug", "left_anti")


def in_categories(entities: DataFrame, entity_categories: DataFrame,
                  slugs: DataFrame) -> DataFrame:
    keys = entity_categories.join(slugs, "slug", "left_semi").select("business_id")
    return entities.join(keys, "business_id", "left_semi")


def from_sources(entities: DataFrame, records: DataFrame, links: DataFrame,
                 wanted: list[str]) -> DataFrame:
    """Entities with a record of, or a link kind in, the wanted list."""
    keys = records.where(F.col("source_id").isin(*wanted)).select("business_id").unionByName(
        links.where(F.col("kind").isin(*wanted)).select("business_id"))
    return entities.join(keys, "business_id", "left_semi")


def unlabelled(shown: DataFrame, labels: DataFrame) -> DataFrame:
    return shown.join(labels.select("business_id"), "business_id", "left_anti")


def orphans(entities: DataFrame, records: DataFrame) -> DataFrame:
    """Entities left without any source record."""
    return entities.join(records.select("business_id"), "business_id", "left_anti")


def geocode_join(rows: DataFrame, gazetteer: DataFrame, *, address: str = "address",
                 country: str = "country_code") -> DataFrame:
    """Add lat and lng from a gazetteer keyed ``address | cc``: the cleaned address first,
    then the postal code. A known miss is a row with nulls. ``geocoded`` tells rows whose
    keys are all unknown (to be geocoded) from known misses."""
    from vouch.functions.address import clean_address, postal_code

    cc = F.lower(F.col(country))
    # one row per query, prefer a located one
    table = gazetteer.groupBy("query").agg(
        F.max(F.when(F.col("lat").isNotNull(), F.struct("lat", "lng"))).alias("p"))
    # rows without a code get a key of their own that matches nothing, so that they do not
    # all meet in one task
    code = postal_code(address, country)
    post = F.coalesce(F.concat(code, F.lit(" | "), cc),
                      F.concat(F.lit("#"), F.xxhash64(address).cast("string")))
    df = rows.withColumns({"_street": F.concat_ws(" | ", clean_address(address), cc),
                           "_post": post, "_coded": code.isNotNull()})
    for q, p in (("_street", "_p1"), ("_post", "_p2")):
        side = table.select(F.col("query").alias(q), F.col("p").alias(p),
                            F.lit(True).alias(p + "k"))
        df = df.join(side, q, "left")
    point = F.coalesce("_p1", "_p2")
    tried = F.coalesce("_p1k", F.lit(False)) & (
        F.col("_p1").isNotNull() | ~F.col("_coded") | F.coalesce("_p2k", F.lit(False)))
    known = point.isNotNull() | tried
    return df.withColumns({"lat": point["lat"], "lng": point["lng"], "geocoded": known}).drop(
        "_street", "_post", "_coded", "_p1", "_p2", "_p1k", "_p2k")


def registry_links(cities: DataFrame, registries: DataFrame, wanted: list[str]) -> DataFrame:
    """(slug, registry id): registries that cover the city or its country and serve one of
    the wanted categories or its parent."""
    cover = cities.select("slug", F.explode(F.array_append(
        F.coalesce("regions", F.array().cast("array<string>")),
        F.concat(F.lit("country:"), F.col("country_code")))).alias("region"))
    wants = F.array(*[F.lit(w) for w in wanted])
    relevant = F.exists("categories", lambda c: F.array_contains(wants, c) | F.array_contains(
        wants, F.substring_index(c, "/", 1)))
    served = registries.where(relevant).select(F.col("id").alias("registry"),
                                               F.explode("regions").alias("region"))
    return cover.join(served, "region").select("slug", "registry").distinct()


def region_overlap(left: ColumnOrName, right: ColumnOrName) -> Column:
    """Both arrays have a common region; nulls have none."""
    none = F.array().cast("array<string>")
    return F.arrays_overlap(F.coalesce(col(left), none), F.coalesce(col(right), none))
