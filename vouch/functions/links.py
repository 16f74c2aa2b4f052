"""Web, social and telephone links normalised to comparable values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions.text import ColumnOrName, col, let, quote

LINK_TYPE = "struct<kind:string,value:string,url:string>"


def url_parts(url: ColumnOrName) -> Column:
    """Struct (scheme, hostname, host, path, query, segments). The host is lowered and loses
    a leading www., then a leading m. or mobile.; a missing scheme counts as https."""
    u = F.trim(col(url))
    u = F.when(u.rlike(r"^(?i)[a-z][a-z0-9+.\-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    shape = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    authority = F.regexp_extract(u, shape, 2)
    hostname = F.lower(F.regexp_extract(authority, r"^(?:.*@)?([^:@]*)", 1))
    bare = F.regexp_replace(hostname, r"^www\.", "")
    path = F.regexp_extract(u, shape, 3)
    return F.struct(
        F.lower(F.regexp_extract(u, shape, 1)).alias("scheme"),
        hostname.alias("hostname"),
        F.regexp_replace(bare, r"^(?:m|mobile)\.", "").alias("host"),
        path.alias("path"),
        F.regexp_extract(u, shape, 4).alias("query"),
        F.filter(F.split(path, "/"), lambda s: s != "").alias("segments"),
    )


def _link(kind: str, value: Column, url: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), url.alias("url"))


def _social(p: Column) -> Column:
    first = F.get(p["segments"], F.lit(0))
    lowered = F.lower(first)
    last = F.element_at(p["segments"], -1)
    handle = F.regexp_replace(first, r"^@+", "")
    fb_id = F.regexp_extract(p["query"], r"(?:^|&)id=([^&]*)", 1)

    def facebook(value: Column, shown: Column) -> Column:
        return _link("facebook", value, F.concat(F.lit("https://www.facebook.com/"), shown))

    some = F.size(p["segments"]) > 0
    return (
        F.when(
            p["host"].isin(*fv.INSTAGRAM_HOSTS) & some & ~lowered.isin(*fv.INSTAGRAM_RESERVED)
            & handle.rlike(fv.INSTAGRAM_HANDLE),
            _link("instagram", F.lower(handle),
                  F.concat(F.lit("https://www.instagram.com/"), F.lower(handle), F.lit("/"))))
        .when(p["host"].isin(*fv.FACEBOOK_HOSTS) & some,
              F.when(lowered == "profile.php",
                     F.when(fb_id.rlike(r"^\d+$"), facebook(fb_id, fb_id)))
              .when((lowered == "pages") & last.rlike(r"^\d+$"), facebook(last, last))
              .when(~lowered.isin(*fv.FACEBOOK_RESERVED) & first.rlike(fv.FACEBOOK_HANDLE),
                    facebook(lowered, first)))
        .when(p["host"].isin(*fv.TELEGRAM_HOSTS) & some & ~lowered.isin(*fv.TELEGRAM_RESERVED)
              & first.rlike(fv.TELEGRAM_HANDLE),
              _link("telegram", lowered, F.concat(F.lit("https://t.me/"), first)))
    )


def listed_domain(host: Column, domains: Iterable[str]) -> Column:
    """Host equals or is below one of a fixed list of domains."""
    body = "|".join(quote(d) for d in domains)
    return host.rlike(rf"(?:^|\.)(?:{body})$") if body else F.lit(False)


def _website(p: Column, domains: Iterable[str]) -> Column:
    first = F.get(p["segments"], F.lit(0))
    deep = (F.size(p["segments"]) >= 2) | F.coalesce(
        F.length(first) > fv.DEEP_SEGMENT_CHARS, F.lit(False))
    value = F.when(deep, F.concat(p["host"], F.lit("/"),
                                  F.lower(F.array_join(p["segments"], "/")))).otherwise(p["host"])
    path = F.when(p["path"] == "", "/").otherwise(p["path"])
    shown = F.concat(p["scheme"], F.lit("://"), p["hostname"], path)
    usable = (p["host"].contains(".") & p["scheme"].isin("http", "https")
              & ~listed_domain(p["host"], domains))
    return F.when(usable, _link("website", value, shown))


def social_link(url: ColumnOrName) -> Column:
    return let(url_parts(url), _social)


def website_link(url: ColumnOrName, domains: Iterable[str] = fv.NON_BUSINESS_DOMAINS) -> Column:
    return let(url_parts(url), lambda p: _website(p, domains))


def classify_url(url: ColumnOrName, domains: Iterable[str] = fv.NON_BUSINESS_DOMAINS) -> Column:
    """A social profile if the URL is one, otherwise the website it points to, or null."""
    return let(url_parts(url), lambda p: F.coalesce(_social(p), _website(p, domains)))


def public_links(links: ColumnOrName) -> Column:
    """True when there are links and all are http(s) with a dotted host."""
    def public(u: Column) -> Column:
        return let(url_parts(u),
                   lambda p: p["scheme"].isin("http", "https") & p["host"].contains("."))

    return (F.size(col(links)) > 0) & F.forall(col(links), public)


def phone_e164(number: ColumnOrName, country: ColumnOrName) -> Column:
    """E.164, or null where the text is no possible number.

    Covers plain national writing for the countries of the built-in numbering plans, and
    international writing for all countries, with the usual separators (no letters, no
    extensions). The number is first written as +code national; one pattern per plan then checks
    the national length. Under calling codes without a plan, 7 to 15 digits are kept."""
    def plan_of(part: int) -> Column:
        pairs = [F.lit(x) for cc, plan in fv.PHONE_PLANS.items() for x in (cc, plan[part])]
        return F.try_element_at(F.create_map(*pairs), F.upper(col(country)))

    raw = F.trim(col(number))
    digits = F.regexp_replace(raw, r"\D", "")
    calling, trunk, prefix = plan_of(0), plan_of(1), plan_of(2)
    national = F.when(digits.startswith(trunk), F.substring(digits, 2, 20)).otherwise(digits)
    full = (F.when(raw.startswith("+"), digits)
            .when(digits.startswith(prefix), F.substring(digits, F.length(prefix) + 1, F.lit(20)))
            .otherwise(F.concat(calling, national)))
    clean = raw.rlike(r"^\+?[\d\s().\-/]+$")
    codes = "|".join(sorted({p[0] for p in fv.PHONE_PLANS.values()}, key=len, reverse=True))
    # a trunk zero written inside an international number is dropped
    plain = F.regexp_replace(F.when(clean, full), rf"^({codes})0", "$1")
    lengths: dict[str, set[int]] = {}
    for code, _, _, allowed in fv.PHONE_PLANS.values():
        lengths.setdefault(code, set()).update(allowed)
    shapes = "|".join(rf"{code}(?:" + "|".join(rf"\d{{{n}}}" for n in sorted(ns)) + ")"
                      for code, ns in lengths.items())
    other = raw.startswith("+") & ~digits.rlike(rf"^(?:{codes})")
    return let(plain, lambda p: F.when(
        p.rlike(rf"^(?:{shapes})$") | (other & p.rlike(r"^[1-9]\d{6,14}$")),
        F.concat(F.lit("+"), p)))


def phone_link(number: ColumnOrName, country: ColumnOrName) -> Column:
    return let(phone_e164(number, country), lambda e: F.when(
        e.isNotNull(), _link("phone", e, F.concat(F.lit("tel:"), e))))


def listing_links(urls: ColumnOrName, phones: ColumnOrName, country: ColumnOrName,
                  domains: Iterable[str] = fv.NON_BUSINESS_DOMAINS) -> Column:
    """Distinct links of a listing; the first spelling of each (kind, value) is kept."""
    domains = tuple(domains)
    none = F.array().cast(f"array<{LINK_TYPE}>")
    web = F.transform(F.coalesce(col(urls), F.array().cast("array<string>")),
                      lambda u: classify_url(u, domains))
    tel = F.transform(F.coalesce(col(phones), F.array().cast("array<string>")),
                      lambda p: phone_link(p, country))
    return first_links(F.coalesce(F.array_compact(F.concat(web, tel)), none))


def first_links(links: Column) -> Column:
    def merge(acc: Column, x: Column) -> Column:
        known = F.exists(acc, lambda a: (a["kind"] == x["kind"]) & (a["value"] == x["value"]))
        return F.when(known, acc).otherwise(F.array_append(acc, x))

    return F.aggregate(links, F.array().cast(f"array<{LINK_TYPE}>"), merge)


def domain_suffixes(host: ColumnOrName) -> Column:
    """The host and every parent domain, for equi-joins with a domain table."""
    labels = F.split(col(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def percent_encode(text: ColumnOrName) -> Column:
    """Percent-encoding with %20 for blanks; '/' and '~' stay as they are."""
    t = F.replace(F.url_encode(col(text)), F.lit("+"), F.lit("%20"))
    t = F.replace(F.replace(t, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(t, F.lit("%2F"), F.lit("/"))


def map_urls(name: ColumnOrName, address: ColumnOrName, lat: ColumnOrName,
             lng: ColumnOrName) -> Column:
    """Struct of outbound map links; the open map needs a location."""
    name = F.coalesce(col(name), F.lit(""))
    query = F.concat_ws(", ", F.nullif(name, F.lit("")), F.nullif(col(address), F.lit("")))
    la, ln = (F.round(col(c), 6).cast("string") for c in (lat, lng))
    return F.struct(
        F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="),
                 percent_encode(query)).alias("google_maps"),
        F.concat(F.lit("https://maps.apple.com/?q="), percent_encode(name),
                 F.coalesce(F.concat(F.lit("&ll="), la, F.lit(","), ln),
                            F.lit(""))).alias("apple_maps"),
        F.concat(F.lit("https://www.openstreetmap.org/?mlat="), la, F.lit("&mlon="), ln,
                 F.lit("#map=18/"), la, F.lit("/"), ln).alias("openstreetmap"),
    )
