"""Shaping source rows into the common listing schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions import signals as sg
from vouch.functions import text as tx
from vouch.schemas import LISTING, SIGNAL, TEXT

KEY = ["source_id", "external_id"]


def text_field(kind: str, text: Column, url: Column) -> Column:
    """A text field struct, or null for an empty text."""
    field = F.struct(F.lit(kind).alias("kind"), text.alias("text"), url.alias("url")).cast(TEXT)
    return F.when(F.coalesce(text, F.lit("")) != "", field)


def texts(*fields: Column) -> Column:
    return F.array_compact(F.array(*fields))


def signal(name: str, when: Column, snippet: Column, url: Column, weights=None) -> Column:
    weight = (weights or fv.SIGNAL_WEIGHTS)[name]
    hit = F.struct(F.lit(name).alias("signal"), F.lit(weight).alias("weight"),
                   F.substring(snippet, 1, fv.SNIPPET_MAX).alias("snippet"),
                   url.alias("url")).cast(SIGNAL)
    return F.when(when, hit)


def filled(value: Column) -> Column:
    """Trimmed text, null when empty."""
    return F.nullif(F.trim(value), F.lit(""))



def number(value: Column) -> Column:
    """A double, null for empty or malformed text."""
    return value.try_cast("double")


def make(df: DataFrame, keep: list[str] | None = None, **columns: Column | str) -> DataFrame:
    """Listing rows from named columns; absent ones get the schema's empty value."""
    out = []
    for field in LISTING.fields:
        value = columns.get(field.name)
        if value is None:
            kind = field.dataType.simpleString()
            value = F.array() if kind.startswith("array") else F.lit(None)
            if field.name == "private_location":
                value = F.lit(False)
            if field.name == "category":
                value = F.lit("other")
        elif isinstance(value, str):
            value = F.col(value)
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*(keep or []), *out)


Source = Callable[..., DataFrame]
_SOURCES: dict[str, Source] = {}


def source(source_id: str) -> Callable[[Source], Source]:
    """Register a function (DataFrame, ...) -> listings under a source id."""
    def register(fn: Source) -> Source:
        _SOURCES[source_id] = fn
        return fn

    return register


def listings_of(source_id: str, *args, **kwargs) -> DataFrame:
    """Run a registered source and check that it returns the listing schema."""
    df = _SOURCES[source_id](*args, **kwargs)
    want = {f.name: f.dataType.simpleString() for f in LISTING.fields}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = {n: have.get(n) for n, t in want.items() if have.get(n) != t}
    if wrong:
        raise TypeError(f"source {source_id!r} does not match the listing schema: {wrong}")
    return df


def registered() -> list[str]:
    return sorted(_SOURCES)


def detect(listings: DataFrame, lexicon: sg.Lexicon, *, key: list[str] | None = None,
           country: str | None = None, all_rows: bool = False) -> DataFrame:
    """Replace ``signals`` by the detected ones (given signals first), one per type.

    A cheap test inside generated code drops the great majority of listings, which have no
    positive evidence at all; only the rest is exploded to text fields. With ``all_rows``
    listings without positive evidence stay, with empty or negative signals.
    """
    key = key or KEY
    own = F.coalesce("signals", F.array().cast(sg.SIGNALS))
    maybe = sg.has_positive(own) | F.exists(
        F.coalesce("texts", F.array().cast(f"array<{TEXT.simpleString()}>")),
        lambda t: lexicon.any_positive(tx.fold(t["text"]), t["text"]))
    df = listings.withColumn("signals", own)
    if not all_rows:
        df = df.where(maybe)
    rest = [c for c in df.columns if c not in (*key, country)]
    fields = df.select(*key, *([country] if country else []), F.struct(*rest).alias("_listing"),
                       F.posexplode_outer("texts").alias("_i", "_t")).select(
        *key, *([country] if country else []), "_listing", "_i", "_t.kind", "_t.text", "_t.url")
    found = sg.field_signals(fields, lexicon, country=country, out="_found")
    # back to one row per listing: as many rows as it has names and descriptions
    per = found.groupBy(*key).agg(
        *([F.first(country).alias(country)] if country else []),
        F.first("_listing").alias("_listing"),
        F.array_sort(F.collect_list(F.struct("_i", "_found"))).alias("_lists"))
    flat = F.flatten(F.transform("_lists", lambda x: x["_found"]))
    out = per.select(*key, *([country] if country else []), "_listing.*",
                     flat.alias("_found")).withColumn(
        "signals", sg.strongest(F.concat("signals", "_found"))).drop("_found")
    out = out.select(*listings.columns)
    return out if all_rows else out.where(sg.has_positive(F.col("signals")))
