"""Evidence from web pages and channel previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions import signals as sg
from vouch.functions import text as tx
from vouch.functions.links import first_links, social_link
from vouch.schemas import SIGNAL
from vouch.sources.html import page_fields


def _joined(*parts: str) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.col(p), F.lit("")) for p in parts])


def read_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Add the page parts as columns and drop the HTML, in one pass over it.

    Exploded on purpose: the optimizer merges a plain column into an aggregation that ``pages`` may
    come from, and then every use of a part gathers and parses the page again."""
    df = pages.select("*", F.explode_outer(F.array(page_fields(html, url))).alias("_p"))
    return df.select(*[c for c in pages.columns if c != html], "_p.*")


def _keyword_fields(df: DataFrame, lexicon: sg.Lexicon, text: str, kind: str, out: str,
                    country: str | None) -> DataFrame:
    df = df.withColumn("_kind", F.lit(kind))
    return sg.field_signals(df, lexicon, text=text, kind="_kind", url="url", country=country,
                            script=False, out=out).drop("_kind")


def _content_signal(name: str, weights, when: Column, snippet: Column) -> Column:
    hit = F.struct(F.lit(name).alias("signal"), F.lit(weights[name]).alias("weight"),
                   F.substring(snippet, 1, fv.SNIPPET_MAX).alias("snippet"),
                   F.col("url").alias("url")).cast(SIGNAL)
    return F.when(when, hit)


def page_evidence(pages: DataFrame, lexicon: sg.Lexicon, country: str | None = None,
                  text_chars: int | None = None) -> DataFrame:
    """Per page (columns of ``pages`` without html, plus lang, title, signals, links).

    The content signal needs Persian script in the page and either a Persian lang attribute
    or enough Persian letters. Keywords come from the head and from the whole text, or from its
    first ``text_chars`` characters.
    """
    keep = [c for c in pages.columns if c != "html"]
    df = read_pages(pages)
    df = df.withColumn("_body", F.col("text") if text_chars is None
                       else F.substring("text", 1, text_chars))
    df = df.withColumn("_all", _joined("title", "description", "_body"))
    df = df.withColumn("_stable", tx.nfkc("_all"))
    arabic, ratio = tx.letter_counts("_stable")
    df = df.withColumns({"letters": arabic, "ratio": ratio,
                         "_head": _joined("title", "description"),
                         "_class": tx.script_class("_stable"),
                         "_fa": F.coalesce(F.lower("lang").startswith("fa"), F.lit(False))})
    df = df.withColumn("_part", F.when(F.col("_class").like("persian%"), tx.script_part("_stable")))
    enough = (F.col("letters") >= fv.PAGE_MIN_LETTERS) & (F.col("ratio") >= fv.PAGE_MIN_RATIO)
    shown = F.when(F.col("_fa") & (F.col("_part") == ""),
                   F.concat(F.lit('lang="'), F.col("lang"), F.lit('"'))).otherwise(F.col("_part"))
    content = _content_signal("website_persian_content", lexicon.weights,
                              F.col("_class").like("persian%") & (F.col("_fa") | enough), shown)
    df = df.withColumn("_content", content)
    df = _keyword_fields(df, lexicon, "_head", "page_head", "_head_signals", country)
    df = _keyword_fields(df, lexicon, "_body", "page", "_body_signals", country)
    found = sg.strongest(F.concat("_head_signals", "_body_signals"))
    signals = F.array_compact(F.concat(F.array("_content"), found))
    links = first_links(F.array_compact(F.transform("hrefs", social_link)))
    return df.select(*keep, "lang", "title", "letters", F.round("ratio", 6).alias("ratio"),
                     signals.alias("signals"), links.alias("links"))


def channel_evidence(previews: DataFrame, lexicon: sg.Lexicon,
                     country: str | None = None) -> DataFrame:
    """Per channel preview (name, url, html): exists, title, description, signals."""
    keep = [c for c in previews.columns if c != "html"]
    df = read_pages(previews)
    exists = F.col("channel_title").isNotNull()
    df = df.withColumn("_all", F.when(exists, _joined("channel_title", "channel_description")))
    df = df.withColumn("_stable", tx.nfkc("_all"))
    letters, _ = tx.letter_counts("_stable")
    persian = tx.is_persian("_stable") & (letters >= fv.CHANNEL_MIN_LETTERS)
    df = df.withColumn("_content", _content_signal("telegram_persian_content", lexicon.weights,
                                                   persian, tx.script_part("_stable")))
    df = _keyword_fields(df, lexicon, "_all", "page_head", "_keywords", country)
    signals = F.array_compact(F.concat(F.array("_content"), sg.strongest(F.col("_keywords"))))
    return df.select(*keep, exists.alias("exists"), F.col("channel_title").alias("title"),
                     F.nullif("channel_description", F.lit("")).alias("description"),
                     signals.alias("signals"))
