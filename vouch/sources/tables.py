"""Table functions for SQL users: page in, zero or more rows out, used with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from vouch.sources.html import read_page
from vouch.sources.wiki import find_templates


class WikiTemplates:
    """Listing templates of a page: kind and parameters."""

    def eval(self, wikitext: str) -> Iterator[tuple]:
        for t in find_templates(wikitext or ""):
            yield t["kind"], dict(t["params"])


class PageLinks:
    """Absolute links of an HTML page in order."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        for i, href in enumerate(read_page(html, url)["hrefs"]):
            yield i, href


def register(spark: SparkSession) -> None:
    """Make wiki_templates(wikitext) and page_links(html, url) callable from SQL."""
    spark.udtf.register("wiki_templates", udtf(
        WikiTemplates, returnType="kind string, params map<string,string>"))
    spark.udtf.register("page_links", udtf(PageLinks, returnType="position int, href string"))
