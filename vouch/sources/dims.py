"""Reference dimensions and lexicon files."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch import schemas
from vouch.functions import signals as sg
from vouch.functions import text as tx


def _yaml(path: str) -> dict[str, Any]:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def reference_dims(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Countries, cities, categories, sources and registries from a folder of YAML files.

    These are hand-edited files of at most some hundred rows, so reading them on the driver
    is bounded by their nature."""
    root = Path(folder)
    places = _yaml(str(root / "cities.yaml"))
    countries = [(c["code"], c.get("name_en"), c.get("name_fa"), c.get("min_display_score"), True)
                 for c in places.get("countries", [])]
    cities = [(i, c["slug"], c["country"], c.get("name_en"), *map(float, c["bbox"]),
               [str(r) for r in c.get("regions", [])], list(c.get("wikivoyage", [])), True)
              for i, c in enumerate(places.get("cities", []))]
    categories = [(c["slug"], c.get("parent"), c.get("name_en"), c.get("name_fa"), i)
                  for i, c in enumerate(_yaml(str(root / "categories.yaml"))
                                        .get("categories", []))]
    sources = [(s["id"], s.get("name_en"), s.get("name_fa") or s.get("name_en"), s.get("kind"),
                s.get("status"), s.get("phase"), bool(s.get("account_required")),
                s.get("monthly_cap"),
                not s.get("account_required") and s.get("status") != "rejected")
               for s in _yaml(str(root / "sources.yaml")).get("sources", [])]
    registry_file = root / "registry_links.yaml"
    registries = [(r["id"], r.get("name_en"), r.get("url"), [str(x) for x in r["regions"]],
                   list(r["categories"]))
                  for r in (_yaml(str(registry_file)).get("registries", [])
                            if registry_file.exists() else [])]
    return {
        "countries": spark.createDataFrame(countries, schemas.COUNTRY),
        "cities": spark.createDataFrame(cities, schemas.CITY),
        "categories": spark.createDataFrame(categories, schemas.CATEGORY),
        "sources": spark.createDataFrame(sources, schemas.SOURCE),
        "registries": spark.createDataFrame(registries, schemas.REGISTRY),
    }


def lexicon_table(lines: DataFrame) -> DataFrame:
    """(list, term, ord) from lines (list, line, ord): comments and blanks dropped, folded."""
    line = F.trim("line")
    kept = lines.where((line != "") & ~line.startswith("#"))
    return kept.select("list", tx.fold(line).alias("term"), "ord")


def read_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Lexicon table of a folder of term files; the list is named after the file."""
    df = spark.read.text(f"{folder}/*.txt")
    name = F.regexp_extract("_metadata.file_name", r"([^/]+)\.txt$", 1)
    names = F.create_map(*[F.lit(x) for k, v in fv.LEXICON_FILES.items()
                           for x in (v.removesuffix(".txt"), k)])
    listed = df.select(F.coalesce(F.try_element_at(names, name), name).alias("list"),
                       F.col("value").alias("line"), F.lit(0).alias("ord"))
    return lexicon_table(listed)


def hint_terms(table: DataFrame, lists: tuple[str, ...] = fv.HINT_LISTS) -> DataFrame:
    """Distinct Latin terms of four or more characters of the hint lists."""
    return table.where(F.col("list").isin(*lists)
                       & F.col("term").rlike(r"^[a-z][a-z \-]{3,}$")).select("term").distinct()


def country_terms(table: DataFrame, exclusions: DataFrame, country: str) -> DataFrame:
    """Explicit terms without those excluded in one country."""
    gone = exclusions.where(F.upper("country") == country.upper()).select(
        tx.fold("term").alias("term"))
    terms = table.where(F.col("list") == "explicit").select("term").distinct()
    return terms.join(gone, "term", "left_anti")


def drop_excluded_matches(matches: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Term matches (country, list, term, ...) without explicit terms excluded there."""
    gone = exclusions.select(F.upper("country").alias("country"), tx.fold("term").alias("term"),
                             F.lit("explicit").alias("list"))
    return matches.join(gone, ["country", "list", "term"], "left_anti")


def lexicon_from_table(table: DataFrame, max_terms: int = 2000, **kwargs) -> sg.Lexicon:
    """A lexicon for regular-expression matching. The size is checked before collecting;
    larger tables belong to ``match_term_table``."""
    rows = table.select("list", "term").distinct().limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        raise ValueError(f"more than {max_terms} terms; join the table with match_term_table")
    lists: dict[str, list[str]] = {}
    for r in sorted(rows):
        lists.setdefault(r.list, []).append(r.term)
    return sg.Lexicon.of(lists, **kwargs)


def sitemap_rows(cities: DataFrame, languages: list[str], base: str) -> DataFrame:
    """(url, last_modified): one row per language and city, and one per non-zero category.

    ``cities``: slug, last_indexed_at, category_counts map."""
    langs = F.array(*[F.lit(x) for x in languages])
    df = cities.withColumn("lang", F.explode(langs))
    used = F.map_keys(F.map_filter(F.coalesce("category_counts", F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<bigint>"))),
        lambda k, v: v > 0))
    suffixes = F.concat(F.array(F.lit("")), F.transform(used, lambda k: F.concat(F.lit("/"), k)))
    return df.withColumn("_s", F.explode(suffixes)).select(
        F.concat(F.lit(f"{base}/"), "lang", F.lit("/"), "slug", "_s").alias("url"),
        F.col("last_indexed_at").alias("last_modified"))
