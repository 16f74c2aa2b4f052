"""Source place types mapped to category slugs; every table is an argument."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions.text import ColumnOrName, col

Pairs = Iterable[tuple[str, str]]


def default_maps() -> tuple[dict[str, str], dict[str, str], list[tuple[str, str]]]:
    """(taxonomy, basic category, map tag) tables of the default category map."""
    taxonomy: dict[str, str] = {}
    basic: dict[str, str] = {}
    tags: list[tuple[str, str]] = []
    for slug, _parent, values, basics, matchers in fv.CATEGORY_MAP:
        for v in values.split():
            taxonomy.setdefault(v, slug)
        for v in basics.split():
            basic.setdefault(v, slug)
        tags += [(m, slug) for m in matchers.split()]
    return taxonomy, basic, tags


def _map(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def map_hierarchy(hierarchy: ColumnOrName, basic_category: ColumnOrName,
                  taxonomy: Mapping[str, str], basic: Mapping[str, str]) -> Column:
    """Most specific known level of a root-to-leaf hierarchy, then the basic type."""
    levels = F.coalesce(col(hierarchy), F.array().cast("array<string>"))
    known = F.filter(F.transform(F.reverse(levels), lambda v: F.try_element_at(_map(taxonomy), v)),
                     lambda s: s.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)),
                      F.try_element_at(_map(basic), F.coalesce(col(basic_category), F.lit(""))),
                      F.lit("other"))


def map_tags(tags: ColumnOrName, rules: Pairs) -> Column:
    """First matching ``key=value`` or ``key=*`` rule; tag values may be ;-separated."""
    tags, chain = col(tags), None
    for matcher, slug in rules:
        key, value = matcher.split("=", 1)
        tag = F.try_element_at(tags, F.lit(key))
        hit = tag.isNotNull() if value == "*" else F.array_contains(F.split(tag, ";"), value)
        chain = (F if chain is None else chain).when(hit, slug)
    return F.lit("other") if chain is None else chain.otherwise("other")


def map_prefix(code: ColumnOrName, rules: Pairs, longest: bool = False) -> Column:
    """Code prefix to category: the first rule that fits, or the longest prefix."""
    rules = list(rules)
    if longest:
        rules = sorted(rules, key=lambda r: -len(r[0]))
    code, chain = F.coalesce(col(code), F.lit("")), None
    for prefix, slug in rules:
        chain = (F if chain is None else chain).when(code.startswith(prefix), slug)
    return chain.otherwise("other")


def map_needles(text: ColumnOrName, rules: Pairs) -> Column:
    """First rule whose needle occurs in the lowered text."""
    low, chain = F.lower(F.coalesce(col(text), F.lit(""))), None
    for needle, slug in rules:
        chain = (F if chain is None else chain).when(low.contains(needle), slug)
    return chain.otherwise("other")


def nonprofit_category(name: ColumnOrName, ntee: ColumnOrName | None = None) -> Column:
    low = F.lower(col(name))
    school = low.contains("school") | low.contains("academy")
    if ntee is not None:
        school = school | F.coalesce(col(ntee), F.lit("")).startswith("B")
    return F.when(school, "education").otherwise("community")
