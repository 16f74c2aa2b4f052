"""Lexicons and the columns that turn text into typed, weighted signals."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouch import fixed_values as fv
from vouch.functions import text as tx
from vouch.functions.text import let
from vouch.schemas import SIGNAL

SIGNALS = T.ArrayType(SIGNAL)


@dataclass(frozen=True)
class Lexicon:
    """Folded term lists, signal weights and per-country exclusions of explicit terms.

    Lists are matched as one alternation each, which suits up to a few hundred terms; longer
    term tables are joined with ``match_term_table``.
    """

    lists: Mapping[str, tuple[str, ...]]
    weights: Mapping[str, float] = field(default_factory=lambda: dict(fv.SIGNAL_WEIGHTS))
    exclusions: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    @staticmethod
    def of(lists: Mapping[str, Iterable[str]], weights: Mapping[str, float] | None = None,
           exclusions: Mapping[str, Iterable[str]] | None = None) -> Lexicon:
        return Lexicon(
            {k: tuple(tx.fold_term(t) for t in v) for k, v in lists.items()},
            dict(weights or fv.SIGNAL_WEIGHTS),
            {k.upper(): tuple(tx.fold_term(t) for t in v)
             for k, v in (exclusions or {}).items()},
        )

    @staticmethod
    def default() -> Lexicon:
        lists = {k: v.strip().splitlines() for k, v in fv.DEFAULT_LEXICON.items()}
        return Lexicon.of(lists, exclusions=fv.COUNTRY_EXCLUSIONS)

    def get(self, name: str) -> tuple[str, ...]:
        return tuple(self.lists.get(name, ()))

    def pattern(self, name: str) -> str | None:
        return tx.whole_word(self.get(name))

    def explicit_patterns(self, owners_only: bool) -> tuple[str | None, dict[str, str | None]]:
        """The explicit pattern and its per-country variants without excluded terms.
        ``owners_only`` leaves out the adjectives that can describe a product."""
        skip = set(self.get("product_adjectives")) if owners_only else set()
        terms = [t for t in self.get("explicit") if t not in skip]
        variants = {c: tx.whole_word([t for t in terms if t not in set(x)])
                    for c, x in self.exclusions.items()}
        return tx.whole_word(terms), variants

    def hint_terms(self) -> list[str]:
        """Latin terms of four or more letters for coarse pre-selection, sorted."""
        letters = set("abcdefghijklmnopqrstuvwxyz")
        terms = {t for name in fv.HINT_LISTS for t in self.get(name)}
        return sorted(t for t in terms
                      if len(t) >= 4 and t[0] in letters and set(t) <= letters | {" ", "-"})

    def surname_pattern(self) -> str | None:
        endings = "|".join(tx.quote(s) for s in self.get("surname_suffixes"))
        return rf"(?i)(?<![A-Za-z])[A-Za-z]{{3,}}(?:{endings})(?![A-Za-z])" if endings else None

    def any_positive(self, folded: Column, raw: Column) -> Column:
        """True for every text that can yield a positive signal (and for few others)."""
        terms = [t for name in ("explicit", "places", "place_adjectives", "foods", "occasions",
                                "places_ambiguous") for t in self.get(name)]
        found = tx.has_arabic_script(raw)
        if terms:
            found = found | folded.rlike(tx.whole_word(terms))
        if self.surname_pattern():
            found = found | raw.rlike(self.surname_pattern())
        return found


def _cut(text: Column, pattern: str | None) -> Column:
    """[before, after] around the first match, or null without a match."""
    if pattern is None:
        return F.lit(None).cast("array<string>")
    return F.when(text.rlike(pattern), F.split(text, pattern, 2))


def _cut_explicit(text: Column, lexicon: Lexicon, owners_only: bool,
                  country: Column | None) -> Column:
    base, variants = lexicon.explicit_patterns(owners_only)
    if country is None or not variants:
        return _cut(text, base)
    chain = None
    for code, pattern in sorted(variants.items()):
        chain = (F if chain is None else chain).when(F.upper(country) == code,
                                                     _cut(text, pattern))
    return chain.otherwise(_cut(text, base))


def _signal(name: str, weight: Column | float, snippet: Column, url: Column) -> Column:
    weight = F.lit(float(weight)) if not isinstance(weight, Column) else weight.cast("double")
    return F.struct(F.lit(name).alias("signal"), weight.alias("weight"),
                    F.substring(snippet, 1, fv.SNIPPET_MAX).alias("snippet"),
                    url.alias("url"))


def field_signals(fields: DataFrame, lexicon: Lexicon, *, text: str = "text", kind: str = "kind",
                  url: str = "url", country: str | None = None, script: bool = True,
                  out: str = "signals") -> DataFrame:
    """Add the signals of one text field per row, in rule order.

    Every list is searched once per row inside generated code; the columns that several
    rules share are materialised once, so no pattern runs twice.
    """
    w = lexicon.weights
    raw, k, u = F.col(text), F.col(kind), F.col(url).cast("string")
    where = F.col(country) if country else None
    norm = F.col("_norm")
    df = fields.withColumn("_norm", F.when(F.trim(raw) != "", tx.fold(raw)))
    cuts = {
        "_owner": _cut_explicit(norm, lexicon, True, where),
        "_product": norm.rlike(lexicon.pattern("product_terms"))
        if lexicon.get("product_terms") else F.lit(False),
        "_places": _cut(norm, lexicon.pattern("places")),
        "_adjectives": _cut(norm, lexicon.pattern("place_adjectives")),
        "_foods": _cut(norm, lexicon.pattern("foods")),
        "_occasions": _cut(norm, lexicon.pattern("occasions")),
        "_negative": F.when(k != "page", _cut(norm, lexicon.pattern("negative"))),
        "_ambiguous": _cut(norm, lexicon.pattern("places_ambiguous")),
        "_surname": F.when(k == "name", _cut(raw, lexicon.surname_pattern())),
    }
    df = df.withColumns(cuts)
    owner, product = F.col("_owner"), F.coalesce(F.col("_product"), F.lit(False))
    df = df.withColumns({
        # every explicit term, product adjectives included
        "_explicit": _cut_explicit(norm, lexicon, False, where),
        "_marker": F.when((k != "page") & F.col("_negative").isNull(),
                          _cut(norm, lexicon.pattern("arabic_markers"))),
    })
    explicit = F.when(product, owner).otherwise(F.col("_explicit"))
    adjective = F.when(product & owner.isNull(), F.col("_explicit"))

    def hit(cut: Column, name: str, weight: float | None = None) -> Column:
        start, end = F.length(cut[0]), F.length(raw) - F.length(cut[1])
        return F.when(cut.isNotNull(),
                      _signal(name, w[name] if weight is None else weight,
                              tx.snippet(raw, start, end), u))

    rules = []
    if script:
        written = tx.has_arabic_script(raw) | raw.rlike(r"[\x{1EE00}-\x{1EEFF}]")
        df = df.withColumn("_stable", F.when(
            k.isin("name", "text") & F.col("_norm").isNotNull() & written, raw))
        df = df.withColumn("_stable", tx.nfkc("_stable"))
        df = df.withColumn("_class", F.when(k.isin("name", "text"), tx.script_class("_stable")))
        df = df.withColumn("_part", F.when(F.col("_class").like("persian%"),
                                           tx.script_part("_stable")))
        is_name, part = k == "name", F.col("_part")
        name = F.when(is_name, "persian_script_name").otherwise("persian_script_text")
        full = F.when(is_name, w["persian_script_name"]).otherwise(w["persian_script_text"])
        short = (F.col("_class") == "persian_likely") & (F.length(part) < fv.SHORT_SCRIPT_TEXT)
        shown = F.when(is_name, part).otherwise(tx.snippet(raw, F.lit(0), F.length(part)))
        rules.append(F.when(
            F.col("_class").like("persian%"),
            F.struct(name.alias("signal"),
                     F.when(short, full / 2).otherwise(full).alias("weight"),
                     F.substring(F.when(shown != "", shown).otherwise(raw), 1,
                                 fv.SNIPPET_MAX).alias("snippet"),
                     u.alias("url"))))
    negative = F.when(F.col("_negative").isNotNull(), F.col("_negative")).when(
        explicit.isNull(), F.col("_marker"))
    rules += [
        hit(explicit, "explicit_keyword"),
        hit(adjective, "persian_product_term"),
        hit(F.col("_places"), "iranian_place_name"),
        hit(F.col("_adjectives"), "persian_personal_name"),
        hit(F.col("_foods"), "iranian_food_terms"),
        hit(F.col("_occasions"), "nowruz_yalda_mentions"),
        hit(negative, "negative_keyword"),
        hit(F.col("_ambiguous"), "iranian_place_name", fv.AMBIGUOUS_PLACE_WEIGHT),
        hit(F.col("_surname"), "persian_personal_name"),
    ]
    df = df.withColumn(out, F.array_compact(F.array(*rules)).cast(SIGNALS))
    return df.drop("_norm", "_stable", "_class", "_part", "_explicit", "_marker", *cuts)


def strongest(signals: Column) -> Column:
    """One signal per type (the first among equals), strongest first; equal weights keep the
    order in which their types first appeared."""
    def ranked(names: Column) -> Column:
        return F.array_sort(F.transform(signals, lambda s, i: F.struct(
            (-s["weight"]).alias("w"), F.array_position(names, s["signal"]).alias("first"),
            i.alias("i"), s.alias("s"))))

    def leaders(rows: Column) -> Column:
        def pick(names: Column) -> Column:
            kept = F.filter(rows, lambda r, j: F.array_position(names, r["s"]["signal"]) == j + 1)
            return F.transform(kept, lambda r: r["s"])

        return let(F.transform(rows, lambda r: r["s"]["signal"]), pick)

    return let(let(F.transform(signals, lambda s: s["signal"]), ranked), leaders)


def signal_rows(df: DataFrame, *columns: str, signals: str = "signals") -> DataFrame:
    """One row per signal: ``columns``, position, signal, weight, snippet, url.

    Explodes with ``posexplode_outer`` on purpose: a plain explode makes the optimizer infer a
    size test on the array and push it below the detection, which would run every pattern
    again."""
    rows = df.select(*columns, F.posexplode_outer(signals).alias("position", "_s"))
    return rows.where(F.col("_s").isNotNull()).select(
        *columns, "position", "_s.signal", "_s.weight", "_s.snippet",
        F.col("_s.url").alias("signal_url"))


def has_positive(signals: Column) -> Column:
    return F.exists(signals, lambda s: s["signal"] != fv.NEGATIVE_SIGNAL)


def signal_score(signals: Column) -> Column:
    """Noisy-OR over an array of signals that already holds one per type."""
    from vouch.functions.scoring import damped

    def fuse(found: Column) -> Column:
        product = F.aggregate(found, F.lit(1.0), lambda acc, s: acc * F.when(
            s["signal"] == fv.NEGATIVE_SIGNAL, 1.0).otherwise(1 - s["weight"]))
        return damped(product, F.exists(found, lambda s: s["signal"] == fv.NEGATIVE_SIGNAL))

    return let(signals, fuse)


def hint_filter(text: Column, terms: Iterable[str]) -> Column:
    """Coarse case-insensitive substring alternation, placed before costly work."""
    terms = list(terms)
    if not terms:
        return F.lit(False)
    return text.rlike("(?i)" + "|".join(tx.quote(t) for t in terms))


def match_term_table(fields: DataFrame, terms: DataFrame, *, key: list[str], text: str = "text",
                     max_words: int = 4) -> DataFrame:
    """Whole-word matches against a term table of any size: (key..., list, term).

    Words that begin no term go first, in a semi join; at the others the n-grams are formed and meet
    the terms in an equi-join. The table may be large and neither side is collected; the term side
    is one row per distinct term. A match is one row per key, however often the text has it.
    """
    # other punctuation separates: a token of its own that no term can hold
    marked = F.regexp_replace(tx.fold(text), r"[^\p{L}\p{N}_\s\p{Z}-]+", " \u0001 ")
    table = terms.select("list", "term", F.array_join(
        F.filter(F.split(tx.fold("term"), r"[\s\p{Z}_-]+"), lambda x: x != ""), " "
    ).alias("_gram")).dropDuplicates(["list", "_gram"])
    firsts = table.select(F.substring_index("_gram", " ", 1).alias("_first")).distinct()
    words = F.split(F.regexp_replace(marked, r"[\s\p{Z}-]+", " "), " ")
    # each word with those behind it, not with the whole text; a plain explode would infer a filter
    # on the array and split every text twice
    behind = [F.slice("_w", k + 1, F.greatest(F.size("_w"), F.lit(0))).alias(f"_{k}") for k in range(max_words)]
    df = fields.where(F.col(text).isNotNull()).select(*key, words.alias("_w")).select(
        *key, F.explode_outer(F.arrays_zip(*behind)).alias("_x")).where("_x._0 <> ''")
    df = df.withColumn("_first", F.substring_index(F.translate("_x._0", "_", " "), " ", 1))
    df = df.join(firsts, "_first", "left_semi")
    grams = F.array(*[F.translate(F.concat_ws(" ", *[f"_x._{k}" for k in range(n)]), "_", " ")
                      for n in range(1, max_words + 1)])
    df = df.select(*key, F.explode_outer(grams).alias("_gram")).where(~F.col("_gram").contains("\u0001"))
    return df.join(table, "_gram").select(*key, "list", "term").distinct()
