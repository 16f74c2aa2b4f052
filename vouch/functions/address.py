"""Address clean-up for geocoding keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouch import fixed_values as fv
from vouch.functions.text import ColumnOrName, col, let


def _unit_word(word: Column) -> Column:
    return F.upper(F.rtrim(word, F.lit("."))).isin(*fv.UNIT_WORDS)


def _street_words(part: Column) -> Column:
    """The words of one part of an address that do not name a unit in the building."""
    words = F.filter(F.split(part, r"\s+"), lambda w: w != "")

    def before(ws: Column, i: Column, n: int) -> Column:
        return F.when(i >= n, F.get(ws, i - n))

    def stays(ws: Column):
        def test(w: Column, i: Column) -> Column:
            last, after, next_ = before(ws, i, 1), F.get(ws, i + 1), F.get(ws, i + 2)
            named = w.startswith("#") | _unit_word(w) | _unit_word(F.split(w, "[-.]")[0])
            number = (last == "#") | _unit_word(last)
            # a unit before the house number: the number, and the hyphen that ends it
            leads = (i == 0) & (after == "-") & F.substring(next_, 1, 1).between("0", "9")
            hyphen = (i == 1) & (w == "-") & F.substring(after, 1, 1).between("0", "9")
            ends = (i == 0) & w.endswith("-") & F.substring(after, 1, 1).between("0", "9")
            drops = [F.coalesce(x, F.lit(False)) for x in (named, number, leads, hyphen, ends)]
            return ~(drops[0] | drops[1] | drops[2] | drops[3] | drops[4])

        return test

    def house_number(w: Column, i: Column) -> Column:  # "12-340" is number 340, unit 12
        cut = F.instr(w, "-")
        after = F.substring(w, cut + 1, F.length(w))
        return F.when((i == 0) & (cut > 1) & F.substring(after, 1, 1).between("0", "9"),
                      after).otherwise(w)

    return let(words, lambda ws: F.transform(F.filter(ws, stays(ws)), house_number))


def clean_address(address: ColumnOrName) -> Column:
    """Without the parts of a building (a number behind ``#`` or a unit word, or before the house
    number), lone letters and lone short numbers."""
    parts = F.transform(F.split(col(address), ","), lambda p: F.array_join(_street_words(p), " "))
    def short(p: Column) -> Column:  # one letter, a number, or a number with a letter behind it
        front = F.substring(p, F.lit(1), F.length(p) - 1)
        return (F.length(p) <= 1) | (F.translate(front, "0123456789", "") == "") & (
            F.substring(p, -1, 1).rlike(r"[\p{L}\p{N}]"))

    kept = F.filter(parts, lambda p: ~short(p))
    return F.array_join(kept, ", ")


def _shape(word: Column) -> Column:
    """A for a letter, 9 for a digit."""
    letters, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    return F.translate(F.upper(word), letters + digits, "A" * len(letters) + "9" * len(digits))


def postal_code(address: ColumnOrName, country: ColumnOrName | None = None) -> Column:
    """A Canadian code (letters and digits in turn, in one word or two), else a US code: five
    digits after which the address has no digit; null without one. In Canada five digits are no
    code but the number of a house."""
    words = F.split(col(address), r"[\s,;]+")

    def canadian(ws: Column) -> Column:
        pairs = F.transform(ws, lambda w, i: F.when(_shape(w) == "A9A9A9", w).when(
            (_shape(w) == "A9A") & (_shape(F.get(ws, i + 1)) == "9A9"),
            F.concat(w, F.lit(" "), F.get(ws, i + 1))))
        return F.get(F.array_compact(pairs), F.lit(0))

    def american(ws: Column) -> Column:
        numbers = F.filter(ws, lambda w: _shape(w).contains("9"))
        last = F.try_element_at(numbers, F.lit(-1))
        return F.when(_shape(last) == "99999", last)

    def code(ws: Column) -> Column:
        if country is None:
            return F.coalesce(canadian(ws), american(ws))
        return F.coalesce(canadian(ws), F.when(
            F.coalesce(F.upper(col(country)) != "CA", F.lit(True)), american(ws)))

    return let(words, code)


def region_code(address: ColumnOrName, country: ColumnOrName) -> Column:
    """Second part of the ISO 3166-2 code in an address map (level 6 in France)."""
    level = F.when(F.upper(col(country)) == "FR", "ISO3166-2-lvl6").otherwise("ISO3166-2-lvl4")
    code = F.coalesce(F.try_element_at(col(address), level), F.lit(""))
    return F.when(code.contains("-"), F.regexp_extract(code, r"^[^-]*-(.*)$", 1))
