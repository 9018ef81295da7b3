"""Coercion of loosely typed values to numbers, texts and categories (Column in, Column out)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from terratally import fixed_values as K


def number(c: Column) -> Column:
    """Text or number as a double; anything unreadable, and NaN, is null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def safe_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(number(c), F.lit(float(default)))


def safe_int(c: Column, default: int = 0) -> Column:
    """Truncated whole number; unreadable or infinite values take the default."""
    return F.coalesce(number(c).try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_text(c: Column, default: str | Column) -> Column:
    d = F.lit(default) if isinstance(default, str) else default
    return F.when(F.trim(c) != "", F.trim(c)).otherwise(d)


def either_text(a: Column, b: Column) -> Column:
    """``a`` unless it is null or empty, else ``b``."""
    return F.when(a != "", a).otherwise(b)


def clamp(c: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Bound to [lo, hi]; unreadable values become ``lo``."""
    return F.least(F.greatest(F.coalesce(number(c), F.lit(float(lo))), F.lit(float(lo))), F.lit(float(hi)))


def finite(c: Column) -> Column:
    """The value when finite, else null."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def clamp_display(c: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Display rule: infinite values become ``lo`` as well."""
    return clamp(finite(number(c)), lo, hi)


def rounded(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def normalize_category(c: Column) -> Column:
    """Closed set of nine: exact name in any case, else the first keyword line that matches.

    The cleaned text is the one item of an array, so that it is made once a row and not once for every comparison.
    Inside an array function a long CASE is looked up branch by branch from its start; a list of short ones is not.
    """
    def named(low: Column) -> Column:
        exact = [(low == name.lower(), F.lit(name)) for name, *_ in K.CATEGORIES]
        loose = [
            (reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(name))
            for name, words in K.CATEGORY_KEYWORDS
        ]
        default = F.lit(K.DEFAULT_CATEGORY)
        return F.coalesce(*[F.when(cond, value) for cond, value in [(low == "", default), *exact, *loose]], default)

    return F.get(F.transform(F.array(F.lower(F.trim(F.coalesce(c, F.lit(""))))), named), F.lit(0))


def class_to_category(c: Column) -> Column:
    """Detector class name to category: alias table first, then the keyword rules."""
    key = F.translate(F.lower(F.trim(c)), "- ", "__")
    pairs = [F.lit(x) for kv in K.CLASS_ALIASES.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], normalize_category(F.translate(c, "_", " ")))


def is_building(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).contains("building")


def _literal_map(position: int) -> Column:
    return F.create_map(*[F.lit(x) for row in K.CATEGORIES for x in (row[0], row[position])])


def layer_of(category: Column) -> Column:
    return F.coalesce(_literal_map(1)[category], F.lit(K.UNKNOWN_LAYER))


def color_of(category: Column) -> Column:
    return F.coalesce(_literal_map(2)[category], F.lit(K.UNKNOWN_COLOR))


def layer_shape(layer: Column) -> Column:
    return (
        F.when(layer.isin("roads", "drains"), "line")
        .when(layer.isin("green_cover", "parks", "water"), "polygon")
        .otherwise("box")
    )


def plain_digits(c: Column) -> Column:
    """Shortest digits of a double written out without an exponent, and without zeros at the end of a fraction."""
    whole = c.cast("string").try_cast("decimal(38,0)").cast("string")
    cut = F.regexp_replace(c.cast("string").try_cast("decimal(38,18)").cast("string"), r"0+$", "")
    return F.when((F.abs(c) >= 1e15) | (c == F.floor(c)), whole).otherwise(cut)


def with_exponent(c: Column, width: int = 1) -> Column:
    """Double as digits, ``e``, sign and exponent of at least ``width`` digits."""
    text = c.cast("string")
    power = F.regexp_extract(text, r"E(-?)(\d+)$", 2)
    sign = F.when(F.regexp_extract(text, r"E(-?)", 1) == "-", "-").otherwise("+")
    return F.concat(F.regexp_replace(F.regexp_extract(text, r"^(.*)E", 1), r"\.0$", ""), F.lit("e"), sign, F.lpad(power, F.greatest(F.length(power), F.lit(width)), F.lit("0")))


def to_area_m2(area_px: Column, mpp: Column | float = 1.0) -> Column:
    m = meters_per_pixel(mpp)
    return F.greatest(area_px, F.lit(0.0)) * (m * m)


def to_length_m(length_px: Column, mpp: Column | float = 1.0) -> Column:
    return F.greatest(length_px, F.lit(0.0)) * meters_per_pixel(mpp)


def meters_per_pixel(raw: Column | float | str) -> Column:
    """Calibration value; zero, negative or unreadable input counts as 1."""
    v = number(raw if isinstance(raw, Column) else F.lit(raw))
    return F.when(v > 0, v).otherwise(F.lit(1.0))


def block_confidence(cells: Column) -> Column:
    return F.least(F.lit(85.0) + cells * 2, F.lit(99.0))


def map_confidence(coverage: Column) -> Column:
    return F.least(F.lit(99.0), F.greatest(F.lit(45.0), F.lit(60.0) + coverage * 4.0))


def video_confidence(presence: Column) -> Column:
    return F.greatest(F.lit(35.0), F.least(F.lit(99.0), F.lit(45.0) + presence * 50.0))
