"""Column expressions used across the package.  All stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(v: Column) -> Column:
    """True for a real number; NaN, infinities and null are not finite.

    Needed before any comparison or min/max: Spark orders NaN above all numbers.
    """
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def finite_or_null(v: Column) -> Column:
    return F.when(is_finite(v), v)


def non_finite_kind(v: Column) -> Column:
    return F.when(F.isnan(v), "nan").when(v > 0, "+inf").otherwise("-inf")


def log10_floor(v: Column) -> Column:
    return F.log10(F.greatest(v, F.lit(1e-12)))


# Fixed rule: a path part made only of digits and underscores, with at least
# eight digits, is a timestamp or run id and not part of a metric's name.
ID_PART = "^[0-9_]+$"
ID_DIGITS = 8


def clean_path(path: Column) -> Column:
    """Path without its timestamp / id parts; may become empty."""
    named = F.filter(
        F.split(path, "/"),
        lambda p: ~(p.rlike(ID_PART) & (F.length(F.replace(p, F.lit("_"), F.lit(""))) >= ID_DIGITS)),
    )
    return F.array_join(named, "/")


def clean_tag(tag: Column) -> Column:
    """``clean_path`` that leaves a tag alone rather than emptying it."""
    cleaned = clean_path(tag)
    return F.when(cleaned != "", cleaned).otherwise(tag)


def prefixed(prefix: Column, tag: Column) -> Column:
    return F.when(F.coalesce(prefix, F.lit("")) == "", tag).otherwise(F.concat(prefix, F.lit("/"), tag))


def first_segment(tag: Column) -> Column:
    return F.split(tag, "/")[0]


def _numbers_as_digits(name: Column, letters) -> Column:
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def key(p):
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(
            p.rlike("^[0-9]+$"),
            F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits),
        ).otherwise(letters(p))

    return F.array_join(F.transform(parts, key), "")


def natural_key(name: Column) -> Column:
    """Sort key under which ``layers.2`` comes before ``layers.10``.

    Digit runs are written as their length and then their digits (leading zeros
    dropped), so numbers of any size compare as numbers.
    """
    return _numbers_as_digits(name, F.lower)


#: Order of the Unicode root locale: letters by base letter, then accent, then case (lower first).
LOCALE = "UNICODE"


def by_locale(name: Column) -> Column:
    return F.collate(name, LOCALE)


def locale_key(name: Column) -> Column:
    """The natural key in the order of a locale: accents and case only decide where all else is equal."""
    return by_locale(_numbers_as_digits(name, lambda p: p))


def digit_mask(token: Column) -> Column:
    return F.regexp_replace(token, "[0-9]+", "#")


def is_integer_name(token: Column) -> Column:
    return token.rlike("^[0-9]+$")


def clean_config_value(v: Column) -> Column:
    """Trim blanks, then any quotes around the value."""
    blanks = F.lit(" \t\r\n\f\u000b")
    return F.btrim(F.btrim(v, blanks), F.lit("'\""))


def first_non_empty(*cols: Column) -> Column:
    """First value that is neither null nor empty; the last one is the fallback."""
    return F.coalesce(*[F.when(c != "", c) for c in cols[:-1]], cols[-1])


def numbered_name(prefix: str, i: Column) -> Column:
    return F.format_string(prefix.replace("%", "%%") + "%03d", i)


def text_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def tag_matches(tag: Column, pattern: str) -> Column:
    """Case-insensitive regex *find*; text that is no valid regex is a substring.

    Validity is decided once on the driver, before a plan exists.  The regex
    dialect is Java's.
    """
    if not pattern:
        return F.lit(True)
    if _is_java_regex(pattern):
        return tag.rlike("(?i)" + pattern)
    return contains_ignore_case(tag, pattern)


def contains_ignore_case(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(needle)))


def _is_java_regex(pattern: str) -> bool:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    jvm = getattr(getattr(spark, "_sc", None), "_jvm", None) if spark else None
    if jvm is not None:
        try:
            jvm.java.util.regex.Pattern.compile(pattern)
            return True
        except Exception:
            return False
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False
