"""Text expressions: trimming, whitespace cleaning, value checks, numbers and URL parts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.schema import MISSING


# Every Unicode whitespace character.
WHITESPACE = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)])
) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Both ends trimmed of any Unicode whitespace (SQL `trim` alone removes plain blanks only)."""
    return F.trim(text, F.lit(WHITESPACE))


def clean_text(text: Column) -> Column:
    """Whitespace runs become one blank, ends are trimmed, an empty result is NULL."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def has_value(value: Column) -> Column:
    """True for a value that is neither NULL, the missing marker nor blank."""
    return F.coalesce((strip(value) != "") & (value != MISSING), F.lit(False))


def first_number(value: Column) -> Column:
    """First run of digits with an optional fraction, as a double; thousands separators end it."""
    digits = F.regexp_extract(value, r"[0-9]+\.?[0-9]*", 0)
    return F.when(has_value(value), F.nullif(digits, F.lit("")).try_cast("double"))


def pattern_group(pattern: str) -> int | None:
    """Which group a pattern yields: the first one, the whole match, or None if it cannot compile."""
    try:
        return 1 if re.compile(pattern).groups else 0
    except re.error:
        return None


def regex_value(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """First match (group 1 where the pattern has one); NULL without a match or for a bad pattern."""
    group = pattern_group(pattern)
    if group is None:
        return F.lit(None).cast("string")
    java = f"(?i){pattern}" if ignore_case else pattern
    return F.nullif(F.regexp_extract(text, java, group), F.lit(""))


def regex_clean(value: Column, pattern: str) -> Column:
    """Matched part of a value. Without a match the value passes through exactly as it came."""
    group = pattern_group(pattern)
    if group is None:
        return value
    found = F.regexp_extract(value, pattern, group)
    kept = F.when(found != "", found).otherwise(clean_text(value))
    return F.when(value.rlike(pattern), kept).otherwise(value)


def is_absolute_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.lit(False))


def url_authority(url: Column) -> Column:
    """Host with any user and port, as written."""
    return F.nullif(
        F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")
    )


def join_root_relative(base: Column, link: Column) -> Column:
    """Resolve `/path` and `//host/path` against a base URL; any other link stays as it is."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)
    return (
        F.when(url_authority(base).isNull() | ~F.coalesce(link.startswith("/"), F.lit(False)), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .otherwise(F.concat(scheme, F.lit("://"), url_authority(base), link))
    )


def platform_of(url: Column, names: tuple[str, ...]) -> Column:
    """First of `names` that occurs in a URL or label, `generic` when none does."""
    label = F.lower(F.coalesce(url, F.lit("")))
    out = F.lit("generic")
    for name in reversed(names):
        out = F.when(label.contains(name), F.lit(name)).otherwise(out)
    return out


# Platform names, in matching order, of the site labeller and of the templates.
LABEL_PLATFORMS = ("flipkart", "amazon", "ebay")
TEMPLATE_PLATFORMS = ("flipkart", "ajio", "myntra", "amazon")
