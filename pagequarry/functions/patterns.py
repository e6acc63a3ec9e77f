"""Text patterns counted over page or document text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six patterns (pattern, group returned). `(?i)` where case does not matter. The class of
# token_like ends in its hyphen, so that Java and RE2 read it alike.
PATTERNS = {
    "currency_examples": (r"(?i)(?:(?:₹|Rs\.?|INR|USD|\$|€|€\s?)\s?[0-9][0-9,]*(?:\.\d+)?)", 0),
    "rating_examples": (r"(?i)([0-9](?:\.[0-9])?)\s*(?:out of\s*5|/5|★|stars?)", 1),
    "emails": (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[A-Za-z]{2,}", 0),
    "phones": (r"(?:\+?\d{1,4}[\s-]?)?(?:\d{3,4}[\s-]?\d{3,4}[\s-]?\d{3,4})", 0),
    "dates": (
        r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}"
        r"|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b",
        0,
    ),
    "token_like": (r"\b[A-Za-z0-9_-]{40,}\b", 0),
}

#: What every match of a pattern holds: texts without it are not searched.
NEEDED = {"emails": "@"}

# How many examples are kept, and the words that mark listing content.
EXAMPLE_CAP = 30
SHOP_WORDS = (
    "perfume",
    "price",
    "₹",
    "Rs",
    "rating",
    "review",
    "discount",
    "offer",
    "add to cart",
    "buy now",
    "product",
    "item",
)
SHOP_WORDS_SHORT = ("perfume", "price", "₹", "Rs", "rating", "review", "discount")

# Name parts and input types that make a form input sensitive.
SENSITIVE_PARTS = (
    "password",
    "pwd",
    "pass",
    "pin",
    "ssn",
    "account",
    "acct",
    "card",
    "cvv",
    "cv2",
    "security",
    "token",
    "auth",
    "otp",
)
SENSITIVE_TYPES = ("password", "hidden")
SESSION_NAME = r"(csrf|token|session|jwt)"

WORD = r"[A-Za-z0-9']{2,}"


def pattern_examples(text: Column, name: str) -> Column:
    """The first matches of a pattern, capped as the report caps them."""
    pattern, group = PATTERNS[name]
    found = F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), 1, EXAMPLE_CAP)
    return F.when(~text.contains(NEEDED[name]), F.array().cast("array<string>")).otherwise(found) if name in NEEDED else found


def shop_words_found(text: Column, words: tuple[str, ...] = SHOP_WORDS) -> Column:
    wanted = F.array(*[F.lit(w) for w in words])
    return F.filter(wanted, lambda w: F.lower(text).contains(F.lower(w)))


def content_quality(text: Column) -> Column:
    """Length band of a text: Good, Moderate or Low."""
    size = F.length(text)
    return F.when(size > 5000, "Good").when(size > 1000, "Moderate").otherwise("Low")


def sensitive_name(name: Column) -> Column:
    low = F.lower(name)
    hit = F.lit(False)
    for part in SENSITIVE_PARTS:
        hit = hit | low.contains(part)
    return F.coalesce(hit, F.lit(False))
