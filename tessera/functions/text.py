"""Text expressions: words, sizes, cleaning, hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters, digits and underscores in any script; the same in Java's and RE2's expressions.
TOKEN = r"[\p{L}\p{N}_]+"
#: Runs of characters that aren't white space.
WORD = r"[^\s\p{Z}]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def token_estimate(text: Column) -> Column:
    """The larger of floor(1.3 words) and floor(characters / 3.5), at least 1; 0 for null and empty."""
    size = F.greatest(F.floor(word_count(text) * F.lit(1.3)), F.floor(F.length(text) / F.lit(3.5)), F.lit(1))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(size).cast("bigint")


def useful_text(text: Column) -> Column:
    """Without tags, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "), r"\s+", " "))


def sanitised(text: Column) -> Column:
    """Without control characters (but tab and line ends), trimmed; empty for null."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def compatible(text: Column) -> Column:
    """The text with compatibility forms of characters replaced (NFKC); plain ASCII is left as it is."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.when(text.rlike(r"[^\x00-\x7F]"), nfkc(text)).otherwise(text)


def content_hash(text: Column) -> Column:
    """SHA-256 of the text in lower case with runs of blanks and of line ends squeezed.

    Give it ``compatible(text)`` where compatibility forms of characters are to count as equal.
    """
    squeezed = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t]+", " "), "\n+", "\n")
    return F.sha2(F.lower(F.regexp_replace(squeezed, r"^\s+|\s+$", "")), 256)


def sentences(text: Column, least: int = 0) -> Column:
    """Trimmed sentences longer than ``least`` characters."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.length(s) > least)


def slug(text: Column) -> Column:
    """Lower case with runs of other than letters and digits as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def clean_markdown(text: Column) -> Column:
    """No-break spaces as blanks, lines trimmed, at most one blank line in a row."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" "))
    lines = F.array_join(F.transform(F.split(plain, "\r\n|\n|\r"), lambda s: F.regexp_replace(s, r"^[ \t]+|[ \t]+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def fit_markdown(text: Column) -> Column:
    """Without lines that are nothing but a short link to an address on the same site."""
    lone = lambda s: F.regexp_like(F.trim(s), F.lit(r"^[*\-]?\s*\[[^\]]*\]\((/|#)[^)]*\)$")) & (F.length(F.trim(s)) < 35)
    return F.array_join(F.filter(F.split(text, "\n"), lambda s: ~lone(s)), "\n")
