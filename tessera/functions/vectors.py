"""Vector and fingerprint expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import tokens


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity held to 0..1; 0 for null, empty, zero or unequally long vectors."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), zero, lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, zero, lambda s, x: s + x.cast("double") * x))
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), F.greatest(zero, F.least(F.lit(1.0), dot / size))).otherwise(zero)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays taken as sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def hash64(word: Column) -> Column:
    """The upper 64 bits of a word's MD5 as a signed number."""
    return F.conv(F.substring(F.md5(word), 1, 16), 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def blocks(print_: Column) -> Column:
    """The four 16-bit parts of a fingerprint, lowest first."""
    return F.array(*[F.shiftrightunsigned(print_, 16 * i).bitwiseAND(F.lit(65535)) for i in range(4)])


def bucket(word: Column, buckets: int) -> Column:
    """Bucket of a word by the first 8 hex digits of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def wide_bucket(word: Column, buckets: int) -> Column:
    """Bucket of a word by all 128 bits of its MD5, taken as one number; 32 bits at a time."""
    rest = F.lit(0).cast("bigint")
    for k in range(4):
        part = F.conv(F.substring(F.md5(word), 8 * k + 1, 8), 16, 10).cast("bigint")
        rest = F.pmod(rest * F.lit(2**32 % buckets) + part, F.lit(buckets))
    return rest.cast("int")


def token_coverage(query_tokens: Column, text: Column) -> Column:
    """Share of the query tokens that are found in the text; 0 without tokens."""
    found = F.size(F.filter(query_tokens, lambda t: F.contains(text, t)))
    return found / F.greatest(F.size(query_tokens), F.lit(1))


def query_tokens(query: Column) -> Column:
    """Tokens of a query with more than two characters."""
    return F.filter(tokens(query), lambda t: F.length(t) > 2)
