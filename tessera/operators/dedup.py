"""Exact and near-duplicate detection."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions import vectors as V
from tessera.session import materialise

BITS = 64
#: Bits of the six parts of a fingerprint, lowest first; within distance 3 three of them are equal.
PARTS = (11, 11, 11, 11, 10, 10)
FINGERPRINT = "fingerprint bigint"


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the smallest ``order`` values; null keys are equal to each other.

    An aggregation with a partial step, so a key with very many rows is reduced before the shuffle.
    """
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def distinct_urls(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per canonical URL (added as canonical), the first in ``order``; rows without a URL are dropped."""
    return first_by(df.where("url is not null").withColumn("canonical", U.canonical_url(F.col("url"))), ["canonical"], order)


def exact_duplicates(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, content_hash, first_id (smallest id with that content), is_duplicate. Null texts are left out."""
    rows = df.where("text is not null").select(F.col(id_column).alias("id"), F.sha2("text", 256).alias("content_hash"))
    firsts = rows.groupBy("content_hash").agg(F.min("id").alias("first_id"))
    return rows.join(firsts, "content_hash").withColumn("is_duplicate", F.col("id") > F.col("first_id"))


def _folded(rows: DataFrame) -> DataFrame:
    """id and fingerprint of rows (id, grams array<string>): each bit is the sign of the votes of all grams; a tie sets it.

    A text is folded where it is, in one pass without a shuffle: the grams of a batch are hashed once
    each and their bits added up per text. Rows without grams are left out.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa

    def fold(batches):
        for batch in batches:
            grams = batch.column(1)
            for at in range(0, batch.num_rows, 100):
                part = grams.slice(at, 100)
                known = part.flatten().dictionary_encode()
                if not len(known):
                    continue
                hashes = np.frombuffer(b"".join(hashlib.md5(g.encode()).digest()[:8] for g in known.dictionary.to_pylist()), ">u8").astype("<u8")
                bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
                sizes = np.diff(part.offsets.to_numpy())
                own = np.flatnonzero(sizes)
                ends = np.cumsum(sizes[own])
                votes = np.add.reduceat(bits[known.indices.to_numpy()], ends - sizes[own], axis=0)
                prints = np.packbits(votes >= 0, axis=1, bitorder="little").view("<i8").ravel()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own + at)), pa.array(prints)], names=["id", "fingerprint"])

    return rows.select("id", "grams").mapInArrow(fold, f"id {rows.schema['id'].dataType.simpleString()}, {FINGERPRINT}")


def simhash(df: DataFrame, id_column: str = "doc_id", most: int | None = None) -> DataFrame:
    """id and SimHash fingerprint over the tokens of each text (the first ``most``, if given); texts without tokens are left out."""
    words = T.tokens(F.col("text"))
    return _folded(df.select(F.col(id_column).alias("id"), (F.slice(words, 1, most) if most else words).alias("grams")))


def shingle_simhash(df: DataFrame, id_column: str = "doc_id", most: int | None = None) -> DataFrame:
    """The same over pairs of neighbouring tokens of two or more characters (a lone token stands for itself)."""
    rows = df.select(F.col(id_column).alias("id"), F.filter(T.tokens(F.col("text")), lambda t: F.length(t) > 1).alias("w"))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.when(F.size("w") < 2, F.col("w")).otherwise(F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))
    return _folded(rows.select("id", (F.slice(pairs, 1, most) if most else pairs).alias("grams")))


def _part_keys() -> list[Column]:
    """A key for each choice of three of the six parts: within distance 3 two fingerprints share one."""
    parts, at = [], 0
    for bits in PARTS:
        parts.append(((1 << bits) - 1) << at)
        at += bits
    masks = [sum(c) for c in combinations(parts, 3)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    return [F.struct(F.lit(k).alias("k"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("bigint")).alias("v")) for k, m in enumerate(signed)]


def _block_keys(radius: int) -> Column:
    """The four 16-bit blocks with up to ``radius`` bits turned."""
    flips = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(16), n)]
    turned = F.array(*[F.lit(m).cast("bigint") for m in flips])
    blocks = F.transform(V.blocks(F.col("fingerprint")), lambda v, i: F.transform(turned, lambda m: F.struct(i.alias("k"), v.bitwiseXOR(m).alias("v"))))
    return F.flatten(blocks)


def near_classes(prints: DataFrame, distance: int = 3) -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints (fingerprint, n, first: the smallest id), and pairs f < g of classes
    at most ``distance`` apart. Fingerprints of 0 take no part.

    Up to distance 3 classes meet on one of 20 keys of 31 to 33 bits. Beyond it one of four 16-bit
    blocks differs in a quarter of the distance at most: one side brings its blocks, the other its
    blocks with that many bits turned. Every pair is found at any distance, but keys and candidates
    grow with it (697 keys a block at 12), so large tables want a small distance. A class counts as
    one, however many copies it has.
    """
    if not 0 <= distance <= 15:
        raise ValueError("distance from 0 to 15")
    classes = materialise(prints.where("fingerprint <> 0").groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    some = classes.select("fingerprint")
    if distance <= 3:
        left = right = some.select("fingerprint", F.explode(F.array(*_part_keys())).alias("key"))
    else:
        left, right = (some.select("fingerprint", F.explode(_block_keys(r)).alias("key")) for r in (0, distance // 4))
    x, y = (d.select("fingerprint", "key.k", "key.v").alias(n) for d, n in ((left, "x"), (right, "y")))
    close = F.bit_count(F.col("x.fingerprint").bitwiseXOR(F.col("y.fingerprint")))
    order = F.col("x.fingerprint") < F.col("y.fingerprint") if distance <= 3 else F.col("x.fingerprint") != F.col("y.fingerprint")
    met = x.hint("merge").join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.v") == F.col("y.v")) & order & (close <= distance))
    f, g = F.col("x.fingerprint"), F.col("y.fingerprint")
    return classes, met.select(F.least(f, g).alias("f"), F.greatest(f, g).alias("g"), close.cast("int").alias("distance")).distinct()


def near_pairs(prints: DataFrame, distance: int = 3) -> DataFrame:
    """id_a < id_b and distance of all rows at most ``distance`` apart, copies written out pair by pair."""
    prints = materialise(prints.select("id", "fingerprint"))
    _, apart = near_classes(prints, distance)
    some = prints.where("fingerprint <> 0")
    left, right = some.select(F.col("id").alias("p"), F.col("fingerprint").alias("f")), some.select(F.col("id").alias("q"), F.col("fingerprint").alias("g"))
    across = apart.join(left, "f").join(right, "g").select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"), "distance")
    same = left.join(right, F.col("f") == F.col("g")).where("p < q").select(F.col("p").alias("id_a"), F.col("q").alias("id_b"), F.lit(0).alias("distance"))
    return across.unionByName(same)


def near_matches(prints: DataFrame, distance: int = 3) -> DataFrame:
    """id, n_near, near_dup_of (smallest earlier id within the distance, null if none): one row per fingerprint row.

    Counts and smallest ids are those of whole classes; copies are never paired with each other.
    """
    prints = materialise(prints.select("id", "fingerprint"))
    classes, apart = near_classes(prints, distance)
    apart = materialise(apart)
    both = apart.select("f", "g").unionByName(apart.select(F.col("g").alias("f"), F.col("f").alias("g")))
    other = classes.select(F.col("fingerprint").alias("g"), F.col("n").alias("m"), F.col("first").alias("o"))
    around = both.join(other, "g").groupBy(F.col("f").alias("fingerprint")).agg(F.sum("m").alias("m"), F.min("o").alias("o"))
    known = classes.join(around, "fingerprint", "left").select("fingerprint", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_near"), F.least("first", "o").alias("o"))
    joined = prints.join(known, "fingerprint", "left")
    return joined.select("id", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("o") < F.col("id"), F.col("o")).alias("near_dup_of"))


def components(edges: DataFrame) -> DataFrame:
    """id and cluster (smallest id reachable) for every end of ``edges`` (id_a, id_b).

    Each round passes the smallest label over the edges and jumps to the label's label, and is
    written to the shared folder, so the lineage stays short. It ends when a round changes nothing.
    """
    both = materialise(edges.select(F.col("id_a").alias("id"), F.col("id_b").alias("other")).unionByName(edges.select(F.col("id_b").alias("id"), F.col("id_a").alias("other"))).distinct())
    label = materialise(both.groupBy("id").agg(F.least(F.min("other"), F.first("id")).alias("cluster")))
    while True:
        near = both.join(label.select(F.col("id").alias("other"), F.col("cluster").alias("c")), "other").groupBy("id").agg(F.min("c").alias("c"))
        step = label.join(near, "id").select("id", "cluster", F.least("cluster", "c").alias("next"))
        step = step.join(label.select(F.col("id").alias("next"), F.col("cluster").alias("far")), "next", "left")
        step = materialise(step.select("id", "cluster", F.least("next", F.coalesce("far", "next")).alias("next")))
        label = step.select("id", F.col("next").alias("cluster"))
        if not step.where("next <> cluster").limit(1).count():
            return label


def clusters(prints: DataFrame, distance: int = 3) -> DataFrame:
    """id and cluster (smallest id) of every fingerprint row; a text without neighbours is its own cluster.

    Classes of equal fingerprints are joined up, not their rows.
    """
    prints = materialise(prints.select("id", "fingerprint"))
    classes, apart = near_classes(prints, distance)
    ends = [classes.select(F.col("fingerprint").alias(k), F.col("first").alias(v)) for k, v in (("f", "id_a"), ("g", "id_b"))]
    found = components(apart.join(ends[0], "f").join(ends[1], "g").select("id_a", "id_b"))
    named = classes.join(found, F.col("first") == F.col("id"), "left").select("fingerprint", F.coalesce("cluster", "first").alias("cluster"))
    return prints.join(named, "fingerprint", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def incremental_clusters(known: DataFrame, prints: DataFrame, distance: int = 3) -> DataFrame:
    """id, fingerprint, cluster of ``known`` (the same columns) and new rows ``prints`` (id, fingerprint).

    New rows join the clusters of what they are near to; a row near to several clusters unites them
    under the smallest id. Old clusters come in as links between their rows and their id, so only
    these and the new neighbourhoods are joined up.
    """
    rows = materialise(known.select("id", "fingerprint").unionByName(prints.select("id", "fingerprint")))
    classes, apart = near_classes(rows, distance)
    ends = [classes.select(F.col("fingerprint").alias(k), F.col("first").alias(v)) for k, v in (("f", "id_a"), ("g", "id_b"))]
    old = known.where("id <> cluster").select(F.col("cluster").alias("id_a"), F.col("id").alias("id_b"))
    copies = rows.join(classes, "fingerprint").where("id <> first").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    found = components(apart.join(ends[0], "f").join(ends[1], "g").select("id_a", "id_b").unionByName(old).unionByName(copies))
    return rows.join(found, "id", "left").select("id", "fingerprint", F.coalesce("cluster", "id").alias("cluster"))


def document_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, is_exact_dup, n_near, near_dup_of: exact copies by hash, near copies among the first of each content."""
    exact = exact_duplicates(docs)
    firsts = docs.join(exact.where("not is_duplicate").select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    near = near_matches(simhash(firsts))
    rows = exact.join(near, "id", "left")
    return rows.select(F.col("id").alias("doc_id"), F.col("is_duplicate").alias("is_exact_dup"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "near_dup_of")
