"""Near-duplicate texts by pigeonring filtering over fingerprints.

A text is the set of its distinct word triples. Its fingerprint lies on a ring of SEGMENTS segments of
WIDTH minimum hashes of the triples; a segment differs between two texts if any of its hashes does. At
the threshold a segment differs with probability 1 - SIMILARITY ** WIDTH, and the BUDGET of differing
segments a segment lies above that. By the pigeonring principle a pair within the budget on the whole
ring has a start from which every chain of 1, 2, 3, ... consecutive segments is within the budget in
proportion to its length. The chains of up to CHAIN segments are the index of the search: with at most
0, 1, 2, 2 differing segments of 1, 2, 3, 4, a viable chain has its first segment equal and one of
the three after it, which makes three join keys a start. Two texts share a key if and only if they have
a viable chain. Pairs that share one pass, still inside the join, a check of their numbers of triples
and the full Hamming check over all minimum hashes; at last the triples themselves are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

SEGMENTS, WIDTH = 24, 2
N = SEGMENTS * WIDTH  # minimum hashes of a fingerprint, 16 bits each; 4 bits of each in the full check
SHORT = N // 16  # 64-bit numbers that hold the four-bit values
SIMILARITY = 0.6
BUDGET = 0.7499  # differing segments a segment
CHAIN = 4  # segments of the longest chain that the index looks at
#: Standard deviations that the fingerprint of a pair at the threshold may stray in the full check.
SLACK = 3.5
#: Texts of one key that are compared in one task; a key with more is cut into blocks.
BLOCK = 2_000
AT_ONCE = 2_000  # texts fingerprinted together, below 2 ** 11
_WORD = re.compile(r"[^\W_]+")
PRINTS = "tbl string, id string, same bigint, size int, print binary, " + ", ".join(f"s{k} bigint" for k in range(SHORT))
KEYS = "no bigint, key bigint"
PAIRS = "tbl string, a string, b string"


def words(text: str) -> list[str]:
    """Runs of letters and digits of the lower-cased text."""
    return _WORD.findall(text.lower())


def triples(text: str) -> set[tuple[str, str, str]]:
    w = words(text)
    return set(zip(w, w[1:], w[2:]))


def most_apart(similarity: float = SIMILARITY) -> float:
    """Four-bit values that may differ between the fingerprints of two texts at the threshold."""
    equal = similarity + (1 - similarity) / 16
    return N * (1 - equal) + SLACK * (N * equal * (1 - equal)) ** 0.5


@lru_cache(1)
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.RandomState(31)
    return random.randint(0, 2**32, N, dtype=np.uint64).astype(np.uint32) | np.uint32(1), random.randint(0, 2**32, N, dtype=np.uint64).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    """64-bit hash of each word, kept while it is in use."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def fingerprints(texts: list[str | None], known: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the texts that have triples; of each a hash of its set of triples, the set's size, its fingerprint (N values)."""
    found = [words(t) if t else [] for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    own = np.flatnonzero(sizes >= 3)
    if not len(own):
        return own, np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, N), np.uint16)
    h = np.fromiter((known[w] for k in own for w in found[k]), np.uint64, int(sizes[own].sum()))
    ends = np.cumsum(sizes[own])
    t = _mix(h[:-2] + _mix(h[1:-1] + _mix(h[2:]) * np.uint64(3)) * np.uint64(5))
    inside = np.ones(len(t), bool)
    for back in (1, 2):
        at = ends[:-1] - back
        inside[at[at < len(t)]] = False
    t = t[inside]
    # One number holds the text (11 bits) and the triple's hash (53 bits), so that one sort finds the distinct ones.
    packed = np.sort(np.repeat(np.arange(len(own), dtype=np.uint64), sizes[own] - 2) << np.uint64(53) | t >> np.uint64(11))
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    packed = packed[new]
    owner, t = (packed >> np.uint64(53)).astype(np.int64), _mix(packed & np.uint64((1 << 53) - 1))
    starts = np.searchsorted(owner, np.arange(len(own)))
    same = _mix(np.add.reduceat(_mix(t ^ np.uint64(0x5851F42D4C957F2D)), starts)).view(np.int64)
    low = (t >> np.uint64(16)).astype(np.uint32)
    x = np.empty_like(low)
    least = np.empty((N, len(own)), np.uint32)
    for k, (a, b) in enumerate(zip(*_hashes())):
        np.bitwise_xor(low, b, out=x)
        np.multiply(x, a, out=x)
        np.bitwise_xor(x, x >> np.uint32(15), out=x)  # products alone leave the minima dependent on each other
        np.multiply(x, np.uint32(0x2C1B3C6D), out=x)
        np.minimum.reduceat(x, starts, out=least[k])
    values = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return own, same, np.diff(starts, append=len(t)).astype(np.int32), np.ascontiguousarray(values.astype(np.uint16).T)


def shortened(values: np.ndarray) -> np.ndarray:
    """Four bits of each value in SHORT 64-bit numbers a fingerprint."""
    four = (values >> np.uint16(12)).astype(np.uint8)
    return np.ascontiguousarray(four[:, 0::2] << np.uint8(4) | four[:, 1::2]).view(np.int64)


def segment_values(values: np.ndarray) -> np.ndarray:
    """One number for each segment of the ring."""
    parts = values.reshape(len(values), SEGMENTS, WIDTH).astype(np.uint64)
    out = np.zeros((len(values), SEGMENTS), np.uint64)
    for k in range(WIDTH):
        out = out << np.uint64(16) | parts[:, :, k]
    return out


def viable(differ: np.ndarray, chain: int = CHAIN) -> np.ndarray:
    """Starts (pair by segment) from which every chain of up to ``chain`` segments is within the budget.

    ``differ`` says which segments of a pair differ. A pair with at most BUDGET * SEGMENTS differing
    segments has such a start for every ``chain``.
    """
    alive, total = np.ones(differ.shape, bool), np.zeros(differ.shape, np.int64)
    for k in range(chain):
        total += np.roll(differ, -k, axis=1)
        alive &= total <= BUDGET * (k + 1)
    return alive


def chain_keys(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Join keys (48 bits) of fingerprints: equal for two texts if and only if they have a viable chain.

    A key holds the table, the start, which later segment of the chain is equal too, and both values.
    """
    ring = segment_values(values)
    start = np.arange(SEGMENTS, dtype=np.uint64)
    first = _mix(ring + (start + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + table[:, None])
    out = [_mix(first + np.roll(ring, -k, axis=1) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k)) for k in range(1, CHAIN)]
    return (np.concatenate(out, axis=1) >> np.uint64(16)).view(np.int64)


def _fixed(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _array(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for at in range(0, len(texts), AT_ONCE):
            own, same, size, values = fingerprints(texts[at : at + AT_ONCE], known)
            take, short = pa.array(own + at), shortened(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(same), pa.array(size), _fixed(values), *(pa.array(short[:, k]) for k in range(SHORT))],
                names=["tbl", "id", "same", "size", "print", *(f"s{k}" for k in range(SHORT))],
            )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            table = np.asarray(batch.column(1)).view(np.uint64)
            keys = chain_keys(_array(batch.column(2), np.uint16, N), table)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), keys.shape[1])), pa.array(keys.ravel())], names=["no", "key"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, set] = {}  # the sets of the texts met last; pairs come sorted by one side

    def of(text: str) -> set:
        if (found := held.get(text)) is None:
            if len(held) >= 2000:
                held.clear()
            held[text] = found = triples(text)
        return found

    for batch in batches:
        ok = []
        for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            p, q = of(x), of(y)
            both = len(p & q)
            ok.append(both >= SIMILARITY * (len(p) + len(q) - both))
        yield batch.select([0, 1, 2]).filter(pa.array(ok, pa.bool_()))


def _differ(x: str, y: str) -> Column:
    """How many four-bit values of two fingerprints differ."""
    total = F.lit(0)
    for k in range(SHORT):
        d = F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        total = total + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def classes_of(prints: DataFrame, *columns: str) -> DataFrame:
    """tbl, same, rep, no and ``columns`` of one row of each class of equal triple sets, the one with the smallest id."""
    first = prints.groupBy("tbl", "same").agg(F.min(F.struct("id", "no", *columns)).alias("r"))
    return first.select("tbl", "same", F.col("r.id").alias("rep"), "r.no", *(f"r.{c}" for c in columns))


def candidates(prints: DataFrame) -> DataFrame:
    """Pairs p < q (no) of the classes of ``prints`` that have a viable chain and pass the full checks.

    Most keys have one text and are dropped after one pass over the sorted keys; what the full checks
    need joins the rest. A key with more than BLOCK texts is cut into blocks and each pair of blocks
    is a task of its own, so that no task compares more than 2 * BLOCK texts of a key. No join here may
    broadcast: Spark sizes these tables by their files, which don't tell how many keys come of a row.
    """
    keyed = classes_of(prints, "print").select("no", F.xxhash64("tbl").alias("t"), "print").mapInArrow(_keys, KEYS)
    counted = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    short = [f"s{k}" for k in range(SHORT)]
    counted = counted.join(classes_of(prints, "size", *short).select("no", "size", *short).hint("merge"), "no")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    tiled = counted.withColumn("block", F.pmod(F.xxhash64("no"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiled = tiled.select("no", "key", "size", *short, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    x, y = tiled.hint("merge").alias("x"), tiled.alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("x.no") < F.col("y.no")) & ((F.col("x.i") == F.col("x.j")) | (F.col("x.block") != F.col("y.block")))
    sizes = F.least("x.size", "y.size") >= SIMILARITY * F.greatest("x.size", "y.size")
    return x.join(y, met & once & sizes & (_differ("x", "y") <= most_apart())).select(F.col("x.no").alias("p"), F.col("y.no").alias("q")).distinct()


def similar(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal triple sets, and the similar pairs of class representatives.

    ``items`` has tbl, id, text. The first result has a row per (tbl, id): tbl, id, same (the class),
    rep (the smallest id of the class). The second has tbl, a, b with a < b: representatives whose
    triples' Jaccard similarity is at least SIMILARITY. Texts with fewer than three words, null texts
    and null ids take no part; repeated rows count once. A class of copies, however large, enters the
    search as one text. Two texts of one (tbl, id) would count as two texts of that id.
    """
    rows = items.where("id is not null and text is not null").select("tbl", "id", "text")
    prints = materialise(rows.mapInArrow(_prints, PRINTS).withColumn("no", F.monotonically_increasing_id()))
    reps = classes_of(prints)
    members = materialise(prints.select("tbl", "id", "same").distinct().join(reps.select("tbl", "same", "rep").hint("merge"), ["tbl", "same"]))
    left = reps.select(F.col("no").alias("p"), "tbl", F.col("rep").alias("r")).hint("merge")
    right = reps.select(F.col("no").alias("q"), F.col("tbl").alias("t2"), F.col("rep").alias("s")).hint("merge")
    both = candidates(prints).join(left, "p").join(right, "q").where("tbl = t2 and r <> s")
    near = materialise(both.select("tbl", F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")))
    wanted = near.select("tbl", F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = rows.join(wanted.hint("merge"), ["tbl", "id"], "left_semi").groupBy("tbl", "id").agg(F.max("text").alias("text"))
    full = near.join(texts.select("tbl", F.col("id").alias("a"), F.col("text").alias("x")).hint("merge"), ["tbl", "a"])
    full = full.join(texts.select("tbl", F.col("id").alias("b"), F.col("text").alias("y")).hint("merge"), ["tbl", "b"])
    links = materialise(full.select("tbl", "a", "b", "x", "y").mapInArrow(_verified, PAIRS))
    return members, links


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair (tbl, chunk_a, chunk_b): copies within a class, and members of linked classes."""
    own = members.hint("merge")
    copies = own.alias("x").join(members.alias("y"), (F.col("x.tbl") == F.col("y.tbl")) & (F.col("x.same") == F.col("y.same")) & (F.col("x.id") < F.col("y.id")))
    copies = copies.select("x.tbl", F.col("x.id").alias("chunk_a"), F.col("y.id").alias("chunk_b"))
    left, right = (members.select("tbl", F.col("rep").alias(k), F.col("id").alias(v)).hint("merge") for k, v in (("a", "p"), ("b", "q")))
    linked = links.join(left, ["tbl", "a"]).join(right, ["tbl", "b"]).where("p <> q").select("tbl", F.least("p", "q").alias("chunk_a"), F.greatest("p", "q").alias("chunk_b"))
    return copies.unionByName(linked).distinct()


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """tbl, id, group (the smallest id reachable), links (texts linked to it, copies of itself among them).

    Connected components by passing on the smallest label and jumping to the label's label, until
    nothing changes; each round is written to the shared folder. Ids without a link are groups of
    their own.
    """
    edges = materialise(links.select("tbl", "a", "b").unionByName(links.select("tbl", F.col("b").alias("a"), F.col("a").alias("b"))))
    sizes = members.groupBy("tbl", "rep").agg(F.count("*").alias("n"))
    label = materialise(edges.select("tbl", "a").distinct().withColumn("label", F.col("a")))
    while True:
        least = edges.join(label.select("tbl", F.col("a").alias("b"), F.col("label").alias("other")).hint("merge"), ["tbl", "b"]).groupBy("tbl", "a").agg(F.min("other").alias("other"))
        step = label.join(least.hint("merge"), ["tbl", "a"]).select("tbl", "a", "label", F.least("label", "other").alias("next"))
        jump = label.select("tbl", F.col("a").alias("next"), F.col("label").alias("far"))
        step = materialise(step.join(jump.hint("merge"), ["tbl", "next"], "left").select("tbl", "a", "label", F.least("next", F.coalesce("far", "next")).alias("next")))
        label = step.select("tbl", "a", F.col("next").alias("label"))
        if not step.where("next <> label").limit(1).count():
            break
    degree = edges.join(sizes.withColumnRenamed("rep", "b").hint("merge"), ["tbl", "b"]).groupBy("tbl", "a").agg(F.sum("n").alias("linked"))
    out = members.join(sizes.hint("merge"), ["tbl", "rep"]).join(label.withColumnRenamed("a", "rep").hint("merge"), ["tbl", "rep"], "left").join(degree.withColumnRenamed("a", "rep").hint("merge"), ["tbl", "rep"], "left")
    return out.select("tbl", "id", F.coalesce("label", "rep").alias("group"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
