"""Problem 9: fill fixed-capacity containers with items of varying length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.positions import grouped_positions
from tessera.session import materialise

UNITS = 256  # steps into which a capacity is divided when patterns are enumerated
ROUNDS = 400  # steps of the non-negative least squares


def patterns(units: int) -> np.ndarray:
    """All multisets of at most three lengths (1..units) that fill ``units`` exactly; 0 pads."""
    rows = [(units, 0, 0)]
    rows += [(a, units - a, 0) for a in range((units + 1) // 2, units)]
    rows += [(a, b, units - a - b) for a in range((units + 2) // 3, units - 1) for b in range((units - a + 1) // 2, min(a, units - a - 1) + 1)]
    return np.array(rows, np.int64)


def repeat_counts(rows: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Non-negative least squares: how often to use each pattern so that the lengths used come near ``need``.

    Projected gradient with Nesterov's momentum; the step is bounded through the row and column sums
    of the pattern matrix. The result is rounded down and trimmed until no length is overdrawn.
    """
    size = len(need)
    flat = rows.ravel()
    used = lambda x: np.bincount(flat, np.repeat(x, rows.shape[1]), size)[:size] * (np.arange(size) > 0)
    per_length = np.bincount(flat, minlength=size)
    step = 1 / (9 * max(1, per_length[1:].max()))
    allowed = (rows == 0) | (need[rows] > 0)
    live = allowed.all(axis=1)
    target = need.astype(float)
    x = np.zeros(len(rows))
    y, t = x.copy(), 1.0
    for _ in range(ROUNDS):
        gap = used(y) - target
        gap[0] = 0
        new = np.where(live, np.maximum(0, y - step * 3 * gap[rows].sum(axis=1)), 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = np.maximum(0, new + (t - 1) / after * (new - x)), new, after
    counts = np.floor(x + 1e-6).astype(np.int64)
    while True:
        over = used(counts).astype(np.int64) - need
        over[0] = 0
        if (over <= 0).all():
            return counts
        worst = int(np.argmax(over))
        for k in np.argsort(-((rows == worst).sum(axis=1) * counts)):
            if over[worst] <= 0:
                break
            times = int((rows[k] == worst).sum())
            if times and counts[k]:
                cut = min(counts[k], -(-over[worst] // times))
                counts[k] -= cut
                over[worst] -= cut * times


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """Slots (length, first rank, ranks, first container): rank r of a length goes to container first + r - first rank.

    Patterns of up to three lengths get their repeat counts by non-negative least squares over the
    histogram in units of capacity / UNITS (lengths rounded up, so no container overflows). What is
    left is packed best-fit, longest first, on whole histogram groups: groups of containers with
    equal free space take groups of items with equal length. Work depends on the capacity, not on
    the number of items.
    """
    left = {int(n): int(c) for n, c in zip(lengths, counts) if n > 0 and c > 0}
    rank = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int]] = []
    base = 0
    free: dict[int, list[list[int]]] = {}  # free space -> groups [first container, containers]

    def take(length: int, n: int, first: int) -> None:
        slots.append((length, rank[length], n, first))
        rank[length] += n
        left[length] -= n

    unit = max(1, -(-capacity // UNITS))
    units = capacity // unit
    need = np.zeros(units + 1, np.int64)
    by_unit: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        u = -(-n // unit)
        if u <= units:
            need[u] += left[n]
            by_unit.setdefault(u, []).append(n)
    rows = patterns(units)
    for row, times in zip(rows, repeat_counts(rows, need)):
        todo = int(times)
        while todo:
            chosen, usage = [], {}
            for u in row:
                if u:
                    n = next(n for n in by_unit[int(u)] if left[n] > usage.get(n, 0))
                    usage[n] = usage.get(n, 0) + 1
                    chosen.append(n)
            m = min([todo, *(left[n] // k for n, k in usage.items())])
            for n in chosen:
                take(n, m, base)
            if space := capacity - sum(chosen):
                free.setdefault(space, []).append([base, m])
            base += m
            todo -= m
    spaces = np.zeros(capacity + 1, bool)
    spaces[list(free)] = True
    for n in sorted(left, reverse=True):
        while left[n]:
            fit = np.flatnonzero(spaces[n:])
            if len(fit):
                space = n + int(fit[0])
                group = free[space][-1]
                m = min(left[n], group[1])
                take(n, m, group[0])
                rest, first = space - n, group[0]
                group[0] += m
                group[1] -= m
                if not group[1]:
                    free[space].pop()
                    spaces[space] = bool(free[space])
            else:
                per = capacity // n  # fill new containers with this length alone
                m = max(1, left[n] // per) if left[n] >= per else 1
                first = base
                each = min(per, left[n])
                for _ in range(each):
                    take(n, m, first)
                base += m
                rest = capacity - n * each
            if rest:
                free.setdefault(rest, []).append([first, m])
                spaces[rest] = True
    return slots


SCHEMA = T.StructType(
    [
        T.StructField("container_type", T.StringType()),
        T.StructField("container_id", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("first_token", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


def pack(sizes: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """A container of each capacity for each document of ``sizes`` (doc_id, n_tokens).

    A document larger than the capacity is cut into full pieces and a rest; nothing else is split.
    Documents of size 0 or null take no space: their container is -1. Repeated rows are packed like other items. The
    driver sees only the histogram of lengths, at most one row per length and capacity. No
    capacities, or no rows, give an empty result.
    """
    spark = sizes.sparkSession
    capacities = {k: int(v) for k, v in capacities.items() if v and v > 0}
    kinds = F.array(*[F.struct(F.lit(k).alias("container_type"), F.lit(v).cast("long").alias("capacity")) for k, v in sorted(capacities.items())])
    if not capacities:
        return spark.createDataFrame([], SCHEMA)
    each = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("total"), F.explode(kinds).alias("k")).select("doc_id", "total", "k.*")
    cut = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("total") / F.col("capacity")) - 1).cast("long"))
    parts = each.withColumn("piece_no", F.explode(cut)).withColumn("first_token", F.col("piece_no") * F.col("capacity"))
    parts = parts.withColumn("n_tokens", F.least(F.col("capacity"), F.col("total") - F.col("first_token")))
    parts = materialise(parts.select("container_type", "doc_id", F.col("piece_no").cast("int"), "first_token", "n_tokens"))
    some = parts.where("n_tokens > 0")
    histogram = some.groupBy("container_type", "n_tokens").agg(F.count("*").alias("n")).collect()
    plans = {}
    for kind, capacity in capacities.items():
        own = [(r.n_tokens, r.n) for r in histogram if r.container_type == kind]
        table = np.array(sorted(plan(np.array([x for x, _ in own]), np.array([n for _, n in own]), capacity)), np.int64).reshape(-1, 4)
        plans[kind] = table
    shared = spark.sparkContext.broadcast(plans)
    width = np.int64(2**40)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            kind = np.array(columns["container_type"].to_pylist(), object)
            size = columns["n_tokens"].to_numpy(zero_copy_only=False)
            rank = columns["position"].to_numpy(zero_copy_only=False)
            out = np.zeros(len(size), np.int64)
            for name, table in shared.value.items():
                own = np.flatnonzero(kind == name)
                if len(own):
                    slot = np.searchsorted(table[:, 0] * width + table[:, 1], size[own] * width + rank[own], side="right") - 1
                    out[own] = table[slot, 3] + rank[own] - table[slot, 1]
            arrays = {"container_id": pa.array(out)} | columns
            yield pa.RecordBatch.from_arrays([arrays[f.name] for f in SCHEMA], names=SCHEMA.names)

    ranked = grouped_positions(some, ["container_type", "n_tokens"], [F.col("doc_id"), F.col("piece_no")])
    empty = parts.where("n_tokens <= 0").select("container_type", F.lit(-1).cast("long").alias("container_id"), "doc_id", "piece_no", "first_token", "n_tokens")
    return ranked.mapInArrow(place, SCHEMA).unionByName(empty)
