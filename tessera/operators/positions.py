"""Exact positions inside sorted groups without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the lower 33 bits


def grouped_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """Add the 0-based position of each row among the rows with equal ``keys`` in ``order``.

    The rows are range-partitioned by keys *and* order, so a hot group is spread over many tasks.
    Prefix sums of the partition sizes give global positions, from which the start of the group is
    subtracted; starts join on partition and keys, so a hot group stays spread. Only one number per
    partition reaches the driver. ``order`` must be total for the
    result to be defined; null keys form a group of their own, and
    without keys all rows are one group. An empty input gives an empty result.
    """
    by = [F.col(k).asc_nulls_first() for k in keys]
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = materialise(ranged.withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__row", _BITS)
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("p")).agg(F.count("*")).collect())
    total, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    before = df.sparkSession.createDataFrame(offsets, "__part bigint, __before bigint")
    rows = rows.join(F.broadcast(before), part == F.col("__part"))  # one row per partition
    rows = rows.withColumn("__at", F.col("__before") + F.col("__row").bitwiseAND(F.lit((1 << _BITS) - 1))).drop("__part", "__before")
    if not keys:
        return rows.withColumn(name, F.col("__at").cast("long")).drop("__row", "__at")
    names = [f"__key{i}" for i in range(len(keys))]
    here = rows.groupBy(part.alias("__part"), *[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.min("__at").alias("__from"))
    whole = here.groupBy(*[F.col(n).alias(f"{n}_") for n in names]).agg(F.min("__from").alias("__start"))  # a row a group and partition
    starts = here.join(whole, _equal(names, [f"{n}_" for n in names])).select("__part", "__start", *names)
    rows = rows.join(starts, (part == F.col("__part")) & _equal(keys, names))
    return rows.withColumn(name, (F.col("__at") - F.col("__start")).cast("long")).drop("__row", "__at", "__start", "__part", *names)


def grouped_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """Add running sums up to and with each row of its group (equal ``keys``) in ``order``.

    As in ``grouped_positions`` a group is spread over many tasks: each adds up its own part, to which
    the totals of the parts before it are added. Nulls count as 0.
    """
    by = [F.col(k).asc_nulls_first() for k in keys]
    ranged = df.withColumns({f"__{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()})
    rows = materialise(ranged.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__row", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftrightunsigned("__row", _BITS))
    names = [f"__key{i}" for i in range(len(keys))]
    total = rows.groupBy("__part", *[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in values])
    parts = Window.partitionBy(*names).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = total.select(F.col("__part").alias("__p"), *names, *[F.coalesce(F.sum(f"__t_{n}").over(parts), F.lit(0)).alias(f"__b_{n}") for n in values])
    here = Window.partitionBy("__part", *keys).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(f"__{n}").over(here).alias(f"__s_{n}") for n in values])
    rows = rows.join(before, (F.col("__part") == F.col("__p")) & _equal(keys, names))
    out = rows.withColumns({n: F.col(f"__s_{n}") + F.col(f"__b_{n}") for n in values})
    return out.select(*df.columns, *values)


def _equal(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of columns by pairs, where null equals null."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])
