"""Running values over long groups, split into blocks so that no task holds a whole group.

A window partitioned by capture or project puts one group into one task, and a single group may
hold a third of all rows. Here the order axis is cut into blocks: the window runs inside
``(keys, block)``, an aggregate gives one row per block, a window over those few
rows gives the value carried into each block, and a join on ``(keys, block)`` adds it. The rows are
shuffled once, on ``(keys, block)``.

Block expressions must be non-decreasing in the order columns within a group (for a dense integer
order, ``order div width``). Groups that fit in one block carry nothing and join nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 16
_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, max, last or next; ``upto`` includes the current row."""

    kind: str
    value: Column
    upto: bool = False


def sum_before(value: Column) -> Running:
    return Running("sum", value)


def sum_upto(value: Column) -> Running:
    return Running("sum", value, upto=True)


def row_no() -> Running:
    """1-based position in the group."""
    return Running("sum", F.lit(1), upto=True)


def max_before(value: Column) -> Running:
    return Running("max", value)


def last_upto(value: Column) -> Running:
    """Latest non-null value so far; the as-of fill."""
    return Running("last", value, upto=True)


def last_before(value: Column) -> Running:
    """Latest non-null value on an earlier row; ``lag`` for columns without nulls."""
    return Running("last", value)


def next_row(value: Column) -> Running:
    """Value of the following row, for columns without nulls."""
    return Running("next", value)


def int_block(order: str, width: int = DEFAULT_BLOCK) -> list[Column]:
    return [F.floor(F.col(order) / F.lit(width))]


_BLANK = {"string": "", "boolean": False, "double": 0.0, "float": 0.0}


def _prepare(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Sequence[Column] | None) -> DataFrame:
    """Add non-null key and block columns, and shuffle by them.

    Non-null columns keep the optimiser from adding null filters to one reader of the shuffle only,
    so that both readers (rows and block totals) share it. Null keys stay a group of their own.
    """
    types = dict(df.dtypes)
    safe = [F.coalesce(F.col(k), F.lit(_BLANK.get(types[k], 0)).cast(types[k])).alias(f"__key{i}") for i, k in enumerate(keys)]
    nulls = sum((F.col(k).isNull().cast("int") * (1 << i) for i, k in enumerate(keys)), F.lit(0))
    if block is None:
        block = int_block(order[0])
    lowest = F.lit(-(1 << 62))
    blocks = [F.coalesce(b.cast("bigint"), lowest).alias(f"__block{i}") for i, b in enumerate(block)]
    return df.select("*", *safe, nulls.alias("__keynull"), *blocks)


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Running]) -> DataFrame:
    """The values of ``scan`` for groups that are short lists, such as a project's sections: windows over whole groups.

    Rows that are partitioned by ``keys`` already are not shuffled again, and stay partitioned so.
    """
    at = Window.partitionBy(*keys).orderBy(*order)
    made: dict[str, Column] = {}
    for name, run in values.items():
        frame = at.rowsBetween(*(_UPTO if run.upto else _BEFORE))
        if run.kind == "sum":
            made[name] = F.coalesce(F.sum(run.value).over(frame), F.lit(0))
        elif run.kind == "max":
            made[name] = F.max(run.value).over(frame)
        elif run.kind == "last":
            made[name] = F.last(run.value, ignorenulls=True).over(frame)
        elif run.kind == "next":
            made[name] = F.lead(run.value).over(at)
        else:
            raise ValueError(f"unknown running value {run.kind}")
    return df.withColumns(made)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Running],
    block: Sequence[Column] | None = None,
    keep_blocks: bool = False,
) -> DataFrame:
    """``df`` with one added column per entry of ``values``, in ``order`` within ``keys``.

    The rows are shuffled once and read twice, for the windows and for the block totals. For both to
    read the same shuffle they must need the same columns, so unused columns are not pruned through a
    scan: select what is needed before. With ``keep_blocks`` the block columns stay, and a following
    scan over the same keys reuses them and the partitioning.
    """
    prepared = any(c.startswith("__block") for c in df.columns)
    base = df if prepared else _prepare(df, keys, order, block)
    groups = [c for c in base.columns if c.startswith("__key")]
    blocks = [c for c in base.columns if c.startswith("__block")]
    parts = [*groups, *blocks]
    data = [c for c in df.columns if c not in parts]
    if not prepared:
        base = base.repartition(*parts)
    fingerprint = F.xxhash64(*base.columns)
    inputs = {name: f"__in_{name}" for name in values}
    base = base.select("*", *[r.value.alias(inputs[n]) for n, r in values.items()])
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)

    local_w = Window.partitionBy(*parts).orderBy(*order)
    carry_w = Window.partitionBy(*groups).orderBy(*blocks)
    local, totals, carries, final = [], [], [], []
    for name, run in values.items():
        col, loc, tot, car = F.col(inputs[name]), f"__loc_{name}", f"__tot_{name}", f"__car_{name}"
        frame = local_w.rowsBetween(*(_UPTO if run.upto else _BEFORE))
        carry = carry_w.rowsBetween(*_BEFORE)
        if run.kind == "sum":
            local.append(F.sum(col).over(frame).alias(loc))
            totals.append(F.sum(col).alias(tot))
            carries.append(F.sum(tot).over(carry).alias(car))
            final.append((F.coalesce(F.col(loc), F.lit(0)) + F.coalesce(F.col(car), F.lit(0))).alias(name))
        elif run.kind == "max":
            local.append(F.max(col).over(frame).alias(loc))
            totals.append(F.max(col).alias(tot))
            carries.append(F.max(tot).over(carry).alias(car))
            final.append(F.greatest(F.col(loc), F.col(car)).alias(name))
        elif run.kind == "last":
            local.append(F.last(col, ignorenulls=True).over(frame).alias(loc))
            totals.append(F.max_by(col, F.when(col.isNotNull(), rank)).alias(tot))
            carries.append(F.last(tot, ignorenulls=True).over(carry).alias(car))
            final.append(F.coalesce(F.col(loc), F.col(car)).alias(name))
        elif run.kind == "next":
            local.append(F.lead(col).over(local_w).alias(loc))
            totals.append(F.min_by(col, rank).alias(tot))
            carries.append(F.lead(tot).over(carry_w).alias(car))
            final.append(F.coalesce(F.col(loc), F.col(car)).alias(name))
        else:
            raise ValueError(f"unknown running value {run.kind}")

    some = F.coalesce(*[F.col(f"__car_{n}").cast("string") for n in values])
    carried = (
        base.groupBy(*parts)
        .agg(*totals, F.max(fingerprint).alias("__print"))
        .filter(F.col("__print").isNotNull())
        .select(*parts, *carries)
        .filter(some.isNotNull())
    )
    return (
        base.select("*", *local)
        .filter(F.pmod(fingerprint, F.lit(2)) < 2)  # always true; holds every column at the shuffle
        .join(carried, parts, "left")
        .select(*data, *(parts if keep_blocks else []), *final)
    )
