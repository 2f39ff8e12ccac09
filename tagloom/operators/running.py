"""Running values over ordered groups that may be far larger than one task.

Groups are cut into slices of the ordering axis. Values run inside a slice, each slice is summarised in one
row, and the summaries carry the state into the next slice. Only (group, slice) rows meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("last", "prev", "sum", "count_before")


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_expr: Column,
    outputs: dict[str, tuple[str, Column]],
    descending: bool = False,
) -> DataFrame:
    """Add running columns.

    Kinds: `last` latest non-null value up to this row, `prev` latest non-null value before it, `sum` running
    sum including this row, `count_before` number of non-null values before this row. Values of `last` and
    `prev` may be structs. `slice_expr` must be monotone in the order columns.
    """
    named = df.withColumns({f"_x_{name}": value for name, (_, value) in outputs.items()}).withColumn("_s", slice_expr)
    by = [F.desc(c) if descending else F.asc(c) for c in order]
    here = Window.partitionBy(*keys, "_s").orderBy(*by)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    aggs, carries = [], {}
    slices = Window.partitionBy(*keys).orderBy(F.desc("_s") if descending else F.asc("_s"))
    past = slices.rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min_by if descending else F.max_by
    local = {}
    for name, (kind, _) in outputs.items():
        x = F.col(f"_x_{name}")
        if kind in ("last", "prev"):
            where = F.when(x.isNotNull(), F.struct(*order))
            aggs.append(pick(x, where).alias(f"_y_{name}"))
            carries[f"_c_{name}"] = F.last(F.col(f"_y_{name}"), ignorenulls=True).over(past)
            frame = upto if kind == "last" else before
            local[name] = F.last(x, ignorenulls=True).over(frame)
        elif kind == "sum":
            aggs.append(F.sum(x).alias(f"_y_{name}"))
            carries[f"_c_{name}"] = F.sum(F.col(f"_y_{name}")).over(past)
            local[name] = F.sum(x).over(upto)
        else:
            aggs.append(F.count(x).alias(f"_y_{name}"))
            carries[f"_c_{name}"] = F.sum(F.col(f"_y_{name}")).over(past)
            local[name] = F.count(x).over(before)
    summary = named.groupBy(*keys, "_s").agg(*aggs).withColumns(carries).select(*keys, "_s", *carries)
    out = named.withColumns(local).join(summary, [*keys, "_s"], "left")
    final = {}
    for name, (kind, _) in outputs.items():
        if kind in ("last", "prev"):
            final[name] = F.coalesce(F.col(name), F.col(f"_c_{name}"))
        else:
            final[name] = F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
    return out.withColumns(final).select(*df.columns, *outputs)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per group; the rank filter is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
