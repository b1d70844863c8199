"""Time-blocked windows: ordered operators that never put a whole series into one task.

A window partitioned by series alone sends a long recording to one task. Here every ordered
operator works on (series, block) with a bounded block, and passes between blocks only what the
next one needs: neighbouring rows for bounded frames (``with_halo``), one summary row per block
for unbounded ones (``ordinal``, ``carry``, ``running_total``). The block is a deterministic function of the row, so
a lost executor recomputes the same split.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numeric import as_col

BLOCK_ROWS = 4096
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def index_block(order, rows: int = BLOCK_ROWS) -> Column:
    """Block of a dense integer order: at most ``rows`` rows per series and block."""
    return F.floor(as_col(order) / rows)


def time_block(t_us, span_us: int = DAY_US) -> Column:
    """Block of an integer microsecond time; pick the span so that rate x span fits a task."""
    return F.floor(as_col(t_us) / span_us)


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str = "sample_idx"
) -> DataFrame:
    """Zero-based position within the series. Block counts are prefix-summed, rows only ranked in their block."""
    tagged = df.withColumn("__blk", block)
    by_block = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "__blk")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__off", F.coalesce(F.sum("__n").over(by_block), F.lit(0)))
        .drop("__n")
    )
    local = Window.partitionBy(*keys, "__blk").orderBy(*order)
    return (
        tagged.join(offsets, [*keys, "__blk"])
        .withColumn(out, (F.row_number().over(local) - 1 + F.col("__off")).cast("long"))
        .drop("__blk", "__off")
    )


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    before: int,
    after: int,
    build: Callable[[WindowSpec], Mapping[str, Column] | Sequence[Mapping[str, Column]]],
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Columns over a frame reaching at most ``before``/``after`` positions of a dense index.

    Rows next to a block edge are copied into the neighbouring block, so each block is complete by
    itself; copies are dropped again afterwards. ``build`` may return several steps, later ones over
    columns of earlier ones; the reach must cover their sum.
    """
    rows = max(rows, before + after + 1)
    own = index_block(idx, rows)
    copies = F.sequence(
        F.floor((F.col(idx) - after) / rows).cast("long"), F.floor((F.col(idx) + before) / rows).cast("long")
    )
    window = Window.partitionBy(*keys, "__blk").orderBy(idx)
    out = df.withColumn("__blk", F.explode(copies))
    steps = build(window)
    for step in [steps] if isinstance(steps, Mapping) else steps:
        out = out.withColumns(dict(step))
    return out.where(F.col("__blk") == own).drop("__blk")


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    last: Mapping[str, Column] | None = None,
    first: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Latest non-null value at or before each row (``last``), earliest at or after it (``first``)."""
    last, first = dict(last or {}), dict(first or {})
    values = {**{f"__l_{k}": v for k, v in last.items()}, **{f"__f_{k}": v for k, v in first.items()}}
    tagged = df.withColumns({"__blk": block, **values})
    position = F.struct(*[F.col(c) for c in order])
    summary = tagged.groupBy(*keys, "__blk").agg(
        *[F.max_by(f"__l_{k}", F.when(F.col(f"__l_{k}").isNotNull(), position)).alias(f"__in_l_{k}") for k in last],
        *[F.min_by(f"__f_{k}", F.when(F.col(f"__f_{k}").isNotNull(), position)).alias(f"__in_f_{k}") for k in first],
    )
    # "first after" is "last before" in descending order: growing frames are linear, shrinking ones quadratic
    earlier = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col("__blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *keys,
        "__blk",
        *[F.last(f"__in_l_{k}", ignorenulls=True).over(earlier).alias(f"__in_l_{k}") for k in last],
        *[F.last(f"__in_f_{k}", ignorenulls=True).over(later).alias(f"__in_f_{k}") for k in first],
    )
    local = Window.partitionBy(*keys, "__blk").orderBy(*order)
    up_to = local.rowsBetween(Window.unboundedPreceding, 0)
    backwards = Window.partitionBy(*keys, "__blk").orderBy(*[F.col(c).desc() for c in order])
    from_here = backwards.rowsBetween(Window.unboundedPreceding, 0)
    joined = tagged.join(summary, [*keys, "__blk"])
    # rows before a block's first value take what earlier blocks handed over
    out = joined.withColumns(
        {
            **{k: F.coalesce(F.last(f"__l_{k}", ignorenulls=True).over(up_to), F.col(f"__in_l_{k}")) for k in last},
            **{k: F.coalesce(F.last(f"__f_{k}", ignorenulls=True).over(from_here), F.col(f"__in_f_{k}")) for k in first},
        }
    )
    return out.drop("__blk", *values, *[f"__in_l_{k}" for k in last], *[f"__in_f_{k}" for k in first])


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column, out: str
) -> DataFrame:
    """Inclusive running sum within the series."""
    tagged = df.withColumns({"__blk": block, "__v": value})
    earlier = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "__blk")
        .agg(F.sum("__v").alias("__s"))
        .withColumn("__off", F.coalesce(F.sum("__s").over(earlier), F.lit(0)))
        .drop("__s")
    )
    local = Window.partitionBy(*keys, "__blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged.join(offsets, [*keys, "__blk"])
        .withColumn(out, F.sum("__v").over(local) + F.col("__off"))
        .drop("__blk", "__v", "__off")
    )


def runs(df: DataFrame, keys: Sequence[str], idx: str, flag: Column, breaks: Column | None = None) -> DataFrame:
    """Islands of consecutive true rows of a dense index: adds run_start, run_end (NULL outside runs).

    ``breaks`` is an optional identity; a change of it starts a new run.
    """
    tagged = df.withColumns({"__on": F.coalesce(flag, F.lit(False)), "__id": breaks if breaks is not None else F.lit(0)})

    def edges(window):
        def other(step):
            shift = F.lag if step < 0 else F.lead
            return F.coalesce(
                shift("__on", 1).over(window) & (shift("__id", 1).over(window).eqNullSafe(F.col("__id"))), F.lit(False)
            )

        return {"__open": F.col("__on") & ~other(-1), "__close": F.col("__on") & ~other(1)}

    marked = with_halo(tagged, keys, idx, 1, 1, edges)
    filled = carry(
        marked,
        keys,
        [idx],
        index_block(idx),
        last={"run_start": F.when(F.col("__open"), F.col(idx))},
        first={"run_end": F.when(F.col("__close"), F.col(idx))},
    )
    on = F.col("__on")
    return filled.withColumns(
        {"run_start": F.when(on, F.col("run_start")), "run_end": F.when(on, F.col("run_end"))}
    ).drop("__on", "__id", "__open", "__close")


def expand_range(df: DataFrame, keys: Sequence[str], start: Column, stop: Column, out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per integer in [start, stop]. Ranges are cut into blocks that are spread over tasks
    before they are expanded, so one long range is neither one array nor one task."""
    cut = df.withColumns({"__a": start.cast("long"), "__z": stop.cast("long")}).where("__z >= __a")
    cut = cut.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__z") - F.col("__a")) / rows).cast("long"))))
    spread = cut.repartition(*keys, "__part")
    low = F.col("__a") + F.col("__part") * rows
    return spread.withColumn(out, F.explode(F.sequence(low, F.least(F.col("__z"), low + rows - 1)))).drop("__a", "__z", "__part")
