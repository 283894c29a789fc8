"""Order-dependent operations that stay parallel inside one hot key.

A plain window puts every row of a key into one task. Here each key is cut into
blocks of its order column: the in-block part is a window over (key, block), the
blocks are summarised with a map-side-combined aggregate (one row per block),
only these summaries are windowed per key, and an equi-join brings the carry
back. A key with a third of all rows is thus spread over as many tasks as it has
blocks. The blocked form reads its input twice.

``block=None`` gives the plain window. It is the default for groups that stem
from one text value (the headings of a document): these are bounded by the value
itself, and a chain of such steps shares a single exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536


def _block(pos: str, block: int) -> Column:
    return F.floor(F.col(pos) / F.lit(block))


def carry(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: dict[str, Column],
    after: bool = False,
    inclusive: bool = False,
    ties: Sequence[str] = (),
    block: int | None = None,
) -> DataFrame:
    """Add, per row, the last non-null value among the rows before it.

    ``after=True`` gives the next non-null value among the rows after it;
    ``inclusive`` counts the row itself.
    """
    keys, ties = list(keys), list(ties)
    order = [F.col(c) for c in [pos, *ties]]
    order = [c.desc() if after else c.asc() for c in order]
    stop = Window.currentRow if inclusive else -1
    base = df.columns
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, stop)
        return df.select("*", *[F.last(v, ignorenulls=True).over(w).alias(n) for n, v in values.items()])

    d = df.select("*", _block(pos, block).alias("__blk"), *[v.alias(f"__v_{n}") for n, v in values.items()])
    w = Window.partitionBy(*keys, "__blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, stop)
    inner = d.select(
        *base, "__blk", *[F.last(f"__v_{n}", ignorenulls=True).over(w).alias(f"__in_{n}") for n in values]
    )
    rank = F.struct(F.col(pos), *[F.col(t) for t in ties])
    pick = F.min_by if after else F.max_by
    ends = d.groupBy(*keys, "__blk").agg(
        *[pick(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), rank)).alias(f"__end_{n}") for n in values]
    )
    blk = F.col("__blk").desc() if after else F.col("__blk").asc()
    wb = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *keys, "__blk", *[F.last(f"__end_{n}", ignorenulls=True).over(wb).alias(f"__pre_{n}") for n in values]
    )
    joined = inner.join(ends, [*keys, "__blk"], "left")
    return joined.select(*base, *[F.coalesce(f"__in_{n}", f"__pre_{n}").alias(n) for n in values])


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: Column,
    out: str,
    inclusive: bool = False,
    ties: Sequence[str] = (),
    block: int | None = None,
) -> DataFrame:
    """Add the sum of ``value`` over the rows before each row (0 for the first)."""
    keys, ties = list(keys), list(ties)
    order = [F.col(c).asc() for c in [pos, *ties]]
    stop = Window.currentRow if inclusive else -1
    base = df.columns
    if block is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, stop)
        return df.select("*", F.coalesce(F.sum(value).over(w), F.lit(0)).alias(out))
    d = df.select("*", _block(pos, block).alias("__blk"), value.alias("__v"))
    w = Window.partitionBy(*keys, "__blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, stop)
    inner = d.select(*base, "__blk", F.coalesce(F.sum("__v").over(w), F.lit(0)).alias("__in"))
    wb = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    tot = (
        d.groupBy(*keys, "__blk")
        .agg(F.sum("__v").alias("__s"))
        .select(*keys, "__blk", F.coalesce(F.sum("__s").over(wb), F.lit(0)).alias("__pre"))
    )
    joined = inner.join(tot, [*keys, "__blk"], "left")
    return joined.select(*base, (F.col("__in") + F.coalesce("__pre", F.lit(0))).alias(out))


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    out: str,
    ties: Sequence[str] = (),
    block: int | None = None,
) -> DataFrame:
    """Add 0, 1, 2, … per key in the order of ``pos`` (and ``ties``)."""
    return running_sum(df, keys, pos, F.lit(1), out, ties=ties, block=block)


def asof_join(
    probes: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    probe_pos: str,
    event_pos: str,
    cols: Sequence[str],
    event_tie: str | None = None,
    block: int | None = None,
) -> DataFrame:
    """Left as-of join: the last event at or before each probe (last of equals).

    Linear in both sides: one union and one carry, no theta join.
    """
    keys = list(keys)
    tie = F.col(event_tie).cast("long") if event_tie else F.lit(0).cast("long")
    ev = events.select(
        *keys,
        F.col(event_pos).cast("long").alias("__pos"),
        F.lit(0).alias("__kind"),
        tie.alias("__tie"),
        F.struct(*cols).alias("__ev"),
    )
    pr = probes.select(
        *keys,
        F.col(probe_pos).cast("long").alias("__pos"),
        F.lit(1).alias("__kind"),
        F.lit(0).cast("long").alias("__tie"),
        F.struct(*[F.col(c) for c in probes.columns]).alias("__row"),
    )
    u = ev.unionByName(pr, allowMissingColumns=True)
    u = carry(u, keys, "__pos", {"__hit": F.col("__ev")}, inclusive=True, ties=["__kind", "__tie"], block=block)
    return u.where("__kind = 1").select("__row.*", *[F.col(f"__hit.{c}").alias(c) for c in cols])
