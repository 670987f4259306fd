"""Exact medians of groups of any size by radix selection.

A double's bits, folded to the order of the numbers, are selected sixteen at a time: count values by
the next sixteen bits, find the bucket that holds the wanted rank, go on inside it.  Counts are made
before the shuffle, so a group costs at most 65,536 rows a round however many values it has, and no
task ever holds a group's values.  Four rounds over the eight bytes a value that are written once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..plans.durable import cut

STEP, BITS = 16, 64


@F.pandas_udf(LongType())
def _ordered(x: pd.Series) -> pd.Series:
    """Bits of a double as a long that sorts like it; both zeros are one."""
    b = (x.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(b ^ ((b >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF)))


@F.pandas_udf(DoubleType())
def _double(k: pd.Series) -> pd.Series:
    k = k.to_numpy(np.int64)
    return pd.Series((k ^ ((k >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))).view(np.float64))


def upper_medians(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``keys, out``: ``sorted[n / 2]`` of the non-null values of each group; groups without any have no row."""
    # written before the filter, which would else be pushed into the expressions behind the value and repeat them
    bits = cut(rows.select(*keys, F.col(value).cast("double").alias("v_"))).where("v_ is not null").select(*keys, _ordered("v_").alias("k_"))
    chosen = None
    for at in range(BITS - STEP, -1, -STEP):
        # the highest bits keep their sign
        part = F.shiftright("k_", at) if chosen is None else F.shiftright("k_", at).bitwiseAND(F.lit((1 << STEP) - 1))
        live = bits if chosen is None else _same(bits, chosen, keys).where(F.shiftright("k_", at + STEP) == F.col("head_"))
        count = live.groupBy(*keys, part.alias("part_")).agg(F.count("*").alias("n_"))
        w = Window.partitionBy(*keys)
        upto = count.withColumn("upto_", F.sum("n_").over(w.orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)))
        if chosen is None:
            upto = upto.withColumns({"rank_": F.expr("sum(n_) over (partition by %s) div 2" % (", ".join(f"`{k}`" for k in keys) or "1")), "head_": F.lit(0).cast("long")})
        else:
            upto = _same(upto, chosen, keys)
        hit = upto.where("upto_ > rank_ and upto_ - n_ <= rank_")
        chosen = hit.select(*keys, (F.shiftleft("head_", STEP) + F.col("part_")).alias("head_"), (F.col("rank_") - F.col("upto_") + F.col("n_")).alias("rank_"))
    return chosen.select(*keys, _double("head_").alias(out))


def _same(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the one row of ``chosen`` of their group."""
    if not keys:
        return rows.join(F.broadcast(chosen))  # one row
    other = chosen.select(*[F.col(k).alias(f"{k}__") for k in keys], "head_", "rank_")
    on = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    return rows.join(other, on).drop(*[f"{k}__" for k in keys])


def with_median(stats: DataFrame, rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """``stats`` (one row a group) with the upper median of ``value``, NULL where there is none."""
    med = upper_medians(rows, keys, value, out)
    if not keys:
        return stats.join(F.broadcast(med), how="left", on=F.lit(True))  # one row each
    other = med.select(*[F.col(k).alias(f"{k}__") for k in keys], out)
    return stats.join(other, [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys], "left").drop(*[f"{k}__" for k in keys])
