"""Joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

HOT_KEYS = 1000
SALTS = 64


def _salt(many: DataFrame, keys: Sequence[str], salts: int) -> Column:
    others = [c for c in many.columns if c not in keys]
    return F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int") if others else F.lit(0)


def salted_join(many: DataFrame, one: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of ``many`` rows to ``one`` row per key.

    Only the most frequent keys are salted: any key that holds more than a
    thousandth of the rows is among the first thousand by count.  Their rows
    in ``one`` are repeated once per salt, all others stay single, so the
    right side grows by at most ``HOT_KEYS * SALTS`` rows.  The list of hot
    keys has at most ``HOT_KEYS`` rows, which bounds what is broadcast.
    Counting combines on the map side.  The salt is a hash of the row, not a
    random number, so a re-run task sends its rows to the same places.
    """
    keys = list(keys)
    hot = (
        many.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_"))
        .orderBy(F.desc("n_"), *keys)
        .limit(HOT_KEYS)
        .select(*keys, F.lit(True).alias("hot_"))
    )
    spread = _salt(many, keys, SALTS)
    left = many.join(F.broadcast(hot), keys, "left").withColumn(
        "salt_", F.when(F.col("hot_"), spread).otherwise(F.lit(0))
    )
    right = one.join(F.broadcast(hot), keys, "left").withColumn(
        "salt_",
        F.explode(F.when(F.col("hot_"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))),
    )
    return left.drop("hot_").join(right.drop("hot_"), [*keys, "salt_"]).drop("salt_")
