"""Permutation importance of any model (M8): how much worse its error gets when one feature's values are dealt anew.

The rows get dense ranks in two random orders (by md5 of their key and a seed); the row of rank i in one order takes the
values of the row of rank i in the other, a permutation by one join on the rank. Every row then becomes one variant per
feature, with that feature alone replaced, and one unchanged; the model scores all variants in one pass, and one aggregate
per variant gives the errors. Ranks come from counts of 4,096 hash ranges (a table of that fixed size is broadcast) and
row numbers inside a range, so no task sorts all rows.

Defined results: ``key`` must identify a row (rows with one key are ranked in any order); rows whose prediction or truth is
null take no part in a variant's error; an empty table gives one row per feature with null errors and n = 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.aggregates import prediction_metrics

RANGE_DIGITS = 3        # hex digits of the hash that name a range: 16^3 ranges
VARIANT = "_variant"


def random_rank(df: DataFrame, key: Sequence[str], seed: int, name: str) -> DataFrame:
    """``df`` with a dense rank from 0, in the order of md5(key parts joined by | with the seed)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    d = df.withColumn("_h", F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))))
    d = d.withColumn("_range", F.substring("_h", 1, RANGE_DIGITS))
    counts = d.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)      # at most 4,096 rows
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    in_range = Window.partitionBy("_range").orderBy("_h")
    return (d.join(F.broadcast(offsets), "_range")
            .withColumn(name, F.col("_before") + F.row_number().over(in_range) - F.lit(1))
            .drop("_h", "_range", "_before"))


def variants(df: DataFrame, features: Sequence[str], key: Sequence[str], seed: int = 42) -> DataFrame:
    """Each row unchanged (``_variant`` null) and once per feature with that feature's value from another row."""
    rows = random_rank(df, key, seed, "_rank")
    donors = random_rank(df.select(*key, *[c for c in features if c not in key]), key, seed + 1, "_donor_rank")
    donors = donors.select("_donor_rank", *[F.col(c).alias(f"_donor_{c}") for c in features])
    both = rows.join(donors, F.col("_rank") == F.col("_donor_rank"))
    out = both.withColumn(VARIANT, F.explode(F.array(F.lit(None).cast("string"), *[F.lit(c) for c in features])))
    return out.withColumns({c: F.when(F.col(VARIANT).eqNullSafe(F.lit(c)), F.col(f"_donor_{c}")).otherwise(F.col(c))
                            for c in features}).drop("_rank", "_donor_rank", *[f"_donor_{c}" for c in features])


def permutation_importance(df: DataFrame, score: Callable[[DataFrame], DataFrame], features: Sequence[str], y_true: str,
                           key: Sequence[str] = ("city", "time"), seed: int = 42) -> DataFrame:
    """(feature, rmse, rmse_permuted, importance, n) per feature. ``score`` adds ``y_pred`` to rows: a saved pipeline's
    ``transform``, a closed-form fit's ``predict`` or an expression. Features must not be part of ``key``."""
    if set(features) & set(key):
        raise ValueError("a key column cannot be permuted")
    scored = score(variants(df, features, key, seed))
    scored = scored.filter(F.col("y_pred").isNotNull() & F.col(y_true).isNotNull())
    m = prediction_metrics(scored, y_true, "y_pred", group=[VARIANT])
    names = df.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    base = m.filter(F.col(VARIANT).isNull()).agg(F.max("rmse").alias("rmse"))      # one row
    changed = m.select(F.col(VARIANT).alias("feature"), F.col("rmse").alias("rmse_permuted"), "n")
    return (names.join(changed, "feature", "left").join(F.broadcast(base))
            .select("feature", "rmse", "rmse_permuted", (F.col("rmse_permuted") - F.col("rmse")).alias("importance"),
                    F.coalesce("n", F.lit(0)).alias("n")))
