"""Ranks, running counts and medians without a window over a whole key.

Rows are cut into ranges of their order; each range counts on its own, and only
one row per range and key, its total, meets in a window.  A key with a third of
all rows is spread over as many ranges as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rasterlake.session import materialize


def running(df: DataFrame, order: list[str], weight: str | None = None, keys: list[str] | None = None, name: str = "upto") -> DataFrame:
    """``df`` with the rows (or the sum of ``weight``) up to and with each row, in its key's order."""
    return running_sums(df, order, {name: F.lit(1) if weight is None else F.col(weight)}, keys)


def running_sums(df: DataFrame, order: list[str], sums: dict, keys: list[str] | None = None) -> DataFrame:
    """``df`` with the sums of columns up to and with each row, in its key's order.

    ``order`` must be unique within a key.  The ranges are written once, so both
    uses of them see the same cut.
    """
    keys = keys or []
    cut = materialize(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranks")
    own = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = cut.groupBy("__part", *keys).agg(*(F.sum(c).alias(n) for n, c in sums.items()))  # a row for each range and key
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("__part", *keys, *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__base_{n}") for n in sums))
    base = base.withColumnsRenamed({c: f"__of_{c}" for c in ("__part", *keys)})
    on = F.col("__part") == F.col("__of___part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    joined = cut.withColumns({f"__own_{n}": F.sum(c).over(own) for n, c in sums.items()}).join(F.broadcast(base), on)
    return joined.select(*df.columns, *((F.col(f"__own_{n}") + F.col(f"__base_{n}")).alias(n) for n in sums))


def medians(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """``keys, med_<col>...``: exact medians, the mean of the two middle values; null without values.

    All columns go through one cut into ranges, with their name as part of the key.
    """
    keys = keys or []
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("__col"), F.col(c).cast("double").alias("__v")) for c in cols)))
    long = df.select(*keys, each.alias("__e")).select(*keys, "__e.*").filter("__v is not null")
    own = [*keys, "__col"]
    upto = running(long.groupBy(*own, "__v").agg(F.count("*").alias("n")), ["__v"], "n", own)
    half = upto.groupBy(*own).agg(F.max("upto").alias("total"))
    both = upto.join(F.broadcast(half), own)  # one row per key and column
    low, high = (F.floor((F.col("total") + k) / 2) for k in (1, 2))
    has = lambda at: (F.col("upto") - F.col("n") < at) & (at <= F.col("upto"))
    pick = lambda c, at: F.max(F.when((F.col("__col") == c) & has(at), F.col("__v")))
    med = both.groupBy(*keys).agg(*(((pick(c, low) + pick(c, high)) / 2).alias(f"med_{c}") for c in cols))
    return df.select(*keys).distinct().join(F.broadcast(med), keys, "left") if keys else med
