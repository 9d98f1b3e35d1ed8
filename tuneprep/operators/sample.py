"""Exact split, even preview and seeded shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.operators.ranking import (
    bucket_offsets, exact_rank, hash_order, nth_key, with_hash_bucket, with_ord_bucket,
)
from pyspark.sql import Window


def split_train_val(rows: DataFrame, ratio: float = 0.9, shuffle: bool = True, seed: int = 42,
                    id_col: str = "ord") -> DataFrame:
    """Add ``split`` with exactly floor(n * ratio) train rows.

    Only the cut-off key is looked for (histogram, then one bucket); the rows themselves are
    labelled in place and never shuffled.
    """
    ids = rows.select(id_col)
    if shuffle:
        key = F.concat(hash_order(id_col, seed), F.lit(":"), F.col(id_col).cast("string"))
        bucketed = with_hash_bucket(ids.withColumn("_key", key), "_key")
    else:
        key = F.col(id_col)
        bucketed = with_ord_bucket(ids, id_col).withColumn("_key", key)
    cut = nth_key(bucketed, F.col("_key"), F.floor(F.col("n") * F.lit(float(ratio))))
    train = F.coalesce(key < cut, F.lit(True))  # no cut-off: every row is train
    return rows.withColumn("split", F.when(train, "train").otherwise("val"))


def shuffle_rows(rows: DataFrame, seed: int = 42, id_col: str = "ord") -> DataFrame:
    """Add ``pos``: the position of each row in a seeded random order."""
    hashed = with_hash_bucket(rows.withColumn("_h", hash_order(id_col, seed)), "_h")
    return exact_rank(hashed, [F.col("_h"), F.col(id_col)]).drop("_h", "n")


def preview_even(rows: DataFrame, k: int = 5, ord_col: str = "ord") -> DataFrame:
    """``k`` rows at positions floor(i * n / k) of the ``ord_col`` order; all when n <= k.

    The wanted positions are worked out per histogram bucket, and only the buckets that hold
    one are read again and ranked.
    """
    bucketed = with_ord_bucket(rows, ord_col)
    first = F.ceil(F.col("start") * k / F.col("n")).cast("long")
    last = F.ceil((F.col("start") + F.col("cnt")) * k / F.col("n")).cast("long") - 1
    wanted = (
        bucket_offsets(bucketed.select(ord_col, "_bucket"))
        .withColumn("_all", F.col("n") <= k)
        .withColumn("_picks", F.when(last >= first, F.transform(
            F.sequence(first, last), lambda i: F.floor(i * F.col("n") / k).cast("long")
        )))
        .filter(F.col("_all") | F.col("_picks").isNotNull())
        .select("_bucket", "start", "_all", "_picks")
    )
    within = Window.partitionBy("_bucket").orderBy(ord_col)
    return (
        bucketed.join(F.broadcast(wanted), "_bucket")
        .withColumn("pos", F.col("start") + F.row_number().over(within) - 1)
        .filter(F.col("_all") | F.array_contains("_picks", F.col("pos")))
        .drop("_bucket", "start", "_all", "_picks")
    )
