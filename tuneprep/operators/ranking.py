"""Order-based selection that never sorts a whole table, or a hot group, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuneprep.session import checkpointed

SALTS = 64
HEX_DIGITS = 4  # 65,536 order-preserving buckets of a hexadecimal hash
ORD_BUCKETS = 65_536
SPARSE = 64
BUCKET_ROWS = 1 << 22
HOT_ROWS = 1_000_000
TOP_KEYS = 100_000


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int,
                  rank: str | None = None, salts: int = SALTS) -> DataFrame:
    """First ``k`` rows of every key, as a two-level reduction.

    Spark's window group limit keeps ``k`` rows per key in each map task. The survivors of a key
    are then ranked in ``salts`` slices, by the input partition they come from, and at most
    ``salts * k`` of them meet in the second ranking. The slice does not affect the result.
    With no ``keys`` it is a top-n that reads its input once, for computed tables.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    slices = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    out = (
        df.withColumn("_salt", salt)
        .withColumn("_slice_rank", F.row_number().over(slices))
        .filter(F.col("_slice_rank") <= k)
        .drop("_slice_rank", "_salt")
        .withColumn(name, F.row_number().over(whole))
        .filter(F.col(name) <= k)
    )
    return out if rank else out.drop(name)


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """Exactly the first ``n`` rows in ``order`` (nulls first; ties by a hash of the row).

    The cut-off key is found on the order columns and the hash alone; rows up to it are then read,
    so texts of rows that do not make it are never moved. Up to ``TOP_KEYS`` the keys are a top-n;
    above that they are range partitioned and counted, with the same result. Rows equal to the
    last one in every column may be more than fit; of these the number that fits is taken.
    """
    if n <= 0:
        return rows.limit(0)
    key = F.struct(*order, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).alias("_tie"))
    keys = rows.select(key.alias("_key"))
    if n <= TOP_KEYS:
        first = keys.orderBy("_key").limit(n)
    else:
        ranged = checkpointed(keys.repartitionByRange("_key").withColumn(
            "_bucket", F.spark_partition_id().cast("long")))
        first = exact_rank(ranged, [F.col("_key")], "_pos").filter(F.col("_pos") < n)
    last = first.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max(F.struct("_key", "n")).alias("last"))
    edge = last.select("last._key").scalar()
    below = rows.filter((key < edge) & (F.col(order[0]).isNull() | (F.col(order[0])
                                                                   <= edge[order[0]])))
    equal = top_k_per_key(rows.filter(key == edge), [], [F.lit(0)], n, rank="_rank")
    return below.unionByName(
        equal.filter(F.col("_rank") <= last.select("last.n").scalar()).drop("_rank"))


def keep_first(df: DataFrame, order: list[str], keys: dict[str, Column]) -> DataFrame:
    """First row of every key in ``order``, a list of columns that is unique together.

    Only (key, order) pairs are grouped, with partial aggregation, so copies of one key collapse
    before the shuffle (several order columns go by the two-level top-k). The rows themselves are joined on the unique order columns and therefore
    spread evenly whatever the key frequencies are.
    """
    firsts = df.select(*order, *[c.alias(n) for n, c in keys.items()]).groupBy(*keys)
    if len(order) == 1:
        firsts = firsts.agg(F.min(order[0]).alias(order[0])).select(order[0])
    else:
        pairs = df.select(*order, *[c.alias(n) for n, c in keys.items()])
        firsts = top_k_per_key(pairs, list(keys), [F.col(c) for c in order], 1).select(*order)
    return df.join(firsts, order, "left_semi")


def hash_order(id_col: str, seed: int) -> Column:
    """Seeded pseudo-random sort key of a unique id (32 hexadecimal digits)."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def with_ord_bucket(df: DataFrame, ord_col: str) -> DataFrame:
    """Add ``_bucket``: ascending ranges of a BIGINT column, none of them large.

    Values should be unique, or repeat a bounded number of times; a null has no bucket. Dense ids
    (range at most ``SPARSE`` times the row count) are cut into equal widths. Otherwise, or where
    such a bucket may exceed ``BUCKET_ROWS``, the histogram is repeated inside the buckets that are
    too large, between their own smallest and largest value, until none is: about one round more
    for each order of magnitude by which ids are clustered. Buckets are named by their lower
    bounds; there are at most ``ORD_BUCKETS`` and 20 for each ``BUCKET_ROWS`` rows. Rows never move.
    """
    lo, hi, n = df.agg(F.min(ord_col), F.max(ord_col), F.count(ord_col)).first()
    if not n:
        return df.withColumn("_bucket", F.lit(0).cast("long"))
    width = (hi - lo) // ORD_BUCKETS + 1
    limit = min(BUCKET_ROWS, max(1024, n >> 10))

    def lower(start: Column, step: Column) -> Column:
        # Decimals, because a difference of two BIGINT values may not be one.
        exact = F.col(ord_col) if hi - lo < 1 << 62 else F.col(ord_col).cast("decimal(38,0)")
        return (exact - F.pmod(exact - start, step)).cast("long")

    out = df.withColumn("_bucket", lower(F.lit(lo), F.lit(width)))
    if hi - lo < SPARSE * n and (width == 1 or width <= BUCKET_ROWS):
        return out
    while True:
        # Only numbers of large buckets come to the driver, at most n / limit rows.
        large = (out.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.min(ord_col).alias("lo"),
                                            F.max(ord_col).alias("hi"))
                 .filter((F.col("n") > limit) & (F.col("lo") < F.col("hi"))).collect())
        if not large:
            return out
        steps = [(r["_bucket"], r["lo"],
                  (r["hi"] - r["lo"]) // max(16, 4 * r["n"] // limit) + 1) for r in large]
        inner = df.sparkSession.createDataFrame(steps, "_large bigint, _lo bigint, _step bigint")
        out = (out.join(F.broadcast(inner), F.col("_bucket") == F.col("_large"), "left")
               .withColumn("_bucket", F.when(F.col("_large").isNull(), F.col("_bucket"))
                           .otherwise(lower(F.col("_lo"), F.col("_step"))))
               .drop("_large", "_lo", "_step"))


def with_hash_bucket(df: DataFrame, hash_col: str) -> DataFrame:
    """Add ``_bucket``: the leading hexadecimal digits of a hash column, ascending."""
    return df.withColumn("_bucket", F.substring(hash_col, 1, HEX_DIGITS))


def bucket_offsets(bucketed: DataFrame) -> DataFrame:
    """Rows per bucket with the number of rows before it (``start``) and the total (``n``).

    The table has one row per bucket (at most 65,536 and 20 for each ``BUCKET_ROWS`` rows of the
    input), so its single-task window is bounded.
    """
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        bucketed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("start", F.coalesce(F.sum("cnt").over(running), F.lit(0).cast("long")))
        .withColumn("n", F.sum("cnt").over(everything))
    )


def exact_rank(bucketed: DataFrame, order: list[Column], pos: str = "pos") -> DataFrame:
    """Zero-based global position: rank within the bucket plus the rows in earlier buckets.

    The offset table is bounded by the bucket count, hence broadcast.
    """
    offsets = bucket_offsets(bucketed).select("_bucket", "start", "n")
    within = Window.partitionBy("_bucket").orderBy(*order)
    return (
        bucketed.withColumn("_rn", F.row_number().over(within))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(pos, F.col("start") + F.col("_rn") - 1)
        .drop("_rn", "start", "_bucket")
    )


def nth_key(bucketed: DataFrame, key: Column, position: Column) -> Column:
    """Scalar: the sort key at a zero-based position; null when past the last row.

    ``position`` may use the row count ``n``. A histogram finds the bucket that holds the
    position and only that bucket's keys are ranked.
    """
    target = (
        bucket_offsets(bucketed)
        .withColumn("target", position.cast("long"))
        .filter((F.col("start") <= F.col("target"))
                & (F.col("target") < F.col("start") + F.col("cnt")))
        .select("_bucket", (F.col("target") - F.col("start")).alias("skip"))
    )
    spot = target.select(F.struct("_bucket", "skip")).scalar()
    return (
        bucketed.filter(F.col("_bucket") == spot["_bucket"])
        .select(key.alias("_key"), F.row_number().over(Window.orderBy(key)).alias("_rn"))
        .filter(F.col("_rn") - 1 == spot["skip"])
        .select("_key")
        .scalar()
    )


def salted_join(many: DataFrame, one: DataFrame, key: str, spread_on: list[str],
                how: str = "inner", salts: int = SALTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join where ``many`` may hold very frequent keys and ``one`` has a row per key.

    Keys with more than ``hot_rows`` rows are spread over ``salts`` tasks and only their partner
    row is repeated. The list of such keys comes from a count that is combined map-side; it has
    at most one key per ``hot_rows`` rows and is broadcast, so ``many`` moves once.
    """
    hot = F.broadcast(many.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") > hot_rows).select(key, F.lit(True).alias("_hot")))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_on]), F.lit(salts)).cast("int")
    spread = many.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0)))
    partners = one.join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return spread.join(partners, [key, "_salt"], how).drop("_salt")


def blocked_lag(rows: DataFrame, key: str, order: str, value: str, out: str,
                width: int = 65_536) -> DataFrame:
    """Previous ``value`` of the same key in ``order`` (a BIGINT, unique within the key).

    Rows are windowed per (key, block of ``width`` order values); the first row of a block takes
    the last value of the key's previous block, from a table with one row per block.
    """
    blocked = rows.withColumn("_block", F.expr(f"`{order}` div {width}"))
    within = Window.partitionBy(key, "_block").orderBy(order)
    across = Window.partitionBy(key).orderBy("_block")
    tails = (
        blocked.groupBy(key, "_block")
        .agg(F.max_by(value, order).alias("_tail"))
        .select(key, "_block", F.lag("_tail").over(across).alias("_before"))
    )
    return (
        blocked.withColumn("_lag", F.lag(value).over(within))
        .withColumn("_rn", F.row_number().over(within))
        .join(tails, [key, "_block"])
        .withColumn(out, F.when(F.col("_rn") == 1, F.col("_before")).otherwise(F.col("_lag")))
        .drop("_block", "_lag", "_rn", "_before")
    )
