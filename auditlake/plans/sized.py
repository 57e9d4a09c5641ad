"""Joins whose small side is measured before it is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import materialize, settled

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 * 1024 * 1024
HOT_KEY_ROWS = 1_000_000
#: Buckets of a hash in which hot keys are looked for.
HASH_BUCKETS = 10_000
#: Rows that a task sorts or groups at a time, where their number is known.
TASK_ROWS = 500_000


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True when the whole table is within both bounds; reads at most ``max_rows + 1`` rows."""
    row = (
        df.limit(max_rows + 1)
        .select(F.octet_length(F.to_json(F.struct("*"))).alias("bytes"))
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
        .first()
    )
    return row["n"] <= max_rows and row["bytes"] <= max_bytes


def lookup_join(
    big: DataFrame,
    side: DataFrame,
    on: list[str],
    how: str = "inner",
    hot_rows: int = HOT_KEY_ROWS,
    max_rows: int = MAX_BROADCAST_ROWS,
    parts: int | None = None,
) -> DataFrame:
    """Equi-join ``big`` with ``side``: broadcast below the bound, salted shuffle beyond it.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``; ``on`` must be non-null columns.
    ``parts`` is the number of partitions of the shuffle, see :func:`parts_for`.
    """
    if is_small(side, max_rows):
        return big.join(F.broadcast(side), on, how)
    return salted_join(big, side, on, how, hot_rows, parts)


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions that leave a task at most ``TASK_ROWS`` of so many rows, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def parted(df: DataFrame, parts: int | None, *columns: str) -> DataFrame:
    """Shuffle by columns into so many partitions; without a number the next step shuffles as it likes."""
    return df if parts is None else df.repartition(parts, *columns)


def placed_by(df: DataFrame, *columns: str, least: int = 0) -> DataFrame:
    """Shuffle by columns into the session's number of partitions, or up to 16 times as many where ``least`` are asked for.

    Numbered, so that AQE does not merge partitions that are small now but fan out in the next join.
    """
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(usual, min(least, 16 * usual)), *columns)


def marked(df: DataFrame, on: list[str]) -> DataFrame:
    """Add ``_mark``, a hash of a key. As its first column it spares sorts the strings, which often begin alike."""
    return df.withColumn("_mark", F.xxhash64(*on))


def marked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join sorted by a hash of the key first; the key is compared as well."""
    return marked(left, on).join(marked(right, on), ["_mark", *on], how).drop("_mark")


def known_only(big: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """Left semi join for a ``big`` whose keys are in ``side`` as a rule: then no row of it is shuffled.

    Distinct keys that are missing from ``side`` are looked for first; ``big`` is read twice.
    """
    named = big.dropna(subset=on)
    others = settled(marked_join(named.select(*on).distinct(), side.select(*on).distinct(), on, "left_anti"), "other-keys")
    return named if others.isEmpty() else lookup_join(named, others, on, "left_anti")


def _place_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each partition a number whose hash leads to it."""
    key = F.col("id").cast("int")
    found = spark.range(32 * parts).groupBy(F.pmod(F.hash(key), F.lit(parts)).alias("part")).agg(F.min(key).alias("key")).collect()
    by_part = {r["part"]: r["key"] for r in found}
    return [by_part.get(i, 32 * parts + i) for i in range(parts)]


def placed_evenly(df: DataFrame, share: str, parts: int, out: str) -> DataFrame:
    """Shuffle rows to partitions by a number from 0 to below 1, in proportion, and replace it by an integer key ``out``.

    Rows of one share meet; unlike by a hash, those of distant shares do not. What is above stays in the last partition.
    """
    at = F.least(F.greatest(F.floor(F.col(share) * parts), F.lit(0)), F.lit(parts - 1)).cast("int")
    keys = F.array(*[F.lit(k) for k in _place_keys(df.sparkSession, parts)])
    return df.withColumn(out, F.get(keys, at)).drop(share).repartition(parts, out)


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a small scan over all cores; a large one already has a split per core and stays as it is.

    A small file is one row group and so one task, however costly its rows are.
    """
    if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df


def _bucket(on: list[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(HASH_BUCKETS))


def full_buckets(df: DataFrame, on: list[str], hot_rows: int | None = None) -> DataFrame:
    """Buckets of a key's hash with more than ``hot_rows`` rows, ``HOT_KEY_ROWS`` by default; without any, no key has that many."""
    most = HOT_KEY_ROWS if hot_rows is None else hot_rows
    full = df.select(_bucket(on).alias("_bucket")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    return materialize(full.select("_bucket"), "full-buckets")


def salted_join(
    big: DataFrame, side: DataFrame, on: list[str], how: str, hot_rows: int = HOT_KEY_ROWS, parts: int | None = None
) -> DataFrame:
    """Shuffle join that spreads a key with more than ``hot_rows`` rows over as many salts as it has times that.

    There are at most ``rows / hot_rows`` hot keys, so Spark may broadcast that list by its own size check.
    With a number of ``parts`` they are looked for first, and without any there is no salt.
    """
    counted = big.select(*on)
    if parts is not None:
        # A hot key fills its bucket of a hash; the few counts of buckets are all that is shuffled where no key is hot.
        full = full_buckets(counted, on, hot_rows)
        if full.isEmpty():
            return parted(big, parts, *on).join(side, on, how)
        counted = parted(counted.withColumn("_bucket", _bucket(on)).join(full, "_bucket", "left_semi").select(*on), parts, *on)
    hot = (
        counted.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*on, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_salts"))
    )
    # Maps have no hash; rows that differ in them only share a salt.
    hashed = [F.col(f"`{c}`") for c, kind in big.dtypes if "map<" not in kind and kind != "variant"]
    spread = F.pmod(F.xxhash64(*hashed), F.col("_salts")).cast("int")
    left = (
        big.join(hot, on, "left")
        .withColumn("_salt", F.when(F.col("_salts").isNotNull(), spread).otherwise(F.lit(0)))
        .drop("_salts")
    )
    right = (
        side.join(hot, on, "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
            ),
        )
        .drop("_salts")
    )
    keys = [*on, "_salt"]
    return parted(left, parts, *keys).join(parted(right, parts, *keys), keys, how).drop("_salt")
