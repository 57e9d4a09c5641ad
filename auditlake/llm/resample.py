"""Importance resampling towards a target: hashed word runs, a gain per bucket, top draws with noise.

Texts of a batch are joined with a separator; one regular expression finds all their words, and
searching the words' places in the texts' offsets tells the text of each. Runs that cross from one
text to the next are masked before the buckets are counted. Tasks hand on one count per bucket; the
gains are a table of one whole number per bucket, so small whatever the corpus. The draw is a
ranking: a count per score (whole numbers of narrow range) gives the score at which it ends, and
only rows from there up are sorted, over all tasks.

Defined cases: null, empty and wordless texts have no features and weight 0; texts of any length are
read in pieces cut between words, runs going on across them; a null identity hashes as the empty
string and ranks last among equal scores; repeated rows are drawn one by one, ties going to the
smaller identity; with an empty target all its counts are 0; an empty table gives an empty table;
other columns but the text pass through and result names replace columns of the same name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.columns import free_name
from auditlake.llm.settle import settled
from auditlake.plans.scan import ordinal, range_bucketed

BUCKETS = 10_000
ORDER = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
OUT = ["n_words", "n_features", "weight", "score", "rank"]

#: Bytes of text joined into one batch.
BATCH_BYTES = 1 << 22
# Fixed value: bytes of words in lower-cased UTF-8, and a separator that is none.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SEPARATOR = b"\x00"
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text in pieces of about ``limit`` bytes, cut where a word has ended."""
    at = 0
    while len(text) - at > limit:
        inside = _WORD.match(text, at + limit)
        end = inside.end() if inside else at + limit
        yield text[at:end]
        at = end
    yield text[at:]


def _batches(texts: Iterable[bytes | None], limit: int) -> Iterator[tuple[int, list[bytes], bool]]:
    """``first, texts, goes_on``: texts in a row, the first of which has number ``first``; a long one in several batches."""
    held, first, size = [], 0, 0
    for number, text in enumerate(texts):
        low = b"" if text is None else text.lower()
        if held and size + len(low) > limit:
            yield first, held, False
            held, size = [], 0
        if len(low) > limit:
            for k, piece in enumerate(_pieces(low, limit)):
                yield number, [piece], k > 0
            continue
        if not held:
            first = number
        held.append(low)
        size += len(low) + 1
    if held:
        yield first, held, False


def features(texts: Iterable[bytes | None], order: int, buckets: int, limit: int = BATCH_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``size, text, bucket`` of all runs of ``size`` words, batch by batch: the number of each run's text, and its bucket."""
    carried: list[bytes] = []
    for first, held, goes_on in _batches(texts, limit):
        joined = _SEPARATOR.join(held)
        words = _WORD.findall(joined)
        inside = _IN_WORD[np.frombuffer(joined, np.uint8)]
        starts = np.flatnonzero(inside & ~np.concatenate([np.zeros(1, dtype=bool), inside[:-1]]))
        offsets = np.cumsum([0] + [len(t) + 1 for t in held[:-1]])
        owner = np.searchsorted(offsets, starts, side="right") - 1 + first
        old = len(carried) if goes_on else 0
        if old:
            words = carried + words
            owner = np.concatenate([np.full(old, first), owner])
        values = list(map(zlib.crc32, words))
        for size in range(1, order + 1):
            if size > 1:  # the checksum of a run goes on from that of the run without its last word
                values = [zlib.crc32(b" " + w, v) for w, v in zip(words[size - 1 :], values, strict=False)]
            count = len(words) - size + 1
            if count <= 0:
                break
            begin, end = owner[:count], owner[size - 1 :]
            whole = begin == end
            whole[: max(0, old - size + 1)] = False
            yield size, begin[whole], np.fromiter(values, dtype=np.int64, count=count)[whole] % buckets
        carried = words[-(order - 1) :] if order > 1 else []


def bucket_counts(df: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of all texts by bucket, those that occur."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for frame in frames:
            for _, _, found in features(frame["t"], order, buckets):
                total += np.bincount(found, minlength=buckets)
        there = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": there, "n": total[there]})

    counted = df.select(F.col(f"`{text}`").cast("binary").alias("t")).mapInPandas(run, "bucket bigint, n bigint")
    return settled(counted.groupBy("bucket").agg(F.sum("n").alias("n")), "bucket-counts")


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, ``floor(1000 ln p_target / p_source)`` with one added to every count; bounded by ``buckets``."""
    spark = source.sparkSession
    s, t = source.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    s_share, t_share = (F.col(c).cast("double") + 1 for c in ("s", "t"))
    ratio = t_share * F.lit(float(all_s + buckets)) / (s_share * F.lit(float(all_t + buckets)))
    rows = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()
    gains = np.zeros(buckets, dtype=np.int64)
    for bucket, gain in rows:
        gains[bucket] = gain
    return gains


def weighed(df: DataFrame, gains: np.ndarray, text: str = "text", order: int = ORDER) -> DataFrame:
    """Add ``n_words``, ``n_features`` and ``weight``, the floored mean gain of a text's features; the text goes."""
    buckets = len(gains)

    @F.pandas_udf("n_words bigint, n_features bigint, weight bigint")
    def weigh(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in frames:
            n = len(texts)
            words, count, total = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for size, owner, found in features(texts, order, buckets):
                here = np.bincount(owner, minlength=n)
                count += here
                if size == 1:
                    words += here
                # Sums of whole numbers below 2^53 are exact.
                total += np.bincount(owner, weights=gains[found], minlength=n).astype(np.int64)
            yield pd.DataFrame({"n_words": words, "n_features": count, "weight": total // np.maximum(count, 1)})

    mark = free_name(df, "_weighed")
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in OUT and c != text]
    done = df.withColumn(mark, weigh(F.col(f"`{text}`").cast("binary")))
    return done.select(*rest, *[F.col(mark)[c].alias(c) for c in OUT[:3]])


def scored(df: DataFrame, identity: str, seed: int = SEED) -> DataFrame:
    """Add ``score``: the weight plus noise that depends on seed and identity alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{identity}`").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return df.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(share))))


def _ranked(rows: DataFrame, identity: str, least_words: int, percent: int) -> DataFrame:
    """Add ``rank`` among the rows drawn; ``rows`` must be a written table."""
    fit = F.col("n_words") >= least_words
    per_score = rows.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    per_score = settled(per_score, "scores")
    quota = per_score.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] * percent // 100
    none = F.lit(None).cast("bigint")
    if quota == 0:
        return rows.withColumn("rank", none)
    # As many rows as there are different scores, whole numbers of narrow range.
    running = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    least = per_score.withColumn("upto", running).filter(F.col("upto") >= quota).agg(F.max("score").alias("s")).first()["s"]
    near = fit & (F.col("score") >= least)
    names = [free_name(rows, n) for n in ("_less", "_unnamed", "_tie", "_range", "_place")]
    less, unnamed, tie, bucket, place = names
    order = [less, unnamed, identity, tie]
    top = rows.filter(near).withColumns(
        {less: -F.col("score"), unnamed: F.col(f"`{identity}`").isNull(), tie: F.monotonically_increasing_id()}
    )
    top = range_bucketed(top, [], [f"`{c}`" for c in order], bucket)
    placed = ordinal(top, [], F.col(bucket), [f"`{c}`" for c in order], place)
    drawn = placed.withColumn("rank", F.when(F.col(place) <= quota, F.col(place).cast("bigint"))).drop(*names)
    return drawn.unionByName(rows.filter(~near).withColumn("rank", none))


def resample(
    df: DataFrame, target: DataFrame, identity: str, text: str = "text", target_text: str = "text", order: int = ORDER,
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """Every row with ``n_words, n_features, weight, score, rank``; rank counts the ``percent`` of rows drawn, null for others.

    Rows with fewer than ``least_words`` words are never drawn. The texts are read twice: for the counts, for the weights.
    """
    gains = bucket_gains(bucket_counts(df, text, order, buckets), bucket_counts(target, target_text, order, buckets), buckets)
    rows = settled(scored(weighed(df, gains, text, order), identity, seed), "weights")
    return _ranked(rows, identity, least_words, percent)
