"""Line dedup by site-relative frequency, native functions only.

A line is boilerplate of a site if the share of the site's pages that contain it exceeds
``ratio`` and at least ``min_pages`` pages do. Lines travel as 128-bit digests, counted on
the map side first, so a hot site or a line of every page is a few rows per task. A site has
at most (mean distinct lines of a page) / ratio boilerplate lines.

With ``keep_whole`` a page that would have no line left stays as it is: it may be a copy of others,
which a later step can judge as a whole.

Defined cases: blank lines are neither counted nor dropped; a null text stays null; pages
with a null site belong to no site and stay as they are; a repeated row is a page of its own;
an empty table gives an empty table; all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.columns import WORD, bind, free_name
from auditlake.plans.sized import is_small, salted_join
from auditlake.session import materialize

RATIO = 0.1
MIN_PAGES = 3


def url_host(url: Column) -> Column:
    """Host of an absolute URL in lower case, without port; null where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.lower(F.nullif(host, F.lit("")))


def _key(line: Column) -> Column:
    return F.substring(F.unhex(F.sha2(line, 256)), 1, 16)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(df: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``_site, _key``: digests of the lines that exceed the ratio on their site."""
    pages = df.filter(F.col(f"`{host}`").isNotNull()).select(F.col(f"`{host}`").alias("_site"), F.col(f"`{text}`").alias("_text"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), lambda x: x.rlike(WORD)), _key))
    # The null of each page counts the page itself, so one pass counts both.
    marks = F.concat(F.array(F.lit(None).cast("binary")), F.coalesce(keys, F.array().cast("array<binary>")))
    counted = pages.select("_site", F.explode(marks).alias("_key")).groupBy("_site", "_key").agg(F.count(F.lit(1)).alias("_n"))
    counted = materialize(counted.filter(F.col("_key").isNull() | (F.col("_n") >= min_pages)), "line-counts")
    totals = counted.filter(F.col("_key").isNull()).select("_site", F.col("_n").alias("_pages"))
    return (
        counted.filter(F.col("_key").isNotNull())
        .join(totals, "_site")
        .filter(F.col("_n") > F.lit(ratio) * F.col("_pages"))
        .select("_site", "_key")
    )


def drop_boilerplate(
    df: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, n_dropped: str | None = None,
    keep_whole: bool = False,
) -> DataFrame:
    """The rows with boilerplate lines taken out of ``text``; ``n_dropped`` names a column for their number.

    The rows are read twice, so give a table that is cheap to read. ``keep_whole``: see above.
    """
    sites = boilerplate(df, host, text, ratio, min_pages).groupBy("_site").agg(F.collect_set("_key").alias("_keys"))
    sites = materialize(sites, "boilerplate")
    site, keys = free_name(df, "_join_site"), free_name(df, "_join_keys")
    side = sites.select(F.col("_site").alias(site), F.col("_keys").alias(keys))
    big = df.withColumn(site, F.col(f"`{host}`"))
    # Few sites fit a broadcast; beyond the bound hot sites are salted.
    joined = big.join(F.broadcast(side), [site], "left") if is_small(side) else salted_join(big, side, [site], "left")

    def cut(lines: Column) -> Column:
        return F.filter(lines, lambda x: ~(x.rlike(WORD) & F.array_contains(F.col(keys), _key(x))))

    def left_of(lines: Column) -> Column:
        if not keep_whole:
            return cut(lines)
        return bind(cut(lines), lambda kept: F.when(F.exists(kept, lambda x: x.rlike(WORD)), kept).otherwise(lines))

    def both(lines: Column) -> Column:
        return bind(
            left_of(lines),
            lambda kept: F.struct(F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("n")),
        )

    left = F.when(F.col(keys).isNotNull() & F.col(f"`{text}`").isNotNull(), bind(_lines(F.col(f"`{text}`")), both))
    result = free_name(joined, "_left")
    done = joined.withColumn(result, left)
    columns = [
        F.when(F.col(result).isNotNull(), F.col(result)["text"]).otherwise(F.col(f"`{text}`")).alias(text) if c == text else F.col(f"`{c}`")
        for c in df.columns
        if not n_dropped or c.lower() != n_dropped.lower()
    ]
    if n_dropped:
        columns.append(F.coalesce(F.col(result)["n"], F.lit(0)).cast("bigint").alias(n_dropped))
    return done.select(*columns)
