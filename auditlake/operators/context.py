"""Context handed to a reader: budgeted rows, condensed text, listings."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import chunk_word_limit, line_count, lines, strip, tokens
from auditlake.plans.scan import bucket_of, prior
from auditlake.session import materialize

# Lines per condensed chunk, characters counted per word of the context limit.
CHUNK_LINES = 500
CHARS_PER_WORD = 4


def _carry(limit: int):
    """Carries the running size over the files of each run, in file order; holds one number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used = object(), 0
        for batch in batches:
            carried = []
            for run_id, sums in zip(batch["run_id"], batch["sums"]):
                if run_id != current:
                    current, used = run_id, 0
                carried.append(used)
                if used < limit:
                    used += max((int(s) for s in sums if s <= limit - used), default=0)
            yield pd.DataFrame({"run_id": batch["run_id"], "file_no": batch["file_no"], "carry": carried})

    return run


def budget_prefix(rows: DataFrame, run: str, file_no: str, row_no: str, size: Column, limit: int) -> DataFrame:
    """Rows of each run's files that fit the budget.

    Rows are taken file by file in order while the running size stays within ``limit``.
    The first row of a file that does not fit is still taken but not counted, and ends
    that file; the next file goes on from the same size. Nothing is taken once the size
    has reached the limit. File and row numbers are integers, unique in their run and file.
    """
    sized = rows.withColumn("run_id", F.col(run)).withColumn("file_no", F.col(file_no)).withColumn("_size", size.cast("bigint"))
    summed = prior(sized, ["run_id", "file_no"], bucket_of(row_no), [row_no], F.sum, F.col("_size"), "_before").withColumn(
        "_before", F.coalesce("_before", F.lit(0))
    )
    # At most the budget plus one row per file: no later row can be taken.
    near = materialize(summed.filter(F.col("_before") <= limit), "budget")
    # Python sees numbers only: the distinct running sums of a file within the limit.
    total = F.col("_before") + F.col("_size")
    files = near.groupBy("run_id", "file_no").agg(F.collect_set(F.when(total <= limit, total)).alias("sums"))
    run_type, file_type = dict(files.dtypes)["run_id"], dict(files.dtypes)["file_no"]
    carried = (
        files.repartition("run_id")
        .sortWithinPartitions("run_id", "file_no")
        .mapInPandas(_carry(limit), f"run_id {run_type}, file_no {file_type}, carry bigint")
    )
    fits = (F.col("carry") < limit) & (F.col("carry") + F.col("_before") <= limit)
    return near.join(carried, ["run_id", "file_no"]).filter(fits).select(*[F.col(f"`{c}`") for c in rows.columns])


def _shortened(body: Column, words: int, chunk_lines: int) -> Column:
    """Chunks of an array of lines without repeated lines, each cut to its share of words.

    The shortest lines are kept, so that no long line stands in the way of others, and at most
    half of a chunk, in their old order. A chunk of long lines only keeps the start of the shortest.
    """
    chunks = F.ceil(F.size(body) / chunk_lines)
    limit = chunk_word_limit(words, chunks)

    def shorten(i: Column) -> Column:
        part = F.array_distinct(F.transform(F.slice(body, (i * chunk_lines + 1).cast("int"), chunk_lines), strip))
        sized = F.sort_array(
            F.transform(part, lambda x, at: F.struct(F.size(tokens(x)).cast("bigint").alias("n"), at.alias("at"), x.alias("x")))
        )
        start = F.struct(F.lit(0).cast("bigint").alias("words"), F.lit(0).alias("kept"))

        def take(state: Column, line: Column) -> Column:
            total = state["words"] + line["n"]
            return F.struct(total.alias("words"), (state["kept"] + (total <= limit).cast("int")).alias("kept"))

        def chosen(s: Column) -> Column:
            kept = F.least(F.aggregate(s, start, take, lambda x: x["kept"]), F.ceil(F.size(s) / 2).cast("int"))
            first = F.array_join(F.slice(F.split(F.get(s, F.lit(0))["x"], " "), F.lit(1), limit.cast("int")), " ")
            some = F.sort_array(F.transform(F.slice(s, F.lit(1), kept), lambda y: F.struct(y["at"].alias("at"), y["x"].alias("x"))))
            return F.when(kept > 0, F.array_join(F.transform(some, lambda y: y["x"]), "\n")).otherwise(first)

        return F.transform(F.array(sized), chosen)[0]

    return F.transform(F.sequence(F.lit(0), (chunks - 1).cast("int")), shorten)


def condense(docs: DataFrame, text: str, threshold: int = 500, words: int = 10_000, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Shorten long texts in place, round by round until they are below ``threshold`` lines.

    A round drops repeated lines in each chunk and keeps lines up to the chunk's share of
    ``words``. It leaves at most half of a chunk's lines and a blank between chunks, so the
    number of lines tells beforehand how many rounds are enough.
    """
    if threshold < 2 or chunk_lines < 6:
        raise ValueError("a threshold of 2 lines and chunks of 6 lines at least")

    def again(body: Column) -> Column:
        short = F.array_join(_shortened(body, words, chunk_lines), "\n\n")
        return F.when(F.size(body) >= threshold, lines(short)).otherwise(body)

    def rounds(body: Column) -> Column:
        number = F.ceil(F.log(F.size(body).cast("double")) / math.log(1.4)).cast("int") + 1
        left = F.aggregate(F.sequence(F.lit(1), number), body, lambda acc, _: F.transform(F.array(acc), again)[0])
        return F.when(F.size(body) >= threshold, F.array_join(left, "\n"))

    done = F.transform(F.array(lines(text)), rounds)[0]
    return docs.withColumn(text, F.coalesce(done, F.col(text)))


#: Letters of a word that a condensed text should keep.
_LETTERS = 4
_TOKEN = re.compile(r"\w+")


def covering_lines(body: list[str], limit: int) -> list[int]:
    """Positions of lines that cover most of a text's words, in ``limit`` words and half of the lines at most.

    A word weighs as many as the lines that hold it; it counts once. The line with most new weight
    per word is taken next, the earliest of equals. Gains only fall as lines are taken, so a line is
    weighed anew only when it comes to the top.
    """
    spoken = [_TOKEN.findall(x.lower()) for x in body]
    held = [{w for w in s if len(w) >= _LETTERS} for s in spoken]
    weight = Counter(w for h in held for w in h)
    covered: set[str] = set()

    def score(k: int) -> int:
        return sum(weight[w] for w in held[k] - covered) * 1000 // max(1, len(spoken[k]))

    queue = [(-score(k), k) for k in range(len(body))]
    heapq.heapify(queue)
    taken: list[int] = []
    while queue and len(taken) < (len(body) + 1) // 2:
        told, k = heapq.heappop(queue)
        if told == 0:
            break
        if len(spoken[k]) > limit:
            continue
        now = -score(k)
        if now != told:
            heapq.heappush(queue, (now, k))
            continue
        taken.append(k)
        covered |= held[k]
        limit -= len(spoken[k])
    return sorted(taken)


def _covered(body: list[str], words: int, chunk_lines: int) -> list[str]:
    """One round over the chunks of a text, a blank line between them."""
    chunks, out = -(-len(body) // chunk_lines), []
    limit = max(50, words // chunks)
    for at in range(0, len(body), chunk_lines):
        part = list(dict.fromkeys(x.strip() for x in body[at : at + chunk_lines]))
        kept = covering_lines(part, limit)
        chosen = [part[k] for k in kept] or [" ".join(min(part, key=lambda x: len(_TOKEN.findall(x))).split(" ")[:limit])]
        out += ([""] if out else []) + chosen
    return out


def condense_by_weight(
    docs: DataFrame, text: str, threshold: int = 500, words: int = 10_000, chunk_lines: int = CHUNK_LINES, rounds: int | None = None
) -> DataFrame:
    """As :func:`condense`, keeping in each chunk the lines that cover most of its words (:func:`covering_lines`).

    ``rounds`` bounds the number of rounds; without it they go on until the text is below ``threshold`` lines.
    Only long texts leave Spark; each is worked on alone.
    """
    if threshold < 2 or chunk_lines < 6:
        raise ValueError("a threshold of 2 lines and chunks of 6 lines at least")

    def shorter(value: str) -> str:
        body, done = value.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n"), 0
        while len(body) >= threshold and (rounds is None or done < rounds):
            body, done = _covered(body, words, chunk_lines), done + 1
        return "\n".join(body)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else shorter(t))

    long = F.when(line_count(text) >= threshold, F.col(text))
    return docs.withColumn(text, F.coalesce(F.pandas_udf(run, "string")(long), F.col(text)))


def column_listing(columns: DataFrame) -> DataFrame:
    """Listing lines of dataset columns by file: ``file, ordinal, line``; ordinal 0 is the heading."""
    heads = columns.select("file").distinct().select(
        "file", F.lit(0).cast("bigint").alias("ordinal"), F.concat(F.lit("Dataset: "), "file").alias("line")
    )
    body = columns.select("file", F.col("ordinal").cast("bigint"), F.concat(F.lit("  - "), "column_name").alias("line"))
    return heads.unionByName(body)


def concept_listing(concepts: DataFrame) -> DataFrame:
    """Listing line per concept."""
    return concepts.select(
        "concept_name",
        F.format_string("- Concept: %s (Type: %s) - Summary: %s", "concept_name", "concept_type", "summary").alias("line"),
    )


def append_context(accumulated: DataFrame | None, retrieved: DataFrame, iteration: int) -> DataFrame:
    """Add what an iteration retrieved to the context so far."""
    new = retrieved.withColumn("iteration", F.lit(iteration).cast("bigint"))
    return new if accumulated is None else accumulated.unionByName(new)
