"""Attributes made of several columns: a greedy weighted cover of an attribute's words.

A word weighs ``ln(1 + attributes / attributes with the word)``, so what all attributes share counts
little. A column may take part if at least half of its words are words of the attribute, exact,
misspelt or of another period. Up to ``most`` columns of one table are picked, each the one that
adds most weight; the attribute is mapped when the picked ones cover at least ``threshold`` of
its weight. Misspelt words meet through the words that are left when letters are deleted.

Only columns with a rare word of the attribute are looked at: of a column's words, ordered from the
rarest, so many are kept that one of them must be shared. Columns that say the same about an
attribute are reduced to the shortest before any are gathered, so a group holds at most as many as
its words have combinations, however many columns there are.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import name_parts
from auditlake.operators.tables import quoted
from auditlake.plans.sized import lookup_join
from auditlake.session import materialize

#: Share of an attribute's weight that its columns must cover, and most columns of a formula.
THRESHOLD, MOST = 0.5, 3
#: What a misspelt word counts, and a word of another period.
NEAR, PERIOD = 0.8, 0.9
# How often a period fits into a year.
PERIODS = {"annual": 1, "yearly": 1, "quarterly": 4, "monthly": 12, "weekly": 52, "daily": 365}


def letters_off(length: Column) -> Column:
    """Edits between two words, by the length of the shorter one."""
    return F.when(length < 4, 0).when(length < 8, 1).otherwise(2)


def _shorter(word: Column) -> Column:
    """The word without one of its letters, for each letter."""
    return F.transform(
        F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))
    )


def deletions(word: Column) -> Column:
    """The word and what is left of it when as many letters are deleted as may be off."""
    once = F.when(letters_off(F.length(word)) > 0, _shorter(word)).otherwise(F.array().cast("array<string>"))
    twice = F.when(letters_off(F.length(word)) > 1, F.flatten(F.transform(_shorter(word), _shorter))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), once, twice))


def _vocabulary(sets: DataFrame, words: str) -> DataFrame:
    return sets.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def word_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``word, other, quality``: words of ``left`` with equal, misspelt or other-period words of ``right``.

    Words with a digit are never misspelt.
    """

    def variants(df: DataFrame, name: str) -> DataFrame:
        return df.filter(~F.col("word").rlike("[0-9]")).select("word", F.explode(deletions(F.col("word"))).alias("rest")).withColumnRenamed("word", name)

    met = variants(left, "word").join(variants(right, "other"), "rest").select("word", "other").distinct()
    bound = letters_off(F.least(F.length("word"), F.length("other")))
    near = met.filter((F.col("word") != F.col("other")) & (F.levenshtein("word", "other") <= bound))
    same = left.select("word").join(right.select("word"), "word").select("word", F.col("word").alias("other"), F.lit(1.0).alias("quality"))
    spark = left.sparkSession
    periods = spark.createDataFrame([p for p in permutations(PERIODS, 2)], "word string, other string")
    periods = periods.join(left.select("word"), "word", "left_semi").join(right.select(F.col("word").alias("other")), "other", "left_semi")
    near = near.join(periods, ["word", "other"], "left_anti")
    return same.unionByName(near.withColumn("quality", F.lit(NEAR))).unionByName(periods.withColumn("quality", F.lit(PERIOD)))


def _half(n: Column) -> Column:
    return F.ceil(n / 2).cast("int")


def _candidates(attributes: DataFrame, columns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``attribute, table, matched, extra, column_name``: the shortest column for each set of matched words."""
    rarity = _vocabulary(columns, "words")
    each = columns.select("column_id", "words", F.explode("words").alias("word")).join(rarity, "word")
    ordered = each.groupBy("column_id").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))
    n = F.size("w")
    kept = ordered.select("column_id", F.explode(F.slice("w", F.lit(1), n - _half(n) + 1)).alias("x")).select("column_id", F.col("x.word").alias("other"))
    ours = attributes.select("attribute", F.explode("words").alias("word"))
    rare = materialize(kept.join(pairs, "other").select("column_id", "word").distinct(), "column-words")
    met = materialize(rare.join(ours, "word").select("attribute", "column_id").distinct(), "met")
    # All words of the columns that met an attribute, with the best word of the attribute for each.
    pieces = met.join(columns.select("column_id", F.explode("words").alias("other")), "column_id").join(pairs, "other").join(ours, ["attribute", "word"])
    best = pieces.groupBy("attribute", "column_id", "other").agg(F.min(F.struct((-F.col("quality")).alias("q"), "word")).alias("b"))
    matched = best.groupBy("attribute", "column_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("b.word").alias("word"), (-F.col("b.q")).alias("quality")))).alias("m"),
        F.count(F.lit(1)).cast("int").alias("shared"),
    )
    named = matched.join(columns.select("column_id", "table", "column_name", "number", F.size("words").alias("size")), "column_id")
    fit = named.filter(F.col("shared") * 2 >= F.col("size")).withColumn("extra", F.col("size") - F.col("shared"))
    return fit.groupBy("attribute", "table", F.array_distinct("m").alias("matched")).agg(
        F.min(F.struct("extra", "column_name", "column_id", "number")).alias("c")
    ).select("attribute", "table", "matched", "c.*")


def _gain(matched: Column, weights: Column, covered: Column) -> Column:
    """Weight that a column adds: each word not covered yet counts once, at its best quality."""
    fresh = F.filter(matched, lambda m: ~F.array_contains(covered, m["word"]))
    words = F.array_sort(F.array_distinct(F.transform(fresh, lambda m: m["word"])))

    def worth(w: Column) -> Column:
        return F.element_at(weights, w) * F.array_max(F.transform(F.filter(fresh, lambda m: m["word"] == w), lambda m: m["quality"]))

    return F.round(F.aggregate(F.transform(words, worth), F.lit(0.0), lambda a, x: a + x), 6)


def _cover(candidates: Column, weights: Column, most: int) -> Column:
    """Picks in order: ``(gain, column_name, matched)``, up to ``most`` that add weight."""
    pick = "struct<loss:double,extra:int,column_name:string,number:boolean,matched:array<struct<word:string,quality:double>>>"
    start = F.struct(F.array().cast(f"array<{pick}>").alias("picked"), F.array().cast("array<string>").alias("covered"))

    def step(state: Column, _: Column) -> Column:
        offers = F.transform(
            candidates,
            lambda c: F.struct(
                (-_gain(c["matched"], weights, state["covered"])).alias("loss"), *[c[n].alias(n) for n in ("extra", "column_name", "number", "matched")]
            ),
        )
        # The lambda's own variable keeps the choice from being made twice.
        return F.transform(
            F.array(F.array_min(offers)),
            lambda best: F.when(
                best["loss"] < 0,
                F.struct(
                    F.concat(state["picked"], F.array(best)).alias("picked"),
                    F.array_union(state["covered"], F.transform(best["matched"], lambda m: m["word"])).alias("covered"),
                ),
            ).otherwise(state),
        )[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["picked"]


def quoted_name(name: Column) -> Column:
    """A column name as a formula may hold it."""
    return F.when(name.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$"), name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))


def _converted(name: Column, columns: Column, attribute: Column) -> Column:
    """The column, times what turns its period into the attribute's where they differ."""
    out = quoted_name(name)
    for ours, theirs in permutations(PERIODS, 2):
        a, b = PERIODS[ours], PERIODS[theirs]
        if a == b:
            continue
        factor = f" * {b}" if a == 1 else f" / {a}" if b == 1 else f" * {b} / {a}"
        other = F.array_contains(columns, theirs) & F.array_contains(attribute, ours) & ~F.array_contains(columns, ours)
        out = F.when(other, F.concat(quoted_name(name), F.lit(factor))).otherwise(out)
    return out


def formula_of(picked: Column, attribute: Column) -> Column:
    """SQL over the picked columns: their sum where all are numbers and share a word, their texts in a row where not.

    Null for one column as it is.
    """
    parts = F.transform(picked, lambda p: F.struct(p["column_name"].alias("name"), name_parts(p["column_name"]).alias("words")))
    terms = F.transform(parts, lambda p: _converted(p["name"], p["words"], attribute))
    shared = F.aggregate(
        F.slice(picked, F.lit(2), F.greatest(F.size(picked) - 1, F.lit(0))), F.transform(picked[0]["matched"], lambda m: m["word"]),
        lambda acc, p: F.array_intersect(acc, F.transform(p["matched"], lambda m: m["word"])),
    )
    numbers = F.forall(picked, lambda p: p["number"])
    joined = F.when((F.size(shared) > 0) & numbers, F.array_join(terms, " + ")).otherwise(F.array_join(terms, " || ' ' || "))
    single = F.when(terms[0] != quoted_name(picked[0]["column_name"]), terms[0])
    return F.when(F.size(picked) == 1, single).when(F.size(picked) > 1, joined)


def cover_match(
    attributes: DataFrame, attribute: str, columns: DataFrame, column: str, within: str | None = None, number: str | None = None,
    threshold: float = THRESHOLD, most: int = MOST,
) -> DataFrame:
    """Add ``mapped_columns``, ``sql_formula``, ``similarity``, ``not_enough_information`` and ``explanation``.

    ``within`` names the column of ``columns`` that tells their table; columns of one table only are
    combined, and the table that covers most is taken, then fewer columns, then the smaller name.
    ``number`` names a boolean column that tells numbers; a header alone does not tell, so without it all count as such.
    ``similarity`` is the covered share of the attribute's weight.
    """
    named = name_parts(attribute)
    ours = attributes.select(named.alias("words")).filter(F.size("words") > 0).distinct()
    ours = materialize(ours.withColumn("attribute", F.array_join("words", " ")), "attributes")
    table = quoted(within) if within else F.lit("")
    told = F.coalesce(quoted(number), F.lit(False)) if number else F.lit(True)
    theirs = columns.select(table.alias("table"), quoted(column).alias("column_name"), told.alias("number")).groupBy("table", "column_name").agg(
        F.bool_and("number").alias("number")
    ).select("*", name_parts("column_name").alias("words"))
    theirs = materialize(theirs.filter(F.size("words") > 0).withColumn("column_id", F.xxhash64("table", "column_name")), "columns")
    total = ours.count()
    vocabulary = materialize(_vocabulary(ours, "words"), "vocabulary")
    pairs = materialize(word_pairs(vocabulary, _vocabulary(theirs, "words")), "word-pairs")
    weighed = vocabulary.select("word", F.round(F.log(1 + F.lit(float(total)) / F.col("df")), 6).alias("weight"))
    weights = ours.select("attribute", F.explode("words").alias("word")).join(weighed, "word").groupBy("attribute").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "weight")))).alias("weights")
    )
    found = _candidates(ours, theirs, pairs).groupBy("attribute", "table").agg(
        F.collect_list(F.struct("extra", "column_name", "number", "matched")).alias("candidates")
    )
    picks = found.join(weights, "attribute").select("attribute", "table", "weights", _cover(F.col("candidates"), F.col("weights"), most).alias("picked"))
    whole = F.aggregate(F.array_sort(F.map_values("weights")), F.lit(0.0), lambda a, x: a + x)
    covered = F.aggregate("picked", F.lit(0.0), lambda a, p: a - p["loss"])
    rated = picks.withColumn("similarity", F.round(covered / whole, 4)).filter(F.col("similarity") >= threshold)
    best = rated.groupBy("attribute").agg(F.min_by(F.struct("picked", "similarity"), F.struct(-F.col("similarity"), F.size("picked"), "table")).alias("b"))
    words = F.split("attribute", " ")
    made = best.select(
        "attribute", F.transform("b.picked", lambda p: p["column_name"]).alias("mapped_columns"), formula_of(F.col("b.picked"), words).alias("sql_formula"), "b.similarity"
    )
    made = materialize(made, "covers")
    out = ["mapped_columns", "sql_formula", "similarity", "not_enough_information", "explanation"]
    keyed = attributes.drop(*out).withColumn("_cover_key", F.array_join(named, " "))
    known = F.col("mapped_columns").isNotNull()
    share = F.format_string("words covered %.4f by %d columns", "similarity", F.size("mapped_columns"))
    return lookup_join(keyed, made.withColumnRenamed("attribute", "_cover_key"), ["_cover_key"], "left").select(
        *[quoted(c) for c in attributes.columns if c not in out],
        F.coalesce("mapped_columns", F.array().cast("array<string>")).alias("mapped_columns"),
        "sql_formula",
        "similarity",
        (~known).alias("not_enough_information"),
        F.when(known, share).otherwise("too few words covered").alias("explanation"),
    )
