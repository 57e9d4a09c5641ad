"""Names of one type that mean the same: each name joins its earliest similar leader.

Names are taken in the order of their arrival. A name that is similar to leaders before it
joins the earliest of them, else it becomes a leader. Two names are similar when they hold the
same numbers and either one has all words of the other and few more (an extended name), or few
letters must change between them (a misspelt one).

Similar names meet through a prefix filter: of the words and letter pairs of a name, in the order
of their rarity, so many are kept that any two similar names share one. It loses no pair. The
sequence is settled in batches that double in size: a batch meets the leaders before it first, so
names of a known leader never meet each other; what is left is settled in rounds over its similar
pairs, each round deciding all names whose earlier neighbours are decided.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.plans.scan import bucket_of, ordinal
from auditlake.plans.sized import placed_by
from auditlake.session import materialize

#: Letters that may change, as a share of the longer name, and words the shorter name must have of the longer one's.
EDIT_SHARE = 0.15
WORD_SHARE = 0.6
#: Names of a type in the first batch; each further batch is as large as all before it.
FIRST_BATCH = 4_096
_GRAM = 2


def _edits(length: Column, share: float) -> Column:
    """Edits allowed where the longer name has ``length`` characters."""
    return F.floor(length * F.lit(share) + F.lit(1e-9)).cast("int")


def name_traits(name: Column) -> Column:
    """What similarity looks at: length, numbers (as text) and distinct words without a digit."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(name, "-"), lambda w: w != "")))
    return F.struct(
        F.length(name).alias("length"),
        F.array_join(F.filter(words, lambda w: w.rlike("[0-9]")), "-").alias("numbers"),
        F.filter(words, lambda w: ~w.rlike("[0-9]")).alias("words"),
    )


def is_similar(
    name_a: Column, a: Column, name_b: Column, b: Column, edit_share: float = EDIT_SHARE, word_share: float = WORD_SHARE
) -> Column:
    """Whether two names with the traits ``a`` and ``b`` are similar."""
    few, many = F.least(F.size(a["words"]), F.size(b["words"])), F.greatest(F.size(a["words"]), F.size(b["words"]))
    shared = F.size(F.array_intersect(a["words"], b["words"]))
    extended = (few > 0) & (shared == few) & (few >= many * F.lit(word_share) - F.lit(1e-9))
    bound = _edits(F.greatest(a["length"], b["length"]), edit_share)
    # Beyond the bound the distance is not counted to its end, and -1.
    near = (F.abs(a["length"] - b["length"]) <= bound) & (F.call_function("levenshtein", name_a, name_b, bound) >= 0)
    return (a["numbers"] == b["numbers"]) & (extended | near)


def _signature(name: Column, traits: Column) -> Column:
    """Words and letter pairs of a name; the n-th time a pair occurs is a pair of its own."""
    starts = F.sequence(F.lit(1), F.greatest(traits["length"] - 1, F.lit(1)))
    pairs = F.array_sort(F.transform(starts, lambda i: F.substring(name, i, F.lit(_GRAM))))
    numbered = F.transform(
        pairs, lambda p, i: F.concat(F.lit("g"), p, F.lit("#"), (i - F.array_position(pairs, p).cast("int") + 1).cast("string"))
    )
    return F.concat(F.transform(traits["words"], lambda w: F.concat(F.lit("w"), w)), numbered)


def _with_prefixes(nodes: DataFrame, edit_share: float, word_share: float) -> DataFrame:
    """Add ``prefix``: the rarest words and letter pairs that a similar name must share one of."""
    tokens = materialize(
        nodes.select("concept_type", "key", F.explode(_signature(F.col("name"), F.col("traits"))).alias("token")), "name-tokens"
    )
    # Tokens of all names of all types; a name has as many as letters, and they are counted on the map side.
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ordered = (
        tokens.join(counted, "token").groupBy("concept_type", "key")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
        .select("concept_type", "key", F.transform("t", lambda x: x["token"]).alias("t"))
    )

    def kind(letter: str) -> Column:
        return F.filter("t", lambda x: F.startswith(x, F.lit(letter)))

    n = F.size(F.col("traits")["words"])
    word_prefix = n - F.ceil(n * F.lit(word_share) - F.lit(1e-9)).cast("int") + 1
    # The longer of two similar names has at most 1 / (1 - share) times the letters of this one.
    most = _edits(F.floor(F.col("traits")["length"] / F.lit(1 - edit_share) + F.lit(1e-9)), edit_share)
    prefix = F.concat(F.slice(kind("w"), F.lit(1), F.greatest(word_prefix, F.lit(0))), F.slice(kind("g"), F.lit(1), most * _GRAM + 1))
    return nodes.join(ordered, ["concept_type", "key"], "left").withColumn(
        "prefix", F.coalesce(prefix, F.array().cast("array<string>"))
    ).drop("t")


def _pairs(late: DataFrame, early: DataFrame, edit_share: float, word_share: float) -> DataFrame:
    """``concept_type, key, lead, at``: similar names, ``lead`` having arrived (``at``) before ``key``.

    Names meet by type, numbers and a token both prefixes hold; the first such token alone counts. Words come
    first, so names that meet by letter pairs share none of the words that an extended name must share, and their lengths are near.
    Both sides are placed by name, as few small names can have very many pairs.
    """

    def placed(df: DataFrame, side: str) -> DataFrame:
        return placed_by(df, *_NODE).select(
            "concept_type", F.col("traits")["numbers"].alias("numbers"), F.explode("prefix").alias("token"),
            *[F.col(c).alias(f"{side}_{c}") for c in ("key", "name", "traits", "at", "prefix")],
        )

    a_length, b_length = F.col("a_traits")["length"], F.col("b_traits")["length"]
    maybe = F.startswith("token", F.lit("w")) | (F.abs(a_length - b_length) <= _edits(F.greatest(a_length, b_length), edit_share))
    met = placed(late, "a").join(placed(early, "b"), ["concept_type", "numbers", "token"]).filter(
        (F.col("a_at") > F.col("b_at")) & maybe & (F.array_intersect("a_prefix", "b_prefix")[0] == F.col("token"))
    )
    same = is_similar(F.col("a_name"), F.col("a_traits"), F.col("b_name"), F.col("b_traits"), edit_share, word_share)
    return met.filter(same).select("concept_type", F.col("a_key").alias("key"), F.col("b_key").alias("lead"), F.col("b_at").alias("at"))


_NODE = ["concept_type", "key"]


def _earliest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*_NODE).agg(F.min_by("lead", "at").alias("lead"))


def _settle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Leaders among ``nodes``: those with no leader among their earlier neighbours (``edges``)."""
    leads = nodes.select(*_NODE).join(edges.select(*_NODE), _NODE, "left_anti")
    found, open_edges = [materialize(leads, "leaders")], edges
    fresh = found[0]
    while True:
        told = fresh.select("concept_type", F.col("key").alias("lead"))
        follow = materialize(open_edges.join(told, ["concept_type", "lead"], "left_semi").select(*_NODE).distinct(), "followers")
        waiting = open_edges.join(follow, _NODE, "left_anti")
        gone = follow.select("concept_type", F.col("key").alias("lead"))
        left = materialize(waiting.join(gone, ["concept_type", "lead"], "left_anti"), "open-pairs")
        free = waiting.select(*_NODE).distinct().join(left.select(*_NODE), _NODE, "left_anti")
        fresh = materialize(free, "leaders")
        if fresh.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(fresh)
        open_edges = left


def leaders(
    names: DataFrame, known: DataFrame, edit_share: float = EDIT_SHARE, word_share: float = WORD_SHARE, first_batch: int = FIRST_BATCH
) -> DataFrame:
    """``concept_type, key, lead_key``: the leader of every name.

    ``names``: concept_type, key (unique in a type), name (a slug), seq (unique integer, the arrival).
    ``known``: concept_type, key, name of names that lead already; they arrived before all others, in
    the order of their keys, and stay apart from each other. Keys of ``known`` must not be in ``names``.
    """
    if not 0 <= edit_share <= 0.2:
        raise ValueError("letter pairs find names of which at most a fifth of the letters change")
    placed = ordinal(names.select(*_NODE, "name", "seq"), ["concept_type"], bucket_of("seq"), ["seq"], "rank")
    late = F.greatest(F.floor(F.log2((F.col("rank") - 1) / F.lit(first_batch) + F.lit(1e-12))) + 1, F.lit(0)).cast("int")
    fresh = placed.select(*_NODE, "name", F.struct(F.lit(1).alias("new"), F.col("seq").cast("bigint").alias("seq"), "key").alias("at"), late.alias("batch"))
    old = known.select(*_NODE, "name", F.struct(F.lit(0).alias("new"), F.lit(0).cast("bigint").alias("seq"), "key").alias("at"), F.lit(-1).alias("batch"))
    nodes = materialize(
        _with_prefixes(fresh.unionByName(old).withColumn("traits", name_traits(F.col("name"))), edit_share, word_share), "names"
    )
    batches = nodes.agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("b")).first()["b"] + 1
    leads, joined = nodes.filter("batch = -1"), [nodes.limit(0).select(*_NODE, F.col("key").alias("lead"))]
    for number in range(batches):
        part = nodes.filter(F.col("batch") == number)
        met = materialize(_earliest(_pairs(part, leads, edit_share, word_share)), "led")
        rest = materialize(part.join(met, _NODE, "left_anti"), "unled")
        edges = materialize(_pairs(rest, rest, edit_share, word_share), "similar")
        new = materialize(_settle(rest, edges), "leaders")
        told = new.select("concept_type", F.col("key").alias("lead"))
        joined += [met, _earliest(edges.join(new, _NODE, "left_anti").join(told, ["concept_type", "lead"], "left_semi")), new.withColumn("lead", F.col("key"))]
        leads = leads.unionByName(rest.join(new, _NODE, "left_semi"))
    return materialize(reduce(DataFrame.unionByName, joined).select(*_NODE, F.col("lead").alias("lead_key")), "name-leaders")
