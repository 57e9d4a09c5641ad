"""Attribute-to-column mappings: matching, sanitation, coverage, export, evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.sqltext import resolve_names
from auditlake.functions.text import name_parts, percent, relative_path
from auditlake.operators.tables import BOOKKEEPING_TABLES, quoted
from auditlake.plans.scan import ordered_parts, range_bucketed
from auditlake.plans.sized import lookup_join, marked, parted, parts_for
from auditlake.session import materialize, settled

# Words of a formula that are not column or table names.
FORMULA_KEYWORDS = [
    "coalesce", "null", "sum", "count", "avg", "min", "max", "select", "from", "join", "on", "where",
    "group", "by", "order", "limit", "and", "or", "not", "in", "is", "as", "cast", "case", "when",
    "then", "else", "end", "like", "ilike",
]


# Names with their column that may be broadcast, within the bound of bytes.
NAME_ROWS = 1_000_000


@dataclass(frozen=True)
class Catalog:
    """Lower-cased table and column names a mapping may use; schema metadata only."""

    tables: list[str]
    columns: list[str]

    @staticmethod
    def of(schemas: dict[str, list[str]]) -> Catalog:
        """From ``table -> columns``, bookkeeping tables left out."""
        used = {t: c for t, c in schemas.items() if t.lower() not in BOOKKEEPING_TABLES}
        return Catalog(
            sorted({t.lower() for t in used}), sorted({c.lower() for cols in used.values() for c in cols})
        )


def _words(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def existing_columns(columns: Column, catalog: Catalog) -> Column:
    """Mapped columns that exist, whatever their case, in their order."""
    known = _words(catalog.columns)
    return F.filter(columns, lambda c: F.array_contains(known, F.lower(c)))


def formula_is_valid(formula: Column, catalog: Catalog) -> Column:
    """True when every identifier outside quotes is a keyword, column, table or ``table.column``."""
    bare = F.regexp_replace(F.regexp_replace(formula, "'[^']*'", ""), '"[^"]*"', "")
    found = F.regexp_extract_all(F.lower(bare), F.lit(r"\b([a-z_][a-z0-9_.]*)\b"), F.lit(1))
    plain = _words(sorted(set(FORMULA_KEYWORDS) | set(catalog.tables) | set(catalog.columns)))
    tables, columns = _words(catalog.tables), _words(catalog.columns)

    def known(t: Column) -> Column:
        rest = F.regexp_extract(t, r"^[^.]*\.(.*)$", 1)
        dotted = (
            F.contains(t, F.lit("."))
            & F.array_contains(tables, F.substring_index(t, ".", 1))
            & F.array_contains(columns, rest)
        )
        return F.array_contains(plain, t) | dotted

    return F.forall(found, known)


def sanitize(mappings: DataFrame, catalog: Catalog) -> DataFrame:
    """Keep existing columns only; without any, the attribute is unmapped; a formula naming
    anything unknown is dropped. The explanation is not carried."""
    kept = F.col("_kept")
    valid = F.coalesce(formula_is_valid(F.col("sql_formula"), catalog), F.lit(False))
    formula = F.when(F.col("sql_formula") == "", F.col("sql_formula")).when(valid, F.col("sql_formula"))
    checked = mappings.withColumn("_kept", existing_columns(F.col("mapped_columns"), catalog))
    empty = F.coalesce(F.size(kept) <= 0, F.lit(True))
    out = []
    for name in mappings.columns:
        if name == "mapped_columns":
            out.append(F.coalesce(kept, F.array().cast("array<string>")).alias(name))
        elif name == "sql_formula":
            out.append(F.when(~empty, formula).alias(name))
        elif name == "not_enough_information":
            out.append(F.when(empty, F.lit(True)).otherwise(F.col(name)).alias(name))
        elif name != "explanation":
            out.append(quoted(name))
    return checked.select(*out)


def existing_columns_join(mappings: DataFrame, key: str, columns: str, catalog: DataFrame) -> DataFrame:
    """Same filter against a catalog table ``(column_name)`` of any size, as a semi join."""
    each = mappings.select(key, F.posexplode(columns).alias("p", "c")).withColumn("column_name", F.lower("c"))
    known = catalog.select(F.lower("column_name").alias("column_name")).distinct()
    kept = (
        lookup_join(each, known, ["column_name"], "left_semi")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("p", "c"))).alias("_kept"))
    )
    joined = mappings.select(key).join(kept, key, "left")
    return joined.select(
        key,
        F.coalesce(F.transform("_kept", lambda s: s["c"]), F.array().cast("array<string>")).alias("mapped_columns"),
    )


def _name_sets(df: DataFrame, name: str, prefix: str) -> DataFrame:
    """Distinct word sets of a name column."""
    return (
        df.select(quoted(name).alias("_name")).distinct().select(name_parts("_name").alias(f"{prefix}_set")).distinct()
        .withColumn(f"{prefix}_key", F.array_join(f"{prefix}_set", " "))
        .filter(F.size(f"{prefix}_set") > 0)
    )


def _rare_words(sets: DataFrame, prefix: str, rarity: DataFrame, threshold: float) -> DataFrame:
    """For each size a partner may have, the rarest words of a set: two sets similar enough share one of them.

    Sets of l and s words with a Jaccard similarity of t share at least t / (1 + t) (l + s)
    words, so all but that many, less one, may be left out.
    """
    each = sets.select(f"{prefix}_key", F.size(f"{prefix}_set").alias("size"), F.explode(f"{prefix}_set").alias("word"))
    words = each.join(rarity, "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = Window.partitionBy(f"{prefix}_key").orderBy("df", "word")
    ranked = words.withColumn("_n", F.row_number().over(order))
    least, most = F.ceil(F.lit(threshold) * F.col("size") - F.lit(1e-9)), F.floor(F.col("size") / F.lit(threshold) + F.lit(1e-9))
    sized = ranked.withColumn("other", F.explode(F.sequence(least.cast("int"), most.cast("int"))))
    shared = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("size") + F.col("other")) - F.lit(1e-9))
    return sized.filter(F.col("_n") <= F.col("size") - shared + 1).select(f"{prefix}_key", "word", "size", "other")


def name_pairs(left: DataFrame, right: DataFrame, rarity: DataFrame, threshold: float) -> DataFrame:
    """Pairs of word sets that may be similar: of sizes that fit, with a rare word in common."""
    theirs = _rare_words(right, "r", rarity, threshold).select("r_key", "word", F.col("size").alias("other"), F.col("other").alias("size"))
    return _rare_words(left, "l", rarity, threshold).join(theirs, ["word", "size", "other"]).select("l_key", "r_key").distinct()


def schema_match(attributes: DataFrame, attribute: str, columns: DataFrame, column: str, threshold: float = 0.5) -> DataFrame:
    """Closest column per attribute name by shared words, or not enough information.

    Jaccard similarity of the word sets must reach ``threshold``; ties go to the smaller
    edit distance, then the smaller name. Word sets are compared once however many
    attributes share them, and only sets that share a rare word meet.
    """
    # Names are cut into words once for all their attributes, and found again by the whole name.
    named = materialize(attributes.select(quoted(attribute).alias("_name")).distinct(), "names")
    left = _name_sets(named, "_name", "l")
    right = materialize(_name_sets(columns, column, "r"), "columns")
    rarity = right.select(F.explode("r_set").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    pairs = name_pairs(left, right, rarity, threshold)
    split_l, split_r = F.split("l_key", " "), F.split("r_key", " ")
    shared = F.size(F.array_intersect(split_l, split_r))
    scored = pairs.select(
        "l_key",
        "r_key",
        (shared / (F.size(split_l) + F.size(split_r) - shared)).alias("similarity"),
        F.levenshtein("l_key", "r_key").alias("distance"),
    ).filter(F.col("similarity") >= threshold)
    best = scored.groupBy("l_key").agg(
        F.min_by(F.struct("r_key", "similarity"), F.struct(-F.col("similarity"), "distance", "r_key")).alias("b")
    )
    spelt = columns.select(F.array_join(name_parts(column), " ").alias("r_key"), quoted(column).alias("c")).groupBy("r_key").agg(
        F.min("c").alias("mapped_column")
    )
    keyed = named.withColumn("l_key", F.array_join(name_parts("_name"), " "))
    chosen = best.select("l_key", "b.r_key", "b.similarity").join(spelt, "r_key").join(keyed, "l_key")
    chosen = materialize(chosen.select("_name", "mapped_column", "similarity"), "matches")
    return lookup_join(attributes.withColumn("_name", quoted(attribute)), chosen, ["_name"], "left", max_rows=NAME_ROWS).select(
        *[quoted(c) for c in attributes.columns],
        "mapped_column",
        F.round("similarity", 4).alias("similarity"),
        F.col("mapped_column").isNull().alias("not_enough_information"),
    )


def mapped_only(mappings: DataFrame) -> DataFrame:
    """Attributes that are mapped and have enough information."""
    enough = ~F.coalesce(F.col("not_enough_information"), F.lit(False))
    return mappings.filter((F.size("mapped_columns") > 0) & enough)


def column_coverage(mappings: DataFrame, columns: DataFrame) -> DataFrame:
    """Distinct dataset columns that some attribute maps, of all distinct columns; case counts."""
    total = columns.select("column_name").distinct()
    used = mappings.select(F.explode("mapped_columns").alias("column_name")).distinct()
    mapped = F.col("mapped_columns")
    return (
        total.join(used.withColumn("hit", F.lit(1)), "column_name", "left")
        .agg(F.count("hit").alias("mapped_columns"), F.count(F.lit(1)).alias("total_columns"))
        .select(
            "mapped_columns",
            "total_columns",
            F.when(F.col("total_columns") > 0, mapped / F.col("total_columns") * 100.0).otherwise(F.lit(0.0)).alias("coverage_pct"),
            F.format_string(
                "Coverage: %s (%d out of %d CSV columns successfully mapped)",
                percent(mapped, F.col("total_columns")), mapped, F.col("total_columns"),
            ).alias("coverage_text"),
        )
    )


RECORD = ["mapped_columns", "sql_formula", "explanation", "not_enough_information"]


def mapping_tree(mappings: DataFrame, seq: str, record: list[str] = RECORD, part_size: int = 1_000) -> DataFrame:
    """One row per file and class with its attributes as a map; the last row of an attribute wins.

    Classes with more than ``part_size`` attributes come in numbered parts.
    """
    keys = ["source_ttl_file", "class_name", "attribute_name"]
    last = mappings.groupBy(*keys).agg(F.max_by(F.struct(*record), F.col(seq)).alias("record"))
    return _tree(range_bucketed(last, keys[:2], ["attribute_name"], "_range"), part_size)


def _tree(placed: DataFrame, part_size: int) -> DataFrame:
    """Maps of the placed attributes, each there once, as of :func:`mapping_tree`."""
    keys = ["source_ttl_file", "class_name"]
    parts = ordered_parts(placed, keys, F.col("_range"), ["attribute_name"], ["attribute_name", "record"], "_items", part_size)
    return parts.select(*keys, "part_no", F.map_from_entries("_items").alias("attributes"))


def _in_class(rows: DataFrame, parts: int) -> DataFrame:
    """Mapped attributes of classes with few rows, in order, as ``_items`` in the row of their class; the last row of an attribute wins."""
    keys = ["source_ttl_file", "class_name"]
    found = (
        marked(parted(rows, parts, *keys), keys).groupBy("_mark", *keys)
        .agg(F.array_sort(F.collect_list(F.struct("attribute_name", "_seq", *RECORD))).alias("_all"))
    )

    def wins(row: Column, at: Column) -> Column:
        after = F.get("_all", at + 1)
        enough = ~F.coalesce(row["not_enough_information"], F.lit(False))
        return (after.isNull() | ~after["attribute_name"].eqNullSafe(row["attribute_name"])) & (F.size(row["mapped_columns"]) > 0) & enough

    items = F.transform(
        F.filter("_all", wins), lambda i: F.struct(i["attribute_name"].alias("attribute_name"), F.struct(*[i[c].alias(c) for c in RECORD[:3]]).alias("record"))
    )
    return found.select(*keys, items.alias("_items")).filter(F.size("_items") > 0)


def mapping_export(mappings: DataFrame, seq: str, columns: DataFrame, base: str, part_size: int = 1_000) -> DataFrame:
    """Lines of the mapping file: the coverage comment, then one JSON object per file and class.

    Unmapped attributes, and classes and files left without any, are pruned.
    """
    keys = ["source_ttl_file", "class_name", "attribute_name"]
    rows = mappings.select(*keys, F.col(seq).alias("_seq"), *RECORD).filter("_seq IS NOT NULL")
    nameless = F.col(keys[0]).isNull() | F.col(keys[1]).isNull()
    sizes = rows.groupBy(*keys[:2]).agg(F.count(F.lit(1)).alias("_n"))
    large = materialize(sizes.filter((F.col("_n") > part_size) | nameless).select(*keys[:2]), "large-classes")
    small = rows if large.isEmpty() else lookup_join(rows.filter(~nameless), large.filter(~nameless), keys[:2], "left_anti")
    # Written once, for the coverage as for the tree.
    whole = settled(_in_class(small, parts_for(rows.sparkSession, rows.count())), "classes")
    used = whole.select(F.explode("_items.record.mapped_columns").alias("mapped_columns")).distinct()
    tree = whole.select(*keys[:2], F.lit(0).cast("bigint").alias("part_no"), F.map_from_entries("_items").alias("attributes"))
    if not large.isEmpty():
        rest = lookup_join(rows.filter(~nameless), large.filter(~nameless), keys[:2], "left_semi").unionByName(rows.filter(nameless))
        last = rest.groupBy(*keys).agg(F.max_by(F.struct(*RECORD), F.col("_seq")).alias("r")).select(*keys, "r.*")
        placed = range_bucketed(mapped_only(last).select(*keys, F.struct(*RECORD[:3]).alias("record")), keys[:2], ["attribute_name"], "_range")
        used, tree = used.unionByName(placed.select("record.mapped_columns")), tree.unionByName(_tree(placed, part_size))
    head = column_coverage(used, columns).select(
        F.lit("").alias("source_file"), F.lit("").alias("class_name"), F.lit(0).cast("bigint").alias("part_no"),
        F.concat(F.lit("# "), "coverage_text").alias("line"),
    )
    path = relative_path("source_ttl_file", base)
    body = tree.select(
        path.alias("source_file"),
        "class_name",
        "part_no",
        F.to_json(
            F.struct(path.alias("source_file"), "class_name", "attributes"), {"ignoreNullFields": "false"}
        ).alias("line"),
    )
    return head.unionByName(body)


def read_mapping_json(rows: DataFrame, text: str) -> DataFrame:
    """Flat attribute rows from the nested form ``file -> class -> attributes -> name -> record``."""
    kind = (
        "map<string,map<string,struct<attributes:map<string,struct<mapped_columns:array<string>,"
        "sql_formula:string,explanation:string,not_enough_information:boolean>>>>>"
    )
    files = rows.select(F.explode(F.from_json(F.col(text), kind)).alias("source_ttl_file", "classes"))
    named = files.select("source_ttl_file", F.explode("classes").alias("class_name", "c"))
    return named.select("source_ttl_file", "class_name", F.explode("c.attributes").alias("attribute_name", "r")).select(
        "source_ttl_file", "class_name", "attribute_name", "r.*"
    )


def semantic_view(df: DataFrame, attributes: list[tuple[str, list[str], str | None]], keep: list[str]) -> DataFrame:
    """Columns named by attribute: its formula, or its only mapped column where there is none."""
    out = [quoted(k) for k in keep]
    for name, mapped, formula in attributes:
        if formula and formula.strip():
            out.append(F.expr(resolve_names(formula, df.columns)).alias(name))
        elif len(mapped) == 1:
            out.append(quoted(mapped[0]).alias(name))
        else:
            raise ValueError(f"attribute {name} needs a formula over {mapped}")
    return df.select(*out)
