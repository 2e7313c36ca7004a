"""Candidate column pairs by name, without comparing every name with every other."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import canonical_name, name_aliases, name_similarity

LOWEST_THRESHOLD, HIGHEST_THRESHOLD = 50.0, 100.0

PAIR_KEY = (
    "left_schema",
    "left_table",
    "left_column",
    "right_schema",
    "right_table",
    "right_column",
)


def _edits_allowed(longer: Column, threshold: float) -> Column:
    """Most edits that leave names of this longer length above the threshold."""
    slack = F.lit(100 - threshold) / 100
    return F.greatest(F.ceil(longer * slack) - 1, F.lit(0)).cast("int")


def _segment_start(i: Column, length: Column, pieces: Column) -> Column:
    return F.floor(i * length / pieces).cast("int")


def similar_names(names: DataFrame, threshold: float) -> DataFrame:
    """(grp, name_a, name_b, similarity) of all names in a group above the threshold.

    Exact. A name cut into d + 1 pieces keeps one piece whole under d edits, shifted by at most
    d places, so two names within d edits share a piece at about the same place. An equi-join
    on (lengths, piece number, piece text) finds them; the edit distance then decides. Every
    name also pairs with itself.
    """
    if not LOWEST_THRESHOLD <= threshold <= HIGHEST_THRESHOLD:
        raise ValueError("threshold must lie between 50 and 100")
    distinct = names.select("grp", "name").distinct()
    itself = distinct.select(
        "grp", F.col("name").alias("name_a"), F.col("name").alias("name_b")
    ).withColumn("similarity", F.lit(100.0))
    if threshold >= HIGHEST_THRESHOLD:
        return itself.limit(0)
    longer, shorter, edits, i = (F.col(c) for c in ("longer", "shorter", "edits", "i"))
    pieces = edits + 1

    shorter_side = (
        distinct.withColumn("shorter", F.length("name"))
        .withColumn("longer", F.explode(F.sequence(shorter, shorter * 2 + 1)))
        .withColumn("edits", _edits_allowed(longer, threshold))
        .where((edits > 0) & (longer - shorter <= edits))
        .withColumn("i", F.explode(F.sequence(F.lit(0), edits)))
        .withColumn("start", _segment_start(i, shorter, pieces))
        .withColumn("size", _segment_start(i + 1, shorter, pieces) - F.col("start"))
        .select(
            "grp",
            "longer",
            "shorter",
            "i",
            F.substring("name", F.col("start") + 1, F.col("size")).alias("piece"),
            F.col("name").alias("name_a"),
        )
    )
    longer_side = (
        distinct.withColumn("longer", F.length("name"))
        .withColumn("edits", _edits_allowed(longer, threshold))
        .where(edits > 0)
        .withColumn("shorter", F.explode(F.sequence(longer - edits, longer)))
        .withColumn("i", F.explode(F.sequence(F.lit(0), edits)))
        .withColumn("start", _segment_start(i, shorter, pieces))
        .withColumn("size", _segment_start(i + 1, shorter, pieces) - F.col("start"))
        .withColumn("lowest", F.greatest(F.col("start") - edits, F.lit(0)))
        .withColumn("highest", F.least(F.col("start") + edits, longer - F.col("size")))
        .where("lowest <= highest")
        .withColumn("at", F.explode(F.sequence("lowest", "highest")))
        .select(
            "grp",
            "longer",
            "shorter",
            "i",
            F.substring("name", F.col("at") + 1, F.col("size")).alias("piece"),
            F.col("name").alias("name_b"),
        )
        .distinct()
    )
    near = (
        shorter_side.join(longer_side, ["grp", "longer", "shorter", "i", "piece"])
        .where("name_a <> name_b")
        .select(
            "grp",
            F.least("name_a", "name_b").alias("name_a"),
            F.greatest("name_a", "name_b").alias("name_b"),
        )
        .distinct()
        .withColumn("similarity", name_similarity(F.col("name_a"), F.col("name_b")))
        .where(F.col("similarity") > threshold)
    )
    return itself.unionByName(near)


def match_group(strict_types: bool, domain_clustering: bool) -> Column:
    """What two columns must agree on to be compared at all."""
    return F.concat_ws(
        "/",
        F.col("type_family") if strict_types else F.lit("ANY"),
        F.coalesce("semantic_tag", F.lit("NONE")) if domain_clustering else F.lit("ANY"),
    )


def name_classes(
    catalog: DataFrame,
    strict_types: bool = True,
    domain_clustering: bool = True,
    synonyms: Mapping[str, str] | None = None,
) -> DataFrame:
    """The catalog with `grp` and `name`: columns that agree in both are one class.

    A column is in one class for each name that it answers to.
    """
    return catalog.withColumns(
        {
            "grp": match_group(strict_types, domain_clustering),
            "name": F.explode(name_aliases(F.col("column_name"), F.col("table_name"))),
        }
    ).withColumn("name", canonical_name(F.col("name"), synonyms))


def class_links(members: DataFrame, threshold: float = 85.0) -> DataFrame:
    """Links between name classes: grp, name_a, name_b, similarity, columns_a, columns_b, n_pairs.

    A class is linked with itself and with classes whose name is more similar than the threshold.
    n_pairs is the number of pairs of columns of different tables that the link stands for. It is
    counted per class and table, so a name that very many tables have costs a row for each of them
    and not one for each pair.
    """
    table = ["schema_name", "table_name"]
    per_table = members.groupBy("grp", "name", *table).agg(F.count("*").alias("n"))
    sizes = per_table.groupBy("grp", "name").agg(F.sum("n").alias("n"))
    left = per_table.select("grp", F.col("name").alias("name_a"), *table, F.col("n").alias("n_a"))
    right = per_table.select("grp", F.col("name").alias("name_b"), *table, F.col("n").alias("n_b"))
    links = similar_names(sizes, threshold)
    within = (
        links.select("grp", "name_a", "name_b")
        .join(left, ["grp", "name_a"])
        .join(right, ["grp", "name_b", *table])
        .groupBy("grp", "name_a", "name_b")
        .agg(F.sum(F.col("n_a") * F.col("n_b")).alias("within"))
    )
    across = F.col("columns_a") * F.col("columns_b") - F.coalesce("within", F.lit(0))
    return (
        links.join(sizes.toDF("grp", "name_a", "columns_a"), ["grp", "name_a"])
        .join(sizes.toDF("grp", "name_b", "columns_b"), ["grp", "name_b"])
        .join(within, ["grp", "name_a", "name_b"], "left")
        .withColumn("n_pairs", F.when(F.col("name_a") == F.col("name_b"), across / 2).otherwise(across).cast("long"))
        .select("grp", "name_a", "name_b", "similarity", "columns_a", "columns_b", "n_pairs")
    )


def expand_links(members: DataFrame, links: DataFrame, key_share: float | None = None) -> DataFrame:
    """Column pairs of different tables that links between classes stand for; the left side sorts first.

    With `key_share` only pairs are formed of which one side could be a key: its distinct values
    are at least this share of its rows. Others are left out before any join.
    """
    both_ways = F.when(
        F.col("name_a") == F.col("name_b"), F.array(F.struct("name_a", "name_b"))
    ).otherwise(
        F.array(
            F.struct("name_a", "name_b"),
            F.struct(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b")),
        )
    )
    oriented = links.select("grp", "similarity", F.inline(both_ways))
    versioned = "version" in members.columns

    def side(prefix: str, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(
            "grp",
            F.col("name").alias(name),
            *([F.col("version").alias(f"{prefix}_version")] if versioned else []),
            F.col("schema_name").alias(f"{prefix}_schema"),
            F.col("table_name").alias(f"{prefix}_table"),
            F.col("column_name").alias(f"{prefix}_column"),
            F.col("row_count").alias(f"{prefix}_rows"),
            F.col("distinct_count").alias(f"{prefix}_estimate"),
        )

    ordered = F.struct("left_schema", "left_table") < F.struct("right_schema", "right_table")

    def formed(lefts: DataFrame, rights: DataFrame) -> DataFrame:
        return (
            side("left", "name_a", lefts)
            .join(oriented, ["grp", "name_a"])
            .join(side("right", "name_b", rights), ["grp", "name_b"])
            .where(ordered)
        )

    if key_share is None:
        pairs = formed(members, members)
    else:
        like_key = F.coalesce(F.col("distinct_count") >= F.lit(key_share) * F.col("row_count"), F.lit(False))
        keys, others = members.where(like_key), members.where(~like_key)
        pairs = formed(keys, members).unionByName(formed(others, keys))
    return pairs.groupBy(*PAIR_KEY, "grp").agg(
        F.max("similarity").alias("name_similarity"),
        *[
            F.max(c).alias(c)
            for c in ("left_rows", "right_rows", "left_estimate", "right_estimate")
        ],
        *[F.max(c).alias(c) for c in ("left_version", "right_version") if versioned],
    )


def candidate_pairs(
    catalog: DataFrame,
    threshold: float = 85.0,
    strict_types: bool = True,
    domain_clustering: bool = True,
    synonyms: Mapping[str, str] | None = None,
    key_share: float | None = None,
) -> DataFrame:
    """Column pairs of different tables whose names are more similar than the threshold.

    Pairs are unordered: the left side sorts first. Type families and semantic tags must agree
    unless switched off. Similarity is the best over the aliases of both columns. `key_share` asks
    that one side could be a key, see `expand_links`.
    """
    members = name_classes(catalog, strict_types, domain_clustering, synonyms)
    return expand_links(members, similar_names(members, threshold), key_share)


def passing_cascade(pairs: DataFrame, threshold: float = 85.0) -> DataFrame:
    """The pairs worth the costly overlap: name similarity strictly above the threshold."""
    return pairs.where(F.col("name_similarity") > threshold)


def not_yet_evaluated(pairs: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Pairs without a finding for the current versions of both tables.

    `evaluated` holds PAIR_KEY and the `left_version`, `right_version` it was computed on; the
    row count serves as version where `pairs` carries none, as pairs of a catalog with content
    versions do.
    """
    if "left_version" not in pairs.columns:
        pairs = pairs.withColumns(
            {
                "left_version": F.col("left_rows").cast("string"),
                "right_version": F.col("right_rows").cast("string"),
            }
        )
    return pairs.join(evaluated, [*PAIR_KEY, "left_version", "right_version"], "left_anti")
