"""Relationship edges and their triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Heuristic labels and statuses.
SYSTEM_FK = "System Foreign Key"
DOMAIN_OVERLAP = "Data Domain Overlap"
FUZZY_NAME = "Fuzzy Name Match"
SUGGESTED, VERIFIED, ENFORCED, REJECTED = "suggested", "verified", "enforced", "rejected"
AMBER_BELOW = 80

EDGE_COLUMNS = (
    "id",
    "source_node",
    "source_col",
    "target_node",
    "target_col",
    "score",
    "heuristic",
    "status",
)
_ENDS = ("source_node", "source_col", "target_node", "target_col")


# Percent of a child's values below which sharing them counts as accidental.
MIN_OVERLAP = 5.0


def _edge_id() -> Column:
    return F.concat(
        F.col("source_node"),
        F.lit("."),
        F.col("source_col"),
        F.lit("->"),
        F.col("target_node"),
        F.lit("."),
        F.col("target_col"),
    )


def found_edges(directed: DataFrame) -> DataFrame:
    """Edges child -> parent: by overlap where at least MIN_OVERLAP percent is shared, else by name.

    So a few values shared by accident do not turn a good name match into a score near 0, however
    large the tables are. Pairs found by values alone have no name to fall back on. Scores are
    whole percents, rounded down, so 100 always means every value.
    """
    shares = (F.col("shared_distinct") > 0) & (
        F.col("name_similarity").isNull() | (F.col("overlap_pct") >= MIN_OVERLAP)
    )
    score = F.when(shares, F.col("overlap_pct")).otherwise(F.col("name_similarity"))
    return (
        directed.select(
            F.concat_ws(".", "child_schema", "child_table").alias("source_node"),
            F.col("child_column").alias("source_col"),
            F.concat_ws(".", "parent_schema", "parent_table").alias("target_node"),
            F.col("parent_column").alias("target_col"),
            F.floor(score).cast("int").alias("score"),
            F.when(shares, F.lit(DOMAIN_OVERLAP))
            .otherwise(F.lit(FUZZY_NAME))
            .alias("heuristic"),
            F.lit(SUGGESTED).alias("status"),
        )
        .withColumn("id", _edge_id())
        .select(*EDGE_COLUMNS)
    )


def declared_edges(declared: DataFrame) -> DataFrame:
    """Declared foreign keys (source_node, source_col, target_node, target_col) as edges."""
    return (
        declared.select(*_ENDS)
        .distinct()
        .withColumns(
            {
                "id": _edge_id(),
                "score": F.lit(100),
                "heuristic": F.lit(SYSTEM_FK),
                "status": F.lit(ENFORCED),
            }
        )
        .select(*EDGE_COLUMNS)
    )


def merge_edges(found: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Found and declared edges together; a declared key replaces a finding on its columns.

    The finding may point either way: columns in both directions count as the same pair.
    """
    if declared is None:
        return found
    ends = declared.select(*_ENDS)
    turned = ends.select(
        F.col("target_node").alias("source_node"),
        F.col("target_col").alias("source_col"),
        F.col("source_node").alias("target_node"),
        F.col("source_col").alias("target_col"),
    )
    covered = ends.unionByName(turned)
    return found.join(covered, list(_ENDS), "left_anti").unionByName(declared)


def with_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attach source and target tables to each edge."""

    def end(role: str) -> DataFrame:
        return nodes.select(
            F.col("id").alias(f"{role}_node"),
            F.col("schema_name").alias(f"{role}_schema"),
            F.col("table_name").alias(f"{role}_table"),
            F.col("row_count").alias(f"{role}_rows"),
            F.col("row_label").alias(f"{role}_row_label"),
        )

    return edges.join(end("source"), "source_node").join(end("target"), "target_node")


def apply_decisions(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Give each edge its latest decided status.

    Decisions are (edge_id, seq, new_status): verified to accept, suggested to undo, rejected.
    Enforced edges are locked.
    """
    latest = decisions.groupBy(F.col("edge_id").alias("id")).agg(
        F.max_by("new_status", "seq").alias("new_status")
    )
    locked = F.col("status") == ENFORCED
    allowed = F.col("new_status").isin(SUGGESTED, VERIFIED, REJECTED)
    return (
        edges.join(latest, "id", "left")
        .withColumn(
            "status", F.when(~locked & allowed, F.col("new_status")).otherwise(F.col("status"))
        )
        .select(*EDGE_COLUMNS)
    )


def with_band(edges: DataFrame) -> DataFrame:
    """Colour band: the status decides first, then the score."""
    return edges.withColumn(
        "band",
        F.when(F.col("status") == ENFORCED, F.lit("enforced"))
        .when(F.col("status") == VERIFIED, F.lit("verified"))
        .when(F.col("score") < AMBER_BELOW, F.lit("amber"))
        .otherwise(F.lit("blue")),
    )


def edge_summary(edges: DataFrame) -> DataFrame:
    """Number of edges per status."""
    return edges.groupBy("status").agg(F.count(F.lit(1)).alias("edges"))


def venn_report(edges: DataFrame, directed: DataFrame) -> DataFrame:
    """Distinct counts and shared values of the edges found by overlap."""
    counts = directed.select(
        F.concat_ws(".", "child_schema", "child_table").alias("source_node"),
        F.col("child_column").alias("source_col"),
        F.concat_ws(".", "parent_schema", "parent_table").alias("target_node"),
        F.col("parent_column").alias("target_col"),
        "child_distinct",
        "parent_distinct",
        "shared_distinct",
    )
    return (
        edges.where(F.col("heuristic").contains("Overlap"))
        .select("id", *_ENDS, "score")
        .join(counts, list(_ENDS))
        .select("id", "score", "child_distinct", "parent_distinct", "shared_distinct")
    )
