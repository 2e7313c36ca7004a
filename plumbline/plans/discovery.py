"""The discovery job: from tables to scored relationship edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import Limits
from plumbline.functions.text import UTILITY_GLOBS, name_matches_glob
from plumbline.operators.edges import declared_edges, found_edges, merge_edges
from plumbline.operators.name_match import candidate_pairs, not_yet_evaluated
from plumbline.operators.overlap import shared_value_pairs, value_overlap, with_direction
from plumbline.operators.versions import table_stamps, with_versions
from plumbline.sources.catalog import column_catalog, table_nodes
from plumbline.sources.templates import quoted


@dataclass(frozen=True)
class DiscoveryOptions:
    """Settings of a scan.

    A `sample_cap` of None compares all values. Without `cascade` names do not matter: every
    column's values are compared, whole, and pairs that share any are kept. With `content_versions`
    a table's version is a checksum of its rows instead of their number. `key_share` forms only
    pairs of which one side's distinct values are at least this share of its rows.
    """

    name_threshold: float = Limits.name_similarity
    strict_types: bool = True
    domain_clustering: bool = True
    utility_globs: Sequence[str] | str = UTILITY_GLOBS
    synonyms: Mapping[str, str] | None = None
    sample_cap: int | None = Limits.overlap_sample
    cascade: bool = True
    content_versions: bool = False
    key_share: float | None = None


@dataclass(frozen=True)
class DiscoveryResult:
    """Lazy results of a scan. `release` drops the cached catalog and pair list."""

    nodes: DataFrame
    pairs: DataFrame
    overlaps: DataFrame
    edges: DataFrame
    cached: tuple[DataFrame, ...] = ()
    catalog: DataFrame | None = None

    def release(self) -> None:
        for frame in self.cached:
            frame.unpersist()


def _tables_to_scan(
    tables: Mapping[str, DataFrame],
    schema_name: str,
    globs: Sequence[str] | str,
    scope: DataFrame | None,
) -> dict[str, DataFrame]:
    """Tables in scope and their columns that are not for utility use: what is left out is not read.

    Of the scope only rows that name a given table come to the driver.
    """
    names = [t for t in tables if not name_matches_glob(t, globs)]
    if scope is not None:
        listed = scope.where((F.col("schema_name") == schema_name) & F.col("table_name").isin(names))
        wanted = {r["table_name"] for r in listed.select("table_name").distinct().collect()}
        names = [t for t in names if t in wanted]
    kept = {t: [c for c in tables[t].columns if not name_matches_glob(c, globs)] for t in names}
    return {t: tables[t].select(*[quoted(c) for c in cols]) for t, cols in kept.items() if cols}


def _versioned_catalog(tables: Mapping[str, DataFrame], schema_name: str, known: DataFrame | None) -> DataFrame:
    """The measured catalog with versions; rows of tables that have not changed come from `known`."""
    stamps = table_stamps(tables, schema_name, known)
    parts = []
    if changed := {s.table_name: tables[s.table_name] for s in stamps if not s.is_known}:
        parts.append(column_catalog(changed, schema_name, measure=True))
    if same := [s for s in stamps if s.is_known]:
        wanted = [F.struct(F.lit(s.table_name), F.lit(s.version)) for s in same]
        own = (F.col("schema_name") == schema_name) & F.struct("table_name", "version").isin(*wanted)
        columns = [c for c in known.columns if c not in ("files", "version")]
        parts.append(known.where(own).select(*columns).dropDuplicates(["table_name", "column_name"]))
    return with_versions(reduce(DataFrame.unionByName, parts), schema_name, stamps)


def discover(
    tables: Mapping[str, DataFrame],
    schema_name: str = "main",
    options: DiscoveryOptions = DiscoveryOptions(),
    scope: DataFrame | None = None,
    declared: DataFrame | None = None,
    evaluated: DataFrame | None = None,
    known: DataFrame | None = None,
) -> DiscoveryResult:
    """Catalog, candidate pairs, overlap of those that pass the name cascade, and edges.

    For an incremental scan give `known`, the `catalog` of a former one with content versions, and
    `evaluated`, the pairs it judged with their versions: tables that still have a known version are
    not measured again, and only pairs with a changed side are compared.
    """
    tables = _tables_to_scan(tables, schema_name, options.utility_globs, scope)
    in_scope = bool(tables)
    if not in_scope:  # no node and no pair, but declared keys are edges all the same
        tables = {"nothing": SparkSession.active().range(0)}
    if options.content_versions and in_scope:
        catalog = _versioned_catalog(tables, schema_name, known)
    else:
        catalog = column_catalog(tables, schema_name, measure=True).where(F.lit(in_scope))
    # Both hold metadata only, one row per column or pair, and are kept so that later steps do
    # not measure the tables again.
    catalog = catalog.persist()
    if options.cascade:
        pairs = candidate_pairs(
            catalog,
            options.name_threshold,
            options.strict_types,
            options.domain_clustering,
            options.synonyms,
            options.key_share,
        )
    else:
        pairs = shared_value_pairs(
            tables, catalog, options.strict_types, options.domain_clustering
        )
    if evaluated is not None:
        pairs = not_yet_evaluated(pairs, evaluated)
    pairs = pairs.persist()
    if options.cascade:
        overlaps = value_overlap(tables, pairs, options.sample_cap)
        directed = with_direction(overlaps, options.sample_cap)
    else:
        directed = with_direction(pairs)
    edges = found_edges(directed)
    if declared is not None:
        edges = merge_edges(edges, declared_edges(declared))
    return DiscoveryResult(table_nodes(catalog), pairs, directed, edges, (catalog, pairs), catalog)
