import datetime
import itertools
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from plumbline.functions.text import name_similarity
from plumbline.operators.edges import (
    apply_decisions,
    declared_edges,
    edge_summary,
    merge_edges,
    with_band,
    with_nodes,
)
from plumbline.operators.name_match import (
    candidate_pairs,
    class_links,
    name_classes,
    not_yet_evaluated,
    passing_cascade,
    similar_names,
)
from plumbline.operators.overlap import canonical_value, column_sets, shared_value_pairs, value_overlap, with_direction
from plumbline.operators.overlap import class_link_counts, column_classes
from plumbline.plans.discovery import DiscoveryOptions, _tables_to_scan, discover
from plumbline.sources.catalog import column_catalog, in_scope, table_nodes, without_utility

EDGE_SCHEMA = (
    "id string, source_node string, source_col string, target_node string, target_col string, "
    "score int, heuristic string, status string"
)


@pytest.mark.parametrize("threshold", [50.0, 70.0, 85.0, 99.0])
def test_similar_names_equal_brute_force(spark, threshold):
    rng = random.Random(3)
    words = ["order", "customer", "key", "id", "date", "price", "status", "o", "c", "qty"]
    names = {"_".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)}
    for name in list(names)[:30]:
        at = rng.randrange(len(name))
        names |= {name[:at] + "x" + name[at:], name[:at] + name[at + 1 :], name[:at] + "z" + name[at + 1 :]}
    names = sorted(n for n in names if n)
    df = spark.createDataFrame([("g", n) for n in names], "grp string, name string")
    got = {
        (r["name_a"], r["name_b"]): r["similarity"] for r in similar_names(df, threshold).collect()
    }
    pairs = spark.createDataFrame(list(itertools.combinations(names, 2)), "a string, b string")
    scored = pairs.withColumn("s", name_similarity(F.col("a"), F.col("b"))).where(F.col("s") > threshold)
    wanted = {(r["a"], r["b"]): r["s"] for r in scored.collect()} | {(n, n): 100.0 for n in names}
    assert got == pytest.approx(wanted)


def test_threshold_range(spark):
    df = spark.createDataFrame([("g", "a")], "grp string, name string")
    with pytest.raises(ValueError, match="between 50 and 100"):
        similar_names(df, 40.0)
    assert similar_names(df, 100.0).count() == 0


@pytest.fixture(scope="module")
def shop(spark):
    orders = spark.range(100).select(
        F.col("id"), (F.col("id") % 10).cast("int").alias("customer_id"), F.lit("n").alias("note")
    )
    customers = spark.range(12).select(
        F.col("id").cast("double").alias("customer_id"), F.concat("id", F.lit("@x.com")).alias("mail")
    )
    items = spark.range(300).select((F.col("id") % 90).alias("order_id"), F.lit(1.5).alias("amount"))
    users = spark.range(5).select(F.concat(F.col("id") + 9, F.lit("@x.com")).alias("mail"))
    return {"orders": orders, "customers": customers, "items": items, "users": users}


def test_catalog(spark, shop):
    rows = {
        (r["table_name"], r["column_name"]): r for r in column_catalog(shop, measure=True).collect()
    }
    assert rows["customers", "mail"]["semantic_tag"] == "EMAIL"
    assert rows["orders", "note"]["semantic_tag"] == "NONE"
    assert rows["orders", "customer_id"]["is_id"] and not rows["items", "amount"]["is_id"]
    assert rows["items", "amount"]["row_count"] == 300
    plain = column_catalog(shop)
    scope = spark.createDataFrame([("main", "orders")], "schema_name string, table_name string")
    assert in_scope(plain, scope).count() == 3
    assert without_utility(plain, "ord*, mail").count() == 2  # tables and columns alike
    nodes = {r["table_name"]: r for r in table_nodes(plain, {"orders": ["Core"]}).collect()}
    assert nodes["orders"]["tags"] == ["Core"] and nodes["items"]["tags"] == []


def test_semantic_tags_need_four_fifths(spark):
    mails = [("a@b.c",)] * 8
    enough = spark.createDataFrame(mails + [("no",)] * 2 + [(None,)] * 5, "v string")
    short = spark.createDataFrame(mails + [("no",)] * 3, "v string")
    empty = spark.createDataFrame([(None,)], "v string")
    rows = column_catalog({"enough": enough, "short": short, "empty": empty}, measure=True).collect()
    assert {r["table_name"]: r["semantic_tag"] for r in rows} == {
        "enough": "EMAIL",
        "short": "NONE",
        "empty": "NONE",
    }


def pair_names(pairs):
    return {
        (r["left_table"], r["left_column"], r["right_table"], r["right_column"]): r["name_similarity"]
        for r in pairs.collect()
    }


def test_bare_id_answers_to_its_table_name(shop):
    pairs = pair_names(candidate_pairs(column_catalog(shop, measure=True), 85.0))
    assert pairs == {
        ("items", "order_id", "orders", "id"): 100.0,
        ("customers", "customer_id", "orders", "customer_id"): 100.0,
        ("customers", "mail", "users", "mail"): 100.0,
    }


def test_synonyms_and_switches(spark):
    a = spark.createDataFrame([("1", 1)], "cust_no string, total int")
    b = spark.createDataFrame([(1, "1")], "client_no int, totals string")
    catalog = column_catalog({"a": a, "b": b}, measure=True)
    synonyms = {"cust": "customer", "client": "customer"}
    assert pair_names(candidate_pairs(catalog, 80.0, synonyms=synonyms)) == {}
    loose = pair_names(candidate_pairs(catalog, 80.0, strict_types=False, synonyms=synonyms))
    assert loose["a", "cust_no", "b", "client_no"] == 100.0
    assert loose["a", "total", "b", "totals"] == pytest.approx(83.3333, abs=1e-3)


CATALOG = (
    "schema_name string, table_name string, column_name string, type_family string, "
    "semantic_tag string, row_count long, distinct_count long"
)


def test_links_between_classes_count_their_pairs(spark):
    rng = random.Random(5)
    names = ["id", "user_id", "users_id", "total", "totals", "note"]
    rows = sorted({("s", f"t{rng.randrange(12)}", rng.choice(names)) for _ in range(60)})
    catalog = spark.createDataFrame([(*r, rng.choice(["NUMBER", "STRING"]), None, 10, 3) for r in rows], CATALOG)
    members = name_classes(catalog)
    listed = [(r.grp, r.name, r.table_name) for r in members.collect()]
    expected = Counter()
    for i, (g, a, t) in enumerate(listed):
        for h, b, u in listed[i + 1 :]:
            if g == h and t != u:
                expected[g, *sorted((a, b))] += 1
    links = class_links(members, 60.0).collect()
    assert len(links) == len({(r.grp, r.name_a, r.name_b) for r in links})
    assert all(r.n_pairs == expected[r.grp, r.name_a, r.name_b] for r in links)
    own = {(g, a) for g, a, _ in listed}
    assert {(r.grp, r.name_a) for r in links if r.name_a == r.name_b} == own
    assert any(r.name_a != r.name_b and r.n_pairs for r in links)
    assert class_links(members.limit(0), 60.0).count() == 0


def test_a_hot_name_is_one_class(spark):
    catalog = spark.range(10_000).selectExpr(
        "'s' AS schema_name", "concat('t', id) AS table_name", "'code' AS column_name", "'NUMBER' AS type_family",
        "CAST(NULL AS string) AS semantic_tag", "10L AS row_count", "IF(id < 2, 10L, 1L) AS distinct_count",
    )
    (link,) = class_links(name_classes(catalog), 85.0).collect()
    assert (link.columns_a, link.n_pairs) == (10_000, 10_000 * 9_999 // 2)
    assert candidate_pairs(catalog, 85.0, key_share=0.95).count() == 9_999 + 9_998


def test_pairs_with_a_key_side(spark):
    rows = [("s", "a", "code", "NUMBER", None, 10, 10), ("s", "b", "code", "NUMBER", None, 10, 2), ("s", "c", "code", "NUMBER", None, 10, 3), ("s", "d", "code", "NUMBER", None, 0, None)]
    pairs = candidate_pairs(spark.createDataFrame(rows, CATALOG), 85.0, key_share=0.9)
    assert set(pair_names(pairs)) == {("a", "code", t, "code") for t in "bcd"}


def test_cascade_is_strict(spark):
    pairs = spark.createDataFrame([(85.0,), (85.1,)], "name_similarity double")
    assert [r[0] for r in passing_cascade(pairs, 85.0).collect()] == [85.1]


def test_incremental_scan_skips_unchanged_pairs(shop):
    pairs = candidate_pairs(column_catalog(shop, measure=True), 85.0)
    versions = {
        "left_version": F.when(F.col("left_table") == "items", "299").otherwise(F.col("left_rows").cast("string")),
        "right_version": F.col("right_rows").cast("string"),
    }
    left = not_yet_evaluated(pairs, pairs.withColumns(versions).drop("left_rows", "right_rows"))
    assert {k[0] for k in pair_names(left)} == {"items"}


def test_equal_values_of_different_types_are_equal(spark):
    df = spark.sql(
        "SELECT 5 AS i, 5L AS l, 5.0D AS d, CAST(5 AS DECIMAL(10,2)) AS n, "
        "CAST('5.250' AS DECIMAL(20,3)) AS w, 5.25D AS e, CAST(5.25 AS DECIMAL(6,3)) AS f"
    )
    row = df.select(*[canonical_value(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert row["i"] == row["l"] == row["d"] == row["n"]
    assert row["w"] == row["e"] == row["f"] != row["i"]


@pytest.mark.parametrize(
    "value",
    ["0", "-0.5", "0.0001", "0.000000001", "12345678.5", "-12345678.5", "3000000000000000", "1000000000000000000", "120", "0.1"],
)
def test_number_text_does_not_depend_on_type_or_size(spark, value):
    types = ["DOUBLE", "DECIMAL(38,10)", "DECIMAL(32,12)"]
    if "." not in value:
        types += ["BIGINT", "DECIMAL(38,0)"]
    if len(value.lstrip("-")) < 10 and "." in value and "12345678" not in value:
        types.append("FLOAT")
    df = spark.sql("SELECT " + ", ".join(f"CAST('{value}' AS {t}) AS c{i}" for i, t in enumerate(types)))
    row = df.select(*[canonical_value(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert len(set(row)) == 1


def test_scan_reads_no_excluded_or_unscoped_table(spark, shop):
    scope = spark.createDataFrame([("main", "items")], "schema_name string, table_name string")
    kept = _tables_to_scan(dict(shop) | {"audit_log": shop["items"]}, "main", "audit_*, *_tmp", scope)
    assert list(kept) == ["items"]
    assert "audit_log" not in _tables_to_scan(dict(shop) | {"audit_log": shop["items"]}, "main", "audit_*", None)


def test_one_shared_value_does_not_hide_a_good_name(spark):
    a = spark.range(1000).select((F.col("id") * 2 + 1).alias("c_acctbal"))
    b = spark.range(1000).select((F.col("id") * 2 + 2001 - F.when(F.col("id") == 0, 2).otherwise(1)).alias("s_acctbal"))
    found = discover({"c": a, "s": b}).edges.collect()
    assert [(r["heuristic"], r["score"]) for r in found] == [("Fuzzy Name Match", 88)]


def test_discovery_of_a_small_shop(spark, shop):
    declared = spark.createDataFrame(
        [("main.orders", "customer_id", "main.customers", "customer_id")],
        "source_node string, source_col string, target_node string, target_col string",
    )
    for cap in (None, 100_000):
        result = discover(shop, options=DiscoveryOptions(sample_cap=cap), declared=declared)
        edges = {r["id"]: r for r in result.edges.collect()}
        assert set(edges) == {
            "main.items.order_id->main.orders.id",
            "main.orders.customer_id->main.customers.customer_id",
            "main.users.mail->main.customers.mail",
        }
        fk = edges["main.orders.customer_id->main.customers.customer_id"]
        assert (fk["status"], fk["score"]) == ("enforced", 100)
        assert edges["main.items.order_id->main.orders.id"]["score"] == 100
        assert edges["main.users.mail->main.customers.mail"]["score"] == 60
        result.release()


def test_values_find_pairs_with_mismatched_names(spark, shop):
    result = discover(shop, options=DiscoveryOptions(cascade=False))
    found = {r["id"]: r["score"] for r in result.edges.collect()}
    assert found["main.customers.customer_id->main.orders.id"] == 100
    assert found["main.users.mail->main.customers.mail"] == 60
    assert not any(i.split("->")[0].split(".")[1] == i.split("->")[1].split(".")[1] for i in found)
    result.release()


def test_sampled_overlap_is_close_and_keeps_parents_whole(spark):
    child = spark.range(50_000).select((F.col("id") % 40_000).alias("thing_id"))
    parent = spark.range(20_000, 60_000).withColumnRenamed("id", "thing_id")
    tables = {"child": child, "parent": parent}
    pairs = candidate_pairs(column_catalog(tables, measure=True), 85.0).persist()
    exact = with_direction(value_overlap(tables, pairs)).first()
    assert (exact["shared_distinct"], exact["overlap_pct"]) == (20_000, 50.0)
    sampled = with_direction(value_overlap(tables, pairs, sample_cap=5000)).first()
    assert sampled["overlap_pct"] == pytest.approx(50.0, abs=4)
    pairs.unpersist()


def test_hot_values_and_many_columns_per_word(spark):
    """More columns than one mask word holds, each with a value that fills most rows."""
    tables = {
        f"t{i:02d}": spark.range(40).select(
            F.when(F.col("id") < 30, -1).otherwise(F.col("id") + i).alias("ref_no")
        )
        for i in range(65)
    }
    catalog = column_catalog({k: v for k, v in tables.items() if k < "t03" or k > "t61"}, measure=True)
    kept = {k: v for k, v in tables.items() if k < "t03" or k > "t61"}
    got = pair_names(candidate_pairs(catalog, 85.0))
    assert len(got) == len(kept) * (len(kept) - 1) // 2
    from plumbline.operators import overlap

    pairs = candidate_pairs(catalog, 85.0)
    original, overlap.WORD_BITS = overlap.WORD_BITS, 2
    try:
        rows = with_direction(value_overlap(kept, pairs)).collect()
    finally:
        overlap.WORD_BITS = original
    for r in rows:
        gap = abs(int(r["child_table"][1:]) - int(r["parent_table"][1:]))
        assert r["shared_distinct"] == 1 + max(0, 10 - gap)
        assert r["child_distinct"] == r["parent_distinct"] == 11


def graph(spark):
    return spark.createDataFrame(
        [
            ("e1", "n3", "ORDER_ID", "n1", "ID", 98, "Data Domain Overlap", "suggested"),
            ("e2", "n1", "CUSTOMER_ID", "n2", "ID", 100, "System Foreign Key", "enforced"),
            ("e3", "n3", "PROD_SKU", "n1", "SKU_REF", 72, "Fuzzy Name Match", "suggested"),
        ],
        EDGE_SCHEMA,
    )


def test_bands_and_triage(spark):
    edges = graph(spark)
    bands = {r["id"]: r["band"] for r in with_band(edges).collect()}
    assert bands == {"e1": "blue", "e2": "enforced", "e3": "amber"}
    schema = "edge_id string, seq long, new_status string"
    accept = [("e1", 1, "verified"), ("e2", 1, "suggested"), ("e3", 1, "rejected")]
    decided = {r["id"]: r["status"] for r in apply_decisions(edges, spark.createDataFrame(accept, schema)).collect()}
    assert decided == {"e1": "verified", "e2": "enforced", "e3": "rejected"}
    undo = spark.createDataFrame([*accept, ("e1", 2, "suggested"), ("e3", 2, "nonsense")], schema)
    undone = apply_decisions(edges, undo)
    assert {r["id"]: r["status"] for r in undone.collect()} == {
        "e1": "suggested",
        "e2": "enforced",
        "e3": "suggested",
    }
    counts = {r["status"]: r["edges"] for r in edge_summary(undone).collect()}
    assert counts == {"suggested": 2, "enforced": 1}


def test_nodes_are_attached_to_both_ends(spark):
    nodes = spark.createDataFrame(
        [("n1", "SALES", "ORDERS", 1_200_000, "1.2M"), ("n2", "SALES", "CUSTOMERS", 450_000, "450k"),
         ("n3", "SALES", "ORDER_ITEMS", 4_500_000, "4.5M")],
        "id string, schema_name string, table_name string, row_count long, row_label string",
    )
    rows = {r["id"]: r for r in with_nodes(graph(spark), nodes).collect()}
    assert (rows["e1"]["source_table"], rows["e1"]["target_table"]) == ("ORDER_ITEMS", "ORDERS")
    assert rows["e2"]["target_row_label"] == "450k"


def test_declared_key_replaces_findings_either_way(spark):
    ends = "source_node string, source_col string, target_node string, target_col string"
    declared = declared_edges(spark.createDataFrame([("n1", "ID", "n3", "ORDER_ID")], ends))
    merged = {r["id"]: r["heuristic"] for r in merge_edges(graph(spark), declared).collect()}
    assert "e1" not in merged and merged["n1.ID->n3.ORDER_ID"] == "System Foreign Key"
    assert len(merged) == 3


def test_edges_found_by_values_are_labelled_so_and_an_empty_scope_finds_nothing(spark):
    first = spark.range(1000).selectExpr("id AS alpha")
    second = spark.range(1000).selectExpr("id + 970 AS zzqk")
    found = discover({"one": first, "two": second}, options=DiscoveryOptions(cascade=False))
    edges = [(r["heuristic"], r["score"]) for r in found.edges.collect()]
    found.release()
    assert edges == [("Data Domain Overlap", 3)]
    scope = spark.createDataFrame([("main", "elsewhere")], "schema_name string, table_name string")
    declared = spark.createDataFrame([("main.a", "x", "main.b", "y")], "source_node string, source_col string, target_node string, target_col string")
    nothing = discover({"one": first}, scope=scope, declared=declared)
    assert nothing.nodes.count() == nothing.pairs.count() == nothing.overlaps.count() == 0
    assert [r["heuristic"] for r in nothing.edges.collect()] == ["System Foreign Key"]


def test_columns_with_equal_values_are_one_class(spark):
    left = spark.range(60).selectExpr("id AS a", "id % 60 AS b", "id + 50 AS c", "CAST(NULL AS BIGINT) AS d", "CAST(id AS STRING) AS e")
    right = spark.range(60).selectExpr("CAST(id AS DOUBLE) AS a", "id + 1000 AS z", "CAST(id + 100 AS DECIMAL(9,2)) AS y")
    catalog = column_catalog({"left": left, "right": right}, measure=True).persist()
    result = column_classes({"left": left, "right": right}, catalog)
    classes, links = result.classes, result.links
    found = {f"{r['table_name']}.{r['column_name']}": (r["class_id"], r["distinct"], r["n_links"]) for r in class_link_counts(classes, links).collect()}
    assert found == {
        "left.a": ("main.left.a", 60, 1),
        "left.b": ("main.left.a", 60, 1),
        "left.c": ("main.left.c", 60, 2),
        "left.d": ("main.left.d", 0, 0),
        "left.e": ("main.left.e", 60, 0),
        "right.a": ("main.left.a", 60, 3),
        "right.z": ("main.right.z", 60, 0),
        "right.y": ("main.right.y", 60, 1),
    }
    pairs = {frozenset((r["left_class"], r["right_class"])): r["shared"] for r in links.collect()}
    assert pairs == {frozenset(("main.left.a", "main.left.c")): 10, frozenset(("main.left.c", "main.right.y")): 10}
    catalog.unpersist()
    result.release()


def test_many_copies_of_a_key_are_one_class_without_pairs(spark):
    def wide(n, start=0):
        return spark.range(30).select(*[(F.col("id") + start).alias(f"k{i}") for i in range(n)])

    tables = {"one": wide(100), "two": wide(100), "three": wide(1, 20)}
    rows = [("main", t, c, "NUMERIC", "NONE") for t, df in tables.items() for c in df.columns]
    catalog = spark.createDataFrame(rows, "schema_name string, table_name string, column_name string, type_family string, semantic_tag string")
    result = column_classes(tables, catalog)
    classes, links = result.classes, result.links
    assert [tuple(r) for r in links.select("left_class", "right_class", "shared").collect()] == [("main.one.k0", "main.three.k0", 10)]
    counts = {(r["class_id"], r["table_name"], r["n_links"]): r["count"] for r in class_link_counts(classes, links).groupBy("class_id", "table_name", "n_links").count().collect()}
    assert counts == {("main.one.k0", "one", 101): 100, ("main.one.k0", "two", 101): 100, ("main.three.k0", "three", 200): 1}
    result.release()


def members_of(tables, group=lambda name: 0):
    names = [(t, c) for t, df in tables.items() for c in df.columns]
    return [{"table_name": t, "column_name": c, "group_no": group(c), "bit": i, "floor": 0} for i, (t, c) in enumerate(names)]


def test_values_are_equal_where_their_canonical_texts_are(spark):
    nan, inf, big = float("nan"), float("inf"), 2**53
    numbers = {
        "bigint": [0, 1, -5, 7, big - 1, big, big + 1, -big - 1, 2**63 - 1, None],
        "int": [0, 1, -5, 100, None],
        "double": [0.0, -0.0, 1.0, 0.1, 0.5, nan, inf, -inf, float(big), 1e20, 1e-7, 123456.789, float(2**63), None],
        "float": [-0.0, 0.1, 0.5, 16777216.0, nan, inf, 1e20, None],
        "decimal(9,2)": [Decimal("0.10"), Decimal("1.00"), Decimal("-5.00"), None],
        "decimal(38,10)": [Decimal(x) for x in ("0.1", "0.1000000001", "100", "123456.789", "9007199254740993", "0.3000000000", "9007199254740991.5", "12345678.1234567891")],
    }
    moments = {
        "date": [datetime.date(2024, 3, 31), datetime.date(1969, 1, 1), None],
        "timestamp": [datetime.datetime(2024, 3, 31, 0, 0), datetime.datetime(2024, 3, 31, 2, 30, 0, 1)],
        "timestamp_ntz": [datetime.datetime(2024, 3, 31, 0, 0), datetime.datetime(2024, 3, 31, 2, 30, 0, 1), datetime.datetime(1969, 1, 1)],
    }
    others = {"string": ["0", "5e1", "-5e1", "2024-03-31 00:00:00", "true", "x" * 99, "", None], "boolean": [True, None]}

    def frames(kinds, tag):
        return {f"{tag}{i}": spark.createDataFrame([(v,) for v in values], f"`{tag}_{i}` {kind}") for i, (kind, values) in enumerate(kinds.items())}

    apart = {**frames(numbers, "n"), **frames(moments, "m"), **frames({"string": others["string"]}, "s")}
    mixed = frames({**numbers, **moments, **others}, "a")
    for tables, group in ((apart, lambda name: "nms".index(name[0])), (mixed, lambda name: 0)):
        members = members_of(tables, group)
        holders = {}
        for m in members:
            field = tables[m["table_name"]].schema[0]
            for r in tables[m["table_name"]].select(canonical_value(F.col(field.name), field.dataType).alias("v")).collect():
                if r.v is not None:
                    holders.setdefault((m["group_no"], r.v), set()).add(m["bit"])
        expected = Counter((g, sum(1 << b for b in bits)) for (g, _), bits in holders.items())
        for sampled in (False, True):
            found = Counter()
            for r in column_sets(tables, members, sampled).collect():
                found[r.group_no, r.words[0]] += r.n_values
            assert found == expected


def test_one_expression_serves_all_columns(spark):
    def casts(n):
        tables = {"t": spark.range(3).select(*[(F.col("id") / 3).alias(f"c{i}") for i in range(n)])}
        return plan_of(column_sets(tables, members_of(tables), False)).lower().count("as string")

    assert casts(6) == casts(2)


def test_sets_of_columns_are_not_taken_apart_for_each_value(spark):
    tables = {t: spark.range(9).withColumnRenamed("id", "shop_id") for t in ("a", "b")}
    catalog = column_catalog(tables, measure=True).persist()
    pairs = shared_value_pairs(tables, catalog)
    assert [(r.left_distinct, r.left_shared) for r in pairs.collect()] == [(9, 9)]
    assert not [line for line in plan_of(pairs).splitlines() if "Filter" in line and "sequence(" in line]


def test_overlap_takes_sets_apart_once_counted(spark):
    tables = {t: spark.range(9).withColumnRenamed("id", "shop_id") for t in ("a", "b")}
    overlaps = value_overlap(tables, candidate_pairs(column_catalog(tables, measure=True).persist(), 85.0))
    assert [(r.left_distinct, r.left_shared) for r in overlaps.collect()] == [(9, 9)]
    assert not [line for line in plan_of(overlaps).splitlines() if "Filter" in line and "sequence(" in line]
