"""The SQL each registered query is compared with, over the same tables."""

from __future__ import annotations

from math import comb

# Fixed values, written out apart from the code they are compared with: tests of semantic tags, and
# lower and upper critical values of chi-squared at 0.05 for 1 to 30 degrees of freedom.
SEMANTIC_PATTERNS = (
    ('UUID', '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$'),
    ('EMAIL', '^[^@ ]+@[^@ ]+[.][^@ ]+$'),
    ('URL', '^https?://'),
    ('DATE', '^[0-9]{4}-[0-9]{2}-[0-9]{2}'),
    ('JSON', '(?s)^[{].*[}]\\s*$'),
)
CHI2_TABLE = (
    (0.00098207, 5.02388619), (0.05063562, 7.37775891), (0.21579528, 9.3484036), (0.48441856, 11.14328678), (0.83121161, 12.83250199),
    (1.23734425, 14.44937534), (1.68986918, 16.01276427), (2.17973075, 17.53454614), (2.7003895, 19.0227678), (3.24697278, 20.48317735),
    (3.81574825, 21.92004926), (4.40378851, 23.33666416), (5.00875051, 24.73560488), (5.6287261, 26.11894805), (6.2621378, 27.48839286),
    (6.90766435, 28.84535072), (7.56418645, 30.19100912), (8.23074619, 31.52637844), (8.90651648, 32.85232686), (9.59077739, 34.1696069),
    (10.28289778, 35.47887591), (10.98232073, 36.78071208), (11.68855192, 38.07562725), (12.40115022, 39.36407703), (13.11972002, 40.64646912),
    (13.84390498, 41.9231701), (14.57338273, 43.19451097), (15.30786055, 44.46079184), (16.0470717, 45.7222858), (16.79077227, 46.97924224),
)

# Scalar columns of the test tables: name, Spark type, type family.
SCHEMA = {
    "region": [("r_regionkey", "int", "NUMERIC"), ("r_name", "string", "STRING")],
    "nation": [
        ("n_nationkey", "int", "NUMERIC"),
        ("n_name", "string", "STRING"),
        ("n_regionkey", "int", "NUMERIC"),
    ],
    "customer": [
        ("c_custkey", "bigint", "NUMERIC"),
        ("c_name", "string", "STRING"),
        ("c_nationkey", "int", "NUMERIC"),
        ("c_acctbal", "double", "NUMERIC"),
        ("c_mktsegment", "string", "STRING"),
    ],
    "supplier": [
        ("s_suppkey", "bigint", "NUMERIC"),
        ("s_name", "string", "STRING"),
        ("s_nationkey", "int", "NUMERIC"),
        ("s_acctbal", "double", "NUMERIC"),
    ],
    "part": [
        ("p_partkey", "bigint", "NUMERIC"),
        ("p_name", "string", "STRING"),
        ("p_brand", "string", "STRING"),
        ("p_type", "string", "STRING"),
        ("p_size", "int", "NUMERIC"),
        ("p_retailprice", "double", "NUMERIC"),
    ],
    "orders": [
        ("o_orderkey", "bigint", "NUMERIC"),
        ("o_custkey", "bigint", "NUMERIC"),
        ("o_orderstatus", "string", "STRING"),
        ("o_totalprice", "double", "NUMERIC"),
        ("o_orderdate", "timestamp_ntz", "TEMPORAL"),
        ("o_orderpriority", "string", "STRING"),
    ],
    "lineitem": [
        ("l_orderkey", "bigint", "NUMERIC"),
        ("l_partkey", "bigint", "NUMERIC"),
        ("l_suppkey", "bigint", "NUMERIC"),
        ("l_linenumber", "int", "NUMERIC"),
        ("l_quantity", "double", "NUMERIC"),
        ("l_extendedprice", "double", "NUMERIC"),
        ("l_discount", "double", "NUMERIC"),
        ("l_tax", "double", "NUMERIC"),
        ("l_returnflag", "string", "STRING"),
        ("l_linestatus", "string", "STRING"),
        ("l_shipdate", "timestamp_ntz", "TEMPORAL"),
    ],
    "events": [
        ("event_id", "bigint", "NUMERIC"),
        ("ts", "timestamp_ntz", "TEMPORAL"),
        ("user_id", "bigint", "NUMERIC"),
        ("event_type", "string", "STRING"),
        ("value", "double", "NUMERIC"),
        ("props", "string", "STRING"),
    ],
    "documents": [
        ("doc_id", "bigint", "NUMERIC"),
        ("text", "string", "STRING"),
        ("lang", "string", "STRING"),
        ("source", "string", "STRING"),
        ("n_chars", "bigint", "NUMERIC"),
    ],
    "embeddings": [("vec_id", "bigint", "NUMERIC"), ("label", "int", "NUMERIC")],
    "pages": [
        ("page_id", "bigint", "NUMERIC"),
        ("url", "string", "STRING"),
        ("html", "string", "STRING"),
    ],
    "benchmark": [("item_id", "bigint", "NUMERIC"), ("text", "string", "STRING")],
    "labels": [
        ("doc_id", "bigint", "NUMERIC"),
        ("quality", "int", "NUMERIC"),
        ("toxic", "int", "NUMERIC"),
    ],
    "conversations": [
        ("conv_id", "bigint", "NUMERIC"),
        ("turn", "bigint", "NUMERIC"),
        ("role", "string", "STRING"),
        ("text", "string", "STRING"),
    ],
}

ID_TEST = "(regexp_matches(lower({0}), '(_id|_sk|_key|uuid)$') OR lower({0}) IN ('id', 'pk'))"

def _label(n: str) -> str:
    def scaled(unit: int) -> str:
        return f"regexp_replace(printf('%.1f', floor({n} * 10 / {unit}) / 10), '[.]0$', '')"

    return (
        f"CASE WHEN {n} >= 1000000 THEN {scaled(1000000)} || 'M' "
        f"WHEN {n} >= 1000 THEN {scaled(1000)} || 'k' ELSE CAST({n} AS VARCHAR) END"
    )


def _pattern(column: str) -> str:
    return (
        f"regexp_replace(regexp_replace({column}, '[A-Za-z]', 'A', 'g'), '[0-9]', 'N', 'g')"
    )


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _columns(table: str, *families: str) -> list[str]:
    return [c for c, _, family in SCHEMA[table] if not families or family in families]


def _family(table: str, column: str) -> str:
    return next(family for c, _, family in SCHEMA[table] if c == column)


# --- pass 1 -----------------------------------------------------------------------------------


def _profile_base() -> str:
    items = ["count(*) AS total_count"]
    for column, _, family in SCHEMA["lineitem"]:
        if family == "TEMPORAL":
            continue
        empty = f"{column} IS NULL" + (f" OR trim({column}) = ''" if family == "STRING" else "")
        items.append(f'count(*) FILTER ({empty}) AS "{column}__Empty Count"')
        items.append(f'min({column}) AS "{column}__Min"')
        items.append(f'max({column}) AS "{column}__Max"')
        if family == "NUMERIC":
            items.append(f'round(avg({column}), 4) AS "{column}__Mean"')
    return "SELECT " + ",\n".join(items) + " FROM lineitem"


def _profile_metrics() -> str:
    parts = []
    for column, _, family in SCHEMA["lineitem"]:
        text = family == "STRING"
        empty = f"{column} IS NULL" + (f" OR trim({column}) = ''" if text else "")
        mean = f"round(avg({column}), 4)" if family == "NUMERIC" else "CAST(NULL AS DOUBLE)"
        patterns = f"count(DISTINCT {_pattern(column)})" if text else "CAST(NULL AS BIGINT)"
        parts.append(
            f"SELECT '{column}' AS column_name, count(*) AS total_count, "
            f"count(*) FILTER ({empty}) AS empty_count, CAST(min({column}) AS VARCHAR) AS \"min\", "
            f'CAST(max({column}) AS VARCHAR) AS "max", {mean} AS mean_val, '
            f"count(DISTINCT {column}) AS distinct_count, {patterns} AS pattern_distinct_count "
            "FROM lineitem"
        )
    return _union(parts)


def _stat_templates() -> str:
    items = ["count(*) AS total_count"]
    for column in ("l_quantity", "l_discount"):
        items.append(f'round(avg({column}), 4) AS "{column}__Mean"')
        items.append(f'min(abs({column})) AS "{column}__Min"')
        items.append(f'count(*) FILTER ({column} = 0) AS "{column}__Empty Count"')
    return "SELECT " + ", ".join(items) + " FROM lineitem"


def _exact_distinct() -> str:
    return _union(
        [
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM lineitem"
            for c in _columns("lineitem")
        ]
    )


def _approx_distinct() -> str:
    return _union(
        [
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS exact_count, true AS is_close "
            "FROM lineitem"
            for c in _columns("lineitem")
        ]
    )


def _pattern_cardinality() -> str:
    return _union(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
            f"count(DISTINCT {_pattern(c)}) AS pattern_count FROM {t}"
            for t in ("orders", "part")
            for c in _columns(t, "STRING")
        ]
    )


# --- gates ------------------------------------------------------------------------------------


def _judged() -> str:
    parts = []
    for table in ("customer", "events", "documents", "pages"):
        for column, _, family in SCHEMA[table]:
            text, number = family == "STRING", family == "NUMERIC"
            patterns = f"count(DISTINCT {_pattern(column)})" if text else "CAST(NULL AS BIGINT)"
            low = f"CAST(min({column}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
            high = f"CAST(max({column}) AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
            parts.append(
                f"SELECT '{table}' AS table_name, '{column}' AS column_name, "
                f"'{family}' AS family, count(*) AS n, count(DISTINCT {column}) AS d, "
                f"{patterns} AS p, {low} AS lo, {high} AS hi FROM {table}"
            )
    return (
        "WITH base AS (" + _union(parts) + "), judged AS (SELECT *, "
        "d::DOUBLE / n AS ratio, " + ID_TEST.format("column_name") + " AS is_id, "
        "d::DOUBLE / n > 0.9 AS high FROM base)"
    )


def _gate(select: str) -> str:
    return f"{_judged()} SELECT table_name, column_name, {select} FROM judged"


def _skipped_operations() -> str:
    reason = "'Skipped: High Cardinality (' || printf('%.1f', ratio * 100) || '% unique) or PK.'"
    shape = [
        f"CASE WHEN family = 'NUMERIC' AND (is_id OR high) THEN '\"{stat}\":\"' || {reason} || "
        "'\"' END"
        for stat in ("Skewness", "Kurtosis", "Box Plot")
    ]
    rest = [
        "CASE WHEN family = 'STRING' AND NOT is_id AND d > 1000 THEN '\"Top-K Frequencies\":\""
        "Skipped: Distinct count (' || d || ') > 1000 limit.\"' END",
        "CASE WHEN family = 'STRING' AND NOT is_id AND p > 100 THEN '\"Patterns\":\""
        "Skipped: Distinct patterns (' || p || ') > 100.\"' END",
        "CASE WHEN family = 'NUMERIC' AND is_id AND high THEN '\"Histograms\":\""
        "Skipped: ID Columns do not require histograms.\"' END",
    ]
    return _gate(
        "'{' || concat_ws(',', " + ", ".join(shape + rest) + ") || '}' AS skipped_operations"
    )


# --- samples, shape and distributions ---------------------------------------------------------

HASH = "CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT)"
SAMPLED = (
    f"{HASH} < (SELECT CASE WHEN count(*) <= 1000 THEN 4294967296 ELSE "
    "CAST(floor((1000::DOUBLE / count(*)) * 4294967296) AS BIGINT) END FROM orders)"
)


def _shape(select: str) -> str:
    return _union(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, {select.format(c)} FROM "
            f"(SELECT {c}, avg({c}) OVER () AS m FROM {t})"
            for t in ("lineitem", "events")
            for c in _columns(t, "NUMERIC")
            if not c.endswith("_id")
        ]
    )


SKEW = "avg(pow({0} - m, 3)) / pow(avg(pow({0} - m, 2)), 1.5)"
KURT = "avg(pow({0} - m, 4)) / pow(avg(pow({0} - m, 2)), 2) - 3"


def _counts(sources: list[tuple[str, str, str]], name: str) -> str:
    """Counts of (column, expression, table)."""
    return _union(
        [
            f"SELECT '{column}' AS column_name, {expression} AS {name}, count(*) AS \"count\" "
            f"FROM {table} WHERE {expression} IS NOT NULL GROUP BY {expression}"
            for column, expression, table in sources
        ]
    )


def _top(counts: str, name: str, k: int = 10) -> str:
    return (
        f'SELECT column_name, {name}, "count" FROM (SELECT *, row_number() OVER (PARTITION BY '
        f'column_name ORDER BY "count" DESC, {name}) AS r FROM ({counts})) WHERE r <= {k}'
    )


ORDER_STATUS = ("o_orderstatus", "nullif(o_orderstatus, 'F')", "orders")
ORDER_PRIORITY = ("o_orderpriority", "o_orderpriority", "orders")
PART_TEXTS = [(c, c, "part") for c in ("p_name", "p_brand", "p_type")]


def _patterned(sources: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return [(c, _pattern(e), t) for c, e, t in sources]


def _bucket(column: str, bins: int) -> str:
    return (
        f"CAST(floor({bins}::DOUBLE * (CAST({column} AS DOUBLE) - lo) / (hi - lo)) AS BIGINT) + 1"
    )


def _histogram(table: str, column: str, bins: int, where: str = "true", factor: str = "1") -> str:
    return (
        f"SELECT '{column}' AS column_name, {_bucket(column, bins)} AS bucket, "
        f'CAST(floor(count(*) * {factor}) AS BIGINT) AS "count" FROM {table}, '
        f"(SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi "
        f"FROM {table}) WHERE {where} GROUP BY 2"
    )


def _mega() -> str:
    texts = [(c, c, "lineitem") for c in ("l_returnflag", "l_linestatus")]
    numbers = _columns("lineitem", "NUMERIC")
    buckets = [_histogram("lineitem", c, 20) for c in numbers]
    return _union(
        [
            f"SELECT 'freq' AS kind, * FROM ({_top(_counts(texts, 'value'), 'value')})",
            f"SELECT 'pattern' AS kind, * FROM "
            f"({_top(_counts(_patterned(texts), 'value'), 'value')})",
            "SELECT 'hist' AS kind, column_name, CAST(bucket AS VARCHAR) AS value, \"count\" FROM ("
            + _union(buckets)
            + ")",
        ]
    )


# --- stored and derived metrics ---------------------------------------------------------------

MEASURED = [
    ("l_orderkey", "l_orderkey", "lineitem"),
    ("l_quantity", "nullif(l_quantity, 1.0)", "lineitem"),
    ("l_extendedprice", "l_extendedprice", "lineitem"),
    ("l_discount", "l_discount", "lineitem"),
    ("l_tax", "l_tax", "lineitem"),
    ("value", "CASE WHEN value >= 5 THEN value END", "events"),
    ("n_nationkey", "n_nationkey", "nation"),
    ("r_regionkey", "r_regionkey", "region"),
]


def _power_sums() -> str:
    """Sums in whole hundredths, then the decimal point put in its place."""
    parts = []
    for column, expression, table in MEASURED:
        unit = f"CAST(round(({expression}) * 100) AS HUGEINT)"
        sums = []
        for k in range(1, 5):
            text = f"CAST(sum({' * '.join([unit] * k)}) AS VARCHAR)"
            digits = f"lpad({text}, greatest(length({text}), {2 * k + 1})::INTEGER, '0')"
            sums.append(
                f"left({digits}, length({digits}) - {2 * k}) || '.' || right({digits}, {2 * k}) "
                f"AS sum_x{k if k > 1 else ''}"
            )
        parts.append(f"SELECT '{column}' AS column_name, {', '.join(sums)} FROM {table}")
    parts.append(_long_sums("price_eighth", "CAST(round(l_extendedprice * 100) AS HUGEINT) * 125", 5))
    parts.append(_long_sums("long_key", "CAST(l_orderkey AS HUGEINT) * 1000000", 0))
    return _union(parts)


def _long_sums(name: str, units: str, decimals: int) -> str:
    """Sums of powers of lineitem's numbers from 0 that no HUGEINT holds, in steps of six digits.

    With units = a * 10**6 + b the sum of a k-th power is that of binomials; carries go from one
    step to the next, and the steps' digits make the text.
    """
    texts = []
    for k in range(1, 5):
        step = "0"
        digits = ""
        for j in range(k + 1):
            binomial = f"sum({' * '.join([str(comb(k, j))] + ['a'] * j + ['b'] * (k - j))})"
            step = f"({binomial} + {step} // 1000000)" if j else binomial
            place = f"lpad(CAST({step} % 1000000 AS VARCHAR), 6, '0')" if j < k else f"CAST({step} AS VARCHAR)"
            digits = f"{place} || {digits}" if digits else place
        places, least = k * decimals, 2 * k
        text = f"coalesce(nullif(ltrim({digits}, '0'), ''), '0')"
        whole = f"left({text}, length({text}) - {places})"
        part = f"rtrim(right({text}, {places}), '0')" if places else "''"
        texts.append(
            f"{whole} || '.' || rpad({part}, greatest(length({part}), {least})::INTEGER, '0') AS sum_x{k if k > 1 else ''}"
        )
    return (
        f"SELECT '{name}' AS column_name, {', '.join(texts)} FROM "
        f"(SELECT u // 1000000 AS a, u % 1000000 AS b FROM (SELECT {units} AS u FROM lineitem))"
    )


def _metrics() -> str:
    parts = []
    for column, expression, table in MEASURED:
        skew, kurt = SKEW.format("x"), KURT.format("x")
        parts.append(
            f"SELECT '{column}' AS column_name, count(*) AS total_count, "
            "count(*) - count(x) AS null_count, count(x) AS valid_count, avg(x) AS mean_val, "
            f"stddev_samp(x) AS stddev_val, {skew} AS skewness_derived, "
            f"{kurt} AS kurtosis_derived FROM (SELECT x, avg(x) OVER () AS m FROM "
            f"(SELECT ({expression})::DOUBLE AS x FROM {table}))"
        )
    chi2 = ", ".join(f"({df}, {lo}, {hi})" for df, (lo, hi) in enumerate(CHI2_TABLE, start=1))
    return (
        f"WITH chi2(df, lo, hi) AS (VALUES {chi2}), base AS ({_union(parts)}), m AS ("
        "SELECT base.*, round(null_count / total_count, 6) AS null_rate, "
        "round(mean_val - 1.96 * stddev_val / sqrt(valid_count), 4) AS mean_ci_lower, "
        "round(mean_val + 1.96 * stddev_val / sqrt(valid_count), 4) AS mean_ci_upper, "
        "coalesce(hi::DOUBLE, (valid_count - 1) * pow(1 - 2.0::DOUBLE / (9 * (valid_count - 1)) "
        "+ 1.959964::DOUBLE * sqrt(2.0::DOUBLE / (9 * (valid_count - 1))), 3)) AS upper, "
        "coalesce(lo::DOUBLE, (valid_count - 1) * pow(1 - 2.0::DOUBLE / (9 * (valid_count - 1)) "
        "- 1.959964::DOUBLE * sqrt(2.0::DOUBLE / (9 * (valid_count - 1))), 3)) AS lower "
        "FROM base LEFT JOIN chi2 ON df = valid_count - 1)"
    )


STDDEV_CI = (
    "round(stddev_val * sqrt((valid_count - 1) / upper), 4) AS stddev_ci_lower, "
    "round(stddev_val * sqrt((valid_count - 1) / lower), 4) AS stddev_ci_upper"
)
DERIVED_SHAPE = (
    "round(skewness_derived, 6) AS skewness_derived, "
    "round(kurtosis_derived, 6) AS kurtosis_derived"
)


def _from_metrics(select: str) -> str:
    return f"{_metrics()} SELECT column_name, {select} FROM m"


# --- catalog and discovery --------------------------------------------------------------------


def _catalog_ctes(tags: bool = False) -> str:
    counts = _union([f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in SCHEMA])
    columns = ", ".join(
        f"('{t}', '{c}', '{kind}', '{family}')"
        for t, fields in SCHEMA.items()
        for c, kind, family in fields
    )
    text = (
        f"counts AS ({counts}), cols(table_name, column_name, data_type, type_family) AS "
        f"(VALUES {columns}), catalog AS (SELECT * FROM cols JOIN counts USING (table_name))"
    )
    if not tags:
        return text
    tagged = []
    for table, fields in SCHEMA.items():
        for column, _, family in fields:
            tag = "'NONE'"
            if family == "STRING":
                cases = " ".join(
                    f"WHEN count(*) FILTER (regexp_matches({column}, '{pattern}')) >= "
                    f"0.8 * count({column}) THEN '{name}'"
                    for name, pattern in SEMANTIC_PATTERNS
                )
                tag = f"CASE WHEN count({column}) = 0 THEN 'NONE' {cases} ELSE 'NONE' END"
            tagged.append(
                f"SELECT '{table}' AS table_name, '{column}' AS column_name, "
                f"count({column}) AS valid_count, {tag} AS semantic_tag FROM {table}"
            )
    return text + f", tags AS ({_union(tagged)})"


def _catalog(select: str, where: str = "true") -> str:
    return f"WITH {_catalog_ctes()} SELECT {select} FROM catalog WHERE {where}"


def _pair_ctes(name: str = "column_name", strict: bool = True) -> str:
    agree = "a.type_family = b.type_family AND a.semantic_tag = b.semantic_tag AND"
    return (
        f"WITH {_catalog_ctes(tags=True)}, named AS (SELECT catalog.*, semantic_tag, "
        f"{name} AS shown FROM catalog JOIN tags USING (table_name, column_name)), "
        "pairs AS (SELECT a.table_name AS left_table, a.column_name AS left_column, "
        "b.table_name AS right_table, b.column_name AS right_column, a.n AS left_rows, "
        "b.n AS right_rows, a.type_family, 100 * (1 - levenshtein(a.shown, b.shown)::DOUBLE / "
        "greatest(length(a.shown), length(b.shown))) AS similarity "
        f"FROM named a JOIN named b ON {agree if strict else ''} "
        "a.table_name < b.table_name)"
    )


PAIR_REPORT = (
    "SELECT left_table, left_column, right_table, right_column, left_rows, right_rows, "
    "round(similarity, 4) AS name_similarity FROM pairs WHERE similarity > {0}"
)
SYNONYM_NAME = (
    "array_to_string(list_transform(string_split(column_name, '_'), "
    "lambda t: CASE t WHEN 'conv' THEN 'doc' WHEN 'item' THEN 'page' ELSE t END), '_')"
)


def _overlap_ctes(passed: str = "SELECT * FROM pairs WHERE similarity > 85") -> str:
    values = []
    for table, fields in SCHEMA.items():
        for column, _, family in fields:
            text = f"CAST({column} AS DOUBLE)" if family == "NUMERIC" else column
            values.append(
                f"SELECT DISTINCT '{table}' AS t, '{column}' AS c, CAST({text} AS VARCHAR) AS v "
                f"FROM {table} WHERE {column} IS NOT NULL"
            )
    return (
        f"{_pair_ctes()}, vals AS ({_union(values)}), "
        "distincts AS (SELECT t, c, count(*) AS d FROM vals GROUP BY t, c), "
        f"passed AS ({passed}), "
        "shared AS (SELECT left_table, left_column, right_table, right_column, count(*) AS s "
        "FROM passed JOIN vals l ON l.t = left_table AND l.c = left_column "
        "JOIN vals r ON r.t = right_table AND r.c = right_column AND r.v = l.v GROUP BY ALL), "
        "sized AS (SELECT passed.*, l.d AS left_d, r.d AS right_d, coalesce(s, 0) AS s, "
        "100 * coalesce(s, 0)::DOUBLE / l.d AS left_pct, "
        "100 * coalesce(s, 0)::DOUBLE / r.d AS right_pct FROM passed "
        "JOIN distincts l ON l.t = left_table AND l.c = left_column "
        "JOIN distincts r ON r.t = right_table AND r.c = right_column "
        "LEFT JOIN shared USING (left_table, left_column, right_table, right_column)), "
        "turned AS (SELECT *, CASE WHEN left_pct <> right_pct THEN left_pct > right_pct "
        "WHEN (right_d = right_rows) <> (left_d = left_rows) THEN right_d = right_rows "
        "ELSE right_d > left_d END AS left_is_child FROM sized), "
        "directed AS (SELECT "
        "CASE WHEN left_is_child THEN left_table ELSE right_table END AS child_table, "
        "CASE WHEN left_is_child THEN left_column ELSE right_column END AS child_column, "
        "CASE WHEN left_is_child THEN right_table ELSE left_table END AS parent_table, "
        "CASE WHEN left_is_child THEN right_column ELSE left_column END AS parent_column, "
        "CASE WHEN left_is_child THEN left_d ELSE right_d END AS child_distinct, "
        "CASE WHEN left_is_child THEN right_d ELSE left_d END AS parent_distinct, "
        "s AS shared_distinct, "
        "CASE WHEN left_is_child THEN left_pct ELSE right_pct END AS overlap_pct, similarity "
        "FROM turned)"
    )


def _edge_ctes() -> str:
    declared = (
        "('main.orders', 'o_custkey', 'main.customer', 'c_custkey'), "
        "('main.lineitem', 'l_orderkey', 'main.orders', 'o_orderkey')"
    )
    return (
        f"{_overlap_ctes()}, declared(source_node, source_col, target_node, target_col) AS "
        f"(VALUES {declared}), found AS (SELECT 'main.' || child_table AS source_node, "
        "child_column AS source_col, 'main.' || parent_table AS target_node, "
        "parent_column AS target_col, CAST(floor(CASE WHEN shared_distinct > 0 AND overlap_pct >= 5 THEN overlap_pct "
        "ELSE similarity END) AS INTEGER) AS score, CASE WHEN shared_distinct > 0 AND overlap_pct >= 5 THEN "
        "'Data Domain Overlap' ELSE 'Fuzzy Name Match' END AS heuristic, "
        "'suggested' AS status, child_distinct, parent_distinct, shared_distinct FROM directed), "
        "merged AS (SELECT source_node, source_col, target_node, target_col, score, heuristic, "
        "status FROM found WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE "
        "(d.source_node, d.source_col, d.target_node, d.target_col) IN "
        "((found.source_node, found.source_col, found.target_node, found.target_col), "
        "(found.target_node, found.target_col, found.source_node, found.source_col))) "
        "UNION ALL SELECT *, 100, 'System Foreign Key', 'enforced' FROM declared), "
        "edges AS (SELECT source_node || '.' || source_col || '->' || target_node || '.' || "
        "target_col AS id, * FROM merged), "
        "decided AS (SELECT * REPLACE (CASE WHEN status = 'enforced' THEN status "
        "WHEN heuristic = 'Fuzzy Name Match' THEN 'rejected' "
        "WHEN source_col LIKE '%nationkey' THEN 'suggested' "
        "WHEN score >= 100 THEN 'verified' ELSE status END AS status) FROM edges)"
    )


BAND = (
    "CASE WHEN status IN ('enforced', 'verified') THEN status WHEN score < 80 THEN 'amber' "
    "ELSE 'blue' END AS band"
)


def _declared_fk_edges() -> str:
    return (
        "SELECT 'main.orders.o_custkey->main.customer.c_custkey' AS id, 100 AS score, "
        "'System Foreign Key' AS heuristic, 'enforced' AS status, "
        "(SELECT count(*) FROM orders) AS source_rows, "
        "(SELECT count(*) FROM customer) AS target_rows UNION ALL "
        "SELECT 'main.lineitem.l_orderkey->main.orders.o_orderkey', 100, 'System Foreign Key', "
        "'enforced', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM orders)"
    )


def _edges_with_nodes() -> str:
    source, target = (_label(f"{x}.n") for x in ("s", "t"))
    return (
        f"{_edge_ctes()} SELECT id, s.table_name AS source_table, s.n AS source_rows, "
        f"{source} AS source_row_label, t.table_name AS target_table, t.n AS target_rows, "
        f"{target} AS target_row_label FROM edges "
        "JOIN counts s ON 'main.' || s.table_name = source_node "
        "JOIN counts t ON 'main.' || t.table_name = target_node"
    )


# --- key-value log ----------------------------------------------------------------------------

KV = (
    "WITH last AS (SELECT user_id AS key, event_type, ts FROM events QUALIFY row_number() OVER "
    "(PARTITION BY user_id ORDER BY event_id DESC) = 1), state AS (SELECT key, "
    "event_type AS value, ts + INTERVAL 86400 SECOND AS expiry FROM last "
    "WHERE event_type <> 'error'), live AS (SELECT * FROM state "
    "WHERE expiry >= TIMESTAMP '2024-01-31 00:00:00')"
)

ORACLES: dict[str, str] = {
    "profile_base": _profile_base(),
    "profile_metrics": _profile_metrics(),
    "stat_templates": _stat_templates(),
    "exact_distinct": _exact_distinct(),
    "approx_distinct": _approx_distinct(),
    "pattern_cardinality": _pattern_cardinality(),
    "char_pattern": (
        f"SELECT page_id, {_pattern('url')} AS url_pattern, {_pattern('html')} AS html_pattern "
        "FROM pages"
    ),
    "shape_gate": _gate(
        "round(ratio, 6) AS uniqueness_ratio, is_id, high AS is_high_cardinality, "
        "family = 'NUMERIC' AND NOT is_id AND NOT high AS shape_ok"
    ),
    "topk_gate": _gate(
        "d AS distinct_count, family = 'STRING' AND NOT is_id AND d <= 1000 AS topk_ok"
    ),
    "pattern_gate": _gate(
        "p AS pattern_distinct_count, family = 'STRING' AND NOT is_id AND p <= 100 AS pattern_ok"
    ),
    "hist_gate": _gate(
        "lo AS min_number, hi AS max_number, "
        "family = 'NUMERIC' AND NOT (is_id AND high) AND lo <> hi AS hist_ok"
    ),
    "skipped_operations": _skipped_operations(),
    "sampled_scan": f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {SAMPLED}",
    "micro_sample": (
        f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {HASH}, o_orderkey LIMIT 2000"
    ),
    "shape_stats": _shape(
        f"round({SKEW}, 6) AS skewness_val, round({KURT}, 6) AS kurtosis_val"
    ),
    "box_plot": _shape(
        "round(CAST(min({0}) AS DOUBLE), 6) AS low, "
        "round(quantile_cont({0}::DOUBLE, 0.25), 6) AS q1, "
        "round(quantile_cont({0}::DOUBLE, 0.5), 6) AS median, "
        "round(quantile_cont({0}::DOUBLE, 0.75), 6) AS q3, "
        "round(CAST(max({0}) AS DOUBLE), 6) AS high"
    ),
    "top_k_freq": _top(_counts([ORDER_STATUS, ORDER_PRIORITY, *PART_TEXTS], "value"), "value"),
    "top_k_pattern": _top(
        _counts(_patterned([ORDER_STATUS, ORDER_PRIORITY, *PART_TEXTS]), "pattern"), "pattern"
    ),
    "freq_grouping_sets": _counts([ORDER_STATUS, ORDER_PRIORITY], "value"),
    "pattern_grouping_sets": _counts(_patterned(PART_TEXTS), "pattern"),
    "histogram": _union(
        [
            _histogram("orders", "o_totalprice", 20),
            _histogram("orders", "o_custkey", 20),
            _histogram("lineitem", "l_quantity", 20),
            _histogram("lineitem", "l_discount", 20),
            _histogram("lineitem", "l_orderkey", 20),
        ]
    ),
    "histogram_extrapolated": _histogram(
        "orders",
        "o_totalprice",
        10,
        SAMPLED,
        "(SELECT greatest(count(*)::DOUBLE / 1000, 1) FROM orders)",
    ),
    "mega_profile": _mega(),
    "power_sums": _power_sums(),
    "metrics_base": _from_metrics(
        "total_count, null_count, valid_count, round(mean_val, 4) AS mean_val, "
        "round(stddev_val, 4) AS stddev_val"
    ),
    "metrics_evolved": _from_metrics(
        "total_count, valid_count, CAST(NULL AS VARCHAR) AS sum_x, "
        "CAST(NULL AS VARCHAR) AS sum_x2, CAST(NULL AS VARCHAR) AS sum_x3, "
        "CAST(NULL AS VARCHAR) AS sum_x4, CAST(NULL AS VARCHAR) AS skewness, "
        "CAST(NULL AS VARCHAR) AS kurtosis"
    ),
    "null_rate": _from_metrics("null_rate"),
    "mean_ci": _from_metrics("mean_ci_lower, mean_ci_upper"),
    "stddev_ci": _from_metrics(STDDEV_CI),
    "derived_shape": _from_metrics(DERIVED_SHAPE),
    "merged_metrics": _from_metrics(DERIVED_SHAPE),
    "derived_shape_raw": _from_metrics(DERIVED_SHAPE),
    "derived_view": _from_metrics(
        "total_count, valid_count, null_rate, mean_ci_lower, mean_ci_upper, "
        f"{STDDEV_CI}, {DERIVED_SHAPE}"
    ),
    "column_catalog": _catalog(
        f"table_name, column_name, data_type, type_family, n AS row_count, {_label('n')} AS row_label"
    ),
    "id_columns": _catalog(
        "table_name, column_name, n AS row_count", ID_TEST.format("column_name")
    ),
    "scoped_catalog": _catalog("table_name, column_name, n AS row_count", "n >= 1000"),
    "excluded_utility": _catalog(
        "table_name, column_name, n AS row_count",
        "NOT regexp_matches(table_name, '^(.*name|lab.*|audit_.*|.*_tmp)$') AND "
        "NOT regexp_matches(column_name, '^(.*name|lab.*|audit_.*|.*_tmp)$')",
    ),
    "semantic_tags": (
        f"WITH {_catalog_ctes(tags=True)} "
        "SELECT table_name, column_name, valid_count, semantic_tag FROM tags"
    ),
    "name_similarity": _pair_ctes(SYNONYM_NAME, strict=False) + " " + PAIR_REPORT.format(60),
    "candidate_pairs": _pair_ctes() + " " + PAIR_REPORT.format(50),
    "name_class_links": (
        f"{_pair_ctes()}, grouped AS (SELECT type_family || '/' || semantic_tag AS grp, table_name, shown AS name FROM named), "
        "classes AS (SELECT grp, name, count(*) AS n FROM grouped GROUP BY ALL), "
        "formed AS (SELECT l.grp, least(l.name, r.name) AS name_a, greatest(l.name, r.name) AS name_b, count(*) AS n_pairs "
        "FROM grouped l JOIN grouped r ON l.grp = r.grp AND l.table_name < r.table_name GROUP BY ALL), "
        "linked AS (SELECT a.grp, a.name AS name_a, b.name AS name_b, a.n AS columns_a, b.n AS columns_b, "
        "100 * (1 - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name))) AS similarity "
        "FROM classes a JOIN classes b ON a.grp = b.grp AND a.name <= b.name) "
        "SELECT grp, name_a, name_b, round(similarity, 4) AS similarity, columns_a, columns_b, "
        "coalesce(n_pairs, 0) AS n_pairs FROM linked LEFT JOIN formed USING (grp, name_a, name_b) WHERE similarity > 50"
    ),
    "cascade_pairs": _pair_ctes() + " " + PAIR_REPORT.format(85),
    "incremental_versions": (
        _pair_ctes() + " " + PAIR_REPORT.format(85) + " AND (left_table = 'customer' OR right_table = 'customer')"
    ),
    "incremental_pairs": (
        _pair_ctes()
        + " "
        + PAIR_REPORT.format(85)
        + " AND NOT (left_table < 'm' AND left_table <> 'customer')"
    ),
    "fk_overlap": (
        f"{_overlap_ctes()} SELECT child_table, child_column, parent_table, parent_column, "
        "child_distinct, parent_distinct, shared_distinct, round(overlap_pct, 4) AS overlap_pct "
        "FROM directed"
    ),
    "overlap_any_name": (
        f"{_overlap_ctes('SELECT * FROM pairs')} SELECT child_table, child_column, parent_table, "
        "parent_column, child_distinct, parent_distinct, shared_distinct, "
        "round(overlap_pct, 4) AS overlap_pct FROM directed WHERE shared_distinct > 0"
    ),
    "overlap_classes": (
        f"{_overlap_ctes()}, grouped AS (SELECT t, c, v, type_family || '/' || semantic_tag AS grp FROM vals "
        "JOIN named ON table_name = t AND column_name = c), "
        "signs AS (SELECT t, c, any_value(grp) AS grp, count(*) AS d, md5(string_agg(v, chr(1) ORDER BY v)) AS sign "
        "FROM grouped GROUP BY t, c), "
        "classes AS (SELECT *, min('main.' || t || '.' || c) OVER (PARTITION BY grp, sign) AS class_id FROM signs), "
        "links AS (SELECT l.t, l.c, count(DISTINCT r.t || '.' || r.c) AS n FROM grouped l JOIN grouped r "
        "ON l.grp = r.grp AND l.v = r.v AND l.t <> r.t GROUP BY l.t, l.c) "
        "SELECT table_name, column_name, coalesce(class_id, 'main.' || table_name || '.' || column_name) AS class_id, "
        "coalesce(d, 0) AS distinct_count, coalesce(links.n, 0) AS n_links FROM named "
        "LEFT JOIN classes ON classes.t = table_name AND classes.c = column_name "
        "LEFT JOIN links ON links.t = table_name AND links.c = column_name"
    ),
    "venn_report": (
        f"{_edge_ctes()} SELECT source_node || '.' || source_col || '->' || target_node || '.' "
        "|| target_col AS id, score, child_distinct, parent_distinct, shared_distinct FROM found "
        "WHERE heuristic = 'Data Domain Overlap'"
    ),
    "declared_fk_edges": _declared_fk_edges(),
    "fk_edges": (
        f"{_edge_ctes()} SELECT id, source_node, source_col, target_node, target_col, score, "
        "heuristic, status FROM edges"
    ),
    "edges_with_nodes": _edges_with_nodes(),
    "edge_bands": f"{_edge_ctes()} SELECT id, score, status, {BAND} FROM decided",
    "triage_state": f"{_edge_ctes()} SELECT id, score, status FROM decided",
    "edge_summary": (
        f"{_edge_ctes()} SELECT status, count(*) AS edges FROM decided GROUP BY status"
    ),
    "kv_state": f"{KV} SELECT key, value, expiry FROM state",
    "kv_removed": f"{KV} SELECT key FROM last WHERE event_type = 'error'",
    "kv_expired": (
        f"{KV} SELECT key, value, expiry FROM state "
        "WHERE expiry < TIMESTAMP '2024-01-31 00:00:00'"
    ),
    "kv_get": (
        f"{KV} SELECT asked.key, value, times FROM (SELECT user_id * 2 AS key, count(*) AS times "
        "FROM events GROUP BY 1) asked LEFT JOIN live USING (key)"
    ),
    "kv_value_index": (
        f"{KV} SELECT value, key // 65536 AS block, string_agg(CAST(key AS VARCHAR), ',' "
        "ORDER BY key) AS keys FROM live GROUP BY 1, 2"
    ),
    "kv_compaction": (
        f"{KV} SELECT key, value, expiry, expiry >= TIMESTAMP '2024-01-31 00:00:00' AS keep "
        "FROM state"
    ),
}
