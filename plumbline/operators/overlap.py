"""Value overlap of column pairs: how many distinct values of one exist in the other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.config import NUMERIC, TEMPORAL, type_family
from plumbline.functions.hashing import bounded_key, trailing_zero_bits
from plumbline.operators.name_match import PAIR_KEY, match_group
from plumbline.sources.templates import quoted

# Columns per long of a membership mask; keeps clear of the sign bit.
WORD_BITS = 62
# What tells values of a group of columns apart; one of the three is set.
VALUE_KEY = ("number", "moment", "text")


def _canonical_number(text: Column) -> Column:
    """One text for every spelling of a number: sign, digits without outer zeros, exponent of ten.

    5, 5.0, 5E0 and 0.005E3 all give '5e1'. Nothing is rounded, whatever the size.
    """
    plain = F.ltrim(text, F.lit("-"))
    mantissa = F.substring_index(plain, "E", 1)
    power = F.coalesce(F.when(F.contains(plain, F.lit("E")), F.substring_index(text, "E", -1).try_cast("int")), F.lit(0))
    whole = F.substring_index(mantissa, ".", 1)
    digits = F.replace(mantissa, F.lit("."))
    led = F.ltrim(digits, F.lit("0"))
    exponent = F.length(whole) - (F.length(digits) - F.length(led)) + power
    sign = F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    number = F.concat(sign, F.rtrim(led, F.lit("0")), F.lit("e"), exponent.cast("string"))
    return F.when(F.rlike(text, F.lit("^-?[0-9]")), F.when(led == "", F.lit("0")).otherwise(number)).otherwise(text)


def canonical_value(column: Column, data_type: T.DataType) -> Column:
    """Text that is equal for equal values of one type family: 5, 5L, 5.0 and 5.00 are one number.

    Floating point numbers count as what their shortest decimal text says.
    """
    if isinstance(data_type, T.NumericType):
        return _canonical_number(column.cast("string"))
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column.cast("timestamp_ntz").cast("string")
    if isinstance(data_type, T.StringType):
        return bounded_key(column)
    return column.cast("string")


def _member_rows(pairs: DataFrame, sample_cap: int | None) -> list[Row]:
    """The columns in play, numbered within their group, with the sampling level they need.

    A column of d distinct values is sampled to the 2**-level share of hash space that leaves at
    most `sample_cap` of them. Both columns of a pair keep the same share, so a sampled child
    value is always met by its parent value. One row per catalog column at most.
    """

    def level(estimate: str) -> Column:
        if sample_cap is None:
            return F.lit(0)
        share = F.col(estimate) / F.lit(sample_cap)
        return F.when(share > 1, F.ceil(F.log2(share))).otherwise(F.lit(0)).cast("int")

    levelled = pairs.withColumns(
        {"left_level": level("left_estimate"), "right_level": level("right_estimate")}
    ).withColumn("floor", F.least("left_level", "right_level"))
    sides = F.array(
        *[
            F.struct(
                F.col(f"{s}_schema").alias("schema_name"),
                F.col(f"{s}_table").alias("table_name"),
                F.col(f"{s}_column").alias("column_name"),
                F.col(f"{s}_level").alias("level"),
            )
            for s in ("left", "right")
        ]
    )
    return (
        levelled.select("grp", "floor", F.inline(sides))
        .groupBy("grp", "schema_name", "table_name", "column_name")
        .agg(F.max("level").alias("level"), F.min("floor").alias("floor"))
        .orderBy("grp", "schema_name", "table_name", "column_name")
        .collect()
    )


def _numbered(members: Sequence[Row]) -> list[dict]:
    groups: dict[str, int] = {}
    sizes: dict[str, int] = {}
    numbered = []
    for row in members:
        group = groups.setdefault(row["grp"], len(groups))
        bit = sizes.get(row["grp"], 0)
        sizes[row["grp"]] = bit + 1
        numbered.append({**row.asDict(), "group_no": group, "bit": bit})
    return numbered


def _number_key(raw: Column, data_type: T.DataType) -> Column:
    """The double that stands for a number, null where only its text tells it from others.

    Doubles below 2**53 in size and their shortest texts tell the same values apart. Whole numbers
    below it are doubles, and so are floats and decimals of up to 15 digits by their texts.
    """
    if isinstance(data_type, T.FloatType):
        number = raw.cast("string").cast("double")
    else:
        number = raw.cast("double")
    exact = F.abs(number) < F.lit(float(2**53))  # NaN is greater than any number
    if isinstance(data_type, T.DecimalType) and data_type.precision > 15:
        exact &= _canonical_number(number.cast("string")) == _canonical_number(raw.cast("string"))
    return F.when(exact, number)


def _stacked_values(tables: Mapping[str, DataFrame], members: Sequence[dict], texts: bool = False) -> DataFrame:
    """(group_no, bit, floor, *VALUE_KEY): a row for each value in play that is not null.

    Columns are stacked by type first, so that one expression serves all of them. Rows of a group
    are equal in VALUE_KEY where `canonical_value` is, but numbers and points in time are only
    turned into text if it takes that to compare them: if `texts`, in a group of several type
    families, and for numbers that no double tells exactly.
    """
    families: dict[int, set[str]] = {}
    for m in members:
        families.setdefault(m["group_no"], set()).add(type_family(tables[m["table_name"]].schema[m["column_name"]].dataType))
    parts = []
    for table in dict.fromkeys(m["table_name"] for m in members):
        df = tables[table]
        by_type: dict[tuple[T.DataType, bool], list[Column]] = {}
        for m in members:
            if m["table_name"] == table:
                entry = F.struct(*[F.lit(m[c]).alias(c) for c in ("group_no", "bit", "floor")], F.col(quoted(m["column_name"])).alias("raw"))
                as_text = texts or len(families[m["group_no"]]) > 1
                by_type.setdefault((df.schema[m["column_name"]].dataType, as_text), []).append(entry)
        for (data_type, as_text), entries in by_type.items():
            rows = df.select(F.inline(F.array(*entries))).where("raw IS NOT NULL")
            raw, text = F.col("raw"), canonical_value(F.col("raw"), data_type)
            number, moment = F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz")
            if not as_text and type_family(data_type) == NUMERIC:
                number = _number_key(raw, data_type)
                text = F.when(number.isNull(), text)
            elif not as_text and type_family(data_type) == TEMPORAL:
                moment, text = raw.cast("timestamp_ntz"), F.lit(None).cast("string")
            parts.append(rows.select("group_no", "bit", "floor", number.alias("number"), moment.alias("moment"), text.alias("text")))
    return reduce(DataFrame.unionByName, parts)


def value_index(tables: Mapping[str, DataFrame], members: Sequence[dict]) -> DataFrame:
    """(group_no, bits, n_values): how many values occur in exactly the columns `bits`, ascending.

    An inverted index from value to the numbers of its columns, for any number of columns: a value
    is a narrow row with one number, equal rows are dropped on the map side, hot values included,
    and lists are as long as the columns that share a value, not as the columns there are.
    """
    once = _stacked_values(tables, members).groupBy("group_no", *VALUE_KEY, "bit").agg(F.lit(1).alias("one"))
    lists = once.groupBy("group_no", *VALUE_KEY).agg(F.sort_array(F.collect_list("bit")).alias("bits"))
    return lists.groupBy("group_no", "bits").agg(F.count(F.lit(1)).alias("n_values"))


@dataclass(frozen=True)
class ColumnClasses:
    """Lazy results of `column_classes`; `release` drops the cached index."""

    classes: DataFrame
    links: DataFrame
    index: DataFrame

    def release(self) -> None:
        self.index.unpersist()


def column_classes(
    tables: Mapping[str, DataFrame],
    catalog: DataFrame,
    strict_types: bool = True,
    domain_clustering: bool = True,
) -> ColumnClasses:
    """Classes of columns that hold the same values, and the links between classes.

    Classes: schema_name, table_name, column_name, class_id, distinct; class_id is the smallest name
    (schema.table.column) in the class. A column without values is a class of its own. Links:
    left_class, right_class, shared, left_distinct, right_distinct, each pair of classes that share
    a value once. Columns count as equal if they stand in the same lists of the
    index, compared by two 64-bit sums of the lists' hashes. Pairs are only formed between classes:
    a thousand copies of a key column are one row here.
    """
    spark = catalog.sparkSession
    grouped = catalog.withColumn("grp", match_group(strict_types, domain_clustering))
    rows = (
        grouped.select("grp", "schema_name", "table_name", "column_name")
        .withColumns({"level": F.lit(0), "floor": F.lit(0)})
        .orderBy("grp", "schema_name", "table_name", "column_name")
        .collect()  # one row per catalog column
    )
    members = _numbered(rows)
    lists = value_index(tables, members).persist()  # one row for each set of columns that share values
    numbers = spark.createDataFrame(members, _NUMBERS_SCHEMA).withColumn("name", F.concat_ws(".", "schema_name", "table_name", "column_name"))
    sums = [F.sum(F.xxhash64(F.lit(salt), "bits").cast("decimal(20,0)")).alias(f"sum{salt}") for salt in (1, 2)]
    signs = lists.select("group_no", "bits", "n_values", F.explode("bits").alias("bit")).groupBy("group_no", "bit").agg(*sums, F.sum("n_values").alias("distinct"))
    signed = numbers.join(signs, ["group_no", "bit"], "left")
    same = Window.partitionBy("group_no", "sum1", "sum2", "distinct")
    empty = F.col("distinct").isNull()
    classes = signed.select(
        "group_no",
        "bit",
        "schema_name",
        "table_name",
        "column_name",
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        F.when(empty, F.col("name")).otherwise(F.min("name").over(same)).alias("class_id"),
        (~empty & (F.col("bit") == F.min("bit").over(same))).alias("leads"),
    )
    led = classes.where("leads")  # one column of each class, which stands for it in the lists
    leaders = led.groupBy("group_no").agg(F.collect_set("bit").alias("leaders"))  # at most the catalog's columns
    some = lists.join(F.broadcast(leaders), "group_no").select("group_no", F.array_intersect("bits", "leaders").alias("bits"), "n_values")
    shared = (
        some.withColumn("left_bit", F.explode("bits"))
        .withColumn("right_bit", F.explode(F.filter("bits", lambda b: b > F.col("left_bit"))))
        .groupBy("group_no", "left_bit", "right_bit")
        .agg(F.sum("n_values").alias("shared"))
    )

    def side(s: str) -> DataFrame:
        return led.select("group_no", F.col("bit").alias(f"{s}_bit"), F.col("class_id").alias(f"{s}_class"), F.col("distinct").alias(f"{s}_distinct"))

    links = shared.join(side("left"), ["group_no", "left_bit"]).join(side("right"), ["group_no", "right_bit"])
    return ColumnClasses(
        classes.select("schema_name", "table_name", "column_name", "class_id", "distinct"),
        links.select("left_class", "right_class", "shared", "left_distinct", "right_distinct"),
        lists,
    )


def class_link_counts(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes with n_links: the columns of other tables that share a value with each column.

    Columns are counted class by class and table by table, never listed in pairs.
    """
    per_table = classes.groupBy("class_id", "schema_name", "table_name").agg(F.count(F.lit(1)).alias("columns"))
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("size"))
    itself = classes.where("distinct > 0").select(F.col("class_id").alias("own"), F.col("class_id").alias("other")).distinct()
    one_way = links.select(F.col("left_class").alias("own"), F.col("right_class").alias("other"))
    met = itself.unionByName(one_way).unionByName(one_way.select(F.col("other").alias("own"), F.col("own").alias("other")))
    reach = met.join(sizes.withColumnRenamed("class_id", "other"), "other").groupBy("own").agg(F.sum("size").alias("reached"))
    near = (
        met.join(per_table.withColumnRenamed("class_id", "other"), "other")
        .groupBy(F.col("own").alias("class_id"), "schema_name", "table_name")
        .agg(F.sum("columns").alias("at_home"))
    )
    counted = classes.join(reach.withColumnRenamed("own", "class_id"), "class_id", "left").join(near, ["class_id", "schema_name", "table_name"], "left")
    n_links = F.coalesce(F.col("reached") - F.col("at_home"), F.lit(0))
    return counted.select(*classes.columns, n_links.alias("n_links"))


def column_sets(
    tables: Mapping[str, DataFrame], members: Sequence[dict], sampled: bool
) -> DataFrame:
    """(group_no, words, level, n_values): how many values occur in exactly which columns.

    Each table is scanned once and only for its columns in play. A value becomes one narrow row
    with a bit for its column; OR-ing the bits per value dedupes on the map side, hot values
    included, and shuffles every distinct value of a column once. No pair is formed here.
    """
    word_names = [f"w{w}" for w in range(max(m["bit"] for m in members) // WORD_BITS + 1)]
    values = _stacked_values(tables, members, texts=sampled)  # a value's level is that of its text
    level = F.lit(0)
    if sampled:
        level = trailing_zero_bits(F.xxhash64("text")).cast("int")
        values = values.where(level >= F.col("floor"))
    flag = F.expr(f"shiftleft(1L, bit % {WORD_BITS})")
    masks = [F.when(F.floor(F.col("bit") / WORD_BITS) == w, flag).otherwise(F.lit(0)).cast("long").alias(name) for w, name in enumerate(word_names)]
    values = values.select("group_no", *VALUE_KEY, *masks)
    per_value = values.groupBy("group_no", *VALUE_KEY).agg(
        *[F.bit_or(w).alias(w) for w in word_names]
    )
    return (
        per_value.groupBy("group_no", *word_names, level.alias("level"))
        .agg(F.count(F.lit(1)).alias("n_values"))
        .select("group_no", F.array(*word_names).alias("words"), "level", "n_values")
    )


def _has_bit(bit: str) -> Column:
    return F.expr(
        f"shiftright(element_at(words, cast({bit} div {WORD_BITS} as int) + 1), "
        f"cast({bit} % {WORD_BITS} as int)) & 1 = 1"
    )


def _present(top_bit: int) -> Column:
    """The bits set in `words`, ascending."""
    return F.expr(
        f"filter(sequence(0, {top_bit}), b -> shiftright(element_at(words, "
        f"cast(b div {WORD_BITS} as int) + 1), cast(b % {WORD_BITS} as int)) & 1 = 1)"
    )


_NUMBERS_SCHEMA = (
    "grp string, schema_name string, table_name string, column_name string, level int, "
    "floor int, group_no int, bit int"
)


def shared_value_pairs(
    tables: Mapping[str, DataFrame],
    catalog: DataFrame,
    strict_types: bool = True,
    domain_clustering: bool = True,
) -> DataFrame:
    """Pairs of columns of different tables that share values, whatever their names.

    The costly scan: every column of the catalog takes part. Pairs are read off the few
    distinct column sets that the values fall into, never formed per value. The result has the
    layout of `value_overlap`.
    """
    spark = catalog.sparkSession
    grouped = catalog.withColumn("grp", match_group(strict_types, domain_clustering))
    rows = (
        grouped.select("grp", "schema_name", "table_name", "column_name")
        .withColumns({"level": F.lit(0), "floor": F.lit(0)})
        .orderBy("grp", "schema_name", "table_name", "column_name")
        .collect()  # one row per catalog column
    )
    members = _numbered(rows)
    sets = column_sets(tables, members, sampled=False)
    # Every set has a column. Outer explodes keep Spark from testing that on each value, before sets are counted.
    present = sets.withColumn("bits", _present(max(m["bit"] for m in members)))
    numbers = spark.createDataFrame(members, _NUMBERS_SCHEMA).join(
        catalog.select("schema_name", "table_name", "column_name", "row_count"),
        ["schema_name", "table_name", "column_name"],
    )
    distinct = (
        present.select("group_no", F.explode_outer("bits").alias("bit"), "n_values")
        .groupBy("group_no", "bit")
        .agg(F.sum("n_values").alias("distinct"))
    )
    shared = (
        present.withColumn("left_bit", F.explode_outer("bits"))
        .withColumn("right_bit", F.explode(F.expr("filter(bits, b -> b > left_bit)")))
        .groupBy("group_no", "left_bit", "right_bit")
        .agg(F.sum("n_values").alias("shared"))
    )

    def side(s: str) -> DataFrame:
        return numbers.join(distinct, ["group_no", "bit"]).select(
            "group_no",
            F.col("bit").alias(f"{s}_bit"),
            F.col("schema_name").alias(f"{s}_schema"),
            F.col("table_name").alias(f"{s}_table"),
            F.col("column_name").alias(f"{s}_column"),
            F.col("row_count").alias(f"{s}_rows"),
            F.col("distinct").alias(f"{s}_distinct"),
        )

    return (
        shared.join(side("left"), ["group_no", "left_bit"])
        .join(side("right"), ["group_no", "right_bit"])
        .where(
            F.struct("left_schema", "left_table") != F.struct("right_schema", "right_table")
        )
        .withColumns(
            {
                "left_shared": F.col("shared"),
                "right_shared": F.col("shared"),
                "name_similarity": F.lit(None).cast("double"),  # names play no part
            }
        )
        .drop("shared", "group_no", "left_bit", "right_bit")
    )


def value_overlap(
    tables: Mapping[str, DataFrame], pairs: DataFrame, sample_cap: int | None = None
) -> DataFrame:
    """Each pair with distinct counts of both sides and the values they share.

    One job for all pairs. With `sample_cap`, each child side is judged on at most about that
    many of its values, drawn by hash; counts are then brought back to full scale.
    """
    spark = pairs.sparkSession
    members = _numbered(_member_rows(pairs, sample_cap))
    counted = ("left_distinct", "right_distinct", "left_shared", "right_shared")
    if not members:
        return pairs.withColumns({c: F.lit(0).cast("long") for c in counted}).limit(0)
    sets = column_sets(tables, members, sample_cap is not None)
    present = _present(max(m["bit"] for m in members))
    by_column = sets.withColumn("probe", F.explode_outer(present))  # outer for the reason in shared_value_pairs

    numbers = spark.createDataFrame(members, _NUMBERS_SCHEMA)

    def numbered_side(s: str) -> DataFrame:
        return numbers.select(
            "grp",
            F.col("schema_name").alias(f"{s}_schema"),
            F.col("table_name").alias(f"{s}_table"),
            F.col("column_name").alias(f"{s}_column"),
            F.col("bit").alias(f"{s}_bit"),
            F.col("level").alias(f"{s}_level"),
            *([F.col("group_no")] if s == "left" else []),
        )

    known = pairs.join(
        numbered_side("left"), ["grp", "left_schema", "left_table", "left_column"]
    ).join(numbered_side("right"), ["grp", "right_schema", "right_table", "right_column"])
    probes = known.select(
        *PAIR_KEY,
        "group_no",
        "left_level",
        "right_level",
        F.explode(
            F.array(
                F.struct(
                    F.col("left_bit").alias("probe"),
                    F.col("right_bit").alias("other"),
                    F.col("left_level").alias("needed"),
                    F.lit(True).alias("is_left"),
                ),
                F.struct(
                    F.col("right_bit").alias("probe"),
                    F.col("left_bit").alias("other"),
                    F.col("right_level").alias("needed"),
                    F.lit(False).alias("is_left"),
                ),
            )
        ).alias("p"),
    ).select(*PAIR_KEY, "group_no", "left_level", "right_level", "p.*")

    scale = F.pow(F.lit(2), F.col("needed")).cast("long")
    n = F.when(F.col("level") >= F.col("needed"), F.col("n_values") * scale)
    left, both = F.col("is_left"), F.col("other_present")
    totals = (
        probes.join(by_column, ["group_no", "probe"])
        .withColumn("other_present", _has_bit("other"))
        .groupBy(*PAIR_KEY)
        .agg(
            F.sum(F.when(left, n)).alias("left_distinct"),
            F.sum(F.when(~left, n)).alias("right_distinct"),
            F.sum(F.when(left & both, n)).alias("left_shared"),
            F.sum(F.when(~left & both, n)).alias("right_shared"),
        )
    )
    return pairs.join(totals, list(PAIR_KEY), "left").fillna(0, list(counted))


def with_direction(overlaps: DataFrame, sample_cap: int | None = None) -> DataFrame:
    """Name child and parent of each pair and give the overlap percentage of the child.

    The child is the side with the larger share of its values in the other. Ties go to the
    parent whose values are unique, then to the one with more distinct values, then by name.
    Distinct counts scaled up from a sample count as unique within their sampling error.
    """
    slack = 0.0 if sample_cap is None else min(0.5, 5 / sample_cap**0.5)

    def share(shared: str, distinct: str) -> Column:
        return F.when(F.col(distinct) > 0, 100 * F.col(shared) / F.col(distinct)).otherwise(0.0)

    shares = overlaps.withColumns(
        {
            "left_pct": share("left_shared", "left_distinct"),
            "right_pct": share("right_shared", "right_distinct"),
        }
    )

    def unique(side: str) -> Column:
        rows = F.col(f"{side}_rows")
        return (F.col(f"{side}_distinct") >= rows * (1 - slack)).cast("int")

    def parenthood(side: str, child: str) -> Column:
        """Sorts the better parent last; its child is the other side."""
        return F.struct(F.col(f"{child}_pct"), unique(side), F.col(f"{side}_distinct"))

    left_is_child = parenthood("right", "left") > parenthood("left", "right")

    def pick(suffix: str, child: bool) -> Column:
        first, second = ("left", "right") if child else ("right", "left")
        return F.when(left_is_child, F.col(f"{first}_{suffix}")).otherwise(
            F.col(f"{second}_{suffix}")
        )

    named = {}
    for role, is_child in (("child", True), ("parent", False)):
        for suffix in ("schema", "table", "column", "rows", "distinct"):
            named[f"{role}_{suffix}"] = pick(suffix, is_child)
    named["shared_distinct"] = pick("shared", True)
    named["overlap_pct"] = pick("pct", True)
    return shares.select(
        *[expression.alias(name) for name, expression in named.items()], "name_similarity"
    )
