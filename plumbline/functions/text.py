"""Text shapes, names and labels."""

from __future__ import annotations

import re
import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings and whole names that mark an identifier column.
ID_SUFFIXES = ("_id", "_sk", "_key", "uuid")
ID_NAMES = ("id", "pk")

# Globs of tables and columns left out of discovery.
UTILITY_GLOBS = ("*_tmp", "*_bak", "audit_*", "sys_*")

# Semantic tags in order of precedence, each with the pattern of its values.
SEMANTIC_PATTERNS = (
    ("UUID", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
    ("EMAIL", r"^[^@ ]+@[^@ ]+[.][^@ ]+$"),
    ("URL", r"^https?://"),
    ("DATE", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("JSON", r"(?s)^[{].*[}]\s*$"),
)
SEMANTIC_SHARE = 0.8

# What each pattern implies and bytes can tell, so that long texts are not decoded in vain.
SEMANTIC_GUARDS = {
    "UUID": "octet_length({0}) = 36",
    "EMAIL": "contains({0}, '@')",
    "URL": "startswith({0}, 'http')",
    "DATE": "substr({0}, 5, 1) = '-'",
    "JSON": "startswith({0}, '{{')",
}


def char_pattern_sql(value: str) -> str:
    """`char_pattern` as SQL text."""
    letters, digits = string.ascii_letters, string.digits
    shapes = "A" * len(letters) + "N" * len(digits)
    return f"translate({value}, '{letters}{digits}', '{shapes}')"


def char_pattern(value: Column) -> Column:
    """Every ASCII letter becomes A, every ASCII digit N; all else stays.

    A character map gives what two regular expressions would, at about half the cost.
    """
    letters, digits = string.ascii_letters, string.digits
    return F.translate(value, letters + digits, "A" * len(letters) + "N" * len(digits))


def is_id_name(name: Column) -> Column:
    """True where a column name marks an identifier."""
    lowered = F.lower(name)
    by_suffix = lowered.rlike("(" + "|".join(ID_SUFFIXES) + ")$")
    return by_suffix | lowered.isin(*ID_NAMES)


def is_id_literal(name: str) -> bool:
    """The same rule for a name known while the plan is built."""
    lowered = name.lower()
    return lowered.endswith(ID_SUFFIXES) or lowered in ID_NAMES


def _glob_pattern(globs: str | Sequence[str]) -> str:
    """Pattern of lower-case names that match a glob of a list or a comma separated text; '' for none."""
    parts = globs.split(",") if isinstance(globs, str) else globs
    bodies = [
        re.escape(g.strip().lower()).replace(r"\*", ".*").replace(r"\?", ".")
        for g in parts
        if g.strip()
    ]
    return "^(" + "|".join(bodies) + ")$" if bodies else ""


def matches_any_glob(name: Column, globs: str | Sequence[str]) -> Column:
    """True where the name matches one of the globs."""
    pattern = _glob_pattern(globs)
    return F.lower(name).rlike(pattern) if pattern else F.lit(False)


def name_matches_glob(name: str, globs: str | Sequence[str]) -> bool:
    """The same for a name known while the plan is built."""
    pattern = _glob_pattern(globs)
    return bool(pattern) and re.match(pattern, name.lower()) is not None


def semantic_test_sql(tag: str, value: str) -> str:
    """SQL text that is true where a value looks like the tag."""
    pattern = dict(SEMANTIC_PATTERNS)[tag]
    return f"({SEMANTIC_GUARDS[tag].format(value)} AND {value} RLIKE '{pattern}')"


def name_aliases(column: Column, table: Column) -> Column:
    """Names a column answers to: its own, and `order_id` for a bare `id` in table `orders`."""
    lowered = F.lower(column)
    owner = F.regexp_replace(F.lower(table), "s$", "")
    return F.when(
        lowered == "id", F.array(lowered, F.concat(owner, F.lit("_id")))
    ).otherwise(F.array(lowered))


def canonical_name(name: Column, synonyms: Mapping[str, str] | None) -> Column:
    """Replace each underscore-separated token by its canonical synonym."""
    if not synonyms:
        return name
    pairs = [F.lit(x.lower()) for item in synonyms.items() for x in item]
    lookup = F.create_map(*pairs)
    tokens = F.transform(F.split(name, "_"), lambda t: F.coalesce(lookup[t], t))
    return F.array_join(tokens, "_")


def name_similarity(a: Column, b: Column) -> Column:
    """Percent similarity: 100 * (1 - edit distance / longer length)."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(100.0)).otherwise(
        100.0 * (1.0 - F.levenshtein(a, b) / longer)
    )


def short_count(n: Column) -> Column:
    """1234567 -> 1.2M, 450000 -> 450k, 999 -> 999."""

    def scaled(unit: int, suffix: str) -> Column:
        tenths = F.floor(n * 10 / unit)
        text = F.regexp_replace(F.format_string("%.1f", tenths / F.lit(10.0)), "[.]0$", "")
        return F.concat(text, F.lit(suffix))

    return (
        F.when(n >= 1_000_000, scaled(1_000_000, "M"))
        .when(n >= 1_000, scaled(1_000, "k"))
        .otherwise(n.cast("string"))
    )
