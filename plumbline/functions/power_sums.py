"""Exact power sums of any finite numbers, by limbs of mantissas.

A value is a whole mantissa times a power of ten. Mantissas are cut into limbs whose products fit
64 bits; numpy sums the products of a block, and the totals go on as whole numbers of any size, per
column and number of decimals. All that leaves a task is a row for each of these.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa

from plumbline.functions.shipping import ship_by_value

POWERS = (1, 2, 3, 4)
#: Bits of a limb; three hold a long.
BITS, LIMBS = 21, 3
#: Values whose products are summed at once: the largest place stays under 2**51, a sum under 2**63.
BLOCK = 4096
#: Decimals that are tried on floats by arithmetic.
TRIED_DECIMALS = (0, 2, 5, 8)
PARTIAL = (
    "i int, s int, part int, n long, nulls long, not_finite long, v long, m double, m2 double, m3 double, m4 double, "
    "sum_1 string, sum_2 string, sum_3 string, sum_4 string"
)


def block_sums(mantissas: np.ndarray) -> list[int]:
    """Sums of powers 1 to 4 of up to `BLOCK` longs."""
    mask = (1 << BITS) - 1
    a = [(mantissas >> (BITS * k)) & mask for k in range(LIMBS - 1)] + [mantissas >> (BITS * (LIMBS - 1))]
    places = [sum(a[i] * a[k - i] for i in range(LIMBS) if 0 <= k - i < LIMBS) for k in range(2 * LIMBS - 1)]
    square = [(places[k] & mask if k < len(places) else 0) + (places[k - 1] >> BITS if k else 0) for k in range(2 * LIMBS)]

    def dot(left: list[np.ndarray], right: list[np.ndarray]) -> int:
        return sum(int(np.dot(x, y)) << (BITS * (i + j)) for i, x in enumerate(left) for j, y in enumerate(right))

    def total(limbs: list[np.ndarray]) -> int:
        return sum(int(x.sum()) << (BITS * k) for k, x in enumerate(limbs))

    return [total(a), total(square), dot(square, a), dot(square, square)]


def central_sums(values: np.ndarray) -> tuple[int, float, float, float, float]:
    """Count, mean and sums of powers 2 to 4 about the mean."""
    with np.errstate(all="ignore"):
        mean = float(values.mean())
        off = values - mean
        square = off * off
        return len(values), mean, float(square.sum()), float((square * off).sum()), float((square * square).sum())


def merged_moments(parts: Sequence[tuple[int, float, float, float, float]]) -> tuple[int, float, float, float, float]:
    """Count, mean and central sums of several parts together."""
    n, mean, m2, m3, m4 = parts[0]
    for nb, mean_b, b2, b3, b4 in parts[1:]:
        total, d = n + nb, mean_b - mean
        share, other = nb / total, n / total
        square = d * d  # products, since a power of a large number raises instead of being infinite
        m4 += b4 + square * square * other * nb * (share * share - share * other + other * other)
        m4 += 6 * square * (other * other * b2 + share * share * m2) + 4 * d * (other * b3 - share * m3)
        m3 += b3 + square * d * other * nb * (other - share) + 3 * d * (other * b2 - share * m2)
        m2 += b2 + square * other * nb
        n, mean = total, mean + d * share
    return n, mean, m2, m3, m4


class Sums:
    """What is known of the values of one column with one number of decimals."""

    def __init__(self) -> None:
        self.n = self.nulls = self.not_finite = 0
        self.powers = [0] * len(POWERS)
        self.moments: tuple | None = None

    def add_moments(self, found: tuple) -> None:
        if found[0]:
            self.moments = merged_moments([self.moments, found]) if self.moments else found

    def add_powers(self, found: Sequence[int]) -> None:
        self.powers = [x + y for x, y in zip(self.powers, found)]

    def row(self) -> tuple:
        v, *moments = self.moments or (0, None, None, None, None)
        return self.n, self.nulls, self.not_finite, v, *moments, *map(str, self.powers)


def partial_rows(found: dict[tuple[int, int | None], Sums], part: int) -> list[tuple]:
    return [(i, s, part, *sums.row()) for (i, s), sums in found.items()]


def _of_floats(x: np.ndarray) -> Iterator[tuple[int, np.ndarray | list[int], np.ndarray]]:
    """(decimals, mantissas, values) of finite floats, read as the shortest decimal that gives them.

    Few decimals are tried by arithmetic, which is sure while a mantissa has no more digits than
    any number of its type keeps; all others are read from their text.
    """
    kind, safe = x.dtype.type, 1e15 if x.dtype == np.float64 else 1e6
    left = x
    with np.errstate(all="ignore"):
        for decimals in TRIED_DECIMALS:
            scaled = np.rint(left.astype(np.float64) * 10.0**decimals)
            fits = (np.abs(scaled) < safe) & ((scaled / 10.0**decimals).astype(kind) == left)
            if fits.any():
                yield decimals, scaled[fits].astype(np.int64), left[fits].astype(np.float64)
                left = left[~fits]
    by_decimals: dict[int, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
    for value in left:
        digits, _, power = str(value).partition("e")
        whole, _, part = digits.partition(".")
        mantissas, values = by_decimals[len(part) - int(power or 0)]
        mantissas.append(int(whole + part))
        values.append(float(value))
    for decimals, (mantissas, values) in by_decimals.items():
        yield decimals, mantissas, np.array(values)


def _of_decimals(column: pa.Array) -> Iterator[tuple[int, np.ndarray | list[int], np.ndarray]]:
    """(decimals, mantissas, values) of decimals without nulls."""
    halves = np.frombuffer(column.buffers()[1], np.int64)[2 * column.offset : 2 * (column.offset + len(column))].reshape(-1, 2)
    scale, low, high = column.type.scale, halves[:, 0], halves[:, 1]
    short = high == (low >> 63)
    if short.any():
        yield scale, low[short], low[short] / 10.0**scale
    long = [(h << 64) | (lo & (2**64 - 1)) for lo, h in halves[~short].tolist()]
    if long:
        yield scale, long, np.array([x / 10**scale for x in long])


def sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over numeric columns: a row for each column and number of decimals."""
    from pyspark import TaskContext

    found: dict[tuple[int, int | None], Sums] = defaultdict(Sums)
    for batch in batches:
        for i, column in enumerate(batch.columns):
            rest = found[i, None]
            rest.nulls += column.null_count
            rest.n += column.null_count
            column = column.drop_null()
            if pa.types.is_decimal(column.type):
                parts = _of_decimals(column)
            elif pa.types.is_floating(column.type):
                values = column.to_numpy()
                finite = np.isfinite(values)
                odd = int((~finite).sum())
                rest.not_finite += odd
                rest.n += odd
                parts = _of_floats(values[finite])
            else:
                whole = column.to_numpy().astype(np.int64)
                parts = iter([(0, whole, whole.astype(np.float64))] if len(whole) else [])
            for decimals, mantissas, values in parts:
                sums = found[i, decimals]
                sums.n += len(values)
                sums.add_moments(central_sums(values))
                if isinstance(mantissas, list):
                    for value in mantissas:
                        sums.add_powers([value**k for k in POWERS])
                    continue
                for start in range(0, len(mantissas), BLOCK):
                    sums.add_powers(block_sums(mantissas[start : start + BLOCK]))
    found = {key: sums for key, sums in found.items() if sums.n}
    rows = partial_rows(found, TaskContext.get().partitionId())
    names = [field.split()[0] for field in PARTIAL.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[field.split()[1]] for field in PARTIAL.split(", ")]
    columns = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(types)]
    yield pa.RecordBatch.from_arrays(columns, names)


def _merged(rows: pd.DataFrame) -> dict[tuple[int, int | None], Sums]:
    found: dict[tuple[int, int | None], Sums] = defaultdict(Sums)
    for row in rows.itertuples(index=False):
        sums = found[int(row.i), None if pd.isna(row.s) else int(row.s)]
        sums.n += int(row.n)
        sums.nulls += int(row.nulls)
        sums.not_finite += int(row.not_finite)
        if row.v:
            sums.add_moments((int(row.v), float(row.m), float(row.m2), float(row.m3), float(row.m4)))
        sums.add_powers([int(row.sum_1), int(row.sum_2), int(row.sum_3), int(row.sum_4)])
    return found


def combine_tasks(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of several tasks as one of each column and number of decimals."""
    names = [field.split()[0] for field in PARTIAL.split(", ")]
    out = pd.DataFrame(partial_rows(_merged(rows), int(rows["part"].min())), columns=names)
    return out.astype({"s": "Int32", **{c: "float64" for c in ("m", "m2", "m3", "m4")}})


def exact_text(units: int, decimals: int, least: int) -> str:
    """units / 10**decimals in full, with at least `least` decimals and no further zeros."""
    if decimals < least:
        units, decimals = units * 10 ** (least - decimals), least
    digits = str(abs(units)).rjust(decimals + 1, "0")
    whole, part = digits[: len(digits) - decimals], digits[len(digits) - decimals :]
    part = part.rstrip("0").ljust(least, "0")
    return f"{'-' if units < 0 else ''}{whole}.{part}"


def exact_sum(texts: Sequence[str], least: int) -> str:
    """The sum of decimal texts, without rounding."""
    parts = [t.partition(".") for t in texts]
    decimals = max(len(p[2]) for p in parts)
    return exact_text(sum(int(w + f.ljust(decimals, "0")) for w, _, f in parts), decimals, least)


def combine_scales(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of a column from its rows per number of decimals: counts, merged moments, exact sums."""
    found = _merged(rows)
    some = {s: sums for (_, s), sums in found.items() if s is not None and sums.moments}
    out: dict = {"i": int(rows["i"].iloc[0])}
    for name in ("n", "nulls", "not_finite"):
        out[name] = sum(getattr(sums, name) for sums in found.values())
    moments = [sums.moments for _, sums in sorted(some.items())]
    out["v"], out["m"], out["m2"], out["m3"], out["m4"] = merged_moments(moments) if moments else (0, None, None, None, None)
    most = max(some, default=0)
    for k in POWERS:
        units = sum(sums.powers[k - 1] * 10 ** (k * (most - s)) for s, sums in some.items())
        whole = units * 10 ** max(0, -k * most)
        out[f"sum_{k}"] = exact_text(whole, max(0, k * most), 2 * k) if some and not out["not_finite"] else None
    return pd.DataFrame([out])


def sum_texts(lists: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    """For each (list of texts, least decimals) its exact sum; NULL for an empty list."""
    for batch in lists:
        yield pd.Series([exact_sum(list(t), int(d)) if len(t) else None for t, d in zip(batch["texts"], batch["least"])], dtype=object)


ship_by_value(__name__)
