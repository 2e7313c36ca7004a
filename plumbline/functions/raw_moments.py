"""Shape from raw power sums in decimals of enough digits, for small tables of stored metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal, localcontext

import pandas as pd

from plumbline.functions.shipping import ship_by_value

# Fixed value: significant digits kept beyond those of the sums, to survive cancellation.
PRECISION = 50


def shape_of_raw(n: int, sums: Sequence[str | None]) -> tuple[float | None, float | None]:
    if any(s is None or pd.isna(s) for s in sums[:3]) or n < 3:
        return None, None
    with localcontext() as context:
        context.prec = PRECISION + max(len(str(s)) for s in sums)
        count = Decimal(int(n))
        mu, *higher = [Decimal(s) / count if not pd.isna(s) else None for s in sums]
        m2 = higher[0] - mu**2
        if m2 <= 0:
            return None, None
        m3 = higher[1] - 3 * mu * higher[0] + 2 * mu**3
        skew = float(m3 / (m2 * m2.sqrt()))
        if n < 4 or higher[2] is None:
            return skew, None
        m4 = higher[2] - 4 * mu * higher[1] + 6 * mu**2 * higher[0] - 3 * mu**4
        return skew, float(m4 / m2**2 - 3)


def raw_shape_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        shapes = [
            shape_of_raw(row.valid_count, (row.sum_x, row.sum_x2, row.sum_x3, row.sum_x4))
            for row in batch.itertuples(index=False)
        ]
        yield pd.DataFrame(
            {
                "run_id": batch["run_id"],
                "column_name": batch["column_name"],
                "skewness_derived": pd.array([s[0] for s in shapes], dtype="Float64"),
                "kurtosis_derived": pd.array([s[1] for s in shapes], dtype="Float64"),
            }
        )


ship_by_value(__name__)
