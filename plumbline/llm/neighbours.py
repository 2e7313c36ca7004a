"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors are packed into blocks and quantised to int8 with one scale per vector. A tile is a query
block times a candidate block: the product of the int8 matrices gives every inner product up to a
known error, pairs whose upper bound can't reach the query's k-th best lower bound are left out,
and the rest is computed again in double precision on the original vectors and put on heaps. The
bounds hold always, so the result is exact.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import map_arrow

K = 20
QUERY_ROWS, CANDIDATE_ROWS = 1024, 4096
#: Dimensions up to which sums of int8 products are exact in single precision.
EXACT_DIMS = (1 << 24) // (127 * 127)
#: Query blocks whose heaps a task keeps; the oldest are sent on to the merge beyond that.
OPEN_BLOCKS = 16
BLOCK = "block long, dims int, n int, ids binary, exact binary, q8 binary, scale binary, residual binary, norm binary"
TILE = "query_id long, vec_id long, score double"


def _usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows that take part."""
    v = F.col("vector")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & v.isNotNull() & good
    )


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, norms of the quantisation residuals, norms of the quantised rows."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale[scale == 0] = 1  # a subnormal maximum: everything is residual
    q = np.clip(np.rint(vectors / scale[:, None]), -127, 127).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(vectors - back, axis=1), np.linalg.norm(back, axis=1)


def _blocks(rows: DataFrame, size: int, keep_equal: int | None) -> DataFrame:
    """Blocks of up to `size` vectors of equal dimension, from each partition as it is.

    With keep_equal, of equal vectors in a block only so many smallest ids stay: as all have the
    same score for any query and ties go to the smaller id, no other can be among its nearest.
    """

    def pack(ids: np.ndarray, vectors: np.ndarray, number: int) -> dict:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        if keep_equal is not None:
            seen: dict[bytes, int] = {}
            stay = []
            last = None
            for i, v in enumerate(vectors + 0.0):  # -0.0 becomes 0.0
                key = v.tobytes()
                fresh = (ids[i], key) != last  # a repeated row counts once
                last = (ids[i], key)
                seen[key] = seen.get(key, 0) + fresh
                stay.append(fresh and seen[key] <= keep_equal)
            ids, vectors = ids[stay], vectors[stay]
        q, scale, residual, norm = quantise(vectors)
        data = {"ids": ids, "exact": vectors, "q8": q, "scale": scale, "residual": residual, "norm": norm}
        return {"block": number, "dims": vectors.shape[1], "n": len(ids)} | {k: v.tobytes() for k, v in data.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        counts: dict[int, int] = {}
        kind = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in BLOCK.split(", ")])

        def flush(dims: int) -> pa.RecordBatch:
            nonlocal number
            parts = held.pop(dims)
            del counts[dims]
            number += 1
            return pa.RecordBatch.from_pylist([pack(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), number)], kind)

        for batch in batches:
            lists = batch.column(1)
            lengths = lists.value_lengths().to_numpy()
            ids = batch.column(0).to_numpy()
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                matrix = lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, dims)
                for s in range(0, len(at), size):
                    part = ids[at[s : s + size]], matrix[s : s + size]
                    if counts.get(dims, 0) + len(part[0]) > size and dims in held:
                        yield flush(dims)
                    held.setdefault(dims, []).append(part)
                    counts[dims] = counts.get(dims, 0) + len(part[0])
        for dims in list(held):
            yield flush(dims)

    return map_arrow(rows, run, BLOCK)


def _array(data: bytes, kind: type, rows: int) -> np.ndarray:
    found = np.frombuffer(data, kind)
    return found.reshape(rows, -1) if rows else found


def tile(query: dict, candidate: dict, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and candidate indices and scores of the pairs that survive the bounds.

    floor: scores that the k-th best of each query is known to reach.
    """
    nq, nc, dims = query["n"], candidate["n"], query["dims"]
    wide = np.float32 if dims <= EXACT_DIMS else np.float64
    product = _array(query["q8"], np.int8, nq).astype(wide) @ _array(candidate["q8"], np.int8, nc).astype(wide).T
    f = {(side, name): np.frombuffer(row[name]) for side, row in (("q", query), ("c", candidate)) for name in ("scale", "residual", "norm")}
    estimate = product.astype(np.float64) * f["q", "scale"][:, None] * f["c", "scale"]
    error = f["q", "residual"][:, None] * (f["c", "norm"] + f["c", "residual"]) + f["q", "norm"][:, None] * f["c", "residual"]
    error += 1e-12 * (f["q", "norm"] + f["q", "residual"])[:, None] * (f["c", "norm"] + f["c", "residual"])  # rounding of doubles
    lower = estimate - error
    own = np.frombuffer(query["ids"], np.int64)[:, None] == np.frombuffer(candidate["ids"], np.int64)
    lower[own] = -np.inf
    if nc > k:
        floor = np.maximum(floor, np.partition(lower, nc - k, axis=1)[:, nc - k])
    i, j = np.nonzero((estimate + error >= floor[:, None]) & ~own)
    q, c = _array(query["exact"], np.float64, nq), _array(candidate["exact"], np.float64, nc)
    score = np.zeros(len(i))
    for d in range(dims):  # one order of summation for all pairs
        score += q[i, d] * c[j, d]
    return i, j, score


def nearest(
    table: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_rows: int = QUERY_ROWS,
    candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query row.

    Candidates are all rows but those with the query's id; ties go to the smaller vec_id; a query
    with fewer candidates gets them all. Null ids, vectors that are null, empty, all zero or hold
    null or non-finite components take no part; vectors are compared with those of their dimension
    only. Repeated rows are one candidate, and one query. Other columns are ignored; an empty table
    gives no rows.
    """
    rows = _usable(table, id_col, vector_col)
    queries = _blocks(rows.where(is_query).coalesce(4), query_rows, None)
    candidates = _blocks(rows, candidate_rows, 2 * k + 2)
    many = max(1, -(-table.where(is_query).count() // query_rows))
    lane = F.pmod(F.xxhash64("block"), F.lit(many))
    left = queries.withColumn("lane", lane)
    right = candidates.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).withColumn("lane", F.col("lane").cast("long"))
    spread = max(1, 4 * table.sparkSession.sparkContext.defaultParallelism // many)
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    right = right.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int"))
    names = [c.split()[0] for c in BLOCK.split(", ") if not c.startswith("dims")]
    tiles = left.hint("shuffle_merge").join(right.select("lane", "part", "dims", *[F.col(c).alias(f"c_{c}") for c in names]), ["lane", "part", "dims"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: OrderedDict[int, tuple[list[int], list[list[tuple]]]] = OrderedDict()

        def send(ids: list[int], of: list[list[tuple]]) -> pa.RecordBatch:
            flat = [(ids[i], -v, s) for i, h in enumerate(of) for s, v in h]
            columns = list(zip(*flat)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                candidate = {n: row[f"c_{n}"] for n in names} | {"dims": row["dims"]}
                if row["block"] not in heaps:
                    ids = np.frombuffer(row["ids"], np.int64).tolist()
                    heaps[row["block"]] = ids, [[] for _ in ids]
                    if len(heaps) > OPEN_BLOCKS:
                        yield send(*heaps.popitem(last=False)[1])
                _, of = heaps[row["block"]]
                floor = np.array([h[0][0] if len(h) == k else -np.inf for h in of])
                i, j, score = tile(row, candidate, k, floor)
                ids = np.frombuffer(candidate["ids"], np.int64)[j].tolist()
                for a, v, s in zip(i.tolist(), ids, score.tolist()):
                    entry = (s, -v)
                    h = of[a]
                    if len(h) < k:
                        if entry not in h:
                            heapq.heappush(h, entry)
                    elif entry > h[0] and entry not in h:
                        heapq.heapreplace(h, entry)
        while heaps:
            yield send(*heaps.popitem(last=False)[1])

    best = map_arrow(tiles.select("block", "dims", "n", "ids", "exact", "q8", "scale", "residual", "norm", *[f"c_{c}" for c in names]), run, TILE)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
