"""Exact top-k by inner product with a pivot table.

Distances of all vectors to some pivots are worked out once, and stored with the vectors in blocks, in order of
their nearest pivots. For a query, |d(q, p) - d(x, p)| is a lower bound of d(q, x) for each pivot p; the largest
over the pivots gives an upper bound of the inner product (|q|^2 + |x|^2 - bound^2) / 2. Candidates are
evaluated in order of that bound until no bound reaches the k-th best score. Queries meet candidates in blocks;
the ranges of two blocks' distances give the same bound for all their pairs, so blocks out of reach never meet, and
that is known before any vector moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, stored

PIVOTS = 24
#: Rows from which pivots are chosen, at most; any choice gives exact results.
PIVOT_SAMPLE = 1024
BLOCK = 8192
QUERY_BLOCK = 8192
#: Candidates evaluated first; each further step takes eight times as many.
STEP = 256
#: What a distance of 1 is rounded by in 24 bits, at most, and some more.
_ROUNDED = 2.0**-22


def quantized(vector):
    """floor(256 * x) of each component as double; null where the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double")))


def _matrix(lists, width: int) -> np.ndarray:
    """Rows padded with zeros to the width."""
    flat = lists.flatten().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0)
    n = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    out = np.zeros((len(lists), width))
    at = np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(lists)), n), np.arange(len(flat)) - at] = flat
    return out


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: in doubles where they are exact there, else in Python's numbers."""
    if not len(x) or np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, len(q)) < 2.0**53:
        return (x @ q).astype(np.int64)
    return _long(q, x)


def _long(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    qs = [int(v) for v in q]
    return np.array([max(-(2**63), min(2**63 - 1, sum(a * int(b) for a, b in zip(qs, row, strict=True)))) for row in x], dtype=np.int64)


def _packed(m: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them all: a letter for the kind, then the numbers."""
    top = np.abs(m).max(initial=0)
    kind = "h" if top < 2**15 else "i" if top < 2**31 else "d"
    return kind.encode() + m.astype(f"<{_KINDS[kind]}").tobytes()


_KINDS = {"h": "i2", "i": "i4", "d": "f8"}


def _unpacked(raw: memoryview, rows: int, width: int) -> np.ndarray:
    kind = _KINDS[bytes(raw[:1]).decode()]
    return np.frombuffer(raw, f"<{kind}", offset=1).astype(float).reshape(rows, width)


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first from the sample's first row."""
    if not len(sample):
        return sample
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, np.sqrt(((sample - sample[chosen[-1]]) ** 2).sum(axis=1)))
        chosen.append(int(far.argmax()))
    return sample[chosen]


def _reached(q: np.ndarray, q_uids: np.ndarray, sample: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k other rows of the sample reach; minus infinity if it has fewer."""
    if len(sample) <= k:
        return np.full(len(q), -np.inf)
    scores = q @ sample.T
    scores -= 1e-9 * np.abs(scores)  # beyond 2**53 they are rounded
    scores[q_uids[:, None] == uids[None]] = -np.inf
    return np.sort(scores, axis=1)[:, -k]


def _search(q: np.ndarray, q_uid: np.ndarray, q_table: np.ndarray, x: np.ndarray, ids: np.ndarray, uids: np.ndarray, table: np.ndarray, k: int, least: np.ndarray | None = None):
    """For each query its k best rows of the block: (query, row, score), ties to the smaller id; and how many rows were evaluated.

    least: for each query a score that k rows of the whole table are known to reach; rows below it don't count.
    """
    q_norm, x_norm = (q * q).sum(axis=1), (x * x).sum(axis=1)
    plain = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1]) < 2.0**53  # doubles are exact
    found, evaluated, far = [], 0, table.max(initial=0)
    for i in range(len(q)):
        low = np.abs(table - q_table[i]).max(axis=1) if table.shape[1] else np.zeros(len(x))
        # Distances are rounded to 24 bits: the bound gives way by a little more than that.
        low = np.maximum(0, low - _ROUNDED * (far + q_table[i].max(initial=0)))
        upper = (q_norm[i] + x_norm - low * low) / 2 + 1e-9 * (q_norm[i] + x_norm) + 1e-6
        floor = -np.inf if least is None else float(least[i])
        left = np.flatnonzero(upper >= floor)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = STEP
        while len(left):
            if len(left) > step:  # those with the highest bounds come next
                top = np.argpartition(-upper[left], step - 1)
                some, left = left[top[:step]], left[top[step:]]
                step *= 8
            else:
                some, left = left, left[:0]
            evaluated += len(some)
            new = (x[some] @ q[i]).astype(np.int64) if plain else _long(q[i], x[some])
            good = (new >= floor) & (uids[some] != q_uid[i])
            rows, scores = np.concatenate([rows, some[good]]), np.concatenate([scores, new[good]])
            best = np.lexsort((uids[rows], ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
            if len(rows) == k:
                floor = max(floor, float(scores[-1]))
                left = left[upper[left] >= floor]
        found += [(i, int(r), int(s)) for r, s in zip(rows, scores, strict=True)]
    return found, evaluated


def top_k(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row among all other rows.

    is_query: a condition on vectors. Ties go to the smaller id, then to the earlier row; fewer rows, fewer
    results. Vectors that are null or hold a null or non-finite component take no part, nor do null ids;
    shorter vectors count as if filled up with zeros. Rows that repeat an id are rows of their own: a query
    leaves out only its own row. Scores beyond a long are the nearest long. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), quantized(F.col(vector)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("uid"))
    rows = stored(rows.where(F.col("v").isNotNull() & F.col("id").isNotNull()), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    some = rows.select("v", "uid").limit(PIVOT_SAMPLE).toArrow()
    sample = _matrix(some["v"].combine_chunks(), width) if width else np.zeros((0, 0))
    sample_uids = some["uid"].to_numpy()
    pivots = choose_pivots(sample) if width else np.zeros((0, 0))

    near = "id long, uid long, q boolean, near int, away double, v array<double>"
    placed = rows.select("id", "uid", "q", "v").mapInArrow(_placer(pivots, width), near)
    order = ["near", "away", "uid"]
    dealt = stored(placed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order), "placed", rows)

    def blocks(size: int, with_least: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, size):
                    some = b.slice(at, size)
                    m = _matrix(some.column(1), width)
                    t = _distances(m, pivots).astype("<f4")
                    uids = some.column(2).to_numpy()
                    least = _reached(m, uids, sample, sample_uids, k) if with_least else np.zeros(0)
                    cols = [some.column(0).to_numpy().astype("<i8").tobytes(), uids.astype("<i8").tobytes(), _packed(m), t.tobytes(), least.astype("<f8").tobytes()]
                    facts = [float((m * m).sum(axis=1).max()), t.min(axis=0).astype(float).tolist(), t.max(axis=0).astype(float).tolist(), float(least.min(initial=np.inf))]
                    kinds = [pa.binary()] * 5 + [pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip(cols + facts, kinds, strict=True)], ["ids", "uids", "m", "t", "least", "norm", "low", "high", "floor"])

        return run

    packed = "ids binary, uids binary, m binary, t binary, least binary, norm double, low array<double>, high array<double>, floor double"
    numbered = lambda df, name: df.withColumn(name, F.monotonically_increasing_id())
    x = stored(numbered(dealt.select("id", "v", "uid").mapInArrow(blocks(BLOCK, False), packed), "xb"), "blocks")
    q = stored(numbered(dealt.where("q").select("id", "v", "uid").mapInArrow(blocks(QUERY_BLOCK, True), packed), "qb"), "query_blocks", dealt)
    # Each pair of blocks in reach meets in a task of its own: the pairs of block numbers are dealt out.
    met = (
        block_pairs(q, x).join(x, "xb").join(q.select("qb", F.col("ids").alias("q_ids"), F.col("uids").alias("q_uids"), F.col("m").alias("q_m"), F.col("t").alias("q_t"), F.col("least").alias("q_least")), "qb")
        .select("q_ids", "q_uids", "q_m", "q_t", "ids", "uids", "m", "t", "q_least")
    )
    n_pivots = len(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = [memoryview(b.column(c)[i].as_buffer()) for c in range(9)]
                q_ids, q_uids, ids, uids = (np.frombuffer(raw[c], "<i8") for c in (0, 1, 4, 5))
                qm, xm = _unpacked(raw[2], len(q_ids), width), _unpacked(raw[6], len(ids), width)
                qt, xt = (np.frombuffer(raw[c], "<f4").astype(float).reshape(rows, n_pivots) for c, rows in ((3, len(q_ids)), (7, len(ids))))
                found, _ = _search(qm, q_uids, qt, xm, ids, uids, xt, k, np.frombuffer(raw[8], "<f8"))
                if found:
                    a, r, s = (np.array(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (q_ids[a], q_uids[a], ids[r], uids[r], s)], ["query_id", "query_uid", "vec_id", "uid", "score"])

    best = met.mapInArrow(run, "query_id long, query_uid long, vec_id long, uid long, score long")
    order = W.partitionBy("query_id", "query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((m - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(m), 0))


def _placer(pivots: np.ndarray, width: int):
    """Adds each vector's nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                t = _distances(_matrix(some.column(3), width), pivots)
                here = [t.argmin(axis=1), t.min(axis=1)] if t.shape[1] else [np.zeros(len(t)), np.zeros(len(t))]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(here[0].astype(np.int32)), pa.array(here[1].astype(float)), some.column(3)], ["id", "uid", "q", "near", "away", "v"])

    return run


def block_pairs(q: DataFrame, x: DataFrame) -> DataFrame:
    """(qb, xb) of those blocks of queries and rows in reach of each other, from their numbers and ranges alone."""
    a = q.select("qb", F.col("norm").alias("qn"), F.col("low").alias("ql"), F.col("high").alias("qh"), F.col("floor").alias("floor"))
    b = x.select("xb", F.col("norm").alias("xn"), F.col("low").alias("xl"), F.col("high").alias("xh"))
    far = F.greatest(F.array_max("qh"), F.array_max("xh"))
    apart = F.array_max(F.zip_with(F.zip_with("ql", "xh", lambda l, h: l - h), F.zip_with("xl", "qh", lambda l, h: l - h), lambda p, r: F.greatest(p, r)))
    apart = F.greatest(F.coalesce(apart - 2 * _ROUNDED * far, F.lit(0.0)), F.lit(0.0))
    norms = F.col("qn") + F.col("xn")
    return a.join(b, (norms - apart * apart) / 2 + norms * 1e-9 + 1e-6 >= F.col("floor")).select("qb", "xb")
