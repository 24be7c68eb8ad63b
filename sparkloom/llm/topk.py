"""Exact top-k search by pivot-table elimination.

The score is the inner product of integer vectors. Every vector's distances to up to PIVOTS pivots and to the origin are
computed once and stored beside it. Together they fix where a vector's projection on the space of the pivots lies and how
long the rest is (r), and so the maximum lower bound that they allow of the distance of two vectors,
d(q, x)^2 >= |q' - x'|^2 + (r_q - r_x)^2, which is never below |d(q, p) - d(x, p)| for any pivot p. As an upper bound of the
score that is q' x' + r_q r_x. A task bounds a block of rows for all queries by one matrix product, evaluates a query's
candidates in the order of their bounds, and stops when the next bound is below its k-th best score. A first k-th best comes
from the pivot sample, so tasks send only candidates that may be in the result. Queries go out in blocks of a fixed size,
each against all rows.

Defined results. Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Only
vectors of the query's length are its candidates. A repeated row is a candidate of its own, but never a row with the
query's id; a query id that repeats is asked once, with its smallest vector. Ties go to the smaller id. Scores are exact
as long as they fit in 64 bits. An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .runtime import drop, ship, tidy, work_dir, written

#: Pivots, vectors of the bounded sample that they are chosen from, and queries of a block.
PIVOTS, SAMPLE, BLOCK = 48, 2048, 4096
#: Bounds that a task holds at a time, and candidates that it evaluates at a time.
BOUNDS, STEP = 1 << 22, 64
_RESULT = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """vec_id and the components floor(scale * x) of the rows that take part."""
    v = vectors[vec_col].cast("array<double>")
    usable = v.isNotNull() & vectors[id_col].isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(usable).select(vectors[id_col].cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Each next pivot is the vector that lies farthest from the space of those chosen; none lies in it."""
    rest, chosen = sample.astype(np.float64), []
    least = 1e-6 * max(1.0, float(np.sqrt((rest**2).sum(axis=1)).max(initial=0.0)))
    while len(chosen) < min(count, len(sample)):
        far = np.sqrt((rest**2).sum(axis=1))
        i = int(far.argmax())
        if far[i] <= least:
            break
        chosen.append(i)
        unit = rest[i] / far[i]
        rest = rest - np.outer(rest @ unit, unit)
    return sample[chosen]


class Space:
    """The space of the pivots: from distances to coordinates in it and the length of what lies outside."""

    def __init__(self, pivots: np.ndarray):
        p = pivots.astype(np.float64)
        self.square = (p**2).sum(axis=1)
        self.back = np.linalg.inv(np.linalg.qr(p.T)[1]) if len(p) else np.zeros((0, 0))

    def place(self, d: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """d: distances to the pivots; norm: squared distances to the origin."""
        products = (norm[:, None] + self.square - d**2) / 2
        at = products @ self.back
        return at, np.sqrt(np.maximum(norm - (at**2).sum(axis=1), 0))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(x.astype(np.float64) - p, axis=1) for p in pivots.astype(np.float64)], axis=1) if len(x) and len(pivots) else np.zeros((len(x), len(pivots)))


def dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    if len(x) and q.size and float(np.abs(x).max()) * float(np.abs(q).max()) * q.size < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and the matrix of the vectors of each length."""
    lengths = np.diff(column.offsets.to_numpy())
    flat, first = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, flat[(first[rows][:, None] + np.arange(n)).ravel()].reshape(len(rows), n)


def _pivot_table(sent):
    def run(batches):
        for batch in batches:
            table = [None] * batch.num_rows
            for rows, x in by_length(batch.column(1)):
                d = distances(x, sent.value[x.shape[1]]) if x.shape[1] in sent.value else np.zeros((len(x), 0))
                for r, values in zip(rows.tolist(), d, strict=True):
                    table[r] = values
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(table, pa.list_(pa.float64()))], names=["vec_id", "v", "d"])

    return run


class Best:
    """The k best (score, id) of a query; ties to the smaller id."""

    def __init__(self, k: int, floor: int | None):
        self.k, self.floor, self.score, self.id = k, floor, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> float:
        own = float(self.score[-1]) if len(self.score) == self.k else -np.inf
        return own if self.floor is None else max(own, float(self.floor))

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if self.floor is not None:
            good = score >= self.floor
            score, ids = score[good], ids[good]
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


def _search(sent, k: int):
    def run(batches):
        blocks = sent.value
        best = {n: [Best(k, f) for f in floors] for n, (_, _, _, floors, _) in blocks.items()}
        evaluated = {n: np.zeros(len(b), np.int64) for n, b in best.items()}
        spaces = {n: Space(pivots) for n, (_, _, _, _, pivots) in blocks.items()}
        for batch in batches:
            ids, table = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            width = np.diff(table.offsets.to_numpy())
            flat, first = table.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(width)])
            for rows, x in by_length(batch.column(1)):
                n = x.shape[1]
                if n not in blocks:
                    continue
                q_ids, q, q_d, _, _ = blocks[n]
                wide = max(1, BOUNDS // max(1, len(q)))
                for a in range(0, len(rows), wide):
                    part = rows[a : a + wide]
                    d = flat[(first[part][:, None] + np.arange(q_d.shape[1])).ravel()].reshape(len(part), -1)
                    _evaluate(q_ids, q, q_d, best[n], evaluated[n], ids[part], x[a : a + wide], d, spaces[n])
        for n, (q_ids, *_) in blocks.items():
            out = [(i, x, s) for i, b in zip(q_ids.tolist(), best[n], strict=True) for x, s in zip(b.id.tolist(), b.score.tolist(), strict=True)]
            out += [(i, None, int(c)) for i, c in zip(q_ids.tolist(), evaluated[n], strict=True) if c]  # how many were evaluated
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def _evaluate(q_ids, q, q_d, best, evaluated, ids, x, d, space: Space) -> None:
    """All queries against a block of rows: bounds by one product, then each query's candidates in the order of their bounds."""
    norm, q_norm = (x.astype(np.float64) ** 2).sum(axis=1), (q.astype(np.float64) ** 2).sum(axis=1)
    at, rest = space.place(d, norm)
    q_at, q_rest = space.place(q_d, q_norm)
    upper = q_at @ at.T + np.outer(q_rest, rest)
    upper += 1e-6 * (norm[None, :] + q_norm[:, None]) + 0.5  # room for rounding; scores are whole numbers
    least = np.array([b.least() for b in best])
    for i in np.flatnonzero((upper >= least[:, None]).any(axis=1)).tolist():
        bound, b = upper[i], best[i]
        live = np.flatnonzero((bound >= least[i]) & (ids != q_ids[i]))
        live = live[np.argsort(-bound[live])]
        for a in range(0, len(live), STEP):
            if bound[live[a]] < b.least():
                break
            some = live[a : a + STEP]
            evaluated[i] += len(some)
            b.add(dots(x[some], q[i]), ids[some])


def found(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """query_id, vec_id, score of all tasks' candidates; rows of a null vec_id say how many vectors a task evaluated for a query."""
    spark = vectors.sparkSession
    ship(spark)
    sc = spark.sparkContext
    rows = integers(vectors, id_col, vec_col, scale)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # SAMPLE rows at most
    lengths = {len(r["v"]) for r in sample}
    mats = {n: (np.array([r["vec_id"] for r in sample if len(r["v"]) == n], np.int64), np.array([r["v"] for r in sample if len(r["v"]) == n], np.int64).reshape(-1, n)) for n in lengths}
    chosen = {n: choose_pivots(x) for n, (_, x) in mats.items() if n}
    pivots = sc.broadcast(chosen)  # PIVOTS vectors a length of the sample
    table = written(rows.mapInArrow(tidy(_pivot_table(pivots)), "vec_id long, v array<long>, d array<double>"), "pivot-table")
    pivots.destroy()
    # a query id that repeats is one row before anything is collected
    asked = written(table.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "d")).alias("r")).select("vec_id", "r.*"), "topk-queries")
    blocks = max(1, -(-asked.count() // BLOCK))
    out = work_dir(spark, "topk")
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        once = [(r["vec_id"], r["v"], r["d"]) for r in part.collect()]  # about BLOCK rows
        sent = {}
        for n in {len(v) for _, v, _ in once}:
            own = sorted(x for x in once if len(x[1]) == n)
            q_ids, q = np.array([i for i, _, _ in own], np.int64), np.array([v for _, v, _ in own], np.int64).reshape(-1, n)
            s_ids, s = mats.get(n, (np.zeros(0, np.int64), np.zeros((0, n), np.int64)))
            floors = []
            for i, v in zip(q_ids, q, strict=True):
                some = np.sort(dots(s[s_ids != i], v))
                floors.append(int(some[-k]) if len(some) >= k else None)
            sent[n] = (q_ids, q, np.array([d for _, _, d in own], np.float64).reshape(len(own), -1), floors, chosen.get(n, np.zeros((0, n), np.int64)))
        block = sc.broadcast(sent)  # about BLOCK vectors
        table.mapInArrow(tidy(_search(block, k)), _RESULT).write.mode("append").parquet(out)
        block.destroy()
    drop(table, asked)
    return spark.read.schema(_RESULT).parquet(out)


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row of vectors that is_query holds for (a condition on vec_id)."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found(vectors, is_query, k, id_col, vec_col, scale).where("vec_id is not null").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def evaluated(candidates: DataFrame) -> DataFrame:
    """query_id, evaluated: for how many vectors the score itself was computed (of what found() gives)."""
    return candidates.where("vec_id is null").groupBy("query_id").agg(F.sum("score").alias("evaluated"))
