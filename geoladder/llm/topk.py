"""Exact top-k search (9): exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights: component t becomes floor(scale * x), and zero components have no posting.
Candidates lie in blocks of bounded size, each an inverted file: for every term the rows that have it and their weights.
Queries lie in blocks too. Where a block of queries meets a block of candidates, the terms are taken one at a time: each
query's weight times the term's postings is scattered into a dense array of scores. The best k of every block are chosen
by partition, and the blocks' lists are merged per query.

Only blocks of numbers travel: every query block goes to every candidate block, and k rows per query and candidate
block come back. Blocks are as large as there is work for all tasks, up to ``candidate_rows`` and ``query_rows``: a
block is sent once per block of the other kind, so the numbers sent grow with (queries x candidates) / block rows. Within
a task they are worked on in pieces.

Scores are exact integers (32 bits where they fit, else 64, else Python's). Defined results: vectors that are null, hold
null or a non-finite component, or have no id take no part; missing components of shorter vectors are 0; rows with the
query's own id are not its candidates; a query row that is repeated exactly counts once, a repeated candidate as often
as it is there; fewer candidates than k give fewer rows; scores beyond 64 bits become the nearest 64-bit number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "block bigint, ids binary, weights binary, n int, dims int, kind string"


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null, and all components finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _pack(rows: list, scale: float) -> tuple[bytes, int, str]:
    dims = max((len(r) for r in rows), default=0)
    m = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    m = np.floor(m * scale)
    if not m.size or np.abs(m).max() < 2**15:
        return m.astype("<i2").tobytes(), dims, "<i2"
    return m.astype("<f8").tobytes(), dims, "<f8"


def blocks(vectors: DataFrame, rows: int, scale: float) -> DataFrame:
    """(vec_id, v) packed into blocks of about ``rows`` rows; a block is one row of numbers."""
    n = max(1, math.ceil(vectors.count() / rows))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        out = []
        for i in range(0, len(pdf), 2 * rows):  # repeated rows meet in one block
            part = pdf.iloc[i : i + 2 * rows]
            data, dims, kind = _pack(list(part["v"]), scale)
            out.append((int(part["block"].iloc[0]), part["vec_id"].to_numpy("<i8").tobytes(), data, len(part), dims, kind))
        return pd.DataFrame(out, columns=["block", "ids", "weights", "n", "dims", "kind"])

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)))
    return dealt.groupBy("block").applyInPandas(pack, BLOCK)


def _matrix(data: bytes, kind: str, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, dims)


def accumulate(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of all query rows with all candidate rows, term at a time over the candidates' postings."""
    dims = min(q.shape[1], c.shape[1])
    top = float(np.abs(q[:, :dims]).max(initial=0)) * float(np.abs(c[:, :dims]).max(initial=0)) * max(dims, 1)
    kind = np.int32 if top < 2**31 else np.int64 if top < 2**62 else object
    as_int = (lambda x: x.astype(kind)) if kind is not object else (lambda x: np.array([int(y) for y in x], object))
    scores = np.zeros((len(q), len(c)), kind)
    for t in range(dims):
        rows, postings = np.flatnonzero(q[:, t]), np.flatnonzero(c[:, t])
        if not len(rows) or not len(postings):
            continue
        weights, values = as_int(q[rows, t]), as_int(c[postings, t])
        full = len(postings) == len(c)
        for i, w in zip(rows.tolist(), weights, strict=True):
            if full:
                scores[i] += w * values
            else:
                scores[i, postings] += w * values
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k highest, ties to smaller ids; ``ids`` ascend. Rows with the id ``own`` are left out."""
    a, b = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    if b > a:
        scores, ids = np.delete(scores, slice(a, b)), np.delete(ids, slice(a, b))
    if len(scores) > k:
        if scores.dtype == object:
            at = np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], i))[:k])
        else:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            over = np.flatnonzero(scores > least)
            at = np.sort(np.concatenate([over, np.flatnonzero(scores == least)[: k - len(over)]]))
        scores, ids = scores[at], ids[at]
    return ids, scores


def search(vectors: DataFrame, queries: DataFrame, spark: SparkSession, k: int = 20, scale: float = 64.0, candidate_rows: int = 65536, query_rows: int = 16384, piece: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query. Both inputs: (vec_id, v array<double>)."""
    n, asked = vectors.count(), (queries := queries.distinct()).count()
    # at least some blocks for each task that can run at once
    tasks = 4 * spark.sparkContext.defaultParallelism
    candidate_rows = min(candidate_rows, max(piece, -(-n // tasks)))
    query_rows = min(query_rows, max(64, -(-asked * max(1, -(-n // candidate_rows)) // tasks)))
    c = blocks(vectors, candidate_rows, scale)
    q = blocks(queries, query_rows, scale).select(*[F.col(x).alias(f"q_{x}") for x in ("ids", "weights", "n", "dims", "kind")])
    n_blocks = max(1, math.ceil(n / candidate_rows))
    met = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(c, "block").drop("block")
    met = met.repartition(F.xxhash64("q_ids", "ids"))

    def score(batches):
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf.itertuples(index=False):
                ids, own = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.q_ids, "<i8")
                qm, cm = _matrix(r.q_weights, r.q_kind, r.q_n, r.q_dims), _matrix(r.weights, r.kind, r.n, r.dims)
                for i, a in ((i, a) for a in range(0, len(ids), piece) for i in range(0, len(own), 64)):
                    s = accumulate(qm[i : i + 64], cm[a : a + piece])
                    for j, me in enumerate(own[i : i + 64].tolist()):
                        got, sc = best(s[j], ids[a : a + piece], me, k)
                        sc = np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in sc], np.int64) if sc.dtype == object else sc.astype(np.int64)
                        out.append((np.full(len(got), me), got, sc))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            yield pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], cols, strict=True)))

    found = met.mapInPandas(score, "query_id bigint, vec_id bigint, score bigint")
    per_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def vectors_of(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The rows that take part, as (vec_id, v array<double>)."""
    v = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return v.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
