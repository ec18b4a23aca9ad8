"""Quality classifier (7): ordinal cumulative-link regression on graded ratings.

The grades are ordered; one weight vector over hashed text features is shared by all cumulative logits, and ordered
thresholds cut its score: P(grade >= k) = sigmoid(score - threshold_k). This gives an expected grade and, for the
selection, the tail probability P(grade >= ``keep_grade``).

Features: the words that a text has (A-Z lower-cased, ASCII punctuation around them taken away), hashed into ``dims``
cells with the value 1 however often; and, in cells of their own, the shares of words that end in each pair of
punctuation signs, begin with two capitals, or repeat the word before. Only words that are associated with the grades (by
``screen`` standard errors) get a weight; of the others, a weight would be noise.

The fit takes a bounded sample of the rated documents: those with the smallest hash of their id, ``sample`` of them at
most, and of each at most ``most_cells`` cells, those with the smallest hash (documented parameters). Only these reach the
driver: 12,000 x 4,096 cells of 6 bytes at the very most. Scoring covers all rows and whole texts. What a document was
rated is known: ``select`` never keeps one that was rated below the wanted grade, whatever its score.

Defined results: a null text is empty and gets the score of a text without features; rows without doc_id are scored
like all others; documents with several ratings count with the lowest; null ratings are ignored; with no ratings, or
only one grade, every document gets that grade (the highest, if there is none); an empty table gives no rows; other
columns stay as they are, and if one of them has the name of a new column, the new one's gets an underscore more; very
long texts are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, _vec

U = np.uint64
DIMS = 1 << 18
SAMPLE = 12_000
MOST_CELLS = 4096
#: Cells that are counted at a time, since NumPy counts on copies of eight bytes a cell.
BLOCK = 1 << 18
#: Ratings below the wanted grade that are broadcast, if they are counted to be no more.
BROADCAST_ROWS = 500_000
#: Grades of the labels table: toxic text is worst, then text of low quality.
GRADES = 3


def grade(quality: Column, toxic: Column) -> Column:
    """0: toxic; 1: of low quality; 2: good. Null if nothing is known."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


#: Cells at the end of the table that hold shares of word shapes, and the factor that brings them to the words' scale.
SHAPES, SHARE = 256, 8.0
#: ASCII signs that are neither letters nor digits nor white space.
IS_SIGN = np.zeros(256, bool)
IS_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def cells(buf: np.ndarray, bounds: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of hashed features: (cells, values, first cell of each text)."""
    start, end, first = _vec.words(buf, bounds)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(len(bounds), np.int64)
    last, before = buf[end - 1], buf[np.maximum(end - 2, start)]
    signs = IS_SIGN[last]
    capital = lambda b: (b >= 65) & (b <= 90)
    caps = (end - start > 1) & capital(buf[start]) & capital(buf[np.minimum(start + 1, len(buf) - 1)])
    pair = last.astype(np.int64) * 256 + np.where(IS_SIGN[before], before, 0)
    exact = _vec.stretch_hashes(buf, start, end)
    again = np.zeros(len(doc), bool)
    again[1:] = (exact[1:] == exact[:-1]) & (doc[1:] == doc[:-1])
    shape_doc = np.concatenate([doc[signs], doc[caps], doc[again]])
    shape = np.concatenate([(pair[signs] * 40503 >> 4) % (SHAPES - 2), np.full(int(caps.sum()), SHAPES - 1), np.full(int(again.sum()), SHAPES - 2)]) + dims - SHAPES
    # words without the signs around them
    a, b = start.copy(), end.copy()
    plain = np.flatnonzero(~IS_SIGN[buf])  # the bytes that stay
    near = np.concatenate([plain, [len(buf)]])[np.searchsorted(plain, start)]
    far = np.concatenate([[-1], plain])[np.searchsorted(plain, end)]
    a, b = np.minimum(near, end), np.maximum(far + 1, start)
    some = a < b
    word = (_vec.stretch_hashes(_vec.LOWER[buf], a[some], b[some]) % U(dims - SHAPES)).astype(np.int64)
    key = np.concatenate([doc[some] * dims + word, shape_doc * dims + shape])
    key, count = np.unique(key, return_counts=True)
    row, cell = key // dims, key % dims
    value = np.where(cell < dims - SHAPES, 1.0, SHARE * count / n[row])
    return cell.astype(np.int32), value.astype(np.float32), np.searchsorted(key, np.arange(len(n) + 1) * dims)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1, a column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def associated(cell: np.ndarray, begin: np.ndarray, grades: np.ndarray, dims: int, n_grades: int, screen: float) -> np.ndarray:
    """Which cells tell grades apart: for some k, the shares of documents of grade >= k with and without the cell differ
    by ``screen`` standard errors. Cells of word shapes always count."""
    n, row = len(grades), np.repeat(np.arange(len(grades), dtype=np.int32), np.diff(begin))
    have, with_good = np.zeros(dims), np.zeros((n_grades, dims))
    for at in range(0, len(cell), BLOCK):
        c, g = cell[at : at + BLOCK], grades[row[at : at + BLOCK]]
        have += np.bincount(c, minlength=dims)
        for k in range(1, n_grades):
            with_good[k] += np.bincount(c, g >= k, dims)
    out = np.zeros(dims, bool)
    out[dims - SHAPES :] = True
    for k in range(1, n_grades):
        good = (grades >= k).astype(np.float64)
        with_it, p = with_good[k], good.mean()
        error = np.sqrt(np.maximum(p * (1 - p) * have * (n - have) / n, 1e-12))
        out |= (have > 0) & (np.abs(with_it - have * p) > screen * error)
    return out


def fit(cell: np.ndarray, value: np.ndarray, begin: np.ndarray, grades: np.ndarray, dims: int, n_grades: int, steps: int = 5000, rate: float = 0.5, ridge: float = 1e-5, screen: float = 4.0, seed: int = 5) -> Model:
    """Maximum likelihood of the cumulative logits by AdaGrad over mini-batches; thresholds stay ordered.

    The grades are weighted towards balance by the square root of their frequency.
    """
    n = len(grades)
    present = np.unique(grades)
    if not n or len(present) == 1:
        g = int(present[0]) if n else n_grades - 1
        return Model(np.zeros(dims, np.float32), np.where(np.arange(1, n_grades) <= g, -30.0, 30.0))
    rng = np.random.default_rng(seed)
    used = associated(cell, begin, grades, dims, n_grades, screen)
    keep = np.flatnonzero(used[cell])
    begin = np.searchsorted(keep, begin)
    cell, value = (np.cumsum(used) - 1).astype(np.int32)[cell[keep]], value[keep]
    del keep
    all_dims, dims = dims, int(used.sum())
    share = np.bincount(grades, minlength=n_grades) / n
    case_weight = np.where(share > 0, 1 / np.sqrt(np.maximum(share, 1e-9)), 0)
    case_weight = case_weight[grades] / case_weight[grades].mean()
    tail = np.clip([(grades >= k).mean() for k in range(1, n_grades)], 1e-3, 1 - 1e-3)
    w, theta = np.zeros(dims), np.maximum.accumulate(-np.log(tail / (1 - tail)))
    gw, gt = np.full(dims, 1e-6), np.full(n_grades - 1, 1e-6)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    size = np.diff(begin)
    for _ in range(-(-steps * 256 // n)):
        order = rng.permutation(n)
        for i in range(0, n, 256):
            rows = order[i : i + 256]
            at = _vec.ragged(begin[:-1][rows], size[rows])
            c, x, r = cell[at], value[at].astype(np.float64), np.repeat(np.arange(len(rows)), size[rows])
            score = np.bincount(r, w[c] * x, len(rows))
            g = grades[rows]
            # P(g) = S(score - theta_g) - S(score - theta_{g+1}), with theta_0 = -inf and theta_K = +inf
            edge = np.concatenate([[-np.inf], theta, [np.inf]])
            up, down = sigmoid(score - edge[g]), sigmoid(score - edge[g + 1])
            up, down = np.where(g == 0, 1.0, up), np.where(g == n_grades - 1, 0.0, down)
            p = np.maximum(up - down, 1e-9)
            d_up, d_down = up * (1 - up) * case_weight[rows] / p, down * (1 - down) * case_weight[rows] / p
            d_score = d_up - d_down
            grad = np.bincount(c, d_score[r] * x, dims) / len(rows)
            hit = np.unique(c)
            grad = grad[hit] - ridge * w[hit]
            gw[hit] += grad * grad
            w[hit] += rate * grad / np.sqrt(gw[hit])
            gt_now = np.zeros(n_grades - 1)
            np.add.at(gt_now, g[g > 0] - 1, -d_up[g > 0])
            np.add.at(gt_now, g[g < n_grades - 1], d_down[g < n_grades - 1])
            gt_now /= len(rows)
            gt += gt_now * gt_now
            theta = np.maximum.accumulate(theta + 0.2 * rate * gt_now / np.sqrt(gt))
    weights = np.zeros(all_dims, np.float32)
    weights[used] = w
    return Model(weights, theta)


def lowest(ratings: DataFrame, id_name: str, grade_name: str) -> DataFrame:
    """One row per rated document, with the lowest of its grades."""
    r = ratings.where("doc_id is not null and grade is not null")
    return r.groupBy(F.col("doc_id").cast("bigint").alias(id_name)).agg(F.min("grade").cast("int").alias(grade_name))


def added(docs: DataFrame) -> tuple[str, str]:
    """The names of the columns that ``score`` adds."""
    have, out = {c.lower() for c in docs.columns}, []
    for name in ("expected_grade", "tail_probability"):
        while name in have:
            name += "_"
        out.append(name)
    return out[0], out[1]


def flat(column: pa.ChunkedArray, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column in one array, and where each row's begin."""
    values = column.combine_chunks()
    if not len(values):
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    _, ends, data = values.buffers()
    begin = np.frombuffer(ends, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64) // np.dtype(dtype).itemsize
    return (np.frombuffer(data, dtype) if data else np.zeros(0, dtype))[begin[0] : begin[-1]], begin - begin[0]


def train(docs: DataFrame, ratings: DataFrame, spark: SparkSession, n_grades: int = GRADES, sample: int = SAMPLE, dims: int = DIMS, most_cells: int = MOST_CELLS, **how) -> Model:
    """Fits on a bounded sample of the rated documents. ``ratings``: (doc_id, grade)."""
    _shared.small_batches(spark)
    r = lowest(ratings, "__id", "__grade")
    chosen = r.orderBy(F.xxhash64("__id"), "__id").limit(sample)  # at most ``sample`` pairs of numbers
    rows = docs.select(F.col("doc_id").cast("bigint").alias("__id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "__id").select("__id", "__grade", "text")

    def features(batches):
        for batch in batches:
            buf, bounds = _vec.text_buffers(batch.column(2))
            for i, j, b, o in _vec.chunks(buf, bounds):
                c, v, begin = cells(b, o, dims)
                n = np.diff(begin)
                if n.max(initial=0) > most_cells:  # cells of word shapes come last and hash to the least
                    row = np.repeat(np.arange(len(n)), n)
                    rank = np.where(c < dims - SHAPES, _vec.mix(c.astype(U)) | U(1), U(0))
                    order = np.lexsort((rank, row))
                    order = np.sort(order[_vec.ragged(begin[:-1], np.minimum(n, most_cells))])
                    c, v, begin = c[order], v[order], np.concatenate([[0], np.cumsum(np.minimum(n, most_cells))])
                cut = [slice(x, y) for x, y in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array([c[s].tobytes() for s in cut], pa.binary()), pa.array([v[s].astype(np.float16).tobytes() for s in cut], pa.binary())], ["id", "grade", "cells", "values"])

    # by way of the shared folder, since what is collected lies in the JVM's heap several times
    kept = _shared.written(rows.mapInArrow(features, "id bigint, grade int, cells binary, values binary"), spark, "quality-sample")
    got = _shared.read_table(kept)
    _shared.discard(kept)
    got = got.take(pa.array(np.argsort(np.asarray(got["id"]), kind="stable")))  # the same sum order in every run
    (c, begin), (v, _) = flat(got["cells"], np.int32), flat(got["values"], np.float16)
    model = fit(c, v.astype(np.float32), begin, np.asarray(got["grade"]).astype(np.int64), dims, n_grades, **how)
    del got, c, v
    _shared.trim()
    return model


def score(docs: DataFrame, model: Model, spark: SparkSession, keep_grade: int = GRADES - 1) -> DataFrame:
    """All rows with expected_grade and tail_probability (of ``keep_grade`` or better) added; see ``added``."""
    _shared.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # dims numbers
    names = added(docs)
    schema = docs.withColumns(dict.fromkeys(names, F.lit(0.0))).schema
    text_at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            buf, bounds = _vec.text_buffers(batch.column(text_at).cast(pa.large_string()) if pa.types.is_large_string(batch.column(text_at).type) else batch.column(text_at))
            tails = np.zeros((batch.num_rows, len(m.thresholds)))
            for i, j, b, o in _vec.chunks(buf, bounds):
                c, v, begin = cells(b, o, len(m.weights))
                s = np.bincount(np.repeat(np.arange(j - i), np.diff(begin)), m.weights[c].astype(np.float64) * v, j - i)
                tails[i:j] = m.tails(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(1)), pa.array(tails[:, keep_grade - 1])], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels table."""
    return labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), grade(F.col("quality"), F.col("toxic")).alias("grade"))


def select(docs: DataFrame, labels: DataFrame, spark: SparkSession, least: float = 0.5, **how) -> DataFrame:
    """The rows that the classifier keeps, with their grades; toxic text and text of low quality go."""
    ratings = ratings_of(labels)
    model = train(docs, ratings, spark, **how)
    scored = score(docs, model, spark).where(F.col(added(docs)[1]) >= least)
    key, known = _shared.fresh(scored, "id", "grade")
    low = lowest(ratings, key, known).where(F.col(known) < GRADES - 1).select(key)
    if low.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        low = F.broadcast(low)
    return scored.join(low, F.col("doc_id").cast("bigint") == F.col(key), "left_anti")
