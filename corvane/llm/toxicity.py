"""Toxicity by cumulative-link ordinal regression over sparse text features.

A text's grade of severity y in 0..K has P(y >= k) = sigmoid(w . x - t_k): one weight vector for all thresholds, and
thresholds kept in order. x has a hashed feature for each word and each longer word's front, valued at the square root
of its count over the fourth root of the text's length, so that neither a long text's chance words nor a few words in
it decide. The result is the expected severity, sum over k of P(y >= k).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize
from .shingles import mixed, word_hashes

_U = np.uint64
BITS = 18
_FRONT = 6
_SLICE = 1 << 20
_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse rows of texts: where each text's entries start (and the last ends), feature numbers, values."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    words, starts, fronts = word_hashes(data, ends, _BETWEEN, _FRONT)
    text_of = np.searchsorted(ends, starts, side="right").astype(np.uint64)
    longer = fronts != 0
    number = np.concatenate((words >> _U(64 - BITS), mixed(fronts[longer] + _U(1)) >> _U(64 - BITS)))
    owner = np.concatenate((text_of, text_of[longer]))
    keys, counts = np.unique((owner << _U(BITS)) | number, return_counts=True)
    rows = (keys >> _U(BITS)).astype(np.int64)
    bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
    totals = np.bincount(rows, weights=counts, minlength=len(texts))
    return bounds, (keys & _U((1 << BITS) - 1)).astype(np.int32), np.sqrt(counts) / totals[rows] ** 0.25


@dataclass
class Ordinal:
    """Weights, and the thresholds of grades 1, 2, ... in order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, bounds: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(values * self.weights[numbers])))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(y >= k) for k = 1, 2, ..., a column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


#: What a feature has to show to get a weight: standard errors between the classes, and texts it is in.
LEAST_Z, LEAST_TEXTS = 5.0, 4


def telling(hot: np.ndarray, cold: np.ndarray, n_hot: int, n_cold: int, least_z: float, least_texts: int) -> np.ndarray:
    """Which features are in toxic and other texts at shares that differ by least_z standard errors or more, and in
    so many texts. hot, cold: how many texts of either kind, of n_hot and n_cold, have each."""
    n1, n0 = max(1, n_hot), max(1, n_cold)
    p = (hot + cold) / (n1 + n0)
    z = (hot / n1 - cold / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    return (np.abs(z) >= least_z) & (hot + cold >= least_texts)


def _steps(gaps: np.ndarray) -> np.ndarray:
    """The thresholds: the first gap, then exp of the others on top of each other, so that they stay in order."""
    return gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))


def loss(w: np.ndarray, gaps: np.ndarray, row_of: np.ndarray, column: np.ndarray, values: np.ndarray, grades: np.ndarray, share: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """The mean negative log-likelihood of the grades with its penalty, and the gradient for (w, gaps). Entries: the
    row, the column in w, and the value of each feature that is there."""
    rows, top = np.arange(len(grades)), len(gaps)
    s = np.bincount(row_of, weights=values * w[column], minlength=len(grades))
    p = np.column_stack((np.ones(len(s)), 1 / (1 + np.exp(-np.clip(s[:, None] - _steps(gaps), -40, 40))), np.zeros(len(s))))
    own = np.maximum(p[rows, grades] - p[rows, grades + 1], 1e-9)
    slope = p * (1 - p)
    upper, lower = slope[rows, grades], slope[rows, grades + 1]
    d_s = -share * (upper - lower) / own
    d_t = np.array([(share * (np.where(grades == k, upper, 0) - np.where(grades == k - 1, lower, 0)) / own).sum() for k in range(1, top + 1)])
    d_gaps = np.array([d_t.sum(), *(d_t[k:].sum() * np.exp(gaps[k]) for k in range(1, top))])
    d_w = np.bincount(column, weights=values * d_s[row_of], minlength=len(w)) + decay * w
    return float(-(share * np.log(own)).sum() + decay / 2 * (w @ w)), np.concatenate((d_w, d_gaps))


def fit(bounds: np.ndarray, numbers: np.ndarray, values: np.ndarray, grades: np.ndarray, shares: np.ndarray, rounds: int = 300, rate: float = 2.0, decay: float = 3e-5, least_z: float = LEAST_Z, least_texts: int = LEAST_TEXTS) -> Ordinal:
    """Maximum likelihood over the telling features with a penalty on the weights, by Adam. shares: how many texts
    each row stands for."""
    top = max(1, int(grades.max(initial=0)))
    row_of = np.repeat(np.arange(len(grades)), np.diff(bounds))
    hot, cold = (np.bincount(numbers[(grades > 0)[row_of] == kind], minlength=1 << BITS) for kind in (True, False))
    kept = telling(hot, cold, int((grades > 0).sum()), int((grades == 0).sum()), least_z, least_texts)[numbers]
    numbers, values, row_of = numbers[kept], values[kept], row_of[kept]
    used, column = np.unique(numbers, return_inverse=True)
    w, gaps = np.zeros(len(used)), np.full(top, 1.0)
    m, v = np.zeros(len(used) + top), np.zeros(len(used) + top)
    share = shares / shares.sum()
    for step in range(1, rounds + 1):
        _, grad = loss(w, gaps, row_of, column, values, grades, share, decay)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) / np.sqrt(1 + step / 20)
        w -= move[: len(used)]
        gaps -= np.clip(move[len(used) :], -0.2, 0.2)
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return Ordinal(weights, _steps(gaps))


def speaking(hot: np.ndarray, cold: np.ndarray, n_hot: int, n_cold: int) -> np.ndarray:
    """Which features are evidence of toxicity: far more common among toxic texts, and in several of them."""
    odds = np.log((hot + 0.5) / (n_hot + 1)) - np.log((cold + 0.5) / (n_cold + 1))
    return (odds > 2) & (hot + 0.5 > 3)


def graded(bounds: np.ndarray, numbers: np.ndarray, values: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Grades of labelled texts: 0 if not toxic; toxic ones 1 or 2, by whether the evidence in them, the share of
    features that are far more common among toxic texts, is below or above the median. The labels know no grades."""
    row_of = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    hot, cold = (np.bincount(numbers[(toxic[row_of] > 0) == kind], minlength=1 << BITS) for kind in (True, False))
    evidence = np.bincount(row_of, weights=values**2 * speaking(hot, cold, int(toxic.sum()), int((toxic == 0).sum()))[numbers], minlength=len(toxic))
    middle = np.median(evidence[toxic > 0]) if toxic.any() else 0.0
    return np.where(toxic > 0, 1 + (evidence > middle), 0).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Some rows at a time, with their texts."""
    for batch in batches:
        at, size, texts = 0, 0, []
        for text in batch.column(column):
            texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
            size += len(texts[-1])
            if size >= _SLICE:
                yield batch.slice(at, len(texts)), texts
                at, size, texts = at + len(texts), 0, []
        if texts:
            yield batch.slice(at), texts


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2500, seed: int = 5) -> Ordinal:
    """Fit on a bounded sample of labelled rows, up to per_class of either label, drawn by hash and weighted to stand
    for all. Labels that are null or not 0 or 1 are left out; of several labels of a text the largest counts.
    Without labels, or with one kind only, nothing is toxic."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = Window.partitionBy("toxic", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(64))).orderBy(F.xxhash64("doc_id", F.lit(seed)))
    some = known.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_class)  # in parts, so that no task ranks a class
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Ordinal(np.zeros(1 << BITS), np.array([40.0, 41.0]))
    sample = [some.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class) for t in (0, 1)]
    sample = materialize(sample[0].unionByName(sample[1]).select("doc_id", "toxic"), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, 2):
            bounds, numbers, values = features(texts)
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x)) for x in (numbers, values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "toxic", "numbers", "vals"])

    texts = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "toxic", "text")
    drawn = materialize(texts.mapInArrow(run, "doc_id long, toxic int, numbers array<int>, vals array<double>"), "features")
    # Whatever the length of the texts, the driver gets counts of at most 2^BITS features, and then only those entries of
    # the texts whose features tell.
    tally = drawn.select("toxic", F.explode("numbers").alias("number")).groupBy("number").agg(F.count_if(F.col("toxic") == 1).alias("hot"), F.count_if(F.col("toxic") == 0).alias("cold")).toArrow()
    seen = {r["toxic"]: r["n"] for r in drawn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    hot, cold = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
    for counts_of, name in ((hot, "hot"), (cold, "cold")):
        counts_of[tally["number"].to_numpy()] = tally[name].to_numpy()
    n_hot, n_cold = seen.get(1, 0), seen.get(0, 0)
    kept = telling(hot, cold, n_hot, n_cold, LEAST_Z, LEAST_TEXTS) | speaking(hot, cold, n_hot, n_cold)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            keep = kept[numbers]
            row_of = np.repeat(np.arange(len(batch)), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row_of[keep], minlength=len(batch))))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (numbers[keep], batch.column(3).flatten().to_numpy(zero_copy_only=False)[keep])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "toxic", "numbers", "vals"])

    got = drawn.mapInArrow(tell, drawn.schema).toArrow().combine_chunks()
    # Equal whatever order the rows come in.
    got = got.sort_by([("doc_id", "ascending")])
    if not len(got):
        return Ordinal(np.zeros(1 << BITS), np.array([40.0, 41.0]))
    numbers, values = (got[c].combine_chunks() for c in ("numbers", "vals"))
    bounds = np.concatenate(([0], np.cumsum(numbers.value_lengths().to_numpy(zero_copy_only=False))))
    numbers, values, toxic = numbers.flatten().to_numpy(), values.flatten().to_numpy(), got["toxic"].to_numpy()
    drawn = {t: max(1, int((toxic == t).sum())) for t in (0, 1)}
    shares = np.where(toxic == 1, counts[1] / drawn[1], counts[0] / drawn[0])
    return fit(bounds, numbers, values, graded(bounds, numbers, values, toxic), shares)


def score(docs: DataFrame, model: Ordinal, text_col: str = "text", added: tuple[str, str, str] = ("severity", "grade", "toxic")) -> DataFrame:
    """docs with severity (the expected grade), grade (the largest k with P(y >= k) of a half or more) and toxic
    (grade 1 or more), under the names in added. A null text is empty; an empty one has no features. Repeated rows come
    out once each; equal texts get equal results. Empty input: no rows."""
    schema = docs.select("*", F.lit(0.0).alias(added[0]), F.lit(0).alias(added[1]), F.lit(True).alias(added[2])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = docs_columns.index(text_col)
        for batch, texts in _texts(batches, at):
            p = model.at_least(model.scores(*features(texts)))
            grade = (p >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(grade > 0)], names=[*batch.schema.names, *added])

    docs_columns = docs.columns
    return docs.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not toxic, with their columns. Null and empty texts have no features and are scored by
    the thresholds alone; repeated rows stay or go together. Empty input: no rows."""
    severity, grade, toxic = (fresh(docs, c) for c in ("_severity", "_grade", "_toxic"))
    scored = score(docs, learn(docs, labels), added=(severity, grade, toxic))
    return scored.where(~F.col(toxic)).select(*[F.col(c) for c in docs.columns])


def severities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity, grade, toxic of each row of docs, by a model fitted on the labels. Rows with a null or
    repeated doc_id come out once each. Other columns play no part. Empty input: no rows."""
    return score(docs.select("doc_id", "text"), learn(docs, labels)).select("doc_id", "severity", "grade", "toxic")
