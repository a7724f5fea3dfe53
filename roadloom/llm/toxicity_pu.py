"""Toxicity by non-negative positive-unlabelled learning over words and word starts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import held_out, sample_share, table

#: Bounds of the fitting sample: confirmed toxic rows, and rows of all documents, whatever their labels.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 16000
MAX_FEATURES, LEAST_DOCS, START = 2048, 5, 5
SEED = 3
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Weights by feature, and the score's offset."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.bias + sum(get(f, 0.0) for f in features(text))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))


def features(text: str | None) -> set[str]:
    """The different words of a whole text in lower case, and with a leading ``^`` the starts of longer ones."""
    words: set[str] = set()
    for chunk in set((text or "").lower().split()):
        if chunk.isalpha():
            words.add(chunk)
        else:
            words.update(_LETTERS.findall(chunk))
    return words | {"^" + w[:START] for w in words if len(w) > START}


def risk(z: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the PU risk at log-odds ``z``: that of positives, and that of negatives, which may be under zero."""
    loss_neg = np.logaddexp(0.0, z)
    loss_pos = loss_neg - z
    return prior * loss_pos[is_p].mean(), loss_neg[~is_p].mean() - prior * loss_neg[is_p].mean()


def risk_slopes(z: np.ndarray, is_p: np.ndarray, prior: float) -> np.ndarray:
    """Slopes in ``z`` of the sum of both parts; where the second is under zero, of its negative alone."""
    n_p = int(is_p.sum())
    s = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    negative = np.where(is_p, -prior * s / n_p, s / (len(z) - n_p))
    if risk(z, is_p, prior)[1] < 0:
        return -negative
    return negative + np.where(is_p, prior * (s - 1) / n_p, 0.0)


def fit_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, steps: int = 600, rate: float = 0.05
) -> tuple[np.ndarray, float]:
    """Logistic weights and bias that minimise the non-negative PU risk.

    The risk is ``prior * P[loss(+)] + max(0, U[loss(-)] - prior * P[loss(-)])``:
    negatives are what unlabelled rows hold beyond their share of positives. Where that
    estimate falls under zero the step climbs it again, and follows nothing else,
    so that the weights can't win by calling every unlabelled row negative.
    """
    rows = [*positive, *unlabelled]
    at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)] or [np.zeros(0, int)]).astype(np.int64)
    col = np.concatenate(rows or [np.zeros(0, int)]).astype(np.int64)
    n_p, n_u = len(positive), len(unlabelled)
    is_p = np.arange(n_p + n_u) < n_p
    w, b = np.zeros(size), np.log(prior / (1 - prior))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(at, weights=w[col], minlength=n_p + n_u)
        slope = risk_slopes(z, is_p, prior)
        g = np.append(np.bincount(col, weights=slope[at], minlength=size) + 1e-4 * w, slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
    max_features: int = MAX_FEATURES,
) -> Model:
    """Fits on learning folds: confirmed toxic rows against documents taken whatever their labels, if they have any.

    Both samples are drawn by a hash of doc_id, of about ``max_positive`` and
    ``max_unlabelled`` rows. The class prior is the toxic share of the labelled
    rows; nothing else is read off rows that aren't toxic. Features are words and word starts in at
    least ``LEAST_DOCS`` positives, the ``max_features`` most over-represented. A document with
    labels that differ counts as toxic. Rows without a text or id don't train. Without
    a positive or an unlabelled row, or if all labelled rows are toxic, every score is 0.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n, n_p = marks.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n_u = texts.count()
    if not n_u or not n_p or n_p == n:
        return Model({}, -30.0)
    prior = n_p / n
    drawn = marks.where((F.col("toxic") == 1) & (sample_share(F.col("doc_id"), SEED) < max_positive / n_p))
    # bounded by the parameters, whatever the tables' size
    joined = texts.join(F.broadcast(drawn.select("doc_id", F.lit(True).alias("p"))), "doc_id", "left")
    in_u = sample_share(F.col("doc_id"), SEED + 1) < max_unlabelled / n_u
    sample = joined.select(F.coalesce("p", F.lit(False)).alias("p"), in_u.alias("u"), "text").where("p OR u")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_p: Counter[str] = Counter()
        in_u: Counter[str] = Counter()
        for batch in batches:
            for p, u, text in zip(*(batch.column(c).to_pylist() for c in ("p", "u", "text")), strict=True):
                found = features(text)
                if p:
                    in_p.update(found)
                if u:
                    in_u.update(found)
        names = list(in_p)
        arrays = [pa.array(names, pa.string()), pa.array([in_p[x] for x in names], pa.int64()), pa.array([in_u[x] for x in names], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["feature", "n_p", "n_u"])

    counts = sample.mapInArrow(counted, "feature string, n_p long, n_u long").groupBy("feature")
    counts = counts.agg(F.sum("n_p").alias("n_p"), F.sum("n_u").alias("n_u")).where(F.col("n_p") >= LEAST_DOCS)
    share_p, share_u = F.col("n_p") / F.lit(float(min(n_p, max_positive))), (F.col("n_u") + 1) / F.lit(float(min(n_u, max_unlabelled)))
    lift = share_p * F.log(share_p / share_u)
    vocabulary = [r.feature for r in counts.orderBy(lift.desc(), "feature").limit(max_features).collect()]
    index = {f: i for i, f in enumerate(sorted(vocabulary))}

    def indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[index[f] for f in features(t.as_py()) if f in index] for t in batch.column("text")]
            arrays = [batch.column("p"), batch.column("u"), pa.array([sorted(r) for r in rows], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["p", "u", "x"])

    rows = sample.mapInArrow(indexed, "p boolean, u boolean, x array<int>").collect()
    rows.sort(key=lambda r: (r.p, r.u, r.x))
    positive, unlabelled = ([np.array(r.x, dtype=np.int64) for r in rows if r[k]] for k in ("p", "u"))
    if not positive or not unlabelled:
        return Model({}, -30.0)
    w, b = fit_nnpu(positive, unlabelled, max(1, len(index)), prior)
    return Model({f: float(w[i]) for f, i in index.items()}, b)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with the column ``into`` (0 to 1); null and empty texts get the offset's score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, into])

    kept = docs.drop(into)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(into, T.DoubleType())]))


def op3_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the folds that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under a half stay; all others, and only they, go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, "_toxicity").where("_toxicity < 0.5").select(docs.columns)
