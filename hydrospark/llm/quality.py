"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good texts, the unlabelled set is web text of
any quality, and the class prior is estimated from the labelled rows. The
non-negative risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))  of a
logistic model over whole-text features is minimised by gradient descent; when
the bracket turns negative its gradient is reversed, as the estimator asks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrospark.llm.common import byte_slices, without

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _HIGH, _COMMON, _OTHER = range(8)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LOWER, _UPPER, _DIGIT, _HIGH
_CLASS[[32, 9]], _CLASS[[10, 13]] = _SPACE, _LINE
_CLASS[[ord(c) for c in ".,;:'-"]] = _COMMON
_HASHED = 64
N_FEATURES = 19 + _HASHED


def features(data: bytes | None) -> np.ndarray:
    """Features of a whole text: character class shares, word, sentence and
    line statistics, repetition, and hashed shares of adjacent character class
    and letter pairs. An empty text has its own flag."""
    out = np.zeros(N_FEATURES, dtype=np.float64)
    if not data:
        out[0] = 1.0
        return out
    raw = np.frombuffer(data, dtype=np.uint8)
    cls = _CLASS[raw]
    n = len(raw)
    share = np.bincount(cls, minlength=8) / n
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    nw, nl = max(len(words), 1), max(len(lines), 1)
    distinct = len(set(words))
    change = float(np.count_nonzero(cls[1:] != cls[:-1])) / n
    same = float(np.count_nonzero(raw[1:] == raw[:-1])) / n
    out[1:9] = share
    out[9:19] = (np.log1p(len(words)), (n - len(words)) / nw / 10, distinct / nw, np.log1p(distinct), len(set(lines)) / nl,
                 np.log1p(n / nl), change, same, share[_OTHER] * n / nw, data.count(b".") / nw)
    pairs = (raw[:-1].astype(np.int64) * 31 + raw[1:]) % _HASHED
    out[19:] = np.sqrt(np.bincount(pairs, minlength=_HASHED) / max(n - 1, 1))
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # one per expanded feature, the last is the bias
    prior: float


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, z[:, :19] ** 2 / 4, np.ones((len(z), 1))], axis=1)


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * t))


def pu_risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(risk, bracket, step direction) of weights ``w``.

    With the logistic loss, R_p(+) and R_p(-) the mean losses of the positives
    as 1 and as 0 and R_u(-) that of the unlabelled rows as 0, the bracket is
    R_u(-) - prior * R_p(-) and the risk prior * R_p(+) + max(0, bracket). The
    direction is the risk's gradient; where the bracket is negative, that of
    minus the bracket, which leads out of there."""
    tp, tu = positive @ w, unlabelled @ w
    sp, su = _sigmoid(tp), _sigmoid(tu)
    grad_pos = positive.T @ (sp - 1) / len(positive)
    grad_rest = unlabelled.T @ su / len(unlabelled) - prior * (positive.T @ sp) / len(positive)
    as_one = np.logaddexp(0, -tp).mean()
    rest = np.logaddexp(0, tu).mean() - prior * np.logaddexp(0, tp).mean()
    risk = prior * as_one + max(0.0, rest)
    return float(risk), float(rest), prior * grad_pos + grad_rest if rest >= 0 else -grad_rest


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05,
             decay: float = 1e-3) -> Model:
    """Adam on the non-negative PU risk with logistic loss."""
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(axis=0), every.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    p, u = _expand(positive, mean, scale), _expand(unlabelled, mean, scale)
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = pu_risk(w, p, u, prior)[2] + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, w, prior)


def score_matrix(model: Model, x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * (_expand(x, model.mean, model.scale) @ model.weights)))


def _featurised(docs: DataFrame) -> DataFrame:
    """(x) of rows (text): the features as packed doubles."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for _, texts in byte_slices(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([features(t).tobytes() for t in texts], pa.binary())], names=["x"])

    return docs.mapInArrow(run, "x binary")


def _matrix(df: DataFrame) -> np.ndarray:
    data = b"".join(bytes(r["x"]) for r in df.collect())
    return np.frombuffer(data, dtype=np.float64).reshape(-1, N_FEATURES)


def _thinned(df: DataFrame, key: str, bound: int, salt: int) -> DataFrame:
    """All rows, or about ``bound`` of them chosen by the hash of their key."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * bound / n))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
        label_col: str = "quality", where: Column | None = None, max_positive: int = 20_000,
        max_unlabelled: int = 40_000, steps: int = 600) -> Model | None:
    """Fit on the rows of ``docs`` and ``labels`` for which ``where`` (over the
    id column) holds; None if there is no positive row.

    Positives are documents with label 1, the unlabelled set all documents of
    the fold whatever their label. The prior is the share of 1 among all labelled
    rows of the fold: known negatives enter it and nothing else. The classifier is fitted on about
    ``max_positive`` positives and ``max_unlabelled`` unlabelled rows at most,
    chosen by id hash (rows without an id all or none); only their features, as
    packed bytes, reach the driver. Null labels count for nothing; repeated
    labels are taken once; repeated documents and null texts (empty ones) count
    as often as they stand there.
    """
    key = F.col(f"`{id_col}`")
    fold = docs if where is None else docs.where(where)
    fold = fold.select(key.alias("_id"), F.col(f"`{text_col}`").alias("text"))
    known = labels if where is None else labels.where(where)
    known = known.select(key.alias("_id"), F.col(f"`{label_col}`").alias("y")).where(
        "y is not null and _id is not null").distinct()
    n, ones = known.agg(F.count(F.lit(1)), F.sum(F.when(F.col("y") == 1, 1).otherwise(0))).first()
    if not ones:
        return None
    chosen = _thinned(known.where("y = 1").select("_id").distinct(), "_id", max_positive, 1)
    positive = _matrix(_featurised(fold.join(F.broadcast(chosen), "_id", "left_semi").select("text")).limit(
        2 * max_positive))
    unlabelled = _matrix(_featurised(_thinned(fold, "_id", max_unlabelled, 2).select("text")).limit(
        2 * max_unlabelled))
    if not len(positive):
        return None
    prior = min(max(ones / n, 0.02), 0.98)
    return fit_nnpu(positive, unlabelled, prior, steps)


def score_quality(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns and rows of ``docs`` plus ``score`` (0 to 1) and ``predicted``.

    Only the text is an input, so repeated rows get one score. Null and empty
    texts get the score of the empty text; without a model every score is 0.5.
    Whole texts are read in slices of
    bounded size. Input columns of these names are replaced. An empty table
    stays empty.
    """
    import pyarrow as pa

    base = without(docs, "score", "predicted")
    index = base.columns.index(text_col)

    def run(batches):
        for b in batches:
            parts = [score_matrix(model, np.stack([features(t) for t in texts])) if model
                     else np.full(len(texts), 0.5) for _, texts in byte_slices(b.column(index))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=[*b.schema.names, "score", "predicted"])

    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    return base.mapInArrow(run, schema)
