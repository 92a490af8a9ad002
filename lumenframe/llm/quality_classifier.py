"""Quality classifier by positive-unlabelled learning.

A text is turned into FEATURES dense features: shares of kinds of characters, statistics of words and lines, and
hashed character trigrams.  A logistic model minimises the non-negative unbiased risk
    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))
over trusted positives (rows labelled 1) and unlabelled texts (any, whatever their label).  The class prior is estimated from
these two alone: the least share that a threshold on a first model's score leaves possible, in unlabelled texts over positives, on
halves that this model was not fitted on.
Training takes at most MOST positives and MOST unlabelled texts, those with the smallest hashes: a
documented bound on the sample, not on what is scored.  Labels, language, source and ids are no features.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

MOST, TRIGRAMS = 8000, 256
LEAST = 0.3
BASIC = 16
FEATURES = BASIC + TRIGRAMS
_KINDS = np.zeros(256, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = 1
_KINDS[48:58] = 2
_KINDS[65:91] = 3
_KINDS[97:123] = 4
_KINDS[[ord(x) for x in ".,;:'\"()-"]] = 5
_KINDS[[ord(x) for x in "#*$%&|<>"]] = 6
_KINDS[[ord(x) for x in "!?"]] = 7
_KINDS[128:] = 8


def features(column) -> np.ndarray:
    """A row of FEATURES for each text of an Arrow column; null and empty texts have a row of zeros but for the first."""
    data, at = c.buffers(column)
    n, size = len(at) - 1, np.diff(at)
    row = np.repeat(np.arange(n), size)
    x = np.zeros((n, FEATURES), np.float32)
    kinds = np.bincount(row * 9 + _KINDS[data], minlength=9 * n).reshape(n, 9)[:, :9]
    length = np.maximum(size, 1)[:, None]
    x[:, 1:9] = kinds[:, 1:] / length
    h, starts, ends, rows = c.words(column, lower=True)
    words = np.diff(rows)
    of = np.repeat(np.arange(n), words)
    many = np.maximum(words, 1)
    x[:, 0] = np.log1p(words) / 10
    x[:, 9] = np.bincount(of, ends - starts, n) / many / 10
    order = np.lexsort((h, of))
    distinct = np.bincount(of[order][c.runs(h[order], of[order])], minlength=n) if len(h) else np.zeros(n)
    x[:, 10] = 1 - distinct / many
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    x[:, 11] = np.bincount(of, same, n) / many
    x[:, 12] = np.bincount(of, ends - starts == 1, n) / many
    x[:, 13] = np.log1p(np.bincount(row, data == 10, n)) / 10
    first = _KINDS[data[starts]] == 3 if len(h) else np.zeros(0, bool)
    x[:, 14] = np.bincount(of, first, n) / many
    x[:, 15] = np.minimum(1, 100 / many)
    low = c.LOWER[data].astype(np.uint32)
    if len(low) > 2:
        tri = ((low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761)) >> np.uint32(24)
        inside = row[:-2] == row[2:]
        x[:, BASIC:] = np.bincount(row[:-2][inside] * TRIGRAMS + tri[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS) / length * 8
        x[:, BASIC:] = np.sqrt(x[:, BASIC:])
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Standardised features, weights and bias."""

    def __init__(self, mean, scale, weights, bias):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid((np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights).astype(np.float64) + self.bias)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimises the non-negative risk by Adam over all rows; where the negative part is below 0 its gradient is reversed."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8).astype(np.float32) for x in (positive, unlabelled))
    w, b = np.zeros(both.shape[1], np.float32), np.float64(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp, gu = prior * (sp - 1) / len(p), np.zeros_like(su)  # of the positive part
        ap, au = -prior * sp / len(p), su / len(u)  # of the negative part
        gp, gu = (gp + ap, au) if negative >= 0 else (-ap, -au)
        g = np.concatenate([p.T @ gp + u.T @ gu + decay * w, [gp.sum() + gu.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - d[:-1].astype(np.float32), b - d[-1]
    return Model(mean, scale, w, b)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled texts, kept within 0.05 and 0.95.

    For a set of scores, the unlabelled texts' share in it is at least the prior times the positives' share; so the
    least quotient of the two, over the sets above a threshold, bounds the prior from above and meets it where the set has
    positives only.  Each threshold keeps LEAST of the positives at least, so that the quotient is not chance.
    """
    half = fit(positive[::2], unlabelled[::2], 0.5)
    p, u = half.score(positive[1::2] if len(positive) > 1 else positive), half.score(unlabelled[1::2] if len(unlabelled) > 1 else unlabelled)
    cuts = np.quantile(p, np.linspace(0, 1 - LEAST, 50))
    shares = [((u >= x).mean(), (p >= x).mean()) for x in cuts]
    return float(np.clip(min(a / b for a, b in shares), 0.05, 0.95))


@c.released
def _featured(batches):
    for b in batches:
        for part in c.pieces(b, "text"):
            x = features(part.column("text"))
            yield pa.record_batch([part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """From docs and the labels given here; leave out of `labels` what is held out.

    Rows without doc_id, label or text are not trained on.  Of a document labelled twice, the larger label counts.
    Without positives the model gives the prior, 0.5, to all.
    """
    c.prepare(docs.sparkSession)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64("id", F.lit(5))
    trusted = known.where("y = 1").orderBy(order, "id").limit(MOST)
    texts = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # MOST ids of each: a bounded sample, first of ids and then of their texts, which are fetched by a broadcast of the ids
    free = texts.select("id").orderBy(F.xxhash64("id", F.lit(6)), "id").limit(MOST).distinct().withColumn("y", F.lit(-1))
    wanted = trusted.select("id", "y").unionByName(free.select("id", "y"))
    rows = texts.join(F.broadcast(wanted), "id").select("y", "text").mapInArrow(_featured, "y int, x binary").toPandas()
    x = np.stack([np.frombuffer(v, np.float32) for v in rows["x"]]) if len(rows) else np.zeros((0, FEATURES), np.float32)
    order = np.lexsort([*x[:, :BASIC].T, rows["y"].to_numpy(np.int64)])  # rows come in any order
    x, y = x[order], rows["y"].to_numpy()[order]
    positive, unlabelled = x[y == 1], x[y == -1]
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0)
    return fit(positive, unlabelled, class_prior(positive, unlabelled))


@c.released
def _score(text: str, name: str, sent, schema: pa.Schema, batches):
    model = sent.value
    for b in batches:
        for part in c.pieces(b, text):
            s = pa.array(np.round(model.score(features(part.column(text))), 9))
            yield pa.record_batch([s if f.name == name else part.column(f.name) for f in schema], schema)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score`, from 0 to 1, of every row; null texts score as empty ones; a clashing name gets an underscore."""
    from pyspark.sql.pandas.types import to_arrow_schema

    c.prepare(docs.sparkSession)
    (name,) = c.fresh(docs, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights
    return docs.mapInArrow(partial(_score, text, name, sent, to_arrow_schema(schema)), schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; the held-out fifth's labels are not learned from."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = c.table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality")
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
