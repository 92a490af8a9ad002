"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Texts are lower-cased, whatever is no letter or digit becomes a space, and runs of spaces one.  An n-gram of NGRAMS characters
counts once a text, in one of 2**BITS buckets.  Spark counts how many labelled texts of either label hold each bucket; its ratio is
    r = log((1 + toxic with it) / sum) - log((1 + others with it) / sum)
and the FEATURES buckets whose ratio is furthest from 0, measured by its standard error, are kept.  A logistic model with features
r * (whether the text holds it) is fitted, weighted to the labels' true shares.  Counts are of COUNTED labelled ids of either label, about,
and weights of MOST of them, those with the smallest hashes: a documented bound on what is learned from, not on what is scored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

NGRAMS, BITS, FEATURES, COUNTED, MOST = (3, 4, 5, 6), 20, 4096, 100_000, 8000
_KEPT = "toxicity characters"


def _characters() -> np.ndarray:
    """The lower-case form of each character of the first plane, a space for what is no letter or digit; others stay."""
    if _KEPT not in c.KEPT:
        low = [chr(i).lower() for i in range(1 << 16)]
        c.KEPT[_KEPT] = np.array([ord(x) if len(x) == 1 and x.isalnum() else i if chr(i).isalnum() else 32 for i, x in enumerate(low)], np.uint32)
    return c.KEPT[_KEPT]


def grams(column) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram of an Arrow text column; a text has a space before and after it, null is empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    size = pc.utf8_length(column).to_numpy().astype(np.int64) + 2
    points = np.frombuffer("".join(f"\n{x}\n" for x in column.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 1 << 16, _characters()[np.minimum(points, (1 << 16) - 1)], points)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    again = np.zeros(len(points), bool)
    again[1:] = (points[1:] == 32) & (points[:-1] == 32) & (row[1:] == row[:-1])
    points, row = points[~again], row[~again]
    buckets, rows, h, n = [], [], points * np.uint32(0x9E3779B1), 1
    while n < max(NGRAMS) and len(points) > n:
        h = (h[:-1] * np.uint32(0x85EBCA6B)) ^ (points[n:] * np.uint32(0xC2B2AE35))
        n += 1
        if n in NGRAMS:
            inside = row[: len(h)] == row[n - 1 :]
            x = h[inside] + np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(12)
            x *= np.uint32(0x297A2D39)
            buckets.append((x >> np.uint32(32 - BITS)).astype(np.int32))
            rows.append(row[: len(h)][inside])
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *buckets]), np.concatenate([none, *rows])


def _once(bucket: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket of a row once, by row: of equal places the one that was written last stays."""
    order = np.argsort(row, kind="stable")
    bucket, row = bucket[order], row[order]
    keep, last = np.zeros(len(row), bool), np.zeros(1 << BITS, np.int32)
    cuts = np.append(c.runs(row), len(row))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part, place = bucket[a:b], np.arange(b - a, dtype=np.int32)
        last[part] = place
        keep[a:b] = last[part] == place
    return bucket[keep], row[keep]


@c.released
def _counted(batches):
    """Texts of a task that hold each bucket, by label."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for b in batches:
        for part in c.pieces(b, "text"):
            y = part.column("y").to_numpy()
            bucket, row = _once(*grams(part.column("text")))
            for k in (0, 1):
                counts[k] += np.bincount(bucket[y[row] == k], minlength=1 << BITS)
    at = np.flatnonzero(counts.any(0))
    for i in range(0, len(at), 1 << 16):
        s = at[i : i + (1 << 16)]
        yield pa.record_batch([pa.array(s.astype(np.int32)), pa.array(counts[0, s]), pa.array(counts[1, s])], names=["bucket", "others", "toxic"])


def counts(labelled: DataFrame) -> DataFrame:
    """bucket, others and toxic: how many of the labelled texts (y, text) hold it, by label; 2**BITS rows at most."""
    return labelled.mapInArrow(_counted, "bucket int, others long, toxic long").groupBy("bucket").agg(F.sum("others").alias("others"), F.sum("toxic").alias("toxic"))


def ratios(counted: DataFrame, features: int = FEATURES) -> DataFrame:
    """bucket and r of the features whose log-count ratio is furthest from 0 by its standard error."""
    sums = counted.agg(F.sum(F.col("toxic") + 1).alias("p"), F.sum(F.col("others") + 1).alias("q")).first()
    r = F.log((F.col("toxic") + 1) / float(sums["p"] or 1)) - F.log((F.col("others") + 1) / float(sums["q"] or 1))
    z = F.abs(F.col("r")) / F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("others") + 1))
    return counted.withColumn("r", r).orderBy(z.desc(), "bucket").limit(features).select("bucket", "r")


def _held(bucket: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every feature that a row holds, each once; place: the feature of each bucket, or -1."""
    feature = place[bucket]
    some = feature >= 0
    both = np.unique(row[some].astype(np.int64) << 32 | feature[some])
    return both >> 32, both & 0xFFFFFFFF


@c.released
def _featured(sent, batches):
    place = sent.value
    for b in batches:
        for part in c.pieces(b, "text"):
            row, feature = _held(*grams(part.column("text")), place)
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            x = [feature[i:j].astype(np.uint16).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.record_batch([part.column("id").cast(pa.string()), part.column("y"), pa.array(x, pa.binary())], names=["id", "y", "x"])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, r: np.ndarray, steps: int = 300, rate: float = 0.02, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of r * presence and the bias, by Adam on the weighted logistic loss over all rows of features."""
    feature = np.concatenate([np.zeros(0, np.uint16), *rows]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    total = weight.sum()
    share = np.clip((weight * y).sum() / total, 1e-6, 1 - 1e-6)
    w, b = np.zeros(len(r)), np.log(share / (1 - share))
    m, v = np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    for step in range(1, steps + 1):
        e = weight * (_sigmoid(np.bincount(row, (r * w)[feature], len(rows)) + b) - y) / total
        g = np.append(r * np.bincount(feature, e[row], len(r)) + decay * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    return w, float(b)


class Model:
    """The feature of each bucket (or -1), what a feature adds to the log odds, and the bias."""

    def __init__(self, place: np.ndarray, adds: np.ndarray, bias: float):
        self.place, self.adds, self.bias = place, adds, bias

    def score(self, column) -> np.ndarray:
        row, feature = _held(*grams(column), self.place)
        return _sigmoid(np.bincount(row, self.adds[feature], len(column)) + self.bias)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """From docs and the labels given here; leave out of `labels` what is held out.

    Rows without doc_id, label or text are not trained on.  Of a document labelled twice, the larger label counts; a doc_id that
    several documents have labels each.  With one label only, all texts score close to it; without labels, 0.5.
    """
    spark = docs.sparkSession
    c.prepare(spark)
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    labelled = texts.join(F.broadcast(_smallest(known, sizes, COUNTED)), "id")  # COUNTED ids of either label, so that no text is shuffled
    counted = c.stored(counts(labelled.select("y", "text")), "buckets")
    chosen = ratios(counted).toPandas()  # FEATURES rows
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen["bucket"].to_numpy(np.int64)] = np.arange(len(chosen))
    sent = spark.sparkContext.broadcast(place)
    sample = _smallest(labelled, sizes, MOST).select("id", "y", "text").mapInArrow(partial(_featured, sent), "id string, y int, x binary")
    got = sample.dropDuplicates(["id"]).toPandas()  # MOST rows of FEATURES numbers at most, of either label
    if not len(got):
        return Model(place, np.zeros(len(chosen)), 0.0)
    got = got.sort_values(["y", "x"], kind="stable")  # rows come in any order
    y = got["y"].to_numpy(np.float64)
    weight = np.where(y == 1, sizes.get(1, 0) / max(1, (y == 1).sum()), sizes.get(0, 0) / max(1, (y == 0).sum()))
    r = chosen["r"].to_numpy(np.float64)
    w, bias = fit([np.frombuffer(x, np.uint16) for x in got["x"]], y, weight, r)
    return Model(place, r * w, bias)


def _smallest(rows: DataFrame, sizes: dict, most: int) -> DataFrame:
    """Rows (id, y) whose hash is under what lets through `most` ids of their label, but for chance."""
    limits = {y: int(-(1 << 63) + min(1.0, most / n) * (1 << 64)) for y, n in sizes.items() if n > most}
    limit = F.lit(None).cast("long")
    for y, x in limits.items():
        limit = F.when(F.col("y") == y, F.lit(x)).otherwise(limit)
    return rows.where(limit.isNull() | (F.xxhash64("id", F.lit(12)) < limit))


@c.released
def _score(text: str, name: str, sent, schema: pa.Schema, batches):
    model = sent.value
    for b in batches:
        for part in c.pieces(b, text):
            s = pa.array(np.round(model.score(part.column(text)), 9))
            yield pa.record_batch([s if f.name == name else part.column(f.name) for f in schema], schema)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score`, from 0 to 1, of every row and its whole text; null texts score as empty ones; a clashing name gets an underscore."""
    from pyspark.sql.pandas.types import to_arrow_schema

    c.prepare(docs.sparkSession)
    (name,) = c.fresh(docs, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a number for each of 2**BITS buckets
    return docs.mapInArrow(partial(_score, text, name, sent, to_arrow_schema(schema)), schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; the held-out quarter's labels are not learned from."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = c.table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
