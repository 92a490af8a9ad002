"""Quality rules: counts of a text, and its perplexity under an n-gram model of the whole corpus.

The model is a modified Kneser-Ney model of order ORDER over characters.  Digits, capitals, spaces and a few groups of
marks each count as one character, as perplexity filters do; letters of all scripts stay as they are, so the model
grows with the corpus.  Spark counts the n-grams of every text, derives the lower orders' continuation counts and the
back-off weights, and stores each order as hash arrays sorted by hash: Parquet files of at most about BLOCK entries in
the shared folder.  A task that scores texts brings each section's distinct n-grams to the arrays, block by block, by
binary search; it keeps at most KEPT_BLOCKS blocks.  Nothing of the model goes through the driver or is broadcast but
the files' names and four counts of counts an order.

A text is rejected if its perplexity lies outside its language's band, which is set by the quartiles of log
perplexity over that language's texts.  Languages of few texts share one band.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

ORDER, SECTION = 4, 1 << 20  # characters of an n-gram; characters that are worked on at once
CODE_BITS = 16
ALPHABET = 1 << CODE_BITS  # code points that one section's packed n-grams tell apart; a section with more is cut
BLOCK, KEPT_BLOCKS = 1 << 15, 128
_PAD = ORDER - 1
_BASE = c.U(0x9FB21C651E98DF25)


def _classes() -> np.ndarray:
    """What each code point below 0x3000 counts as."""
    t = np.arange(0x3000, dtype=np.uint32)
    t[0x30:0x3A] = ord("0")
    for marks in (" \t\x0b\x0c\r", ",;:", "!?", "'\"", "-/()[]", "#*$%&|<>"):
        t[[ord(x) for x in marks]] = ord(marks[0])
    t[[p for p in range(0x41, 0x3000) if chr(p).isupper()]] = ord("A")
    return t


_CLASSES = _classes()


def points_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(text: str | None) -> np.ndarray:
    p = points_of(text)
    return _CLASSES[p] if not len(p) or p.max() < 0x3000 else np.where(p < 0x3000, _CLASSES[np.minimum(p, 0x2FFF)], p).astype(np.uint32)


def _sections(texts: list[str | None]):
    """Lists of (number of the text, its code points after ORDER - 1 that precede them), SECTION in all at most."""
    held, size = [], 0
    for i, t in enumerate(texts):
        full = np.concatenate([np.zeros(_PAD, np.uint32), symbols(t)])
        for at in range(0, len(full) - _PAD, SECTION):
            piece = full[at : at + SECTION + _PAD]
            if held and size + len(piece) > SECTION + _PAD:
                yield held
                held, size = [], 0
            held.append((i, piece))
            size += len(piece)
    if held:
        yield held


def grams(held: list[tuple[int, np.ndarray]]):
    """Of a section, in parts of at most ALPHABET code points: texts' numbers and sizes, packed n-grams, alphabet (None: the code points themselves)."""
    points = np.concatenate([p for _, p in held])
    alphabet = None
    if points.max() >= ALPHABET:
        alphabet, points = np.unique(points, return_inverse=True)
        if len(alphabet) > ALPHABET:
            if len(held) > 1:
                halves = held[: len(held) // 2], held[len(held) // 2 :]
            else:
                (i, p), at = held[0], len(held[0][1]) // 2
                halves = [(i, p[: at + _PAD])], [(i, p[at:])]
            for h in halves:
                yield from grams(h)
            return
    keep = np.ones(len(points), bool)
    size = np.array([len(p) for _, p in held])
    for at in np.cumsum(size) - size:
        keep[at : at + _PAD] = False
    key = points.astype(c.U)
    for k in range(1, ORDER):
        key[k:] |= points[:-k].astype(c.U) << c.U(CODE_BITS * k)
    yield np.array([i for i, _ in held]), size - _PAD, key[keep], alphabet


def unpacked(keys: np.ndarray, alphabet: np.ndarray | None) -> np.ndarray:
    """Code points of packed n-grams, a row each."""
    codes = np.stack([(keys >> c.U(CODE_BITS * k)) & c.U(ALPHABET - 1) for k in range(_PAD, -1, -1)], 1).astype(np.uint32)
    return codes if alphabet is None else alphabet[codes].astype(np.uint32)


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = c.runs(keys)
    return keys[at], np.add.reduceat(counts[order], at)


@c.released
def _count(text: str, batches):
    """N-grams and their counts, summed over as many texts as fit in 2 * SECTION distinct ones."""
    c.KEPT.clear()

    def told(keys, counts, alphabet):
        s = unpacked(keys, alphabet).tobytes().decode("utf-32-le", "surrogatepass")
        for at in range(0, len(keys), 1 << 17):
            names = [s[i : i + ORDER] for i in range(at * ORDER, min(len(s), (at + (1 << 17)) * ORDER), ORDER)]
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(counts[at : at + (1 << 17)], pa.int64())], names=["gram", "n"])

    parts, size = [], 0
    for b in batches:
        for piece in c.pieces(b, text):
            for held in _sections(piece.column(text).to_pylist()):
                for _, _, key, alphabet in grams(held):
                    keys, counts = np.unique(key, return_counts=True)
                    if alphabet is not None:
                        yield from told(keys, counts, alphabet)
                        continue
                    parts.append((keys, counts))
                    size += len(keys)
                    if size > 2 * SECTION:
                        parts = [_merged(parts)]
                        size = len(parts[0][0])
                        if size > SECTION:
                            yield from told(*parts[0], None)
                            parts, size = [], 0
    if parts:
        yield from told(*_merged(parts), None)


def gram_hash(points: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of code points; the length counts too."""
    h = np.full(len(points), points.shape[1] + 1, c.U)
    for k in range(points.shape[1]):
        h = h * _BASE + points[:, k] + c.U(1)
    return c.mix(h)


def _hashed(width: dict[str, int], parts: dict[str, int], batches):
    """Of (kind, gram, value): the gram's hash and its part of the array; a kind's grams have all one width."""
    for b in batches:
        kinds, names = b.column("kind").to_pylist(), b.column("gram").to_pylist()
        hashes, part = np.zeros(len(kinds), c.U), np.zeros(len(kinds), np.int32)
        for kind in set(kinds):
            at = [i for i, k in enumerate(kinds) if k == kind]
            points = points_of("".join(names[i] for i in at)).reshape(len(at), width[kind])
            hashes[at] = gram_hash(points)
            part[at] = c.bucket_of(hashes[at], parts[kind])
        yield pa.record_batch([b.column("kind"), pa.array(part), pa.array(hashes.view(np.int64)), b.column("value")], names=["kind", "part", "hash", "value"])


class Model:
    """Where the sorted hash arrays are: by kind (p: log probability, g: log back-off weight, each with its order) the files in order of hash."""

    def __init__(self, files: dict[str, dict[int, str]], parts: dict[str, int], unseen: float):
        self.files, self.parts, self.unseen = files, parts, unseen

    def block(self, path: str) -> tuple[np.ndarray, np.ndarray]:
        if path not in c.KEPT:
            while len(c.KEPT) >= KEPT_BLOCKS:
                c.KEPT.pop(next(iter(c.KEPT)))
            fs, name = c.file_system(path)
            t = pq.read_table(name, filesystem=fs, columns=["hash", "value"], partitioning=None)
            hashes, values = t["hash"].to_numpy().view(c.U), t["value"].to_numpy()
            order = np.argsort(hashes, kind="stable")  # sorted as written: nothing to do but to make sure
            c.KEPT[path] = hashes[order], values[order]
        return c.KEPT[path]

    def find(self, kind: str, points: np.ndarray) -> np.ndarray:
        """The values of rows of code points, NaN where there is none."""
        key = f"{kind}{points.shape[1] + (kind == 'g')}"
        hashes, out = gram_hash(points), np.full(len(points), np.nan, np.float32)
        part = c.bucket_of(hashes, max(1, self.parts.get(key, 1)))
        order = np.argsort(part, kind="stable")
        for p, s in c.slices(part[order]):
            if (path := self.files.get(key, {}).get(p)) is None:
                continue
            at, (known, values) = order[s], self.block(path)
            where = np.searchsorted(known, hashes[at])
            where[where == len(known)] = 0
            out[at] = np.where(known[where] == hashes[at], values[where], np.nan)
        return out

    def log_probability(self, points: np.ndarray) -> np.ndarray:
        """Of each row's last character after the others."""
        out, weight, todo = np.full(len(points), self.unseen, np.float64), np.zeros(len(points)), np.arange(len(points))
        for k in range(points.shape[1], 0, -1):
            if not len(todo):
                break
            p = self.find("p", points[todo, -k:])
            out[todo] = np.where(np.isnan(p), out[todo], p + weight[todo])
            todo = todo[np.isnan(p)]
            weight[todo] += np.nan_to_num(self.find("g", points[todo, -k:-1])) if len(todo) else 0
        out[todo] += weight[todo]
        return out


def train(docs: DataFrame, text: str = "text") -> Model:
    """Of all texts of docs; null and empty texts have no n-grams."""
    spark = docs.sparkSession
    c.prepare(spark)
    counted = docs.select(text).mapInArrow(partial(_count, text), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    levels = {ORDER: c.stored(counted, "grams")}
    for k in range(ORDER - 1, 0, -1):  # in how many n+1-grams an n-gram stands last
        levels[k] = levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
    lower = None
    for k in range(ORDER - 1, 0, -1):
        one = levels[k].withColumn("level", F.lit(k))
        lower = one if lower is None else lower.unionByName(one)
    lower = c.stored(lower, "grams-lower")
    levels |= {k: lower.where(F.col("level") == k).select("gram", "n") for k in range(1, ORDER)}
    every = lower.unionByName(levels[ORDER].withColumn("level", F.lit(ORDER)))
    told = every.groupBy("level").agg(F.count("*").alias("size"), F.sum("n").alias("total"), *(F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4))).collect()
    about = {r["level"]: r for r in told}
    if not about:
        return Model({}, {}, 0.0)
    unseen = float(np.log(1 / (about[1]["size"] + 1)))
    rows, below, parts = None, None, {}
    for k in range(1, ORDER + 1):
        d = discounts(about[k])
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        own = levels[k].select("gram", "n", F.substring("gram", 1, k - 1).alias("ctx"), off.alias("off"))
        if k == 1:  # one context: its sums are known from the counts of counts
            n = about[1]
            lost = d[0] * n["n1"] + d[1] * n["n2"] + d[2] * (n["size"] - n["n1"] - n["n2"])
            p = own.select("gram", ((F.col("n") - F.col("off")) / n["total"] + lost / n["total"] * float(np.exp(unseen))).alias("p"))
            weights = spark.createDataFrame([("", lost / n["total"])], "gram string, p double")
        else:
            ctx = own.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("off").alias("lost"))
            p = own.join(ctx, "ctx").withColumn("tail", F.substring("gram", 2, k - 1)).join(below.select(F.col("gram").alias("tail"), F.col("p").alias("q")), "tail")
            p = p.select("gram", ((F.col("n") - F.col("off") + F.col("lost") * F.col("q")) / F.col("total")).alias("p"))
            weights = ctx.select(F.col("ctx").alias("gram"), (F.col("lost") / F.col("total")).alias("p"))
        both = p.withColumn("kind", F.lit(f"p{k}")).unionByName(weights.withColumn("kind", F.lit(f"g{k}")))
        rows, below = both if rows is None else rows.unionByName(both), p
        parts |= {f"p{k}": -(-about[k]["size"] // BLOCK), f"g{k}": -(-about[max(1, k - 1)]["size"] // BLOCK)}
    width = {f"{kind}{k}": k - (kind == "g") for kind in "pg" for k in range(1, ORDER + 1)}
    rows = rows.select("kind", "gram", F.log("p").cast("float").alias("value"))
    rows = rows.mapInArrow(partial(_hashed, width, parts), "kind string, part int, hash long, value float")
    folder = c.scratch(spark, "model")
    rows.repartition(min(sum(parts.values()), c.partitions(spark)), "kind", "part").sortWithinPartitions("kind", "part", "hash").write.partitionBy("kind", "part").parquet(folder)
    files: dict = {}
    for path in spark.read.parquet(folder).inputFiles():
        kind, part = re.search(r"kind=(\w+)/part=(\d+)/", path).groups()
        if int(part) in files.setdefault(kind, {}):
            raise ValueError(f"two files of part {part} of {kind}: unset spark.sql.files.maxRecordsPerFile")
        files[kind][int(part)] = path
    return Model(files, parts, unseen)


def discounts(n) -> list[float]:
    """Of n-grams seen once, twice and more often, from the counts of counts; within 0.05 and 0.95 of the count."""
    ones = [float(n[f"n{i}"]) for i in (1, 2, 3, 4)]
    y = ones[0] / (ones[0] + 2 * ones[1]) if ones[0] + ones[1] else 0.0
    return [min(max(i - (i + 1) * y * ones[i] / ones[i - 1] if ones[i - 1] else 0.5 * i, 0.05 * i), 0.95 * i) for i in (1, 2, 3)]


def rules(column) -> dict[str, np.ndarray]:
    """Of a text column: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    h, _, _, rows = c.words(column)
    n = len(rows) - 1
    w, fits = c.windows(h, rows, 3)
    row = np.repeat(np.arange(n), np.diff(rows))
    at = np.flatnonzero(fits)
    order = at[np.argsort(w[at], kind="stable")]
    order = order[np.argsort(row[order], kind="stable")]
    marks = np.zeros(len(h), bool)
    if len(order):
        same = (w[order][1:] == w[order][:-1]) & (row[order][1:] == row[order][:-1])
        marks[order[1:][same]] = True
        marks[order[:-1][same]] = True
    covered = np.concatenate([[0], np.cumsum(c.covered(marks, 3))]) if len(h) else np.zeros(1, int)
    texts = column.to_pylist()
    chars, symbols_, lines = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        if t:
            chars[i] = len(t) - sum(t.count(x) for x in " \t\n\x0b\x0c\r")
            symbols_[i] = sum(t.count(x) for x in "#*$%&|<>")
            real = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            lines[i] = len(real) - len(set(real))
    return {"n_words": np.diff(rows), "word_chars": chars, "n_symbols": symbols_, "n_dup_lines": lines, "n_repeat_words": np.diff(covered[rows])}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _spread(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values of keys, all of which are in the sorted array: by a table of slots, and by search where slots clash."""
    bits = max(10, int(8 * len(known)).bit_length())
    slot = lambda k: (k * c.U(0x9E3779B97F4A7C15)) >> c.U(64 - bits)
    table = np.zeros(1 << bits, np.int32)
    table[slot(known)] = np.arange(len(known))
    at = table[slot(keys)]
    wrong = np.flatnonzero(known[at] != keys)
    at[wrong] = np.searchsorted(known, keys[wrong])
    return values[at]


def losses(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the sum of negative log probabilities of its characters, and their number."""
    total, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for held in _sections(texts):
        for who, n, key, alphabet in grams(held):
            known = np.unique(key)
            logs = _spread(key, known, model.log_probability(unpacked(known, alphabet)))
            upto = np.concatenate([[0.0], np.cumsum(logs)])
            at = np.concatenate([[0], np.cumsum(n)])
            np.add.at(total, who, -np.diff(upto[at]))
            np.add.at(size, who, n)
    return total, size


@c.released
def _score(text: str, model: Model, names: tuple, schema: pa.Schema, batches):
    c.KEPT.clear()
    for b in batches:
        for part in c.pieces(b, text):
            column = part.column(text)
            counts = rules(column)
            total, size = losses(model, column.to_pylist())
            # in whole millionths, so that sums over a language do not depend on their order
            loss = np.round(total / np.maximum(size, 1) * 1e6).astype(np.int64)
            new = dict(zip(names, [*(pa.array(counts[k], pa.int64()) for k in COUNTS), pa.array(loss, pa.int64(), mask=size == 0)], strict=True))
            yield pa.record_batch([new.get(f.name) if f.name in new else part.column(f.name) for f in schema], schema)


def scored(docs: DataFrame, text: str = "text", model: Model | None = None) -> tuple[DataFrame, list[str]]:
    """docs with the five counts and `log_perplexity` (millionths of a nat a character; null if empty), and their names."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = c.fresh(docs, *COUNTS, "log_perplexity")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    return docs.mapInArrow(partial(_score, text, model or train(docs, text), tuple(names), to_arrow_schema(schema)), schema), names


def base_failed(names: list[str]):
    return (F.col(names[0]) < 50) | (100 * F.col(names[4]) > 50 * F.col(names[0]))


BIN = 1000  # millionths: quartiles are exact to a thousandth of a nat


def bands(rows: DataFrame, names: list[str], lang: str, below: float, above: float, least: int) -> DataFrame:
    """lang, middle, and how far the band reaches under and over it, of every language with `least` texts or more, and of the rest together (`pooled`)."""
    good = rows.where(~base_failed(names) & F.col(names[5]).isNotNull())
    bins = good.groupBy(F.col(lang).alias("lang"), F.floor(F.col(names[5]) / BIN).alias("bin")).agg(F.count("*").alias("n"))
    bins = bins.withColumn("pooled", F.sum("n").over(Window.partitionBy("lang")) < least)
    bins = bins.withColumn("lang", F.when(~F.col("pooled"), F.col("lang")))
    bins = bins.groupBy("lang", "pooled", "bin").agg(F.sum("n").alias("n"))
    key = Window.partitionBy("lang", "pooled")
    bins = bins.withColumn("upto", F.sum("n").over(key.orderBy("bin"))).withColumn("total", F.sum("n").over(key))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), (F.col("bin") + 0.5) * BIN / 1e6))
    found = bins.groupBy("lang", "pooled").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(0.005))
    return found.select("lang", "pooled", ((F.col("q1") + F.col("q3")) / 2).alias("middle"), (spread * (below + 0.5)).alias("under"), (spread * (above + 0.5)).alias("over"))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", below: float = 2.0, above: float = 2.0, least: int = 100, keep_text: bool = True) -> DataFrame:
    """docs with the five counts, `log_perplexity`, `base_failed` and `kept`; without the text if it is not to be kept.

    Words are runs of what is neither a space nor 0x09-0x0D.  A text fails the base rules with under 50 words, or if
    over half of them lie in 3-word windows that it repeats.  It is kept if it passes and its log
    perplexity lies in its language's band (ends included): from `below` quartile ranges below the lower quartile (boilerplate,
    lists) to `above` above the upper (garbled text), each times sqrt(1 + 50 / n_words), since short texts scatter more.  A null text is empty and fails; a
    null language is one of its own (pooled with the rare if under `least` texts).  Repeated rows each count; clashing
    names of new columns get an underscore.  Texts are scored once: the rows are stored with what they scored.
    """
    rows, names = scored(docs, text)
    rows = c.stored(rows if keep_text else rows.drop(text), "perplexity")
    few = c.stored(bands(rows, names, lang, below, above, least), "bands")
    failed, kept, tongue, *limits = c.fresh(rows, "base_failed", "kept", "_lang", "_middle", "_under", "_over")
    rows = rows.withColumn(failed, base_failed(names))
    rest = few.where("pooled").collect()  # one row at most
    own = few.where(~F.col("pooled")).select(*(F.col(k).alias(d) for k, d in zip(("lang", *LIMITS), (tongue, *limits), strict=True)))
    own = F.broadcast(own) if own.count() <= MOST_BANDS else own
    rows = rows.join(own, F.col(lang).eqNullSafe(F.col(tongue)), "left")
    middle, under, over = (F.coalesce(F.col(x), F.lit(rest[0][k] if rest else None).cast("double")) for x, k in zip(limits, LIMITS, strict=True))
    off, scatter = F.col(names[5]) / 1e6 - middle, F.sqrt(1 + 50 / F.greatest(F.col(names[0]), F.lit(1)))
    inside = (-off <= under * scatter) & (off <= over * scatter)
    return rows.withColumn(kept, ~F.col(failed) & F.coalesce(inside, F.lit(True))).drop(tongue, *limits)


#: Rows of the table of bands that a join broadcasts; with more, Spark joins as it sees fit.
MOST_BANDS, LIMITS = 4096, ("middle", "under", "over")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and log_perplexity of every document."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judged(docs, keep_text=False).select("doc_id", *COUNTS, "base_failed", "kept", "log_perplexity")
