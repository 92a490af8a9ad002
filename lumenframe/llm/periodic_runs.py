"""Periodic runs of words, by longest common extensions over a difference cover.

A run is a stretch of words in which words q apart are the same, for the smallest such q, that cannot be extended and holds
q three times at least.  For each period p the words at multiples of p form a harmonic grid (N/1 + N/2 + ... points in all); a run
of 3p words or more holds three neighbours of that grid, which are the same word.  From each such place the common extensions of
(i, i + p), forwards and backwards, give the run.

An extension compares a few words, until both places are samples: places whose number modulo COVER's size is in COVER, a
difference cover, are less than that size away for any pair.  Only the suffixes at samples are sorted, by doubling over named
blocks; the extension from two samples is a minimum over the sorted order, read from a sparse table.  Most places differ within the
few words, so suffixes are sorted only for texts that hold a pair that reached its samples.  Texts are independent of each other,
so Spark deals out rows and nothing is shuffled; a task holds PIECE bytes of text at once, or one longer text.
"""

from __future__ import annotations

from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

#: Perfect difference cover: each remainder modulo 13 but 0 is the difference of one pair.
COVER, MODULUS = (0, 1, 3, 9), 13
PENDING = 1 << 20  # places of the grid that are extended at once
LEAST = 24


def _steps() -> np.ndarray:
    """[i mod m, (j - i) mod m]: words from the pair (i, j) to its samples."""
    out = np.zeros((MODULUS, MODULUS), np.int64)
    for apart in range(MODULUS):
        x = next(a for a in COVER if (a + apart) % MODULUS in COVER)
        out[:, apart] = (x - np.arange(MODULUS)) % MODULUS
    return out


_STEPS = _steps()


def _compared(x: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that are the same from i and j on, `most` of each pair at most."""
    same, left = np.zeros(len(i), np.int64), np.arange(len(i))
    for t in range(int(most.max(initial=0))):
        left = left[most[left] > t]
        left = left[x[i[left] + t] == x[j[left] + t]]
        same[left] += 1
    return same


class Extensions:
    """Longest common extensions of places in x, an array that ends in as many unique values as COVER's modulus."""

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x) - MODULUS
        at = np.arange(n)
        self.samples = at[np.isin(at % MODULUS, COVER)]
        self.index = np.full(len(x), -1, np.int32)
        self.index[self.samples] = np.arange(len(self.samples))
        blocks = c.windows(x, np.array([0, len(x)]), MODULUS)[0][self.samples]
        rank = np.unique(blocks, return_inverse=True)[1].astype(np.int64)
        later = self._after(np.arange(len(self.samples)), 1)
        ranks, width = [rank], 1
        while len(rank) and rank.max() + 1 < len(rank):  # until all suffixes differ
            key = rank * (len(rank) + 1) + np.where(later >= 0, rank[later] + 1, 0)
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            ranks.append(rank)
            width *= 2
            later = self._after(np.arange(len(self.samples)), width)
        self.rank = rank
        order = np.argsort(rank)
        a, b, common = order[:-1], order[1:], np.zeros(max(0, len(order) - 1), np.int32)
        for level in range(len(ranks) - 1, -1, -1):
            ok = (a >= 0) & (b >= 0)
            ok[ok] = ranks[level][a[ok]] == ranks[level][b[ok]]
            common[ok] += 1 << level
            a, b = np.where(ok, self._after(a, 1 << level), a), np.where(ok, self._after(b, 1 << level), b)
        self.table = [common]
        while 2 * (half := 1 << (len(self.table) - 1)) <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _after(self, sample: np.ndarray, blocks: int) -> np.ndarray:
        """The sample that many blocks after each, or -1."""
        at = self.samples[np.maximum(sample, 0)] + MODULUS * blocks
        return np.where((sample >= 0) & (at < len(self.x)), self.index[np.minimum(at, len(self.x) - 1)], -1)

    def blocks(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whole blocks that are the same from two samples on."""
        a, b = self.rank[self.index[i]], self.rank[self.index[j]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            of = np.flatnonzero(level == k)
            out[of] = np.minimum(self.table[k][low[of]], self.table[k][high[of] - (1 << k)])
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        steps = _STEPS[i % MODULUS, (j - i) % MODULUS]
        out = _compared(self.x, i, j, steps)
        met = np.flatnonzero(out == steps)
        i, j = i[met] + steps[met], j[met] + steps[met]
        far = MODULUS * self.blocks(i, j)
        out[met] += far + _compared(self.x, i + far, j + far, np.full(len(met), MODULUS))
        return out


def _joined(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all rows, a unique value before each row and MODULUS after the last; where each row starts."""
    n = len(rows) - 1
    heads = rows + np.arange(n + 1) + 1
    x = np.empty(len(h) + n + MODULUS + 1, c.U)
    ends = np.concatenate([heads - 1, np.arange(heads[-1], len(x))])
    word = np.ones(len(x), bool)
    word[ends] = False
    x[word] = h
    x[ends] = c.mix(np.arange(len(ends)).astype(c.U) + c.U(0x5851F42D4C957F2D))
    return x, heads


def _extents(x: np.ndarray, heads: np.ndarray, i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common extensions of (i, i + p) forwards, and of (i - 1, i + p - 1) backwards, where they may reach 2p together; else less than that."""
    turn = len(x) - MODULUS
    back = np.concatenate([x[turn - 1 :: -1], x[turn:]])
    steps = _STEPS[i % MODULUS, p % MODULUS]
    forth = _compared(x, i, i + p, steps)
    ri = turn - (i + p)
    rsteps = _STEPS[ri % MODULUS, p % MODULUS]
    aft = _compared(back, ri, ri + p, rsteps)
    met = (forth == steps) | (aft == rsteps)
    of = np.flatnonzero(met)
    if len(of):
        docs, which = np.unique(np.searchsorted(heads, i[of], side="right") - 1, return_inverse=True)
        size = heads[docs + 1] - 1 - heads[docs]
        rows = np.concatenate([[0], np.cumsum(size)])
        h = x[np.repeat(heads[docs] - rows[:-1], size) + np.arange(rows[-1])]
        y, starts = _joined(h, rows)
        at = i[of] - heads[docs][which] + starts[which]
        forth[of] = Extensions(y).of(at, at + p[of])
        turn = len(y) - MODULUS
        at = turn - (at + p[of])
        aft[of] = Extensions(np.concatenate([y[turn - 1 :: -1], y[turn:]])).of(at, at + p[of])
    return forth, aft


def runs(h: np.ndarray, rows: np.ndarray, least: int = LEAST, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word in it, length and smallest period of each run of `least` words and `times` periods or more, `times` being 3 or more.

    h are hashes of words and rows the n + 1 places where rows begin.  Runs come ordered by row, start and period.
    """
    x, heads = _joined(h, rows)
    found, places, periods, pending = [], [], [], 0

    def extend():
        i, p = np.concatenate(places), np.concatenate(periods)
        inside = np.searchsorted(heads, i, side="right") == np.searchsorted(heads, i + 2 * p, side="right")  # a run lies in one row
        i, p = i[inside], p[inside]
        forth, aft = _extents(x, heads, i, p)
        good = (forth + aft >= (times - 1) * p) & (forth + aft + p >= least)
        s, e, p = (i - aft)[good], (i + p + forth)[good], p[good]
        found.append(np.unique(np.stack([s, e, p], 1), axis=0))

    words = x[: heads[-1]]
    for p in range(1, int(np.diff(rows).max(initial=0)) // times + 1):
        grid = words[::p]
        same = grid[1:] == grid[:-1]
        k = np.flatnonzero(same[1:] & same[:-1])
        if len(k):
            places.append(k * p)
            periods.append(np.full(len(k), p))
            pending += len(k)
            if pending > PENDING:
                extend()
                places, periods, pending = [], [], 0
    if places:
        extend()
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    s, e, p = np.unique(np.concatenate(found), axis=0).T
    first = c.runs(s, e)  # the smallest period of a stretch comes first; its multiples have the same stretch
    s, e, p = s[first], e[first], p[first]
    row = np.searchsorted(heads, s, side="right") - 1
    order = np.lexsort((p, s))
    return row[order], (s - heads[row])[order], (e - s)[order], p[order]


_RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


@c.released
def _found(text: str, names: tuple[str, str, str], least: int, times: int, schema: pa.Schema, batches):
    for batch in batches:
        for part in c.pieces(batch, text):
            h, starts, ends, rows = c.words(part.column(text))
            row, start, length, period = runs(h, rows, least, times)
            step = np.zeros(len(h) + 1, np.int32)
            first = rows[row] + start
            np.add.at(step, first + period, 1)
            np.add.at(step, first + length, -1)
            lost = np.cumsum(step)[:-1] > 0
            raw, kept = c.buffers(part.column(text))[0].tobytes(), []
            for a, b in zip(rows[:-1], rows[1:], strict=True):
                tokens = raw[starts[a] : ends[b - 1]].split() if a < b else []
                kept.append(b" ".join(compress(tokens, ~lost[a:b]) if lost[a:b].any() else tokens).decode())
            values = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, length, period)], names=["start", "length", "period"])
            cut = pa.array(np.searchsorted(row, np.arange(len(rows))), pa.int32())
            new = (pa.array(np.diff(rows), pa.int64()), pa.ListArray.from_arrays(cut, values), pa.array(kept, pa.string()))
            out = dict(zip(names, new, strict=True))
            yield pa.record_batch([out[f.name].cast(f.type) if f.name in out else part.column(f.name) for f in schema], schema)


def with_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = 3) -> DataFrame:
    """docs with `n_words`, `runs` (start, length, period; by start, then period) and `collapsed_text`.

    Words are runs of what is neither a space nor 0x09-0x0D.  A run holds its smallest period `times` times or more, 3 at least,
    and has `least` words or more.  The collapsed text is without the words that a run holds after its first period, joined by one space.
    Null and empty texts have no words and no runs, and the collapsed text ""; every row stays, repeated rows too; clashing names
    of new columns get an underscore.  Long texts are processed whole.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods need not hold three places of the grid")
    from pyspark.sql.pandas.types import to_arrow_schema

    c.prepare(docs.sparkSession)
    names = tuple(c.fresh(docs, "n_words", "runs", "collapsed_text"))
    kinds = (T.LongType(), T.ArrayType(_RUN, False), T.StringType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    return docs.mapInArrow(partial(_found, text, names, least, times, to_arrow_schema(schema)), schema)


def strongest(found) -> F.Column:
    """Of an array of runs, that with the greatest length over period, exactly compared; the first of those alike; null if there is none."""
    return F.aggregate(found, F.get(found, F.lit(0)), lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))


def rebuilt(docs: DataFrame) -> DataFrame:
    """doc_id and text of all documents; where crc32(doc_id) % 10 is 0 the words from a on repeat with a period p, both given by that number."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10).cast("bigint"), F.size("w").cast("bigint")
    some = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"))).alias("w"))
    some = some.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int")).withColumn("left", (n - F.col("a")).cast("int"))
    p = (1 + F.floor(F.col("left") / (3 + F.col("g") % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, p), F.ceil(F.col("left") / p).cast("int"))), F.lit(1), F.col("left"))
    return some.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document's words: their number, the strongest, and digests of all runs and of the collapsed text."""
    out = with_runs(rebuilt(c.table(spark, sf_dir, "documents")))
    best, length, period = strongest(F.col("runs")), F.col("best.length"), F.col("best.period")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed_text")).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def crc32_sql(x: str) -> str:
    """SQL of the unsigned CRC-32 of a decimal number: a list of its bytes and bits, shifted and folded with the polynomial."""
    bits = f"list_concat([4294967295::UBIGINT], flatten(list_transform(range(1, length({x}::VARCHAR) + 1), lambda i: [ascii(substr({x}::VARCHAR, i::INT, 1))::UBIGINT, 0, 0, 0, 0, 0, 0, 0])))"
    return f"xor(list_reduce({bits}, lambda a, b: xor(xor(a, b) >> 1, 3988292384::UBIGINT * (xor(a, b) & 1))), 4294967295::UBIGINT)::BIGINT"


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql("doc_id")} AS h FROM documents),
a AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
b AS (SELECT r, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, len(w)), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) END + 1]) END AS w FROM a),
k AS (SELECT r, len(w) AS n, i, md5(array_to_string(w[i:i + 7], ' ')) AS k FROM b, LATERAL (SELECT unnest(generate_series(1, len(w) - 7)) AS i) WHERE len(w) >= 24),
p AS (SELECT x.r, x.i, y.i - x.i AS p FROM k x JOIN k y ON x.r = y.r AND x.k = y.k AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
s AS (SELECT r, p, min(i) - 1 AS s, count(*) + 7 + p AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM p) GROUP BY r, p, island HAVING count(*) + 7 + p >= greatest(24, 3 * p)),
u AS (SELECT r, s, l, min(p) AS p FROM s GROUP BY r, s, l),
e AS (SELECT r, count(*) AS n_runs, list({{'s': s, 'l': l, 'p': p}} ORDER BY l / p::DOUBLE DESC, s, p)[1] AS m, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS t FROM u GROUP BY r),
g AS (SELECT DISTINCT r, unnest(range(s + p, s + l)) AS i FROM u), f AS (SELECT r, list(i) AS gone FROM g GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(m.s AS BIGINT) AS start, CAST(m.l AS BIGINT) AS length, CAST(m.p AS BIGINT) AS period, CAST(1000 * m.l // m.p AS BIGINT) AS exponent_milli, sha256(coalesce(t, '')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END, ' ')) AS collapsed_sha256
FROM b LEFT JOIN e USING (r) LEFT JOIN f USING (r)
"""
