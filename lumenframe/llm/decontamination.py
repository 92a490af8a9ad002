"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Items and texts are normalised alike: A-Z lower-cased, words are runs of digits, letters and non-ASCII characters.
Each word of the items is coded as two symbols, one of either of two alphabets, so that a match is of whole words
and a node has few children; a word that no item has is a symbol of its own.  The automaton holds each
item's windows and reads each text once.  Matches are mapped to words, and in texts that have any to characters of the
original.

An automaton takes about 140 bytes a character of the items.  They are dealt by their ids to blocks of about BLOCK_CHARS
characters, one block in usual cases; the driver and the workers hold one block at a time, and each further block is
another pass over texts stored with what was found so far.
"""

from __future__ import annotations

import math
import re
import uuid
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

BLOCK_CHARS = 2_000_000
_OTHER = "\x01\x01"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_NORMAL = bytes(32 if c.NON_ALNUM[c.LOWER[i]] else int(c.LOWER[i]) for i in range(256))
FOUND = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def item_windows(text: str | None, k: int) -> set[bytes]:
    w = normal_words(text)
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def automaton(items: list[tuple[str | None, str | None]], k: int):
    """The automaton and the code of each word; None if no item has a word. Its values: number of words, and the items that have the window."""
    owners: dict[bytes, set] = {}
    for item, text in items:
        for w in item_windows(text, k):
            owners.setdefault(w, set()).add(item)
    if not owners:
        return None
    known = sorted({x for w in owners for x in w.split(b" ")})
    base = math.isqrt(len(known)) + 1
    codes = {w: chr(0x100 + i // base) + chr(0x100 + base + i % base) for i, w in enumerate(known)}
    a = ahocorasick.Automaton()
    while owners:
        w, ids = owners.popitem()
        x = w.split(b" ")
        a.add_word("".join(map(codes.__getitem__, x)), (len(x), tuple(sorted(i for i in ids if i is not None))))
    a.make_automaton()
    return a, codes


def matches(found_by, text: str | None) -> tuple[int, list[tuple[int, int, tuple]]]:
    """Number of words, and of each match the first word, the last word plus one, and the items."""
    w = normal_words(text)
    if found_by is None or not w:
        return len(w), []
    a, codes = found_by
    found = a.iter("".join([codes.get(x, _OTHER) for x in w]))
    return len(w), [((e + 1) // 2 - n, (e + 1) // 2, ids) for e, (n, ids) in found]


@c.released
def _scan(text: str, words: str, hits: str, items, key: str, k: int, schema: pa.Schema, batches):
    """Adds to `hits` what the block of items finds."""
    if key not in c.KEPT:
        c.KEPT.clear()
        c.KEPT[key] = automaton(items.value, k)
    a = c.KEPT[key]
    for whole in batches:
        for b in c.pieces(whole, text):
            n, out = [], []
            for s in b.column(text):
                count, found = matches(a, s.as_py())
                n.append(count)
                out.append([{"first": i, "last": j - 1, "items": ids} for i, j, ids in found])
            if hits in b.schema.names:
                out = [(old or []) + new for old, new in zip(b.column(hits).to_pylist(), out, strict=True)]
            columns = [pa.array(n, pa.int64()) if f.name == words else pa.array(out, f.type) if f.name == hits else b.column(f.name) for f in schema]
            yield pa.record_batch(columns, schema)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """docs with `n_words`, `n_hit`, `item_ids` (sorted as strings), `contaminated`, and `spans`: first and
    last character (from 0) of the original text of each run of hit words.

    A window is k consecutive words of an item; an item of fewer words, but not none, is one window.
    A word inside any occurrence of a window is hit.  Null and empty texts have no words; items that are null or have
    no words find nothing; rows of the benchmark with one id are one item; an item without id hits words but is not
    listed.  Every row of docs stays, repeated rows too; clashing names of new columns get an underscore.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    c.prepare(spark)
    n, hits, *new = c.fresh(docs, "_n", "_hits", "n_words", "n_hit", "item_ids", "contaminated", "spans")
    schema = T.StructType([*docs.schema.fields, T.StructField(n, T.LongType()), T.StructField(hits, T.ArrayType(FOUND))])
    arrow = to_arrow_schema(schema)
    blocks = max(1, -(-(benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0) // BLOCK_CHARS))
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    df = docs
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == i).collect()  # BLOCK_CHARS characters, about
        sent = spark.sparkContext.broadcast([tuple(r) for r in block])
        df = df.mapInArrow(partial(_scan, text, n, hits, sent, uuid.uuid4().hex, k, arrow), schema)
        if i + 1 < blocks:
            df = c.stored(df, "decontaminate")
    out = T.StructType([*docs.schema.fields, *(T.StructField(x, t) for x, t in zip(new, (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.BooleanType(), T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))), strict=True))])
    return df.mapInArrow(partial(_told, text, n, hits, tuple(new), to_arrow_schema(out)), out)


def _told(text: str, words: str, hits: str, new: tuple, schema: pa.Schema, batches):
    for b in batches:
        sums = {x: [] for x in new}
        column = b.column(text)
        for i, (n, found) in enumerate(zip(b.column(words).to_pylist(), b.column(hits).to_pylist(), strict=True)):
            runs: list[list[int]] = []
            for x in sorted(found, key=lambda x: (x["first"], x["last"])):
                if runs and x["first"] <= runs[-1][1] + 1:
                    runs[-1][1] = max(runs[-1][1], x["last"])
                else:
                    runs.append([x["first"], x["last"]])
            at = [m.span() for m in _WORD.finditer(column[i].as_py().translate({j: j + 32 for j in range(65, 91)}))] if runs else []
            spans = [{"first": at[x][0], "last": at[y][1] - 1} for x, y in runs]
            values = n, sum(y - x + 1 for x, y in runs), sorted({s for x in found for s in x["items"]}), bool(runs), spans
            for name, v in zip(new, values, strict=True):
                sums[name].append(v)
        yield pa.record_batch([pa.array(sums[f.name], f.type) if f.name in sums else b.column(f.name) for f in schema], schema)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document, against the whole benchmark."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, c.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + 9], ' ') AS s FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS i) WHERE len(w) > 0),
p AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM v), LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i) WHERE len(w) >= k),
m AS (SELECT r, i, k, item_id FROM p JOIN v USING (k, s)),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS j FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
