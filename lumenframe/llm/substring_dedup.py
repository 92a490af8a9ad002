"""Exact substring deduplication by fixed-block anchors.

Every document is cut into non-overlapping blocks of `block` words; these are the index.  Every
rolling window of that length probes it.  A repeated window of k >= 2 * block - 1 words holds
one whole block in either of its places, at the same offset, so a hit lies in every repeat.  Hits are
extended to all k-word windows around them; windows that occur twice or more make up the maximal
exact repeats, and the words that they cover are removed.

No pairs are made.  Each chunk of documents sends each distinct anchor once, packed with its bucket's
others, so that a passage in a third of all documents costs one entry a chunk.  The index is probed
with 32 bits beside the bucket, which may let a few false anchors through; windows are compared by 96
bits.  Text is shuffled once and the exchange is used three times.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

_ANCHORS = "bucket int, chunk int, keys binary, flags binary"
_HITS = "chunk int, bucket int, keys binary"
_WINDOWS = "bucket int, chunk int, keys binary, more binary, flags binary"
_REPEATS = "chunk int, bucket int, keys binary, more binary"


def _rows(names: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table({n: pa.array(v, kinds[k]) for (n, k), v in zip(fields, columns, strict=True)})


def _anchors(text: str, chunk: str, block: int, buckets: int):
    def send(t: pa.Table) -> pa.Table:
        h, _, _, rows = c.words(t[text])
        w, fits = c.windows(h, rows, block)
        keys = c.composite(w, buckets)
        offset = np.arange(len(h)) - np.repeat(rows[:-1], np.diff(rows))
        indexed = np.unique(keys[fits & (offset % block == 0)])
        keys, n = np.unique(keys[fits], return_counts=True)
        flags = (n > 1).astype(np.uint8) | c.isin_sorted(keys, indexed).astype(np.uint8) << 1
        own = t[chunk][0].as_py()
        return _rows(_ANCHORS, [(b, own, c.pack(keys[s].astype(np.uint32)), c.pack(flags[s])) for b, s in c.slices(keys >> c.U(32))])

    return send


def _hits(t: pa.Table) -> pa.Table:
    """Of one bucket: the anchors that are indexed and occur in two places or more, to each chunk that has them."""
    parts = c.unpack(t["keys"], np.uint32)
    keys, flags = np.concatenate(parts), np.concatenate(c.unpack(t["flags"], np.uint8))
    chunk = np.repeat(t["chunk"].to_numpy(), [len(x) for x in parts])
    order = np.argsort(keys, kind="stable")
    keys, flags, chunk = keys[order], flags[order], chunk[order]
    at = c.runs(keys)
    if not len(at):
        return _rows(_HITS, [])
    size = np.diff(at, append=len(keys))
    seen = np.bitwise_or.reduceat(flags, at)
    good = np.repeat((seen & 2 > 0) & ((seen & 1 > 0) | (size > 1)), size)
    keys, chunk = keys[good], chunk[good]
    order = np.argsort(chunk, kind="stable")
    keys, chunk = keys[order], chunk[order]
    bucket = t["bucket"][0].as_py()
    return _rows(_HITS, [(k, bucket, c.pack(keys[s])) for k, s in c.slices(chunk)])


def _extended(text: str, chunk: str, block: int, k: int, buckets: int):
    def send(t: pa.Table, hits: pa.Table) -> pa.Table:
        if not t.num_rows or not hits.num_rows:
            return _rows(_WINDOWS, [])
        h, _, _, rows = c.words(t[text])
        w, fits = c.windows(h, rows, block)
        hits = hits.sort_by("bucket")
        found = np.concatenate([c.U(b) << c.U(32) | x for b, x in zip(hits["bucket"].to_numpy().astype(c.U), c.unpack(hits["keys"], np.uint32), strict=True)])
        hit = c.isin_sorted(c.composite(w, buckets), found) & fits
        total = np.concatenate([[0], np.cumsum(hit)])
        n = len(h)
        near = total[np.minimum(np.arange(n) + k - block + 1, n)] > total[:-1]
        w, fits = c.windows(h, rows, k)
        take = near & fits
        more = c.windows(h, rows, k, second=True)[0][take].astype(np.uint32)
        w = w[take]
        order = np.lexsort((more, w))
        w, more = w[order], more[order]
        at = c.runs(w, more)
        n = np.diff(at, append=len(w))
        w, more = w[at], more[at]
        own = t[chunk][0].as_py()
        return _rows(_WINDOWS, [(b, own, c.pack(w[s]), c.pack(more[s]), c.pack((n[s] > 1).astype(np.uint8))) for b, s in c.slices(c.bucket_of(w, buckets))])

    return send


def _repeats(t: pa.Table) -> pa.Table:
    """Of one bucket: the windows that start in two places or more, to each chunk that has them."""
    parts = c.unpack(t["keys"], c.U)
    keys, more, many = np.concatenate(parts), np.concatenate(c.unpack(t["more"], np.uint32)), np.concatenate(c.unpack(t["flags"], np.uint8))
    chunk = np.repeat(t["chunk"].to_numpy(), [len(x) for x in parts])
    order = np.lexsort((more, keys))
    keys, more, many, chunk = keys[order], more[order], many[order], chunk[order]
    at = c.runs(keys, more)
    if not len(at):
        return _rows(_REPEATS, [])
    size = np.diff(at, append=len(keys))
    good = np.repeat((size > 1) | (np.maximum.reduceat(many, at) > 0), size)
    keys, more, chunk = keys[good], more[good], chunk[good]
    order = np.argsort(chunk, kind="stable")
    keys, more, chunk = keys[order], more[order], chunk[order]
    bucket = t["bucket"][0].as_py()
    return _rows(_REPEATS, [(k, bucket, c.pack(keys[s]), c.pack(more[s])) for k, s in c.slices(chunk)])


def _removed(text: str, chunk: str, k: int, names: tuple[str, str, str, str], schema: pa.Schema):
    def cut(t: pa.Table, found: pa.Table) -> pa.Table:
        if not t.num_rows:
            return schema.empty_table()
        h, starts, ends, rows = c.words(t[text])
        gone = np.zeros(len(h), bool)
        if found.num_rows:
            found = found.sort_by("bucket")
            keys, more = np.concatenate(c.unpack(found["keys"], c.U)), np.concatenate(c.unpack(found["more"], np.uint32))
            w, fits = c.windows(h, rows, k)
            marks = c.isin_sorted(w, keys) & fits
            at = np.flatnonzero(marks)
            second = c.windows(h, rows, k, second=True)[0][at].astype(np.uint32)
            left = np.searchsorted(keys, w[at])
            good = more[left] == second
            for i in np.flatnonzero(~good):  # two windows with one 64-bit hash
                good[i] = second[i] in more[left[i] : np.searchsorted(keys, w[at[i]], side="right")]
            marks[at[~good]] = False
            gone = c.covered(marks, k)
        data, _ = c.buffers(t[text])
        raw = data.tobytes()
        kept, spans = [], []
        for i in range(t.num_rows):
            a, b = rows[i], rows[i + 1]
            if a == b:
                kept.append("")
                spans.append([])
                continue
            tokens, lost = raw[starts[a] : ends[b - 1]].split(), gone[a:b]
            if lost.any():
                tokens = compress(tokens, ~lost)
                d = np.diff(np.concatenate([[0], lost.astype(np.int8), [0]]))
                spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(np.flatnonzero(d > 0), np.flatnonzero(d < 0), strict=True)])
            else:
                spans.append([])
            kept.append(b" ".join(tokens).decode())
        total = np.concatenate([[0], np.cumsum(gone)])
        out = t.drop_columns([chunk])
        for name, values in zip(names, (np.diff(rows), np.diff(total[rows]), kept, spans), strict=True):
            out = out.append_column(name, pa.array(values, schema.field(name).type))
        return out.cast(schema)

    return cut


def remove_repeats(docs: DataFrame, text: str = "text", k: int = 35) -> DataFrame:
    """docs with `n_words`, `n_removed`, `kept_text` and `repeats` (first and last word of each maximal repeat).

    Words are runs of what is neither a space nor 0x09-0x0D.  A word goes if it lies in a window of k words
    whose sequence starts anywhere else too, in any row or the same.  Null and empty texts have no words
    and are kept; equal rows are copies of each other; clashing names of new columns get an underscore.
    Long texts are processed whole.
    """
    spark = docs.sparkSession
    c.prepare(spark)
    from pyspark.sql.pandas.types import to_arrow_schema

    block = (k + 1) // 2
    chunks, buckets = c.chunks_and_buckets(docs, text)
    chunk, *names = c.fresh(docs, "chunk", "n_words", "n_removed", "kept_text", "repeats")
    dealt = c.dealt(docs.withColumn(chunk, c.chunk_of(chunks, *c.hashable(docs))), chunk)
    by_chunk = dealt.groupBy(chunk)
    anchors = by_chunk.applyInArrow(_anchors(text, chunk, block, buckets), _ANCHORS)
    hits = c.dealt(c.grouped(anchors, _hits, _HITS, "bucket"), "chunk")
    windows = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(_extended(text, chunk, block, k, buckets), _WINDOWS)
    repeats = c.dealt(c.grouped(windows, _repeats, _REPEATS, "bucket"), "chunk")
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, x) for n, x in zip(names, (T.LongType(), T.LongType(), T.StringType(), span), strict=True))])
    cut = _removed(text, chunk, k, tuple(names), to_arrow_schema(schema))
    return by_chunk.cogroup(repeats.groupBy("chunk")).applyInArrow(cut, schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 34)) AS i) WHERE len(w) >= 35),
m AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS i FROM s SEMI JOIN m USING (h)),
g AS (SELECT r, list(i) AS gone FROM c GROUP BY r),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone, list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)) AS kept FROM d LEFT JOIN g USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
