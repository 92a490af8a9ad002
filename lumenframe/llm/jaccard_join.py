"""Exact n-gram Jaccard join by signature trees.

A tree over all documents would not fit a task, and its upper nodes would prune nothing; so documents are
dealt to groups that hold every pair which can be linked, and a tree is grown in each.

1. Two sets with a Jaccard similarity of t or more share a token among the first |a| - ceil(t |a|) + 1 of each, in
   any one order; in ours the frequent come last (the order, from counts over all texts, decides only how large groups
   are).  Tokens with the same members make one group, so copies meet once and not once a token.
2. Each group's tree is traversed with bitmaps and sizes alone.  Pairs that may be linked are connected; the components
   of that are exact candidates: no link leaves them, and unrelated texts that share a passage are apart.
3. Each document sends its set once, to its candidate component, whose tree is traversed again and compares sets.
4. A component of over BLOCK members is dealt to blocks that share some members, its leaders, whose trees link most
   of a family; members that are not linked with it then meet every block.  Components are those of the links found.

Copies are collapsed first.  A token of over MANY members connects them all without a tree.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .components import components
from .signature_tree import bitmap, links, possible_links

BLOCK, MANY = 2048, 16384
FREQUENT = 1 << 17  # tokens ranked by their count; 2 MB
_FEW = 8
_WORDS_AT_ONCE = 500_000
_SENT = "bucket int, chunk int, tokens binary, members binary, counts binary"
_FOUND = "chunk int, tokens binary, groups binary, counts binary"


def shingles(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles (or the whole of a shorter text) of each row, sorted, and n+1 offsets."""
    h, _, _, rows = c.words(column, lower=True)
    w, fits = c.windows(h, rows, n)
    size = np.diff(rows)
    short = np.flatnonzero((size > 0) & (size < n))
    for k in range(1, n):
        at = rows[short[size[short] == k]]
        if len(at):
            w[at] = c.windows(h, rows, k)[0][at]
            fits[at] = True
    del h
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)[fits]
    w = w[fits]
    del fits
    order = np.argsort(w, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    w, row = w[order], row[order]
    first = c.runs(w, row)
    w, row = w[first], row[first]
    return w, np.searchsorted(row, np.arange(len(size) + 1))


@c.released
def _count(text: str, n: int, batches):
    """Shingles that two texts of a batch share or more, and how many."""
    c.KEPT.clear()
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def told(parts):
        w, _ = shingles(pa.chunked_array(parts, parts[0].type), n)
        keys, counts = np.unique(w, return_counts=True)
        return pa.record_batch([pa.array(keys[counts > 1].view(np.int64)), pa.array(counts[counts > 1])], schema)

    parts, held = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.column(text).slice(at, 1000)
            parts.append(part)
            held += part.nbytes
            if held > 6 * _WORDS_AT_ONCE:
                yield told(parts)
                parts, held = [], 0
    if parts:
        yield told(parts)


def frequent_tokens(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """The tokens that most texts share, from rare to frequent: FREQUENT at most, an order's tail."""
    rows = docs.select(text).mapInArrow(partial(_count, text, n), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= _FEW)
    top = rows.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    return top["token"].to_numpy().view(np.uint64)[::-1].copy() if len(top) else np.zeros(0, np.uint64)


class _Prefixes:
    """Tokens of a chunk's representatives, and their prefixes in the one order."""

    def __init__(self, t: pa.Table, reps: set, text: str, n: int, num: int, den: int, order):
        nodes = t["node"].to_pylist()
        take = [nodes[i] in reps and not reps.discard(nodes[i]) for i in range(len(nodes))]
        t = t.filter(pa.array(take, pa.bool_()))
        self.nodes = t["node"].to_pylist()
        self.sets, self.at = shingles(t[text], n)
        sorted_tokens, rank = order.value
        ranked = self.sets >> c.U(1)
        where = np.searchsorted(sorted_tokens, self.sets)
        where[where == len(sorted_tokens)] = 0
        if len(sorted_tokens):
            hot = sorted_tokens[where] == self.sets
            ranked[hot] = c.U(1) << c.U(63) | rank[where[hot]]
        self.prefixes = []
        for a, b in zip(self.at[:-1], self.at[1:], strict=True):
            size = int(b - a)
            p = size - -(-num * size // den) + 1
            self.prefixes.append(np.partition(ranked[a:b], p - 1)[:p] if p < size else ranked[a:b].copy())

    def __iter__(self):
        return iter(zip(self.nodes, self.at[:-1], self.at[1:], self.prefixes, strict=True))


def _send(text, n, num, den, order, buckets, t: pa.Table, reps: pa.Table) -> pa.Table:
    c.KEPT.clear()
    out: list = []
    if t.num_rows and reps.num_rows:
        own = t["chunk"][0].as_py()
        x = _Prefixes(t, set(reps["node"].to_pylist()), text, n, num, den, order)
        if x.nodes:
            member = np.array([xxhash.xxh3_64_intdigest(s) for s in x.nodes], np.uint64)
            tokens = np.concatenate(x.prefixes)
            member = np.repeat(member, [len(p) for p in x.prefixes])
            bucket = c.bucket_of(c.mix(tokens.copy()), buckets)
            order_ = np.lexsort((tokens, bucket))
            tokens, member, bucket = tokens[order_], member[order_], bucket[order_]
            at = c.runs(tokens)
            counts = np.diff(at, append=len(tokens)).astype(np.uint32)
            if len(at):
                member, tokens, bucket = np.add.reduceat(member, at), tokens[at], bucket[at]
            out = [(b, own, c.pack(tokens[s]), c.pack(member[s]), c.pack(counts[s])) for b, s in c.slices(bucket)]
    return _table(_SENT, out)


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(v, kinds[k]) for (name, k), v in zip(fields, columns, strict=True)})


def _found(t: pa.Table) -> pa.Table:
    """Of one bucket: tokens of two members or more, with the group that their members make."""
    parts = c.unpack(t["tokens"], c.U)
    tokens, members, counts = np.concatenate(parts), np.concatenate(c.unpack(t["members"], c.U)), np.concatenate(c.unpack(t["counts"], np.uint32))
    chunk = np.repeat(t["chunk"].to_numpy(), [len(x) for x in parts])
    order = np.argsort(tokens, kind="stable")
    tokens, members, counts, chunk = tokens[order], members[order], counts[order], chunk[order]
    at = c.runs(tokens)
    if not len(at):
        return _table(_FOUND, [])
    size = np.diff(at, append=len(tokens))
    total, group = np.add.reduceat(counts.astype(np.int64), at), np.add.reduceat(members, at)
    group = c.mix(group + total.astype(np.uint64))
    good = np.repeat(total > 1, size)
    tokens, chunk, group, total = tokens[good], chunk[good], np.repeat(group, size)[good], np.repeat(total, size)[good].astype(np.uint32)
    order = np.argsort(chunk, kind="stable")
    tokens, chunk, group, total = tokens[order], chunk[order], group[order], total[order]
    return _table(_FOUND, [(k, c.pack(tokens[s]), c.pack(group[s]), c.pack(total[s])) for k, s in c.slices(chunk)])


def _members(text, n, num, den, order, many, t: pa.Table, told: pa.Table) -> pa.Table:
    """A row for each representative, and one for each group that it is in."""
    out: list = []
    if t.num_rows and told.num_rows:
        x = _Prefixes(t, {s for s in told["node"].to_pylist() if s is not None}, text, n, num, den, order)
        found = told.filter(pa.compute.is_valid(told["tokens"]))
        if found.num_rows:
            tokens, group, total = (np.concatenate(c.unpack(found[k], d)) for k, d in (("tokens", c.U), ("groups", c.U), ("counts", np.uint32)))
            o = np.argsort(tokens)
            tokens, group, total = tokens[o], group[o], total[o]
        for node, a, b, prefix in x:
            size = int(b - a)
            out.append(("size", None, node, None, size, None, None))
            if not size or not found.num_rows:
                continue
            prefix.sort()
            at = np.searchsorted(tokens, prefix)
            at[at == len(tokens)] = 0
            at = at[tokens[at] == prefix]
            if not len(at):
                continue
            groups, first = np.unique(group[at], return_index=True)
            packed, least = c.pack(bitmap(x.sets[a:b])), int(x.sets[a].view(np.int64))
            for g, members in zip(groups.view(np.int64).tolist(), total[at][first].tolist(), strict=True):
                if members > many:
                    out.append(("edge", None, node, f"g{g}", None, None, None))
                else:
                    out.append(("member", g, node, None, size, least, packed))
    return _table(_LIGHT, out)


_LIGHT = "kind string, grp long, node string, other string, n long, least long, bits binary"


@c.released
def _possible(num: int, den: int, batches):
    """Edges between members of a group that may be linked, from rows sorted by group; other rows pass."""
    key, held, out = None, [], []

    def done():
        if len(held) > 1:
            maps = [np.frombuffer(r["bits"], c.U) for r in held]
            for i, j in possible_links(maps, np.array([r["n"] for r in held], np.int64), np.array([r["least"] for r in held], np.int64).view(np.uint64), num, den):
                out.append(("edge", None, held[i]["node"], held[j]["node"], None, None, None))

    for b in batches:
        for r in b.to_pylist():
            if r["kind"] != "member":
                out.append(tuple(r.values()))
            else:
                if key != r["grp"]:
                    done()
                    key, held = r["grp"], []
                held.append(r)
        yield from _table(_LIGHT, out).to_batches()
        out = []
    done()
    yield from _table(_LIGHT, out).to_batches()


def _sets(text, n, most, t: pa.Table, told: pa.Table) -> pa.Table:
    """The set of each member of a candidate component; a leader's goes to each block."""
    out: list = []
    if t.num_rows and told.num_rows:
        want = dict(zip(told["node"].to_pylist(), zip(told["grp"].to_pylist(), told["members"].to_pylist(), strict=True), strict=True))
        nodes = t["node"].to_pylist()
        take = [i for i, s in enumerate(nodes) if s in want]
        sets, at = shingles(t[text].take(pa.array(take, pa.int64())), n)
        for k, i in enumerate(take):
            found = want.pop(nodes[i], None)
            if found is None:
                continue
            (g, members), own = found, xxhash.xxh3_64_intdigest(nodes[i], 1)
            blocks, packed, size = -(-members // most), c.pack(sets[at[k] : at[k + 1]]), int(at[k + 1] - at[k])
            lead = blocks > 1 and own * 0x9E3779B97F4A7C15 % (1 << 64) < (1 << 66) // members
            for block in range(blocks) if lead else [own % blocks]:
                out.append(("member", g, blocks, block, lead, nodes[i], None, size, packed))
    return _table(_ROWS, out)


_ROWS = "kind string, grp string, blocks int, block int, leader boolean, node string, other string, n long, tokens binary"


@c.released
def _join(num: int, den: int, straggling: bool, batches):
    """Links of each block, from rows sorted by group and block; rows of large groups pass once."""
    key, held, out = None, [], []

    def done():
        if len(held) > 1:
            sets = [np.frombuffer(r["tokens"], c.U) for r in held]
            wanted = np.array([r["leader"] for r in held]) if straggling else None
            for i, j in links(sets, num, den, wanted):
                out.append(("link", None, None, None, None, held[i]["node"], held[j]["node"], None, None))

    for b in batches:
        for r in b.to_pylist():
            if key != (k := (r["grp"], r["block"])):
                done()
                key, held = k, []
            held.append(r)
            if r["blocks"] > 1 and not straggling and (not r["leader"] or r["block"] == 0):
                out.append(tuple(r.values()))
        yield from _table(_ROWS, out).to_batches()
        out = []
    done()
    yield from _table(_ROWS, out).to_batches()


def _linked(rows: DataFrame, num: int, den: int, straggling: bool = False) -> DataFrame:
    dealt = rows.repartition(c.partitions(rows.sparkSession), "grp", "block").sortWithinPartitions("grp", "block")
    return dealt.mapInArrow(partial(_join, num, den, straggling), _ROWS)


def _stragglers(big: DataFrame, parts: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Links of large groups' members that are not in the group's largest component, against all of the group."""
    labelled = big.join(parts.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    main = labelled.groupBy("grp", "part").count().groupBy("grp").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    labelled = labelled.join(main, "grp").withColumn("leader", F.col("part") != F.col("main"))
    few = labelled.where("leader").groupBy("grp").agg(F.count("*").alias("left"))
    cells = labelled.join(few, "grp").withColumn("rows", F.ceil(F.col("left") / most).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("rows")).cast("int")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = lambda r, b: (r * F.col("blocks") + b).alias("block")
    everyone = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r")).withColumn("cell", pair(F.col("r"), block)).withColumn("leader", F.lit(False))
    loose = cells.where("leader").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")).withColumn("cell", pair(own, F.col("b")))
    columns = ["kind", "grp", "blocks", F.col("cell").alias("block"), "leader", "node", "other", "n", "tokens"]
    return _linked(everyone.select(*columns).unionByName(loose.select(*columns)), num, den, True)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100, block: int = BLOCK, many: int = MANY) -> DataFrame:
    """`node` (of doc_id and text), `n_shingles` and `component_id` of every distinct text with words.

    Sets hold the distinct n-word shingles of the text, A-Z lower-cased; fewer words make one shingle.
    Texts are linked when den * |a & b| >= num * |a | b|.  component_id is the smallest doc_id of the texts
    that links connect, copies included; null where none of them has one.
    """
    spark = docs.sparkSession
    c.prepare(spark)
    if 2 * num < den:
        raise ValueError("links of a similarity under a half would join bitmaps of more than two widths")
    chunks, buckets = c.chunks_and_buckets(docs, text)
    tail = frequent_tokens(docs, text, n)
    by_token = np.argsort(tail)
    order = spark.sparkContext.broadcast((tail[by_token], by_token.astype(np.uint64)))  # at most FREQUENT * 16 bytes
    nodes = docs.select(node_of(doc_id, text).alias("node"), F.coalesce(F.col(text), F.lit("")).alias(text))
    nodes = nodes.withColumn("chunk", c.chunk_of(chunks, "node"))
    reps = docs.select(node_of(doc_id, text).alias("node")).groupBy(F.substring("node", 17, 32).alias("h")).agg(F.min("node").alias("node")).select("node", c.chunk_of(chunks, "node").alias("chunk"))
    by_chunk = c.dealt(nodes).groupBy("chunk")
    sent = by_chunk.cogroup(c.dealt(reps).groupBy("chunk")).applyInArrow(partial_arrow(_send, text, n, num, den, order, buckets), _SENT)
    found = c.grouped(sent, _found, _FOUND, "bucket")
    told = reps.unionByName(found, allowMissingColumns=True)
    rows = by_chunk.cogroup(c.dealt(told).groupBy("chunk")).applyInArrow(partial_arrow(_members, text, n, num, den, order, many), _LIGHT)
    rows = rows.repartition(c.partitions(spark), "grp", F.when(F.col("grp").isNull(), F.col("node"))).sortWithinPartitions("grp")
    with c.gathered(rows.mapInArrow(partial(_possible, num, den), _LIGHT)) as few:
        light = c.stored(few, "jaccard-candidates")
    with c.gathered(components(light.where("kind = 'edge'").select(F.col("node").alias("a"), F.col("other").alias("b"))).where("node not like 'g%'")) as few:
        candidates = few.checkpoint()
    members = candidates.groupBy("component").agg(F.count("*").alias("members"))
    want = candidates.join(members.where("members > 1"), "component").select("node", F.col("component").alias("grp"), "members", c.chunk_of(chunks, "node").alias("chunk"))
    sets = by_chunk.cogroup(c.dealt(want).groupBy("chunk")).applyInArrow(partial_arrow(_sets, text, n, block), _ROWS)
    with c.gathered(_linked(sets, num, den), "tokens") as few:
        joined = c.stored(few, "jaccard-links")
    parts = components(joined.where("kind = 'link'").select(F.col("node").alias("a"), F.col("other").alias("b")))
    big = joined.where("kind = 'member'")
    if not big.isEmpty():
        with c.gathered(parts) as few:
            parts = few.checkpoint()
        late = _stragglers(big, parts, num, den, block).where("kind = 'link'").select(F.col("node").alias("a"), F.col("other").alias("b"))
        parts = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late))
    sizes = light.where("kind = 'size'").select("node", F.col("n").alias("n_shingles"))
    return sizes.join(parts, "node", "left").select("node", "n_shingles", id_of(F.coalesce("component", "node")).alias("component_id"))


def partial_arrow(f, *first):
    def call(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(*first, left, right)
        finally:
            c.release()

    return call


_NONE = (1 << 63) - 1


def node_of(doc_id: str, text: str):
    """16 hexadecimal digits that sort as doc_id does, null last, and the text's MD5."""
    number = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NONE)).bitwiseXOR(F.lit(-_NONE - 1))
    return F.concat(F.lpad(F.hex(number), 16, "0"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def id_of(node):
    number = (F.conv(F.substring(node, 1, 16), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")
    return F.when(number != _NONE, number)


def with_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with `n_shingles` and `component_id`, one row for each row.

    Texts without words (null, empty, spaces) have no shingles and are classes of their own: their component_id is
    their doc_id.  Equal texts are one class.  Rows without doc_id take the class of their text.
    """
    found = classes(docs, doc_id, text, **how)
    h, n, component = c.fresh(docs, "h", "n_shingles", "component_id")
    told = found.select(F.substring("node", 17, 32).alias(h), F.col("n_shingles").alias(n), F.col("component_id").alias(component))
    out = docs.withColumn(h, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).join(told, h, "left")
    return out.withColumn(component, F.when(F.col(n) > 0, F.col(component)).otherwise(F.col(doc_id).cast("long"))).drop(h)


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each class: that with the smallest doc_id; of equal rows one.  Texts without words all stay."""
    found = classes(docs, doc_id, text, **how)
    node, chunk = c.fresh(docs, "node", "chunk")
    chunks = c.chunk_count(docs, text)
    empty = F.coalesce(F.length(F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]", "")), F.lit(0)) == 0
    kept = found.where((F.col("n_shingles") > 0) & id_of(F.col("node")).eqNullSafe(F.col("component_id"))).select(F.col("node").alias(node), c.chunk_of(chunks, "node").alias(chunk))
    full = docs.where(~empty).withColumn(node, node_of(doc_id, text)).withColumn(chunk, c.chunk_of(chunks, node))

    def first(t: pa.Table, keep: pa.Table) -> pa.Table:
        left = set(keep[node].to_pylist())
        take = [s in left and not left.discard(s) for s in t[node].to_pylist()]
        return t.filter(pa.array(take, pa.bool_())).drop_columns([node, chunk])

    return c.cogrouped(full, kept, first, docs.schema, chunk).unionByName(docs.where(empty).dropDuplicates([doc_id, text]))


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_classes(docs).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 3))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 85 * (a.n + b.n - m)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM r WHERE x = doc_id), doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
