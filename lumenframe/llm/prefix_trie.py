"""Trie of conversation prefixes by van Emde Boas recursion: every cut is at half depth, so log2(depth) rounds do for any depth.

Sequences of turns are cut into aligned blocks of 1, 2, 4, ... turns.  Upwards, two halves make a block and its content gets a name.
Downwards, a block of a trie g is cut at half depth: its upper half stays in g, and its lower half belongs to the forest below the
cut prefix, which is named after g and the upper half's content.  All blocks of a height, of all tries and forests, are cut in one
job, and a sequence joins at the first height that holds it whole.  At height 1 each turn is a node: the trie that it is in, and its own content.
Then totals are grafted upwards, again one job for each height: what the roots of a forest hold is added up for the cut prefix they hang from
and given to that prefix and its ancestors in the upper half at once, which the blocks' rows name.

A node is known by its depth and its smallest member, so everything after naming is a join of whole numbers.  No group is held whole: turns
are numbered by ranges of a sorted table, names and totals are sums with partial sums before each shuffle, joins with hot nodes
are inner joins that Spark splits, and the members that end at a node are hashed as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from .periodic_runs import crc32_sql

ENDS = 4096  # of a node's members in one string at most, before these are hashed in order


def _name(*parts) -> F.Column:
    """128 bits of SHA-256 over parts of fixed length."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


# ---------------------------------------------------------------- turns in order


@c.released
def _number(batches):
    last, seen = None, 0
    for b in batches:
        key = b.column("conv").to_numpy()
        if not len(key):
            continue
        first = c.runs(key)
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        if key[0] == last:
            head = len(key) if len(first) == 1 else first[1]
            place[:head] += seen
        last, seen = key[-1], int(place[-1]) + 1
        yield pa.record_batch([b.column("part"), b.column("conv"), pa.array(place), b.column("tok"), b.column("words")], names=["part", "conv", "p", "tok", "words"])


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, p, tok and words of every turn; p is its place from 0, by turn (null first), then role, then text; tok is its content's name.

    Rows without a conversation are left out; a null role or text is empty.  Turns are sorted by ranges, so that a conversation of any
    length is dealt to many tasks; what earlier ranges hold of the conversation that a range begins with is one row a range.
    """
    spark = turns.sparkSession
    c.prepare(spark)
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = rows.repartitionByRange(c.partitions(spark), *order).sortWithinPartitions(*order)
    tok = _name(F.encode(F.concat(F.length("role"), F.lit(":"), "role", "text"), "utf-8"))
    rows = rows.select(F.spark_partition_id().alias("part"), "conv", tok.alias("tok"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    rows = c.stored(rows.mapInArrow(_number, "part int, conv long, p long, tok binary, words long"), "turns")
    ranges = rows.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "p")).alias("last"))
    held = ranges.select("part", F.explode(F.array(F.struct(F.col("last.conv").alias("conv"), (F.col("last.p") + 1).alias("n"), F.lit(1).alias("after")), F.struct(F.col("first").alias("conv"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("after")))).alias("x")).select("part", "x.*")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part", "after").rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("before", before).where("after = 0 and before > 0").select("part", "conv", "before")  # a row for a range at most
    return rows.join(F.broadcast(held), ["part", "conv"], "left").select("conv", (F.col("p") + F.coalesce("before", F.lit(0))).alias("p"), "tok", "words")


def regrafted(rows: DataFrame, modulus: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations (conv, n) where c begins with the first h turns of c - c % modulus and goes on with its own after its first h; h = crc32(c) % heads."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads))
    first = F.collect_list(F.when(F.col("p") < heads - 1, F.struct("p", "tok", "words")))  # few turns of each conversation
    convs = rows.groupBy("conv").agg(F.max("p").alias("last"), F.array_sort(first).alias("first"))
    base = convs.where(F.col("conv") % modulus == 0).select(F.col("conv").alias("base"), F.col("first").alias("head"))
    convs = convs.select("conv", "last", h.alias("h"), (F.col("conv") - F.col("conv") % modulus).alias("base")).join(base, "base", "left")
    convs = convs.select("conv", "last", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array()).alias("head"))
    size = F.size("head")
    convs = c.stored(convs.select("conv", "h", "head", (size + F.greatest(F.lit(0), F.col("last") + 1 - F.col("h"))).alias("n")), "conversations")
    given = convs.select("conv", "n", F.explode("head").alias("x")).select("conv", "x.p", "x.tok", "x.words", "n")
    own = rows.join(convs.select("conv", "h", "n", F.size("head").alias("k")), "conv").where("p >= h").select("conv", (F.col("p") - F.col("h") + F.col("k")).alias("p"), "tok", "words", "n")
    return given.unionByName(own), convs.select("conv", "n")


# ---------------------------------------------------------------- the recursion


def named(rows: DataFrame, depth: int) -> DataFrame:
    """rows (conv, p, tok, n and others) with `key`, the name of the node that the turn is; `depth` is the greatest n."""
    heights = max(0, depth - 1).bit_length()
    level = rows.select("conv", F.col("p").alias("k"), F.col("tok").alias("seg"), "n")
    pairs = []
    for j in range(heights):  # blocks of 2**j turns become blocks of twice that; a sequence that one block holds is done
        level = level.where(F.col("n") > 1 << j).groupBy("conv", F.shiftright("k", 1).alias("k")).agg(
            F.max(F.when(F.col("k") % 2 == 0, F.col("seg"))).alias("left"), F.max(F.when(F.col("k") % 2 == 1, F.col("seg"))).alias("right"), (F.count("*") > 1).alias("lower"), F.max("n").alias("n")
        )
        level = c.stored(level.withColumn("seg", _name("left", "right")), f"blocks-{j + 1}")
        pairs.append(level)
        level = level.select("conv", "k", "seg", "n")
    tries = None
    for j in range(heights, 0, -1):
        tops = pairs[j - 1].where(F.col("n") <= 1 << j).select("conv", "k", F.lit(b"").alias("g"))
        tries = tops if tries is None else tries.unionByName(tops)
        cut = tries.join(pairs[j - 1], ["conv", "k"])
        upper = F.struct((2 * F.col("k")).alias("k"), F.col("g").alias("g"))
        lower = F.when(F.col("lower"), F.struct((2 * F.col("k") + 1).alias("k"), _name("g", "left").alias("g")))
        tries = cut.select("conv", F.explode(F.array_compact(F.array(upper, lower))).alias("x")).select("conv", "x.k", "x.g")
    single = rows.where("n = 1").withColumn("g", F.lit(b""))
    if tries is not None:
        many = rows.where("n > 1").join(tries.withColumnRenamed("k", "p"), ["conv", "p"])
        single = single.unionByName(many.select(*single.columns))
    return single.withColumn("key", _name("g", "tok")).drop("g")


def grafted(own: DataFrame, path: DataFrame, depth: int, totals: list[str]) -> DataFrame:
    """Sums of `totals` over the subtree of each node, itself included.

    own: node, p, parent (its smallest member, null at p = 0) and totals; path: conv, p, node and n, the node that each turn of a conversation is.
    """
    sums = [F.sum(x).alias(x) for x in totals]
    given = []
    for j in range(max(0, depth - 1).bit_length()):
        half = 1 << j
        roots = F.col("p") % (2 * half) == half  # of the forests below the cuts at this height
        parts = own.where(roots).select("node", "p", "parent", *totals)
        for x in given:
            parts = parts.unionByName(x.where(roots).select("node", "p", F.lit(None).cast("long").alias("parent"), *totals))
        whole = parts.groupBy("node", "p").agg(F.max("parent").alias("parent"), *sums) if given else parts
        cut = whole.groupBy(F.col("parent").alias("conv"), F.shiftright(F.col("p") - 1, j).alias("block")).agg(*sums)
        upper = path.where((F.col("n") >= half) & (F.shiftright("p", j) % 2 == 0)).select("conv", F.shiftright("p", j).alias("block"), "p", "node")
        given.append(c.stored(upper.join(cut, ["conv", "block"]).groupBy("node", "p").agg(*sums), f"grafts-{j}"))
    out = own.select("node", "p", *totals)
    for x in given:
        out = out.unionByName(x)
    return out.groupBy("node", "p").agg(*sums)


# ---------------------------------------------------------------- nodes


def _hashed(batches):
    """Rows sorted by node, depth and block: SHA-256 of each node's comma-joined strings, taken in as they come."""
    key, digest, done = None, None, []

    def out():
        return pa.record_batch([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["node", "depth", "ends_sha256"])

    for b in batches:
        for node, depth, ids in zip(b.column("node").to_pylist(), b.column("depth").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if (node, depth) == key:
                digest.update(b",")
            else:
                if key:
                    done.append((*key, digest.hexdigest()))
                key, digest = (node, depth), hashlib.sha256()
            digest.update(ids.encode())
        yield out()
        done.clear()
    if key:
        done.append((*key, digest.hexdigest()))
        yield out()


def ends(members: DataFrame) -> DataFrame:
    """node, depth and ends_sha256 of the members (node, depth, conv) that end there, by number; a string holds ENDS of them at most, since conv is distinct."""
    strings = members.groupBy("node", "depth", F.floor(F.col("conv") / ENDS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))
    order = ["node", "depth", "block"]
    return strings.repartition(c.partitions(members.sparkSession), "node", "depth").sortWithinPartitions(*order).mapInArrow(_hashed, "node long, depth long, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of all prefixes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    rows: conv, p, tok, words, n of each turn; convs: conv, n, those without turns too.  The root is at depth 0; without conversations there is none.
    """
    rows = c.stored(rows, "sequences")
    depth = convs.agg(F.max("n")).first()[0] or 0
    keyed = c.stored(named(rows, depth), "named")
    # stored, since Spark splits a hot key's rows only where both sides of a join come from shuffles of their own
    nodes = c.stored(keyed.groupBy("key").agg(F.min("conv").alias("node"), F.first("p").alias("p"), F.count("*").alias("n_convs"), F.first("words").alias("words")), "keys")
    path = c.stored(keyed.select("key", "conv", "p", "n").join(nodes.select("key", "node"), "key").drop("key"), "path")
    above = path.select(F.col("conv").alias("node"), (F.col("p") + 1).alias("p"), F.col("node").alias("parent"))
    nodes = c.stored(nodes.drop("key").join(above, ["node", "p"], "left"), "nodes")
    children = nodes.groupBy(F.col("parent").alias("node"), (F.col("p") - 1).alias("p")).agg(F.count("*").alias("n_children")).where("node is not null")
    own = nodes.join(children, ["node", "p"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = c.stored(own.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words")), "own")
    totals = ["n_leaves", "saved_tokens"]
    whole = own.drop(*totals).join(grafted(own, path, depth, totals), ["node", "p"])
    whole = whole.withColumn("depth", F.col("p") + 1)
    least, most = convs.agg(F.min("conv"), F.count("*")).first()
    below = own.agg(F.count(F.when(F.col("p") == 0, 1)), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    spark = rows.sparkSession
    root = spark.createDataFrame([(least, 0, None, most, below[0], below[1] or 1, below[2] or 0)] if most else [], f"node long, depth long, parent long, n_convs long, n_children long, {totals[0]} long, {totals[1]} long")
    none = convs.where("n = 0").select(F.lit(least).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), "conv")
    closed = ends(path.where(F.col("p") == F.col("n") - 1).select("node", (F.col("p") + 1).alias("depth"), "conv").unionByName(none))
    # the root's parent is no node; at depth 1 it is the root
    out = whole.select("node", "depth", F.coalesce("parent", F.lit(least).cast("long")).alias("parent"), "n_convs", "n_children", *totals).unionByName(root).join(closed, ["node", "depth"], "left")
    numbers = [F.col(x).cast("long").alias(x) for x in ("n_convs", "n_children", *totals)]
    return out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), *numbers, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of conversations as they are; see trie().

    Turns go by turn (null first), then role, then text; a null role or text is empty, repeated rows are turns of their own, rows without a
    conversation are left out, other columns are not read.  Empty tables have no nodes.
    """
    rows = numbered(turns, conv, turn, role, text)
    n = rows.groupBy("conv").agg((F.max("p") + 1).alias("n"))
    return trie(rows.join(n, "conv"), n)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of the one that its twenty begin with."""
    return trie(*regrafted(numbered(c.table(spark, sf_dir, "conversations"))))


OP13_SQL = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p, role, text FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, t.p, role, text FROM c JOIN t ON t.conv_id = c.base WHERE t.p < h UNION ALL SELECT c.conv_id, 1, t.p, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.p >= h),
o AS (SELECT conv_id, d, text, list(x) OVER (PARTITION BY conv_id ORDER BY d) AS k FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d, text, sha256(length(role) || ':' || role || text) AS x FROM r)),
a AS (SELECT conv_id, d, k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM o UNION ALL SELECT conv_id, 0, [], 0 FROM c),
n AS (SELECT d, k, min(conv_id) AS node, count(*) AS n, max(words) AS words FROM a GROUP BY d, k),
q AS (SELECT a.conv_id, d, node FROM a JOIN n USING (d, k)), e AS (SELECT conv_id, max(d) AS d FROM a GROUP BY conv_id),
b AS (SELECT n.d, n.node, n.n, n.words, q.node AS parent FROM n LEFT JOIN q ON q.conv_id = n.node AND q.d = n.d - 1),
m AS (SELECT b.*, (SELECT count(*) FROM b x WHERE x.d = b.d + 1 AND x.parent = b.node) AS children FROM b),
s AS (SELECT q.d, q.node, sum(CASE WHEN m.children = 0 THEN 1 ELSE 0 END) AS leaves, sum((m.n - 1) * m.words) AS saved FROM m JOIN q ON q.conv_id = m.node AND q.d <= m.d GROUP BY q.d, q.node),
g AS (SELECT d, node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM q JOIN e USING (conv_id, d) GROUP BY d, node)
SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, children AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM m JOIN s USING (d, node) LEFT JOIN g USING (d, node)
"""
