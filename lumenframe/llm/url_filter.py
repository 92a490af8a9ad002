"""URL rules by a sort-merge range join.

A host is turned into a canonical key, its labels in reverse order each ended by a dot, so that a rule's host
and all its subdomains make up one interval of keys.  URLs and rules are sorted by key over the whole cluster and
swept in that order; a stack holds the rules whose interval is open, each nested in the one below.  A partition
starts with the rules that are open at its first key, found by an equality join with that key's ancestors.  Under each
open host the rules' paths are sorted too, each linked to the longest one that it continues.
No side is broadcast, and a host with a third of all URLs is spread over as many partitions as its rows fill.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

_EVENTS = "part int, key string, kind int, path string, verdict string, row binary"


def url_parts(url):
    """Host (A-Z lower-cased) and path of a url column; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({_sql(url)}, instr({_sql(url)}, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _sql(name: str) -> str:
    return f"`{name}`" if isinstance(name, str) else name


def _key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class _Paths:
    """A host's rules by path."""

    def __init__(self, key: str):
        self.key, self.paths, self.up, self.verdicts, self.stack = key, [], [], [], []

    def add(self, path: str, verdict: str) -> None:  # in order of path
        while self.stack and not path.startswith(self.paths[self.stack[-1]]):
            self.stack.pop()
        if self.paths and self.paths[-1] == path:  # of two rules for one prefix, block comes later and wins
            self.verdicts[-1] = verdict
            return
        self.up.append(self.stack[-1] if self.stack else -1)
        self.stack.append(len(self.paths))
        self.paths.append(path)
        self.verdicts.append(verdict)

    def longest(self, path: str) -> int:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.up[i]
        return i


def _sweep(batches):
    """Of events in order of part, key, kind (open, rule, url) and path: rule and verdict of each url."""
    part, stack, out = None, [], ([], [], [])
    schema = pa.schema([("row", pa.binary()), ("rule", pa.string()), ("verdict", pa.string())])
    for b in batches:
        for p, key, kind, path, verdict, row in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind < 2:
                if not stack or stack[-1].key != key:
                    stack.append(_Paths(key))
                stack[-1].add(path, verdict)
                continue
            best = None
            for node in stack:
                if (i := node.longest(path)) >= 0:
                    size = len(node.key) + len(node.paths[i])
                    if best is None or size >= best[0]:
                        best = size, ".".join(node.key[:-1].split(".")[::-1]) + node.paths[i], node.verdicts[i]
            for x, v in zip(out, (row, best and best[1], best and best[2]), strict=True):
                x.append(v)
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema)
        out = ([], [], [])


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with `host`, `path`, `rule` and `verdict`; rules has host, path and verdict.

    A rule fits its host and all subdomains, if the url's path starts with the rule's.  The longest (host and path
    together; of equal ones the longer host) wins; of two verdicts for one rule the later in the alphabet.  No rule:
    `rule` is null and the verdict `default`.  A null url, or one without `://`, has an empty host and path, which no
    rule fits.  Rules with nulls are void.  Repeated rows stay; clashing names of new columns get an underscore.
    """
    spark = pages.sparkSession
    c.prepare(spark)
    n = c.partitions(spark)
    host, path, rule, verdict, key = c.fresh(pages, "host", "path", "rule", "verdict", "_key")
    h, p = url_parts(url)
    pages = pages.withColumn(host, F.coalesce(h, F.lit(""))).withColumn(path, F.coalesce(p, F.lit("")))
    return _judged(spark, pages, rules, n, host, path, rule, verdict, key, default)


def _judged(spark, pages, rules, n, host, path, rule, verdict, key, default):
    plain = pages.schema
    packed = pages.select(_key(F.col(host)).alias("key"), F.lit(2).alias("kind"), F.col(path).alias("path"), F.lit(None).cast("string").alias("verdict"), F.struct(*pages.columns).alias("row"))
    known = rules.where("host is not null and path is not null and verdict is not null").select(_key(F.lower("host")).alias("key"), F.lit(1).alias("kind"), F.col("path").alias("path"), F.col("verdict")).distinct()
    # The sort order is kept in the shared folder, for partitions must be the same each time that they are read.
    events = packed.unionByName(known, allowMissingColumns=True).repartitionByRange(n, "key", "kind", "path", F.xxhash64("row"))
    events = c.stored(events.select(F.spark_partition_id().alias("part"), "*"), "urls")
    labels = F.split(F.expr("substring(first, 1, length(first) - 1)"), r"\.")
    starts = events.groupBy("part").agg(F.min("key").alias("first")).select("part", "first", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))).alias("key"))
    # Rules of the first key itself may lie in this partition, or end the one before: those before are opened too.
    opened = starts.join(events.where("kind = 1").select("key", "path", "verdict", F.col("part").alias("at")), "key").where("at < part").select("part", "key", F.lit(0).alias("kind"), "path", "verdict")
    rows = events.unionByName(opened, allowMissingColumns=True)
    swept = rows.repartition(n, "part").sortWithinPartitions("part", "key", "kind", "path", "verdict")
    return swept.mapInArrow(partial(_swept, verdict, rule, default, plain), _out_schema(plain, rule, verdict))


def _out_schema(plain, rule, verdict):
    return T.StructType([*plain.fields, T.StructField(rule, T.StringType()), T.StructField(verdict, T.StringType())])


def _swept(verdict, rule, default, plain, batches):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_out_schema(plain, rule, verdict))
    carried = []

    def told():
        for b in batches:
            rows = b.column("row")
            at = [i if k == 2 else None for i, k in enumerate(b.column("kind").to_pylist())]
            carried.append(rows.filter(pa.array([i is not None for i in at])))
            yield pa.record_batch([*(b.column(x) for x in ("part", "key", "kind", "path", "verdict")), pa.nulls(b.num_rows, pa.binary())], names=["part", "key", "kind", "path", "verdict", "row"])

    for out in _sweep(told()):
        rows = carried.pop(0)
        new = {rule: out.column("rule"), verdict: pa.array([v or default for v in out.column("verdict").to_pylist()], pa.string())}
        yield pa.record_batch([new.get(f.name) if f.name in new else rows.field(f.name).cast(f.type) for f in schema], schema)


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = c.table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH r(rhost, rpath, rverdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT n, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM h LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (n)
"""
