"""Raw word files that grow: ranges of words as a stream, decoded as counters close.

    query = recordings.decoded_as_it_grows(spark, folder, work).trigger(availableNow=True).start()

The source's offset is how many ranges of each file have been given; a range is given once CONTEXT words beyond it are there.  A micro-batch scans
its ranges, keeps their lines of the index, and decodes the ranges whose counters a later one has followed, with the whole file's index.  All
that a batch writes carries its number and is overwritten if it runs again, so each record comes out once.
`finish` decodes what is left when a recording has ended; together that is what `decode` makes of the whole files.
"""

from __future__ import annotations

import json

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources import decode

RANGE = "file string, range long, start long, n long"
_LINE = ", ".join(["file string", *(f"{x} long" for x in ("range", "run", "counter", "n", "bad", *decode._MOMENTS)), "batch long"])


class _Ranges(SimpleDataSourceStreamReader):
    """Runs on the driver: it lists files and gives a line for each range, not words."""

    def __init__(self, path: str, words: int, context: int):
        self.path, self.words, self.context = path, words, context

    def initialOffset(self) -> dict:
        return {"given": "{}"}

    def _there(self) -> dict[str, int]:
        fs, at = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path.removeprefix('file:')}")
        found = fs.get_file_info(pyarrow.fs.FileSelector(at))
        whole = lambda size: max(0, (size // 2 - self.context) // self.words)
        return {f.path: whole(f.size) for f in found if f.type == pyarrow.fs.FileType.File and not f.base_name.startswith((".", "_"))}

    def _lines(self, start: dict, end: dict):
        return [(f"file:{f}" if "://" not in f else f, k, k * self.words, self.words) for f, n in sorted(end.items()) for k in range(start.get(f, 0), n)]

    def read(self, start: dict):
        before, now = json.loads(start["given"]), self._there()
        end = before | {f: max(n, before.get(f, 0)) for f, n in now.items()}
        return iter(self._lines(before, end)), {"given": json.dumps(end, sort_keys=True)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._lines(json.loads(start["given"]), json.loads(end["given"])))


class GrowingWords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_words"

    def schema(self) -> str:
        return RANGE

    def simpleStreamReader(self, schema) -> _Ranges:
        return _Ranges(self.options["path"], int(self.options.get("words", 1 << 22)), int(self.options.get("context", decode.CONTEXT)))


def ranges(spark: SparkSession, folder: str, words: int = 1 << 22) -> DataFrame:
    """A stream of file, range, start and n, in words, of the files of a folder as they grow."""
    spark.dataSource.register(GrowingWords)
    return spark.readStream.format("growing_words").option("words", words).load(folder)


def _table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """What batches have written so far; empty before the first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], ddl)


def _decode(spark: SparkSession, work: str, batch: int, complete: int, last: bool) -> None:
    runs = _table(spark, f"{work}/index", _LINE).where(F.col("batch") <= batch).drop("batch")
    indexed = decode.index(runs)
    done = _table(spark, f"{work}/ranges", f"{RANGE}, batch long").where(F.col("batch") < batch)
    each = indexed.groupBy("file", "range").agg(F.max("counter").alias("high"))
    top = indexed.groupBy("file").agg(F.max("counter").alias("top"))
    known = _table(spark, f"{work}/given", f"{RANGE}, batch long").where(F.col("batch") <= batch).drop("batch")
    open_ = known.join(done, ["file", "range"], "left_anti")
    ready = open_ if last else open_.join(each, ["file", "range"]).join(top, "file").where("high + 1 < top").drop("high", "top")
    ready.write.mode("overwrite").parquet(f"{work}/ranges/batch={batch}")
    ready = spark.read.schema(RANGE).parquet(f"{work}/ranges/batch={batch}")
    decode.decoded(ready, indexed, None, complete).write.mode("overwrite").parquet(f"{work}/events/batch={batch}")


def _batch(work: str, complete: int):
    def run(given: DataFrame, batch: int) -> None:
        spark = given.sparkSession
        given.write.mode("overwrite").parquet(f"{work}/given/batch={batch}")
        again = spark.read.schema(RANGE).parquet(f"{work}/given/batch={batch}")
        again = again.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "range")
        decode.scan(again).write.mode("overwrite").parquet(f"{work}/index/batch={batch}")
        _decode(spark, work, batch, complete, False)

    return run


def decoded_as_it_grows(spark: SparkSession, folder: str, work: str, words: int = 1 << 22, complete: int = decode.PER_COUNTER):
    """A stream's writer that decodes the folder's files into `work`, a folder that the cluster shares; a range comes out when two
    later counters have begun, so that its counters, and the next that its clock may need, are known.
    """
    return ranges(spark, folder, words).writeStream.foreachBatch(_batch(work, complete)).option("checkpointLocation", f"{work}/checkpoint")


def finish(spark: SparkSession, folder: str, work: str, words: int = 1 << 22, complete: int = decode.PER_COUNTER) -> None:
    """Decodes what the stream has left: files' ends, and ranges whose counters nothing followed.  The stream has to be stopped."""
    batch = (_table(spark, f"{work}/given", f"{RANGE}, batch long").agg(F.max("batch")).first()[0] or 0) + 1
    all_ = decode.ranges(spark, folder, words)
    given = _table(spark, f"{work}/given", f"{RANGE}, batch long").select("file", "range")
    rest = all_.join(given, ["file", "range"], "left_anti").select("file", "range", "start", F.col("n").cast("long").alias("n"))
    rest.write.mode("overwrite").parquet(f"{work}/given/batch={batch}")
    rest = spark.read.schema(RANGE).parquet(f"{work}/given/batch={batch}")
    decode.scan(rest).write.mode("overwrite").parquet(f"{work}/index/batch={batch}")
    _decode(spark, work, batch, complete, True)


def events(spark: SparkSession, work: str) -> DataFrame:
    """What has been decoded so far (columns of decode.EVENTS)."""
    return _table(spark, f"{work}/events", f"{decode.EVENTS}, batch long").drop("batch")
