"""Readers of the text and binary inputs, as typed DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits


def tsv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Tab-separated text; NaN becomes null."""
    df = spark.read.csv(path, sep="\t", header=header, schema=schema, nanValue="NaN")
    return df.select(*(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema.fields))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """The last element of a settings document's array, in a row."""
    return spark.read.json(path, multiLine=True)


def state_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """frame and state of ragged lines `frame, flag, flag ...`; lines without a number first are left out."""
    parts = F.split(F.trim(F.col(column)), r"\s*,\s*")
    frame = F.try_to_number(F.get(parts, 0), F.lit("999999999")).cast("long")
    return lines.select(frame.alias("frame"), F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("state")).where("frame is not null and state <> ''")


def words(spark: SparkSession, path: str) -> DataFrame:
    """file, pos and w of little-endian 16-bit word files, decoded a file at a time by the JVM's reader."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                w = np.frombuffer(raw.as_buffer(), "<u2")
                for at in range(0, len(w), 1 << 20):
                    part = w[at : at + (1 << 20)].astype(np.int32)
                    yield pa.record_batch([pa.array([p] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(part)], names=["file", "pos", "w"])

    return files.mapInArrow(decode, "file string, pos long, w int")


def records(stream: DataFrame, code: int, length: int) -> DataFrame:
    """Records of `length` words that start with a code and whose checksum is 0: file, pos and their words as w0, w1 ...

    Records that overlap an earlier valid one of their code are left to the caller, who knows which code wins.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("pos")
    ahead = [F.lead("w", i).over(w) if i else F.col("w") for i in range(length)]
    rows = stream.select("file", "pos", *(a.alias(f"w{i}") for i, a in enumerate(ahead)))
    payload = [bits.word_payload(F.col("w0")), *(F.col(f"w{i}") for i in range(1, length))]
    return rows.where((bits.word_code(F.col("w0")) == code) & (bits.checksum([p.bitwiseAND(4095) for p in payload]) == 0))
