"""Files of fixed-width numbers as a data source: rows of the same number of values, read in ranges.

    spark.dataSource.register(fixed.FixedWidth)
    spark.read.format("fixed").option("columns", "t x y z").option("type", "<f8").load(folder)

Options: columns, names by blanks; type, a numpy type; layout, `rows` (a row's values together, as writers of points leave them) or `columns` (all of
the first column, then all of the second, and so on); rows, of a range at the most.  Files are cut into ranges of whole rows, each a partition;
a last part of a row is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Range(InputPartition):
    file: str
    first: int
    rows: int
    total: int


def _files(path: str) -> tuple[pa.fs.FileSystem, list[pa.fs.FileInfo]]:
    fs, at = pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    info = fs.get_file_info(at)
    if info.type == pa.fs.FileType.Directory:
        found = fs.get_file_info(pa.fs.FileSelector(at))
        return fs, sorted((f for f in found if f.type == pa.fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
    if info.type != pa.fs.FileType.File:
        raise FileNotFoundError(path)
    return fs, [info]


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.names = options["path"], options["columns"].split()
        self.type, self.layout, self.most = np.dtype(options.get("type", "<f8")), options.get("layout", "rows"), int(options.get("rows", 1 << 20))
        if self.layout not in ("rows", "columns"):
            raise ValueError("layout is rows or columns")

    def partitions(self) -> list[Range]:
        width, out = self.type.itemsize * len(self.names), []
        for f in _files(self.path)[1]:
            total = f.size // width
            out += [Range(f.path, a, min(self.most, total - a), total) for a in range(0, total, self.most)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range):
        if not partition.rows:
            return
        fs, size = _files(self.path)[0], self.type.itemsize
        with fs.open_input_file(partition.file) as f:
            if self.layout == "rows":
                raw = f.read_at(size * len(self.names) * partition.rows, size * len(self.names) * partition.first)
                columns = list(np.frombuffer(raw, self.type).reshape(-1, len(self.names)).T)
            else:
                columns = [np.frombuffer(f.read_at(size * partition.rows, size * (k * partition.total + partition.first)), self.type) for k in range(len(self.names))]
        kind = pa.float64() if self.type.kind == "f" else pa.int64()
        yield pa.record_batch([pa.array(np.ascontiguousarray(c).astype(self.type.newbyteorder("="))).cast(kind) for c in columns], names=self.names)


class FixedWidth(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixed"

    def schema(self) -> str:
        kind = "double" if np.dtype(self.options.get("type", "<f8")).kind == "f" else "long"
        return ", ".join(f"`{c}` {kind}" for c in self.options["columns"].split())

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def doubles(spark, path: str, columns: list[str], type: str = "<f8", layout: str = "rows", rows: int = 1 << 20):
    """Points or dwell of raw files: the named columns of every row."""
    spark.dataSource.register(FixedWidth)
    return spark.read.format("fixed").option("columns", " ".join(columns)).option("type", type).option("layout", layout).option("rows", rows).load(path)


def _write(folder: str, columns: list[str], type: str, batches):
    import uuid

    fs, at = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
    fs.create_dir(at)
    part, n = f"{at}/_{uuid.uuid4().hex}", 0
    with fs.open_output_stream(part) as f:
        for b in batches:
            f.write(np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(type) for c in columns], 1).tobytes())
            n += b.num_rows
    if n:
        fs.move(part, f"{at}/{uuid.uuid4().hex}.bin")
    else:
        fs.delete_file(part)
    yield pa.record_batch([pa.array([n])], names=["rows"])


def write_doubles(df, folder: str, columns: list[str], type: str = "<f8") -> int:
    """Writes the named columns as raw numbers, a row's together, a file for each partition that has rows; returns how many rows.

    Files appear whole, but a task that runs twice may leave two: write to a folder that is read only if the number of rows is right.
    """
    from functools import partial

    from pyspark.sql import functions as F

    fs, at = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
    fs.create_dir(at)
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    return rows.mapInArrow(partial(_write, folder, columns, type), "rows long").agg(F.sum("rows")).first()[0] or 0
