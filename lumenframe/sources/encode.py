"""Raw word files from photons: the format that `decode` reads, for recordings that are cut, merged or made anew.

Every counter is written whole, PER_COUNTER timers with the scanners' place, AOD settings and tags between them, by one task, and so a
file for each counter; nothing else is shuffled.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decode

TAGS, LATE, SETTINGS = 4, 4, 16  # tags between two timers, ticks from a timer to the first, timers between two settings


def words(counter: int, tick: np.ndarray, color: np.ndarray, absolute: bool, timers: int = decode.PER_COUNTER) -> np.ndarray:
    """The words of one counter: its timers, settings and tags on beam 1, and photons (codes of `decode`'s colors: 1 green, 2 red, 3 both).

    A photon holds the ticks since the last tag.  Timers' places and settings are a fixed pattern of their number.
    """
    k = np.arange(timers, dtype=np.int64)
    base = counter * decode.COUNTER + k * decode.STEP
    place = (np.stack([k, k * 3, k * 7, k, k * 5, k * 11], 1) % 2048).astype(np.uint16)
    clock = np.zeros((timers, 8), np.uint16)
    clock[:, 0] = decode.TIMER << 12 | counter % decode.WRAP
    clock[:, 1] = np.bitwise_xor.reduce(place, axis=1)
    clock[:, 2:] = place
    s = k[::SETTINGS]
    low = (base[s] % 65536 + 160) // 16
    xy = (np.stack([s * 2, s * 9], 1) % 2048).astype(np.uint16)
    setting = np.stack([decode.AOD[0] << 12 | low, xy[:, 0] ^ xy[:, 1], xy[:, 0], xy[:, 1]], 1).astype(np.uint16)
    gap = decode.STEP // TAGS
    tags = (base[:, None] + LATE + gap * np.arange(TAGS)).ravel()
    tag = decode.TAG[0] << 12 | (tags % 16384 // 4 if absolute else np.full(len(tags), gap - 1))
    since = (tick - LATE - counter * decode.COUNTER) % gap
    parts = [(base, clock), (base[s] + 1, setting), (tags, tag[:, None]), (tick, (color.astype(np.int64) << 12 | since)[:, None])]
    when = np.concatenate([t for t, _ in parts])
    size = np.concatenate([np.full(len(t), x.shape[1]) for t, x in parts])
    order = np.lexsort((np.concatenate([np.full(len(t), i) for i, (t, _) in enumerate(parts)]), when))
    start = np.empty(len(when), np.int64)
    start[order] = np.cumsum(size[order]) - size[order]
    out, first = np.empty(int(size.sum()), "<u2"), 0
    for t, x in parts:
        at = start[first : first + len(t)]
        for j in range(x.shape[1]):
            out[at + j] = x[:, j]
        first += len(t)
    return out


def _write(folder: str, absolute: bool, d: pd.DataFrame) -> pd.DataFrame:
    counter = int(d["counter"].iloc[0])
    rows = d[d["tick"].notna()].sort_values("tick", kind="stable")
    w = words(counter, rows["tick"].to_numpy(np.int64), rows["color"].to_numpy(np.int64), absolute)
    fs, path = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    fs.create_dir(path)
    name = f"{path}/{counter:08d}.bin"
    part = f"{path}/_{counter:08d}.{uuid.uuid4().hex}"  # a task that runs twice leaves one whole file
    with fs.open_output_stream(part) as f:
        f.write(w.tobytes())
    fs.move(part, name)
    return pd.DataFrame({"file": [name], "words": [len(w)]})


def recording(photons: DataFrame, folder: str, absolute: bool = True) -> DataFrame:
    """Writes photons (tick, color 1 to 3) as word files, one for each counter from the first to the last; returns file and words.

    Rows without a tick are left out.  A counter is one task: PER_COUNTER timers and its photons.
    """
    rows = photons.where(F.col("tick").isNotNull()).select(F.floor(F.col("tick") / decode.COUNTER).alias("counter"), F.col("tick").cast("long").alias("tick"), F.col("color").cast("int").alias("color"))
    span = rows.agg(F.min("counter").alias("low"), F.max("counter").alias("high")).where("low is not null")
    every = span.select(F.explode(F.sequence("low", "high")).alias("counter"), F.lit(None).cast("long").alias("tick"), F.lit(None).cast("int").alias("color"))
    return rows.unionByName(every).groupBy("counter").applyInPandas(partial(_write, folder, absolute), "file string, words long")
