"""Raw word files to timers, scan settings, tags and photons on one clock.

A file is cut into ranges of words, and every range is read with CONTEXT more words on either side, so that records, the tags and the
timers that its words refer to are at hand.  Two passes, neither of which shuffles words:

1. `scan` finds each range's timers and sends a line for each run of equal counters, with sums over its tags.  From these few lines
   Spark derives the counter's wraps, each range's first timer number, the counters that are complete, what a file's
   tags hold (`index`), and each counter's clock (`clocks`).
2. `decoded` reads each range again with its lines of the index and puts every record on the clock with numpy.

A record belongs to the range in which it starts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the format: codes of words, ticks between timers, timers and ticks of a counter, wrap of the counter.
TIMER, AOD, TAG, GREEN, RED, BOTH = 8, (12, 13), (7, 15), (1, 9), (2, 10), (3, 11)
STEP, PER_COUNTER, COUNTER, WRAP = 4096, 1 << 16, 1 << 28, 4096
CONTEXT = 4096
#: In which order timers around a tag are tried: the one before, then further ones on either side.
TRIALS = [0, *(s * k for k in range(1, 9) for s in (-1, 1))]
EVENTS = "file string, kind string, pos long, beam int, color string, tick long, period double, phase double, x double, y double, z double, counter long, matched boolean"


def ranges(spark: SparkSession, path: str, words: int = 1 << 22) -> DataFrame:
    """file, range, start and n, in words, of all files of a path; a last odd byte is left out."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.floor(F.col("length") / 2).alias("words"))
    cut = files.where("words > 0").select("file", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / words))).alias("range"))
    start = F.col("range") * words
    out = cut.select("file", "range", start.alias("start"), F.least(F.lit(words), F.col("words") - start).alias("n"))
    return out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "range")


def _read(file: str, start: int, n: int) -> tuple[np.ndarray, int]:
    """Words from CONTEXT before start to CONTEXT after its n, and where start is among them."""
    fs, name = pa.fs.FileSystem.from_uri(file if "://" in file else file.replace("file:", "file://", 1))
    first = max(0, start - CONTEXT)
    with fs.open_input_file(name) as f:
        raw = f.read_at(2 * (start - first + n + CONTEXT), 2 * first)
    return np.frombuffer(raw[: len(raw) // 2 * 2], "<u2"), start - first


def marks(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of valid timers and AOD records, which words belong to records, and how many codes outside have a wrong checksum."""
    code = w >> 12

    def valid(at, size):
        at = at[at + size < len(w)]
        xs = np.zeros(len(at), np.uint16)
        for k in range(1, size + 1):
            xs ^= w[at + k]
        return at[xs == 0], at[xs != 0]

    def inside(at, size):
        out = np.zeros(len(w), bool)
        for k in range(1, size + 1):
            out[at + k] = True
        return out

    timers, bad_t = valid(np.flatnonzero(code == TIMER), 7)
    aods, bad_a = valid(np.flatnonzero((code == AOD[0]) | (code == AOD[1])), 3)
    aods = aods[~inside(timers, 7)[aods]]
    timers = timers[~inside(aods, 3)[timers]]
    used = inside(timers, 7) | inside(aods, 3)
    bad = int((~used[bad_t]).sum() + (~used[bad_a]).sum())
    used[timers] = used[aods] = True
    return timers, aods, used, bad


def _nearest(tags: np.ndarray, timers: np.ndarray) -> np.ndarray:
    """The tag nearest each timer in words, of two as near the earlier one; -1 before the first tag and after the last."""
    if not len(tags):
        return np.full(len(timers), -1)
    after = np.minimum(np.searchsorted(tags, timers), len(tags) - 1)
    before = np.maximum(after - 1, 0)
    near = np.where(np.abs(tags[after] - timers) < np.abs(timers - tags[before]), after, before)
    return np.where((timers < tags[0]) | (timers > tags[-1]), -1, near)


def _passed(tags: np.ndarray, v: np.ndarray, at: int) -> np.ndarray:
    """Ticks from a range's start to each tag, if tags hold the interval since the last one less a tick."""
    total = np.cumsum(v + 1)
    return total - (total[tags < at][-1] if (tags < at).any() else 0)


_MOMENTS = [f"{x}{beam}" for beam in (1, 2) for x in ("tags", "sum", "squares", "timers", "places", "passed")]


def _scan(batches):
    names = ["file", "range", "run", "counter", "n", "bad", *_MOMENTS]
    for b in batches:
        for file, k, start, n in zip(*(b.column(x).to_pylist() for x in ("file", "range", "start", "n")), strict=True):
            w, at = _read(file, start, n)
            timers, _, used, bad = marks(w)
            timers = timers[(timers >= at) & (timers < at + n)]
            c = w[timers].astype(np.int64) & 4095
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, int)
            size = np.diff(np.r_[first, len(c)])
            rows = len(first) or 1
            zero, moments = [0] * (rows - 1), []
            for beam in (1, 2):
                tags = np.flatnonzero((w >> 12 == TAG[beam - 1]) & ~used)
                v = w[tags].astype(np.int64) & 4095
                own = v[(tags >= at) & (tags < at + n)]
                near = _nearest(tags, timers)
                some = (near >= 0).astype(np.int64)
                passed = np.where(near >= 0, _passed(tags, v, at)[near] if len(tags) else 0, 0)
                moments += [[len(own), *zero], [int(own.sum()), *zero], [int((own * own).sum()), *zero]]
                place = some * (np.arange(len(c)) - np.repeat(first, size))
                moments += [np.add.reduceat(x, first).tolist() if len(c) else [0] for x in (some, place, passed)]
            columns = [pa.array([file] * rows), pa.array([k] * rows), pa.array(np.arange(rows)), pa.array(c[first] if len(c) else np.array([None], object), pa.int64()), pa.array(size if len(c) else np.zeros(1, np.int64)), pa.array([bad, *zero])]
            yield pa.record_batch([*columns, *(pa.array(x, pa.int64()) for x in moments)], names=names)


def scan(cut: DataFrame) -> DataFrame:
    """Of each range its runs of equal counters: file, range, run, counter, n timers; in the first run `bad` checksums and, by beam, how
    many tags there are, their sum and their squares' sum; in each run how many timers lie between tags, their places in the run, and the
    ticks that had passed since the range's start at the tags nearest them.
    """
    return cut.mapInArrow(_scan, ", ".join(["file string", *(f"{x} long" for x in ("range", "run", "counter", "n", "bad", *_MOMENTS))]))


def index(runs: DataFrame) -> DataFrame:
    """runs with the counter unwrapped, `first`, the number of their first timer in the file, `wraps` that came before, and by beam
    `start`, the ticks that had passed before their range, and `absolute`, whether the file's tags give their time: they then scatter by over a
    fifth of their mean.

    A line for each counter and range: few, and so one window a file.
    """
    w = Window.partitionBy("file").orderBy("range", "run")
    last = F.last("counter", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = runs.withColumn("_down", F.when(F.col("counter") < last, 1).otherwise(0)).withColumn("first", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = r.withColumn("wraps", F.sum("_down").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    for beam in (1, 2):
        n, total, squares = (F.sum(f"{x}{beam}").over(Window.partitionBy("file")) for x in ("tags", "sum", "squares"))
        r = r.withColumn(f"start{beam}", F.coalesce(F.sum(F.col(f"sum{beam}") + F.col(f"tags{beam}")).over(Window.partitionBy("file").orderBy("range").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        mean = F.try_divide(total, n)
        spread = F.try_divide(squares - total * mean, n - 1)
        r = r.withColumn(f"absolute{beam}", F.coalesce(spread > 0.04 * mean * mean, F.lit(False)))
    return r.withColumn("counter", F.col("counter") + WRAP * F.col("wraps")).drop("_down")


def counters(indexed: DataFrame, complete: int = PER_COUNTER) -> DataFrame:
    """Of each counter of a file: n timers, `first` timer's number, whether it is complete; t0 and t1 in seconds."""
    g = indexed.where("counter is not null").groupBy("file", "counter").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return g.withColumn("complete", F.col("n") == complete).withColumn("t0", F.col("counter") * (COUNTER / 1.6e8)).withColumn("t1", (F.col("counter") + 1) * (COUNTER / 1.6e8))


def clocks(indexed: DataFrame, complete: int = PER_COUNTER) -> DataFrame:
    """counters() with `shift1` and `shift2`: by beam, what turns the ticks that have passed at a tag into its time.

    Of a complete counter the mean over its timers of their time less what had passed at the tags nearest them; of another that of
    the next complete one, else of the last; where no counter is complete, each has its own.
    """
    c = counters(indexed, complete)
    per = indexed.where("counter is not null").join(c.select("file", "counter", F.col("first").alias("_f")), ["file", "counter"])
    begin = F.col("counter") * COUNTER + (F.col("first") - F.col("_f")) * STEP  # of the run's first timer
    sums = []
    for beam in (1, 2):
        n = F.col(f"timers{beam}")
        sums.append(F.try_divide(F.sum(n * (begin - F.col(f"start{beam}")) + STEP * F.col(f"places{beam}") - F.col(f"passed{beam}")), F.sum(n)).alias(f"_s{beam}"))
    c = c.join(per.groupBy("file", "counter").agg(*sums), ["file", "counter"], "left")
    w = Window.partitionBy("file").orderBy("counter")  # a line for each counter
    for beam in (1, 2):
        own = F.when(F.col("complete"), F.col(f"_s{beam}"))
        after, before = F.first(own, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        c = c.withColumn(f"shift{beam}", F.coalesce(after, before, F.col(f"_s{beam}")))
    return c.drop("_s1", "_s2")


def report(indexed: DataFrame, complete: int = PER_COUNTER) -> DataFrame:
    """Of each file: counters, those that lack timers or are missing between the first and the last, and wrong checksums."""
    c = counters(indexed, complete).groupBy("file").agg(F.count("*").alias("counters"), F.count_if(~F.col("complete")).alias("incomplete"), (F.max("counter") - F.min("counter") + 1 - F.count("*")).alias("missing"))
    return c.join(indexed.groupBy("file").agg(F.sum("bad").alias("bad")), "file")


def _aligned(tick: np.ndarray, before: np.ndarray, low: np.ndarray, agree: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Ticks of records that know their low bits: those of the first timer tried that agrees in some bits; and whether one did."""
    out, good = np.zeros(len(low), np.int64), np.zeros(len(low), bool)
    for o in TRIALS:
        t = tick[np.clip(before + o, 0, len(tick) - 1)]
        new = ~good & ((t & agree) == (low & agree))
        out[new], good = (t & ~np.int64(keep))[new] + low[new], good | new
    t = tick[np.clip(before, 0, len(tick) - 1)]
    out[~good] = (t & ~np.int64(keep))[~good] + low[~good]
    return out, good


def _interpolated(tick: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Ticks of records that agree with no timer, between those of the records beside them that do."""
    if good.sum() > 1 and not good.all():
        tick[~good] = np.round(np.interp(np.flatnonzero(~good), np.flatnonzero(good), tick[good])).astype(np.int64)
    return tick


def _placed(w: np.ndarray, at: int, n: int, number: int, known: list[dict], start: tuple[int, int], absolute: tuple[bool, bool]):
    """Arrays of every record that starts in w[at : at + n].

    number: of its first timer; known: the counters near (first timer's number, tick, complete, shift1, shift2); start and
    absolute: by beam, ticks passed before the range, and what the file's tags hold.
    """
    timers, aods, used, _ = marks(w)
    data, code = (w & 4095).astype(np.int64), w >> 12
    own = lambda p: (p >= at) & (p < at + n)
    i = np.arange(len(timers)) - int((timers < at).sum()) + number
    if not known or not len(timers):
        return
    known = sorted(known, key=lambda x: x["first"])
    whole = [x for x in known if x["complete"]] or known
    k, tick0 = (np.array([x[c] for x in whole], np.int64) for c in ("first", "tick"))
    if len(whole) == 1:
        tick = (i - k[0]) * STEP + tick0[0]
    else:
        s = np.clip(np.searchsorted(k, i, side="right") - 1, 0, len(k) - 2)
        tick = np.round(tick0[s] + (tick0[s + 1] - tick0[s]) * ((i - k[s]) / (k[s + 1] - k[s]))).astype(np.int64)
    place = np.stack([w[timers + j].view(np.int16) / 64 for j in range(2, 8)], 1)
    mine = own(timers)
    for beam in (1, 2):
        xyz = place[mine, 3 * (beam - 1) : 3 * beam]
        yield {"kind": "timer", "pos": timers[mine], "beam": beam, "tick": tick[mine], "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "counter": tick[mine] // COUNTER}
    before = lambda p: np.searchsorted(timers, p) - 1
    for beam in (1, 2):
        p = aods[code[aods] == AOD[beam - 1]]
        low, b = data[p] * 16, before(p)
        t = [tick[np.clip(b + o, 0, len(tick) - 1)] for o in (0, 1, -1)]
        fits = [(x & 61440) == (low & 61440) for x in t]
        base = np.where(fits[2], t[2], np.where(fits[1], t[1], t[0]))
        good = fits[0] | fits[1] | fits[2]
        at_tick = _interpolated((base & ~np.int64(65535)) + low, good)
        mine = own(p)
        p = p[mine]
        yield {"kind": "aod", "pos": p, "beam": beam, "tick": at_tick[mine], "x": w[p + 2].view(np.int16) / 64, "y": w[p + 3].view(np.int16) / 64, "matched": good[mine]}
    for beam in (1, 2):
        tags = np.flatnonzero((code == TAG[beam - 1]) & ~used)
        if not len(tags):
            continue
        v = data[tags]
        if absolute[beam - 1]:
            elapsed, good = _aligned(tick, before(tags), 4 * v, 0x3000, 0x3FFF)
            elapsed = _interpolated(elapsed, good)
            period = np.diff(elapsed, prepend=elapsed[:1]).astype(float)
            period[:1] = period[1:2] if len(period) > 1 else np.nan
        else:
            period, good = v.astype(float), np.ones(len(v), bool)
            # a counter's clock holds up to the first tag after its last timer
            of = np.searchsorted([x["first"] for x in known], i, side="right") - 1
            change = np.flatnonzero(np.diff(of))
            edge = tags[np.minimum(np.searchsorted(tags, timers[change]), len(tags) - 1)]
            counter = np.append(of[change], of[-1])[np.searchsorted(edge, tags)]
            shift = np.array([x[f"shift{beam}"] or 0.0 for x in known])[np.maximum(counter, 0)]
            elapsed = np.round(start[beam - 1] + _passed(tags, v, at) + shift).astype(np.int64)
        mine = own(tags)
        yield {"kind": "tag", "pos": tags[mine], "beam": beam, "tick": elapsed[mine], "period": period[mine], "matched": good[mine]}
        for color, codes in (("g", (GREEN, BOTH)), ("r", (RED, BOTH))):
            p = np.flatnonzero(((code == codes[0][beam - 1]) | (code == codes[1][beam - 1])) & ~used)
            p = p[own(p)]
            last = np.searchsorted(tags, p) - 1
            next_ = np.minimum(last + 1, len(tags) - 1)
            near = np.where((last < 0) | (tags[next_] - p <= p - tags[np.maximum(last, 0)]), next_, last)
            base = np.where(last >= 0, elapsed[np.maximum(last, 0)], elapsed[0] - np.nan_to_num(period[0]).astype(np.int64))
            with np.errstate(divide="ignore", invalid="ignore"):
                phase = 2 * np.pi * data[p] / period[near]
            yield {"kind": "photon", "pos": p, "beam": beam, "color": color, "tick": base + data[p], "period": period[near], "phase": phase, "matched": last >= 0}


def _decode(absolute, batches):
    fields = [x.split() for x in EVENTS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    for b in batches:
        for r in b.to_pylist():
            file, start, n = r["file"], r["start"], r["n"]
            w, at = _read(file, start, n)
            modes = tuple(r[f"absolute{beam}"] if absolute is None else absolute for beam in (1, 2))
            for part in _placed(w, at, n, r["number"] or 0, r["known"] or [], (r["start1"] or 0, r["start2"] or 0), modes):
                rows = len(part["pos"])
                part["pos"] = part["pos"] + start - at
                part["file"] = file
                columns = []
                for name, kind in fields:
                    v = part.get(name)
                    a = pa.nulls(rows, kinds[kind]) if v is None else pa.array([v] * rows, kinds[kind]) if np.isscalar(v) else pa.array(v, kinds[kind], from_pandas=kind == "double")
                    columns.append(a)
                whole = pa.record_batch(columns, names=[x for x, _ in fields])
                for i in range(0, rows, 1 << 16):
                    yield whole.slice(i, 1 << 16)


def decoded(cut: DataFrame, indexed: DataFrame, absolute: bool | None = None, complete: int = PER_COUNTER) -> DataFrame:
    """All records of the ranges on the clock (columns EVENTS): timers with the scanners' place for each beam, AOD settings, tags with
    their period, photons of both colours with their phase.

    Timers lie STEP ticks apart between the first timers of complete counters, and of any if none near is complete.  absolute: whether tags
    give their time or the interval since the last one; None tells by how much they scatter in each file.  Intervals are added up over
    the file and set on the clock counter by counter (`clocks`).  `matched` is false where no timer near agrees with a
    record's low bits; its time lies between those of the records beside it.  A range without timers near it gives nothing.
    """
    from functools import partial

    one = [F.max(x).alias(x) for x in ("start1", "start2", "absolute1", "absolute2")]
    ranges_ = indexed.groupBy("file", "range").agg(F.min("first").alias("number"), F.min("counter").alias("low"), F.max("counter").alias("high"), *one)
    need = ranges_.where("low is not null").select("file", "range", F.explode(F.sequence(F.col("low") - 1, F.col("high") + 2)).alias("counter"))
    line = F.struct("first", (F.col("counter") * COUNTER).alias("tick"), "complete", "shift1", "shift2")
    known = need.join(clocks(indexed, complete), ["file", "counter"]).groupBy("file", "range").agg(F.collect_list(line).alias("known"))  # a handful
    rows = cut.join(ranges_.drop("low", "high"), ["file", "range"], "left").join(known, ["file", "range"], "left")
    return rows.mapInArrow(partial(_decode, absolute), EVENTS)


def of_kind(events: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """One kind's records with the columns that it needs."""
    return events.where(F.col("kind") == kind).select("file", "beam", *columns)
