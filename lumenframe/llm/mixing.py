"""Mixing sources to target weights by Pareto order sampling.

A source's target says how often each of its documents is taken: the whole part for certain, the rest by a sample of
fixed size with unequal inclusion odds.  A document's inclusion probability is p = min(1, level * weight), its weight the square
root of its size unless another is given; the level of a source is such that the expected words are what is left of its target.
Documents of like weight make a stratum; each stratum's sample has the size that its probabilities sum to, rounded so that
a source's sum is too.  Within it documents are ranked by random odds over inclusion odds, u / (1 - u) over p / (1 - p), and the
first ones are taken; those with p = 1 are certain.  What the drawn words miss or exceed the target by is then made good by a few
documents that change sides.

No source is sorted: ranks fall into bins that are counted before the shuffle, and only the documents of the one bin in which a
stratum's sample ends are ranked one by one.  What a source's rows need to know is a line for each stratum, sent to all
tasks if there are MOST_LINES at most, else joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

BINS, MOST_COPIES, WEIGHTS, MOST_LINES = 1 << 12, 3, (1, 2, 3), 100_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: int, keys: list[str]) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + 0.5) / float(1 << 53)


def stratum(weight: Column) -> Column:
    """Quarters of an octave of the weight; -1000 for documents that have none."""
    return F.when(weight > 0, F.floor(F.log2(weight) * 4)).otherwise(-1000).cast("int")


def rank(u: Column, weight: Column, level: Column, odds: Column) -> Column:
    """The Pareto rank, random odds over inclusion odds, times the stratum's typical odds and folded into 0 to 1."""
    p = F.least(F.greatest(level * weight, F.lit(1e-9)), F.lit(1 - 1e-9))
    q = u / (1 - u) / (p / (1 - p)) * odds
    return q / (1 + q)


def known(rows: DataFrame, lines: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """rows joined with a table of a few lines a source: broadcast if its size allows."""
    return rows.join(F.broadcast(lines) if lines.count() <= MOST_LINES else lines, on, how)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Of source and source_size: `target`.  Sources in order of code point, null last, weigh as `weights` does, repeated.

    They share the sum of all sizes by weight; none gets over `most` times its size, and what is cut off is
    shared by the rest by weight until none is above.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped, gone = F.coalesce(F.sum("cap").over(order), F.lit(0.0)), F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    t = t.withColumn("all", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    # What a unit of weight gets if all sources before this one, in order of cap by weight, are held at their caps: the
    # first source that this does not lift above its own cap sets the level for all.
    t = t.withColumn("level", (F.col("all") - capped) / (F.col("weights") - gone)).withColumn("place", F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())))
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    level = F.min(free).over(whole)["level"]
    return t.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).select("source", "source_size", "target")


def levels(strata: DataFrame, plan: DataFrame) -> DataFrame:
    """Of each stratum: `level`, `odds` (typical inclusion odds) and `take`, the size of its sample.

    strata: source, stratum, n, weights, words, both (sum of weight times words), heaviest.  Strata are taken from the heaviest: the
    first that the words left by those before it do not lift over a probability of 1 sets the level for all.
    """
    s = strata.where(F.col("stratum") > -1000).join(plan.select(F.col("source").alias("s"), "left"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    down = Window.partitionBy("source").orderBy(F.desc("stratum"))
    before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("both").over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("left") - before) / after)
    s = s.withColumn("level", F.when((F.col("level") >= 0) & (F.col("level") * F.col("heaviest") <= 1), F.struct(-F.col("stratum"), "level")))
    s = s.withColumn("level", F.coalesce(F.min("level").over(Window.partitionBy("source"))["level"], F.lit(1e18)))
    sum_p = F.least(F.col("level") * F.col("weights"), F.col("n").cast("double"))
    upto = F.round(F.sum("sum_p").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("sum_p", sum_p).withColumn("upto", upto)
    s = s.withColumn("take", F.least(F.greatest(F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0.0)), F.lit(0.0)), F.col("n")).cast("long"))
    p = F.least(F.greatest(F.col("sum_p") / F.col("n"), F.lit(1e-9)), F.lit(1 - 1e-9))
    return s.select("source", "stratum", "level", (p / (1 - p)).alias("odds"), "take", "n")


def drawn(units: DataFrame, lines: DataFrame) -> DataFrame:
    """lines with `cut`: the largest rank in each stratum's sample (-1 if it is empty, 2 if it is all)."""
    some = lines.where((F.col("take") > 0) & (F.col("take") < F.col("n"))).select(F.col("source").alias("s"), F.col("stratum").alias("k"), "level", "odds", "take")
    mine = F.col("source").eqNullSafe(F.col("s")) & (F.col("stratum") == F.col("k"))
    ranked = known(units, some, mine).select("s", "k", "take", rank(F.col("u"), F.col("weight"), F.col("level"), F.col("odds")).alias("rank"))
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") * BINS).cast("int"))
    bins = ranked.groupBy("s", "k", "take", "bin").agg(F.count("*").alias("n"))
    bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("s", "k").orderBy("bin")))
    last = bins.where(F.col("upto") >= F.col("take")).groupBy(F.col("s").alias("s2"), F.col("k").alias("k2")).agg(F.min(F.struct("bin", (F.col("take") - F.col("upto") + F.col("n")).alias("more"))).alias("x"))
    last = c.stored(last.select("s2", "k2", F.col("x.bin").alias("b"), F.col("x.more").alias("more")), "mix-bins")
    near = known(ranked, last, F.col("s").eqNullSafe(F.col("s2")) & (F.col("k") == F.col("k2")) & (F.col("bin") == F.col("b")))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("s", "k", "bin").orderBy("rank"))).where(F.col("place") <= F.col("more"))
    cut = near.groupBy("s", "k").agg(F.max("rank").alias("found"))
    out = lines.join(cut, mine, "left").withColumn("cut", F.when(F.col("take") >= F.col("n"), 2.0).otherwise(F.coalesce("found", F.lit(-1.0))))
    return out.select("source", "stratum", "level", "odds", "cut")


def corrections(chosen: DataFrame, gaps: DataFrame) -> DataFrame:
    """t (a source) and `changed`: the units (u, size) that change sides, so that the drawn words come nearer their target.

    Candidates are, of each stratum's drawn and other units, the one of least u, the largest that the gap holds and the smallest that
    covers it.  Either the gap is filled from the largest candidate down, or one that covers it is taken and what is then
    too much made good from the other side in the same way: whichever leaves less.
    """
    gap, unit = F.abs("gap"), F.struct("words", "u", "size")
    near = known(chosen, gaps, F.col("source").eqNullSafe(F.col("s"))).where(F.col("words") > 0)
    few = F.array_compact(F.array(F.min(F.struct("u", unit.alias("x")))["x"], F.max(F.when(F.col("words") <= gap, unit)), F.min(F.when(F.col("words") >= gap, unit))))
    near = near.groupBy(F.col("source").alias("t"), "gap", "stratum", "hit").agg(few.alias("few"))
    sides = near.groupBy("t", "gap").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("hit") == (F.col("gap") < 0 if own else F.col("gap") >= 0), F.col("few")))))).alias(name) for name, own in (("own", True), ("other", False))))

    def filled(left: Column, units: Column) -> Column:
        start = F.struct(left.cast("double").alias("left"), F.array().cast("array<struct<words:bigint,u:double,size:bigint>>").alias("took"))
        fits = lambda a, x: F.when(x["words"] <= a["left"], F.struct((a["left"] - x["words"]).alias("left"), F.array_append(a["took"], x).alias("took"))).otherwise(a)
        return F.aggregate(F.reverse(units), start, fits)

    over = F.get(F.filter("own", lambda x: x["words"] >= gap), F.lit(0))
    sides = sides.withColumn("plain", filled(gap, F.col("own"))).withColumn("over", over)
    sides = sides.withColumn("back", filled(F.col("over.words") - gap, F.col("other")))
    better = F.col("over").isNotNull() & (F.col("back.left") < F.col("plain.left"))
    took = F.when(better, F.array_append(F.col("back.took"), F.col("over"))).otherwise(F.col("plain.took"))
    return sides.select("t", F.transform(took, lambda x: F.struct(x["u"].alias("u"), x["size"].alias("size"))).alias("changed"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 9, preference: Column | None = None) -> DataFrame:
    """docs with `size`, `source_size`, `target`, `copies` and `taken` (size times copies), every row, taken or not.

    preference: a weight above 0 for each row, else the square root of the size; null and what is not above 0 is not drawn.
    A null or empty text has size 0.  A null source is one source, the last.  Rows that are equal in doc_id, text, and what the
    preference makes of them are one unit and are taken together.  The same rows give the same sample in any order.  Clashing names get an underscore.
    """
    size, source_size, target, copies, taken, u, weight, key, line = c.fresh(docs, "size", "source_size", "target", "copies", "taken", "_u", "_weight", "_stratum", "_line")
    rows = docs.withColumn(size, word_count(text)).withColumn(u, uniform(seed, [doc_id, text]))
    wish = F.sqrt(size) if preference is None else preference.cast("double")
    rows = rows.withColumn(weight, F.when(F.col(size) > 0, F.greatest(F.coalesce(wish, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)).withColumn(key, stratum(F.col(weight)))
    units = rows.groupBy(F.col(source).alias("source"), F.col(size).alias("size"), F.col(u).alias("u"), F.col(weight).alias("weight"), F.col(key).alias("stratum")).agg((F.count("*") * F.col(size)).alias("words"))
    units = c.stored(units, "mix")
    strata = c.stored(units.groupBy("source", "stratum").agg(F.count("*").alias("n"), F.sum("weight").alias("weights"), F.sum("words").alias("words"), F.sum(F.col("weight") * F.col("words")).alias("both"), F.max("weight").alias("heaviest")), "mix-strata")
    plan = targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")))
    full = F.col("source_size")
    plan = plan.withColumn("whole", F.when(full > 0, F.floor(F.col("target") / full)).otherwise(0).cast("int"))
    plan = c.stored(plan.withColumn("left", F.col("target") - F.col("whole") * full), "mix-plan")
    lines = c.stored(levels(strata, plan), "mix-levels")
    lines = c.stored(drawn(units, lines), "mix-lines")
    mine = lambda s, k: F.col(s).eqNullSafe(F.col("s")) & (F.col(k) == F.col("k"))
    named = lines.withColumnsRenamed({"source": "s", "stratum": "k"})
    hit = rank(F.col("u"), F.col("weight"), F.col("level"), F.col("odds")) <= F.col("cut")
    chosen = known(units, named, mine("source", "stratum")).select("source", "stratum", "words", "u", "size", hit.alias("hit"))
    have = chosen.groupBy("source").agg(F.sum(F.when(F.col("hit"), F.col("words")).otherwise(0)).alias("have"))
    gaps = plan.join(have.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), (F.col("left") - F.coalesce("have", F.lit(0))).alias("gap"))
    gaps = c.stored(gaps, "mix-gaps")
    plan = plan.join(corrections(chosen, gaps), F.col("source").eqNullSafe(F.col("t")), "left").select(F.col("source").alias("p"), "source_size", "target", "whole", "changed")
    told = c.stored(strata.select("source", "stratum").join(plan, F.col("source").eqNullSafe(F.col("p"))).join(named, mine("source", "stratum"), "left").drop("s", "k", "p"), "mix-told")
    told = told.select(F.struct(*told.columns).alias(line))
    rows = known(rows, told, F.col(source).eqNullSafe(F.col(line)["source"]) & (F.col(key) == F.col(line)["stratum"]), "left")
    x = F.col(line)
    more = F.coalesce(rank(F.col(u), F.col(weight), x["level"], x["odds"]) <= x["cut"], F.lit(False))
    more = more != F.coalesce(F.array_contains(x["changed"], F.struct(F.col(u).alias("u"), F.col(size).alias("size"))), F.lit(False))  # a few units change sides
    rows = rows.withColumn(copies, F.least(x["whole"] + more.cast("int"), F.lit(MOST_COPIES))).withColumn(source_size, x["source_size"]).withColumn(target, x["target"])
    return rows.withColumn(taken, F.col(size) * F.col(copies)).select(*docs.columns, size, source_size, target, copies, taken)


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")
