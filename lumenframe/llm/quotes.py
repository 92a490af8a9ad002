"""Quotation linking: conversations in the order of replies, without their quotes.

Lines that start with `>` are quoted; the number of marks is the level.  A passage is a run of lines of one level
(1 or more).  Passages are normalised (case, spaces, punctuation at the ends), hashed, and joined to the earlier messages of
the conversation that have the passage, or one of its lines or sentences, among their own unquoted text: the latest of those with
the whole passage, else of those with a part.  The reply-to is the original of the first passage of the lowest level
that has one, else the message before.  Replies are followed to the message that starts the thread, and each thread becomes a
conversation in which every message comes after the one that it replies to.
"""

from __future__ import annotations

import re
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

_MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
# The line that mail programs put above a quote.
_ATTRIBUTION = re.compile(r"^\s*(?:On|Am|Le|El)\b.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\b.{0,80}:\s*$")
_EDGES = " \t.,;:!?\"'()[]*_-"
TURNS = 1024  # turns of a conversation that one window or one row of the result holds at most
MOST_NAMED = 100_000  # conversations with quotes that are sent to all tasks; more are joined
PASSAGE = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("hash", T.LongType()), T.StructField("parts", T.ArrayType(T.LongType()))])
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def normal(s: str) -> str:
    return " ".join(s.casefold().split()).strip(_EDGES)


def digest(s: str) -> int | None:
    n = normal(s)
    return xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) - (1 << 63) if n else None


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes (and the lines that announce them), and the passages (level, text)."""
    own, passages, last = [], [], 0
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        level, body = (m.group(1).count(">"), line[m.end() :]) if m else (0, line)
        if not level:
            own.append(line)
        elif level == last:
            passages[-1][1].append(body)
        else:
            if not last and own and _ATTRIBUTION.match(own[-1]):
                own.pop()
            passages.append((level, [body]))
        last = level
    quoted = [(n, "\n".join(x).strip()) for n, x in passages]
    own_text = "\n".join(own)
    return own_text.strip("\n") if passages else (text or ""), [x for x in quoted if x[1]]


def parts(s: str) -> set[str]:
    """The lines and the sentences of a text; sentences whatever lines they are wrapped to."""
    return {*s.split("\n"), *_SENTENCE.split(" ".join(s.split()))}


def own_hashes(own: str) -> list[int]:
    """Hashes of the whole text, its paragraphs, lines and sentences."""
    return sorted({d for x in ({own, *re.split(r"\n\s*\n", own)} | parts(own)) if (d := digest(x)) is not None})


@c.released
def _parse(text: str, names: tuple, schema: pa.Schema, batches):
    for whole in batches:
        for b in c.pieces(whole, text):
            own, passages = [], []
            for s in b.column(text):
                o, p = parse(s.as_py())
                own.append(o)
                passages.append([{"level": n, "text": x, "hash": digest(x), "parts": sorted({d for y in parts(x) if (d := digest(y)) is not None})} for n, x in p])
            new = dict(zip(names, (own, passages), strict=True))
            yield pa.record_batch([pa.array(new[f.name], f.type) if f.name in new else b.column(f.name) for f in schema], schema)


def _hashes(batches):
    for b in batches:
        yield pa.record_batch([b.column("conv"), b.column("turn"), pa.array([own_hashes(x or "") for x in b.column("own").to_pylist()], pa.list_(pa.int64()))], names=["conv", "turn", "hashes"])


def before(turns: DataFrame) -> DataFrame:
    """Of distinct (conv, turn): the turn before, null for a conversation's first; long conversations are split."""
    part = F.floor(F.col("turn") / TURNS)
    rows = turns.withColumn("part", part)
    firsts = rows.groupBy("conv", "part").agg(F.max("turn").alias("last"))
    firsts = firsts.select("conv", "part", F.lag("last").over(Window.partitionBy("conv").orderBy("part")).alias("earlier"))
    inner = F.lag("turn").over(Window.partitionBy("conv", "part").orderBy("turn"))
    return rows.withColumn("p", inner).join(firsts, ["conv", "part"]).select("conv", "turn", F.coalesce("p", "earlier").alias("previous"))


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """messages with `own_text` (without quotes), `reply_to` (a turn), `quoted` (level and turn of each passage, turn
    null if its original is not there), `n_quotes` and `chat` (the message as a training template has it; a `<|` of its own has a backslash).

    Null texts are empty.  A message whose conversation or turn is null links with nothing and has no reply_to.  Of messages
    with one turn none replies to another.  A passage that only later messages have stays unlinked.  Repeated rows all
    stay; clashing names of new columns get an underscore.  Texts are parsed once, and stored with what was found.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    c.prepare(messages.sparkSession)
    own, passages, reply, quoted, n, chat, uid, prev, one, other = c.fresh(messages, "own_text", "_passages", "reply_to", "quoted", "n_quotes", "chat", "_uid", "_previous", "_conv", "_turn")
    schema = T.StructType([*messages.schema.fields, T.StructField(own, T.StringType()), T.StructField(passages, T.ArrayType(PASSAGE))])
    rows = messages.mapInArrow(partial(_parse, text, (own, passages), to_arrow_schema(schema)), schema)
    content = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = c.stored(rows.withColumn(uid, F.concat_ws("/", F.coalesce(F.col(conv).cast("string"), F.lit("-")), F.coalesce(F.col(turn).cast("string"), F.lit("-")), content)), "messages")
    key = [F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(uid).alias("uid")]
    placed = F.col(conv).isNotNull() & F.col(turn).isNotNull()
    asked = rows.where((F.size(passages) > 0) & placed).select(*key, F.posexplode(passages).alias("i", "p")).distinct()
    units = F.concat(F.array(F.struct(F.col("p.hash").alias("hash"), F.lit(1).alias("whole"))), F.transform("p.parts", lambda x: F.struct(x.alias("hash"), F.lit(0).alias("whole"))))
    asked = asked.select("conv", "turn", "uid", "i", F.col("p.level").alias("level"), F.explode(units).alias("x")).select("conv", "turn", "uid", "i", "level", "x.hash", "x.whole")
    asked = c.stored(asked, "quotes")
    named = asked.select("conv").distinct()
    named = F.broadcast(named) if named.count() <= MOST_NAMED else named
    has = rows.where(placed).select(*key[:2], F.col(own).alias("own")).join(named, "conv", "left_semi")
    has = has.mapInArrow(_hashes, T.StructType([*has.select("conv", "turn").schema.fields, T.StructField("hashes", T.ArrayType(T.LongType()))]))
    has = has.select("conv", "turn", F.explode("hashes").alias("hash")).distinct().join(asked.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    both = asked.unionByName(has.withColumn("origin", F.col("turn")), allowMissingColumns=True)
    near = F.max("origin").over(Window.partitionBy("conv", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    found = both.withColumn("at", near).where("uid is not null").groupBy("uid", "i", "level").agg(F.max(F.when(F.col("at").isNotNull(), F.struct("whole", "at"))).getField("at").alias("at"))
    told = found.groupBy(F.col("uid").alias(uid)).agg(F.array_sort(F.collect_list(F.struct("i", "level", F.col("at").alias("turn")))).alias(quoted))  # of one message
    earlier = before(rows.where(placed).select(*key[:2]).distinct()).select(F.col("conv").alias(one), F.col("turn").alias(other), F.col("previous").alias(prev))
    out = rows.join(told, uid, "left").join(earlier, (F.col(conv) == F.col(one)) & (F.col(turn) == F.col(other)), "left")
    links = F.filter(F.col(quoted), lambda x: x["turn"].isNotNull())
    first = F.array_min(F.transform(links, lambda x: F.struct(x["level"].alias("level"), x["i"].alias("i"), x["turn"].alias("turn"))))
    out = out.withColumn(reply, F.coalesce(first["turn"], F.col(prev))).withColumn(quoted, F.coalesce(F.transform(quoted, lambda x: F.struct(x["level"].alias("level"), x["turn"].alias("turn"))), F.array().cast("array<struct<level:int,turn:bigint>>")))
    body = F.replace(F.col(own), F.lit("<|"), F.lit("<\\|"))
    out = out.withColumn(n, F.size(passages).cast("long")).withColumn(chat, F.concat(F.lit("<|"), F.coalesce(F.col(role), F.lit("user")), F.lit("|>\n"), body, F.lit("<|end|>\n")))
    return out.select(*messages.columns, own, reply, quoted, n, chat)


def threads(replies: DataFrame) -> DataFrame:
    """Of (conv, turn, reply_to): `thread`, the turn that starts it, and `depth`, the replies between.

    Messages that reply to the one before them make a run, found by one window over TURNS turns at the most.  The runs' first
    messages alone are then followed to the start, by jumps that double; those that have arrived are left out of the next round.
    """
    w = Window.partitionBy("conv", F.floor(F.col("turn") / TURNS)).orderBy("turn")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = replies.groupBy("conv", "turn").agg(F.min("reply_to").alias("up"))
    rows = rows.withColumn("k", F.row_number().over(w)).withColumn("p", F.lag("turn").over(w))
    first = F.when(F.col("up").isNull() | F.col("p").isNull() | (F.col("up") != F.col("p")), F.struct("turn", "k"))
    rows = rows.withColumn("s", F.last(first, ignorenulls=True).over(upto)).select("conv", "turn", "up", F.col("s.turn").alias("start"), (F.col("k") - F.col("s.k")).cast("long").alias("place"))
    rows = c.stored(rows, "runs")
    heads = rows.where(F.col("turn") == F.col("start")).select("conv", "start", "up")
    at = rows.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("start").alias("to"), (F.col("place") + 1).alias("hops"))
    now = heads.join(at, (F.col("conv") == F.col("c")) & (F.col("up") == F.col("t")), "left").select("conv", "start", "to", F.coalesce("hops", F.lit(0).cast("long")).alias("hops"), F.col("to").isNull().alias("there"))
    now = c.stored(now, "threads")
    while not now.where("NOT there").isEmpty():
        up = now.select(F.col("conv").alias("c"), F.col("start").alias("t"), F.col("to").alias("next"), F.col("hops").alias("more"))
        going = now.where("NOT there").join(up, (F.col("conv") == F.col("c")) & (F.col("to") == F.col("t")), "left")
        going = going.select("conv", "start", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.when(F.col("next").isNotNull(), F.col("more")).otherwise(0)).alias("hops"), F.col("next").isNull().alias("there"))
        before_, now = now, c.stored(going.unionByName(now.where("there")), "threads")
        c.discard(before_)
    heads = now.select(F.col("conv").alias("c"), F.col("start").alias("t"), F.coalesce("to", "start").alias("thread"), "hops")
    out = rows.join(heads, (F.col("conv") == F.col("c")) & (F.col("start") == F.col("t")))
    return out.select("conv", "turn", "thread", (F.col("place") + F.col("hops")).alias("depth"))


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """A row for each thread of each conversation: conv, `thread` (the turn that starts it), `part`, `n_messages`, `n_quotes`,
    `n_linked` (quotes with an original), `turns`, `reply_to`, `depth` and `chat`: the messages without quotes, in order of turn,
    so that each comes after the one that it replies to.

    A thread is cut into parts of TURNS turns.  A message without conversation or turn is a thread of its own, with its
    equals; `thread`, and what cannot be told, is then null.  Repeated rows are messages of their own.
    """
    rows = linked(messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(text).alias("text"), F.col(role).alias("role")), "conv", "turn")
    rows = c.stored(rows.select("conv", "turn", "reply_to", "n_quotes", F.size(F.filter("quoted", lambda x: x["turn"].isNotNull())).cast("long").alias("n_linked"), "chat"), "replies")
    placed = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    of = threads(rows.where(placed).select("conv", "turn", "reply_to"))
    rows = rows.join(of.withColumnsRenamed({"conv": "c", "turn": "t"}), (F.col("conv") == F.col("c")) & (F.col("turn") == F.col("t")), "left").drop("c", "t")
    rows = rows.withColumn("part", F.floor(F.col("turn") / TURNS)).withColumn("alone", F.when(~placed, F.xxhash64("conv", "turn", "chat")))
    one = F.array_sort(F.collect_list(F.struct("turn", "chat", "reply_to", "depth")))
    out = rows.groupBy("conv", "thread", "part", "alone").agg(F.count("*").alias("n_messages"), F.sum("n_quotes").alias("n_quotes"), F.sum("n_linked").alias("n_linked"), one.alias("all"))
    return out.select(F.col("conv").alias(conv), "thread", "part", "n_messages", "n_quotes", "n_linked", F.col("all.turn").alias("turns"), F.col("all.reply_to").alias("reply_to"), F.col("all.depth").alias("depth"), F.array_join("all.chat", "").alias("chat"))


def op10_quote_links(spark, sf_dir: str) -> DataFrame:
    """The threads of all conversations, as `conversations` gives them."""
    return conversations(c.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
