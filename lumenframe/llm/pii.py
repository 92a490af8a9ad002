"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern, with a group for each kind, in one pass over the text.  Each is replaced by a keyed permutation of
what may vary in its normal form: a Feistel network over the characters, whose rounds add HMAC-SHA-256 streams to every other
character within that character's own alphabet.  So equal entities get equal surrogates, in every text and writing (coreference),
different ones of a kind get different ones by construction, whatever their number, and nothing is drawn again.  A surrogate keeps type
and format: separators, case, country codes, card networks, valid check digits, address ranges, a name's script, length,
vowels and the ending that shows its gender.

Each text is stored once with its entities; the collision check runs over all distinct entities, on the values that are written, and
ends the job if two had one surrogate.  Surrogates are drawn from the same space as real values, and so may equal the real value of
someone else; e-mail addresses end in `.example`, which is nobody's.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

# Patterns of entities, in order of precedence.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])"
IPV6 = r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
ACCESS_KEY = r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
TOKEN = r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (
    r"(?<![0-9A-Za-z+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9A-Za-z+])\+(?:[2-9][0-9]{0,2})[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
    r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[-.][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9-])"
)
CARD = r"(?<![0-9A-Za-z-])(?:[0-9]{4}(?<sep>[ -]?)[0-9]{4}\k<sep>[0-9]{4}\k<sep>[0-9]{1,7}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9A-Za-z])"
TITLES = r"Mr\.|Herr|Monsieur|Señor|Sr\.|г-н|Mrs\.|Ms\.|Miss|Frau|Madame|Mme\.?|Señora|Sra\.|г-жа|Dr\.|Prof\."
PERSON = rf"(?=\p{{Lu}}\p{{Ll}})(?<=(?<!\p{{L}})(?:{TITLES}) )\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})"
KINDS = {"email": EMAIL, "ipv6": IPV6, "accesskey": ACCESS_KEY, "token": TOKEN, "iban": IBAN, "ipv4": IPV4, "ssn": SSN, "phone": PHONE, "card": CARD, "name": PERSON}
# What a kind starts with is looked at first, so that most places of a text cost one look.
STARTS = {"": ["email"], "[0-9A-Fa-f]": ["ipv6", "token"], "[A-Z]": ["accesskey", "iban"], "[0-9+(]": ["ipv4", "ssn", "phone", "card"], r"\p{Lu}": ["name"]}
PATTERN = "|".join(f"(?={start})(?:{'|'.join(f'(?<{k}>{KINDS[k]})' for k in kinds)})" for start, kinds in STARTS.items())


def hinted(text: Column) -> Column:
    """Whether a text may have entities at all."""
    out = text.rlike("[0-9@]")
    for title in TITLES.replace("\\", "").replace("?", "").split("|"):
        out = out | text.contains(f"{title} ")
    return out | text.contains("Mme ")


# Alphabets within which a character is replaced; what is in none stays.
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
VOWELS = ["aeiou", "áéíóúàèìòùâêîôûäëïöüãõåæøœ", "аеиоуыэюя", "αεηιουω", "άέήίόύώ"]
CONSONANTS = ["bcdfghjklmnpqrstvwxyz", "çñßšžčřłđ", "бвгджзйклмнпрстфхцчшщ", "βγδζθκλμνξπρστφχψ"]
#: Endings that show a name's gender stay.
ENDINGS = "aáeéаяαηάής"

# A string stands for an entity's varying part: other digits, and octets, have symbols and alphabets of their own.
_FIXED_DIGITS, _AREA, _OTHER_AREA = "KLMNOPQRST", "cdefghij", "ab"  # a digit that stays; a first digit of 2-9; of 0 or 1
_OCTETS = "".join(chr(0x4E00 + i) for i in range(256))
_FIXED_OCTETS = "".join(chr(0x5E00 + i) for i in range(256))
_SPECIAL = {0, 10, 127, 172, 192, *range(224, 256)}  # first octets that stay
_PLAIN = [i for i in range(256) if i not in _SPECIAL]
_FIRST = "".join(chr(0x6E00 + i) for i in range(len(_PLAIN)))
ALPHABETS = {"email": [DIGITS, LOWER], "ipv6": [HEX], "accesskey": [DIGITS, UPPER], "token": [HEX], "iban": [DIGITS, UPPER], "ipv4": [_OCTETS, _FIRST], "ssn": [DIGITS], "phone": [DIGITS, _AREA, _OTHER_AREA], "card": [DIGITS], "name": [*VOWELS, *CONSONANTS]}
_SEP, _GROUP = "\u0001", "\u0002"


def let(value: Column, f) -> Column:
    """f(value), value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def hmac(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 in lower-case hexadecimal digits."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(b ^ 0x36 for b in block)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytearray(b ^ 0x5C for b in block)), inner), 256)


def permuted(key: bytes, kind: Column, s: Column, alphabets: Column, rounds: int = 4) -> Column:
    """A permutation, under the key, of the strings of s's kind and pattern of alphabets.

    Round r adds to each character whose place is r modulo 2 a stream that depends on the other characters only.
    """

    def shifted(ch: Column, by: Column) -> Column:
        return let(F.get(F.filter(alphabets, lambda a: F.instr(a, ch) > 0), F.lit(0)), lambda a: F.when(a.isNull() | (ch == ""), ch).otherwise(a.substr(((F.instr(a, ch) - 1 + by) % F.length(a) + 1).cast("int"), F.lit(1))))

    def one(s: Column, r: Column) -> Column:
        chars = F.split(s, "")
        others = F.array_join(F.transform(chars, lambda ch, i: F.when(i % 2 == r % 2, F.lit("\u0000")).otherwise(ch)), "")
        stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(s) / 32)), lambda b: hmac(key, F.concat_ws("\x1f", kind, r.cast("string"), b.cast("string"), others))), "")
        byte = lambda st, i: F.conv(st.substr((2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        return let(stream, lambda st: F.array_join(F.transform(chars, lambda ch, i: F.when(i % 2 == r % 2, shifted(ch, byte(st, i))).otherwise(ch)), ""))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), s, one)


def normal(kind: Column, raw: Column) -> Column:
    """The form in which writings of one entity are equal: a phone's has a + before another country's code than 1."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    phone = F.when(raw.startswith("+1"), digits.substr(2, 40)).when(raw.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits)
    return (
        F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(raw, F.lit(" "), F.lit(""))).when(kind == "email", F.lower(raw))
        .when(kind == "ipv6", F.array_join(F.transform(F.split(F.lower(raw), ":"), lambda g: F.lpad(g, 4, "0")), "")).when(kind == "name", F.lower(raw)).otherwise(raw)
    )


def _fixed(digits: Column) -> Column:
    return F.translate(digits, DIGITS, _FIXED_DIGITS)


def _tail(s: Column, at: int) -> Column:
    return s.substr(F.lit(at), F.length(s))


def varying(kind: Column, n: Column) -> Column:
    """Of a normal form the part that is permuted, what stays in it written so that no alphabet has it."""
    first = n.substr(1, 1)
    phone = F.when(first == "+", F.concat(_fixed(n.substr(2, 2)), _tail(n, 4))).otherwise(F.concat(F.translate(first, DIGITS, _OTHER_AREA + _AREA), _tail(n, 2)))
    octets = F.transform(F.split(n, r"\."), lambda x: x.cast("int"))
    symbol = lambda table, v: F.lit(table).substr((v + 1).cast("int"), F.lit(1))
    plain = F.translate(symbol(_OCTETS, octets[0]), "".join(_OCTETS[i] for i in _PLAIN), _FIRST)
    two = octets[0].isin(172, 192, 0) | (octets[0] >= 224)  # the second octet tells ranges apart: it stays too
    head = F.when(octets[0].isin(*sorted(_SPECIAL)), symbol(_FIXED_OCTETS, octets[0])).otherwise(plain)
    ipv4 = F.concat(head, F.when(two, symbol(_FIXED_OCTETS, octets[1])).otherwise(symbol(_OCTETS, octets[1])), symbol(_OCTETS, octets[2]), symbol(_OCTETS, octets[3]))
    last = n.substr(F.length(n), F.lit(1))
    name = F.when((F.length(n) > 3) & F.lit(ENDINGS).contains(last), F.concat(n.substr(F.lit(1), F.length(n) - 1), F.upper(last))).otherwise(n)
    return (
        F.when(kind == "phone", phone).when(kind == "card", F.concat(_fixed(first), n.substr(F.lit(2), F.length(n) - 2))).when(kind == "iban", _tail(n, 5)).when(kind == "ipv4", ipv4)
        .when(kind == "ipv6", F.concat(F.translate(n.substr(1, 4), HEX, "KLMNOPQRSTUVWXYZ"), _tail(n, 5))).when(kind == "accesskey", _tail(n, 5)).when(kind == "name", name).otherwise(n)
    )


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10; 0 for a valid number."""

    def term(i):
        d = digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + term(i)) % 10


def _check(iban: Column) -> Column:
    """The valid check number, 2 to 98, of an IBAN, whatever stands in its place."""
    ring = F.split(F.concat(_tail(iban, 5), iban.substr(1, 2), F.lit("00")), "")
    value = lambda ch: F.when(ch.rlike("[A-Z]"), F.ascii(ch) - 55).otherwise(F.coalesce(F.try_to_number(ch, F.lit("9")).cast("int"), F.lit(0)))
    rest = F.aggregate(ring, F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise((a * F.when(ch.rlike("[A-Z]"), 100).otherwise(10) + value(ch)) % 97))
    return 98 - rest


def _poured(raw: Column, digits: Column) -> Column:
    """raw with its digits replaced in turn."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))
    step = lambda a, ch: F.when(ch.rlike("^[0-9]$"), F.struct(F.concat(a["o"], digits.substr(a["k"], F.lit(1))).alias("o"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["o"], ch).alias("o"), a["k"].alias("k")))
    return F.aggregate(F.split(raw, ""), start, step, lambda a: a["o"])


def _cased(raw: Column, s: Column) -> Column:
    """s with capitals where raw has them."""
    chars = F.split(raw, "")
    return F.array_join(F.transform(F.split(s, ""), lambda ch, i: F.when(F.coalesce(F.get(chars, i).rlike(r"^\p{Lu}$"), F.lit(False)), F.upper(ch)).otherwise(ch)), "")


def written(kind: Column, raw: Column, n: Column, p: Column) -> Column:
    """The surrogate in the writing of raw, from the permuted varying part of its normal form n."""
    plain = F.translate(p, _OTHER_AREA + _AREA + _FIXED_DIGITS, DIGITS + DIGITS)
    phone = _poured(raw, F.when(raw.startswith("+1"), F.concat(F.lit("1"), plain)).otherwise(plain))
    last = n.substr(F.length(n), F.lit(1)).cast("int")
    card = _poured(raw, F.concat(plain, ((last + _luhn(F.concat(n.substr(F.lit(1), F.length(n) - 1), F.lit("0"))) - _luhn(F.concat(plain, F.lit("0"))) + 10) % 10).cast("string")))
    given = n.substr(3, 2).cast("int")
    new = F.concat(n.substr(1, 4), p)
    number = F.when(given.between(2, 98), F.pmod(given - _check(n) + _check(new) - 2, F.lit(97)) + 2).otherwise(given)
    iban = F.concat(n.substr(1, 2), F.lpad(number.cast("string"), 2, "0"), p)
    gaps = F.aggregate(F.split(raw, ""), F.struct(F.lit("").alias("o"), F.lit(1).alias("k")), lambda a, ch: F.when(ch.isin(" ", ""), F.struct(F.concat(a["o"], ch).alias("o"), a["k"].alias("k"))).otherwise(F.struct(F.concat(a["o"], iban.substr(a["k"], F.lit(1))).alias("o"), (a["k"] + 1).alias("k"))), lambda a: a["o"])
    octet = lambda ch: F.greatest(F.instr(F.lit(_OCTETS), ch), F.instr(F.lit(_FIXED_OCTETS), ch)) - 1
    first = F.when(F.instr(F.lit(_FIRST), p.substr(1, 1)) > 0, F.element_at(F.array(*map(F.lit, _PLAIN)), F.greatest(F.instr(F.lit(_FIRST), p.substr(1, 1)), F.lit(1)))).otherwise(octet(p.substr(1, 1)))
    ipv4 = F.concat_ws(".", first.cast("string"), *(octet(p.substr(i, 1)).cast("string") for i in (2, 3, 4)))
    v6 = F.concat(n.substr(1, 4), _tail(p, 5))
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: v6.substr((4 * i + 1).cast("int"), F.lit(4))), ":")
    return (
        F.when(kind == "email", F.concat(_cased(raw, p), F.lit(".example"))).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", _poured(raw, p)).when(kind == "iban", gaps)
        .when(kind == "ipv4", ipv4).when(kind == "ipv6", F.when(raw.rlike("[A-F]"), F.upper(groups)).otherwise(groups)).when(kind == "accesskey", F.concat(n.substr(1, 4), p)).when(kind == "name", _cased(raw, F.lower(p))).otherwise(p)
    )


def surrogate(key: bytes, kind: Column, raw: Column) -> Column:
    """The replacement of one entity."""
    tables = F.element_at(F.create_map(*(x for k, v in ALPHABETS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), kind)
    return let(normal(kind, raw), lambda n: let(tables, lambda a: let(permuted(key, kind, varying(kind, n), a), lambda p: written(kind, raw, n, p))))


def _marked(text: Column, pattern: Column | str, kinds: list[str]) -> Column:
    """The text with each entity between separators, in its kind's place."""
    return F.regexp_replace(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(_SEP + _GROUP.join(f"${{{k}}}" for k in kinds) + _SEP))


def _entities(pieces: Column, kinds: list[str]) -> Column:
    """kind and raw of every second piece."""
    odd = F.filter(pieces, lambda x, i: i % 2 == 1)
    told = lambda g: F.filter(F.transform(g, lambda raw, i: F.struct(F.element_at(F.array(*map(F.lit, kinds)), i + 1).alias("kind"), raw.alias("raw"))), lambda x: x["raw"] != "")
    return F.transform(odd, lambda x: F.get(told(F.split(x, _GROUP)), F.lit(0)))


def found(docs: DataFrame, text: str, parts: str, ents: str) -> DataFrame:
    """docs with the text between entities, and the entities, one less, instead of the text; both null where it has none.

    A name after a title is known again without one further on in the same text, whole or its given or family name alone.
    Names of two words are two entities.
    """
    s, kinds = F.col(text), list(KINDS)
    # Control characters that mark entities here are not expected in texts; those that have them go without.
    clean = F.translate(s, _SEP + _GROUP, "")
    df = docs.withColumn(parts, F.when(hinted(s), F.split(_marked(clean, PATTERN, kinds), _SEP)))
    people = F.array_distinct(F.flatten(F.transform(F.filter(_entities(F.col(parts), kinds), lambda e: e["kind"] == "name"), lambda e: F.split(e["raw"], " "))))
    df = df.withColumn(ents, F.when(F.size(parts) > 1, people))
    again = F.concat(F.lit(PATTERN + r"|(?<known>(?<!\p{L})(?:"), F.array_join(F.col(ents), "|"), F.lit(r")(?!\p{L}))"))
    df = df.withColumn(parts, F.when(F.size(ents) > 0, F.split(_marked(clean, again, [*kinds, "known"]), _SEP)).otherwise(F.col(parts)))
    kinds = [*kinds, "known"]
    df = df.withColumn(ents, F.when(F.size(parts) > 1, F.transform(_entities(F.col(parts), kinds), lambda e: F.struct(F.when(e["kind"] == "known", "name").otherwise(e["kind"]).alias("kind"), e["raw"].alias("raw")))))
    df = df.withColumn(parts, F.when(F.size(parts) > 1, F.filter(F.col(parts), lambda x, i: i % 2 == 0)))
    return df.withColumn(text, F.when(F.col(parts).isNull(), s))


def _tokens(e: Column) -> Column:
    """A person's given and family name are entities of their own, so that either alone is known again."""
    return F.transform(F.when(e["kind"] == "name", F.split(e["raw"], " ")).otherwise(F.array(e["raw"])), lambda x: F.struct(e["kind"].alias("kind"), x.alias("raw")))


def collisions(rows: DataFrame, ents: str, key: bytes) -> DataFrame:
    """kind and surrogate that two entities or more of the stored rows would share; empty unless the permutation is at fault."""
    each = rows.where(F.size(ents) > 0).select(F.explode(F.flatten(F.transform(ents, _tokens))).alias("e"))
    each = each.groupBy(F.col("e.kind").alias("kind"), normal(F.col("e.kind"), F.col("e.raw")).alias("entity")).agg(F.min("e.raw").alias("raw"))
    # few bytes but much to compute: dealt out, since AQE would put them into one task
    each = each.repartition(c.partitions(rows.sparkSession), "kind", "entity").withColumn("s", normal(F.col("kind"), surrogate(key, F.col("kind"), F.col("raw"))))
    return each.groupBy("kind", "s").agg(F.count("*").alias("n")).where("n > 1")


def replaced(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with the entities of `text` replaced, and `n_entities`, `kinds` (sorted, each once).

    Texts without entities are as they were; null stays null, empty stays empty.  Of a text with entities, U+0001 and U+0002 are taken
    out.  Rows keep their number and columns; repeated rows get equal texts; clashing names of new columns get an
    underscore.  Raises if the collision check finds two entities with one surrogate.
    """
    n, kinds, parts, ents = c.fresh(docs, "n_entities", "kinds", "_parts", "_ents")
    rows = c.stored(found(docs, text, parts, ents), "pii")
    shared = collisions(rows, ents, key).limit(3).collect()
    if shared:
        raise ValueError(f"entities share surrogates: {shared}")
    new = F.transform(F.col(ents), lambda e: F.array_join(F.transform(_tokens(e), lambda x: surrogate(key, x["kind"], x["raw"])), " "))
    spliced = F.concat(F.array_join(F.zip_with(F.slice(F.col(parts), F.lit(1), F.size(ents)), new, lambda a, b: F.concat(a, b)), ""), F.element_at(F.col(parts), -1))
    some = F.coalesce(F.size(ents) > 0, F.lit(False))
    out = rows.withColumn(text, F.when(some, spliced).otherwise(F.col(text)))
    out = out.withColumn(kinds, F.when(some, F.array_sort(F.array_distinct(F.transform(ents, lambda e: e["kind"])))).otherwise(F.array().cast("array<string>")))
    return out.withColumn(n, F.when(some, F.size(ents)).otherwise(0).cast("long")).select(*docs.columns, n, kinds)


def key_of(spark) -> bytes:
    """The session's `spark.lumenframe.pii.key`, or LUMENFRAME_PII_KEY of the environment; production sets one, tests go without."""
    return (spark.conf.get("spark.lumenframe.pii.key", None) or os.environ.get("LUMENFRAME_PII_KEY") or "no key is set: for tests").encode()


def op8_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds of every document."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    return replaced(docs, key_of(spark))
