"""WARC archives, one Zstandard frame a record, with a dictionary in the leading skippable frame.

Writing: a record for each page goes to the shared folder, in archives of at most ARCHIVE_BYTES or one record more.
The dictionary is trained on a bounded sample of payloads (SAMPLE at most) and stored, itself a Zstandard frame, in a
skippable frame (magic 0x184D2A5D) at the start of each archive.  A payload that another record of at least
MIN_REVISIT bytes has already goes out as a revisit without it.  Archives are named by content-free random names,
written whole, and listed only by the task that ended: a task that is repeated leaves no half archive in the list.

Reading: Spark reads whole archives, whatever the file system; each is parsed record by record, one frame at a time, and every
header, length and digest is validated.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from functools import partial

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

MAGIC, ARCHIVE_BYTES, MIN_REVISIT, SAMPLE, DICTIONARY_BYTES = 0x184D2A5D, 8 << 20, 100, 256, 32 << 10
_FRAME = 0xFD2FB528
_DATE = "2000-01-01T00:00:00Z"
RECORDS = "archive string, type string, id string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'lumenframe:' + key)}>"


_UNSAFE = re.compile(r"[\x00-\x20\x7f-\xa0\u2028\u2029]")


def header_uri(uri: str) -> str:
    """The target as a header can hold it: control characters and spaces percent-encoded."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri)


def record(kind: str, key: str, uri: str, payload: bytes, digest: str, refers_key: str | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {header_uri(uri)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_key is not None:
        head += [f"WARC-Refers-To: {record_id(refers_key)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """Trained, or the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def _leading(raw: bytes) -> bytes:
    frame = zstandard.ZstdCompressor().compress(raw)
    return struct.pack("<II", MAGIC, len(frame)) + frame


@c.released
def _write(folder: str, raw: bytes, batches):
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    level = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
    held, size, names = [_leading(raw)], 0, []

    def close():
        name = f"{uuid.uuid4().hex}.warc.zst"
        with fs.open_output_stream(f"{root}/{name}.part") as f:
            for x in held:
                f.write(x)
        fs.move(f"{root}/{name}.part", f"{root}/{name}")
        names.append(f"{folder}/{name}")

    for b in batches:
        for key, uri, payload, digest, refers in zip(*(b.column(x).to_pylist() for x in ("key", "uri", "payload", "digest", "refers")), strict=True):
            held.append(level.compress(record("revisit" if refers is not None else "response", key, uri, payload, digest, refers)))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                close()
                held, size = held[:1], 0
    if size:
        close()
    yield pa.record_batch([pa.array(names, pa.string())], names=["archive"])


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record; ValueError if it is not well formed."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:60]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name}")
    if not headers["content-length"].isdigit() or int(headers["content-length"]) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise ValueError("content-length does not fit the record")
    block = rest[:-4]
    if (want := headers.get("warc-block-digest", "").removeprefix("sha256:")) and hashlib.sha256(block).hexdigest() != want:
        raise ValueError("block digest does not fit")
    return headers, block


def frames(data: memoryview):
    """Of an archive: its records, uncompressed, or ValueError in a record's place; damage to a frame's end stops the archive."""
    if len(data) < 8 or struct.unpack("<I", data[:4])[0] != MAGIC:
        raise ValueError("no leading dictionary frame")
    size = struct.unpack("<I", data[4:8])[0]
    if 8 + size > len(data):
        raise ValueError("the dictionary frame is cut off")
    raw = bytes(data[8 : 8 + size])
    if raw[:4] == struct.pack("<I", _FRAME):
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    known, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)), 8 + size
    while at < len(data):
        if len(data) - at >= 8 and 0x184D2A50 <= struct.unpack("<I", data[at : at + 4])[0] <= 0x184D2A5F:
            at += 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
            continue
        one, parts, to = known.decompressobj(), [], at
        try:
            while not one.eof and to < len(data):
                step = data[to : to + 65536]
                parts.append(one.decompress(step))
                to += len(step)
        except zstandard.ZstdError as e:
            yield ValueError(f"bad frame: {e}")
            return
        if not one.eof:
            yield ValueError("the last frame is cut off")
            return
        at = to - len(one.unused_data)
        yield b"".join(parts)


@c.released
def _read(payloads: bool, batches):
    fields = [x.split() for x in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in fields])

    def batch(rows):
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema)

    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            rows, size = [], 0
            try:
                for data in frames(memoryview(content.as_buffer())):
                    rows.append(_row(path, data, payloads))
                    size += len(rows[-1][7] or b"")
                    if len(rows) >= 2000 or size > ARCHIVE_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
            except ValueError as e:
                rows.append((path, *[None] * 7, str(e)))
            if rows:
                yield batch(rows)


def _row(path: str, data, payloads: bool) -> tuple:
    try:
        if isinstance(data, ValueError):
            raise data
        h, block = parse(data)
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found or not http.startswith(b"HTTP/"):
            raise ValueError("no HTTP header")
        lengths = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(lengths[0]) if lengths and lengths[0].isdigit() else len(payload)
        digest = h.get("warc-payload-digest", "").removeprefix("sha256:")
        if h["warc-type"] == "response" and (size != len(payload) or digest != hashlib.sha256(payload).hexdigest()):
            raise ValueError("payload length or digest does not fit")
        if h["warc-type"] == "revisit" and (payload or "warc-refers-to" not in h):
            raise ValueError("a revisit needs a reference and no payload")
        return path, h["warc-type"], h["warc-record-id"], h.get("warc-target-uri"), h.get("warc-refers-to"), digest, size, payload if payloads else None, None
    except ValueError as e:
        return (path, *[None] * 7, str(e))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for each row and returns a stored table of archive names.

    A null html is an empty payload, a null url an empty target; of a url's control characters and spaces the header has the
    percent-encoding.  Ids may be of any type that sorts.  Of rows with equal payloads of MIN_REVISIT bytes or more, that
    with the smallest page_id (null last) is the response, other ids revisit it; repeated rows of that id are responses too.
    A payload that many pages share makes a skewed join, which Spark splits as it runs.
    """
    spark = pages.sparkSession
    c.prepare(spark)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page"), F.coalesce(F.col(url), F.lit("")).alias("uri"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    heads = rows.where(F.length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(heads, "digest", "left")
    refers = F.when(F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("page")), F.col("head").cast("string"))
    rows = rows.select(F.coalesce(F.col("page").cast("string"), F.lit("null")).alias("key"), "uri", "payload", "digest", refers.alias("refers"))
    samples = [bytes(r[0]) for r in pages.select(F.substring(F.col(html).cast("binary"), 1, 4096)).where(F.length(html) > 0).limit(SAMPLE).collect()]
    raw = dictionary([record("response", "", "", s, "", None) for s in samples])
    return c.stored(rows.mapInArrow(partial(_write, folder, raw), "archive string"), "warc-list")


def read(spark, archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the listed archives (columns RECORDS); what is not valid has an `error` and nothing else."""
    c.prepare(spark)
    names = [r[0] for r in archives.select("archive").distinct().collect()]  # names only: one for each ARCHIVE_BYTES
    if not names:
        return spark.createDataFrame([], RECORDS)
    files = spark.read.format("binaryFile").load(names).select("path", "content")
    return files.mapInArrow(partial(_read, payloads), RECORDS)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as read back; a record that is not valid ends the query with its error."""
    pages = c.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = c.scratch(spark, "warc")
    found = read(spark, write(pages, folder if "://" in folder else f"file://{folder}"), payloads=False)
    found = found.withColumn("id", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "archive", "error"))).otherwise(F.col("id")))
    known = pages.select("page_id").distinct().select("page_id", F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("key"))
    named = known.select("page_id", _record_id(F.col("key")).alias("id"))
    out = found.join(named, "id").join(named.select(F.col("page_id").alias("referred"), F.col("id").alias("refers_to")), "refers_to", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("referred").alias("refers_to"))


def _record_id(key):
    """record_id() as an expression: a version 5 UUID."""
    space = uuid.NAMESPACE_URL.bytes
    h = F.sha1(F.concat(F.lit(bytearray(space)), F.concat(F.lit("lumenframe:"), key).cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


OP6_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, min(page_id) AS head FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN head IS NOT NULL AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to FROM p LEFT JOIN m USING (d)
"""
