"""Web archives: writing pages as records, and a reader that salvages what is whole from damaged files.

An archive is a file of gzip members, one WARC record each. Spark's text writer puts it down, so any file system, commit
and retry of a task is Spark's; the byte that ends a text row is the last byte of the archive (see :func:`archives`).
A payload that a page with a larger id has too is written once: the other records revisit it by digest.

The reader checks member checksums, version line, framing and digests. Where a check fails, it looks for the next member
or version line at which a whole record begins, goes on there, and logs the bytes in between as a quarantined gap. A
record that is framed whole but whose digest fails is a gap of its own, so nothing inside its payload is taken for a
record. Plain (uncompressed) records are read likewise, also mixed with members.

Defined results: a null page is an empty payload; a null ``page_id`` is smaller than any other and is written without one;
repeated rows are equal records with equal names, and all rows of the largest id are responses; a null address is empty;
an archive ends after the record that fills it, so a long page makes a long archive, never a cut one. An empty table
gives no record, an empty file no row. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.session import small_side

#: Compressed bytes after which an archive is full, decompressed bytes at a time, and payload bytes that leave a task at once.
ARCHIVE, STEP, BATCH = 16 << 20, 1 << 16, 8 << 20
MEMBER, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/\d\.\d\r\n")
_STARTS = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def labelled(hex_digest: str) -> str:
    """A SHA-1 as records state it."""
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def unlabelled(stated: str) -> str | None:
    """The lower-case hex digits of a stated SHA-1, in base 32 or 16; null for other digests."""
    name, _, value = stated.partition(":")
    if name.lower() != "sha1":
        return None
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else bytes.fromhex(value).hex()
    except ValueError:
        return None


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def record(fields: dict[str, str], block: bytes) -> bytes:
    stated = {**fields, "WARC-Block-Digest": labelled(hashlib.sha1(block).hexdigest()), "Content-Length": str(len(block))}
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in stated.items()), b"\r\n", block, b"\r\n\r\n"])


def page_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit that names the response's record; both state the whole payload."""
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_name(page_id, digest), "WARC-Date": date,
        "WARC-Target-URI": quote(url, safe="%/:=&?~#+!$,;'@()*[]"), "WARC-Payload-Digest": labelled(digest), "Content-Type": "application/http; msgtype=response",
    }
    if page_id is not None:
        fields["Page-ID"] = str(page_id)
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_name(refers_to, digest), "Refers-To-Page-ID": str(refers_to)}
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record(fields, head + payload if refers_to is None else head)


def archives(records: Iterator[bytes], full: int = ARCHIVE) -> Iterator[bytes]:
    """Members joined to archives, each without its last byte, which is zero.

    A member ends with its length, lowest byte first; for long records, whose length may end otherwise, an empty member follows.
    """
    held, size = [], 0
    for data in records:
        held.append(member(data))
        size += len(held[-1])
        if size >= full:
            yield _ended(held)
            held, size = [], 0
    if held:
        yield _ended(held)


def _ended(members: list[bytes]) -> bytes:
    return b"".join(members if members[-1][-1] == 0 else [*members, member(b"")])[:-1]


def write(
    pages: DataFrame, path: str, least: int = 1000, full: int = ARCHIVE, page_id: str = "page_id", url: str = "url", content: str = "html", date: str = DATE
) -> None:
    """Write a record per page into archives below ``path``.

    Of equal payloads of ``least`` bytes or more, that with the largest id is the response and the others revisit it. Only
    digests are grouped; the groups join the pages by broadcast if measured small.
    """
    body = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.where(F.octet_length("payload") >= least)
    groups = long.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1 AND largest IS NOT NULL")
    marked = rows.join(small_side(groups.drop("n")), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")) & (F.octet_length("payload") >= least), F.col("largest"))

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                columns = (batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to"))
                for page, address, payload, digest, target in zip(*columns, strict=True):
                    page, target = (None if pd.isna(x) else int(x) for x in (page, target))
                    yield page_record(page, address, payload or b"", digest, target, date)

        for archive in archives(records(), full):
            yield pd.DataFrame({"archive": [archive]})

    # ids are text, since numbers beside nulls would become doubles
    sent = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", refers.cast("string").alias("refers_to"))
    done = sent.mapInPandas(written, "archive binary")
    done.select(F.col("archive").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


class Damaged(Exception):
    """A check that failed, and where reading can go on if the framing was whole."""

    def __init__(self, reason: str, resume: int | None = None) -> None:
        super().__init__(reason)
        self.reason, self.resume = reason, resume


class Record(NamedTuple):
    fields: dict[str, str]
    payload: bytes
    payload_bytes: int
    payload_digest: str | None


def parsed(data: bytes, at: int) -> tuple[Record, int]:
    """The plain record that begins at a place, checked, and where it ends."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    head = data.find(b"\r\n\r\n", version.end() - 2)
    if head < 0:
        raise Damaged("header cut off")
    fields = {}
    for line in data[version.end() : head].split(b"\r\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damaged("header field without a colon")
        fields[name.strip().lower()] = value.strip()
    if not re.fullmatch("[0-9]{1,18}", stated := fields.get("content-length", "")):
        raise Damaged("no content length")
    start = head + 4
    stop = start + int(stated)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("record cut off" if stop + 4 > len(data) else "no end of record where stated")
    end, block = stop + 4, data[start:stop]
    whole = end == len(data) or _STARTS.match(data, end)
    if (digest := unlabelled(fields.get("warc-block-digest", ""))) and hashlib.sha1(block).hexdigest() != digest:
        raise Damaged("block digest", end if whole else None)
    payload, http = block, {}
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        top, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise Damaged("http header cut off", end if whole else None)
        lines = (line.decode("latin-1").partition(":") for line in top.split(b"\r\n")[1:])
        http = {k.strip().lower(): v.strip() for k, _, v in lines}
    claimed = unlabelled(fields.get("warc-payload-digest", ""))
    if fields.get("warc-type") == "revisit":
        size = http.get("content-length", "")
        return Record(fields, b"", int(size) if size.isdecimal() else len(payload), claimed), end
    found = hashlib.sha1(payload).hexdigest()
    if claimed and claimed != found:
        raise Damaged("payload digest", end if whole else None)
    return Record(fields, payload, len(payload), found), end


def unpacked(data: bytes, at: int) -> tuple[bytes, int]:
    """What the member at a place holds, checksum verified, and where the member ends."""
    unpacker, out, start = zlib.decompressobj(31), [], at
    while not unpacker.eof:
        if at >= len(data):
            raise Damaged("member cut off")
        try:
            out.append(unpacker.decompress(data[at : at + STEP]))
        except zlib.error as error:
            raise Damaged("member checksum" if "check" in str(error) else "member unreadable") from error
        if start == at and out[0] and not b"WARC/".startswith(out[0][:5]):
            raise Damaged("no version line in member")
        at += STEP
    return b"".join(out), min(at, len(data)) - len(unpacker.unused_data)


def read_at(data: bytes, at: int) -> tuple[list[Record], int]:
    """The records of the member, or the plain record, that begins at a place; an empty member has none."""
    if data.startswith(MEMBER, at):
        inner, end = unpacked(data, at)
        records, place = [], 0
        while place < len(inner):
            try:
                found, place = parsed(inner, place)
            except Damaged as damage:  # the member itself is whole
                raise Damaged(damage.reason, end) from damage
            records.append(found)
        return records, end
    found, end = parsed(data, at)
    return [found], end


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, Record | None]]:
    """(start, end, reason, record) of an archive, in order: whole records, and gaps with the reason of the first failed check."""
    at = 0
    while at < len(data):
        try:
            records, end = read_at(data, at)
            for found in records:
                yield at, end, None, found
        except Damaged as damage:
            end = damage.resume or next_whole(data, at + 1)
            yield at, end, damage.reason, None
        at = end


def next_whole(data: bytes, at: int) -> int:
    """The next place at which a whole member or record begins, or one that is framed whole; else the end."""
    while start := _STARTS.search(data, at):
        try:
            records, _ = read_at(data, start.start())
            if records:
                return start.start()
        except Damaged as damage:
            if damage.resume:
                return start.start()
        at = start.start() + 1
    return len(data)


SCHEMA = (
    "archive string, offset long, length long, reason string, type string, record_id string, page_id long, refers_to long, "
    "fields map<string,string>, payload_bytes long, payload_digest string, payload binary"
)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records and gaps of the archives below a path.

    A gap is a row with a ``reason``: the ``length`` bytes of ``archive`` from ``offset`` that no whole record covers. A
    record has none. ``payloads=False`` leaves payloads behind once they are checked.
    """

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [field.split(" ")[0] for field in SCHEMA.split(", ")]
        rows, size = [], 0

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            return out.astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes")})

        for batch in batches:
            for archive, data in zip(batch["path"], batch["content"], strict=True):
                for start, end, reason, found in salvage(bytes(data)):
                    if found is None:
                        rows.append((archive, start, end - start, reason, *[None] * 8))
                    else:
                        f, ids = found.fields, (found.fields.get(k, "") for k in ("page-id", "refers-to-page-id"))
                        ids = [int(x) if re.fullmatch("-?[0-9]{1,18}", x) else None for x in ids]
                        rows.append((
                            archive, start, end - start, None, f.get("warc-type"), f.get("warc-record-id"), *ids, f,
                            found.payload_bytes, found.payload_digest, found.payload if payloads else None))
                        size += len(found.payload)
                    if size >= BATCH or len(rows) >= 4096:
                        yield frame()
                        rows, size = [], 0
        if rows:
            yield frame()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(scanned, SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload of the response that a revisit names; null where that response was not recovered.

    A response is named by its record; among repeated ones any is as good, so one of each name is taken.
    """
    names = records.columns
    named = records.where("type = 'response'").select(F.col("record_id").alias("named"), F.col("payload").alias("said")).dropDuplicates(["named"])
    target = F.when(F.col("type") == "revisit", F.col("fields")["warc-refers-to"])
    joined = records.join(named, target == F.col("named"), "left")
    payload = F.when(F.col("type") == "revisit", F.col("said")).otherwise(F.col("payload"))
    return joined.select(*[payload.alias(c) if c == "payload" else F.col(c) for c in names])
