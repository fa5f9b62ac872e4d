"""WARC archives with revisit records, and a reader that salvages damaged ones.

Archives are gzip members, one a record. The reader checks each member's CRC and each record's lengths and digests. After
a failed check it searches for the next valid member or version line, goes on from there, and logs the bytes between
as a quarantined gap. Inside a member it searches the decompressed content for version lines in the same way, also what
came out of a member before its damage.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read_blobs, row_key, saved, skew_join, work_path, write_blobs

#: Payloads below so many bytes are written anew each time.
MIN_REVISIT = 100
#: An archive is closed when it has so many bytes.
ARCHIVE_BYTES = 4 << 20
#: An empty gzip member.
TRAILER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
_MAGIC, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_NEXT = re.compile(rb"\x1f\x8b\x08|(?:(?<=\n)|\A)WARC/1\.")
_VERSION_LINE = re.compile(rb"(?<=\n)WARC/1\.")
#: What is wrong with a member whose content may be wrong anywhere: only records with a digest of their own are taken from it.
_BAD, _DIGEST = "bad gzip member", re.compile(rb"(?i)\r\nWARC-Block-Digest:\s*sha256:")
_PAGE = "urn:page:"
_STEP = 1 << 16
#: Bytes of a record's head and of a record, at most; longer ones count as damaged. A member whose content is longer than a record may be is read as a
#: stream, record by record.
MAX_HEAD, MAX_CONTENT = 1 << 20, 256 << 20
_LONG = "long"


def record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """A gzip member with a response, or with a revisit if refers_to is given; that has the HTTP head but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = "null" if page_id is None else str(page_id)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_PAGE}{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if uri is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{_PAGE}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Damaged(ValueError):
    pass


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record whose version line starts at data[at], and where it ends. Damaged if a check fails."""
    end = data.find(b"\r\n\r\n", at, at + MAX_HEAD)
    if not data.startswith(_VERSION, at) or end < 0:
        raise Damaged("no record head")
    try:
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in data[at:end].decode().split("\r\n")[1:])}
        size = int(fields["content-length"])
    except (ValueError, KeyError, UnicodeDecodeError) as e:
        raise Damaged("bad record head") from e
    start = end + 4
    block = data[start : start + size]
    if size < 0 or len(block) < size or data[start + size : start + size + 4] != b"\r\n\r\n":
        raise Damaged("record cut short or of another length")
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest differs")
    kind = fields.get("warc-type", "")
    out = {"record_type": kind, "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, "length": size, "payload": block}
    if kind in ("response", "revisit") and b"\r\n\r\n" in block:
        head, _, payload = block.partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        out |= {"length": int(said[1]) if said else len(payload), "payload": payload if kind == "response" else None}
        if kind == "response" and said and out["length"] != len(payload):
            raise Damaged("payload of another length")
        if kind == "response" and fields.get("warc-payload-digest", "").startswith("sha256:") and out["digest"] != hashlib.sha256(payload).hexdigest():
            raise Damaged("payload digest differs")
    return out, start + size + 4


def read_member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The content of the gzip member at data[at], where it ends, and "" or what is wrong with it: then the content is what came
    out before the damage, and the end is not known (at). _LONG, and no content, if that is over MAX_CONTENT: member_chunks() has it."""
    z, parts, start, size = zlib.decompressobj(31), [], at, 0
    try:
        while not z.eof and at < len(data):
            step = data[at : at + _STEP]
            at += _STEP
            before = z.copy()
            parts.append(z.decompress(step))
            size += len(parts[-1])
            if size > MAX_CONTENT:
                return b"", start, _LONG
    except zlib.error:
        parts.append(_until_damage(before, step))
        return b"".join(parts), start, _BAD
    if not z.eof:
        return b"".join(parts), start, "gzip member cut short"
    return b"".join(parts), min(at, len(data)) - len(z.unused_data), ""


def _until_damage(z, step: bytes) -> bytes:
    """What z makes of step, byte by byte, before it fails."""
    parts = []
    try:
        for i in range(len(step)):
            parts.append(z.decompress(step[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(parts)


def member_chunks(data: bytes, at: int, ended: list) -> Iterator[bytes]:
    """The content of the gzip member at data[at] in pieces; ended then gets where it ends, and "" or what is wrong with it."""
    z, start = zlib.decompressobj(31), at
    while not z.eof and (at < len(data) or z.unconsumed_tail):
        step = z.unconsumed_tail or data[at : at + _STEP]
        at += 0 if z.unconsumed_tail else len(step)
        before = z.copy()
        try:
            piece = z.decompress(step, _STEP)
        except zlib.error:
            yield _until_damage(before, step)
            ended += [start, _BAD]
            return
        yield piece
    ended += [at - len(z.unused_data), ""] if z.eof else [start, "gzip member cut short"]


def _record_size(data: bytes, at: int) -> int | None:
    """Bytes of the record that data[at] begins, by its head; None while the head has no end or says nothing."""
    end = data.find(b"\r\n\r\n", at, at + MAX_HEAD)
    said = re.search(rb"(?im)^content-length:\s*(\d{1,18})\s*$", data[at:end]) if end >= 0 else None
    return end + 4 - at + int(said[1]) + 4 if said else None


def _streamed(chunks: Iterator[bytes]) -> Iterator[tuple[int, int, dict | str, bool]]:
    """_inner()'s rows of a content that comes in pieces, and whether a record has a digest of its own. Holds a record, or what may be a head, and a piece."""
    held, base, at, done = b"", 0, 0, False  # held is the content from base on; at is the place in it
    gap, reason = None, ""
    while True:
        begins = held.startswith(_VERSION, at) if len(held) - at >= len(_VERSION) else None
        size = _record_size(held, at) if begins else None
        open_head = size is None and begins is not False and len(held) - at < MAX_HEAD and held.find(b"\r\n\r\n", at) < 0
        if not done and (open_head or (size is not None and size <= MAX_CONTENT and len(held) - at < size)):
            piece = next(chunks, None)
            done = piece is None
            held, base, at = held[at:] + (piece or b""), base + at, 0
            continue
        if at >= len(held):
            break
        try:
            if size is not None and size > MAX_CONTENT:
                raise Damaged(f"record over the limit of {MAX_CONTENT} bytes")
            one, end = parse_record(held, at)
        except Damaged as e:
            if gap is None:
                gap, reason = base + at, str(e)
            later = _VERSION_LINE.search(held, at + 1)
            while later is None and not done:  # what may be the beginning of a version line stays
                piece = next(chunks, None)
                done = piece is None
                keep = max(at, len(held) - len(_VERSION) - 1)
                held, base = held[keep:] + (piece or b""), base + keep
                later = _VERSION_LINE.search(held, 1 if keep == at else 0)
                at = 0
            at = later.start() if later else len(held)
            continue
        if gap is not None:
            yield gap, base + at, reason, False
            gap = None
        yield base + at, base + end, one, bool(_DIGEST.search(held, at, end))
        at = end
    if gap is not None:
        yield gap, base + len(held), reason, False


def _inner(content: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record or a gap's reason) of content, in order; together they cover it."""
    at, gap, reason = 0, None, ""
    while at < len(content):
        try:
            one, end = parse_record(content, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            later = _VERSION_LINE.search(content, at + 1)
            at = later.start() if later else len(content)
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        yield at, end, one
        at = end
    if gap is not None:
        yield gap, len(content), reason


def salvage(data: bytes) -> Iterator[dict]:
    """Records ({"kind": "record", "start", "end", ...}) and gaps ({"kind": "gap", "start", "end", "reason"}) in order;
    together they cover every byte, but for empty members.

    Records and gaps inside a member have the member's start and end; an inner gap's reason has the bytes of the content that
    it spans. A member that is damaged itself gives the whole records that came out of it and then one gap up to what follows;
    those records have the start and end of that gap. A member without a single whole record is one gap. Of a member whose content is over
    MAX_CONTENT a record is held at a time, and a gap before it is closed first.
    """
    at, gap, reason, held = 0, None, "", []

    def closed(end: int) -> list[dict]:
        return [{"kind": "record", "start": start, "end": end} | one for start, one in held] + [{"kind": "gap", "start": gap, "end": end, "reason": reason}]

    while at < len(data):
        wrong, found = "", []
        if data.startswith(_MAGIC, at):
            content, end, wrong = read_member(data, at)
            if wrong == _LONG:
                # A first pass finds whether and where the member ends, as its records tell that, too, and whether it holds one.
                ended, any_whole, first = [], False, ""
                for _, _, x, sure in _streamed(member_chunks(data, at, ended)):
                    any_whole, first = any_whole or isinstance(x, dict), first or (x if isinstance(x, str) else "")
                end, wrong = ended
                wrong = wrong or ("" if any_whole else first)
                later = _NEXT.search(data, at + 1) if wrong else None
                stop = end if not wrong else later.start() if later else len(data)
                if gap is not None and (any_whole or not wrong):
                    yield from closed(at)
                    gap, held = None, []
                if any_whole:
                    for low, high, x, sure in _streamed(member_chunks(data, at, [])):
                        if isinstance(x, dict) and (wrong != _BAD or sure):
                            yield {"kind": "record", "start": at, "end": stop} | x
                        elif isinstance(x, str) and not wrong:
                            yield {"kind": "gap", "start": at, "end": stop, "reason": f"{x}: bytes {low} to {high} of the member's content"}
                if wrong and gap is None:
                    gap, reason = at, wrong
                at = stop
                continue
            found = list(_inner(content))
            whole = [x for low, high, x in found if isinstance(x, dict) and (wrong != _BAD or _DIGEST.search(content, low, high))]
            if wrong:
                held += [(at, x) for x in whole]
            elif content and not whole:
                wrong = found[0][2]
        else:
            try:
                one, end = parse_record(data, at)
                found = [(0, 0, one)]
            except Damaged as e:
                wrong = str(e)
        if wrong:
            if gap is None:
                gap, reason = at, wrong
            later = _NEXT.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if gap is not None:
            yield from closed(at)
            gap, held = None, []
        for low, high, x in found:
            if isinstance(x, dict):
                yield {"kind": "record", "start": at, "end": end} | x
            else:
                yield {"kind": "gap", "start": at, "end": end, "reason": f"{x}: bytes {low} to {high} of the member's content"}
        at = end
    if gap is not None:
        yield from closed(len(data))


def revisits(pages: DataFrame, id_col: str, text_col: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(row, refers_to) of pages whose payload a page of smaller id has, too."""
    slim = pages.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("payload"))
    slim = saved(slim.where(F.octet_length("payload") >= min_bytes).select("row", "id", F.unhex(F.sha2("payload", 256)).alias("digest")), "warc-digests")
    groups = slim.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")
    found = skew_join(slim, groups, ["digest"], "inner", "warc")
    return found.where(~F.col("id").eqNullSafe(F.col("refers_to"))).groupBy("row").agg(F.min("refers_to").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", min_bytes: int = MIN_REVISIT) -> None:
    """Writes a record a row below path. Of rows of equal payload of at least min_bytes, those of the smallest id are
    responses and the others revisits. A null text is an empty payload, a null id is never referred to, a null URI is left
    out; repeated rows are repeated records, and other columns are ignored. An empty table writes no archive."""
    bounded_batches(pages.sparkSession)
    d = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.col(text_col).alias("text"))
    d = d.withColumn("row", row_key(F.col("id"), F.col("text"))).join(saved(revisits(d, "id", "text", min_bytes), "warc-revisits"), "row", "left")
    payload = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    d = d.select("id", "uri", "refers_to", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if pd.isna(x) else int(x)
        held, size = [], 0
        for batch in batches:
            for i, uri, refers_to, own, digest in zip(batch["id"], batch["uri"], batch["refers_to"], batch["payload"], batch["digest"], strict=True):
                held.append(record(whole(i), uri, bytes(own), digest, whole(refers_to)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"archive": [b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"archive": [b"".join(held)]})

    write_blobs(d.mapInPandas(pack, "archive binary"), "archive", path, TRAILER)


RECORDS = "kind string, path string, start long, end long, reason string, record_type string, record_id string, uri string, refers_to string, digest string, length long, payload binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """What salvage() finds in the files below path: a row a record (kind `record`) and a row a quarantined gap (kind `gap`). A task holds
    one file (at most 2 GB, as Spark reads it) and MAX_CONTENT bytes of a member of it; longer members are read as streams, so none of their records is lost."""
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows, size = [], 0
                for x in salvage(bytes(content)):
                    rows.append([name if c == "path" else x.get(c) for c in names])
                    size += len(x.get("payload") or b"") + 200
                    if size > 4 << 20:
                        yield pd.DataFrame(rows, columns=names).astype({"length": "Int64"})
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"length": "Int64"})

    return read_blobs(spark, path).mapInPandas(read, RECORDS)


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes and payload_digest of records that write_archives() has made. A response's
    digest is taken anew from the payload that was read; a revisit's is that of its head."""
    number = lambda c: F.regexp_extract(c, f"{_PAGE}(-?[0-9]+)>", 1)
    page = F.when(number("record_id") != "", number("record_id").cast("long"))
    return records.where(F.col("kind") == "record").select(
        page.alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), "length").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "digest").alias("payload_digest"), "record_type",
        F.when(F.col("refers_to").isNotNull(), number("refers_to").cast("long")).alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    path = work_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return pages_of(read_archives(pages.sparkSession, path))
