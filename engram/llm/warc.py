"""WARC archives: a writer that stores equal payloads once, and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._base import tidy, work_path, written
from ._files import Replaced, opened

DATE = "2024-01-01T00:00:00Z"
#: Payloads below so many bytes are stored every time.
REVISIT_BYTES = 1000
#: Bytes of an archive that one task looks for record starts in, and bytes read at once.
SPLIT_BYTES, READ_BYTES = 4 << 20, 1 << 20
#: Bytes beyond a range in which its chain of records must go on.
LOOK_BYTES = 1 << 20
#: A record's head has fewer bytes.
HEAD_BYTES = 64 << 10
_GZIP = b"\x1f\x8b\x08"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _uri(page_id: int | None) -> str:
    return f"urn:engram:page:{'' if page_id is None else page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 1) -> bytes:
    """One gzip member. A revisit (refers_to given) has the digest and length of its payload, not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_uri(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block = http + payload
    else:
        block = http
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_uri(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    whole = ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(whole) + pack.flush()


def parsed(member: bytes) -> dict:
    """A record's fields from its uncompressed bytes; a response's digest and length are those of its payload."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda x: int(x[1:-1].rpartition(":")[2]) if x[1:-1].rpartition(":")[2] else None
    out = {"page_id": page(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "refers_to": None, "url": fields.get("WARC-Target-URI"), "payload": None}
    said = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if out["record_type"] == "revisit":
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return out | {"payload_digest": said, "payload_bytes": size, "refers_to": page(fields["WARC-Refers-To"])}
    got = hashlib.sha1(payload).hexdigest()
    if got != said:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    return out | {"payload_digest": got, "payload_bytes": len(payload), "payload": payload}


def _writer(folder: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path, out, n = f"{folder}/part-{part:06d}.warc.gz", None, 0
        for batch in batches:
            for i in range(len(batch)):
                page, url, payload, refers = (batch.column(k)[i] for k in range(4))
                if out is None:
                    out = Replaced(path)
                out.write(record(page.as_py(), url.as_py(), payload.as_buffer().to_pybytes() if payload.is_valid else b"", refers.as_py()))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([out.size], pa.int64()), pa.array([n], pa.int64())], ["path", "n_bytes", "n_records"])

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Write a record for each row; returns the table of archives (path, n_bytes, n_records).

    Of equal payloads of at least `least` bytes, rows with the largest id are responses and the others revisit it; if
    that id is on several such rows, each of them is a response, as are rows with a null id. Equal means equal SHA-1 and
    length. Only digests are grouped, one row of each for every task; the pages then meet the largest id of their digest in a join that can
    be split where one digest is very common. Null html is an empty payload, a null url has no target.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    digest = F.unhex(F.sha1("payload"))
    large = rows.select("id", digest.alias("d"), F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    largest = large.groupBy("d", "n").agg(F.max("id").alias("top"), F.count("*").alias("c")).where("c > 1").select(F.col("d").alias("d2"), F.col("n").alias("n2"), "top")
    own = rows.withColumns({"d": digest, "n": F.octet_length("payload")})
    met = own.join(largest, (own.d == largest.d2) & (own.n == largest.n2), "left")
    met = met.select("id", "url", "payload", F.when(F.col("id") < F.col("top"), F.col("top")).alias("refers"))
    return written(met.mapInArrow(_writer(folder), "path string, n_bytes long, n_records long"), "archives")


def _fields(head: bytes) -> dict[str, str] | None:
    """The header fields of a record's head, up to the empty line; None if it is no head of a record."""
    if not head.startswith(b"WARC/1."):
        return None
    try:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    except (UnicodeDecodeError, ValueError):
        return None
    return fields if {"WARC-Type", "WARC-Record-ID", "Content-Length"} <= fields.keys() and fields["Content-Length"].isdigit() else None


class _Archive:
    """A file read in pieces; at most a piece more than the member at hand is held."""

    def __init__(self, f):
        self.f, self.size, self.buffer, self.base = f, f.size(), b"", 0

    def piece(self, at: int) -> bytes:
        """READ_BYTES from a place on, less at the file's end."""
        if not self.base <= at <= self.base + len(self.buffer):
            self.buffer, self.base = b"", at
        while self.base + len(self.buffer) < min(at + READ_BYTES, self.size):
            place = self.base + len(self.buffer)
            self.buffer = self.buffer[max(0, at - self.base) :] + self.f.read_at(min(READ_BYTES, self.size - place), place)
            self.base = max(self.base, at)
        return self.buffer[at - self.base : at - self.base + READ_BYTES]

    def member(self, start: int) -> tuple[bytes, int] | None:
        """(record, the place after it) if a gzip member with a whole record begins here, decided by the record's head."""
        unpack, parts, at, fields, size = zlib.decompressobj(31), [], start, None, 0
        try:
            while not unpack.eof:
                packed = self.piece(at)
                if not packed:
                    return None
                at += len(packed)
                while packed and not unpack.eof:
                    part = unpack.decompress(packed, READ_BYTES if fields else HEAD_BYTES)
                    packed = unpack.unconsumed_tail
                    parts.append(part)
                    size += len(part)
                    if fields is None:
                        head, line, _ = b"".join(parts).partition(b"\r\n\r\n")
                        fields = _fields(head) if line else None
                        if fields is None and (line or size >= HEAD_BYTES or not head.startswith(b"WARC/1."[: len(head)])):
                            return None
                        end = len(head) + 4 + int(fields["Content-Length"]) + 4 if fields else 0
                    if fields and size > end:
                        return None
        except zlib.error:
            return None
        return (b"".join(parts), at - len(unpack.unused_data)) if fields and size == end else None


def members(path: str, start: int, end: int) -> Iterator[bytes]:
    """Uncompressed records whose gzip member starts in [start, end).

    The magic bytes are searched for; a place is a record's start if what follows inflates to a whole head of a WARC record and
    to as many bytes as that says. At most HEAD_BYTES are inflated to decide. Members follow each other without a gap, so
    a range is done when its chain of records reaches its end and goes on for LOOK_BYTES, or to the file's end.

    Where a chain breaks, the archive is damaged, or the chain was that of an archive stored uncompressed inside a record. The file is
    then followed from its first byte, which surely begins a record: either that chain has the range's records, or it
    breaks as well, and that is an error. As the end of each range's chain is looked at too, damage anywhere is found by the range whose
    records lead to it, whatever the ranges are: records are never left out. An archive inside a record that goes on
    over a whole range and LOOK_BYTES is taken for records.
    """
    system, where = opened(path)
    with system.open_input_file(where) as f:
        archive, at = _Archive(f), start
        end = min(end, archive.size)
        while start and at < end:  # the first place in the range that may begin a chain
            k = archive.piece(at).find(_GZIP)
            if k < 0:
                at += max(1, len(archive.piece(at)) - len(_GZIP) + 1)
            elif at + k < end and not archive.member(at + k):
                at += k + 1
            else:
                at += k
                break
        if at >= end:
            return
        chain: list[bytes] = []
        while at < end and (found := archive.member(at)):
            if start:
                chain.append(found[0])
            else:
                yield found[0]
            at = found[1]
        if at >= end and _goes_on(archive, at, min(end + LOOK_BYTES, archive.size)):
            yield from chain
            return
        if not start and at < end:
            raise ValueError(f"{path} has no record at {at}")
        chain.clear()
        at = 0
        while at < max(end, min(end + LOOK_BYTES, archive.size)):
            found = archive.member(at)
            if not found:
                raise ValueError(f"{path} has no record at {at}")
            if start and start <= at < end:
                yield found[0]
            at = found[1]


def _goes_on(archive: _Archive, at: int, limit: int) -> bool:
    """Whether records follow each other from a place on up to the limit."""
    while at < limit:
        found = archive.member(at)
        if not found:
            return False
        at = found[1]
    return True


def _reader(with_payload: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types)], names)

        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                found, held = [], 0
                for m in members(path, start, end):
                    r = parsed(m)
                    if not with_payload:
                        r["payload"] = None
                    held += len(r["payload"] or b"")
                    found.append(r)
                    if len(found) >= 5000 or held > 8 << 20:
                        yield batch_of(found)
                        found, held = [], 0
                if found:
                    yield batch_of(found)

    return run


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the archives (path, n_bytes): each task scans byte ranges and owns the records starting there.

    Every record comes once, whatever the split size; no archives, or empty ones, give no records. A payload that lacks its
    digest is an error, and so is whatever is no record, at an archive's start, between its records or at its cut end, for every split size.
    """
    ranges = archives.select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least("n_bytes", F.col("start") + split_bytes).alias("end"))
    tasks = max(1, min(ranges.count(), 20_000))  # named, or adaptive execution would put such small rows into one task
    return ranges.repartition(tasks, "path", "start").mapInArrow(_reader(with_payload), _RECORD)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) read back from archives of pages.

    One row for each row of pages, repeated rows included; nulls as in write_warc. Other columns aren't read; an empty table gives an
    empty result.
    """
    archives = write_warc(pages, folder or work_path(pages.sparkSession, "warc"), id_col, url_col, html_col)
    out = read_warc(archives, with_payload=False)
    return out.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
