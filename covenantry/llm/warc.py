"""WARC archives: one gzip member per record, written and read in sequence by Spark tasks.

Writing: each task streams its rows to archive files in a shared folder, under names of its attempt;
the manifest lists those of the attempts that Spark committed. Rows with equal payloads are written once, as the response with the
largest id; the others become revisit records that refer to it.

Reading: each file is read front to back in fixed chunks. Members are inflated incrementally with zlib;
a record's header gives the length of its content, which is framed while it is inflated, and its block
and payload digests (SHA-1, where a record has them) are verified on the way. Of a record only the
header, and the payload where it is asked for, is held.

Archives of others: records of any type are framed and verified, and those that are no response or
revisit are passed over; ids that are not ours give a null page_id and refers_to, and stay as record_id;
digests of other kinds are not verified; a record without Content-Length, or of another length, is an
error, as is a member of several records.

Defined cases: null payload = empty payload; null id sorts below every id; rows that repeat the
largest id of their payload are all responses; an empty table gives no archive and no rows; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import SharedFile, materialise, open_filesystem, shared_dir

RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "2024-01-01T00:00:00Z"  # records carry no fetch time; a fixed one keeps files reproducible
CHUNK = 1 << 16
MAX_HEADER = 1 << 24  # bytes, such as of a url of 16 MB; a reader takes longer ones for damage


class WarcError(ValueError):
    """An archive that breaks the format or fails a digest."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(value: str | None) -> str:
    return "" if value is None else "".join(c if c >= " " else "%%%02X" % ord(c) for c in value)


def format_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


class Member:
    """One gzip member of a stream, inflated step by step; ``rest`` is what was read beyond its end."""

    def __init__(self, stream, data: bytes):
        self._stream, self._inflate, self._raw, self._ready, self.rest = stream, zlib.decompressobj(31), data, b"", b""

    def _more(self) -> bool:
        """Inflate up to ``CHUNK`` further bytes; False at the member's end."""
        while not self._inflate.eof:
            raw = self._inflate.unconsumed_tail or self._raw or self._stream.read(CHUNK)
            self._raw = b""
            if not raw:
                raise WarcError("the archive ends within a gzip member")
            try:
                found = self._inflate.decompress(raw, CHUNK)
            except zlib.error as error:
                raise WarcError(f"not a gzip member: {error}") from error
            if self._inflate.eof:
                self.rest = self._inflate.unused_data
            if found:
                self._ready += found
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """All up to a mark, which is passed over."""
        begin = 0
        while (at := self._ready.find(mark, begin)) < 0:
            begin = max(0, len(self._ready) - len(mark) + 1)
            if len(self._ready) > MAX_HEADER or not self._more():
                raise WarcError("no WARC header")
        found, self._ready = self._ready[:at], self._ready[at + len(mark) :]
        return found

    def take(self, size: int) -> Iterator[bytes]:
        """So many bytes, in parts."""
        while size:
            if not self._ready and not self._more():
                raise WarcError("the content's length differs from Content-Length")
            part, self._ready = self._ready[:size], self._ready[size:]
            size -= len(part)
            yield part

    def tail(self) -> bytes:
        """What is left of it, if it is little."""
        while len(self._ready) <= 4 and self._more():
            pass
        return self._ready


def parse_header(head: bytes) -> dict[str, str]:
    """Header fields by their names in lower case; a line that begins with white space continues the one before."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    headers: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            headers[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
    return headers


def _agrees(declared: str | None, found) -> bool:
    """Whether a digest field, if it is a SHA-1 in base32 or hexadecimal, is that of the data."""
    kind, _, value = (declared or "").partition(":")
    if kind.lower() != "sha1" or len(value) not in (32, 40):
        return True
    return value.lower() == found.hexdigest() if len(value) == 40 else value.upper() == base64.b32encode(found.digest()).decode()


class Payload:
    """The payload of a block given in parts: what follows the HTTP header of ``application/http``, else all."""

    def __init__(self, http: bool, keep: bool):
        self.head, self._open = b"", http
        self.size, self.sha1, self.parts = 0, hashlib.sha1(), [] if keep else None

    def add(self, part: bytes) -> None:
        if self._open:
            self.head += part
            at = self.head.find(b"\r\n\r\n", max(0, len(self.head) - len(part) - 3))
            if at < 0 and len(self.head) <= MAX_HEADER:
                return
            # without an end it is no HTTP header, but payload
            part, self.head, self._open = (self.head[at + 4 :], self.head[:at], False) if at >= 0 else (self.head, b"", False)
        self.size += len(part)
        self.sha1.update(part)
        if self.parts is not None:
            self.parts.append(part)

    def declared(self) -> int | None:
        for line in self.head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                return int(value)
        return None


class Inflated(Member):
    """A member that is inflated already."""

    def __init__(self, data: bytes):
        self._ready = data

    def _more(self) -> bool:
        return False


def frame_record(member: Member, keep: bool) -> tuple[dict[str, str], Payload]:
    """Header fields and payload of a member's record, verified; ``keep``: with the payload's bytes."""
    headers = parse_header(member.until(b"\r\n\r\n"))
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise WarcError("no Content-Length")
    kind, block = headers.get("warc-type", ""), hashlib.sha1()
    payload = Payload(headers.get("content-type", "").startswith("application/http"), keep and kind in ("response", "revisit"))
    for part in member.take(int(length)):
        block.update(part)
        payload.add(part)
    if member.tail() != b"\r\n\r\n":
        raise WarcError("the content's length differs from Content-Length")
    if not _agrees(headers.get("warc-block-digest"), block):
        raise WarcError(f"block digest of {headers.get('warc-record-id')} differs")
    if kind == "response" and not _agrees(headers.get("warc-payload-digest"), payload.sha1):
        raise WarcError(f"payload digest of {headers.get('warc-record-id')} differs")
    return headers, payload


def _members(stream) -> Iterator[Member]:
    """The gzip members of a stream; each must be read to its end before the next."""
    data = stream.read(CHUNK)
    while data:
        member = Member(stream, data)
        yield member
        data = member.rest or stream.read(CHUNK)


def iter_members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, each whole."""
    for member in _members(stream):
        parts = []
        while member._more():
            parts.append(member._ready)
            member._ready = b""
        yield b"".join(parts)


def iter_records(stream, keep: bool = True) -> Iterator[tuple[dict[str, str], Payload]]:
    """Header fields and payload of each record of a stream."""
    for member in _members(stream):
        yield frame_record(member, keep)


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def record_row(headers: dict[str, str], payload: Payload) -> tuple | None:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id and the payload (None in a
    revisit) of a response or revisit; a revisit has the length and digest it declares. Other records give None."""
    kind = headers.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    revisit, declared = kind == "revisit", payload.declared()
    own = base64.b32encode(payload.sha1.digest()).decode()
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None if revisit else own
    identity = headers.get("warc-record-id")
    return (_page(identity), headers.get("warc-target-uri") or None, declared if revisit else payload.size, digest,
            kind, _page(headers.get("warc-refers-to")), identity, None if revisit or payload.parts is None else b"".join(payload.parts))


def read_record(member: bytes) -> tuple | None:
    """The row of an inflated member."""
    return record_row(*frame_record(Inflated(member), True))


def plan_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), refers_to: null for responses, the response's id for revisits.

    Only digests and ids are grouped. The repeated digests are stored first, so that Spark knows
    their size: small, they are broadcast and no payload is shuffled; else a sort-merge join whose
    hot keys it splits."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    keyed = rows.withColumn("digest", F.sha1("payload"))
    repeated = materialise(
        keyed.filter(F.length("payload") >= min_bytes)
        .groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("digest", "response_id"),
        "warc-repeated",
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    return keyed.join(repeated, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = 1 << 30) -> DataFrame:
    """Write a record per row below ``folder``; returns the manifest (path, records), one row per archive.

    The manifest is stored beside the archives, so reading it again writes nothing again."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rows = ((i, u, p, r) for b in batches for i, u, p, r in zip(b["page_id"], b["url"], b["payload"], b["refers_to"], strict=True))
        part, pending = 0, next(rows, None)
        while pending is not None:
            count = 0

            def records():
                nonlocal pending, count
                size = 0
                while pending is not None and size < file_bytes:
                    page, url, payload, refers = pending
                    page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                    member = format_record(page, url, payload, refers, refers is not None)
                    size, count, pending = size + len(member), count + 1, next(rows, None)
                    yield member

            archive = SharedFile(f"{folder}/archives", f"part-{TaskContext.get().partitionId():06d}-{part:04d}.warc.gz")
            for member in records():
                archive.write(member)
            archive.close()
            yield pd.DataFrame({"path": [archive.uri], "records": [count]})
            part += 1

    spark = pages.sparkSession
    manifest = plan_revisits(pages, min_bytes).mapInPandas(write, "path string, records long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema("path string, records long").parquet(f"{folder}/manifest")


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the archives named in ``manifest.path``; each file is read by one task in sequence."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (p for b in batches for p in b["path"]):
            system, name = open_filesystem(path)
            rows: list[tuple] = []
            held = 0
            with system.open_input_stream(name, compression=None, buffer_size=CHUNK) as stream:
                for headers, payload in iter_records(stream, with_payload):
                    row = record_row(headers, payload)
                    if row is None:
                        continue
                    rows.append(row if with_payload else row[:-1])
                    held += payload.size if with_payload else 100
                    if held > 1 << 22:
                        yield frame(rows)
                        rows, held = [], 0
            yield frame(rows)

    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")] + ["payload"] * with_payload

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    return manifest.select("path").mapInPandas(scan, RECORD_SCHEMA + ", payload binary" * with_payload)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all of ``pages`` to archives in the session's shared folder and read them back."""
    return read_warc(write_warc(pages, shared_dir(pages.sparkSession, "warc")))


def oracle_sql() -> str:
    """The rows of ``archive_round_trip`` over ``pages`` in DuckDB SQL; a digest's base32 letters are groups of five of its bits."""
    nibble = lambda k: f"(instr('0123456789abcdef', (hex || '000')[5 * i // 4 + {k}]) - 1)"
    value = f"(({nibble(1)} * 256 + {nibble(2)} * 16 + {nibble(3)}) // (1 << (7 - 5 * i % 4)::INT)) % 32"
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages), h AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[({value}) + 1]), '') AS payload_digest, max(page_id) OVER (PARTITION BY hex) AS response FROM h)
SELECT page_id, nullif(url, '') AS url, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to, '<urn:page:' || coalesce(page_id::VARCHAR, '') || '>' AS record_id FROM d
"""
