"""WARC archives: a writer with revisits, and a reader that salvages damaged files.

The reader walks a file from record to record: gzip members (one record each, or many) or plain records.
A member must inflate with its checksum, a record must have its version line, its headers, its length
and the end it promises, and its block must have the digest that its header states. Where one of these
fails, the reader searches for the next place at which a member inflates to a version line or a plain version line
is followed by headers, goes on from there, and logs the bytes between as a quarantined gap. In a member of many
records the same search goes on in what it inflates to, as far as that goes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget_on_exit, new_path, staged

#: Payloads of fewer bytes are always written in full; an archive is closed at this size; a record may inflate to so much
#: (2 GiB less a little: a larger one can't be a value of a row).
LEAST_REVISIT, ARCHIVE_BYTES, MOST_RECORD = 1000, 16 << 20, (1 << 31) - (1 << 16)
#: A gzip member of more bytes is read in pieces.
MOST_WHOLE = 64 << 20
DATE = "2024-01-01T00:00:00Z"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Headers that every record has; characters that no header has.
_NEEDED = ("warc-type", "warc-record-id", "warc-date")
_CONTROL = re.compile(rb"[\x00-\x08\x0a-\x1f\x7f]")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Damaged(ValueError):
    """A check failed; the message is the reason that is logged."""


@dataclass(frozen=True)
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


@dataclass(frozen=True)
class Gap:
    """Lost bytes of the file; in a member of which records are kept, the place and length in what it inflates to."""

    offset: int
    length: int
    reason: str
    inflated_offset: int | None = None
    inflated_length: int | None = None


# ---------------------------------------------------------------- reading


def read_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers (names lower-cased), block and end of the plain record at ``at``."""
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", version.end() - 2)
    if stop < 0:
        raise Damaged("headers do not end")
    headers: dict[str, str] = {}
    for line in data[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or _CONTROL.search(line):
            raise Damaged("a header is no header")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit() or not all(headers.get(n) for n in _NEEDED):
        raise Damaged("a header is missing")
    begin = stop + 4
    end = begin + int(headers["content-length"])
    if end + 4 > len(data):
        raise Damaged("truncated record")
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where it says")
    block = data[begin:end]
    named, _, digest = headers.get("warc-block-digest", "").partition(":")
    if named.lower() == "sha1":
        if _bare(digest) != hashlib.sha1(block).hexdigest():
            raise Damaged("block digest differs")
    elif headers.get("warc-payload-digest", "").lower().startswith("sha1:") and headers["warc-type"] == "response":
        if payload_of(headers, block)[2] != _bare(headers["warc-payload-digest"][5:]):
            raise Damaged("payload digest differs")
    return headers, block, end + 4


def _bare(digest: str) -> str:
    """A SHA-1 in base 32 or hex as lower-case hex; empty if it is neither."""
    try:
        return base64.b32decode(digest.upper()).hex() if len(digest) == 32 else bytes.fromhex(digest).hex()
    except ValueError:
        return ""


def inflate_member(data: bytes, at: int, most: int = MOST_RECORD) -> tuple[bytes, int]:
    """The content of the gzip member at ``at`` and where it ends; its checksum is tested."""
    view, z, out, made, here = memoryview(data), zlib.decompressobj(31), [], 0, at
    try:
        while not z.eof:
            if here >= len(data):
                raise Damaged("truncated member")
            piece = view[here : here + 65536]
            out.append(z.decompress(piece))
            made += len(out[-1])
            here += len(piece)
            if made > most:
                raise Damaged("member is too large")
    except zlib.error as e:
        raise Damaged(f"member does not inflate: {str(e).rpartition(': ')[2]}") from None
    return b"".join(out), here - len(z.unused_data)


def next_plain(data: bytes, at: int) -> int:
    """The first place from ``at`` on with a version line and a header; the end if there is none."""
    while found := _VERSION.search(data, at):
        if re.match(rb"[A-Za-z][A-Za-z-]*:", data[found.end() : found.end() + 64]):
            return found.start()
        at = found.start() + 1
    return len(data)


def next_start(data: bytes, at: int) -> int:
    """The first place from ``at`` on where a record can begin; the file's end if there is none."""
    plain, member = next_plain(data, at), at
    while True:
        member = data.find(b"\x1f\x8b\x08", member, plain + 3)
        if member < 0 or member >= plain:
            return plain
        try:
            if zlib.decompressobj(31).decompress(data[member : member + 4096], 16).startswith(b"WARC/1."):
                return member
        except zlib.error:
            pass
        member += 1


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records of an archive that pass their checks, and the gaps between them, in order. Gaps that touch are one."""
    at, gap = 0, None
    while at < len(data):
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                content, end = inflate_member(data, at, MOST_WHOLE)
                found = [Record(at, end - at, h, b) for h, b in _records(content)]
            else:
                headers, block, end = read_record(data, at)
                found = [Record(at, end - at, headers, block)]
        except Damaged as e:
            if data[at : at + 2] == b"\x1f\x8b":
                member = Member(data, at)
                kept = member.parts()
                first = next(kept, None)
                if first:
                    if gap:
                        yield gap
                        gap = None
                    yield first
                    yield from kept
                    at = member.end
                    continue
            end = next_start(data, at + 1)
            gap = Gap(gap.offset, end - gap.offset, gap.reason) if gap else Gap(at, end - at, str(e))
        else:
            if gap:
                yield gap
                gap = None
            yield from found
        at = end
    if gap:
        yield gap


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one member; one that holds anything else is damaged as a whole."""
    at = 0
    if not content:
        raise Damaged("empty member")
    while at < len(content):
        headers, block, at = read_record(content, at)
        yield headers, block


class Member:
    """A gzip member that is damaged, holds damaged records or is very large; it is inflated in pieces, twice."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.reason, self.reached = "", at
        self.size = sum(map(len, self._pieces()))
        self.sound = not self.reason
        self.end = self.reached if self.sound else next_start(data, at + 1)
        if not self.sound and self.data[self.end : self.end + 5] == b"WARC/":  # perhaps within what was inflated, if it is stored
            self.end = next_start(data, max(self.end, self.reached))

    def _pieces(self) -> Iterator[bytes]:
        """What can be inflated; then ``reason`` tells what broke it off, and ``reached`` where."""
        z, here = zlib.decompressobj(31), self.at
        while not z.eof:
            if here >= len(self.data):
                self.reason, self.reached = "truncated member", here
                return
            piece, before = self.data[here : here + 4096], z.copy()
            try:
                out = z.decompress(piece)
            except zlib.error as e:
                # What is good of this piece, byte by byte.
                self.reason = f"member does not inflate: {str(e).rpartition(': ')[2]}"
                for k in range(len(piece)):
                    try:
                        out = before.decompress(piece[k : k + 1])
                    except zlib.error:
                        break
                    yield out
                self.reached = here + k
                return
            here += len(piece)
            self.reached = here - len(z.unused_data)
            yield out

    def parts(self) -> Iterator[Record | Gap]:
        """Records that pass and gaps in what is inflated; nothing if no record passes."""
        gaps: list[Gap] = []
        any_kept = False
        for x in self._walk():
            if isinstance(x, Record) or any_kept:
                yield from gaps
                yield x
                gaps, any_kept = [], True
            else:
                gaps.append(x)
        if any_kept and not self.sound:
            yield Gap(self.at, self.end - self.at, self.reason, self.size, None)

    def _walk(self) -> Iterator[Record | Gap]:
        pieces, held, at, base, done, gap = self._pieces(), b"", 0, 0, False, None

        def lost(a: int, b: int, reason: str) -> tuple[int, int, str]:
            return (gap[0], b, gap[2]) if gap else (a, b, reason)

        def more() -> None:
            """At least doubles what is held from ``at`` on, so that reading again costs no more than in proportion."""
            nonlocal held, at, base, done
            new, need = [held[at:]], max(1 << 16, len(held) - at)
            base, at = base + at, 0
            while need > 0 and not done:
                piece = next(pieces, None)
                done = piece is None
                new.append(piece or b"")
                need -= len(new[-1])
            held = b"".join(new)

        while at < len(held) or not done:
            try:
                headers, block, end = read_record(held, at)
                if not self.sound:
                    if base + at == 0 and end == self.size:
                        raise Damaged(self.reason)  # a member of one record: its checksum is the record's
                    named = headers.get("warc-block-digest", ""), headers.get("warc-payload-digest", "") if headers["warc-type"] == "response" else ""
                    if not any(x.lower().startswith("sha1:") for x in named):
                        raise Damaged("no digest in a damaged member")
            except Damaged as e:
                if not done and len(held) - at <= MOST_RECORD and (len(held) - at < 128 or str(e) in ("truncated record", "headers do not end")):
                    more()
                    continue
                if at == len(held):
                    break
                found = next_plain(held, at + 1)
                if found == len(held) and not done:
                    found = max(at + 1, found - 80)  # a version line may go on in the next piece
                gap = lost(base + at, base + found, str(e))
                at = found
                if at > len(held) - 128 and not done:
                    more()
            else:
                if gap:
                    yield Gap(self.at, self.end - self.at, gap[2], gap[0], gap[1] - gap[0])
                    gap = None
                yield Record(self.at, self.end - self.at, headers, block)
                at = end
        if gap:
            yield Gap(self.at, self.end - self.at, gap[2], gap[0], gap[1] - gap[0])


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes | None, int, str]:
    """Payload (None for a revisit), its full length and bare SHA-1."""
    body, length = block, None
    if headers.get("content-type", "").startswith("application/http"):
        head, cut, body = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        length = int(stated[1]) if stated else None
        body = body if cut else b""
    if headers["warc-type"] == "revisit":
        return None, -1 if length is None else length, _bare(headers.get("warc-payload-digest", "").partition(":")[2])
    return body, len(body), hashlib.sha1(body).hexdigest()


_READ_DDL = "archive string, offset bigint, length bigint, reason string, type string, headers map<string,string>, payload_bytes bigint, payload_digest string, payload binary, inflated_offset bigint, inflated_length bigint"
_READ = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("inflated_offset", pa.int64()), ("inflated_length", pa.int64())])


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of ``archives`` (path, content), such as ``binaryFile`` gives.

    A record has archive, offset, length, type, headers (names lower-cased), payload_bytes, payload_digest (bare
    lower-case hex SHA-1 of the payload) and, if wanted, the payload (null for a revisit). A gap has archive, offset,
    length and the reason of the first check that failed there; its other columns are null. In a gzip member of
    which some records pass, gaps have the member's offset and length, and inflated_offset and inflated_length tell the
    place in its content (the length is null where the content breaks off).

    A null or empty content has no records. Files are taken one at a time; an archive should be small enough
    for one task, as those of :func:`write_archives` are. Repeated rows are read each. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, rows, held = batch.column(0)[i].as_py(), [], 0
                for x in salvage(batch.column(1)[i].as_py() or b""):
                    if isinstance(x, Gap):
                        rows.append((path, x.offset, x.length, x.reason, None, None, None, None, None, x.inflated_offset, x.inflated_length))
                    else:
                        body, n, digest = payload_of(x.headers, x.block)
                        rows.append((path, x.offset, x.length, None, x.headers["warc-type"], list(x.headers.items()), n, digest, body if with_payload else None, None, None))
                        held += len(body or b"") if with_payload else 0
                    if len(rows) >= 4096 or held > 32 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return archives.select("path", "content").mapInArrow(run, _READ_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


# ---------------------------------------------------------------- writing


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}:{digest}'.encode()).digest()[:16], version=5)}>"


def _label(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record_bytes(page_id: int | None, url: str | None, html: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the page ``refers_to`` that has the same payload."""
    sha1 = hashlib.sha1(html)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    revisit = refers_to is not None
    if not revisit:
        block += html
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, sha1.hexdigest()),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None,
        "WARC-Refers-To": record_id(refers_to, sha1.hexdigest()) if revisit else None,
        "WARC-Profile": _PROFILE if revisit else None,
        "WARC-Payload-Digest": _label(sha1.digest()),
        "WARC-Block-Digest": _label(hashlib.sha1(block).digest()),
        "X-Page-Id": page_id,
        "X-Refers-To-Page": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(content: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(content) + z.flush()


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    local = re.match(r"(?:file:/*)?(/.*)", uri) if not uri.startswith("file:") else re.match(r"file:/+(.*)", uri)
    if local:
        return fs.LocalFileSystem(), "/" + local[1].lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def _writer(folder: str, gzip: bool, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, at = filesystem(folder)
        files.create_dir(at, recursive=True)
        made, held, size = 0, [], 0

        def close() -> pa.RecordBatch:
            """The attempt is in the name: what an attempt that was lost has left is never taken for a file of another."""
            nonlocal made, held, size
            name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{made:05d}.warc{'.gz' if gzip else ''}"
            with files.open_output_stream(f"{at}/{name}", compression=None) as out:
                for piece in held:
                    out.write(piece)
            row = pa.RecordBatch.from_pydict({"archive": [name], "n_records": pa.array([len(held)], pa.int64()), "n_bytes": pa.array([size], pa.int64())})
            made, held, size = made + 1, [], 0
            return row

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (batch.column(k)[i].as_py() for k in range(4))
                plain = record_bytes(page_id, url, html or b"", refers_to)
                held.append(member(plain) if gzip else plain)
                size += len(held[-1])
                if size >= most_bytes:
                    yield close()
        if held:
            yield close()

    return run


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, html (bytes) and refers_to: the largest page_id of an equal payload.

    Equal payloads are found on digests alone; one row for each payload that occurs more than once is joined back. Null
    html is an empty payload, and smaller ones than ``least`` refer to nothing; rows with a null page_id never refer, and
    are never referred to while an id is there. Repeated rows are rows of their own. An empty table gives an empty result.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html"))
    narrow = rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least)
    twice = narrow.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("times")).where("times > 1").withColumnRenamed("digest", "of")
    again = narrow.join(twice, F.col("digest") == F.col("of")).where(F.col("page_id") != F.col("kept")).select(F.col("page_id").alias("again_id"), "of", F.col("kept").alias("refers_to")).distinct()
    keyed = rows.withColumn("digest", F.sha1("html"))
    return keyed.join(again, (F.col("page_id") == F.col("again_id")) & (F.col("digest") == F.col("of")), "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str, gzip: bool = True, least: int = LEAST_REVISIT, most_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) into archives under ``folder``, which all executors share.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest page_id is a response, the others
    revisit it; of rows with that same page_id all are responses, and so are rows without a page_id. Each record is a
    gzip member of its own (or plain). Null html is an empty payload; a null url leaves its header out. Returns archive,
    n_records and n_bytes of each file written; the work is done when this returns. Only these files count: the folder may
    hold others, left by tasks that were lost or ran twice.
    """
    return staged(with_revisits(pages, least).mapInArrow(_writer(folder, gzip, most_bytes), "archive string, n_records bigint, n_bytes bigint"), "warc-list")


def listed(written: DataFrame, folder: str) -> DataFrame:
    """(path, content) of the files that ``written`` (archive, as :func:`write_archives` gives it) names, one at a time for a task."""
    n = written.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{at}/{name}", compression=None) as source:
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([source.read()], pa.binary())], names=["path", "content"])

    return written.select("archive").repartition(max(1, n)).mapInArrow(run, "path string, content binary")


def round_trip(spark: SparkSession, pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) and reads the archives that were committed: what :func:`read_archives` gives of them.

    Null html is an empty payload, null urls and ids leave their headers out; very long pages are written and read whole;
    repeated rows have a record each. Other columns are not read. An empty table gives an empty result.
    """
    folder = new_path(spark, "warc")
    written = write_archives(pages, folder)
    if written.isEmpty():
        return read_archives(spark.createDataFrame([], "path string, content binary"), with_payload)
    forget_on_exit(spark, folder)
    return read_archives(listed(written, folder), with_payload)
