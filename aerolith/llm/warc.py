"""Operator 8: WARC files with boundary-chain verification.

Pages are written as WARC/1.1 records, a gzip member each (or plain), a file a task. Of pages with equal payloads the
one of the smallest id is a response, the others revisit it. For reading, files are cut into byte ranges. A task looks
for the magic of a record at every place of its range, parses what starts there, and emits a candidate with the offset of its
successor; magic inside a payload gives false candidates. Within a range a task also follows successors to the first
offset outside. Pointer jumping over those, from the start of each file, finds where the true chain enters each range, in a
number of rounds that is the logarithm of the ranges of a file; records on the chain from there are kept. A chain that
does not end at the end of its file is an error.

A head that does not end within a megabyte, a length beyond the file or one that no blank line ends is no candidate, so that
text inside payloads never makes a task read on; bodies are hashed as they are read.

Defined results: a null payload is empty; a null url is an empty target, and one of more than half a megabyte is left out; rows without an id are responses unless their payload
has a page with an id; rows that repeat an id and payload are each a record of the same type; an empty table writes no file;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.shared import discard, fresh_path, opened, written

#: Fixed values of the format.
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLAIN, MEMBER = b"WARC/1.1\r\n", b"\x1f\x8b\x08"
END = b"\r\n\r\n"
#: Most bytes of a record's head where the manifest doesn't say more, and bytes read at a time.
HEAD_MOST, PIECE = 1 << 20, 1 << 16
RECORD = "path string, block long, offset long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_FIELDS = [x.split() for x in RECORD.split(", ")]
_SCHEMA = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in _FIELDS])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, revisits: int | None, date: str, compress: bool) -> bytes:
    """One record; revisits is the page_id of the response that it repeats."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
    block = http + (payload if revisits is None else b"")
    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = [f"WARC-Type: {'response' if revisits is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisits is not None:
        lines += [f"WARC-Profile: {PROFILE.decode()}", f"WARC-Refers-To: {record_id(revisits)}", f"Refers-To-Page: {revisits}"]
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = PLAIN + "\r\n".join(lines).encode() + END + block + END
    if not compress:
        return data
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Stream:
    """Bytes that come in chunks, taken up to a mark or by number; no more is held than a mark may need."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.held = iter(chunks), b""

    def upto(self, mark: bytes, most: int) -> bytes | None:
        """What stands before the mark, which is taken too; None if it does not begin within `most` bytes."""
        searched = 0
        while (at := self.held.find(mark, max(0, searched - len(mark)), most + len(mark))) < 0:
            searched = len(self.held)
            more = next(self.chunks, None) if searched < most + len(mark) else None
            if more is None:
                return None
            self.held += more
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def feed(self, n: int, sink: Callable[[bytes], object]) -> bool:
        """Gives the next n bytes to sink; False if there are fewer."""
        while n:
            if not self.held and not (more := next(self.chunks, b"")):
                return False
            self.held = self.held or more
            part, self.held = self.held[:n], self.held[n:]
            sink(part)
            n -= len(part)
        return True


def parse(chunks: Iterable[bytes], room: int | None = None, sound: Callable[[int], bool] = lambda length: True, head_most: int = HEAD_MOST) -> tuple[int, dict] | None:
    """Length and fields of the record at the start of a byte stream; None if none starts there.

    A head over head_most bytes, a record longer than room and one whose length is not sound are none; the body is read last, and
    never held whole.
    """
    stream = Stream(chunks)
    lead = stream.upto(END, head_most)
    if lead is None or not lead.startswith(PLAIN):
        return None
    head = dict(x.split(": ", 1) for x in lead[len(PLAIN) :].decode("utf-8", "replace").split("\r\n") if ": " in x)
    size = head.get("Content-Length", "")
    if not size.isdecimal() or len(size) > 18 or head.get("WARC-Type") not in ("response", "revisit"):
        return None
    length = len(lead) + 4 + int(size) + 4
    if room is not None and length > room or not sound(length):
        return None
    http = stream.upto(END, min(int(size), HEAD_MOST))
    rest = int(size) - len(http or b"") - 4
    sha, tail = hashlib.sha1(), []
    if http is None or rest < 0 or not stream.feed(rest, sha.update) or not stream.feed(4, tail.append) or b"".join(tail) != END:
        return None
    named = head.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    number = lambda x: int(x) if x and x.lstrip("-").isdecimal() else None
    if head["WARC-Type"] == "response":
        if base64.b32encode(sha.digest()).decode() != named:
            return None
        n, refers = rest, None
    else:
        n, refers = number(http.rpartition(b"Content-Length: ")[2].decode("ascii", "replace")), number(head.get("Refers-To-Page"))
    return length, {"page_id": number(head.get("Page-Id")), "payload_bytes": n, "payload_digest": named, "record_type": head["WARC-Type"], "refers_to": refers}


def pieces(f, at: int) -> Iterator[bytes]:
    """The bytes of a file from a place on."""
    while True:
        f.seek(at)
        data = f.read(PIECE)
        if not data:
            return
        yield data
        at += len(data)


class Member:
    """The contents of the gzip member at a place of a file; size is its length once all is read, None if it is damaged or cut off."""

    def __init__(self, f, at: int):
        self.f, self.at, self.size = f, at, None

    def __iter__(self) -> Iterator[bytes]:
        unpack, taken = zlib.decompressobj(31), 0
        for data in pieces(self.f, self.at):
            taken += len(data)
            while data:
                try:
                    out = unpack.decompress(data, PIECE)
                except zlib.error:
                    return
                if out:
                    yield out
                if unpack.eof:
                    self.size = taken - len(unpack.unused_data)
                    return
                data = unpack.unconsumed_tail


def candidates(f, size: int, start: int, stop: int, compressed: bool, head_most: int = HEAD_MOST) -> Iterator[tuple[int, int, dict]]:
    """offset, successor's offset and fields of all that looks like a record and starts in [start, stop)."""
    magic = MEMBER if compressed else PLAIN
    f.seek(start)
    data = f.read(min(size, stop + len(magic) - 1) - start)

    def ends(at: int, length: int) -> bool:
        f.seek(at + length - 4)
        return f.read(4) == END

    at = data.find(magic)
    while 0 <= at < stop - start:
        here = start + at
        if compressed:
            member = Member(f, here)
            chunks = iter(member)
            found = parse(chunks, head_most=head_most)
            if found and next(chunks, None) is None and member.size is not None:
                yield here, here + member.size, found[1]
        elif found := parse(pieces(f, here), size - here, lambda length, here=here: ends(here, length), head_most):
            yield here, here + found[0], found[1]
        at = data.find(magic, at + 1)


def write_warc(pages: DataFrame, compress: bool = True, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record for each page; returns the manifest: path, n_bytes, n_records, head_most. Payloads under least_bytes are never revisited.

    head_most bounds the bytes of a head in the file, whatever the length of the targets, so that a reader knows where to give up.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    copies = keyed.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    copies = written(copies.select("sha", "size", "first"), "copies")
    placed = keyed.join(copies, ["sha", "size"], "left")
    revisits = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def write(batches):
        out, name, n, n_bytes, head = None, "", 0, 0, HEAD_MOST
        fs, base = opened(folder)
        for batch in batches:
            for page_id, url, body, first in zip(*(batch.column(i) for i in range(4))):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.warc" + ".gz" * compress
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page_id.as_py(), url.as_py(), body.as_py(), first.as_py(), date, compress)
                out.write(data)
                # Nothing of a target takes more than 12 bytes; the other lines are short.
                n, n_bytes, head = n + 1, n_bytes + len(data), max(head, 12 * len(url.as_py() or "") + 4096)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "n_bytes": n_bytes, "n_records": n, "head_most": head}])

    manifest = written(placed.select("page_id", "url", "payload", revisits.alias("first")).mapInArrow(write, "path string, n_bytes long, n_records long, head_most long"), "manifest")
    discard(copies)
    return manifest


def scan(manifest: DataFrame, block: int) -> DataFrame:
    """All candidates of all byte ranges, with `leave`, the first offset outside the range that successors lead to."""

    def run(batches):
        for batch in batches:
            for path, size, head_most, number in zip(*(c.to_pylist() for c in batch.columns)):
                fs, base = opened(path)
                with fs.open_input_file(base) as f:
                    rows = [{"path": path, "block": number, "offset": a, "next": b} | fields for a, b, fields in candidates(f, size, number * block, min(size, (number + 1) * block), path.endswith(".gz"), head_most)]
                leave: dict[int, int] = {}
                for row in reversed(rows):
                    leave[row["offset"]] = leave.get(row["next"], row["next"])
                for i in range(0, len(rows), 10_000):
                    part = pa.RecordBatch.from_pylist(rows[i : i + 10_000], _SCHEMA)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([leave[r["offset"]] for r in rows[i : i + 10_000]], pa.int64())], [*part.schema.names, "leave"])

    head_most = F.col("head_most") if "head_most" in manifest.columns else F.lit(HEAD_MOST)
    ranges = manifest.select("path", F.col("n_bytes").alias("size"), head_most.cast("long").alias("head_most"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / block))).alias("block"))
    n = max(1, min(10_000, ranges.count()))  # a fixed number, else adaptive execution gathers the tiny rows into one task
    return ranges.select("path", "size", "head_most", "block").repartition(n, "path", "block").mapInArrow(run, RECORD + ", leave long")


def reached(steps: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, offset) of all steps' offsets on the chain from offset 0, by pointer jumping over (path, offset, leave)."""
    found, old = manifest.select("path", F.lit(0).cast("long").alias("offset")), []
    jumps, n = steps, -1
    while True:
        ahead = found.join(jumps, ["path", "offset"]).select("path", F.col("leave").alias("offset"))
        more = written(found.unionByName(ahead).distinct(), "reached")
        if (now := more.count()) == n:
            discard(*old)
            return more
        n, found = now, more
        further = jumps.select("path", F.col("leave").alias("offset"), F.col("leave").alias("via")).distinct()
        landing = further.join(jumps.select("path", "offset", F.col("leave").alias("far")), ["path", "offset"])
        jumps = written(jumps.join(landing.select("path", F.col("via").alias("leave"), "far"), ["path", "leave"]).select("path", "offset", F.col("far").alias("leave")), "jumps")
        discard(*old)  # what the tables just written came from
        old = [more, jumps]


def read_warc(manifest: DataFrame, block: int = 4 << 20) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record on the chains of the files."""
    found = written(scan(manifest, block), "candidates")
    entries = reached(found.select("path", "offset", "leave"), manifest)
    ends = entries.groupBy("path").agg(F.max("offset").alias("end"))
    if (broken := manifest.join(ends, "path", "left").where("end is null or end != n_bytes").select("path").first()) is not None:
        raise ValueError(f"the chain of records of {broken[0]} breaks off")
    starts = entries.join(manifest, "path").where("offset < n_bytes").select("path", F.floor(F.col("offset") / block).alias("block"), F.col("offset").alias("entry"))

    def walk(table: pa.Table) -> pa.Table:
        after = dict(zip(table["offset"].to_pylist(), table["next"].to_pylist()))
        at, chain = table["entry"][0].as_py(), set()
        while at in after:
            chain.add(at)
            at = after[at]
        return table.filter(pa.array([o in chain for o in table["offset"].to_pylist()])).select(["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    entered = found.drop("leave").join(starts, ["path", "block"])
    return entered.groupBy("path", "block").applyInArrow(walk, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
