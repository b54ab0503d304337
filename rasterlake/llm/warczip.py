"""WARC records in ZIP packages: writing, and range reads without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` (a line per record with its offset and length), both
stored, not deflated.  Reading parses the end-of-directory records, ZIP64 ones
included, and the central directory, locates the members, reads the index, and
then fetches each record by a range read inside the stored archive member.

Packages go to the shared folder through ``pyarrow.fs``, so any store that it
knows will do.  A task writes under a name of its own and lists the package in
the manifest only when it is complete; packages of lost attempts are ignored.

Edge cases: a null html is an empty payload; rows with a null ``page_id`` are
written and read like others but never chosen as the response of a group;
repeated rows are records of their own (with equal page_id, the same record
type); an empty table gives no packages and no rows.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from rasterlake.session import materialize, scratch_path

MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 64 << 20
REVISIT_BYTES = 100
#: Fixed values of the ZIP format.
END_SIG, END64_SIG, LOCATOR64_SIG, CENTRAL_SIG, LOCAL_SIG = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
NO32, NO16 = 0xFFFFFFFF, 0xFFFF
READ_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


# ---- ZIP directories -------------------------------------------------------


def zip_members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Name to (data offset, stored size, method) of each member of an open file.

    ``f`` needs ``seek`` and ``read``.  Only directories and local headers are
    read.
    """

    def at(pos: int, n: int) -> bytes:
        f.seek(pos)
        return f.read(n)

    tail_at = max(0, size - 22 - 65535)
    tail = at(tail_at, size - tail_at)
    k = tail.rfind(struct.pack("<I", END_SIG))
    if k < 0:
        raise ValueError("no end of central directory")
    count, length, begin = struct.unpack("<HII", tail[k + 10 : k + 20])
    if NO16 == count or NO32 in (length, begin):
        sig, _, end64, _ = struct.unpack("<IIQI", at(tail_at + k - 20, 20))
        if sig != LOCATOR64_SIG:
            raise ValueError("no ZIP64 locator")
        head = at(end64, 56)
        if struct.unpack("<I", head[:4])[0] != END64_SIG:
            raise ValueError("no ZIP64 end of central directory")
        count, length, begin = struct.unpack("<QQQ", head[32:56])
    directory, pos, out = at(begin, length), 0, {}
    for _ in range(count):
        sig, method, packed, plain, n_name, n_extra, n_note, offset = struct.unpack("<I6xH8xIIHHH8xI", directory[pos : pos + 46])
        if sig != CENTRAL_SIG:
            raise ValueError("broken central directory")
        name = directory[pos + 46 : pos + 46 + n_name].decode()
        extra = directory[pos + 46 + n_name : pos + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            if tag == 1:  # ZIP64: only the fields whose 32-bit form is full
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(wide) if plain == NO32 else plain
                packed = next(wide) if packed == NO32 else packed
                offset = next(wide) if offset == NO32 else offset
            extra = extra[4 + n :]
        local = at(offset, 30)
        if struct.unpack("<I", local[:4])[0] != LOCAL_SIG:
            raise ValueError("broken local header")
        out[name] = (offset + 30 + sum(struct.unpack("<HH", local[26:30])), packed, method)
        pos += 46 + n_name + n_extra + n_note
    return out


# ---- WARC records ----------------------------------------------------------


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit when ``refers_to`` is given."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.insert(2, "WARC-Target-URI: " + "".join(url.split()))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_record(raw: bytes) -> dict:
    """Fields of one gzip member; the digest of a response is checked."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = field["WARC-Payload-Digest"].removeprefix("sha256:"), field["WARC-Type"]
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"payload of {field['WARC-Record-ID']} does not match its digest")
    number = lambda v: int(v[len("<urn:page:") : -1]) if v and v != record_id(None) else None
    return {"page_id": number(field["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number(field.get("WARC-Refers-To")), "url": field.get("WARC-Target-URI"), "payload": payload if kind == "response" else None}


class Package:
    """One package being built in memory, of at most about ``PACKAGE_BYTES``."""

    def __init__(self) -> None:
        self.data, self.lines = io.BytesIO(), []

    def add(self, page_id: int | None, url: str | None, record: bytes) -> None:
        entry = {"offset": self.data.tell(), "length": len(record), "page_id": page_id}
        self.data.write(record)
        self.lines.append(f"{''.join((url or '-').split())} {json.dumps(entry)}")

    def bytes(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(MEMBER, self.data.getvalue())
            z.writestr(INDEX, "\n".join(sorted(self.lines)))
        return out.getvalue()


# ---- Spark jobs ------------------------------------------------------------


def plan_records(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, first``: first is the page of a group's response.

    Only digests that occur twice are joined back, so a table without repeats
    joins nothing; minima are combined before the shuffle.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    large = rows.filter(F.octet_length("html") >= REVISIT_BYTES).select("digest", "page_id")
    firsts = materialize(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "warc")
    return rows.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("first") != F.coalesce("page_id", F.lit(-1)), F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes ``pages(page_id, url, html)``; returns the manifest ``path, records, bytes``."""
    base = folder if "://" in folder else "file://" + folder.removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)

        def flush(p: Package) -> pa.RecordBatch:
            path, body = f"{root}/{uuid.uuid4().hex}.wacz", p.bytes()
            with fs.open_output_stream(path) as f:
                f.write(body)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(p.lines)], "bytes": [len(body)]})

        package = Package()
        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                package.add(page_id, url, build_record(page_id, url, html.encode(), digest, refers))
                if package.data.tell() >= package_bytes:
                    yield flush(package)
                    package = Package()
        if package.lines:
            yield flush(package)

    return materialize(plan_records(pages).mapInArrow(run, "path string, records bigint, bytes bigint"), "manifest")


def read_packages(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row per record of the packages that ``manifest(path)`` lists."""
    base = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    schema = READ_SCHEMA + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(base)
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    members = zip_members(f, f.size())
                    at, size, method = members[INDEX]
                    f.seek(at)
                    index = f.read(size)
                    index = zlib.decompress(index, -15) if method == 8 else index
                    begin, _, method = members[MEMBER]
                    if method != 0:
                        raise ValueError(f"{path}: {MEMBER} is not stored")
                    rows, held = [], 0
                    for line in index.decode().split("\n"):
                        entry = json.loads(line.split(" ", 1)[1])
                        f.seek(begin + entry["offset"])
                        rows.append(parse_record(f.read(entry["length"])))
                        held += rows[-1]["payload_bytes"]
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                    if rows:
                        yield out(rows)

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("path").repartition(n).mapInArrow(run, schema)


def round_trip(pages: DataFrame, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes ``pages`` as packages in the shared folder and reads every record back."""
    folder = scratch_path(pages.sparkSession, "wacz")
    return read_packages(write_packages(pages, folder, package_bytes), folder)
