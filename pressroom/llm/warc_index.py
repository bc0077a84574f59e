"""WARC archives with a two-level capture index.

Writing: records are gzip members of WARC files, one file per task. Of records with equal payloads of at
least ``least`` bytes, the one of smallest page id is the response, the others are revisits without payload.
The captures are sorted by reversed-host key and page id into index files: compressed blocks of ``BLOCK``
captures, then a sparse directory with the first key of each block. A list of the index files with their
first keys, one row each, is all the driver sees.

Reading: keys are sorted and dealt by range; a task searches the list of files, then the directory of a
file, by bisection and names the blocks that can hold its keys. Blocks are dealt out, decompressed and
bisected; the captures found are dealt by archive range and read by range reads. A key of many captures is
many blocks, so no key is one task's load.

Null html is an empty payload, a null url the empty key; repeated rows are a record each, all of them
response where they share the smallest id; a null page id never is the smallest; an empty table gives
neither files nor rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.session import cut_lineage

from . import files

BLOCK = 1000
KEYS = 1000  # asked keys a row names at most
RANGE = 16 << 20  # bytes of an archive that are read in a row
MAGIC = b"CAPIDX01"
CAPTURE = "key string, page_id long, file string, offset long, length long"
RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "url string, payload binary")


def url_key(url: Column) -> Column:
    """``http://www.site.example/a?b`` as ``example,site,www)/a?b``; the scheme and any user are dropped."""
    url = F.coalesce(url, F.lit(""))
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)(?s:(.*))$"
    host = F.lower(F.regexp_extract(url, parts, 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(url, parts, 2))
    return F.when(url.rlike(parts), key).otherwise(F.concat(F.lit(")"), url))


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m.group()):02X}", text)


def _record(page_id, url, kind, digest, refers_to, payload: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
             f"WARC-Target-URI: {_header_value(url or '')}", f"WARC-Payload-Digest: sha256:{digest}",
             f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
        body = b""
    else:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def _parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[:int(fields["Content-Length"])]
    number = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    payload = None
    if fields["WARC-Type"] == "response":
        payload = body.partition(b"\r\n\r\n")[2]
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"]):
            raise ValueError("a payload does not match its digest")
    url = re.sub("%([0-9A-F]{2})", lambda m: chr(int(m.group(1), 16)), fields["WARC-Target-URI"])
    return {"page_id": number("WARC-Record-ID"), "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "url": url, "payload": payload}


def write_archives(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Write all records; one row per capture (``CAPTURE``), kept in the shared folder."""
    spark = pages.sparkSession
    folder = files.new_folder(spark, "archives")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        html.alias("html"), F.sha2(html, 256).alias("digest"))
    copied = (rows.where(F.octet_length("html") >= least).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    rows = rows.join(copied, "digest", "left").select(
        url_key(F.col("url")).alias("key"), "page_id", "url", "html", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, stream, at = "", None, 0
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, page_id, url, text, digest, refers_to in zip(*(c for c in batch.columns), strict=True):
                if stream is None:
                    uri, stream = files.create(folder, ".warc.gz")
                page_id, refers_to = page_id.as_py(), refers_to.as_py()
                kind = "response" if refers_to is None else "revisit"
                record = _record(page_id, url.as_py(), kind, digest.as_py(), refers_to, text.as_buffer().to_pybytes())
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                raw = packer.compress(record) + packer.flush()
                stream.write(raw)
                for column, value in zip(out, (key.as_py(), page_id, uri, at, len(raw)), strict=True):
                    column.append(value)
                at += len(raw)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)],
                                             names=["key", "page_id", "file", "offset", "length"])
        if stream is not None:
            stream.close()

    return cut_lineage(rows.mapInArrow(run, CAPTURE))


def write_index(captures: DataFrame) -> list[tuple[str, str]]:
    """Sort captures into index files; (first key, file) of each, in order."""
    folder = files.new_folder(captures.sparkSession, "capture-index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, stream, at, directory, held = "", None, 0, [], []

        def block(rows: list[dict]) -> None:
            nonlocal at
            raw = zlib.compress(json.dumps([list(r.values()) for r in rows]).encode())
            stream.write(raw)
            directory.append((rows[0]["key"], at, len(raw)))
            at += len(raw)

        for batch in batches:
            if batch.num_rows and stream is None:
                uri, stream = files.create(folder, ".cdxb")
            held += batch.to_pylist()
            while len(held) >= BLOCK:
                block(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            block(held)
        if stream is not None:
            raw = zlib.compress(json.dumps(directory).encode())
            stream.write(raw + len(raw).to_bytes(8, "little") + MAGIC)
            stream.close()
            yield pa.RecordBatch.from_pydict({"first_key": [directory[0][0]], "file": [uri]})

    made = (captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
            .mapInArrow(run, "first_key string, file string"))
    return sorted((r.first_key, r.file) for r in made.collect())


class Directory:
    """The sparse block directory of an index file."""

    def __init__(self, uri: str):
        with files.read_at(uri) as f:
            size = f.size()
            f.seek(size - 16)
            tail = f.read(16)
            if tail[8:] != MAGIC:
                raise ValueError(f"{uri} is not a capture index")
            length = int.from_bytes(tail[:8], "little")
            f.seek(size - 16 - length)
            self.blocks = json.loads(zlib.decompress(f.read(length)))
        self.keys = [b[0] for b in self.blocks]


def _candidates(keys: list[str], key: str) -> range:
    """Which of the parts that begin with the given sorted keys can hold a key."""
    return range(max(0, bisect.bisect_left(keys, key) - 1), bisect.bisect_right(keys, key))


def look_up(keys: DataFrame, index: list[tuple[str, str]]) -> DataFrame:
    """Captures (``CAPTURE``) of the distinct keys in column ``key``."""
    names = [k for k, _ in index]
    asked = keys.select("key").where("key is not null").distinct().repartitionByRange("key").sortWithinPartitions("key")

    def find_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file, directory, last, held = None, None, None, []
        out: dict[str, list] = {"file": [], "offset": [], "length": [], "keys": []}

        def done() -> None:
            if held:
                for name, value in zip(out, (*last, list(held)), strict=True):
                    out[name].append(value)
                held.clear()

        for batch in batches:
            for key in batch.column(0).to_pylist():
                for i in _candidates(names, key):
                    if open_file != index[i][1]:
                        open_file, directory = index[i][1], Directory(index[i][1])
                    for b in _candidates(directory.keys, key):
                        place = (open_file, *directory.blocks[b][1:])
                        if place != last or len(held) == KEYS:
                            done()
                        last = place
                        held.append(key)
            yield pa.RecordBatch.from_pydict({
                "file": pa.array(out["file"], pa.string()), "offset": pa.array(out["offset"], pa.int64()),
                "length": pa.array(out["length"], pa.int64()), "keys": pa.array(out["keys"], pa.list_(pa.string()))})
            out = {name: [] for name in out}
        done()
        yield pa.RecordBatch.from_pydict({
            "file": pa.array(out["file"], pa.string()), "offset": pa.array(out["offset"], pa.int64()),
            "length": pa.array(out["length"], pa.int64()), "keys": pa.array(out["keys"], pa.list_(pa.string()))})

    def search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with files.read_at(row["file"]) as f:
                    f.seek(row["offset"])
                    entries = json.loads(zlib.decompress(f.read(row["length"])))
                firsts = [e[0] for e in entries]
                hits = [entries[i] for key in row["keys"]
                        for i in range(bisect.bisect_left(firsts, key), bisect.bisect_right(firsts, key))]
                columns = list(zip(*hits, strict=True)) if hits else [[]] * 5
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                                 names=["key", "page_id", "file", "offset", "length"])

    blocks = asked.mapInArrow(find_blocks, "file string, offset long, length long, keys array<string>")
    return blocks.repartition("file", "offset").mapInArrow(search_blocks, CAPTURE)


def read_records(captures: DataFrame, payload: bool = True) -> DataFrame:
    """The records (``RECORD``) of some captures; payloads are checked against their digests either way."""
    near = (captures.withColumn("part", F.floor(F.col("offset") / RANGE)).repartition("file", "part")
            .sortWithinPartitions("file", "offset").select("file", "offset", "length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
                            ("payload", pa.binary())])
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                rows = []
                for file, offset, length in zip(*(c.to_pylist() for c in batch.slice(lo, 1000).columns), strict=True):
                    if file != name:
                        if f:
                            f.close()
                        name, f = file, files.read_at(file)
                    f.seek(offset)
                    rows.append(_parse(zlib.decompress(f.read(length), 31)))
                    if not payload:
                        rows[-1]["payload"] = None
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if f:
            f.close()

    return near.mapInArrow(run, RECORD)


def archive_and_read(pages: DataFrame, **columns: str) -> DataFrame:
    """Write all pages, index them, and read the captures of all their urls back through the index."""
    captures = write_archives(pages, **columns)
    index = write_index(captures)
    keys = pages.select(url_key(F.col(columns.get("url_col", "url")).cast("string")).alias("key"))
    return read_records(look_up(keys, index), payload=False)

