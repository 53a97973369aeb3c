"""WARC archives with a two-level capture index.

Tasks write archive files in which every record is a gzip member of its own, and one row for each
capture. Captures are sorted over all tasks by reversed-host URL key; each sorted part becomes an index
shard of compressed blocks of ``BLOCK_LINES`` lines, followed by a sparse directory with the first key
of each block. A look-up bisects the shards' first keys, then the directory, reads the one block
it points to, bisects its lines, and reads the record's range of the archive.

Files carry a random name; the settled frames of captures and shards name the ones that count, so a
repeated task leaves nothing but a file nobody reads.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import settled, shared_folder, store_of, text_or_empty
from casemill.session import scratch_path

BLOCK_LINES = 512
TASK_RECORDS, MOST_TASKS = 2048, 10_000
FILE_BYTES = 1 << 30
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, file string, at long, size int, record_type string"
SHARD = "part int, path string, first_key string, first_id long, last_key string, last_id long, at long, size int, blocks int, lines long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
NO_ID = -(1 << 63)  # where a null page_id sorts: before all others


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then path and query; scheme, user, default port and fragment go."""
    plain = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    bare = F.regexp_replace(F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"#.*$", "")
    place = F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^.*@|:(80|443)?$", "")
    host = F.array_join(F.reverse(F.split(F.lower(place), r"\.")), ",")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    return F.concat(host, F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit, which keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in url.encode()).encode("latin-1").decode("utf-8"))
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id_of(urn: str):
    inner = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(member: bytes) -> dict:
    """Headers and payload of one record; the payload of a response is checked against its digest."""
    data = zlib.decompress(member, 31)
    head, block = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = block[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": _id_of(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": kind,
            "refers_to": None if refers is None else _id_of(refers), "payload": payload}


def _write(folder: str, date: str, file_bytes: int):
    def run(batches):
        out, name = None, ""
        for batch in batches:
            rows = {n: [] for n in ("file", "at", "size", "record_type")}
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")]
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                if out is None or out.tell() >= file_bytes:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    store, inner = store_of(f"{folder}/{name}")
                    out = store.open_output_stream(inner, compression=None)
                    info = b"software: casemill\r\nformat: WARC File Format 1.1\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    out.write(_member(head.encode() + info + b"\r\n\r\n"))
                member = record_bytes(page_id, url, payload, refers_to, date)
                rows["file"].append(name)
                rows["at"].append(out.tell())
                rows["size"].append(len(member))
                rows["record_type"].append("response" if refers_to is None else "revisit")
                out.write(member)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("page_id"), *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True))],
                names=["key", "page_id", *rows],
            )
        if out is not None:
            out.close()

    return run


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page (page_id, url, html) and return the settled captures.

    The payload is the html in UTF-8, empty for null. Of equal payloads with ``least_bytes`` or more, the
    record with the largest page_id is the response and the others revisit it. Rows with that page_id are
    all responses; a row without page_id revisits if any equal payload has one. A null url has no
    target. Further columns are not read; an empty table writes nothing.
    """
    folder = shared_folder(pages.sparkSession, folder)
    store, inner = store_of(folder)
    store.create_dir(inner, recursive=True)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(text_or_empty("html"), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # One row for each repeated payload: counts and maxima are combined before they move.
    repeated = rows.filter(F.length("payload") >= least_bytes).groupBy("digest").agg(
        F.max("page_id").alias("first_seen"), F.count("*").alias("many")
    ).filter("many > 1").select(F.col("digest").alias("of_digest"), "first_seen")
    met = rows.join(repeated, F.col("digest") == F.col("of_digest"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_seen")), F.col("first_seen")).alias("refers_to")
    ready = met.select(url_key(F.col("url")).alias("key"), "page_id", "url", "payload", refers)
    return settled(ready.mapInArrow(_write(folder, date, FILE_BYTES), CAPTURE), "captures")


def _place(key, page_id):
    return key, NO_ID if page_id is None else page_id


def _write_shard(folder: str, block_lines: int):
    def run(batches):
        lines, directory, out, path, first, last, total = [], [], None, "", None, None, 0

        def flush():
            nonlocal out, path
            if out is None:
                path = f"{folder}/{uuid.uuid4().hex}.idx"
                store, inner = store_of(path)
                out = store.open_output_stream(inner, compression=None)
            raw = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            directory.append([lines[0][0], lines[0][1], out.tell(), len(raw)])
            out.write(raw)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, last, total = first or row, row, total + 1
                lines.append(row)
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if out is not None:
            raw, at = zlib.compress(json.dumps(directory).encode(), 6), out.tell()
            out.write(raw + struct.pack("<QI", at, len(raw)))
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path],
                 "first_key": [first[0]], "first_id": pa.array([first[1]], pa.int64()),
                 "last_key": [last[0]], "last_id": pa.array([last[1]], pa.int64()),
                 "at": [at], "size": pa.array([len(raw)], pa.int32()), "blocks": pa.array([len(directory)], pa.int32()), "lines": [total]}
            )

    return run


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures by key and page_id over all tasks and write the index; returns the settled shards."""
    folder = shared_folder(captures.sparkSession, folder)
    store, inner = store_of(folder)
    store.create_dir(inner, recursive=True)
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "at")
    return settled(ordered.mapInArrow(_write_shard(folder, block_lines), SHARD), "shards")


class _Shards:
    """The index as a task sees it: shard bounds, the directory of the last shard, the lines of the last block."""

    def __init__(self, shards: list[tuple]):
        self.shards = shards
        self.firsts = [_place(s[1], s[2]) for s in shards]
        self.held = self.block = None

    def directory(self, shard: int):
        if self.held is None or self.held[0] != shard:
            store, inner = store_of(self.shards[shard][0])
            with store.open_input_file(inner) as file:
                at, size = struct.unpack("<QI", file.read_at(12, file.size() - 12))
                entries = json.loads(zlib.decompress(file.read_at(size, at)))
            self.held = shard, entries, [_place(e[0], e[1]) for e in entries]
        return self.held[1:]

    def lines(self, shard: int, block: int):
        if self.block is None or self.block[:2] != (shard, block):
            _, _, at, size = self.directory(shard)[0][block]
            store, inner = store_of(self.shards[shard][0])
            with store.open_input_file(inner) as file:
                rows = [json.loads(x) for x in zlib.decompress(file.read_at(size, at)).decode().split("\n")]
            self.block = shard, block, rows, [_place(r[0], r[1]) for r in rows]
        return self.block[2:]

    def find(self, key, page_id):
        """All lines of a key and page_id; they may run on over blocks and shards."""
        wanted = _place(key, page_id)
        # The block before the first that starts at or beyond the wanted place may hold it too.
        shard = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while shard < len(self.shards) and self.firsts[shard] <= wanted:
            starts = self.directory(shard)[1]
            block = max(0, bisect.bisect_left(starts, wanted) - 1)
            while block < len(starts) and starts[block] <= wanted:
                rows, places = self.lines(shard, block)
                at = bisect.bisect_left(places, wanted)
                while at < len(rows) and places[at] == wanted:
                    yield rows[at]
                    at += 1
                block += 1
            shard += 1


def _look_up(shards: list[tuple]):
    def run(batches):
        index = _Shards(shards)
        for batch in batches:
            found = [r for k, i in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist(), strict=True) for r in index.find(k, i)]
            columns = list(zip(*found, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split(" ")[0] for f in CAPTURE.split(", ")]
            )

    return run


def tasks_for(shards: DataFrame) -> int:
    """Tasks for reading all that is indexed: the rows that lead to records are small, the reading is not."""
    lines = shards.agg(F.sum("lines")).first()[0] or 0
    return max(1, min(MOST_TASKS, lines // TASK_RECORDS))


def look_up(requests: DataFrame, shards: DataFrame, tasks: int) -> DataFrame:
    """Captures of requested (key, page_id) pairs, each asked once. Neighbouring requests share a block."""
    # A row for each index shard, which is one task of the sorted write.
    bounds = [tuple(r) for r in shards.orderBy("part").select("path", "first_key", "first_id").collect()]
    asked = requests.select("key", "page_id").distinct()
    ordered = asked.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(_look_up(bounds), CAPTURE)


def _read(folder: str, with_payload: bool):
    fields = [f.split(" ")[0] for f in RECORD.split(", ")]
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    schema = schema.append(pa.field("payload", pa.binary())) if with_payload else schema

    def run(batches):
        file = name = None
        for batch in batches:
            found = []
            for path, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size")), strict=True):
                if path != name:
                    if file is not None:
                        file.close()
                    store, inner = store_of(f"{folder}/{path}")
                    file, name = store.open_input_file(inner), path
                record = parse_record(file.read_at(size, at))
                found.append({k: record[k] for k in (*fields, "payload")[: len(schema)]})
            yield pa.RecordBatch.from_pylist(found, schema=schema)
        if file is not None:
            file.close()

    return run


def read_records(captures: DataFrame, folder: str, tasks: int, with_payload: bool = False) -> DataFrame:
    """Read the records that captures point to, in the order of the files; a damaged response raises."""
    ordered = captures.repartitionByRange(tasks, "file", "at").sortWithinPartitions("file", "at").select("file", "at", "size")
    folder = shared_folder(captures.sparkSession, folder)
    return ordered.mapInArrow(_read(folder, with_payload), RECORD + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame, least_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write archives and index to the shared scratch folder, look every page up and read its record."""
    folder = scratch_path(pages.sparkSession, "warc")
    shards = write_index(write_archive(pages, folder, least_bytes), f"{folder}/index")
    asked = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"))
    tasks = tasks_for(shards)
    return read_records(settled(look_up(asked, shards, tasks), "found"), folder, tasks, with_payload)
