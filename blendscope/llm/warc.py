"""Web archives with a two-level capture index.

Captures are sorted by URL key, the host's labels reversed, then path and query (``org,example,www)/a?b``), and page_id. Each
task writes a range of keys: ``part-N.warc.gz``, one gzip member per record, and ``part-N.cdx``, the sorted capture lines
(key, page_id, offset, size) in compressed blocks, then a sparse directory with the first key of every block, and
its place in the last 16 bytes. Nothing else is stored.

A lookup binary-searches the files' first keys, reads a file's directory, binary-searches it, reads one block,
binary-searches its lines and reads the records found. ``read`` looks up a table of keys that way: sorted keys first find their blocks in the
directories, a key of many captures in many of them; then each block is read once, its lines searched for its keys, and one range of the
archive holds the records found.

Of the captures with equal payloads, that with the largest page_id is stored as response, the others as revisits of
it: their record keeps the HTTP header, with the payload's length, and the payload's digest.

Defined cases: null html is an empty payload; null url has the empty key and no target URI; a null page_id revisits the
others and, alone, is a response; rows equal in page_id and payload are stored alike, each with its record; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blendscope.session import local_table

from .files import Output, locate, read_range

LINES = 1000  # capture lines of a block at most
BLOCK_BYTES = 8 << 20  # of records that the lines of a block point to, from which it is closed
LEVEL = 3
TAIL = struct.Struct("<QQ")
WRITTEN = "file int, blocks bigint"
PLACES = "file int, offset bigint, size bigint, key string"
CAPTURES = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def url_key(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.coalesce(F.regexp_replace(key, r"[\x00-\x20]", "_"), F.lit(""))


def gzipped(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def gunzipped(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def page_number(urn: str):
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "None" else int(number)


def parse(data: bytes) -> dict:
    """A record's fields and payload; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": page_number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
            "payload_digest": digest, "record_type": kind, "refers_to": refers and page_number(refers), "payload": payload}


class Writer:
    """One file of records and its index, fed in key order."""

    def __init__(self, folder: str, number: int, date: str):
        self.records = Output(folder, f"part-{number:05d}.warc.gz")
        self.index = Output(folder, f"part-{number:05d}.cdx")
        self.number, self.date = number, date
        self.lines: list[str] = []
        self.bytes, self.first = 0, ""
        self.blocks: list[tuple] = []

    def add(self, key: str, page_id, url, payload: bytes, refers_to) -> None:
        data = gzipped(record(page_id, url, payload, refers_to, self.date))
        at = self.records.write(data)
        self.first = self.first if self.lines else key
        self.lines.append(f"{key} {page_id} {at} {len(data)}")
        self.bytes += len(data)
        if len(self.lines) >= LINES or self.bytes >= BLOCK_BYTES:
            self.close_block()

    def close_block(self) -> None:
        if self.lines:
            data = gzipped("\n".join(self.lines).encode("utf-8", "surrogatepass"))
            self.blocks.append((self.first, self.index.write(data), len(data)))
            self.lines, self.bytes = [], 0

    def close(self) -> pa.RecordBatch:
        self.close_block()
        directory = gzipped(json.dumps(self.blocks).encode())
        self.index.write(directory + TAIL.pack(self.index.size, len(directory)))
        return pa.RecordBatch.from_pydict({"file": pa.array([self.number], pa.int32()), "blocks": [len(self.blocks)]})


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write all pages below ``folder``.

    Payloads are shuffled once. Which captures are revisits is found on digests alone; those marks travel with the
    captures to the same range of keys, where each comes just before its capture.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    rows = pages.select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("bigint").alias("page_id"), "url",
                        payload.alias("payload"))
    digests = rows.select("key", "page_id", F.sha1("payload").alias("digest"))
    firsts = digests.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    marks = (digests.join(firsts, "digest").where("not page_id <=> top")
             .select("key", "page_id", F.lit(0).alias("is_page"), "digest", "top"))
    both = rows.withColumn("is_page", F.lit(1)).unionByName(marks, allowMissingColumns=True)

    def run(batches):
        writer = Writer(folder, TaskContext.get().partitionId(), date)
        with writer.records, writer.index:
            place, marked = None, {}
            for batch in batches:
                for i in range(batch.num_rows):
                    key, page_id, url, page, is_page, digest, top = (c[i] for c in batch.columns)
                    here = (key.as_py(), page_id.as_py())
                    if here != place:
                        place, marked = here, {}
                    if not is_page.as_py():
                        marked[digest.as_py()] = top.as_py()
                        continue
                    page = page.as_py()
                    refers = marked.get(hashlib.sha1(page).hexdigest()) if marked else None
                    writer.add(*here, url.as_py(), page, refers)
            found = writer.close()
        yield found

    (both.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "is_page")
     .select("key", "page_id", "url", "payload", "is_page", "digest", "top")
     .mapInArrow(run, WRITTEN).write.format("noop").mode("overwrite").save())


def directory_of(folder: str, file: int) -> list[list]:
    """[first key, offset, size] of each block of an index file."""
    name = f"part-{file:05d}.cdx"
    system, path = locate(folder)
    size = system.get_file_info(f"{path}/{name}").size
    place = TAIL.unpack(read_range(folder, name, size - TAIL.size, TAIL.size))
    return json.loads(gunzipped(read_range(folder, name, *place)))


def first_keys(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(file, first key) of the index files that hold a line, in key order; one row per file."""
    system, path = locate(folder)
    listed = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    files = sorted(int(f.base_name[5:-4]) for f in listed if f.base_name.startswith("part-") and f.base_name.endswith(".cdx"))

    def run(batches):
        for batch in batches:
            found = [(f, directory_of(folder, f)) for f in batch.column(0).to_pylist()]
            found = [(f, d[0][0]) for f, d in found if d]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.int32()), pa.array([k for _, k in found], pa.string())], names=["file", "first"])

    rows = local_table(spark, [(f,) for f in files], "file int").repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism)), "file")
    return sorted(tuple(r) for r in rows.mapInArrow(run, "file int, first string").collect()) if files else []


def span(firsts: list[str], key: str) -> range:
    """The parts that may hold a key, given the first key of each: it may begin in the part before the first one that reaches it."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def block_lines(folder: str, file: int, offset: int, size: int) -> list[list[str]]:
    data = gunzipped(read_range(folder, f"part-{file:05d}.cdx", offset, size))
    return [line.rsplit(" ", 3) for line in data.decode("utf-8", "surrogatepass").split("\n")]


def captures(folder: str, file: int, lines: list[list[str]], keys: list[str]) -> list[dict]:
    """The records of the given keys among the sorted lines of a block, by one range read of the archive."""
    names = [line[0] for line in lines]
    found = [(int(line[2]), int(line[3])) for key in keys for line in lines[bisect_left(names, key):bisect_right(names, key)]]
    if not found:
        return []
    first, end = found[0][0], sum(found[-1])
    data = read_range(folder, f"part-{file:05d}.warc.gz", first, end - first)
    return [parse(gunzipped(data[at - first:at - first + size])) for at, size in found]


def read(keys: DataFrame, folder: str) -> DataFrame:
    """One row per record of the URL keys in the column ``key``, found through the index; a repeated key counts once."""
    spark = keys.sparkSession
    files = first_keys(spark, folder)
    numbers, firsts = [f for f, _ in files], [k for _, k in files]

    def locate_blocks(batches):
        file, directory = None, []
        for batch in batches:
            out: list[tuple] = []
            for key in batch.column(0).to_pylist():
                for i in span(firsts, key):
                    if numbers[i] != file:  # keys come sorted, so each directory is read once
                        file, directory = numbers[i], directory_of(folder, numbers[i])
                        begins = [d[0] for d in directory]
                    out += [(file, directory[k][1], directory[k][2], key) for k in span(begins, key)]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["file", "offset", "size", "key"])

    names = [c.split()[0] for c in CAPTURES.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def fetch(batches):
        def one(place: tuple, wanted: list[str]):
            found = captures(folder, place[0], block_lines(folder, *place), wanted)
            return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], k) for c, k in zip(names, kinds)], names=names)

        place, wanted = None, []
        for batch in batches:
            for *here, key in zip(*(c.to_pylist() for c in batch.columns)):
                if tuple(here) != place:
                    if wanted:
                        yield one(place, wanted)
                    place, wanted = tuple(here), []
                wanted.append(key)
        if wanted:
            yield one(place, wanted)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = keys.select("key").where("key is not null").distinct().repartitionByRange(parts, "key").sortWithinPartitions("key")
    places = sorted_keys.mapInArrow(locate_blocks, PLACES)
    return places.repartition(parts, "file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(fetch, CAPTURES)


class Lookup:
    """Captures of single keys, by range reads from where this is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.files = folder, first_keys(spark, folder)

    def find(self, key: str) -> list[dict]:
        out = []
        for i in span([k for _, k in self.files], key):
            file = self.files[i][0]
            directory = directory_of(self.folder, file)
            for k in span([d[0] for d in directory], key):
                out += captures(self.folder, file, block_lines(self.folder, file, *directory[k][1:]), [key])
        return out
