"""Token ids as files of entropy-coded blocks (static range asymmetric numeral system).

One frequency table, counted over all documents, is shared by every file. A file holds blocks of whole documents in
ascending doc_id order; a block is coded by itself on interleaved lanes, token ``i`` on lane ``i % lanes``, and is cut into
sections of ``EVERY`` steps. A section starts with a checkpoint, all lane states, and has checksums of its bytes and of its
ids, so that it is read, checked and decoded without the others.

File: ``RANSFIL1``, blocks, a trailer. Block: ``HEADER`` (magic, documents, ids, ids before the block in the file, lanes,
steps a section, sections, bytes of metadata, crc32 of metadata and section table), metadata (zlib: int64 doc_ids, one byte
each whether the id is there, int64 lengths), section table (``SECTION``: end, crc32 of the bytes, crc32 of the ids as
little-endian uint32), sections (uint64 states, uint32 words). Trailer: five int64 a block (offset, size, documents,
ids, sections), then ``FOOTER`` (blocks, ids, crc32 of these, magic). Files are numbered in the order of their documents.
Nothing else is needed to read: the first id of a file is the sum of its predecessors' footers.

Reading deals out runs of ``SECTIONS`` sections; a run decodes the documents that start in it, to their ends. So large
blocks are decoded by several tasks, and every document by one, as it is one row.

Defined cases: null text is empty, its document is the end id alone; a null doc_id comes first and stays null; repeated
rows are each written; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blendscope.session import scratch_path

from .files import Output, read_range
from .textvec import token_slices

MAGIC, BLOCK_MAGIC = b"RANSFIL1", b"RBK1"
HEADER = struct.Struct("<4sQQQIIIQI")
SECTION = np.dtype([("end", "<u8"), ("crc", "<u4"), ("ids_crc", "<u4")])
FOOTER = struct.Struct("<QQI8s")

PRECISION = 20  # frequencies of a table sum to 2**PRECISION
LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63) between steps
LANES = 1024
EVERY = 256
BLOCK_TOKENS = 1 << 20
SECTIONS = 2

ENTRY = ("offset", "size", "n_docs", "n_tokens", "sections")  # of a trailer, one per block
FILES = f"file string, n_tokens bigint, blocks array<struct<{','.join(f'{c}:bigint' for c in ENTRY)}>>"
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def normalise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**PRECISION, at least 1 for every id that occurs."""
    total, goal = int(counts.sum()), 1 << PRECISION
    if not total:
        return np.zeros(len(counts), np.uint64)
    freq = np.maximum((counts > 0).astype(np.int64), np.floor(counts * (goal / total)).astype(np.int64))
    excess = int(freq.sum()) - goal
    order = np.argsort(-freq, kind="stable")
    if excess <= 0:
        freq[order[0]] -= excess
    else:  # take what the ones forced to 1 added from the most frequent, in proportion
        room = np.maximum(freq[order] - 1, 0)
        cut = np.minimum(room, -(-room * excess // max(1, int(room.sum()))))
        cut = np.minimum(cut, np.maximum(0, excess - (np.cumsum(cut) - cut)))
        freq[order] -= cut
    return freq.astype(np.uint64)


class Model:
    """A frequency table and what coding needs of it."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.ascontiguousarray(freq, np.uint64)
        self.cum = (np.cumsum(self.freq) - self.freq).astype(np.uint64)

    @property
    def symbol(self) -> np.ndarray:
        if not hasattr(self, "_symbol"):
            kind = np.uint16 if len(self.freq) <= 1 << 16 else np.uint32
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=kind), self.freq.astype(np.int64))
        return self._symbol


def encode(ids: np.ndarray, model: Model, every: int = EVERY) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(lanes, checkpoint word positions, checkpoint states, words) of one block."""
    lanes = min(LANES, 1 << max(0, (len(ids) // 16).bit_length() - 1)) if len(ids) else 1
    steps = -(-len(ids) // lanes)
    freq, cum = model.freq[ids], model.cum[ids]
    limit = freq << np.uint64(63 - PRECISION)
    x = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    half, low, scale = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(PRECISION)
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min((step + 1) * lanes, len(ids))
        y, f = x[:b - a], freq[a:b]
        full = y >= limit[a:b]
        out = y[full]
        words.append((out & low).astype(np.uint32))
        written += len(out)
        y = np.where(full, y >> half, y)
        q = y // f
        x[:b - a] = (q << scale) + (y - q * f) + cum[a:b]
        if step % every == 0:
            marks.append((written, x.copy()))
    marks.reverse()
    return (lanes, np.array([written - w for w, _ in marks], np.uint64),
            np.concatenate([s for _, s in marks]) if marks else np.zeros(0, np.uint64),
            np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32))


def decode(model: Model, n: int, lanes: int, words: np.ndarray, x: np.ndarray, at: int) -> np.ndarray:
    """``n`` ids from the states ``x`` and the word position ``at`` of a checkpoint."""
    out = np.empty(n, np.uint32)
    symbol, freq, cum = model.symbol, model.freq, model.cum
    mask, scale, half = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(32)
    x = x.copy()
    for a in range(0, n, lanes):
        b = min(a + lanes, n)
        y = x[:b - a]
        slot = y & mask
        s = symbol[slot]
        out[a:b] = s
        y = freq[s] * (y >> scale) + slot - cum[s]
        less = np.flatnonzero(y < LOW)
        y[less] = (y[less] << half) | words[at:at + len(less)]
        at += len(less)
        x[:b - a] = y
    return out


def pack_block(doc_ids: list, counts: np.ndarray, ids: np.ndarray, model: Model, before: int = 0, every: int = EVERY) -> bytes:
    lanes, places, states, words = encode(ids, model, every)
    meta = zlib.compress(
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
        + bytes(d is not None for d in doc_ids) + counts.astype("<i8").tobytes())
    ends = [*places[1:].tolist(), len(words)]
    sections = [states[k * lanes:(k + 1) * lanes].astype("<u8").tobytes() + words[int(a):b].astype("<u4").tobytes()
                for k, (a, b) in enumerate(zip(places, ends))]
    table, span = np.zeros(len(sections), SECTION), every * lanes
    table["end"] = np.cumsum([len(x) for x in sections], dtype=np.uint64)
    table["crc"] = [zlib.crc32(x) for x in sections]
    table["ids_crc"] = [zlib.crc32(ids[k * span:(k + 1) * span].astype("<u4").tobytes()) for k in range(len(sections))]
    head = meta + table.tobytes()
    return HEADER.pack(BLOCK_MAGIC, len(doc_ids), len(ids), before, lanes, every, len(sections), len(meta),
                       zlib.crc32(head)) + head + b"".join(sections)


class Block:
    """A block of which ``fetch(offset, size)`` gives bytes; sections are fetched, checked and decoded on demand."""

    def __init__(self, fetch, model: Model):
        self.fetch, self.model = fetch, model
        (magic, n, self.n_tokens, self.before, self.lanes, self.every, sections, n_meta,
         crc) = HEADER.unpack(fetch(0, HEADER.size))
        if magic != BLOCK_MAGIC:
            raise ValueError("damaged block")
        head = fetch(HEADER.size, n_meta + sections * SECTION.itemsize)
        if zlib.crc32(head) != crc:
            raise ValueError("damaged block")
        meta = zlib.decompress(head[:n_meta])
        self.counts = np.frombuffer(meta, "<i8", n, 9 * n)
        self.doc_ids = [d if has else None for d, has in
                        zip(np.frombuffer(meta, "<i8", n).tolist(), meta[8 * n:9 * n])]
        self.table = np.frombuffer(head, SECTION, sections, n_meta)
        self.span = self.every * self.lanes
        self.body = HEADER.size + len(head)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids [first, last) of the block, from the checkpoint before ``first``; whole sections are checked."""
        last = self.n_tokens if last is None else last
        if first >= last:
            return np.zeros(0, np.uint32)
        low, high = first // self.span, -(-last // self.span)
        ends = [0, *self.table["end"].tolist()]
        data = memoryview(self.fetch(self.body + ends[low], ends[high] - ends[low]))
        out = []
        for k in range(low, high):
            part = data[ends[k] - ends[low]:ends[k + 1] - ends[low]]
            if zlib.crc32(part) != self.table["crc"][k]:
                raise ValueError("damaged section")
            states = np.frombuffer(part, "<u8", self.lanes)
            words = np.frombuffer(part, "<u4", offset=8 * self.lanes)
            whole = min(self.span, self.n_tokens - k * self.span)
            n = min(whole, last - k * self.span)
            got = decode(self.model, n, self.lanes, words, states, 0)
            if n == whole and zlib.crc32(got.astype("<u4").tobytes()) != self.table["ids_crc"][k]:
                raise ValueError("damaged ids")
            out.append(got)
        return np.concatenate(out)[first - low * self.span:]


def n_sections(block: bytes) -> int:
    return HEADER.unpack_from(block)[6]


def pack_trailer(rows: list, ids: int) -> bytes:
    entries = np.array(rows, "<i8").tobytes()
    return entries + FOOTER.pack(len(rows), ids, zlib.crc32(entries), MAGIC)


def read_trailer(folder: str, name: str, size: int) -> tuple[int, list]:
    """Number of ids of a file and one row of ``ENTRY`` per block."""
    n, ids, crc, magic = FOOTER.unpack(read_range(folder, name, size - FOOTER.size, FOOTER.size))
    entries = read_range(folder, name, size - FOOTER.size - 8 * len(ENTRY) * n, 8 * len(ENTRY) * n)
    if magic != MAGIC or zlib.crc32(entries) != crc:
        raise ValueError(f"damaged file {name}")
    return ids, np.frombuffer(entries, "<i8").reshape(n, len(ENTRY)).tolist()


@lru_cache(maxsize=2)
def model_of(folder: str, size: int) -> Model:
    """The table of a data set, read once a worker."""
    return Model(np.frombuffer(zlib.decompress(read_range(folder, "model.bin", 0, size)), "<u4"))


def write(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, spaced: bool, end_id: int,
          block_tokens: int = BLOCK_TOKENS, every: int = EVERY) -> DataFrame:
    """Write all documents below ``folder`` and return its blocks, as ``directory`` reads them from the files.

    Texts are encoded once; narrow ids then wait in a written table until the counts over all of them are known.
    The counts, one row per token id, are the only thing that comes to the driver.
    """
    spark = docs.sparkSession
    narrow = "<u2" if vocabulary <= 1 << 16 else "<u4"
    stored = pa.schema([("doc_id", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def tokenise(batches):
        total = np.zeros(vocabulary, np.int64)
        for doc_ids, ids, counts in token_slices(batches, tokenizer, spaced, end_id):
            total += np.bincount(ids, minlength=vocabulary)
            at = np.concatenate(([0], np.cumsum(counts)))
            raw = [ids[a:b].astype(narrow).tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                 pa.array(raw, pa.binary()), pa.nulls(len(raw), pa.binary())], schema=stored)
        yield pa.RecordBatch.from_pylist([{"counts": zlib.compress(total.tobytes(), 1)}], schema=stored)

    path = scratch_path(spark, "tokens")
    (docs.select(F.col("doc_id").cast("bigint"), "text")
     .mapInArrow(tokenise, "doc_id bigint, crc bigint, ids binary, counts binary")
     .write.option("compression", "zstd").parquet(path))
    tokens = spark.read.schema("doc_id bigint, crc bigint, ids binary, counts binary").parquet(path)

    def add(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(raw), np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": seen, "n": total[seen]})

    sums = (tokens.where("counts is not null").select("counts").mapInArrow(add, "token bigint, n bigint")
            .groupBy("token").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(vocabulary, np.int64)
    counts[sums["token"].to_numpy()] = sums["n"].to_numpy()
    table = zlib.compress(normalise(counts).astype("<u4").tobytes())
    with Output(folder, "model.bin") as out:
        out.write(table)
    table_size = len(table)

    def encode_files(batches):
        model, task = model_of(folder, table_size), TaskContext.get().partitionId()
        name, rows = f"part-{task:08d}.rans", []
        held: list[tuple] = []
        state = {"held": 0, "before": 0}

        def close(out):
            ids = np.concatenate([np.frombuffer(r, narrow) for _, r in held]).astype(np.uint32)
            sizes = np.array([len(r) for _, r in held], np.int64) // np.dtype(narrow).itemsize
            block = pack_block([d for d, _ in held], sizes, ids, model, state["before"], every)
            rows.append((out.write(block), len(block), len(held), len(ids), n_sections(block)))
            state["before"] += len(ids)
            held.clear()
            state["held"] = 0

        with Output(folder, name) as out:
            out.write(MAGIC)
            for batch in batches:
                for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    held.append((doc, raw.as_py()))
                    state["held"] += len(held[-1][1]) // np.dtype(narrow).itemsize
                    if state["held"] >= block_tokens:
                        close(out)
            if held:
                close(out)
            out.write(pack_trailer(rows, state["before"]))
        yield pa.RecordBatch.from_pydict({"file": [name]})

    (tokens.where("ids is not null").repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc")
     .select("doc_id", "ids").mapInArrow(encode_files, "file string").write.format("noop").mode("overwrite").save())
    return directory(spark, folder)


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """All blocks of the files in ``folder``, read from their trailers: file, offset, size, n_docs, n_tokens, sections and
    ``file_first``, the number of ids in the files before."""
    def trailers(batches):
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, rows = read_trailer(folder, name, size)
                blocks = [dict(zip(ENTRY, row)) for row in rows]
                yield pa.RecordBatch.from_pylist([{"file": name, "n_tokens": ids, "blocks": blocks}], schema=schema)

    schema = pa.schema([("file", pa.string()), ("n_tokens", pa.int64()),
                        ("blocks", pa.list_(pa.struct([(c, pa.int64()) for c in ENTRY])))])
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*.rans").load(folder)
              .selectExpr("element_at(split(path, '/'), -1) as file", "length"))
    # One row per file, as many as the writing job had tasks; only these are put in order by one task.
    before = "sum(n_tokens) over (order by file rows between unbounded preceding and current row) - n_tokens as file_first"
    return listed.mapInArrow(trailers, FILES).selectExpr("file", "blocks", before).selectExpr("file", "file_first", "inline(blocks)")


def read(blocks: DataFrame, folder: str) -> DataFrame:
    """Documents of the given blocks: doc_id, start (ids of all documents before it), n_tokens, ids as uint32."""
    spark = blocks.sparkSession
    size = len_of(folder, "model.bin")

    def decode_runs(batches):
        model = model_of(folder, size)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(lambda at, n, row=row: read_range(folder, row["file"], row["offset"] + at, n), model)
                at = np.concatenate(([0], np.cumsum(block.counts)))
                low, high = np.searchsorted(at[:-1], [row["run"] * SECTIONS * block.span, (row["run"] + 1) * SECTIONS * block.span])
                if low == high:
                    continue
                ids, at = block.ids(int(at[low]), int(at[high])), at[low:high + 1]
                cuts = at - at[0]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(block.doc_ids[low:high], pa.int64()),
                    "start": pa.array(at[:-1] + row["file_first"] + block.before, pa.int64()),
                    "n_tokens": pa.array(block.counts[low:high], pa.int64()),
                    "ids": pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = blocks.withColumn("run", F.explode(F.expr(f"sequence(0L, (sections - 1) div {SECTIONS})")))
    return (runs.select("file", "offset", "file_first", "run").repartition(parts, "file", "offset", "run")
            .mapInArrow(decode_runs, DOCUMENTS))


def len_of(folder: str, name: str) -> int:
    from .files import locate
    system, path = locate(folder)
    return system.get_file_info(f"{path}/{name}").size
