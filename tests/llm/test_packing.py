"""Packing: an exact partition of every document's ids into gapless sequences without padding."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
from blendscope.llm.packing import Packer, pack
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, docs):
    tokenizer = Tokenizer.from_file(PATH)
    want = collections.Counter(
        (d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in docs)
    sequences = collections.defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        parts.sort()
        total = 0
        for offset, length in parts:
            assert offset == total
            total += length
        assert total == 2048 or (total < 2048 and total & (total - 1) == 0)
    assert sum(p.length for p in pieces) == sum(len(raw) // 4 * n for (_, raw), n in want.items())
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    unique = {d: raw for (d, raw), n in want.items() if n == 1 and sum(1 for k in want if k[0] == d) == 1}
    for doc, raw in unique.items():
        parts = sorted(by_doc[doc], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in parts) == raw
        assert all(p.doc_tokens == len(raw) // 4 for p in parts)


def test_hard_rows(hard_docs):
    pieces = pack(hard_docs.repartition(3), PATH).collect()
    check(pieces, [(r.doc_id, r.text) for r in hard_docs.collect()])


def test_many_partitions_merge(spark, frame):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["a", "bb", "ccc"]) for _ in range(rng.randint(0, 3000)))) for i in range(200)]
    pieces = pack(frame(docs, "doc_id bigint, text string").repartition(70), PATH).collect()
    check(pieces, docs)
    short = [s for s, n in collections.Counter((p.sequence_id, 0) for p in pieces).items() if s[0] >= 1 << 62]
    assert short  # what partitions left over was merged


def test_empty_table(frame):
    assert pack(frame([], "doc_id bigint, text string"), PATH).count() == 0


def test_best_fit_takes_the_tightest_window():
    packer = Packer(10, 2, 0)
    packer.open = [[6, [("a", 0, 4, 4, b"x" * 16)]], [3, [("b", 0, 7, 7, b"y" * 28)]]]
    packer.add(("c", 0, 3, 3, b"z" * 12))
    assert [row[0] for row in packer.done] == ["b", "c"] and packer.done[1][5] == 7
    assert len(packer.open) == 1


def test_fullest_window_is_filled_when_none_fits():
    packer = Packer(10, 2, 0)
    packer.open = [[2, [("a", 0, 8, 8, b"x" * 32)]], [3, [("b", 0, 7, 7, b"y" * 28)]]]
    packer.add(("c", 0, 5, 5, b"z" * 20))
    assert [(row[0], row[2]) for row in packer.done] == [("a", 8), ("c", 2), ("b", 7), ("c", 3)]
    assert not packer.open


def test_crc_is_that_of_little_endian_ids(frame):
    row = pack(frame([(1, "hello")], "doc_id bigint, text string"), PATH).selectExpr("crc32(ids) as c", "ids").collect()
    assert sum(len(r.ids) for r in row) == 4 * 2
    assert all(r.c == zlib.crc32(bytes(r.ids)) for r in row)
