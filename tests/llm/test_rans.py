"""Token files: exact round trips, random access from checkpoints, damage is noticed."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from blendscope.llm import rans
from blendscope.session import scratch_path
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.integers(0, 3))
def test_round_trip(ids, power):
    ids = np.array(ids * 10 ** power, np.uint32)[:200_000]
    model = rans.Model(rans.normalise(np.bincount(ids, minlength=301)))
    lanes, places, states, words = rans.encode(ids, model)
    if len(ids):
        assert (rans.decode(model, len(ids), lanes, words, states[:lanes], int(places[0])) == ids).all()


@pytest.mark.parametrize("counts", [[5], [1, 10 ** 12], [0, 3, 0, 7], list(range(50_000)), [1] * 49_000 + [0] * 400])
def test_frequencies_sum_up_and_spare_every_id(counts):
    counts = np.array(counts)
    freq = rans.normalise(counts).astype(np.int64)
    assert freq.sum() == 1 << rans.PRECISION
    assert ((freq > 0) == (counts > 0)).all()


def block(n=700_000):
    ids = (np.random.default_rng(2).zipf(1.3, n) % 5000).astype(np.uint32)
    model = rans.Model(rans.normalise(np.bincount(ids, minlength=5000)))
    return ids, model, rans.pack_block([1, None, 3], np.array([n - 10, 4, 6]), ids, model)


def opened(data, model):
    return rans.Block(lambda at, n: data[at:at + n], model)


def test_reading_from_a_checkpoint():
    ids, model, data = block()
    b = opened(data, model)
    assert b.doc_ids == [1, None, 3] and len(b.table) == 3
    for first, last in ((0, 700_000), (5, 9), (262_144, 262_150), (262_143, 524_289), (600_001, 700_000), (7, 7)):
        assert (b.ids(first, last) == ids[first:last]).all()


def test_a_section_is_read_alone():
    ids, model, data = block()
    read = []

    def fetch(at, n):
        read.append((at, n))
        return data[at:at + n]

    b = rans.Block(fetch, model)
    read.clear()
    assert (b.ids(300_000, 300_010) == ids[300_000:300_010]).all()
    assert len(read) == 1 and read[0][1] < len(data) // 2


def test_damage_is_noticed():
    _, model, data = block(5000)
    with pytest.raises(ValueError):
        opened(data[:-1] + bytes([data[-1] ^ 1]), model).ids()
    with pytest.raises(ValueError):
        opened(data[:70] + bytes([data[70] ^ 1]) + data[71:], model)


def files(spark, docs):
    folder = scratch_path(spark, "rans")
    blocks = rans.write(docs, folder, PATH, 49_408, False, 2)
    return blocks, rans.read(blocks, folder).collect()


def test_hard_rows(spark, hard_docs):
    _, got = files(spark, hard_docs)
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(((r.doc_id is not None, r.doc_id or 0, zlib.crc32(raw), raw) for r in hard_docs.collect()
                   for raw in [np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()]),
                  key=lambda x: x[:2])
    got.sort(key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    assert sorted(bytes(r.ids) for r in got) == sorted(w[3] for w in want)
    at = 0
    for r in got:
        assert r.start == at and 4 * r.n_tokens == len(r.ids)
        at += r.n_tokens


def test_blocks_are_decoded_in_runs_and_the_files_tell_all(spark, frame):
    rows = [(i, "word " * (i * 37 % 400) + f"end {i}") for i in range(300)] + [(77_000, "long text " * 30_000)]
    docs = frame(rows, "doc_id bigint, text string").repartition(5)
    folder = scratch_path(spark, "rans")
    rans.write(docs, folder, PATH, 49_408, False, 2, block_tokens=20_000, every=1)
    blocks = rans.directory(spark, folder)  # from the files alone
    listed = blocks.collect()
    assert max(b.sections for b in listed) > 3 * rans.SECTIONS
    assert {name.split(".")[-1] for name in os.listdir(folder) if not name.startswith(".")} <= {"rans", "bin"}
    got = sorted(rans.read(blocks, folder).collect(), key=lambda r: r.start)
    tokenizer, at = Tokenizer.from_file(PATH), 0
    assert [r.doc_id for r in got] == [d for d, _ in rows]
    for r, (_, text) in zip(got, rows):
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens) == (at, len(want)) and np.frombuffer(r.ids, "<u4").tolist() == want
        at += len(want)


def test_empty_table(spark, frame):
    assert files(spark, frame([], "doc_id bigint, text string"))[1] == []
