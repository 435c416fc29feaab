"""The pipeline: stages keep the columns, their decisions take effect, the result equals a plain version of each stage."""

import collections
import os

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from blendscope.llm import mixing, pii, quality
from blendscope.session import materialize
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .test_neardup import brute_force

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_columns(stages):
    for docs in stages[1:-1]:
        assert docs.dtypes == stages[0].dtypes


def test_quality_stage(spark, stages):
    judged = quality.judge(stages[0], quality.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(r.doc_id for r in judged if r.kept)


def test_one_document_of_each_group_stays(stages):
    label, _ = brute_force([(r.doc_id, r.text) for r in stages[1].collect()])
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(d for d, low in label.items() if d == low)


def test_no_base_span_is_left(stages):
    assert not [r for r in pii.find(stages[3]).collect() if any(s.kind in pii.BASE_KINDS for s in r.spans)]
    assert sum(a.text != b.text for a, b in zip(stages[2].orderBy("doc_id").collect(), stages[3].orderBy("doc_id").collect())) > 0


def test_mixture_keeps_documents(stages):
    assert sorted(stages[4].collect()) == sorted(stages[3].collect())


def test_sequences_hold_every_token_once(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    parts = collections.defaultdict(list)
    for p in stages[5].collect():
        parts[p.doc_id].append((p.start, bytes(p.ids)))
    for r in stages[4].collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(raw for _, raw in sorted(parts.pop(r.doc_id))) == ids
    assert not parts


def test_run_equals_its_stages(spark, stages):
    def total(df):
        return sorted((r.doc_id, r.n) for r in df.groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect())
    assert total(corpus_pipeline.run(spark, SF)) == total(stages[5])


def test_packing_follows_the_mixture_whatever_files_it_reads(spark, frame):
    rows = [(i, "w " * (20_000 + i), "abc"[i % 7 % 3]) for i in range(60)]
    mixed = mixing.mixed(frame(rows, "doc_id bigint, text string, source string"))
    rank = {r.doc_id: i for i, r in enumerate(mixed.select("doc_id").collect())}
    shuffled = materialize(mixed.repartitionByRange(6, F.xxhash64("doc_id")), "shuffled")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = corpus_pipeline.pack(spark, shuffled, SF).where(f"sequence_id < {1 << 62}").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    tasks = collections.defaultdict(set)
    for p in pieces:
        tasks[rank[p.doc_id]].add(p.sequence_id >> 33)
    assert all(len(t) == 1 for t in tasks.values()) and len(set.union(*tasks.values())) > 2
    in_order = [min(tasks[r]) for r in sorted(tasks)]
    assert in_order == sorted(in_order)
