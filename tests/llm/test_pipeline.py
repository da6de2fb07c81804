"""Each stage on what its predecessor kept, against a plain version."""

import collections
from pathlib import Path

import corpus_pipeline
import pytest
from clausegraph.llm import simhash
from clausegraph.llm.pieces import Encoder
from clausegraph.llm.quality import quality_scores

from .test_operators import alike_of, hits, lower, plain, tokenizer

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_stages_equal_plain_versions(spark, tmp_path):
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=str(tokenizer()))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    scores = {r.doc_id: r.accepted for r in quality_scores(docs).collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(SF)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        rows = {r.doc_id: r.text for r in before.collect()}
        kept[name] = {r.doc_id for r in docs.collect()}
        assert name == "tokens" or docs.columns == columns
        if name == "quality":
            want = {i for i, ok in scores.items() if ok}
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert sum((labels[i] == 1) == (i in want) for i in labels) >= 0.97 * len(labels)
        elif name == "exact dedup":
            last = collections.defaultdict(list)
            for i, t in rows.items():
                last[lower(t)].append(i)
            want = {max(ids) for ids in last.values()}
        elif name == "near-dedup":
            ids = sorted(rows)
            of = alike_of([rows[i] for i in ids])
            want = {ids[g] for g in of}
        elif name == "decontamination":
            items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = {i for i, t in rows.items() if not hits((t or "").encode(), items, 10)[1]}
        else:
            want = set(rows)
            got = {r.doc_id: r for r in docs.collect()}
            assert all(list(got[i].ids) == lib.encode(t or "") and got[i].n_tokens == len(got[i].ids) for i, t in rows.items())
        assert kept[name] == want, name
    assert kept["tokens"] == {r.doc_id for r in corpus_pipeline.run(spark, str(SF)).collect()}


def test_tokens_carry_source_spans(spark, docs):
    pytest.importorskip("sentencepiece")
    coder = Encoder(Path(tokenizer()).read_bytes())
    got = corpus_pipeline.tokens(spark, docs, str(SF)).collect()
    texts = collections.defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add((r.text or "").encode())
    for r in got:
        assert len(r.starts) == r.n_tokens + 1 == len(r.ids) + 1
        assert any(r.starts == coder.encode(t)[1].tolist() and r.starts[-1] == len(t) for t in texts[r.doc_id] if coder.lib.encode(t.decode()) == list(r.ids))


def test_hot_buckets_are_dealt_out(docs, rows, monkeypatch):
    want = plain(simhash.near_groups(docs), "doc_id", "fingerprint", "component_id")
    monkeypatch.setattr(simhash, "HOT", 20_000)
    monkeypatch.setattr(simhash, "VARIANTS", 500)
    assert plain(simhash.near_groups(docs), "doc_id", "fingerprint", "component_id") == want
