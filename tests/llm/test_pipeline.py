import re

import public_tokenizers
import pytest
from test_decontaminate import grams
from test_near_dedup import brute as groups
from test_pii import brute as spans

import corpus_pipeline
from lexiloom.llm import pieces, pii, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [(docs.columns, docs.collect())]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        out.append((docs.columns, docs.collect()))
    return out


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "pieces"]


def test_each_stage_against_brute_force(spark, stages):
    (columns, raw), (c1, good), (c2, single), (c3, clean), (c4, redacted), (_, last) = stages
    assert columns == c1 == c2 == c3 == c4
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in good} == {r.doc_id for r in raw if model.score(quality.features(r.text)[None])[0] >= 0.3}
    assert {r.doc_id for r in single} == {i for i, _, _, kept in groups([(r.doc_id, r.text) for r in good], 5) if kept}
    items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean} == {r.doc_id for r in single if not any(len(g & grams(r.text)) >= 0.8 * len(g) for g in items)}
    before = {r.doc_id: r.text for r in clean}
    assert len(redacted) == len(before) < len(raw)
    for r in redacted:
        found, text, at = spans(before[r.doc_id]), "", 0
        for s, _, kind, e in found:
            if s >= at:
                text, at = text + before[r.doc_id][at:s] + f"<{kind.upper()}>", e
        if not re.search("<(IBAN|SSN)>", r.text):
            assert r.text == text + before[r.doc_id][at:] and r.n_chars == len(r.text)
    codec = pieces.Codec(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    assert all(r.lossless and r.pieces == codec.encode(r.text).tolist() and codec.decode(r.pieces) == r.text and r.n_pieces == len(r.pieces) for r in last)


def test_run_gives_the_same_rows(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[-1][0]
    key = lambda r: r.doc_id
    assert sorted(got.collect(), key=key) == sorted(stages[-1][1], key=key)
    assert pii.BASE_KINDS == ["email", "ip", "card", "phone"]
