"""The stages one by one against brute force, then run() against the stages."""

import corpus_pipeline as P
import pytest
import test_bpe
import test_decontaminate
import test_minhash_dedup
import test_pii
import test_quality_rules
from cases import corpus
from tokenizers import Tokenizer

from lectern.llm import bpe

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs.collect()]
    for _, stage in P.STAGES:
        out.append(stage(spark, docs, DIR).collect())
        docs = spark.createDataFrame(out[-1], docs.schema) if len(out) < 6 else None
    return out


def test_quality(steps):
    assert sorted(r.doc_id for r in steps[1]) == sorted(r.doc_id for r in steps[0] if test_quality_rules.brute(r.text)[-1])


def test_near_duplicates(steps):
    rows = [(r.doc_id, r.text) for r in steps[1]]
    assert sorted(r.doc_id for r in steps[2]) == sorted(d for d, _, _, kept in test_minhash_dedup.brute(rows, 5, 80, 100) if kept)


def test_decontamination(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    word = test_decontaminate.WORD
    grams = {g for _, t in items for g in test_decontaminate.bag(word.findall(t.lower()))}
    maybe = [(r.doc_id, r.text) for r in steps[2] if grams & test_decontaminate.bag(word.findall(r.text.lower())).keys()]
    bad = {d for d, _ in test_decontaminate.brute(maybe, items)}
    assert sorted(r.doc_id for r in steps[3]) == sorted(r.doc_id for r in steps[2] if r.doc_id not in bad)
    assert bad


def test_personal_data(steps):
    before = {r.doc_id: r for r in steps[3]}
    changed = 0
    for r in steps[4]:
        b = before[r.doc_id]
        assert (r.lang, r.source, r.n_chars) == (b.lang, b.source, len(r.text))
        assert not test_pii.plain(r.text)
        changed += r.text != b.text
        if not test_pii.plain(b.text) and "<" not in r.text:
            assert r.text == b.text
    assert changed and len(before) == len(steps[4])


def test_tokens(steps):
    library = Tokenizer.from_file(bpe.word_bpe())
    text = {r.doc_id: r.text for r in steps[4]}
    assert sorted(text) == sorted(r.doc_id for r in steps[5])
    for r in steps[5]:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded_sha256 == test_bpe.sha(library.decode(ids, skip_special_tokens=False))


def test_run_is_all_stages(spark, steps):
    got = P.run(spark, DIR).collect()
    assert sorted(map(str, got)) == sorted(map(str, steps[5]))


def test_stages_survive_odd_rows(spark):
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in corpus(5)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as kept", "2 as matches", "3 as redacted", "4 as `a.b`")
    for frame in (docs, docs.limit(0)):
        now = frame
        for _, stage in P.STAGES[:-1]:
            now = stage(spark, now, DIR)
            assert now.columns == docs.columns
        assert P.STAGES[-1][1](spark, now, DIR).count() == now.count()
