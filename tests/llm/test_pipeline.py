"""The stages of the pipeline take effect one after another."""

from __future__ import annotations

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from motorpool.llm import leaks, secret_scan
from llm_samples import DATA, TOKENIZER

NAMES = ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "bpe"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, DATA).write.parquet(path)
        docs = found[name] = spark.read.parquet(path)
    return found


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    columns = stages["start"].columns
    assert all(stages[n].columns == columns for n in NAMES[:-1])
    counts = [stages[n].count() for n in ("start", *NAMES)]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] == counts[5]


def test_nothing_left_to_do(spark, stages):
    again = corpus_pipeline.drop_near_copies(spark, stages["ngram_jaccard_join"], DATA)
    assert again.count() == stages["ngram_jaccard_join"].count()
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert leaks.leaks(stages["benchmark_decontamination"], bench).count() == 0
    texts = [r.text for r in stages["secret_scans"].select("text").collect()]
    assert not any(secret_scan.base_spans(t) for t in texts)


def test_other_rows_stay_as_they_are(stages):
    start = {r.doc_id: r for r in stages["start"].collect()}
    for name in NAMES[:3]:
        assert all(start[r.doc_id] == r for r in stages[name].collect())
    for r in stages["secret_scans"].collect():
        assert r.text == start[r.doc_id].text or "[secret]" in r.text and r.n_chars == len(r.text)


def test_ids_are_those_of_the_text(stages):
    of = Tokenizer.from_file(TOKENIZER)
    texts = {r.doc_id: r.text for r in stages["secret_scans"].collect()}
    rows = stages["bpe"].collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(list(r.ids) == of.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in rows)


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == stages["bpe"].columns
    key = lambda df: sorted((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert key(got) == key(stages["bpe"])


def test_stages_survive_odd_rows(spark, odd):
    docs = odd.selectExpr("doc_id", "text", "lang", "'s' as source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert corpus_pipeline.encode(spark, docs, DATA).count() == docs.count()


def test_all_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")] + ["pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names[:-1]) == list(range(1, 14))
    assert set(names) <= set(entry.queries()) and "op7_warc" in entry.oracle_sql()
