from __future__ import annotations

import edge
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from ravelin.llm import bpe, decontaminate, pii, registry, simhash, toxicity


def test_registry():
    numbers = sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(registry.QUERIES) | {"pipeline"} <= set(driver.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "pii_redaction", "bpe_encoding"]


def test_each_stage_against_its_operator(spark, data):
    """Every stage does to its own input what its operator says of it."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    ids = lambda df: {r.doc_id for r in df.collect()}

    stages = [f for _, f in corpus_pipeline.STAGES]
    civil = stages[0](spark, docs, data)
    scored = toxicity.scores(docs, toxicity.train(docs, labels), ["doc_id"]).collect()
    assert ids(civil) == {r.doc_id for r in scored if r.toxic_score < 0.7} and civil.columns == columns
    assert 0 < len(ids(civil)) < len(texts)

    single = stages[1](spark, civil, data)
    classes = simhash.near_duplicates(civil).collect()
    assert ids(single) == {r.component_id for r in classes} and single.count() == len(ids(single)) and single.columns == columns

    clean = stages[2](spark, single, data)
    items = [(str(r.item_id), decontaminate.words_of(r.text.encode())) for r in bench.collect()]
    tables = decontaminate.Benchmark(items)
    assert ids(clean) == {i for i in ids(single) if not tables.scan(decontaminate.words_of(texts[i].encode()))[0]} and clean.columns == columns

    redacted = stages[3](spark, clean, data)
    rows = {r.doc_id: r for r in redacted.collect()}
    assert set(rows) == ids(clean) and redacted.columns == columns
    for i, r in rows.items():
        assert not [s for s in pii.base_spans(r.text)[0]] and r.n_chars == len(r.text)
        assert r.text == texts[i] or pii.base_spans(texts[i])[0] or pii.scan(texts[i])[1]

    coded = stages[4](spark, redacted, data)
    final = {r.doc_id: r for r in coded.collect()}
    coder = bpe.MergeReplay(bpe.public_tokenizers.path(bpe.VOCABULARY))
    assert set(final) == set(rows)
    for i, r in final.items():
        assert b"".join(coder.tokens[x] for x in r.ids).decode() == rows[i].text and r.n_tokens == len(r.ids)


def test_run_equals_its_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert edge.same(corpus_pipeline.run(spark, data), docs)


@pytest.mark.parametrize("empty", [False, True])
def test_edges(spark, data, empty, tmp_path):
    docs = edge.documents(spark, [] if empty else None, extra=True)
    edge.labels(spark, [(3, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert k == 4 or docs.columns == columns
    assert docs.count() == (0 if empty else len({simhash.fingerprint(None if t is None else t.encode()) for t in edge.TEXTS}))
