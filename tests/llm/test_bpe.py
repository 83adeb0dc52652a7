from __future__ import annotations

import hashlib
import random
import time

import edge
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ravelin.llm import bpe
from ravelin.llm import token_counts as counts

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def truth():
    return tiktoken.Encoding("truth", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH)[0], special_tokens={})


def ids_of(packed):
    return np.frombuffer(packed, dtype=np.uint32).tolist()


def test_replay_equals_the_library(truth):
    rnd = random.Random(1)
    wide = [chr(x) for x in [*range(0x250), 0x300, 0x660, 0x2028, 0x2160, 0x3000, 0x4E2D, 0x200B, 0x1F600]]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.choice([2, 9, 80]))) for _ in range(1500) for letters in (wide, "ab", "aA ", "ab \n", "\x1c\x1f \x85a", "é ñ\xa0")]
    coder = bpe.MergeReplay(PATH)
    for at in range(0, len(texts), 1000):
        for text, packed in zip(texts[at : at + 1000], coder.encode(texts[at : at + 1000])):
            assert ids_of(packed) == truth.encode_ordinary(text)
            assert coder.decode(packed) == text.encode()


def test_small_word_table(truth, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 3)
    coder = bpe.MergeReplay(PATH)
    for text in ("one two three four five", "five six", "one two"):
        assert ids_of(coder.encode([text])[0]) == truth.encode_ordinary(text)


def test_words_are_bounded_by_their_characters(truth, monkeypatch):
    monkeypatch.setattr(bpe, "PENDING_CHARS", 1000)
    monkeypatch.setattr(bpe, "WORD_CHARS", 3000)
    coder = bpe.MergeReplay(PATH)
    most = 0
    for i in range(40):
        word = f"q{chr(97 + i % 26)}{chr(97 + i // 26)}" * 100  # 300 characters each
        numbers = coder.numbers(word)
        due = coder.due
        coder.settle()
        assert not coder.due and ids_of(coder.ids(numbers)) == truth.encode_ordinary(word)
        assert not due
        most = max(most, coder.number.chars)
        coder.forget()
    assert most <= 3300
    for i in range(4):
        assert not coder.due
        coder.numbers(f"z{chr(97 + i)}" * 150)
    assert coder.due


def test_long_words(truth, monkeypatch):
    rnd = random.Random(3)
    coder = bpe.MergeReplay(PATH)
    began = time.process_time()
    for word in ("ab" * 500_000, "QmFzZTY0" * 125_000, "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))):
        packed = coder.encode([word])[0]
        assert coder.decode(packed) == word.encode()
    assert time.process_time() - began < 60  # 20 times the length of what took that long when it was quadratic
    monkeypatch.setattr(bpe, "LONG", 3)
    coder = bpe.MergeReplay(PATH)
    for _ in range(600):
        word = "".join(rnd.choices("abe tion=+/é"[: rnd.randrange(1, 13)], k=rnd.choice([4, 30, 500])))
        assert ids_of(coder.encode([word])[0]) == truth.encode_ordinary(word)


def test_texts_wait_for_a_replay(spark, truth, monkeypatch):
    monkeypatch.setattr(bpe, "PENDING", 2)
    monkeypatch.setattr(bpe, "NUMBERS", 5)
    monkeypatch.setattr(bpe, "WORDS", 4)
    docs = edge.documents(spark)
    got = {r.doc_id: r.ids for r in bpe.encode(docs.unionByName(docs), ["doc_id", "lang"]).collect()}
    assert got == {i: truth.encode_ordinary(t or "") for i, t in enumerate(edge.TEXTS)}


def test_edges_and_round_trip(spark, truth):
    docs = edge.documents(spark, extra=True)
    got = {r.doc_id: r for r in bpe.encode(docs, ["doc_id"], decoded=True).collect()}
    for i, t in enumerate(edge.TEXTS):
        assert got[i].ids == truth.encode_ordinary(t or "") and bytes(got[i].bytes) == (t or "").encode()
    again = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(docs, ["doc_id"]), ["doc_id"]).collect()}
    assert again == {i: (t or "").encode() for i, t in enumerate(edge.TEXTS)}
    strange = spark.createDataFrame([(1, None), (2, [-1]), (3, [1, 99_999]), (4, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.bytes for r in bpe.decode(strange, ["doc_id"]).collect()} == {1: None, 2: None, 3: None, 4: b""}
    assert bpe.digests(edge.documents(spark, [])).count() == 0


def test_query_on_the_fixture(spark, data, truth):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = bpe.op5(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = truth.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_histogram_answers_every_limit(spark, truth):
    docs = edge.documents(spark, extra=True)
    sizes = sorted(len(truth.encode_ordinary(t or "")) for t in edge.TEXTS)
    sums = counts.suffix_sums(counts.histogram(counts.lengths(docs)), block=4).collect()
    assert sorted(r.length for r in sums) == sorted(set(sizes))
    for r in sums:
        assert r.n_docs == sizes.count(r.length) and r.docs_longer == sum(s > r.length for s in sizes)
        assert r.tokens_longer == sum(s for s in sizes if s > r.length) and r.truncated_total == sum(min(s, r.length) for s in sizes)
        assert r.quantile == pytest.approx(sum(s <= r.length for s in sizes) / len(sizes)) and r.total_tokens == sum(sizes) and r.total_docs == len(sizes)
    hist = counts.histogram(counts.lengths(docs))
    for r in counts.truncated_totals(hist, [0, 1, 7, 100, 10**6]).collect():
        assert r.truncated_total == sum(min(s, r.context_limit) for s in sizes) and r.tokens_lost == sum(sizes) - r.truncated_total
        assert r.docs_longer == sum(s > r.context_limit for s in sizes)
    got = {r.share: r.length for r in counts.quantiles(counts.suffix_sums(hist), [0.1, 0.5, 1.0]).collect()}
    assert got == {q: next(s for i, s in enumerate(sizes, 1) if i >= q * len(sizes)) for q in got}


def test_histogram_of_nothing(spark):
    hist = counts.histogram(counts.lengths(edge.documents(spark, [])))
    assert counts.suffix_sums(hist).count() == 0
    assert [tuple(r) for r in counts.truncated_totals(hist, [5]).collect()] == [(5, 0, 0, 0)]
    assert counts.quantiles(counts.suffix_sums(hist), [0.5]).first().length is None


def test_counts_query(spark, data, truth):
    rows = counts.op7(spark, data).collect()
    sizes = [len(truth.encode_ordinary(r.text)) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert {r.length: (r.n_docs, r.truncated_total) for r in rows} == {s: (sizes.count(s), sum(min(x, s) for x in sizes)) for s in set(sizes)}


def test_many_long_words_in_a_task(spark, truth):
    """More characters than may wait at once, in few words."""
    texts = [f"{chr(97 + i)}{chr(98 + i)}c" * 100_000 for i in range(20)] + ["one two"] * 3
    rows = {r.doc_id: r for r in bpe.digests(edge.documents(spark, texts).coalesce(1)).collect()}
    for i in (0, 19, 22):
        ids = truth.encode_ordinary(texts[i])
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert all(r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in rows.items())
