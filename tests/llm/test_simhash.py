from __future__ import annotations

import random

import edge
import numpy as np
import pytest
import xxhash

from ravelin.llm import simhash
from ravelin.llm.components import connected_components


def brute_fingerprint(text, width=3):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in folded + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(rows))]


def test_edge_texts_and_extra_columns(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(edge.documents(spark, extra=True)).collect()}
    prints = [(i, brute_fingerprint(t)) for i, t in enumerate(edge.TEXTS)]
    assert [got[i].fingerprint for i in range(len(prints))] == [f"{p:016x}" for _, p in prints]
    assert [got[i].component_id for i in range(len(prints))] == brute_classes(prints)
    assert simhash.near_duplicates(edge.documents(spark, [])).count() == 0


def test_whole_fixture_against_brute_force(spark, data):
    got = simhash.op2(spark, data).collect()
    want = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in want}
    assert {r.doc_id: r.component_id for r in got} == dict(zip((i for i, _ in want), brute_classes(want)))


def crowded(rnd, n=300, crowds=4, each=150):
    prints = {rnd.getrandbits(64) for _ in range(n)}
    for centre in rnd.sample(sorted(prints), crowds):  # crowds within a few bits
        prints |= {centre ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) ^ (1 << rnd.randrange(64)) * rnd.randrange(2) for _ in range(each)}
    return sorted(p - (1 << 64) if p >> 63 else p for p in prints)


@pytest.mark.parametrize("bucket,radius", [(2, 2), (64, 2), (1, 1), (3, 3), (64, 3), (8, 0)])
def test_links_of_random_and_crowded_prints(spark, bucket, radius):
    signed = crowded(random.Random(3))
    x = np.array(signed).view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    want = {(signed[i], signed[j]) for i, j in np.argwhere(near) if i < j}
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), radius, bucket=bucket).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_crowd_of_ten_thousand(spark):
    rnd = random.Random(8)
    centre = rnd.getrandbits(62)
    crowd = {centre}
    while len(crowd) < 10_000:
        crowd.add(centre ^ 1 << rnd.randrange(63) ^ 1 << rnd.randrange(63) ^ 1 << rnd.randrange(63) ^ (1 << rnd.randrange(63)) * rnd.randrange(2))
    values = spark.createDataFrame([(p,) for p in crowd], "fp long")
    x = np.array(sorted(crowd))
    want = 0
    for at in range(0, len(x), 500):
        want += int((np.bitwise_count(x[at : at + 500, None] ^ x[None, :]) <= 2).sum())
    assert simhash.links(values).count() == (want - len(x)) // 2


def test_bits_in_common_bound_what_meets():
    first, again = simhash.choices(2)
    assert len(first) == 6 and {m.bit_count() for m in first} == {32}
    assert {len(a) for a in again} == {28} and {m.bit_count() for own in again for m in own} == {56}  # 2^8 fingerprints at most


def test_pivots_discard_no_link_and_verify():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values[10:20] = values[:10] ^ np.uint64(0b101)
    values[20] = values[0] ^ np.uint64(0b1110)
    a, b = simhash.links_within(values, np.array([0, 21, 40]), 2, simhash.pivot_table())
    assert sorted(zip(a.tolist(), b.tolist())) == sorted((i, i + 10) for i in range(10))


def test_null_and_repeated_ids_ties_and_keep_one(spark, monkeypatch):
    texts = ["a b c d", "a b c d", "a b c d", "other words here now", None, "", "other words here now"]
    ids = [5, 2, 2, None, None, 7, None]
    docs = edge.documents(spark, texts, extra=True, ids=ids)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()) == [(False, 2, "a b c d"), (False, 7, ""), (True, 0, "other words here now")]
    for rows in (4, 3, 2):  # numbers to drop are broadcast, those to keep, nothing
        monkeypatch.setattr(simhash, "BROADCAST_BYTES", rows * simhash.ROW_BYTES)
        assert edge.same(simhash.keep_one(docs), kept)
    classes = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert set(classes.values()) == {2, 7, None}
    assert simhash.keep_one(edge.documents(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (500, 502)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500, 502: 500}
    assert connected_components(edges.limit(0)).count() == 0
