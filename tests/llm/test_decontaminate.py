from __future__ import annotations

import hashlib
import pickle
import random
import re

import duckdb
import edge
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import decontaminate as dec


def words(t):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        own = words(item)
        size = min(10, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else ()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found |= {str(name)} if name is not None else set()
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab ", max_size=40), min_size=1, max_size=4), st.text("ab C", max_size=120))
def test_search_equals_brute_force(items, text):
    items = list(enumerate(items))
    ranges, names = dec.Benchmark((str(i), dec.words_of(t.encode())) for i, t in items).scan(dec.words_of(text.encode()))
    hit = sum(b - a for a, b in dec.merge(ranges))
    assert (len(words(text)), hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), hit > 0) == brute(text, items)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog"), (10, "wort1 the of and wort2 the of and wort3 the of and"), (2, None), (3, " .,; "), (None, "one"), (10, "two"), (4, "日本語 \U0001f600")]


def test_edges_in_one_and_in_many_groups(spark):
    docs = edge.documents(spark, extra=True)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = {i: brute(t, ITEMS) for i, t in enumerate(edge.TEXTS)}
    assert {r.doc_id: tuple(r)[1:] for r in dec.report(docs, bench).collect()} == want
    many = dec.hits(docs, bench, keep=["doc_id"], most=2000)
    assert {r.row.doc_id: (r.n_words, sum(r.flat[1::2]) - sum(r.flat[::2]), len(r["items"])) for r in many.collect()} == {i: w[:3] for i, w in want.items()}
    kept = dec.keep_clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[4]}
    assert dec.report(edge.documents(spark, []), bench).count() == 0
    assert not any(r.contaminated for r in dec.report(docs, bench.limit(0)).collect())
    twice = docs.unionByName(docs)
    assert dec.report(twice, bench).count() == 2 * len(edge.TEXTS)


def test_groups_are_bounded_and_lose_no_window(spark):
    rnd = random.Random(7)
    words = [f"w{rnd.randrange(300)}" for _ in range(3000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "short one"), (3, " ".join(words[40:70]))], "item_id long, text string")
    for most in (1, 20_000, 100_000, 1 << 30):
        groups = [*dec.item_groups(bench, 10, most)]
        windows = {(n, tuple(w[i : i + 10])) for g in groups for n, w in g for i in range(max(1, len(w) - 9))}
        assert windows == {("1", tuple(x.encode() for x in words[i : i + 10])) for i in range(2991)} | {("2", (b"short", b"one"))} | {("3", tuple(x.encode() for x in words[i : i + 10])) for i in range(40, 61)}
        least = 20 * (dec.WORD_BYTES + dec.DISTINCT_BYTES)
        assert all(sum(dec.WORD_BYTES * len(w) for _, w in g) + dec.DISTINCT_BYTES * len({x for _, w in g for x in w}) <= max(most, least) for g in groups)
    assert len(groups) == 1 and len(pickle.dumps(dec.Benchmark(groups[0]))) < 3030 * dec.WORD_BYTES + 302 * dec.DISTINCT_BYTES


def test_query_equals_sql(spark, data):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    assert sorted(map(tuple, dec.op9(spark, data).collect())) == sorted(con.sql(dec.OP9_SQL).fetchall())
