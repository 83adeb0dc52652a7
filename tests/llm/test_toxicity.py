from __future__ import annotations

import math
import random
import re
import zlib

import edge
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import toxicity as tox


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


TERMS = ["idiot", "scum", "worthless", "abcab", "stem*", "longstems*"]


def brute(word):
    found = []
    for term in TERMS:
        if term.endswith("*"):
            d = min(distance(word[:n], term[:-1]) for n in range(len(word) + 1))
        else:
            d = distance(word, term)
        if d <= tox.edits(term):
            found.append((d, term))
    return min(found)[::-1] if found else None


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(TERMS), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("abcdiotsmelnguwrh"), st.integers(0, 2)), max_size=3), st.text("abcs", max_size=4))
def test_automaton_equals_edit_distance(term, changes, tail):
    word = term.rstrip("*") + tail
    for at, c, how in changes:
        word = word[:at] + c * (how < 2) + word[at + (how > 0) :]
    assert tox.FuzzyTrie(TERMS).match(word) == brute(word)


def test_quotation_counts_less_than_abuse():
    scorer = tox.Scorer(tox.SEEDS)
    abuse, quoted = scorer.features("You are an idiot!"), scorer.features('He said the word "idiot" was used')
    assert abuse[1] > quoted[1] and quoted[2] > 0
    assert scorer.occurrences("what an IDIOTT")[0]["distance"] == 1
    assert scorer.features(None) == scorer.features("") == scorer.features("nice words")


@pytest.mark.parametrize("size", [10, 500, 50_000])
def test_quotations_of_any_length(size):
    scorer, filler = tox.Scorer(tox.SEEDS), ("plain words " * 5000)[:size]
    quoted = lambda t: [x["quotation"] >= 1 for x in scorer.occurrences(t)]
    for start, end in ("“”", "«»", "„“", "‘’", '""'):
        assert quoted(f"a {start}{filler} idiot {filler}{end} b") == [True]
        assert quoted(f"a {start}{filler}{end} idiot {filler} b") == [False]
        assert quoted(f"a {start}one{end} {filler} idiot {start}{filler}{end} b") == [False]
        assert quoted(f"a {start}{filler} idiot {filler} b") == [False]  # nothing closes it
    assert quoted(f'5" {filler}\nan idiot "x"') == [False]  # straight marks pair within a line
    assert quoted(f"“a ‘{filler} idiot’ moron” scum") == [True, True, False]
    score = lambda t: float(tox.PRIOR @ np.array(scorer.features(t)))
    assert score(f'you are "{filler}" an idiot') > score(f'it is "{filler} an idiot"')


def brute_quoted(text, lo, hi):
    """Whether some pair of marks around the place belongs together, by a scan from each opening mark."""
    lines = text.split("\n")
    at = 0
    for line in lines:
        marks = [at + i for i, c in enumerate(line) if c == '"']
        if any(a < lo and hi <= b for a, b in zip(marks[::2], marks[1::2])):
            return True
        at += len(line) + 1
    for opening, closing in ("«»", "‘’"):
        stack = []
        for i, c in enumerate(text):
            if c == opening:
                stack.append(i)
            elif c == closing and stack and stack.pop() < lo and hi <= i:
                return True
    low, high = [], []  # „ closed by “, which else opens what ” closes
    for i, c in enumerate(text):
        if c == "„":
            low.append(i)
        elif c == "“" and low:
            if low.pop() < lo and hi <= i:
                return True
        elif c == "“":
            high.append(i)
        elif c == "”" and high and high.pop() < lo and hi <= i:
            return True
    return False


def test_scores_equal_brute_force(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = tox.train(docs, labels)
    lexicon, trust, weights = model
    near = {}

    def match(word):
        if word not in near:
            found = []
            for term in lexicon:
                most = tox.edits(term)
                if term.endswith("*"):
                    starts = [word[:n] for n in range(max(0, len(term) - 1 - most), min(len(word), len(term) - 1 + most) + 1)]
                    d = min((distance(x, term[:-1]) for x in starts), default=9)
                else:
                    d = distance(word, term) if abs(len(word) - len(term)) <= most else 9
                if d <= most:
                    found.append((d, term))
            near[word] = min(found) if found else None
        return near[word]

    def score(text):
        low = (text or "").lower()
        source = text if text and len(low) == len(text) else low
        words = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", low)]
        net, quoted = [], 0
        for i, (w, lo, hi) in enumerate(words):
            if not (hit := match(w)):
                continue
            around = [x for x, *_ in words[max(0, i - 8) : i] + words[i + 1 : i + 9]]
            said = (1.0 if brute_quoted(source, lo, hi) else 0.0) + (0.5 if any(x in tox._REPORTING for x in around) else 0.0)
            if said >= 1:
                quoted += 1
                continue
            force = 1 + 0.5 * any(x in tox._SECOND for x in around) + 0.25 * sum(match(x) is not None for x in around) + 0.25 * source[lo:hi].isupper() + 0.25 * ("!" in source[hi : hi + 3])
            net.append(max(0.0, force - said) * (trust.get(w, 0.5) if hit[0] else 1))
        x = [1.0, math.log1p(sum(net)), math.log1p(quoted), min(2.0, max(net)), math.log1p(100 * sum(net) / len(words))] if net else [1.0, 0.0, math.log1p(quoted), 0.0, 0.0]
        return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, weights))))))

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in tox.op3(spark, data).collect():
        if len(texts[r.doc_id] or "") < 5000:
            assert r.score == pytest.approx(score(texts[r.doc_id]), abs=1e-9), r.doc_id
    for t in ["“you idiot” said", 'a "moron" is “no „idiot“ scum” ‘loser’', "you IDIOTS! moron, scum", "„idiot“ “moron” „scum"]:
        found = tox.Scorer(lexicon, trust).features(t)
        assert 1 / (1 + math.exp(-sum(a * b for a, b in zip(found, weights)))) == pytest.approx(score(t), abs=1e-9), t


def test_stems_of_whole_texts_without_caps(spark):
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("bdfgklmnprt") + rnd.choice("aeiou") for _ in range(n))
    stems = sorted({f"zq{word(2)}" for _ in range(9)})
    texts = [" ".join([word(3) for _ in range(20)] + ([stems[i % len(stems)] + word(1)] if i % 2 else [])) for i in range(900)]
    lexicon, _, _ = tox.train(edge.documents(spark, texts), edge.labels(spark, [(i, i % 2) for i in range(900)]))
    assert all(any(s.startswith(t[:-1]) or t.startswith(s) for t in lexicon if t.endswith("*")) for s in stems)


def test_learned_scores_hold_out(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("bdfgklmnprt") + rnd.choice("aeiou") for _ in range(3))
    texts, marks = [], []
    for i in range(600):
        words = [word() for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[rnd.randrange(40)] = rnd.choice(["idiot", "moron"]) if i % 8 else "zuqxo" + word()[:2]
        texts.append(" ".join(words))
        marks.append((i, int(bad)))
    docs = edge.documents(spark, texts)
    model = tox.train(docs, edge.labels(spark, marks))
    assert any(t.startswith("zuqx") for t in model[0])
    rows = tox.scores(docs, model, ["doc_id"]).collect()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 == 1:
            assert (r.toxic_score >= tox.THRESHOLD) == (r.doc_id % 4 == 0)
    assert all(0 <= r.toxic_score <= 1 for r in rows)
    kept = tox.keep_civil(docs, edge.labels(spark, marks))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(600) if i % 4}


def test_held_out_labels_are_not_learned_from(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    docs = edge.documents(spark, [f"text {i}" for i in ids], ids=ids)
    one, other = (tox.train(docs, edge.labels(spark, [(i, v) for i in ids])) for v in (0, 1))
    assert one == other and one[2] == pytest.approx(tox.PRIOR.tolist())


def test_edges(spark):
    docs = edge.documents(spark, extra=True)
    marks = edge.labels(spark, [(0, 1), (1, None), (2, 7), (None, 1), (4, 1), (4, 0), (5, 0)])
    model = tox.train(docs, marks)
    rows = {r.doc_id: r.toxic_score for r in tox.scores(docs, model, ["doc_id"]).collect()}
    assert len(rows) == len(edge.TEXTS) and rows[0] == rows[1]
    assert tox.keep_civil(docs, marks).columns == docs.columns
    empty = edge.documents(spark, [])
    assert tox.keep_civil(empty, marks).count() == 0 and tox.scores(empty, tox.train(empty, marks.limit(0)), ["doc_id"]).count() == 0


def test_query_columns(spark, data):
    df = tox.op3(spark, data)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
