"""Toxicity by a Levenshtein automaton intersected with a lexicon trie.

Every distinct word of a batch runs through the intersection of the trie of offensive terms with the
automaton that tolerates a term's allowed edits (made deterministic as it is used), so misspelled terms are
found without comparing words with terms. Terms are whole words or stems, which stand for all words that begin so.
Each occurrence is then judged by a window of words around it: quotation marks, reporting verbs and words about words speak for a quotation, second persons, shouting and other offensive
terms nearby for abuse. A logistic model over a few sums of these window scores gives the probability.

Quotations are matched once over the whole text: paired marks by nesting, straight ones two by two within a line; a mark without its partner
quotes nothing.

Fitting: of the labelled rows about `TRAIN_ROWS`, chosen by a hash of the id, are used (this bounds the
driver's memory; nothing else is sampled). The lexicon starts from `SEEDS` and takes, greedily, stems that mark toxic training
texts which it doesn't explain yet. How far a misspelling is to be trusted is learned for each form that at least `LEAST_FORMS` training
texts hold. Weights are a maximum a posteriori fit around `PRIOR`, which alone holds without labels.

Defined results: null, empty and wordless texts have no hits and get the score of that; very long texts are scored whole; repeated rows
are scored each; a label that is repeated for an id counts once, conflicting ones count once each, null labels are ignored; of stems that
explain as many texts the longest comes first, then the last in order; empty tables give an empty result or the prior's weights; a
null doc_id is not held out; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.arrow import map_columns
from ravelin.runtime import materialize

#: Offensive terms known beforehand.
SEEDS = ("asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "dumbass", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
#: Labelled rows that the fit uses (about); training texts that hold a form of a misspelling at least.
TRAIN_ROWS, LEAST_FORMS = 20_000, 2
#: A learned stem's lengths, the least number and share of unexplained toxic texts that hold it, and its least precision.
STEM_LENGTHS, LEAST_TEXTS, LEAST_SHARE, LEAST_PRECISION = (4, 8), 5, 0.01, 0.95
#: Words on each side of an occurrence that its window score looks at; probability from which a text is rejected.
CONTEXT, THRESHOLD = 8, 0.7

_WORD = re.compile(r"[^\W_]+")
#: A space for what is no part of a word, by Latin-1 character.
_LATIN = bytes(c if _WORD.match(chr(c)) else 32 for c in range(256))
_REPORTING = frozenset("said says say called calls call wrote writes quoted quote quotes word words term terms phrase alleged allegedly sagte nannte schrieb zitat wort dit appelé écrit citation mot dijo llamó escribió cita palabra".split())
_SECOND = frozenset("you your yours yourself u ur du dich dein deine ihr euch tu te ton ta vous votre tú usted vosotros eres".split())
#: Closing marks by opening ones; “ also closes what „ has opened.
_CLOSERS = {"“": "”", "«": "»", "„": "“", "‘": "’"}
_MARK = re.compile("[“”«»„‘’\"\n]")

FEATURES = ("bias", "abuse", "quoted", "strongest", "density")
#: Mean and precision of the weights before any label is seen.
PRIOR = np.array([-4.0, 3.0, 0.6, 3.0, 1.0])
PRIOR_PRECISION = np.array([0.05, 0.05, 2.0, 0.05, 0.5])
#: Trust in a form of a misspelling that was never seen, and how many texts that counts for.
UNSEEN, UNSEEN_TEXTS = 0.5, 1.0


def words_in(lowered: str) -> list[str]:
    """All words in order, where the text allows it without the pattern."""
    try:
        return lowered.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(lowered)


def edits(term: str) -> int:
    """Edits tolerated in a term; a stem is written with a * at its end."""
    if term.endswith("*"):
        return int(len(term) > 7)
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyTrie:
    """Trie of terms intersected with their Levenshtein automata; states are sets of (node, edits so far)."""

    def __init__(self, terms: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[str]] = [[]]
        self.allowed: list[int] = [0]  # most edits of any term below
        for term in sorted(set(terms)):
            node = 0
            for c in term.rstrip("*"):
                self.allowed[node] = max(self.allowed[node], edits(term))
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.children[node][c]
            self.ends[node].append(term)
            self.allowed[node] = max(self.allowed[node], edits(term))
        self.alphabet = {c for kids in self.children for c in kids}
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[int, str] | None] = []  # when a word ends there
        self.begun: list[tuple[int, str] | None] = []  # stems that the word has passed
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        best: dict[int, int] = {}
        queue = list(pairs)
        while queue:  # skipped characters of a term cost an edit each
            node, spent = queue.pop()
            if spent > self.allowed[node] or best.get(node, 9) <= spent:
                continue
            best[node] = spent
            queue += [(kid, spent + 1) for kid in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            hits = sorted((spent, term) for node, spent in key for term in self.ends[node] if spent <= edits(term))
            stems = [x for x in hits if x[1].endswith("*")]
            self.found.append(hits[0] if hits else None)
            self.begun.append(stems[0] if stems else None)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        after = set()
        for node, spent in self.members[state]:
            after.add((node, spent + 1))
            for label, kid in self.children[node].items():
                after.add((kid, spent + (label != c)))
        return self._state(after)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance, if within what it tolerates."""
        state, best = self.start, None
        for c in word:
            if c not in self.alphabet:
                c = ""  # all other characters act alike
            moves = self.moves[state]
            state = moves[c] if c in moves else moves.setdefault(c, self._move(state, c))
            if not self.members[state]:
                break
            if (stem := self.begun[state]) and (best is None or stem < best):
                best = stem
        else:
            if (found := self.found[state]) and (best is None or found < best):
                best = found
        return best and (best[1], best[0])


def quotations(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint ranges between quotation marks, in order, found in one pass."""
    found: list[tuple[int, int]] = []
    opened: dict[str, list[int]] = {c: [] for c in _CLOSERS.values()}  # by the mark that will close them
    straight = -1
    for m in _MARK.finditer(text):
        mark, at = m.group(), m.start()
        if mark == "\n":
            straight = -1
        elif mark == '"':
            if straight >= 0:
                found.append((straight, at))
            straight = -1 if straight >= 0 else at
        elif opened.get(mark):
            found.append((opened[mark].pop(), at))
        elif mark in _CLOSERS:
            opened[_CLOSERS[mark]].append(at)
    starts: list[int] = []
    ends: list[int] = []
    for lo, hi in sorted(found):
        if ends and lo < ends[-1]:
            ends[-1] = max(ends[-1], hi)
        else:
            starts.append(lo)
            ends.append(hi)
    return starts, ends


class Scorer:
    """Features of a text under a lexicon; trust: how far each form of a misspelling is believed."""

    def __init__(self, terms: Iterable[str], trust: dict[str, float] | None = None):
        self.trie = FuzzyTrie(terms)
        self.trust = trust or {}
        self.seen: set[str] = set()
        self.known: dict[str, tuple[str, int]] = {}  # what those of them match that match anything

    def matches(self, words: set[str]) -> dict[str, tuple[str, int]]:
        """Term and distance of each offensive word among these."""
        if len(self.seen) >= 200_000:
            self.seen.clear()
            self.known.clear()
        fresh = words - self.seen
        self.known.update((w, m) for w in fresh if (m := self.trie.match(w)))
        self.seen |= fresh
        return {w: self.known[w] for w in self.known.keys() & words}

    def occurrences(self, text: str | None) -> list[dict]:
        """Every offensive word with its term, distance, place and window scores."""
        return self._judged(text)[0]

    def _judged(self, text: str | None) -> tuple[list[dict], int]:
        """The occurrences, and how many words the text has."""
        lowered = (text or "").lower()
        words = words_in(lowered)
        hits = self.matches(set(words))
        if not hits:
            return [], len(words)
        if len(lowered) != len(text):  # lower-casing may add code points; places refer to the lowered text then
            text = lowered
        hit = [w in hits for w in words]
        starts, ends = quotations(text)
        out = []
        for i, m in compress(enumerate(_WORD.finditer(lowered)), hit):
            word, (lo, hi) = words[i], m.span()
            near = words[max(0, i - CONTEXT) : i] + words[i + 1 : i + 1 + CONTEXT]
            at = bisect_right(starts, lo) - 1
            quotes = 1.0 * (at >= 0 and hi <= ends[at]) + 0.5 * any(w in _REPORTING for w in near)
            abuse = 1.0 + 0.5 * any(w in _SECOND for w in near) + 0.25 * sum(w in hits for w in near) + 0.25 * text[lo:hi].isupper() + 0.25 * ("!" in text[hi : hi + 3])
            term, distance = hits[word]
            out.append({"term": term, "word": word, "start": lo, "end": hi, "distance": distance, "quotation": quotes, "abuse": abuse})
        return out, len(words)

    def features(self, text: str | None) -> list[float]:
        own, n_words = self._judged(text)
        direct = [x for x in own if x["quotation"] < 1]
        net = [max(0.0, x["abuse"] - x["quotation"]) * (self.trust.get(x["word"], UNSEEN) if x["distance"] else 1) for x in direct]
        if not net:
            return [1.0, 0.0, math.log1p(len(own)), 0.0, 0.0]
        per_word = 100 * sum(net) / max(1, n_words)
        return [1.0, math.log1p(sum(net)), math.log1p(len(own) - len(direct)), min(2.0, max(net)), math.log1p(per_word)]


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights with the greatest posterior, by Newton's method."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(PRIOR_PRECISION), x.T @ (p - y) + PRIOR_PRECISION * (w - PRIOR))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(column: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], dict[str, float], list[float]]:
    """(lexicon, trust in forms, weights), from the labels that aren't held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).distinct()
    share = min(1.0, rows / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < math.ceil(share * 1_000_003))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = materialize(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")  # chosen: two numbers for about `rows` pairs of id and label
    lexicon = sorted({*SEEDS, *_learn_stems(sample)})
    trust = _learn_trust(sample, lexicon)
    found = map_columns(sample, "features array<double>", _features(lexicon, trust), keep=["toxic"]).toPandas()
    x, y = np.array(found.features.tolist(), dtype=float).reshape(-1, len(FEATURES)), found.toxic.to_numpy(dtype=float)
    return lexicon, trust, [float(v) for v in fit(x, y)]


def _features(lexicon: list[str], trust: dict[str, float]):
    def start():
        scorer = Scorer(lexicon, trust)
        return lambda texts: [[scorer.features(t) for t in texts]]

    return start


def _stems(wanted):
    """Beginnings of each text's words: all (none for texts that seeds explain), or those of a broadcast set."""
    shortest, longest = STEM_LENGTHS

    def start():
        scorer = Scorer(SEEDS)

        def call(texts, toxic):
            out = []
            for text, label in zip(texts, toxic):
                words = set(words_in((text or "").lower()))
                if wanted is None and (not label or any(not distance for _, distance in scorer.matches(words).values())):
                    out.append(None)
                    continue
                stems = {w[:n] for w in words if w.isalpha() for n in range(shortest, min(longest, len(w)) + 1)}
                out.append(sorted(stems if wanted is None else stems & wanted.value))
            return [out]

        return call

    return start


def _learn_stems(sample: DataFrame) -> list[str]:
    """Stems that mark toxic texts without seeds: the one in most unexplained texts first, then what it leaves."""
    texts = sample.distinct()
    plain = materialize(map_columns(texts.withColumn("label", F.col("toxic")), "stems array<string>", _stems(None), keep=["label"]).filter("label = 1 and stems is not null").select("stems", F.row_number().over(Window.orderBy(F.xxhash64("stems"))).alias("text_no")), "stems")  # numbers of at most about TRAIN_ROWS texts
    least = max(LEAST_TEXTS, LEAST_SHARE * plain.count())
    each = plain.select("text_no", F.explode("stems").alias("stem"))
    bad = {r.stem: r.bad for r in each.groupBy("stem").agg(F.count(F.lit(1)).alias("bad")).filter(F.col("bad") >= least).toLocalIterator()}  # each in a hundredth of the texts
    if not bad:
        return []
    others = map_columns(texts.filter("toxic = 0"), "stems array<string>", _stems(sample.sparkSession.sparkContext.broadcast(frozenset(bad)))).select(F.explode("stems").alias("stem"))
    good = {r.stem: r.good for r in others.groupBy("stem").agg(F.count(F.lit(1)).alias("good")).toLocalIterator()}
    sure = [s for s, n in bad.items() if n >= LEAST_PRECISION * (n + good.get(s, 0))]
    # One bit per training text; of stems that mark the same texts only the one that would be chosen leaves Spark.
    held = each.filter(F.col("stem").isin(sure)).withColumn("at", F.col("text_no")).groupBy("stem", F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("bitmap_bit_position(at)")).alias("bits"))
    whole = held.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("texts"))
    alike = whole.groupBy("texts").agg(F.max(F.struct(F.length("stem").alias("n"), "stem")).alias("best"))
    where: dict[str, int] = {}
    for r in alike.toLocalIterator():
        where[r.best.stem] = sum(int.from_bytes(b.bits, "little") << (int(b.bucket) - 1) * 8 * len(b.bits) for b in r.texts)
    chosen: list[str] = []
    while where:  # every round explains a hundredth of the texts at least, so there are at most a hundred
        stem = max(where, key=lambda s: (where[s].bit_count(), len(s), s))
        if where[stem].bit_count() < least:
            break
        chosen.append(stem + "*")
        explained = where[stem]
        where = {s: rest for s, own in where.items() if (rest := own & ~explained)}
    return chosen


def _learn_trust(sample: DataFrame, lexicon: list[str]) -> dict[str, float]:
    """For misspellings in several texts without an exact term: the share of toxic ones among those texts."""

    def start():
        scorer = Scorer(lexicon)

        def call(texts):
            out = []
            for text in texts:
                hits = scorer.matches(set(words_in((text or "").lower())))
                out.append([] if any(not m[1] for m in hits.values()) else sorted(hits))
            return [out]

        return call

    forms = map_columns(sample.distinct(), "forms array<string>", start, keep=["toxic"]).select("toxic", F.explode("forms").alias("form"))
    counts = forms.groupBy("form").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all"))
    rows = counts.filter(F.col("all") >= LEAST_FORMS).toLocalIterator()
    return {r.form: (r.bad + UNSEEN * UNSEEN_TEXTS) / (r["all"] + UNSEEN_TEXTS) for r in rows}


def scores(docs: DataFrame, model: tuple[list[str], dict[str, float], list[float]], keep: list[str]) -> DataFrame:
    """The columns to keep and `toxic_score`."""
    lexicon, trust, weights = model

    def start():
        scorer, w = Scorer(lexicon, trust), np.array(weights)

        def call(texts):
            if not texts:
                return [[]]
            z = np.array([scorer.features(t) for t in texts]) @ w
            return [(1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()]

        return call

    return map_columns(docs.select(*keep, F.col("text").cast("string").alias("__toxic_text")), "toxic_score double", start, keep=keep)


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents scored below the threshold."""
    model = train(docs, labels)
    rows = docs.select(F.struct("*").alias("row"), "text")
    return scores(rows, model, ["row"]).filter(F.col("toxic_score") < threshold).select("row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: a toxicity score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores(docs, model, ["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
