"""Personal data by weak supervision.

Base patterns give e-mail, IP, card and phone spans; looser patterns propose further candidates (spelled-out
addresses, phone numbers without a country code, national and bank numbers, names after titles or from a gazetteer,
and card- or IP-like digits that fail their test). Labelers vote on every candidate: its format, a gazetteer, a checksum, the words
around it, and what it sticks to. Votes are counted over the whole corpus by pattern (there are at most
3^5 for each kind), and expectation-maximisation estimates the labelers' reliabilities from those counts. The soft labels that
follow train a logistic span classifier, whose inputs are the kind, the votes and what the labelers don't see: length, shares of
digits and capitals, separators, and the words before and after. It is fitted on at most `TRAIN_SPANS`
distinct sets of inputs, each counted once however many candidates have it, since the soft label depends on kind and votes alone; they come from
candidates chosen by a hash of kind, place and inputs. Base spans always stay; candidates stay where the classifier says so. A candidate never overlaps a base span
or another candidate; base spans of different kinds may overlap each other.

Spans are (kind, start, end) in code points, the end exclusive. Defined results: null, empty and very long texts are scanned
whole, the first two have no spans; repeated rows are scanned each; of candidates that begin together the longer comes first, then the
earlier kind; without candidates the classifier keeps its prior; an empty table gives an empty result; extra columns are ignored, or
kept by redaction.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.arrow import map_columns
from ravelin.runtime import materialize

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "spelled_email", "local_phone", "national_id", "iban", "name", "card_like", "ip_like")
LABELERS = ("format", "gazetteer", "checksum", "context", "neighbours")
#: Characters before and after a candidate that the context labeler reads; probability from which a candidate is a span.
WINDOW, KEEP = 40, 0.5
#: Distinct sets of inputs that the classifier is fitted on at most; buckets of neighbouring words.
TRAIN_SPANS, WORD_BUCKETS = 20_000, 64

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Patterns that look behind their first character do so after it: a search then skips to places that can begin a match.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*(?:\.[0-9]+){3}")  # a match can only start where a run of digits does
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Sra Sr Don Doña".split()
#: Common given names in the four languages of the corpus.
GIVEN = frozenset("Alice Andreas Anna Antoine Antonio Carlos Carmen Charles Claire Daniel David Elena Elizabeth Emma Francisco François Hans Heinrich Isabel James Jean Jennifer John José Juan Julia Jürgen Karl Laura Linda Louis Luis Manuel Maria María Marie Mary Michael Michel Nathalie Patricia Paul Pedro Peter Philippe Pierre Robert Sarah Sophie Stefan Susan Thomas Ursula William Wolfgang".split())
_NAME = re.compile(rf"\b(?:(?:{'|'.join(_TITLES)})\.? [A-ZÀ-Þ][a-zß-ÿ]{{1,30}}(?: [A-ZÀ-Þ][a-zß-ÿ]{{1,30}})?|(?:{'|'.join(sorted(GIVEN))}) [A-ZÀ-Þ][a-zß-ÿ]{{1,30}})\b")
_CAPITALISED = re.compile(r"[A-ZÀ-Þ](?<!\w[A-ZÀ-Þ])[a-zß-ÿ]+")
_OPENERS = GIVEN.union(_TITLES)
_SPELLED = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z0-9-]{2,63}){1,4}")
_SPELLED_HINT = re.compile(r"[(\[{]dot[)\]}]| dot ")
_LOCAL_PHONE = re.compile(r"[(0-9](?<![0-9+.-][(0-9])(?:(?<=\()[0-9]{3}|(?<=[0-9])[0-9]{2})\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"[A-Z](?<![A-Z0-9][A-Z])[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")

_FOR = {
    "spelled_email": "mail email e-mail contact write kontakt correo courriel",
    "local_phone": "phone tel call fax mobile telefon anruf appel téléphone teléfono llame",
    "national_id": "ssn social security id number nummer numéro número",
    "iban": "iban account bank konto compte cuenta",
    "name": "name contact from by regards signed author von par por",
    "card_like": "card visa credit payment karte carte tarjeta",
    "ip_like": "ip host server address adresse dirección",
}
_CONTEXT = {kind: frozenset(words.split()) for kind, words in _FOR.items()}
_AGAINST = frozenset("version release build chapter section isbn order invoice token password secret hash".split())
_ENDINGS = frozenset("com org net edu gov info io eu de fr es uk ch at it nl".split())
_TOKENS = re.compile(r"[^\W_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from the @ in time linear in the text."""
    last = 0
    for m in _DOMAIN.finditer(text):
        before = text[last : m.start()]
        local = len(before) - len(before.rstrip(_LOCAL))
        if local:
            yield m.start() - local, m.end()
            last = m.end()
        else:
            last = m.start()  # nothing before it can belong to a later match


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and card- and IP-like matches that fail their test."""
    out, failed = [], []
    if "@" in text:
        out += [("email", *x) for x in emails(text)]
    for m in _IP.finditer(text):
        good = all(len(p.lstrip("0")) <= 3 and int(p) <= 255 if len(p) < 20 else not p.lstrip("0") or len(p.lstrip("0")) <= 3 and int(p.lstrip("0")) <= 255 for p in m.group().split("."))
        (out if good else failed).append(("ip" if good else "ip_like", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 14:
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19:
            good = luhn(digits)
            (out if good else failed).append(("card" if good else "card_like", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out, failed


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    if "dot" in text and _SPELLED_HINT.search(text):
        yield from (("spelled_email", *m.span()) for m in _SPELLED.finditer(text))
    yield from (("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text))
    yield from (("national_id", *m.span()) for m in _NATIONAL.finditer(text))
    yield from (("iban", *m.span()) for m in _IBAN.finditer(text))
    if _OPENERS.isdisjoint(_CAPITALISED.findall(text)):
        return
    at = 0
    for word in _CAPITALISED.finditer(text):
        if word.start() >= at and word.group() in _OPENERS and (m := _NAME.match(text, word.start())):
            at = m.end()
            yield "name", *m.span()


def _iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, kind: str, lo: int, hi: int) -> tuple[int, ...]:
    """What each labeler says: 1 personal, -1 not, 0 nothing."""
    found = text[lo:hi]
    digits = "".join(c for c in found if c.isdigit())
    form = {"national_id": 1 if digits[:3] not in ("000", "666") and digits[:1] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1, "local_phone": 1 if digits[:1] not in "01" else -1, "card_like": 0 if digits[:1] in "3456" else -1, "ip_like": -1}.get(kind, 1)
    words = found.split()
    named = kind == "name" and any(w.strip(".") in GIVEN for w in words)
    if kind == "spelled_email":
        gazetteer = 1 if words[-1].lower().rstrip(")]}") in _ENDINGS else -1
    else:
        gazetteer = int(named)
    checksum = (1 if _iban_valid(found) else -1) if kind == "iban" else -1 if kind == "card_like" else 0
    near = {w.lower() for w in _TOKENS.findall(text[max(0, lo - WINDOW) : lo])} | {w.lower() for w in _TOKENS.findall(text[hi : hi + WINDOW // 2])}
    context = 1 if near & _CONTEXT[kind] else -1 if near & _AGAINST else 0
    stuck = text[max(0, lo - 1) : lo] + text[hi : hi + 1]
    neighbours = -1 if any(c.isalnum() or c in "=/_#" for c in stuck) else 0
    return form, gazetteer, checksum, context, neighbours


def merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint ranges that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for _, lo, hi in sorted(spans, key=lambda s: s[1]):
        if ends and lo < ends[-1]:
            ends[-1] = max(ends[-1], hi)
        else:
            starts.append(lo)
            ends.append(hi)
    return starts, ends


#: Groups of the classifier's inputs, each of which has one input at most, and their sizes.
_GROUPS = {"kind": len(KINDS) - len(BASE), **{f"{x}{sign}": 1 for x in LABELERS for sign in "+-"}, "length": 10, "digits": 5, "capitals": 4, "separators": 5, "before": WORD_BUCKETS, "after": WORD_BUCKETS}
_FIRST = dict(zip(_GROUPS, np.cumsum([0, *_GROUPS.values()]).tolist()))
INPUTS = sum(_GROUPS.values())


def inputs(text: str, kind: str, lo: int, hi: int, said: str) -> list[int]:
    """The classifier's inputs that are 1 for a candidate."""
    found = text[lo:hi]
    size = hi - lo
    before, after = _TOKENS.findall(text[max(0, lo - WINDOW) : lo]), _TOKENS.findall(text[hi : hi + WINDOW])
    place = {
        "kind": KINDS.index(kind) - len(BASE),
        "length": min(9, size // 4),
        "digits": 4 * sum(c.isdigit() for c in found) // size,
        "capitals": min(3, 6 * sum(c.isupper() for c in found) // size),
        "separators": min(4, sum(not c.isalnum() for c in found)),
        "before": zlib.crc32(before[-1].lower().encode()) % WORD_BUCKETS if before else None,
        "after": zlib.crc32(after[0].lower().encode()) % WORD_BUCKETS if after else None,
        **{f"{x}{c}": 0 for x, c in zip(LABELERS, said) if c != "0"},
    }
    return [_FIRST[group] + n for group, n in place.items() if n is not None]


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str, list[int]]]]:
    """Base spans; candidates that overlap none of them, with their votes as text like `+00-0` and their inputs."""
    text = text or ""
    base, failed = base_spans(text)
    starts, ends = merged(base)
    out = []
    for kind, lo, hi in sorted([*failed, *candidates(text)], key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        at = bisect_right(ends, lo)
        if at < len(ends) and starts[at] < hi or out and out[-1][2] > lo:
            continue
        said = "".join("-0+"[v + 1] for v in votes(text, kind, lo, hi))
        out.append((kind, lo, hi, said, inputs(text, kind, lo, hi, said)))
    return base, out


def em(patterns: dict[tuple[str, str], int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray, dict[tuple[str, str], float]]:
    """From counts by (kind, votes): how often a kind is personal, each labeler's reliability, each pattern's probability.

    A labeler that speaks is right with its reliability, for either class; Beta priors hold both estimates in bounds.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], dtype=float)
    v = np.array([["-0+".index(c) - 1 for c in k[1]] for k in keys], dtype=float).reshape(-1, len(LABELERS))
    kinds = sorted({k for k, _ in keys})
    of = np.array([kinds.index(k) for k, _ in keys], dtype=int)
    right, share = np.full(len(LABELERS), 0.8), np.full(len(kinds), 0.5)
    p = np.full(len(keys), 0.5)
    for _ in range(rounds):
        z = np.log(share / (1 - share))[of] + v @ np.log(right / (1 - right))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for j in range(len(LABELERS)):
            agree = (n * np.where(v[:, j] > 0, p, np.where(v[:, j] < 0, 1 - p, 0))).sum()
            spoken = (n * (v[:, j] != 0)).sum()
            right[j] = np.clip((agree + 8) / (spoken + 10), 0.55, 0.99)
        for j in range(len(kinds)):
            share[j] = ((n * p)[of == j].sum() + 5) / (n[of == j].sum() + 10)
    return dict(zip(kinds, share.tolist())), right, dict(zip(keys, p.tolist()))


def prior() -> tuple[np.ndarray, np.ndarray]:
    """Mean and precision of the bias and the weights before any candidate is seen."""
    mean, precision = np.zeros(INPUTS + 1), np.ones(INPUTS + 1)
    mean[0] = -1.0
    for x in LABELERS:
        mean[1 + _FIRST[f"{x}+"]], mean[1 + _FIRST[f"{x}-"]] = 1.0, -1.5
    for group in ("length", "digits", "capitals", "separators", "before", "after"):  # they only refine what the votes say
        precision[1 + _FIRST[group] : 1 + _FIRST[group] + _GROUPS[group]] = 10.0
    return mean, precision


def train(rows: list[tuple[list[int], float]]) -> np.ndarray:
    """Bias and weights fitted to (inputs, soft label) of candidates, by Newton's method."""
    mean, precision = prior()
    if not rows:
        return mean
    x, y = np.zeros((len(rows), INPUTS + 1)), np.array([label for _, label in rows])
    x[:, 0] = 1.0
    for i, (places, _) in enumerate(rows):
        x[i, np.array(places, dtype=int) + 1] = 1.0
    w = mean.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(precision), x.T @ (p - y) + precision * (w - mean))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


_SPAN = "struct<kind:string,start:bigint,end:bigint>"
_FOUND = f"base array<{_SPAN}>, extra array<struct<kind:string,start:bigint,end:bigint,votes:string,inputs:array<int>>>"


def _dicts(spans: list[tuple]) -> list[dict]:
    return [dict(zip(("kind", "start", "end", "votes", "inputs"), s)) for s in spans]


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, base spans, and candidates with their votes and inputs."""

    def start():
        def call(texts):
            found = [scan(t) for t in texts]
            return [_dicts(b) for b, _ in found], [_dicts(e) for _, e in found]

        return call

    return map_columns(docs.select(*keep, F.col("text").cast("string").alias("__pii_text")), _FOUND, start, keep=keep)


def classifier(found: DataFrame, spans: int = TRAIN_SPANS) -> np.ndarray:
    """Bias and weights, from the vote patterns of the whole corpus (a bounded number of rows) and at most so many distinct sets of inputs."""
    each = found.select(F.explode("extra").alias("s")).select("s.*")
    patterns = {(r.kind, r.votes): r.n for r in each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not patterns:
        return train([])
    _, _, soft = em(patterns)
    # About a hundredth of the sample, if there are so many, comes from every pattern, so that rare ones are seen too.
    share = min(1.0, spans / sum(patterns.values()))
    chance = F.create_map(*(F.lit(x) for (k, v), n in sorted(patterns.items()) for x in (k + v, min(1.0, max(share, spans / 100 / n)))))
    drawn = F.pmod(F.xxhash64("kind", "start", "end", "inputs"), F.lit(1 << 20)) / float(1 << 20)
    rows = each.filter(drawn < chance[F.concat("kind", "votes")]).groupBy("kind", "votes", "inputs").agg(F.count(F.lit(1)).alias("n"))
    picked = rows.orderBy(F.xxhash64("kind", "votes", "inputs"), "kind", "votes", "inputs").limit(spans).collect()
    return train([(list(r.inputs), soft[r.kind, r.votes]) for r in picked])


def kept(extra: str, weights: np.ndarray) -> F.Column:
    """The candidates that the classifier keeps."""
    table = F.array(*(F.lit(float(w)) for w in weights[1:]))
    least = math.log(KEEP / (1 - KEEP)) - float(weights[0])
    return F.filter(extra, lambda s: F.aggregate(F.transform(s["inputs"], lambda i: F.element_at(table, i + 1)), F.lit(0.0), lambda a, x: a + x) >= least)


def ranked(spans: F.Column) -> F.Column:
    """By start, then kind."""
    order = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    sorted_ = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(sorted_, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def decide(found: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds `spans`: base spans and the candidates that the classifier keeps, by start, then kind."""
    plain = F.transform(kept("extra", weights), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.withColumn("spans", ranked(F.concat("base", plain))).withColumn("base", ranked(F.col("base")))


def joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    found = materialize(scanned(docs, ["doc_id"]), "pii")
    spans = decide(found, classifier(found))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *(count(k) for k in BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact_text(text: str | None, spans: list[dict]) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """All documents and columns, with personal data replaced in text and n_chars counted anew. Texts are scanned once."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    found = materialize(scanned(rows, ["row"]), "pii")
    decided = decide(found, classifier(found)).select("row", F.col("row.text").cast("string").alias("text"), "spans")
    done = map_columns(decided, "clean string", lambda: lambda texts, spans: [[redact_text(t, s) for t, s in zip(texts, spans)]], keep=["row"])
    changed = {"text": F.col("clean"), **({"n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}
    return done.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: personal data in every document."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
