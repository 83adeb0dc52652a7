"""Secret scans by character Markov models.

Base patterns give assignments, access keys and long hexadecimal strings. Other runs of key-like characters are
candidates, and two first-order character models score them: one of random strings, trained from the values
that base patterns label and from generated samples, one of ordinary identifiers, trained from the corpus's words outside base spans. Both
are counts of character pairs, summed over the whole corpus before anything leaves its task. A candidate is a
secret if its log-likelihood ratio exceeds a threshold per character and in total. Base spans always stay.

Texts are scanned once: the pass that counts also writes each text's base spans and candidates, which are scored when the models are known.

Spans are (kind, start, end) in code points, the end exclusive. Defined results: null, empty and very long texts are scanned
whole, the first two have no spans; repeated rows are scanned each; without any text the models rest on the generated samples;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ravelin.llm.arrow import give_back, map_columns
from ravelin.runtime import materialize, prepare

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
#: Least log-likelihood ratio per character and in total; characters a candidate has at least; generated strings of each kind.
PER_CHARACTER, IN_TOTAL, SHORTEST, GENERATED = 0.35, 12.0, 16, 2_000

_ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+))""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}")
#: Names of the assign pattern, one of which a text must hold; a space for what is no part of a word.
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_WORDS = bytes(c if re.match(r"(?a:[A-Za-z0-9_+/-])", chr(c)) else 32 for c in range(256))

ALPHABET = string.ascii_letters + string.digits + "+/_-="
SIZE = len(ALPHABET) + 1  # and a place before the first character
_CODE = np.full(256, 255, dtype=np.uint8)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, SIZE)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    lowered = text.lower()
    out = []
    if any(name in lowered for name in _NAMES):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Key-like runs that overlap no base span."""
    taken = sorted((lo, hi) for _, lo, hi in base)
    i = 0
    for m in _CANDIDATE.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i == len(taken) or taken[i][0] >= m.end():
            yield m.span()


def pair_counts(words: list[str]) -> np.ndarray:
    """Counts of (character, next character), the first being 0 before each word."""
    joined = _CODE[np.frombuffer("".join(words).encode("latin-1", "replace"), dtype=np.uint8)].astype(np.int64) if words else np.empty(0, np.int64)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    before = np.append(0, joined[:-1]) if len(joined) else joined
    starts = np.cumsum(sizes) - sizes
    before[starts[sizes > 0]] = 0
    known = (joined != 255) & (before != 255)
    return np.bincount(before[known] * SIZE + joined[known], minlength=SIZE * SIZE)


def generated(seed: int = 7, n: int = GENERATED) -> list[str]:
    """Random strings over the alphabets that keys use."""
    rnd = random.Random(seed)
    sets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)
    return ["".join(rnd.choices(chars, k=rnd.randrange(16, 65))) for chars in sets for _ in range(n)]


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def words_in(text: str) -> list[str]:
    """Runs of [A-Za-z0-9_+/-]."""
    return text.encode("latin-1", "replace").translate(_WORDS).decode("ascii").split()


def parts(text: str, base: list[tuple[str, int, int]]) -> tuple[list[str], list[str]]:
    """(labelled secrets, words outside base spans); base spans come by start."""
    values: list[str] = []
    words: list[str] = []
    at = 0
    for kind, lo, hi in base:
        if lo >= at:
            words += words_in(text[at:lo])
            values.append(_ASSIGN.match(text, lo).group(1) if kind == "assign" else text[lo:hi])
        at = max(at, hi)
    words += words_in(text[at:])
    return values, words


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, `base` spans and `candidates` of every row; and for each task a row with nulls but for `pairs`.

    pairs: how often a character follows another (secret, pair, n) in labelled secrets and in other words, summed over the task.
    """
    prepare(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").cast("string").alias("__secret_text"))
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields[: len(keep)]] + _parse_datatype_string(f"base {_SPANS}, candidates array<struct<start:bigint,end:bigint,word:string>>, pairs array<struct<secret:boolean,pair:int,n:bigint>>").fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE * SIZE), dtype=np.int64)
        for batch in batches:
            values: list[str] = []
            words: list[str] = []
            bases, found = [], []
            for text in batch.column(len(keep)).to_pylist():
                base = in_order(base_spans(text)) if text else []
                bases.append([dict(zip(("kind", "start", "end"), s)) for s in base])
                found.append([{"start": lo, "end": hi, "word": text[lo:hi]} for lo, hi in candidates(text, base)] if text else [])
                if text:
                    secret, other = parts(text, base)
                    values += secret
                    words += other
            total[1] += pair_counts(values)
            total[0] += pair_counts(words)
            out = [*batch.columns[: len(keep)], pa.array(bases, arrow.field("base").type), pa.array(found, arrow.field("candidates").type), pa.nulls(len(bases), arrow.field("pairs").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow)
        told = [{"secret": bool(secret), "pair": int(i), "n": int(total[secret][i])} for secret in (0, 1) for i in np.flatnonzero(total[secret])]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(arrow)[:-1]), pa.array([told], arrow.field("pairs").type)], schema=arrow)
        give_back()

    return rows.mapInArrow(run, schema)


def log_ratios(ordinary: np.ndarray, secret: np.ndarray) -> np.ndarray:
    """log P(next | character) under the model of secrets less that under the model of ordinary words."""
    tables = []
    for n in (secret, ordinary):
        n = n.reshape(SIZE, SIZE).astype(float)
        shared = (n.sum(axis=0) + 1) / (n.sum() + SIZE)  # what follows in general, for characters seldom seen
        tables.append((n + 20 * shared) / (n.sum(axis=1, keepdims=True) + 20))
    return np.log(tables[0]) - np.log(tables[1])


def train(found: DataFrame) -> np.ndarray:
    """The ratio table from scanned rows; at most 2 * SIZE^2 counts reach the driver."""
    total = np.zeros((2, SIZE * SIZE))
    pairs = found.filter(F.col("pairs").isNotNull()).select(F.inline("pairs")).groupBy("secret", "pair").agg(F.sum("n").alias("n"))
    for r in pairs.collect():
        total[int(r.secret), r.pair] = r.n
    own = pair_counts(generated())
    weight = max(1.0, total[1].sum() / own.sum())  # generated strings count as much as labelled ones
    return log_ratios(total[0] if total[0].sum() else pair_counts(["example", "identifier", "configuration"]), total[1] + own * weight)


def ratio(word: str, table: np.ndarray) -> float:
    codes = _CODE[np.frombuffer(word.encode("latin-1", "replace"), dtype=np.uint8)].astype(np.int64)
    return float(table[np.append(0, codes[:-1]), codes].sum())


def is_secret(word: str, table: np.ndarray) -> bool:
    score = ratio(word, table)
    return score >= IN_TOTAL and score >= PER_CHARACTER * len(word)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """By start, then kind."""
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def decided(found: DataFrame, keep: list[str], table: np.ndarray) -> DataFrame:
    """The columns to keep, `base` spans and all `spans` of scanned rows."""

    def start():
        def call(bases, candidates):
            out = []
            for base, own in zip(bases, candidates):
                extra = [{"kind": "random", "start": c["start"], "end": c["end"]} for c in own if is_secret(c["word"], table)]
                out.append(sorted([*base, *extra], key=lambda s: (s["start"], KINDS.index(s["kind"]))) if extra else base)
            return [out]

        return call

    rows = found.filter(F.col("pairs").isNull()).select(*keep, "base", F.col("base").alias("__base"), "candidates")
    return map_columns(rows, f"spans {_SPANS}", start, keep=[*keep, "base"])


def secrets_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, `base` spans and all `spans` of every row."""
    found = materialize(scanned(docs, keep), "secrets")
    return decided(found, keep, train(found))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: secrets in every document."""
    found = secrets_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
