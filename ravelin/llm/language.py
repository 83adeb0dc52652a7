"""Language identification by Bayesian evidence fusion.

Evidence about a page or document, with l the language:

- text: a naive Bayes model of hashed character trigrams, trained from the documents that declare `lang`; as neighbouring
  trigrams aren't independent, n of them count as n^(1/2) observations;
- markup: P(declared language | l), from the pages' own soft counts;
- address: P(suffix of the host | l), likewise;
- prior: P(l | host), smoothed towards the host's domain and that towards the whole corpus.

Soft counts are posteriors of the text alone, summed by grouped aggregation with partial sums before each shuffle; a row's own part is taken out
of its host's and domain's counts, so that it doesn't vouch for itself. A document's source takes the place of its host.

Every language that training documents declare takes part: the model has `BUCKETS` numbers for each, and plans grow with their number.

Defined results: null and empty texts are decided by what else there is, in the end by the corpus prior; very long texts are read whole;
a null url has no host and no suffix; a missing or unknown declaration is a value of its own; ties go to the first language in order;
repeated rows count each; without any labelled document there is no language to choose and `lang` is null; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ravelin.llm.arrow import map_columns
from ravelin.runtime import materialize, prepare

#: Hashed trigrams.
BUCKETS = 1 << 15
#: Rows of a host that meet it in one task; those of larger hosts are dealt to several. Pieces that rows without a host are dealt to.
HOST_ROWS, NO_HOST = 1 << 18, 256
#: Pseudo-counts with which a domain smooths its hosts, and the corpus its domains; exponent of the number of trigrams.
HOST_WEIGHT, DOMAIN_WEIGHT, EXPONENT = 8.0, 20.0, 0.5

_TAG = re.compile(r"<[^>]*>")
_ROOT = re.compile(r"<html\b[^>]*", re.IGNORECASE)
_DECLARED = re.compile(r"\s(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]*)", re.IGNORECASE)
#: Three-letter codes (ISO 639-2, both forms) of languages that also have two letters.
_THREE = dict(pair.split(":") for pair in "ara:ar bul:bg cat:ca ces:cs cze:cs cym:cy wel:cy dan:da deu:de ger:de ell:el gre:el eng:en est:et eus:eu baq:eu fas:fa per:fa fin:fi fra:fr fre:fr gle:ga glg:gl heb:he hin:hi hrv:hr hun:hu hye:hy arm:hy ind:id isl:is ice:is ita:it jpn:ja kat:ka geo:ka kor:ko lat:la lav:lv lit:lt mkd:mk mac:mk msa:ms may:ms nld:nl dut:nl nor:no pol:pl por:pt ron:ro rum:ro rus:ru slk:sk slo:sk slv:sl spa:es sqi:sq alb:sq srp:sr swe:sv tha:th tur:tr ukr:uk vie:vi zho:zh chi:zh".split())
_HOST = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_SECOND_LEVEL = frozenset(("ac", "co", "com", "edu", "gov", "net", "org"))


def visible_text(page: str | None) -> str:
    """Text outside scripts, styles, comments and tags, in time linear in the page."""
    page, out, at = page or "", [], 0
    lowered = page.lower()
    if len(lowered) != len(page):
        page = lowered
    closed: dict[str, bool] = {}
    for m in re.finditer(r"<!--|<script\b|<style\b", lowered):
        if m.start() < at:
            continue
        end = {"<!--": "-->", "<script": "</script", "<style": "</style"}[m.group()]
        if closed.get(end, True):
            stop = lowered.find(end, m.end())
            closed[end] = stop >= 0
            if stop >= 0:
                out.append(page[at : m.start()])
                at = stop + len(end)
                if end != "-->":  # what the closing tag still holds
                    at = max(at, lowered.find(">", at) + 1)
    out.append(page[at:])
    return html.unescape(_TAG.sub(" ", " ".join(out)))


def host_parts(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, domain, suffix): m.a.example.co.uk, example.co.uk, uk."""
    m = _HOST.match(url or "")
    if not m:
        return None, None, None
    labels = m.group(1).lower().strip(".").split(".")
    if len(labels) < 2 or labels[-1].isdigit():
        return ".".join(labels), ".".join(labels), None
    n = 3 if len(labels) > 2 and labels[-2] in _SECOND_LEVEL and len(labels[-1]) == 2 else 2
    return ".".join(labels), ".".join(labels[-n:]), labels[-1]


def declared_language(page: str | None, known: set[str]) -> str:
    """The root element's declaration as one of the known languages, `other` if it isn't one, `none` without one."""
    root = _ROOT.search(page or "")
    m = root and _DECLARED.search(root.group())
    if not m or not m.group(1):
        return "none"
    code = m.group(1).lower()
    return code if code in known else two if (two := _THREE.get(code)) in known else "other"


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of every character trigram of the lower-cased text, with a space at each end."""
    if not text:
        return np.empty(0, dtype=np.int64)
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) ^ c[1:-1] * np.uint64(0x85EBCA77) ^ c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x27D4EB2F)
    return ((h >> np.uint64(16)) % np.uint64(BUCKETS)).astype(np.int64)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log P(trigram | language)), from all documents with a language outside the held-out third."""
    prepare(docs.sparkSession)
    usable = docs.filter(F.col("lang").isNotNull() & ~held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    languages = sorted(r.lang for r in usable.select("lang").distinct().collect())
    schema = _parse_datatype_string("language int, bucket int, n long")
    arrow = to_arrow_schema(schema)
    number = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                if lang in number:
                    total.setdefault(number[lang], np.zeros(BUCKETS, dtype=np.int64))
                    total[number[lang]] += np.bincount(trigrams(text), minlength=BUCKETS)
        for i, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], schema=arrow)

    counts = np.zeros((len(languages), BUCKETS))
    summed = usable.mapInArrow(run, schema).groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    for batch in summed.toArrow().to_batches() if languages else ():  # at most BUCKETS rows for each language
        i, j, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        counts[i, j] = n
    return languages, np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)).astype(np.float32)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_scores(text: str | None, table: np.ndarray) -> list[float]:
    """Tempered log-likelihoods, the best being 0."""
    at = trigrams(text)
    if not len(at) or not len(table):
        return [0.0] * len(table)
    scores = np.array([row[at].sum(dtype=np.float64) for row in table]) * len(at) ** (EXPONENT - 1)
    return (scores - scores.max()).tolist()


_EVIDENCE = "host string, domain string, suffix string, declared string, scores array<double>"


def page_evidence(pages: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """(doc_id null, page_id, host, domain, suffix, declared, scores)."""
    known = set(languages)

    def start():
        def call(urls, sources):
            parts = [host_parts(u) for u in urls]
            declared = [declared_language(s, known) for s in sources]
            return [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], declared, [text_scores(visible_text(s), table) for s in sources]

        return call

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_columns(rows, _EVIDENCE, start, keep=["page_id"]).select(F.lit(None).cast("long").alias("doc_id"), "*")


def document_evidence(docs: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """The same for documents, whose source is their host."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit("source:"), F.col("source").cast("string")).alias("host"), F.col("text").cast("string").alias("text"))
    scored = map_columns(rows, "scores array<double>", lambda: lambda texts: [[text_scores(t, table) for t in texts]], keep=["doc_id", "host"])
    return scored.select("doc_id", F.lit(None).cast("long").alias("page_id"), "host", F.lit("source:").alias("domain"), F.lit(None).cast("string").alias("suffix"), F.lit("none").alias("declared"), "scores")


def _normalized(logs: F.Column) -> F.Column:
    """exp and division by the sum, for logs of which the greatest is near 0."""
    e = F.transform(logs, lambda x: F.exp(x))
    total = F.aggregate(e, F.lit(0.0), lambda s, y: s + y)
    return F.zip_with(e, F.array_repeat(total, F.size(logs)), lambda x, t: x / t)  # the total is computed once, not in the lambda


def _with_hosts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows and what is told of their host. The rows of a very large host, and those without one, are dealt to many tasks."""
    pieces = F.ceil(F.col("rows") / HOST_ROWS).cast("int")
    large = hosts.filter(F.col("rows") > HOST_ROWS).select("host", pieces.alias("pieces"))  # one host in HOST_ROWS rows at most
    drawn = F.xxhash64("doc_id", "page_id", "scores")
    dealt = rows.join(F.broadcast(large), "host", "left").withColumn("piece", F.pmod(drawn, F.when(F.col("host").isNull(), F.lit(NO_HOST)).otherwise(F.coalesce("pieces", F.lit(1)))).cast("int"))
    each = hosts.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1))).drop("rows")
    return dealt.drop("pieces").join(each, ["host", "piece"], "left").drop("piece")


def fuse(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """Adds lang, posterior (of that language) and text_lang."""
    n = len(languages)
    names = F.array(*map(F.lit, languages))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    rows = materialize(evidence.withColumn("soft", _normalized(F.col("scores"))), "evidence")
    sums = lambda: F.array(*(F.sum(F.col("soft")[i]) for i in range(n)))
    corpus = rows.agg(sums().alias("s")).first().s
    total = sum(x or 0.0 for x in corpus)
    base = [((x or 0.0) + 1.0) / (total + n) for x in corpus]
    prior = F.array(*map(F.lit, base))

    def likelihood(counted: DataFrame, column: str) -> DataFrame:
        """log P(value | language) by value, from (value, n): soft counts of a value over those of the language."""
        told = counted.filter(F.col(column).isNotNull()).groupBy(column).agg(F.array(*(F.sum(F.col("n")[i]) for i in range(n))).alias(f"{column}_n"))
        shape = told.agg(F.count(F.lit(1)).alias("values"), *(F.sum(F.col(f"{column}_n")[i]).alias(f"t{i}") for i in range(n))).first()
        over = F.array(*(F.lit(float((shape[i + 1] or 0.0) + 0.5 * (shape[0] or 1))) for i in range(n)))
        return told.select(column, F.zip_with(f"{column}_n", over, lambda a, b: F.log((a + 0.5) / b)).alias(f"{column}_log"))

    # Rows meet their host once; what depends on the domain and the suffix is joined to the hosts, of which there are far fewer.
    hosts = materialize(rows.filter(F.col("host").isNotNull()).groupBy("host", "domain", "suffix").agg(sums().alias("host_n"), F.count(F.lit(1)).alias("rows")), "hosts")
    domains = hosts.groupBy("domain").agg(F.array(*(F.sum(F.col("host_n")[i]) for i in range(n))).alias("domain_n"))
    suffixes = likelihood(hosts.select("suffix", F.col("host_n").alias("n")), "suffix")
    told_hosts = hosts.join(domains, "domain").join(suffixes, "suffix", "left").select("host", "rows", "host_n", "domain_n", "suffix_log")
    zero = F.array(*[F.lit(0.0)] * n)
    declared = likelihood(rows.select("declared", F.col("soft").alias("n")), "declared")  # a row for each language and two more
    joined = _with_hosts(rows.join(F.broadcast(declared), "declared", "left"), told_hosts)
    others = lambda c: F.zip_with(F.coalesce(c, zero), F.when(F.col(c).isNotNull(), F.col("soft")).otherwise(zero), lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def smoothed(counts: F.Column, towards: F.Column, weight: float) -> F.Column:
        size = F.aggregate(counts, F.lit(weight), lambda s, x: s + x)
        return F.zip_with(F.zip_with(counts, towards, lambda a, b: a + weight * b), F.array_repeat(size, n), lambda a, s: a / s)

    by_domain = smoothed(others("domain_n"), prior, DOMAIN_WEIGHT)
    told = joined.withColumn("by_host", smoothed(others("host_n"), by_domain, HOST_WEIGHT))
    parts = ["scores", F.coalesce("declared_log", zero), F.coalesce("suffix_log", zero), F.transform("by_host", lambda x: F.log(x))]
    summed = told.withColumn("logs", reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts))
    final = summed.withColumn("posteriors", _normalized(F.zip_with("logs", F.array_repeat(F.array_max("logs"), n), lambda x, m: x - m)))
    return final.withColumn("lang", best(F.col("posteriors"))).withColumn("posterior", F.array_max("posteriors")).withColumn("text_lang", best(F.col("scores")))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id or page_id, lang, posterior, text_lang, declared, host, held_out) for every page and document."""
    languages, table = train(docs)
    evidence = page_evidence(pages, languages, table).unionByName(document_evidence(docs, languages, table))
    if not languages:
        return evidence.select("doc_id", "page_id", *(F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("posterior", "double"), ("text_lang", "string"))), "declared", "host", held_out().alias("held_out"))
    return fuse(evidence, languages).select("doc_id", "page_id", "lang", "posterior", "text_lang", "declared", "host", held_out().alias("held_out"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: the language of every page and document."""
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
