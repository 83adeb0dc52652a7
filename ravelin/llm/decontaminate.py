"""Benchmark decontamination by Wu-Manber search over words.

A benchmark item gives its windows of `WINDOW` consecutive words, or itself as one window if it is shorter.
Windows of equal length share a table: blocks of two words, hashed, with the distance by which the search may advance when that
block ends the place looked at; where that is zero, the bucket of the block's hash holds the windows that end so, in order of their
words, and a direct comparison of all words finds the one that is meant. A word that no item has rules out every window over it.

Tables are flat arrays over numbered words, made once and broadcast, in groups whose tables take at most about `TABLE_BYTES`; a
larger benchmark takes several passes, each adding to the hits of every row. A long item is dealt to several groups where needed.

Defined results: null and wordless texts have no words and no hits; null, empty and wordless items have no
windows; very long texts and items are searched whole; a null item_id marks words but is not listed; a repeated item_id counts
once; repeated documents each give their row; with an empty benchmark nothing is hit; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.arrow import map_columns
from ravelin.runtime import materialize

WINDOW, TABLE_BYTES = 10, 128 << 20
#: What a word of an item and a distinct word take in the tables of a group, generously.
WORD_BYTES, DISTINCT_BYTES = 64, 160
_MIX = 0x9E3779B1

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 text: runs of ASCII letters and digits and of anything beyond ASCII."""
    return (text or b"").translate(_FOLD).split()


class WuManber:
    """Windows of one length: they begin at `starts` in the numbered words of all items, and belong to `owners`."""

    def __init__(self, length: int, words: np.ndarray, starts: np.ndarray, owners: np.ndarray):
        self.length, block = length, min(2, length)
        m = words[starts[:, None] + np.arange(length)]
        order = np.lexsort((owners, *m.T[::-1]))
        m, starts, owners = m[order], starts[order], owners[order]
        fresh = np.append(True, (m[1:] != m[:-1]).any(axis=1))
        mine = fresh | np.append(True, owners[1:] != owners[:-1])  # an item may repeat a window
        number = np.cumsum(fresh) - 1
        bits = max(10, int(4 * fresh.sum()).bit_length())
        self.mask = (1 << bits) - 1
        m = m[fresh].astype(np.int64)
        hashed = lambda a, b: (a * _MIX + b) & self.mask
        suffix = hashed(m[:, -2], m[:, -1]) if block == 2 else m[:, -1] & self.mask
        place = np.argsort(suffix, kind="stable")
        self.words, self.starts = words, starts[fresh][place]
        self.head = np.searchsorted(suffix[place], np.arange((1 << bits) + 1)).astype(np.int32)
        ends = np.append(0, np.cumsum(np.bincount(number[mine], minlength=len(m))))
        self.owners, self.own = owners[mine], np.stack([ends[place], ends[place + 1]], axis=1).astype(np.int32)
        self.furthest = length - block + 1
        shift = np.full(1 << bits, min(255, self.furthest), dtype=np.uint8)
        if block == 2:
            for end in range(2, length + 1):
                np.minimum.at(shift, hashed(m[:, end - 2], m[:, end - 1]), min(255, length - end))
        self.shift = shift.tobytes()

    def search(self, text: list[bytes], number: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, items) of every occurrence."""
        length, n, get, shift, mask = self.length, len(text), number.get, self.shift, self.mask
        if length == 1:
            for i, w in enumerate(text):
                if (b := get(w, -1)) >= 0:
                    yield from ((i, x) for x in self._confirmed(b & mask, [b]))
            return
        at = length - 1
        while at < n:
            b = get(text[at], -1)
            if b < 0:
                at += length
                continue
            a = get(text[at - 1], -1)
            if a < 0:
                at += length - 1
                continue
            h = (a * _MIX + b) & mask
            if step := shift[h]:
                at += step
                continue
            own = [get(w, -1) for w in text[at - length + 1 : at + 1]]
            if -1 not in own:
                yield from ((at - length + 1, x) for x in self._confirmed(h, own))
            at += 1

    def _confirmed(self, h: int, own: list[int]) -> Iterator[np.ndarray]:
        """Items of the window that is those words, if there is one."""
        lo, hi, size = int(self.head[h]), int(self.head[h + 1]), self.length
        if lo == hi:
            return
        window = lambda k: self.words[(at := self.starts[k]) : at + size].tolist()
        k = bisect_left(range(hi), own, lo, key=window)
        if k < hi and window(k) == own:
            yield self.owners[self.own[k, 0] : self.own[k, 1]]


class Benchmark:
    """Search tables for a group of items."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.names: list[str | None] = []
        self.number: dict[bytes, int] = {}
        flat: list[np.ndarray] = []
        places: dict[int, list[tuple[np.ndarray, int]]] = {}
        at = 0
        for name, words in items:
            if not words:
                continue
            number = self.number
            flat.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int32))
            size = min(window, len(words))
            places.setdefault(size, []).append((np.arange(at, at + len(words) - size + 1), len(self.names)))
            self.names.append(name)
            at += len(words)
        words = np.concatenate([*flat, np.empty(0, np.int32)])
        self.tables = [WuManber(size, words, np.concatenate([s for s, _ in own]), np.concatenate([np.full(len(s), i, np.int32) for s, i in own])) for size, own in sorted(places.items())]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [first, end) that are hit, and the names of the items that hit them."""
        ranges: list[tuple[int, int]] = []
        owners: set[int] = set()
        for table in self.tables:
            for first, items in table.search(words, self.number):
                ranges.append((first, first + table.length))
                owners.update(items.tolist())
        return ranges, {self.names[i] for i in owners if self.names[i] is not None}


def merge(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def item_groups(benchmark: DataFrame, window: int = WINDOW, most: int = TABLE_BYTES) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items (name, words) in groups whose tables take about so many bytes, read from Spark one partition at a time.

    An item that is too large for a group goes on in the next, from its last words, so that no window is lost.
    """
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    group: list[tuple[str | None, list[bytes]]] = []
    seen: set[bytes] = set()
    size, longest = 0, max(2 * window, most // (WORD_BYTES + DISTINCT_BYTES))
    for name, text in rows.toLocalIterator():
        words = words_of(bytes(text or b""))
        for lo in range(0, max(1, len(words) - window + 1), longest - window + 1):
            part = words[lo : lo + longest]
            cost = WORD_BYTES * len(part) + DISTINCT_BYTES * len(fresh := set(part) - seen)
            if group and size + cost > most:
                yield group
                group, size, seen = [], 0, set()
                cost = WORD_BYTES * len(part) + DISTINCT_BYTES * len(fresh := set(part))
            group.append((name, part))
            seen |= fresh
            size += cost
    yield group


def hits(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, most: int = TABLE_BYTES) -> DataFrame:
    """Struct `row` of the columns to keep (all, if not said), n_words, flat (first, end, first, end ... of hit words) and item ids."""
    at = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col("text").cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<bigint>)").alias("flat"), F.expr("cast(array() as array<string>)").alias("items"))
    groups = item_groups(benchmark, window, most)
    group: list | None = next(groups)
    while group is not None:
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(group, window))
        following = next(groups, None)

        def start(shared=shared):
            tables = shared.value  # a worker process keeps it from task to task

            def call(texts, _, flats, found):
                counts, out, items = [], [], []
                for text, flat, had in zip(texts, flats, found):
                    words = words_of(text)
                    ranges, own = tables.scan(words)
                    counts.append(len(words))
                    out.append([x for r in merge([*zip(flat[::2], flat[1::2]), *ranges]) for x in r] if ranges else flat)
                    items.append([*own.union(had)])
                return counts, out, items

            return call

        passed = ["row"]
        if following is not None:  # the text goes on to the next pass
            at, passed = at.withColumn("again", F.col("text")), ["row", "again"]
        at = map_columns(at, "n_words long, flat array<long>, items array<string>", start, keep=passed)
        if following is not None:
            at = materialize(at.withColumnRenamed("again", "text").select("row", "text", "n_words", "flat", "items"), "hits")
        group = following
    return at


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document, the words it shares with the benchmark."""
    found = hits(docs, benchmark, keep=["doc_id"])
    n_hit = F.expr("aggregate(flat, 0L, (s, x) -> x - s)")  # alternating differences: ends less starts
    return found.select("row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("flat") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of the documents that hold no window of the benchmark."""
    return hits(docs, benchmark).filter(F.size("flat") == 0).select("row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: contamination of whole documents by whole benchmark items."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same by joins on the words' windows.
OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT row_number() OVER () AS i, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS t
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM p),
o AS (
  SELECT x.r, x.s, p.m, p.item_id
  FROM (SELECT r, m, s, array_to_string(w[s:s + m - 1], ' ') AS t
        FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, lengths WHERE len(w) >= m)) x
  JOIN p ON p.m = x.m AND p.t = x.t),
h AS (SELECT r, count(DISTINCT word) AS n FROM (SELECT r, unnest(range(s, s + m)) AS word FROM o) GROUP BY r),
n AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM o WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
