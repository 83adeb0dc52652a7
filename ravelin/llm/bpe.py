"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

A task numbers the distinct words of its share of the corpus, over many batches of texts, and lays those that it hasn't met before
side by side. An inverted index from merge rank (that is, from token pair) to word positions is built once; then merges are applied
to all words at once in rank order, and each looks up and indexes only the two neighbours that it touched. Where a word holds
a pair several times, its first place merges and the others go back to the index, so that every word gets the merges it
would get alone, in that order. A word of over `LONG` bytes has an index of its own, a heap of (rank, place), so that its time is
linear but for a logarithm. Texts wait as numbers until their words are encoded: `PENDING` new words, `PENDING_CHARS` of their
characters or `NUMBERS` numbers at most, and a batch beyond. A task keeps at most about `WORDS` words and `WORD_CHARS` of their characters.

Defined results: null and empty texts have no tokens and decode to nothing; lone surrogates can't occur in Spark strings; very long
texts and words are encoded whole; repeated rows are encoded each; ties (equal pairs in a word) merge from the left; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ravelin.llm.arrow import give_back, map_columns
from ravelin.runtime import prepare

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words and their characters that a task keeps, the same and numbers that wait for a replay, bytes from which a word is replayed alone.
WORDS, WORD_CHARS, PENDING, PENDING_CHARS, NUMBERS, LONG = 600_000, 32 << 20, 200_000, 4 << 20, 8_000_000, 256

#: Up to U+024F letters, numbers and white space can be listed, so that `re` splits as the general pattern does, and sooner.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \u0085 "
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-\x1b\x20-ɏ]")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Ranks by token, and tokens by rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


@lru_cache(maxsize=4)
def mergeable_pairs(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens that together make a token, as left << 20 | right in order, and that token's rank."""
    ranks, _ = load_ranks(path)
    pairs = {ranks[token[:i]] << 20 | ranks[token[i:]]: rank for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks}
    keys = np.array(sorted(pairs), dtype=np.int64)
    return np.append(keys, np.iinfo(np.int64).max), np.array([*(pairs[k] for k in keys.tolist()), -1], dtype=np.int32)


class _Numbers(dict):
    """Words by number, in the order they were met, and how many characters they have."""

    def __init__(self):
        super().__init__()
        self.chars = 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.chars += len(word)
        return n


class MergeReplay:
    """Encodes texts with the ranks of a file in tiktoken's format."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.tokens = load_ranks(path)
        self.latin = _LATIN if pattern == public_tokenizers.PATTERN else None
        self.general = regex.compile(pattern)
        self.number = _Numbers()
        self.coded: list[bytes] = []  # ids of the words, as far as they have been replayed
        self.coded_chars = 0
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pair_keys, self.pair_values = mergeable_pairs(path)
        self.rank_of: dict[int, int] | None = None  # the pairs again, for single look-ups
        left, right = np.divmod(np.arange(1 << 16), 256)
        self.byte_pairs = self._pair_ranks(self.bytes[left], self.bytes[right]).reshape(256, 256)

    def split(self, text: str) -> list[str]:
        if self.latin and not _BEYOND.search(text):
            return self.latin.findall(text)
        return self.general.findall(text)

    def numbers(self, text: str | None) -> array:
        """The text's words by number. New words wait for settle()."""
        return array("I", map(self.number.__getitem__, self.split(text))) if text else array("I")

    @property
    def due(self) -> bool:
        """Whether enough words or characters wait for a replay."""
        return len(self.number) - len(self.coded) > PENDING or self.number.chars - self.coded_chars > PENDING_CHARS

    def settle(self) -> None:
        """Replay the words that wait."""
        if len(self.number) > len(self.coded):
            self.coded += self._replay([w.encode() for w in islice(self.number, len(self.coded), None)])
            self.coded_chars = self.number.chars

    def ids(self, numbers: array) -> bytes:
        """Ids of a text's settled words, as packed unsigned 32-bit integers."""
        return b"".join(map(self.coded.__getitem__, numbers))

    def forget(self) -> None:
        """Empty the table of words if it has grown beyond its bound. Numbers given before mean nothing then."""
        if len(self.number) > WORDS or self.number.chars > WORD_CHARS:
            self.number, self.coded, self.coded_chars = _Numbers(), [], 0

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        numbers = [self.numbers(t) for t in texts]
        self.settle()
        out = [self.ids(n) for n in numbers]
        self.forget()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype=np.uint32).tolist()))

    def _replay(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        rest = []
        for k, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(word) > LONG:
                out[k] = self._replay_long(word)
            elif word:
                rest.append(k)
        if not rest:
            return out
        sizes = np.array([len(words[k]) for k in rest])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        n = int(ends[-1])
        # at: the token that starts at a byte, -1 if none does; after, before: its neighbours' starts (n: none); pair: rank of
        # the token with its right neighbour, -1 if they don't merge; word: the word it lies in. Place n stands for no place.
        raw = np.frombuffer(b"".join([words[k] for k in rest]), dtype=np.uint8)
        at = np.append(self.bytes[raw], np.int32(-1))
        word = np.append(np.repeat(np.arange(len(rest), dtype=np.int32), sizes), np.int32(-1))
        after = np.append(np.arange(1, n + 1, dtype=np.int32), np.int32(n))
        before = np.append(np.arange(-1, n - 1, dtype=np.int32), np.int32(n))
        after[ends - 1] = n
        before[starts] = n
        pair = np.full(n + 1, -1, dtype=np.int32)
        pair[: n - 1] = self.byte_pairs[raw[:-1], raw[1:]]
        pair[ends - 1] = -1
        merging = np.flatnonzero(pair >= 0).astype(np.int32)
        merging = merging[np.argsort(pair[merging], kind="stable")]
        queue: list[int] = []
        index: dict[int, list[np.ndarray]] = {}

        def put(ranks: np.ndarray, places: np.ndarray) -> None:
            """Index places, which come by rank."""
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, lo, hi in zip(ranks[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(ranks)]):
                if rank in index:
                    index[rank].append(places[lo:hi])
                else:
                    index[rank] = [places[lo:hi]]
                    heappush(queue, rank)

        if len(merging):
            put(pair[merging], merging)
        while queue:
            rank = heappop(queue)
            parts = index.pop(rank)
            i = parts[0] if len(parts) == 1 else np.concatenate(parts)
            i = np.sort(i[pair[i] == rank])  # else a neighbour has changed meanwhile
            if not len(i):
                continue
            own = word[i]
            first = np.ones(len(i), dtype=bool)
            np.not_equal(own[1:], own[:-1], out=first[1:])
            if not first.all():  # later places of a word wait for what the first one brings
                later = i[~first]
                index[rank] = [later[np.append(True, later[1:] != later[:-1])]]
                heappush(queue, rank)
                i = i[first]
            j = after[i]
            k = after[j]
            at[i], at[j], pair[j] = rank, -1, -1
            after[i] = k
            before[k] = i
            left = before[i]
            touched = np.concatenate([i, left[left < n]])
            new = self._pair_ranks(at[touched], at[after[touched]])
            pair[touched] = new
            live = np.flatnonzero(new >= 0)
            if len(live):
                new, touched = new[live], touched[live]
                order = np.argsort(new, kind="stable")
                put(new[order], touched[order])
        live = np.flatnonzero(at[:n] >= 0)
        ids = at[live].astype(np.uint32)
        cuts = (np.searchsorted(live, np.append(starts, n)) * 4).tolist()
        packed = ids.tobytes()
        for k, lo, hi in zip(rest, cuts, cuts[1:]):
            out[k] = packed[lo:hi]
        return out

    def _replay_long(self, word: bytes) -> bytes:
        """The same for one word, whose places are indexed by (rank, place): those of its bytes in order, new ones in a heap."""
        n = len(word)
        raw = np.frombuffer(word, dtype=np.uint8)
        at, after, before = array("i", self.bytes[raw].tobytes()), array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        ranks = np.append(self.byte_pairs[raw[:-1], raw[1:]], np.int32(-1))
        pair, heap = array("i", ranks.astype(np.int32).tobytes()), []
        some = np.flatnonzero(ranks >= 0)
        sorted_keys = np.sort(ranks[some].astype(np.int64) << 40 | some)
        given = (key for lo in range(0, len(sorted_keys), 1 << 14) for key in sorted_keys[lo : lo + (1 << 14)].tolist())
        if self.rank_of is None:
            self.rank_of = dict(zip(self.pair_keys.tolist(), self.pair_values.tolist()))
        rank_of = self.rank_of
        coming = next(given, None)
        while heap or coming is not None:
            if coming is None or heap and heap[0] < coming:
                key = heappop(heap)
            else:
                key, coming = coming, next(given, None)
            rank, i = key >> 40, key & (1 << 40) - 1
            if pair[i] != rank:
                continue
            j = after[i]
            k = after[j]
            at[i], at[j], pair[j], after[i] = rank, -1, -1, k
            if k < n:
                before[k] = i
                pair[i] = new = rank_of.get(rank << 20 | at[k], -1)
                if new >= 0:
                    heappush(heap, new << 40 | i)
            else:
                pair[i] = -1
            if (h := before[i]) >= 0:
                pair[h] = new = rank_of.get(at[h] << 20 | rank, -1)
                if new >= 0:
                    heappush(heap, new << 40 | h)
        ids = np.frombuffer(at, dtype=np.int32)
        return ids[ids >= 0].astype(np.uint32).tobytes()

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make, -1 where there is none (or no right one)."""
        keys = left.astype(np.int64) << 20 | right
        found = np.searchsorted(self.pair_keys, keys)
        return np.where((right >= 0) & (self.pair_keys[found] == keys), self.pair_values[found], np.int32(-1))


def _as_lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype=np.uint32).astype(np.int32)))


def encode(docs: DataFrame, keep: list[str], path: str | None = None, decoded: bool = False) -> DataFrame:
    """The columns to keep and `ids`; with decoded, also what the ids stand for, as `bytes`."""
    prepare(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(*keep, F.col("text").cast("string").alias("__bpe_text"))
    schema = StructType([*rows.schema.fields[: len(keep)], *_parse_datatype_string("ids array<int>" + ", bytes binary" * decoded).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = MergeReplay(path)
        held: list[tuple[list[pa.Array], list[array]]] = []
        waiting = 0

        def settled() -> Iterator[pa.RecordBatch]:
            coder.settle()
            for kept, numbers in held:
                packed = [coder.ids(n) for n in numbers]
                out = [*kept, _as_lists(packed), *([pa.array([coder.decode(p) for p in packed], pa.binary())] if decoded else [])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out, arrow)], schema=arrow)
            held.clear()
            coder.forget()

        for batch in batches:
            numbers = [coder.numbers(t) for t in batch.column(len(keep)).to_pylist()]
            held.append((batch.columns[: len(keep)], numbers))
            waiting += sum(map(len, numbers))
            if coder.due or waiting > NUMBERS:
                yield from settled()
                waiting = 0
        yield from settled()
        del coder
        give_back()

    return rows.mapInArrow(run, schema)


def decode(coded: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns to keep and `bytes`, from column ids; null where an id is unknown or ids are null."""
    path = path or public_tokenizers.path(VOCABULARY)

    def start():
        _, tokens = load_ranks(path)
        return lambda lists: [[None if ids is None or any(i is None or not 0 <= i < len(tokens) for i in ids) else b"".join([tokens[i] for i in ids]) for ids in lists]]

    return map_columns(coded.select(*keep, "ids"), "bytes binary", start, keep=keep)


def digests(docs: DataFrame) -> DataFrame:
    coded = encode(docs, ["doc_id"], decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: ids of every document, and the bytes they decode to."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
