"""SimHash near-duplicate classes by pivot distance tables.

A text's fingerprint holds, per bit, whether over half of its shingle hashes have that bit. Fingerprints
within `RADIUS` differing bits are linked; a class is a connected component of links.

Pairs are found among distinct fingerprints only. Every pair within the radius agrees on at least
`BANDS - RADIUS` of `BANDS` bit bands, so fingerprints meet under each choice of that many bands. A meeting of more than `BUCKET`
fingerprints is dealt out once more: the bits that its choice leaves open are cut into `PARTS` bands for each band, all but
`RADIUS` of which a pair within the radius has in common again. What meets then differs in so few bits (8 for a radius of 2) that its
size is bounded (by 256). Wherever fingerprints meet, the distances to all pivots are computed once per fingerprint; pairs whose
largest coordinate difference exceeds the radius cannot be links (triangle inequality) and are discarded, survivors are verified.

Defined results: null and wordless texts have fingerprint zero and are linked like any other; very long texts are shingled whole; a
bit that exactly half of the hashes have is 0; repeated rows stay and share their class; a null doc_id is ignored in the minimum (null if a
class has no other); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.arrow import map_columns
from ravelin.llm.components import connected_components
from ravelin.runtime import materialize

SHINGLE, SEED, RADIUS, BANDS, BUCKET, PARTS, PIVOTS = 3, 42, 2, 4, 64, 4, 32
#: Bytes of a table of row numbers that is broadcast, a larger one being joined by a shuffle; what a row of it takes there.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 96


def fingerprint(data: bytes | None, width: int = SHINGLE) -> int:
    """SimHash of UTF-8 text, as a signed 64-bit integer."""
    words = (data or b"").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    hashes = np.array([digest(join(s), SEED) for s in shingles], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_columns(rows, "fp long", lambda: lambda texts: [[fingerprint(t) for t in texts]], keep=["doc_id"])


def pivot_table(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(n)], dtype=np.uint64)


def links_within(values: np.ndarray, bounds: np.ndarray, radius: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked fingerprints that lie in the same run; bounds are the runs' limits in values."""
    table = np.bitwise_count(values[:, None] ^ pivots[None, :]).astype(np.int8)
    sizes, starts = np.diff(bounds), bounds[:-1]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(size, 1)
        step = max(1, (1 << 18) // len(i))
        own = starts[sizes == size]
        for at in range(0, len(own), step):
            a = (own[at : at + step, None] + i).ravel()
            b = (own[at : at + step, None] + j).ravel()
            near = np.abs(table[a] - table[b]).max(axis=1) <= radius
            a, b = a[near], b[near]
            same = np.bitwise_count(values[a] ^ values[b]) <= radius
            left.append(a[same])
            right.append(b[same])
    return np.concatenate(left), np.concatenate(right)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(bits: list[int], n: int) -> list[int]:
    """Masks of n runs of bits, as equal as can be."""
    edges = [round(i * len(bits) / n) for i in range(n + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(edges, edges[1:])]


def choices(radius: int, bands: int = BANDS, parts: int = PARTS) -> tuple[list[int], list[list[int]]]:
    """Masks of the bits that fingerprints have in common where they meet: at first, and (by first choice) once more."""
    first = [sum(pick) for pick in combinations(_cut([*range(64)], bands), bands - radius)]
    again = []
    for mask in first if radius else ():
        cut = _cut([b for b in range(64) if not mask >> b & 1], parts * radius)
        again.append([mask | sum(pick) for pick in combinations(cut, len(cut) - radius)])
    return first, again


def _paired(met: DataFrame, radius: int, pivots: np.ndarray) -> DataFrame:
    """Links (a, b), a < b, among the fingerprints of each row's list fps."""

    def start():
        def call(members):
            bounds = np.cumsum([0, *map(len, members)])
            flat = np.fromiter((x for run in members for x in run), dtype=np.int64, count=bounds[-1])
            a, b = links_within(flat.view(np.uint64), bounds, radius, pivots)
            which = np.searchsorted(bounds, a, side="right") - 1
            order = np.argsort(which, kind="stable")
            ends = pa.array(np.searchsorted(which[order], np.arange(len(members) + 1)), pa.int32())
            x, y = flat[a[order]], flat[b[order]]
            return [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (np.minimum(x, y), np.maximum(x, y))]

        return call

    return map_columns(met.select("fps"), "a array<long>, b array<long>", start).select(F.explode(F.arrays_zip("a", "b")).alias("e")).select("e.a", "e.b")


def links(values: DataFrame, radius: int = RADIUS, bands: int | None = None, bucket: int = BUCKET, parts: int = PARTS, n_pivots: int = PIVOTS) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints of column fp that differ in at most radius bits."""
    first, again = choices(radius, bands or radius + 2, parts)
    pivots = pivot_table(n_pivots)
    masked = lambda masks: F.array(*(F.struct(F.lit(k).cast("smallint").alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(masks)))
    keys = values.select(F.explode(masked(first)).alias("key"), "fp").select("key.*", "fp")
    sizes = keys.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = materialize(keys.join(sizes, ["choice", "bits"]), "met")
    gathered = lambda rows, *by: rows.groupBy(*by).agg(F.collect_list("fp").alias("fps"))
    found = _paired(gathered(met.filter(F.col("members") <= bucket), "choice", "bits"), radius, pivots)
    if radius:
        masks = F.array(*(F.array(*(F.lit(_signed(m)) for m in own)) for own in again))
        dealt = met.filter(F.col("members") > bucket).withColumn("masks", F.element_at(masks, F.col("choice") + 1))
        dealt = dealt.select("choice", F.posexplode("masks").alias("part", "mask"), "fp").select("choice", "part", F.expr("fp & mask").alias("bits"), "fp")
        found = found.unionByName(_paired(gathered(dealt, "choice", "part", "bits").filter(F.size("fps") > 1), radius, pivots))
    return found.distinct()


def classes(prints: DataFrame) -> DataFrame:
    """Adds root and component_id to materialized rows with doc_id and fp; root names the class where ids are null."""
    values = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "values")
    roots = connected_components(links(values.select("fp")))
    rooted = values.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(least, "root"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document."""
    found = classes(materialize(fingerprints(docs), "prints"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """All columns of one row of each class: that of the least doc_id (null if there is no other); of rows repeating it, the first.

    Rows are numbered and written with their fingerprints; what is shuffled is numbers and fingerprints. Only where the numbers
    to drop (and those to keep) exceed `BROADCAST_BYTES` are whole rows joined by a shuffle.
    """
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    printed = materialize(map_columns(rows, "fp long", lambda: lambda texts: [[fingerprint(t) for t in texts]], keep=["row", "uid", "doc_id"]), "printed")
    rooted = classes(printed.select("uid", "doc_id", "fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "uid"))
    kept = materialize(rooted.groupBy("root").agg(first.alias("k")).select("k.uid"), "kept")
    n, n_kept = printed.count(), kept.count()  # from the files' footers
    if ROW_BYTES * (n - n_kept) <= BROADCAST_BYTES:
        dropped = materialize(printed.select("uid").join(kept, "uid", "left_anti"), "dropped")
        return printed.join(F.broadcast(dropped), "uid", "left_anti").select("row.*")
    if ROW_BYTES * n_kept <= BROADCAST_BYTES:
        return printed.join(F.broadcast(kept), "uid", "left_semi").select("row.*")
    return printed.join(kept, "uid", "left_semi").select("row.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: near-duplicate classes of whole documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
