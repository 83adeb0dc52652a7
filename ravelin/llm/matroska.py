"""Media columns in Matroska: a writer for 8-bit sound, and a parser of EBML into packet tables.

The parser walks variable-length elements (unknown sizes included), tracks, clusters, simple blocks and block groups with no,
Xiph, fixed-size or EBML lacing, and cues; each frame of a block becomes a packet with its track, timestamp in
nanoseconds, byte range and key-frame flag, so that any packet can be read without parsing again. Frames of a lace follow each other by
the track's default duration, or by the length of the frame itself where the codec is PCM. Cues have a table of their own, and `seek`
reads packets from a cued cluster on without touching those before it.

Defined results: a null blob has no packets and no cues; a blob that is no Matroska, breaks off, or has fields of impossible widths raises
ValueError when parsed alone and becomes a row with `error` in a table; a null text is stored like an empty one; very long texts are stored
whole; equal payloads give equal files, whatever row they are in, so repeated rows give equal rows; packets of equal time stay in the
order of the file; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.arrow import map_columns

#: Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE, TIMESTAMP, SCALE = 0xA3, 0xA0, 0xA1, 0xFB, 0xE7, 0x2AD7B1
NUMBER, UID, TYPE, CODEC, LACING, AUDIO, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = frozenset((EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES, BLOCK_GROUP, AUDIO, CUE_POINT, CUE_POSITIONS))
_TOP = frozenset((EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES))

#: The writer's choices: samples a second, bytes of a frame, frames of a laced block, blocks of a cluster. PAD: bytes a payload is filled up to.
HERTZ, FRAME, LACED, BLOCKS, PAD = 8000, 4096, 8, 4, 64


def _number(value: int) -> bytes:
    return value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size of the least width, or of that width."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return _number(ident) + vint(len(body)) + body


def _lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flag and body of a block: fixed-size where frames are equal, EBML else, none for a single one."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return 2, head + b"".join(frames)
    deltas = b""
    for before, now in zip(sizes, sizes[1:-1]):
        width = next(w for w in range(1, 9) if abs(now - before) < (1 << 7 * w - 1) - 1)
        deltas += vint(now - before + (1 << 7 * width - 1) - 1, width)
    return 3, head + vint(sizes[0]) + deltas + b"".join(frames)


def write_pcm(samples: bytes) -> bytes:
    """A Matroska file with one track of unsigned 8-bit mono samples."""
    track = element(NUMBER, b"\x01") + element(UID, b"\x01") + element(TYPE, b"\x02") + element(LACING, b"\x01") + element(CODEC, b"A_PCM/INT/LIT")
    track += element(AUDIO, element(RATE, np.array(HERTZ, dtype=">f8").tobytes()) + element(CHANNELS, b"\x01") + element(DEPTH, b"\x08"))
    head = element(EBML, element(0x4282, b"matroska") + element(0x4287, b"\x04") + element(0x4285, b"\x02"))
    body = [element(INFO, element(SCALE, _number(1_000_000)) + element(0x4D80, b"ravelin") + element(0x5741, b"ravelin")), element(TRACKS, element(TRACK, track))]
    at, cues = sum(map(len, body)), []
    frames = [samples[i : i + FRAME] for i in range(0, len(samples), FRAME)]
    for first in range(0, len(frames), LACED * BLOCKS):
        start = first * FRAME * 1000 // HERTZ
        blocks = []
        for k in range(first, min(first + LACED * BLOCKS, len(frames)), LACED):
            flag, laced = _lace(frames[k : k + LACED])
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + (k * FRAME * 1000 // HERTZ - start).to_bytes(2, "big", signed=True) + bytes([0x80 | flag << 1]) + laced))
        cluster = element(CLUSTER, element(TIMESTAMP, _number(start)) + b"".join(blocks))
        cues.append(element(CUE_POINT, element(CUE_TIME, _number(start)) + element(CUE_POSITIONS, element(CUE_TRACK, b"\x01") + element(CUE_CLUSTER, _number(at)))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    tracks: list[dict] = field(default_factory=list)
    packets: list[dict] = field(default_factory=list)
    cues: list[dict] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    body: int = 0  # where the segment's body begins, from which cues count


def _vint_at(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, next place); None is the unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"number at {at} breaks off")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            return None, at + width
    return value, at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, place, body's place, body's end) of the elements in a range; one of unknown size reaches to the next of its level."""
    while at < end:
        place = at
        ident, at = _vint_at(data, at, True)
        size, at = _vint_at(data, at)
        if size is None:
            stop = at
            while stop < end:  # children, up to an element that can't be one
                kid, _ = _vint_at(data, stop, True)
                if kid in _TOP and (ident == CLUSTER or kid in (EBML, SEGMENT)):
                    break
                _, _, _, stop = next(elements(data, stop, end))
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element {ident:x} at {place} reaches beyond its parent")
        yield ident, place, at, stop
        at = stop


def _unsigned(data: bytes, lo: int, hi: int) -> int:
    return int.from_bytes(data[lo:hi], "big")


def _laced_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    if not lacing:
        return [end - at], at
    if at >= end:
        raise ValueError("laced block without a count")
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % count:
            raise ValueError("fixed-size lacing doesn't divide its block")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for i in range(count - 1):
        if lacing == 1:
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise ValueError("Xiph lacing breaks off")
            size, at = size + data[at], at + 1
        else:
            first = at
            value, at = _vint_at(data, at)
            if value is None:
                raise ValueError("unknown size in a lace")
            size = value if not i else sizes[-1] + value - ((1 << 7 * (at - first) - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("laced frames don't fit their block")
    return [*sizes, last], at


def parse(data: bytes, first_cluster: int | None = None) -> Media:
    """Tracks, packets and cues of a file; with first_cluster (a place in the segment's body, as cues tell it), clusters before it are skipped."""
    try:
        return _parse(data, first_cluster)
    except (TypeError, IndexError, OverflowError, RecursionError) as e:
        raise ValueError(f"broken file: {e}") from e


def _parse(data: bytes, first_cluster: int | None) -> Media:
    media, seen = Media(), False

    def block(lo: int, hi: int, start: int, keyed: bool | None) -> None:
        track, at = _vint_at(data, lo)
        if at + 3 > hi:
            raise ValueError(f"block at {lo} breaks off")
        offset, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
        sizes, at = _laced_sizes(data, at + 3, hi, flags >> 1 & 3)
        owner = next((t for t in media.tracks if t["number"] == track), {"frame_ns": 0, "byte_ns": 0.0})
        when = (start + offset) * media.scale
        for i, size in enumerate(sizes):
            media.packets.append({"track": track, "timestamp": when, "start": at, "end": at + size, "keyframe": bool(flags & 0x80) if keyed is None else keyed, "lace": i})
            at += size
            when += owner["frame_ns"] or round(size * owner["byte_ns"])

    def walk(lo: int, hi: int, start: list[int]) -> None:
        nonlocal seen
        for ident, place, a, b in elements(data, lo, hi):
            if ident == EBML:
                seen = True
            elif not seen:
                raise ValueError("no EBML header")
            elif ident == SEGMENT:
                media.body = a
                walk(a, b, [0])
            elif ident == CLUSTER:
                media.clusters.append(place)
                if first_cluster is None or place - media.body >= first_cluster:
                    walk(a, b, [0])
            elif ident == TIMESTAMP:
                start[0] = _unsigned(data, a, b)
            elif ident == SIMPLE_BLOCK:
                block(a, b, start[0], None)
            elif ident == BLOCK_GROUP:
                inner = {i: (x, y) for i, _, x, y in elements(data, a, b)}
                if BLOCK in inner:
                    block(*inner[BLOCK], start[0], REFERENCE not in inner)
            elif ident == INFO:
                for i, _, x, y in elements(data, a, b):
                    if i == SCALE:
                        media.scale = _unsigned(data, x, y)
            elif ident == TRACKS:
                for i, _, x, y in elements(data, a, b):
                    if i == TRACK:
                        media.tracks.append(_track(data, x, y))
            elif ident == CUES:
                for i, _, x, y in elements(data, a, b):
                    cue = {}
                    for j, _, u, v in elements(data, x, y):
                        if j == CUE_TIME:
                            cue["timestamp"] = _unsigned(data, u, v) * media.scale
                        elif j == CUE_POSITIONS:
                            cue |= {{CUE_TRACK: "track", CUE_CLUSTER: "cluster"}.get(p, "other"): _unsigned(data, q, r) for p, _, q, r in elements(data, u, v)}
                    media.cues.append({"track": cue.get("track"), "timestamp": cue.get("timestamp"), "cluster": cue.get("cluster")})

    walk(0, len(data), [0])
    if not seen:
        raise ValueError("no EBML header")
    return media


def _track(data: bytes, lo: int, hi: int) -> dict:
    track = {"number": 0, "kind": 0, "codec": "", "rate": 0.0, "channels": 1, "bits": 0, "frame_ns": 0, "byte_ns": 0.0}
    for i, _, a, b in elements(data, lo, hi):
        if i == NUMBER:
            track["number"] = _unsigned(data, a, b)
        elif i == TYPE:
            track["kind"] = _unsigned(data, a, b)
        elif i == CODEC:
            track["codec"] = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif i == 0x23E383:  # default duration of a frame
            track["frame_ns"] = _unsigned(data, a, b)
        elif i == AUDIO:
            for j, _, x, y in elements(data, a, b):
                if j == RATE:
                    track["rate"] = _float(data, x, y)
                elif j == CHANNELS:
                    track["channels"] = _unsigned(data, x, y)
                elif j == DEPTH:
                    track["bits"] = _unsigned(data, x, y)
    if track["codec"].startswith("A_PCM") and track["rate"] > 0 and track["channels"] * track["bits"] > 0:
        track["byte_ns"] = 8e9 / (track["rate"] * track["channels"] * track["bits"])
    return track


def _float(data: bytes, lo: int, hi: int) -> float:
    if hi - lo not in (0, 4, 8):
        raise ValueError(f"a float of {hi - lo} bytes at {lo}")
    found = float(np.frombuffer(data[lo:hi], dtype=f">f{hi - lo}")[0]) if hi > lo else 0.0
    if not np.isfinite(found):
        raise ValueError(f"a float at {lo} isn't finite")
    return found


def seek(data: bytes, track: int, timestamp: int) -> list[dict]:
    """Packets of the track from its last cued cluster at or before that time on; from the first cluster without such a cue."""
    cues = [c for c in parse(data, len(data)).cues if c["track"] == track and c["cluster"] is not None and (c["timestamp"] or 0) <= timestamp]
    first = max(cues, key=lambda c: (c["timestamp"] or 0, -c["cluster"]))["cluster"] if cues else 0
    return [p for p in parse(data, first).packets if p["track"] == track]


_PACKET = "struct<track:bigint,timestamp:bigint,start:bigint,end:bigint,keyframe:boolean,lace:int>"
_CUE = "struct<track:bigint,timestamp:bigint,cluster:bigint>"


def _table(blobs: DataFrame, keep: list[str], blob_col: str, kind: str, read) -> DataFrame:
    """A row for each entry that read() takes from a parsed file, and one with `error` for each file that can't be parsed."""

    def start():
        def call(media):
            found, errors = [], []
            for blob in media:
                try:
                    found.append(read(parse(blob)) if blob is not None else [])
                    errors.append(None)
                except ValueError as e:
                    found.append([])
                    errors.append(str(e))
            return found, errors

        return call

    rows = map_columns(blobs.select(*keep, F.col(blob_col).alias("__media")), f"entries array<{kind}>, error string", start, keep=keep)
    entries = F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast(kind))).otherwise(F.col("entries"))
    return rows.select(*keep, F.explode(entries).alias("p"), "error").select(*keep, "p.*", "error")


def packet_table(blobs: DataFrame, keep: list[str], blob_col: str = "media") -> DataFrame:
    """One row per packet of every file (track, timestamp, start, end, keyframe, lace), or one with `error`."""
    return _table(blobs, keep, blob_col, _PACKET, lambda media: media.packets)


def cue_table(blobs: DataFrame, keep: list[str], blob_col: str = "media") -> DataFrame:
    """One row per cue of every file (track, timestamp, cluster: its place in the file), or one with `error`."""
    return _table(blobs, keep, blob_col, _CUE, lambda media: [{**c, "cluster": None if c["cluster"] is None else c["cluster"] + media.body} for c in media.cues])


def payload(text: bytes | None) -> bytes:
    """UTF-8 filled up with bytes 0 to a positive multiple of 64."""
    text = text or b""
    return text + bytes(PAD * max(1, -(-len(text) // PAD)) - len(text))


def feature(samples: bytes, media: Media) -> str:
    """Packets, clusters, cues, length in milliseconds, and the sound's level, peak, crossings of its middle and tone (mean absolute step)."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    step = np.abs(np.diff(x))
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={len(x) * 1000 // HERTZ};rms={float(np.sqrt((x * x).sum() / len(x))):.4f};peak={int(np.abs(x).max())};crossings={crossings};tone={int(step.sum()) / max(1, len(step)):.4f}"


def stored(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, the length of the text in bytes, and its payload as Matroska sound in `media`."""
    rows = docs.select(*keep, F.col("text").cast("binary").alias("__media_text"))
    return map_columns(rows, "n_bytes long, media binary", lambda: lambda texts: ([len(t or b"") for t in texts], [write_pcm(payload(t)) for t in texts]), keep=keep)


def read_back(media: DataFrame, keep: list[str], blob_col: str = "media") -> DataFrame:
    """The columns to keep, the samples read by the packets' byte ranges in time order, and features of them."""

    def start():
        def call(blobs):
            samples, features = [], []
            for blob in blobs:
                parsed = parse(blob)
                ordered = sorted(parsed.packets, key=lambda p: (p["timestamp"], p["start"]))
                samples.append(b"".join([blob[p["start"] : p["end"]] for p in ordered]))
                features.append(feature(samples[-1], parsed))
            return samples, features

        return call

    return map_columns(media.select(*keep, F.col(blob_col).alias("__media")), "samples binary, feature string", start, keep=keep)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every document's payload stored as Matroska sound and read back."""
    media = stored(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    told = media.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    found = read_back(told, ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    tail = F.expr(f"substring(samples, -{PAD}, {PAD})")
    return found.select("doc_id", "n_bytes", F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")

