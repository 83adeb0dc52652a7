"""Matroska, WARC and language."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import random
import zlib

import duckdb
import edge
import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin.llm import language
from ravelin.llm import matroska as mkv
from ravelin.llm import warc


def brute(text):
    """The payload's digests without any file."""
    p = text + bytes(64 * max(1, -(-len(text) // 64)) - len(text))
    return len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])


def samples_of(blob):
    return b"".join(blob[p["start"] : p["end"]] for p in mkv.parse(blob).packets)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300_000), st.integers(0, 255))
def test_round_trip(size, seed):
    data = np.random.default_rng(seed).integers(0, 256, size, dtype=np.uint8).tobytes()
    blob = mkv.write_pcm(data)
    media = mkv.parse(blob)
    assert samples_of(blob) == data and media.tracks[0]["codec"] == "A_PCM/INT/LIT" and media.tracks[0]["rate"] == mkv.HERTZ
    times = [p["timestamp"] for p in media.packets]
    assert times == [i * mkv.FRAME * 1000 // mkv.HERTZ * 1_000_000 for i in range(len(times))]
    for when in (0, times[-1] // 2, times[-1]):
        own = mkv.seek(blob, 1, when)
        assert own == [p for p in media.packets if p["timestamp"] >= own[0]["timestamp"]] and own[0]["timestamp"] <= when
        assert when - own[0]["timestamp"] < mkv.FRAME * mkv.LACED * mkv.BLOCKS * 1_000_000_000 // mkv.HERTZ
    assert mkv.seek(blob, 2, 0) == []
    assert [c["cluster"] for c in media.cues] == [c - media.clusters[0] + media.cues[0]["cluster"] for c in media.clusters]
    assert all(blob[c : c + 4] == b"\x1fC\xb6u" for c in media.clusters)


def file(*blocks, unknown=False):
    track = mkv.element(mkv.TRACKS, mkv.element(mkv.TRACK, mkv.element(mkv.NUMBER, b"\x02") + mkv.element(mkv.TYPE, b"\x01") + mkv.element(mkv.CODEC, b"V_TEST")))
    body = mkv.element(mkv.TIMESTAMP, b"\x64") + b"".join(blocks)
    if unknown:
        clusters = (b"\x1fC\xb6u\xff" + body) * 2
        return mkv.element(mkv.EBML, b"") + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + track + clusters
    return mkv.element(mkv.EBML, b"") + mkv.element(mkv.SEGMENT, track + mkv.element(mkv.CLUSTER, body))


def block(flags, body, ident=mkv.SIMPLE_BLOCK, at=5):
    return mkv.element(ident, b"\x82" + at.to_bytes(2, "big", signed=True) + bytes([flags]) + body)


def test_lacings_groups_and_unknown_sizes():
    xiph = block(0x02, b"\x02\xff\x05\x03" + b"a" * 260 + b"b" * 3 + b"c" * 4)
    ebml = block(0x86, b"\x02" + mkv.vint(300) + (0x4000 | 0x1FFF - 200).to_bytes(2, "big") + b"d" * 300 + b"e" * 100 + b"f", at=-7)
    fixed = block(0x04, b"\x01" + b"gghh")
    group = mkv.element(mkv.BLOCK_GROUP, block(0, b"key", mkv.BLOCK))
    delta = mkv.element(mkv.BLOCK_GROUP, block(0, b"other", mkv.BLOCK) + mkv.element(mkv.REFERENCE, b"\x01"))
    blob = file(xiph, mkv.element(0xEC, b"void"), ebml, fixed, group, delta)
    got = [(blob[p["start"] : p["end"]], p["timestamp"] // 1_000_000, p["keyframe"], p["track"]) for p in mkv.parse(blob).packets]
    assert got == [(b"a" * 260, 105, False, 2), (b"bbb", 105, False, 2), (b"cccc", 105, False, 2), (b"d" * 300, 93, True, 2), (b"e" * 100, 93, True, 2), (b"f", 93, True, 2), (b"gg", 105, False, 2), (b"hh", 105, False, 2), (b"key", 105, True, 2), (b"other", 105, False, 2)]
    open_ended = file(fixed, unknown=True)
    media = mkv.parse(open_ended)
    assert [open_ended[p["start"] : p["end"]] for p in media.packets] == [b"gg", b"hh"] * 2 and len(media.clusters) == 2


def test_laced_frames_last_as_long_as_they_are():
    audio = mkv.element(mkv.AUDIO, mkv.element(mkv.RATE, np.array(8000, dtype=">f4").tobytes()) + mkv.element(mkv.CHANNELS, b"\x01") + mkv.element(mkv.DEPTH, b"\x08"))
    track = mkv.element(mkv.TRACKS, mkv.element(mkv.TRACK, mkv.element(mkv.NUMBER, b"\x02") + mkv.element(mkv.CODEC, b"A_PCM/INT/LIT") + audio))
    cluster = mkv.element(mkv.CLUSTER, mkv.element(mkv.TIMESTAMP, b"\x00") + block(0x04, b"\x01" + b"x" * 1600, at=0))
    packets = mkv.parse(mkv.element(mkv.EBML, b"") + mkv.element(mkv.SEGMENT, track + cluster)).packets
    assert [p["timestamp"] for p in packets] == [0, 100_000_000]  # 800 samples at 8 kHz


def test_cues(spark):
    blob = mkv.write_pcm(bytes(range(256)) * 1500)
    rows = mkv.cue_table(spark.createDataFrame([(1, blob), (2, None), (3, b"no")], "media_id long, media binary"), ["media_id"]).collect()
    own = [r for r in rows if r.media_id == 1]
    assert [r.cluster for r in own] == mkv.parse(blob).clusters and all(r.error is None and r.track == 1 for r in own)
    assert [r.media_id for r in rows if r.error] == [3]


def odd_fields():
    """Files with fields of impossible widths."""
    for ident, bodies in ((mkv.RATE, [b"abc", b"\x7f\xf0" + bytes(6), bytes(9)]), (mkv.CHANNELS, [bytes(300)]), (mkv.DEPTH, [b""])):
        for body in bodies:
            track = mkv.element(mkv.TRACKS, mkv.element(mkv.TRACK, mkv.element(mkv.NUMBER, b"\x02") + mkv.element(mkv.CODEC, b"A_PCM") + mkv.element(mkv.AUDIO, mkv.element(ident, body))))
            yield mkv.element(mkv.EBML, b"") + mkv.element(mkv.SEGMENT, track + mkv.element(mkv.CLUSTER, mkv.element(mkv.TIMESTAMP, bytes(20)) + block(0x04, b"\x01gghh")))


def test_odd_fields_never_kill_a_job(spark):
    blobs = [*odd_fields()]
    for cut in range(0, 400, 7):
        blobs.append(mkv.write_pcm(b"x" * 9000)[:cut] + bytes([cut % 256]) * 40)
    for blob in blobs:
        try:
            mkv.parse(blob)
        except ValueError:
            pass
    with pytest.raises(ValueError):
        mkv.parse(blobs[0])
    deep = mkv.element(mkv.EBML, b"") + mkv.element(mkv.SEGMENT, mkv.element(mkv.CLUSTER, b"\xa0\xff" * 5000))
    with pytest.raises(ValueError):
        mkv.parse(deep)
    df = spark.createDataFrame([(i, b) for i, b in enumerate([*blobs, deep])], "media_id long, media binary")
    assert mkv.packet_table(df, ["media_id"]).filter("media_id = 0").first().error


def test_broken_files(spark):
    good = mkv.write_pcm(b"x" * 10_000)
    bad = [b"", b"\x00", b"text", good[:-9], good[5:], file(block(0x04, b"\x01abc")), file(block(0x02, b"\x01\xff")), file(block(0x06, b"\x01\x82a")), file(block(0x02, b""))]
    for blob in bad:
        with pytest.raises(ValueError):
            mkv.parse(blob)
    df = spark.createDataFrame([(i, b) for i, b in enumerate([*bad, None, good])], "media_id long, media binary")
    rows = mkv.packet_table(df, ["media_id"]).collect()
    assert {r.media_id for r in rows if r.error} == set(range(len(bad)))
    assert [r.end - r.start for r in rows if not r.error] == [4096, 4096, 1808]


def test_stored_texts(spark, data):
    docs = edge.documents(spark, extra=True)
    back = {r.doc_id: bytes(r.samples) for r in mkv.read_back(mkv.stored(docs, ["doc_id"]), ["doc_id"]).collect()}
    assert back == {i: mkv.payload((t or "").encode()) for i, t in enumerate(edge.TEXTS)}
    assert len(mkv.payload(b"")) == 64 and len(mkv.payload(b"x" * 64)) == 64 and len(mkv.payload(b"x" * 65)) == 128
    assert mkv.stored(edge.documents(spark, []), ["doc_id"]).count() == 0
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = mkv.op4(spark, data).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        text = texts[r.doc_id].encode()
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == brute(text)
        blob = mkv.write_pcm(mkv.payload(text))
        assert (r.media_bytes, r.media_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
        assert by_text.setdefault(text, r.feature) == r.feature


PAGES = [(1, "http://a.b/1", "same"), (9, "http://a.b/2\r\nX: y", "same"), (5, None, "same"), (2, "u", None), (3, "u", ""), (9, "v", "same"), (None, "w", "same"), (None, "w", "lone"), (4, "é", "ÄÖ\r\n\r\nWARC/1.1" * 30_000)]


def pages_of(spark, rows=PAGES, extra=False):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "1 as top", "'x' as key", "2 as revisit", "'p' as payload") if extra else df


def test_archives(spark, tmp_path):
    bundles = warc.store(pages_of(spark, extra=True))
    rows = warc.read_bundles(bundles).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = []
    for i, _, html in PAGES:
        html = html or ""
        ids = [p for p, _, h in PAGES if (h or "") == html and p is not None]
        top = max(ids, default=None)
        want.append((i, len(html.encode()), sha(html), "response" if i == top else "revisit", None if i == top else top))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=key) == sorted(want, key=key)
    found = warc.fetch(bundles, spark.createDataFrame([(4,), (5,), (77,)], "page_id long")).collect()
    assert {(r.page_id, None if r.payload is None else bytes(r.payload)) for r in found} == {(4, PAGES[-1][2].encode()), (5, None)}
    assert warc.store(pages_of(spark, PAGES[:0])).count() == 0
    warc.export(bundles, str(tmp_path / "out"))
    files = sorted(os.listdir(tmp_path / "out"))
    assert len(files) == bundles.count() and all(f.endswith(".warc.zst") for f in files)
    records = []
    for f in files:  # any reader of Zstandard can read the file from end to end
        with open(tmp_path / "out" / f, "rb") as raw:
            records.append(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read())
    assert sum(r.count(b"WARC-Type: ") for r in records) == len(PAGES)
    with pytest.raises(ValueError):
        warc.export(bundles, "hdfs://x/y")


def test_shared_payloads_are_dealt(spark, monkeypatch):
    rows = [(i, f"u{i}", "" if i % 3 else "other") for i in range(60)] + [(99, "v", "x" * 3_000_000)]
    want = sorted(map(repr, warc.decisions(pages_of(spark, rows)).collect()))
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(warc, "KEY_ROWS", 7)
    assert sorted(map(repr, warc.decisions(pages_of(spark, rows)).collect())) == want
    assert sum(r.payload_bytes for r in warc.read_bundles(warc.store(pages_of(spark, rows))).collect() if r.page_id == 99) == 3_000_000


def test_seek_table_and_index():
    writer = warc.BundleWriter()
    for i in range(400):
        writer.add(i, warc.record(i, f"http://h/{i}", b"page %d " % i * 500, None, False))
    bundle, index = writer.finish()
    assert len(warc.seek_table(bundle)) > 3
    for entry in index[::37]:
        assert warc.lookup(bundle, entry)["page_id"] == entry["page_id"]
    assert zlib.crc32(b"".join(warc.frame(bundle, n) for n in range(len(warc.seek_table(bundle))))) == zlib.crc32(b"".join(warc.record(i, f"http://h/{i}", b"page %d " % i * 500, None, False) for i in range(400)))
    with pytest.raises(ValueError):
        warc.seek_table(bundle + b"x")


def test_archive_query_equals_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    assert sorted(map(str, map(tuple, warc.op10(spark, data).collect()))) == sorted(map(str, con.sql(warc.OP10_SQL).fetchall()))


def test_page_parts():
    assert language.visible_text("<p>a<script>var x='<b>'</script>b<!-- c --><style>d</style>&amp;e</p>").split() == ["a", "b", "&e"]
    assert "hidden" not in language.visible_text("x <script>hidden</script> y <!-- hidden --> <STYLE>hidden</STYLE>")
    assert "kept" in language.visible_text("a <script> kept") and language.visible_text(None) == ""
    language.visible_text("<script>" * 50_000 + "<!--" * 50_000)
    assert language.host_parts("https://u:p@M.a.Example.co.uk:80/x?y") == ("m.a.example.co.uk", "example.co.uk", "uk")
    assert language.host_parts("http://www.beispiel.de") == ("www.beispiel.de", "beispiel.de", "de")
    assert language.host_parts("http://1.2.3.4/") == ("1.2.3.4", "1.2.3.4", None)
    assert language.host_parts(None) == (None, None, None) == language.host_parts("no address")
    known = {"de", "en", "fi", "es"}
    codes = {"fil": "other", "est": "other", "deu": "de", "ger-AT": "de", "ENG": "en", "english": "other", "fin": "fi", "spa": "es", "": "none", "e": "other"}
    assert {c: language.declared_language(f"<html lang='{c}'>", known) for c in codes} == codes
    assert [language.declared_language(s, known) for s in ('<!DOCTYPE html><HTML class=x LANG="de-AT">', "<html lang=fr>", "<html>", None, "<p lang=de>")] == ["de", "other", "none", "none", "none"]


def test_evidence_is_fused(spark):
    german = ["der die das und nicht ist ein eine mit von zu auf", "wir haben nicht die zeit und das geld für ein haus"]
    english = ["the and of to a in is that it was for on", "we do not have the time and the money for a house"]
    rows = [(i, (german if i % 2 else english)[i % 4 // 2], "de" if i % 2 else "en", "s") for i in range(80)]
    docs = spark.createDataFrame([*rows, (900, None, "en", None), (901, "", None, "s")], "doc_id long, text string, lang string, source string")
    pages = [(i, f"http://h{i % 3}.seite.de/{i}", f"<html lang='de'><p>{german[i % 2]} {i}</p></html>") for i in range(30)]
    pages += [(100 + i, f"http://k{i % 3}.page.com/{i}", f"<html lang='en'><p>{english[i % 2]} {i}</p></html>") for i in range(30)]
    pages += [(200, "http://h1.seite.de/x", "<html><p>123 456</p></html>"), (201, None, None), (202, "http://new.seite.de/", ""), (203, "http://k1.page.com/", "<html lang=de></html>")]
    got = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()
    by_page = {r.page_id: r for r in got if r.page_id is not None}
    assert all(by_page[i].lang == ("de" if i < 100 else "en") for i in by_page if i < 200)
    assert by_page[200].lang == "de" and by_page[202].lang == "de" and by_page[201].lang in ("de", "en") and by_page[203].posterior < 1
    by_doc = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by_doc[i].lang == rows[i][2] for i in range(80)) and by_doc[900].lang and 0 < by_doc[901].posterior <= 1
    assert len(got) == len(pages) + 82


def brute_fusion(rows, languages):
    """Posteriors by the definition, row against row. rows: (host, domain, suffix, declared, scores)."""
    n = len(languages)
    norm = lambda v: [x / sum(v) for x in v]
    soft = [norm([math.exp(s) for s in r[4]]) for r in rows]
    add = lambda which: [sum(s[i] for s, r in zip(soft, rows) if which(r)) for i in range(n)]
    corpus = norm([x + 1 for x in add(lambda r: True)])

    def log_likelihood(at, value, counted):
        values = {r[at] for r in counted if r[at] is not None}
        if value is None:
            return [0.0] * n
        own, whole = add(lambda r: r[at] == value), add(lambda r: r[at] is not None)
        return [math.log((a + 0.5) / (b + 0.5 * len(values))) for a, b in zip(own, whole)]

    out = []
    for r, s in zip(rows, soft):
        rest = lambda at, r=r, s=s: [0.0] * n if r[0] is None else [max(0.0, a - b) for a, b in zip(add(lambda x: x[0] is not None and x[at] == r[at]), s)]
        domain = rest(1)
        domain = [(a + language.DOMAIN_WEIGHT * p) / (sum(domain) + language.DOMAIN_WEIGHT) for a, p in zip(domain, corpus)]
        host = rest(0)
        host = [(a + language.HOST_WEIGHT * p) / (sum(host) + language.HOST_WEIGHT) for a, p in zip(host, domain)]
        suffix = log_likelihood(2, r[2], [x for x in rows if x[0] is not None])
        logs = [a + b + c + math.log(d) for a, b, c, d in zip(r[4], log_likelihood(3, r[3], rows), suffix, host)]
        out.append(norm([math.exp(x - max(logs)) for x in logs]))
    return out


@pytest.mark.parametrize("large", [2, 1 << 18])
def test_fusion_equals_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(language, "HOST_ROWS", large)
    rnd = random.Random(2)
    languages, rows = ["de", "en", "fr"], []
    for i in range(70):
        host = rnd.choice([None, "a.x.de", "b.x.de", "c.y.com", "hot.z.fr", "hot.z.fr", "hot.z.fr"])
        scores = [-6 * rnd.random() for _ in languages]
        rows.append((host, host and host[2:] if host != "hot.z.fr" else "z.fr", host and host.rpartition(".")[2], rnd.choice(["none", "de", "en", "other"]), [s - max(scores) for s in scores]))
    rows += rows[:3]  # repeated rows
    df = spark.createDataFrame([(None, i, *r) for i, r in enumerate(rows)], "doc_id long, page_id long, host string, domain string, suffix string, declared string, scores array<double>")
    got = {r.page_id: r for r in language.fuse(df, languages).collect()}
    want = brute_fusion(rows, languages)
    assert len(got) == len(rows)
    for i, p in enumerate(want):
        assert got[i].posteriors == pytest.approx(p, abs=1e-9) and got[i].lang == languages[p.index(max(p))]


def test_language_of_odd_tables(spark):
    """Clashing columns, repeated rows, very long texts, and more languages than two letters name."""
    docs = edge.documents(spark, ["der die das und nicht", "the and of to", None, "", edge.LONG, "der die das und nicht"], extra=True).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit("de")).otherwise(F.lit("en")))
    docs = docs.selectExpr("*", "1 as host", "2 as scores", "3 as soft", "'x' as declared", "7 as pieces")
    pages = spark.createDataFrame([(1, "http://a.de", f"<html lang=de><p>{edge.LONG}")] * 3 + [(None, None, None)], "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as scores", "'y' as domain", "5 as rows")
    rows = language.identify(pages, docs).collect()
    assert len(rows) == 10 and all(r.lang in ("de", "en") for r in rows)
    assert len({(r.lang, r.posterior) for r in rows if r.page_id == 1}) == 1
    many = spark.createDataFrame([(i, f"w{i} text{i} und{i} " * 20, f"l{i % 220}", f"s{i % 3}") for i in range(880)], "doc_id long, text string, lang string, source string")
    found = language.identify(pages.limit(1), many)
    assert found.select("lang").distinct().count() > 200


def test_language_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.de", "<p>x")], "page_id long, url string, html string")
    docs = spark.createDataFrame([(1, "x", None, "s")], "doc_id long, text string, lang string, source string")
    assert [r.lang for r in language.identify(pages, docs).collect()] == [None, None]
    some = spark.createDataFrame([(2, "x y z", "en", "s")], "doc_id long, text string, lang string, source string")
    assert language.identify(pages.limit(0), some).count() == 1


def test_language_query_holds_out(spark, data):
    rows = language.op1(spark, data).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    held = [r for r in rows if r.doc_id is not None and r.held_out]
    assert held and sum(r.lang == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    pages = [r for r in rows if r.page_id is not None]
    assert len(pages) == spark.read.parquet(f"{data}/pages.parquet").count()
    # without the declarations, which are an input, the other evidence finds the same language
    bare = spark.read.parquet(f"{data}/pages.parquet").withColumn("html", F.regexp_replace("html", r"(?i)\slang\s*=\s*[\"']?[A-Za-z-]*[\"']?", " "))
    without = {r.page_id: r for r in language.identify(bare, spark.read.parquet(f"{data}/documents.parquet")).collect() if r.page_id is not None}
    assert all(r.declared == "none" for r in without.values())
    told = [r for r in pages if r.declared not in ("none", "other")]
    assert told and sum(without[r.page_id].lang == r.declared for r in told) >= 0.9 * len(told)
