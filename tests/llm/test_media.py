"""op4: round trips, sniffing, false magic, carving, edge rows."""

import gzip
import hashlib
import io
import random
import struct
import zipfile
import zlib

from aerolith.llm import media


def samples():
    rng = random.Random(1)
    raw = {}
    for n in range(300):
        data = media.padded(bytes(rng.randrange(256) for _ in range(rng.randint(0, 200))))
        raw.setdefault(zlib.crc32(data) % 3, data)
    return [media.store(x) for x in raw.values()]


def test_round_trips():
    rng = random.Random(4)
    for n in [0, 1, 63, 64, 65, 5000, *(rng.randint(0, 3000) for _ in range(60))]:
        payload = media.padded(bytes(rng.choice(b"BMRIFFPK\x03\x04GIF89a%PDF-") for _ in range(n)))
        assert len(payload) % 64 == 0 and len(payload) >= max(64, n)
        assert media.load(media.store(payload))[0] == payload


def test_each_format_is_found_and_carved():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(8) + b"\0" + b"\x02\x02\x44\x01\x00" + b"\x3b"
    au = b".snd" + struct.pack(">IIIII", 24, 4, 2, 8000, 1) + b"abcd"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x02\x00\x03\x01\x01\x11\x00\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00\x12\xff\x00\x34\xff\xd9"
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\n%%EOF"
    page = b"OggS\0\x02" + bytes(8) + struct.pack("<II", 7, 0)
    tail = bytes([1, 5]) + b"hello"
    ogg = page + struct.pack("<I", media._ogg_crc(page + bytes(4) + tail)) + tail
    cases = [(ogg, "audio/ogg"), *((s, None) for s in samples()), (z.getvalue(), "application/zip"), (gzip.compress(b"x" * 999), "application/gzip"), (gif, "image/gif"), (au, "audio/basic"), (jpeg, "image/jpeg"), (pdf, "application/pdf")]
    assert len(samples()) == 3
    for data, kind in cases:
        whole = media.sniff(data)[0]
        assert whole[:2] == (0, len(data)) and (kind is None or whole[2] == kind)
        at = media.sniff(b"text BM GIF89a RIFF then " + data + b" and more")
        assert [(o, n, k) for o, n, k, _ in at if o == 25] == [(25, len(data), whole[2])]
        broken = media.sniff(data[: len(data) // 2])
        assert not broken or broken[0][0] != 0


def test_carving_inside_another_medium():
    inner = samples()[0]
    body = media.padded(b"prefix" + inner)
    outer = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(body)) + body
    got = media.sniff(outer)
    assert got[0][:2] == (0, len(outer)) and (44 + 6, len(inner)) in [g[:2] for g in got]


def test_rows(spark):
    frame = spark.createDataFrame([(1, "BM and GIF89a"), (1, "BM and GIF89a"), (None, None), (2, ""), (3, "é" * 50000)], "doc_id long, text string")
    rows = frame.select("doc_id", media.media_digests("text").alias("m")).select("doc_id", "m.*").collect()
    assert rows[0] == rows[1] and rows[2][1:] == rows[3][1:] and rows[3]["payload_bytes"] == 64
    for r, t in zip(rows, ["BM and GIF89a", "BM and GIF89a", "", "", "é" * 50000]):
        payload = media.padded(t.encode())
        assert r["n_bytes"] == len(t.encode()) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    kinds = frame.select(media.sniffed(media.stored_media("text"), frame.text).alias("s")).collect()
    assert all(k["s"]["corrected"] and k["s"]["type"] in ("audio/wav", "image/png", "image/bmp") for k in kinds)
    assert frame.limit(0).select(media.media_digests("text")).collect() == []


def test_types_are_corrected_and_media_carved_by_the_query_column(spark):
    inner = media.store(media.padded(b"inside"))
    texts = [(1, "plain", b"x"), (2, None, b"x"), (2, None, b"x"), (3, "BM RIFF .snd %PDF- OggS", b"x"), (4, "a" * 300_000, b"x")]
    frame = spark.createDataFrame(texts, "doc_id long, text string, feature binary")
    got = {r["doc_id"]: r["m"] for r in frame.select("doc_id", media.media_digests("text").alias("m")).collect()}
    for i, t, _ in texts:
        kind = media.sniff(media.store(media.padded((t or "").encode())))[0][2]
        assert got[i]["media_type"] == kind and got[i]["type_corrected"] == (kind != media.DECLARED) and got[i]["n_carved"] == 0
    # a whole medium inside the payload is carved, wherever the form leaves its bytes as they are
    wrapped = media.store(media.padded(b"before " + inner + b" after"))
    if wrapped[:4] != b"\x89PNG":
        assert [m[2] for m in media.sniff(wrapped)[1:]] == [media.sniff(inner)[0][2]]


def test_sniffing_takes_time_in_proportion():
    import time

    def seconds(text):
        began = time.perf_counter()
        assert media.sniff(text) == []
        return time.perf_counter() - began

    for text in (b"%PDF-" * 60_000 + b"%%EOF", b"PK\x03\x04" * 60_000 + b"PK\x05\x06" + bytes(18)):
        seconds(text)
        assert seconds(text) < 8 * max(seconds(text[-len(text) // 4 :]), 0.02)
    assert media.sniff(b"%PDF-1.7 1 0 obj x %%EOF")[0][:3] == (0, 24, "application/pdf") and media.sniff(b"%PDF-1.7 %%EOF obj") == []
