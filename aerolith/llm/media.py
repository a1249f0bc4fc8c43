"""Media columns: signature sniffing, structure checks, corrected types and carving.

One Aho-Corasick automaton over all magic bytes reads each value once. Wherever one occurs,
its format's validator walks the structure (chunks, checksums, lengths) and returns the
medium's end and facts, or nothing. A valid medium at the start gives the value's true type
and corrects the declared one; valid media elsewhere are carved out as (offset, length, type).

`store` writes bytes losslessly as 8-bit samples: WAV, PNG (64 grey pixels a row) or BMP,
as the payload's checksum picks; `load` reads them back through the same validators.
Null values count as empty ones; empty or unknown values are application/octet-stream.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm.common import text_batches

UNKNOWN = "application/octet-stream"
#: What stored texts are declared as, whatever their form.
DECLARED = "audio/wav"
ROW = 64

# The formats' magic bytes.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"BM": "image/bmp",
    b"RIFF": "riff",
    b".snd": "audio/basic",
    b"fLaC": "audio/flac",
    b"OggS": "audio/ogg",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
}


def _png(d: bytes, at: int):
    i, facts = at + 8, None
    while i + 12 <= len(d):
        size, name = struct.unpack_from(">I4s", d, i)
        end = i + 12 + size
        if end > len(d) or zlib.crc32(d[i + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0]:
            return None
        if facts is None:
            if name != b"IHDR" or size != 13:
                return None
            w, h, depth, color = struct.unpack_from(">IIBB", d, i + 8)
            if not w or not h:
                return None
            facts = ("image/png", f"{w}x{h}x{depth}")
        if name == b"IEND":
            return end, *facts
        i = end
    return None


def _jpeg(d: bytes, at: int):
    i, size = at + 2, None
    while i + 4 <= len(d):
        if d[i] != 0xFF:
            return None
        marker = d[i + 1]
        if marker == 0xFF:
            i += 1
            continue
        if marker == 0xD9:
            return (i + 2, "image/jpeg", size) if size else None
        length = struct.unpack_from(">H", d, i + 2)[0]
        if length < 2 or i + 2 + length > len(d):
            return None
        if marker in (0xC0, 0xC1, 0xC2) and length >= 8:
            h, w = struct.unpack_from(">HH", d, i + 5)
            size = f"{w}x{h}x{d[i + 4]}"
        i += 2 + length
        if marker == 0xDA:  # entropy-coded data up to the next marker that is neither stuffing nor a restart
            while True:
                i = d.find(b"\xff", i)
                if i < 0 or i + 1 >= len(d):
                    return None
                if d[i + 1] == 0 or 0xD0 <= d[i + 1] <= 0xD7:
                    i += 2
                else:
                    break
            if d[i + 1] == 0xD9:
                return (i + 2, "image/jpeg", size) if size else None
    return None


def _gif(d: bytes, at: int):
    if at + 13 > len(d):
        return None
    w, h, flags = struct.unpack_from("<HHB", d, at + 6)
    i, frames = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), 0

    def blocks(i):
        while i < len(d):
            if not d[i]:
                return i + 1
            i += 1 + d[i]
        return None

    while i is not None and i < len(d):
        kind = d[i]
        if kind == 0x3B:
            return (i + 1, "image/gif", f"{w}x{h}x{frames}") if frames else None
        if kind == 0x21:
            i = blocks(i + 2)
        elif kind == 0x2C and i + 10 < len(d):
            local = d[i + 9]
            i = blocks(i + 11 + (3 << (local & 7) + 1 if local & 128 else 0))
            frames += 1
        else:
            return None
    return None


def _bmp(d: bytes, at: int):
    if at + 54 > len(d):
        return None
    size, zero, start, head, w, h, planes, depth = struct.unpack_from("<IIIIiiHH", d, at + 2)
    if zero or planes != 1 or head < 40 or depth not in (1, 4, 8, 16, 24, 32) or w <= 0 or not h or at + size > len(d) or start < 14 + head:
        return None
    if start + (w * depth + 31) // 32 * 4 * abs(h) > size:
        return None
    return at + size, "image/bmp", f"{w}x{abs(h)}x{depth}"


def _riff(d: bytes, at: int):
    if at + 12 > len(d):
        return None
    size, form = struct.unpack_from("<I4s", d, at + 4)
    end, i, facts = at + 8 + size, at + 12, None
    if end > len(d) or form not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    while i + 8 <= end:
        name, n = struct.unpack_from("<4sI", d, i)
        if i + 8 + n > end:
            return None
        if name == b"fmt " and n >= 16:
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", d, i + 8)
            facts = f"{rate}x{channels}x{bits}"
        i += 8 + n + n % 2
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}[form]
    if form == b"WAVE" and facts is None:
        return None
    return min(end + size % 2, len(d)), kind, facts or ""


def _au(d: bytes, at: int):
    if at + 24 > len(d):
        return None
    start, size, coding, rate, channels = struct.unpack_from(">IIIII", d, at + 4)
    if start < 24 or size == 0xFFFFFFFF or not 1 <= coding <= 27 or not rate or not 1 <= channels <= 64 or at + start + size > len(d):
        return None
    return at + start + size, "audio/basic", f"{rate}x{channels}x{coding}"


def _flac(d: bytes, at: int):
    i, first = at + 4, True
    while i + 4 <= len(d):
        last, kind, size = d[i] >> 7, d[i] & 127, int.from_bytes(d[i + 1 : i + 4], "big")
        if kind == 127 or i + 4 + size > len(d) or (first and (kind or size != 34)):
            return None
        i, first = i + 4 + size, False
        if last:
            ok = i + 2 <= len(d) and d[i] == 0xFF and d[i + 1] & 0xFC == 0xF8
            return (len(d), "audio/flac", "") if ok else None
    return None


def _ogg_crc(page: bytes) -> int:
    """Checksum of an Ogg page whose own checksum is zero: polynomial 0x04C11DB7, no reflection."""
    c = 0
    for byte in page:
        c ^= byte << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
    return c


def _ogg(d: bytes, at: int):
    i, pages = at, 0
    if d[at + 5 : at + 6] == b"" or not d[at + 5] & 2:  # the first page begins a stream
        return None
    while d[i : i + 4] == b"OggS" and i + 27 <= len(d) and d[i + 4] == 0:
        n = d[i + 26]
        end = i + 27 + n + sum(d[i + 27 : i + 27 + n])
        if end > len(d) or _ogg_crc(d[i : i + 22] + bytes(4) + d[i + 26 : end]) != struct.unpack_from("<I", d, i + 22)[0]:
            break
        i, pages = end, pages + 1
    return (i, "audio/ogg", f"{pages}") if pages else None


class Marked(bytes):
    """Bytes that find each end mark once, however often validators ask for the next one."""

    def after(self, mark: bytes, at: int) -> int:
        """Where the mark next stands, from at on; -1 if nowhere."""
        places = self.__dict__.get(mark)
        if places is None:
            places, i = [], self.find(mark)
            while i >= 0:
                places.append(i)
                i = self.find(mark, i + 1)
            self.__dict__[mark] = places
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1


def _pdf(d: Marked, at: int):
    end, body = d.after(b"%%EOF", at), d.after(b"obj", at)
    return (end + 5, "application/pdf", d[at + 5 : at + 8].decode("latin-1")) if end >= 0 and 0 <= body <= end - 3 else None


def _zip(d: Marked, at: int):
    end = d.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(d):
        return None
    count, size, offset, comment = struct.unpack_from("<HIIH", d, end + 10)
    if at + offset + size != end or end + 22 + comment > len(d):
        return None
    return end + 22 + comment, "application/zip", f"{count}"


def _gzip(d: bytes, at: int):
    z = zlib.decompressobj(31)
    i = at
    try:
        while i < len(d) and not z.eof:  # output is dropped piece by piece
            z.decompress(d[i : i + 65536], 1 << 20)
            while z.unconsumed_tail:
                z.decompress(z.unconsumed_tail, 1 << 20)
            i += 65536
    except zlib.error:
        return None
    return (min(i, len(d)) - len(z.unused_data), "application/gzip", "") if z.eof else None


_CHECKS = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "audio/basic": _au, "audio/flac": _flac, "audio/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def sniff(data: bytes | None) -> list[tuple[int, int, str, str]]:
    """(offset, length, type, facts) of valid media: one at offset 0 first, if any, then those inside or after it, apart from each other."""
    data = Marked(data or b"")
    found, end = [], 0
    hopeless = set()  # formats whose end mark doesn't occur any more
    for last, (size, kind) in _automaton().iter(data.decode("latin-1")):
        at = last - size + 1
        if (at and at < end) or kind in hopeless:
            continue
        got = _CHECKS[kind](data, at)
        if got is None:
            if kind == "application/pdf" and data.after(b"%%EOF", at) < 0 or kind == "application/zip" and data.after(b"PK\x05\x06", at) < 0:
                hopeless.add(kind)
            continue
        found.append((at, got[0] - at, got[1], got[2]))
        end = got[0] if at else 0  # what the first holds may be carved too
    return found


_CARVED = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType()), T.StructField("facts", T.StringType())]))
_SNIFFED = T.StructType([T.StructField("type", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("media", _CARVED)])


@F.pandas_udf(_SNIFFED)
def sniffed(values: pd.Series, declared: pd.Series) -> pd.DataFrame:
    """Column function: (binary, declared type) -> struct(type, corrected, media)."""
    rows = []
    for value, said in zip(values, declared):
        media = sniff(value)
        kind = media[0][2] if media and media[0][0] == 0 else UNKNOWN
        rows.append((kind, kind != said, [dict(zip(("offset", "length", "type", "facts"), m)) for m in media]))
    return pd.DataFrame(rows, columns=["type", "corrected", "media"])


# --- storing as samples ------------------------------------------------------------------


def padded(text: bytes) -> bytes:
    """text with zero bytes up to a positive multiple of 64."""
    return text + bytes(max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def store(payload: bytes) -> bytes:
    """payload (a positive multiple of 64 bytes) as 8-bit samples, without loss."""
    rows = len(payload) // ROW
    kind = zlib.crc32(payload) % 3
    if kind == 0:
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload
    if kind == 1:
        lines = np.zeros((rows, ROW + 1), dtype=np.uint8)
        lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, ROW)
        return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")
    grey = b"".join(bytes((v, v, v, 0)) for v in range(256))
    start = 54 + len(grey)
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", start + len(payload), 0, start, 40, ROW, -rows, 1, 8, 0, len(payload), 2835, 2835, 256, 0) + grey + payload


def load(data: bytes, media: list | None = None) -> tuple[bytes, str, str]:
    """(samples, type, facts) of stored bytes, once their structure was confirmed; media: what sniff found, if known."""
    media = sniff(data) if media is None else media
    if not media or media[0][0]:
        raise ValueError("no stored medium")
    _, size, kind, facts = media[0]
    if kind == "audio/wav":
        i = 12
        while data[i : i + 4] != b"data":
            i += 8 + struct.unpack_from("<I", data, i + 4)[0]
        return data[i + 8 : i + 8 + struct.unpack_from("<I", data, i + 4)[0]], kind, facts
    if kind == "image/bmp":
        start, w, h = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<ii", data, 18)
        return data[start : start + w * abs(h)], kind, facts
    if kind == "image/png":
        w, h = struct.unpack_from(">II", data, 16)
        i, parts = 8, []
        while data[i + 4 : i + 8] != b"IEND":
            n = struct.unpack_from(">I", data, i)[0]
            if data[i + 4 : i + 8] == b"IDAT":
                parts.append(data[i + 8 : i + 8 + n])
            i += 12 + n
        lines = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(h, w + 1)
        if lines[:, 0].any():
            raise ValueError("filtered rows")
        return lines[:, 1:].tobytes(), kind, facts
    raise ValueError(f"not stored as samples: {kind}")


def feature(samples: bytes, kind: str, facts: str) -> str:
    """Type, facts, mean, spread, share of zero samples and entropy of the samples."""
    n = np.bincount(np.frombuffer(samples, dtype=np.uint8), minlength=256)
    p = n / n.sum()
    mean = float(p @ np.arange(256))
    spread = float(np.sqrt(p @ (np.arange(256) - mean) ** 2))
    q = p[p > 0]
    return f"{kind};{facts};mean={mean:.3f};spread={spread:.3f};zero={p[0]:.4f};bits={float(-(q * np.log2(q)).sum()):.4f}"


_DIGEST = T.StructType([T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("media_type", T.StringType()), ("type_corrected", T.BooleanType()), ("n_carved", T.LongType()))])


@F.pandas_udf(T.BinaryType())
def stored_media(texts: pd.Series) -> pd.Series:
    """Column function: text -> its padded bytes as a stored medium."""
    return pd.Series([store(padded((t or "").encode())) for t in texts])


@F.pandas_udf(_DIGEST)
def media_digests(texts: pd.Series) -> pd.DataFrame:
    """Column function: text -> digests of its bytes, stored as a medium declared as DECLARED and read back.

    media_type is what the bytes are, type_corrected whether that isn't the declared type, n_carved
    how many whole media lie inside the stored one.
    """
    rows = []
    for t in texts:
        raw = (t or "").encode()
        kept = store(padded(raw))
        media = sniff(kept)
        samples, kind, facts = load(kept, media)
        rows.append((len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ROW:]), len(kept), hashlib.sha256(kept).hexdigest(), feature(samples, kind, facts), kind, kind != DECLARED, len(media) - 1))
    return pd.DataFrame(rows, columns=[f.name for f in _DIGEST.fields])


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    """Digests of every row of `documents` stored as media and read back; null texts count as empty."""
    text_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", media_digests("text").alias("m")).select("doc_id", "m.*")
