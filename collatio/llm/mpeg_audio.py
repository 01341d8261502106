"""Media columns of MPEG audio: resynchronised frames, tags, variable-bitrate tables, checksums, durations, seek offsets.

`parse` walks a file's bytes frame by frame. Tags (ID3v2 in front, ID3v1 and APEv2 behind) are set apart. A frame header
is believed at the start or after a gap only if another header of the same version, layer and rate follows where the
first frame ends (or the audio ends there); in sync, each frame leads to the next. When a header is not where it should
be, bytes are skipped to the next believed header and the gap is counted. A leading Xing, Info or VBRI frame is
metadata: its frame and byte counts, seek table and encoder delay are read. Frames with a checksum are verified (CRC-16 over
the header's last two bytes and layer III's side information, layer I's bit allocation, or layer II's bit allocation and
scale factor selection). A free format's frame length is the distance to the next header that a third one confirms.
The duration is exact: samples of all audio frames less the encoder's delay and padding, over the sampling rate. Every
frame's byte offset is stored, so that sample s lies in frame s // samples_per_frame.

`pack` stores any payload losslessly as a valid stream: silent MPEG-1 layer III frames (mono, 48 kHz) with checksums, the
payload being the frames' ancillary bytes. Full frames have 320 kbit/s; the last takes the lowest rate that holds
the rest, and a frame of silence ends the stream. An ID3v2 tag keeps the payload's length and CRC-32, and a Xing frame keeps the counts and the seek table.

Null media have null results; bytes without any frame give 0 frames and a null duration. Null texts are stored as
empty payloads. Very long texts are one stream each, whole in a worker's memory, with a frame offset for each 957 bytes. Repeated rows repeat and
equal texts are equal streams; empty tables stay empty; other columns stay, and results are columns the caller names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.session import spread

from .shared import bound_batches, new_folder

# Fixed values of the MPEG audio formats: bit rates in kbit/s by (version is 1, layer), sampling rates by version (1, 2, 2.5).
RATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
HERTZ = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 25: [11025, 12000, 8000]}
# Layer II: bits that allot each subband's bits, by (least kbit/s of a channel, tables at 44.1, 48 and 32 kHz), and at the lower sampling rates.
ALLOT = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "low": [4] * 4 + [3] * 7 + [2] * 19}
ALLOT_BY = [(96, "bab"), (56, "aaa"), (0, "ccd")]
# End of fixed values.

ALIGN, FRONT = 64, 4 + 2 + 17
#: Bytes within which a free format's next frame is looked for.
FREE_REACH = 1 << 14
SCHEMA = "version string, layer int, sample_rate int, n_frames long, n_samples long, duration double, mean_kbps double, n_gaps long, gap_bytes long, n_checked long, n_bad_crc long, table string, tags map<string,string>, offsets array<long>"


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
    return c


def crc16_bits(data: bytes, bits: int) -> int:
    """crc16 over a number of bits that need not fill the last byte."""
    whole, rest = divmod(bits, 8)
    c = crc16(data[:whole])
    for k in range(rest):
        c = (c << 1 ^ (0x8005 if (c >> 15) ^ (data[whole] >> (7 - k) & 1) else 0)) & 0xFFFF
    return c


@lru_cache(4096)
def header(four: bytes, free: int = 0) -> tuple | None:
    """(version, layer, Hz, kbit/s, frame bytes, samples, protected, side information bytes) of a frame header; None if it is none.

    free: bytes of a free format's frames without padding; while it is 0, their length is 0.
    """
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = {3: 1, 2: 2, 0: 25}.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    rate, hertz, pad = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version is None or layer == 4 or rate == 15 or hertz == 3:
        return None
    kbps, hz = RATES[version == 1, layer][rate], HERTZ[version][hertz]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    slot = 4 if layer == 1 else 1
    if rate:
        size = (samples // 8 * 1000 // slot * kbps // hz + pad) * slot
    else:
        size, kbps = (free + pad * slot, free * hz // (samples * 125)) if free else (0, 0)
    mono = four[3] >> 6 == 3
    side = (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return version, layer, hz, kbps, size, samples, not four[1] & 1, side if layer == 3 else 0


def protected_bits(frame: bytes, h: tuple) -> int:
    """How many bits behind a frame's header and checksum the checksum covers."""
    version, layer, hz, kbps = h[:4]
    if layer == 3:
        return 8 * h[7]
    mode, channels = frame[3] >> 6, 1 if frame[3] >> 6 == 3 else 2
    joint = 4 * ((frame[3] >> 4 & 3) + 1) if mode == 1 else 32  # from this subband on, channels share what they are allotted
    if layer == 1:
        return 4 * (min(joint, 32) * channels + (32 - min(joint, 32)))
    by = next(names for least, names in ALLOT_BY if kbps / channels >= least)
    widths = ALLOT[by[HERTZ[1].index(hz)] if version == 1 else "low"]
    bits, at, used = int.from_bytes(frame[6:70].ljust(64, b"\0"), "big"), 0, 0
    for band, width in enumerate(widths):
        own = channels if band < joint else 1
        for _ in range(own):
            at += width
            used += (channels if own < channels else 1) * bool(bits >> (512 - at) & ((1 << width) - 1))
    return at + 2 * used


def free_size(data: bytes, p: int, end: int, inner: bool = False) -> int:
    """Bytes, without padding, of the free format's frames that begin at p; 0 if no second and third header say so, or if shorter frames
    begin at a header on the way, which then p is not in step with."""
    same = lambda q: (h := header(data[q : q + 4])) is not None and h[:3] == kind and not data[q + 2] >> 4
    kind = header(data[p : p + 4])[:3]
    pad = lambda q: (data[q + 2] >> 1 & 1) * (4 if kind[1] == 1 else 1)
    q = data.find(b"\xff", p + 24, min(end, p + FREE_REACH))
    while q >= 0:
        if same(q):
            size = q - p - pad(p)
            after = q + size + pad(q)
            if after == end or (after + 4 <= end and same(after)):
                return size
            if not inner and 0 < free_size(data, q, end, True) < size:
                return 0
        q = data.find(b"\xff", q + 1, min(end, p + FREE_REACH))
    return 0


def synchronised(body: bytes) -> bytes:
    """Bytes without the zeros that keep them from looking like a frame."""
    return body.replace(b"\xff\x00", b"\xff")


def text_frame(body: bytes) -> list[str]:
    """The strings of a text frame, by the encoding that its first byte names."""
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
    return body[1:].decode(code, "replace").split("\0")


def id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """(bytes, text frames by their names) of an ID3v2 tag in front, of version 2 to 4. Frames that are packed or enciphered are passed over."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return 0, {}
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    major, flags, inner = data[3], data[5], safe(data[6:10])
    size = min(len(data), 10 + inner + (10 if flags & 0x10 else 0))
    body, out = data[10 : min(size, 10 + inner)], {}
    if flags & 0x80 and major < 4:  # the whole tag; version 4 says so of each frame
        body = synchronised(body)
    at = 0
    if flags & 0x40 and major >= 3 and len(body) >= 4:  # extended header
        at = safe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    long = major >= 3
    head, letters = (10, 4) if long else (6, 3)
    while at + head <= len(body) and body[at] >= 0x41:
        name, field = body[at : at + letters].decode("latin-1"), body[at + letters : at + 2 * letters]
        n = safe(field) if major == 4 else int.from_bytes(field, "big")
        kind = body[at + 9] if long else 0
        value = body[at + head : at + head + n]
        at += head + n
        if kind & (0x0C if major == 4 else 0xC0):
            continue
        if major == 4:
            value = value[4:] if kind & 0x01 else value
            value = synchronised(value) if kind & 0x02 else value
        if name[0] == "T" and value:
            text = text_frame(value)
            if name in ("TXXX", "TXX"):
                out[f"{name}:{text[0]}"] = text[1] if len(text) > 1 else ""
            else:
                out[name] = text[0]
    return size, out


def ape_items(items: bytes) -> dict[str, str]:
    """The text items of an APEv2 tag."""
    out, at = {}, 0
    while at + 9 <= len(items):
        n, flags = struct.unpack("<II", items[at : at + 8])
        end = items.find(b"\0", at + 8)
        if end < 0 or end + 1 + n > len(items):
            break
        if not flags >> 1 & 3:
            out[f"ape:{items[at + 8 : end].decode('latin-1')}"] = items[end + 1 : end + 1 + n].decode("utf-8", "replace")
        at = end + 1 + n
    return out


def trailer(data: bytes, start: int) -> tuple[int, dict[str, str]]:
    """(end of the audio, tags) with an ID3v1 tag and an APEv2 tag behind set apart."""
    end, out = len(data), {}
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for k, (a, b) in {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97)}.items():
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                out[f"id3v1:{k}"] = value
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I", data[end - 20 : end - 16])[0], struct.unpack("<I", data[end - 12 : end - 8])[0]
        whole = size + (32 if flags >> 31 else 0)
        if whole <= end - start:
            out |= ape_items(data[end - size : end - 32]) | {"ape:bytes": str(whole)}
            end -= whole
    return end, out


def rate_table(frame: bytes, h: tuple) -> tuple[str, dict] | None:
    """(kind, fields) of a Xing, Info or VBRI frame."""
    at = 4 + 2 * h[6] + h[7]
    kind = frame[at : at + 4]
    if kind not in (b"Xing", b"Info"):
        at = 4 + h[7]  # some encoders don't count the checksum
        kind = frame[at : at + 4]
    if kind in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, p, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 4:
            out["toc"], p = list(frame[p : p + 100]), p + 100
        p += 4 if flags & 8 else 0
        if frame[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") and len(frame) >= p + 24:
            packed = int.from_bytes(frame[p + 21 : p + 24], "big")
            out |= {"delay": packed >> 12, "padding": packed & 0xFFF}
        return kind.decode(), out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames = struct.unpack(">II", frame[46:54])
        count, scale, width, per = struct.unpack(">HHHH", frame[54:62])
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(count)]
        return "VBRI", {"frames": frames, "bytes": size, "toc": toc, "per": per}
    return None


def parse(data: bytes) -> dict:
    """What SCHEMA names, of a file's bytes."""
    start, tags = id3v2(data)
    end, more = trailer(data, start)
    tags |= more
    offsets, gaps, lost, at, kind = [], 0, 0, start, None
    checked = bad = kbps = samples = 0
    table, info, free = None, {}, 0

    def read(p: int) -> tuple | None:
        """The header at p; the first of a free format tells the length of all."""
        nonlocal free
        h = header(data[p : p + 4], free)
        if h and not h[4]:
            free = free_size(data, p, end)
            h = header(data[p : p + 4], free) if free else None
        return h

    def believed(p: int) -> tuple | None:
        h = read(p)
        if h is None or p + h[4] > end:
            return None
        if p + h[4] == end:
            return h
        n = header(data[p + h[4] : p + h[4] + 4], free)
        return h if n and n[:3] == h[:3] else None

    synced = False
    while at + 4 <= end:
        h = read(at)
        if synced:
            h = h if h and at + h[4] <= end and kind in (None, h[:3]) else None
        else:
            h = believed(at)
        if h is None:
            p = at
            while True:
                p = data.find(b"\xff", p + (p == at), end)
                if p < 0 or (believed(p) and (kind is None or read(p)[:3] == kind)):
                    break
                p += 1
            gaps, lost = gaps + 1, lost + ((p if p >= 0 else end) - at)
            if p < 0:
                at = end
                break
            at, synced = p, True
            continue
        if not offsets and table is None:
            kind = h[:3]
            if (found := rate_table(data[at : at + h[4]], h)) is not None:
                (table, info), at, synced = found, at + h[4], True
                continue
            table = "none"
        synced = True
        if h[6]:
            checked += 1
            frame = data[at : at + min(h[4], 134)]
            bad += crc16_bits(frame[2:4] + frame[6:], 16 + protected_bits(frame, h)) != int.from_bytes(frame[4:6], "big")
        offsets.append(at)
        kbps, samples = kbps + h[3], samples + h[5]
        at += h[4]
    if at < end:
        gaps, lost = gaps + 1, lost + end - at
    net = max(0, samples - info.get("delay", 0) - info.get("padding", 0))
    return {"version": {1: "1", 2: "2", 25: "2.5"}[kind[0]] if kind else None, "layer": kind[1] if kind else None, "sample_rate": kind[2] if kind else None, "n_frames": len(offsets), "n_samples": net, "duration": net / kind[2] if kind else None, "mean_kbps": kbps / len(offsets) if offsets else None, "n_gaps": gaps, "gap_bytes": lost, "n_checked": checked, "n_bad_crc": bad, "table": table + "".join(f" {k}={info[k]}" for k in ("frames", "bytes", "delay", "padding") if k in info) if table else None, "tags": tags, "offsets": offsets}


@lru_cache(32)
def frame_front(rate: int) -> tuple[bytes, int]:
    """(header, checksum and side information, bytes of the frame) of a silent frame of a rate index."""
    four = bytes([0xFF, 0xFA, rate << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    return four + crc16(four[2:] + side).to_bytes(2, "big") + side, header(four)[4]


def pack(payload: bytes, n_bytes: int) -> bytes:
    """A stream that holds the payload; n_bytes: what of it is not padding."""
    full, size = frame_front(14)
    room = size - FRONT
    bodies = [payload[i : i + room] for i in range(0, len(payload), room)]
    frames = [full + b for b in bodies[:-1]]
    last, n = next(x for r in range(1, 15) if (x := frame_front(r))[1] - FRONT >= len(bodies[-1]))
    frames.append((last + bodies[-1]).ljust(n, b"\0"))
    last, n = frame_front(3)
    frames.append(last.ljust(n, b"\0"))  # silence, so that no payload bytes at the end look like a tag
    total = sum(map(len, frames))
    text = lambda k, v: b"TXXX" + bytes([0, 0, 0, len(k) + len(v) + 2, 0, 0]) + b"\3" + k + b"\0" + v
    tag = text(b"payload", str(len(payload)).encode()) + text(b"unpadded", str(n_bytes).encode()) + text(b"crc32", b"%08x" % zlib.crc32(payload))
    head = b"ID3\4\0\0" + bytes([0, 0, len(tag) >> 7 & 127, len(tag) & 127]) + tag
    front, first = frame_front(6)
    toc = bytes(min(255, (len(frames) * i // 100 * size) * 256 // total) for i in range(100))
    xing = (front + b"Xing" + struct.pack(">III", 7, len(frames), total + first) + toc).ljust(first, b"\0")
    return b"".join([head, xing, *frames])


def unpack(data: bytes, parsed: dict | None = None) -> tuple[bytes, int]:
    """(payload, unpadded bytes) of a stream that pack made; raises ValueError if its checksums don't hold."""
    parsed = parsed or parse(data)
    tags = parsed["tags"]
    n = int(tags["TXXX:payload"])
    ends = [*parsed["offsets"][1:], len(data)]
    payload = b"".join([data[a + FRONT : b] for a, b in zip(parsed["offsets"], ends)])[:n]
    if parsed["n_bad_crc"] or parsed["n_gaps"] or len(payload) != n or zlib.crc32(payload) != int(tags["TXXX:crc32"], 16):
        raise ValueError("the stored stream is damaged")
    return payload, int(tags["TXXX:unpadded"])


def packed(text: Column | str) -> Column:
    """Binary column: each text's payload as MPEG audio."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                raw = t.encode("utf-8", "surrogatepass") if t else b""
                out.append(pack(raw.ljust(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN), b"\0"), len(raw)))
            yield pd.Series(out)

    return run.asNondeterministic()(text)


def audio_features(media: Column | str) -> Column:
    """Struct column SCHEMA of a binary column."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "map").split(", ")]
        for blobs in batches:
            rows = [parse(bytes(b)) if b is not None else dict.fromkeys(names) for b in blobs]
            yield pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})

    return run.asNondeterministic()(media)


READ = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, offsets array<long>"


def read_back(media: Column | str) -> Column:
    """Struct column READ of a binary column that packed made: the payload is restored and its digests taken."""

    @F.pandas_udf(READ)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for blobs in batches:
            rows = []
            for b in map(bytes, blobs):
                p = parse(b)
                payload, n = unpack(b, p)
                length = p["n_samples"] * 1_000_000 // p["sample_rate"]
                seek = hashlib.sha256(struct.pack(f"<{len(p['offsets'])}Q", *p["offsets"])).hexdigest()[:16]
                feature = f"mpeg{p['version']} layer{p['layer']} {p['sample_rate']}Hz frames={p['n_frames']} samples={p['n_samples']} us={length} kbps={p['mean_kbps']:.3f} crc={p['n_checked'] - p['n_bad_crc']}/{p['n_checked']} {p['table']} seek={seek}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(b), hashlib.sha256(b).hexdigest(), feature, length, list(p["offsets"])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])

    return run.asNondeterministic()(media)


def store_media(df: DataFrame, text: str, media: str) -> DataFrame:
    """df with a media column in place of its text, written to the shared folder and read again."""
    spark = df.sparkSession
    bound_batches(spark)
    folder = new_folder(spark, "media")
    df.withColumn(media, packed(F.col(text))).drop(text).write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def op5_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    """Every document stored as MPEG audio, read back and measured."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text")
    return store_media(docs, "text", "media").select("doc_id", read_back("media").alias("m")).select("doc_id", "m.*")
