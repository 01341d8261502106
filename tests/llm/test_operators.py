"""Each operator against its SQL or a brute-force statement, on the small tables and on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import assert_same, bag, duck
from pyspark.sql import functions as F

from collatio.llm import decontaminate, kneser_ney, language_id, license_scan, mixing, mpeg_audio, registry, secret_links, shared, simhash, token_counts, warc_store

LONG = "lorem ipsum " * 30_000
ODD = [None, "", " ", "a", "Ünï cödé 日本 🙂", "x" * 5000, "tab\tand\x0bline\r\nend", "same text here", "same text here", LONG, "\x00 nul"]
SCHEMA = "doc_id long, text string, source string, lang string, tokens string, hits string, slot string"


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, empty, long and repeated texts, a null key, repeated rows, and extra columns with clashing names."""
    rows = [(i if i != 3 else None, t, [None, "src0", "src1", "zz"][i % 4], "en" if i % 2 else None, "t", "h", "s") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[7]], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


def texts_of(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 1 token counts


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_vocabulary())


def test_tokens_equal_the_library(spark, sf_dir, odd):
    tok = library()
    texts = texts_of(spark, sf_dir)
    for r in token_counts.op1_token_counts(spark, sf_dir).collect():
        assert r["n_tokens"] == len(tok.encode(texts[r["doc_id"]], add_special_tokens=False)) and r["n_bytes"] == len(texts[r["doc_id"]].encode())
        assert r["over_limit"] == (r["n_tokens"] > 512)
    got = token_counts.with_token_counts(odd, chunk=4096).select("text", "tokens.*", "hits").collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        assert r["n_tokens"] == len(tok.encode(r["text"] or "", add_special_tokens=False))
    assert max(r["n_chunks"] for r in got) > 50


PARTS = ["a", "b", " ", "  ", "\n", "'s", "'re", "'", "é", "ab", "<|endoftext|>", "!", "...", "12", "日本", " ", "x" * 90, " " * 70, "<|end", " ", "ʼn", "½", "\x1c", "\x85"]


def test_chunks_are_spliced_at_stable_boundaries():
    import public_tokenizers

    tok, r = library(), random.Random(1)
    small = token_counts.Counter(token_counts.default_vocabulary(), None, chunk=64, overlap=40)
    fast = token_counts.Counter(token_counts.default_vocabulary(), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    widened = 0
    for _ in range(300):
        t = "".join(r.choice(PARTS) for _ in range(r.randint(0, 300)))
        n = len(tok.encode(t, add_special_tokens=False))
        k, _, w = small.count([t])[0]
        widened += w
        assert k == n and fast.count([t])[0][0] == n
    assert widened > 0


# 2 decontamination


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        k = min(window, len(v))
        for i in range(len(v) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == v[i : i + k]:
                    hit.update(range(j, j + k))
                    names.add(name)
    return len(w), len(hit), sorted(names)


def test_search_finds_every_window(spark):
    r = random.Random(2)
    word = lambda: r.choice("abcd") * r.randint(1, 2)
    items = [(str(i), " ".join(word() for _ in range(r.choice([0, 1, 2, 3, 10, 14])))) for i in range(25)]
    texts = [" ".join(word() for _ in range(r.randint(0, 60))) + r.choice(["", " " + r.choice(items)[1] + "!"]) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*items, items[3], (None, None), ("99", None)], "item_id string, text string")
    items += [("null", None)]
    for words in (10_000, 60):  # one automaton, and several blocks
        got = decontaminate.with_benchmark_hits(docs, bench, max_words=words, window=5).select("doc_id", "hits.*").collect()
        assert len(got) == len(texts)
        for x in got:
            n, hit, names = brute_hits(texts[x["doc_id"]], items, 5)
            assert (x["n_words"], x["n_hit"], x["items"]) == (n, hit, names) and x["n_items"] == len(names)
            assert x["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest() and x["contaminated"] == (hit > 0)
            assert sum(s["stop"] - s["start"] for s in x["spans"]) == hit


def test_search_on_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([("1", "same text here"), (None, "a")], "item_id string, text string")
    got = decontaminate.with_benchmark_hits(odd, bench).select("text", "hits.*", "tokens").collect()
    assert Counter(tuple(r["items"]) for r in got if r["items"]) == {("1",): 3, ("null",): 1}
    assert decontaminate.with_benchmark_hits(nothing, bench).count() == 0
    assert decontaminate.with_benchmark_hits(odd, bench.limit(0)).where("hits.contaminated").count() == 0


# 3 mixing


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 2, "d": 1}, {"a": 17, "b": 1, "c": 1, "d": 1}, {"a": 7, "b": 6, "c": 5, "d": 4, "e": 3, "f": 2, "g": 1}])
def test_every_prefix_is_within_a_block_of_its_share(weights):
    order, total = mixing.period(weights), sum(weights.values())
    assert Counter(order) == weights
    for t in range(1, total + 1):
        for s, w in weights.items():
            assert abs(order[:t].count(s) - t * w / total) < 1


def test_phases_go_on_without_sources_that_end():
    plan = mixing.phases({"a": 3, "b": 40, "c": 7, "d": 0}, {"a": 4, "b": 2, "c": 1, "d": 5})
    assert [sorted(p["sources"]) for p in plan] == [["a", "b", "c"], ["b", "c"], ["b"]] or len(plan) == 3
    total = Counter()
    for p in plan:
        for s, x in p["sources"].items():
            assert x["first"] == total[s]
            total[s] += x["blocks"]
    assert total == {"a": 3, "b": 40, "c": 7}


def test_mixture_keeps_all_rows(spark, odd, nothing):
    got = mixing.mix(odd, {"src0": 2, "src1": 1}, rest=1, block=100).collect()
    assert len(got) == len(ODD) + 1 and {r["stream"] for r in got} == {"src0", "src1", "*"}
    assert len({(r["stream"], r["place"]) for r in got}) == len(got)
    slots = {}
    for r in got:
        assert slots.setdefault(r["slot"], (r["stream"], r["block"])) == (r["stream"], r["block"])
    assert mixing.mix(nothing, {"src0": 1}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"src0": 0})


# 4 SimHash


def brute_print(text, width):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, distance):
    """prints: list of (key, fp); the smallest key of each row's group."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= distance and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return [min((k for (k, _), h in zip(prints, group) if h == g and k is not None), default=None) for g in group]


def test_fingerprints_and_groups_equal_brute_force(spark, sf_dir, odd):
    texts = texts_of(spark, sf_dir)
    keys = sorted(texts)
    prints = [(k, brute_print(texts[k], 3)) for k in keys]
    want = dict(zip(keys, brute_groups(prints, 2)))
    for r in simhash.op4_simhash(spark, sf_dir).collect():
        assert int(r["fingerprint"], 16) == dict(prints)[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]
    small = odd.where("length(text) < 100000 or text is null")
    rows = small.collect()
    got = simhash.with_groups(small, into="tokens").collect()
    prints = [(r["doc_id"], brute_print(r["text"], 3)) for r in rows]
    assert Counter((r["doc_id"], r["tokens"]["component"]) for r in got) == Counter(zip([r["doc_id"] for r in rows], brute_groups(prints, 2)))


@pytest.mark.parametrize("distance, hot", [(2, 4096), (2, 4), (5, 4096), (5, 8), (0, 4)])
def test_links_connect_all_that_is_near(spark, distance, hot):
    r = random.Random(distance)
    centres = [r.getrandbits(64) for _ in range(12)]
    prints = set(centres)
    for _ in range(400):
        x = r.choice(centres)
        for _ in range(r.randint(0, 4)):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), distance, hot)
    rows = edges.collect()
    assert all(bin((e["u"] ^ e["v"]) & (1 << 64) - 1).count("1") <= distance for e in rows)
    roots = {x["node"]: x["root"] for x in shared.components(edges).collect()}
    got = [roots.get(s, s) for (s,) in signed]
    want = brute_groups([(i, x) for i, x in enumerate(prints)], distance)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_forest_of_many_links_stays_small():
    x = np.array([a ^ (1 << b) for a in range(64) for b in range(20)], np.uint64)
    u, v = simhash.forest(np.unique(x), 2)
    assert len(u) <= 3 * len(x) + 64 and (np.bitwise_count(u ^ v) <= 2).all()


def test_thresholds_satisfy_the_pigeonhole_sum():
    r = np.random.default_rng(0)
    bits = (r.random((500, 64)) < 0.5).astype(float)
    bits[:, 1] = bits[:, 0]
    both = bits.T @ bits
    for n, d in ((500, 2), (10**9, 2), (500, 10), (10**7, 6)):
        parts = simhash.plan(n, both * n / 500, d)
        groups = simhash.grouped_bits(simhash.correlations(500, both), 3)
        assert any({0, 1} <= set(g) for g in groups)
        skipped = d + 1 - sum(t + 1 for _, t in parts)
        assert skipped <= 0


def test_verified_links_share_shingles(spark):
    w = [f"w{i}" for i in range(200)]
    near = [*w[:100], "zz", *w[101:]]
    rows = [(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(w[::-1])), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["near"]["component"] for r in simhash.with_groups(df, width=5, distance=14, share=0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


# 5 MPEG audio


def test_payloads_are_stored_without_loss(spark, sf_dir, odd, nothing):
    texts = texts_of(spark, sf_dir)
    got = {r["doc_id"]: r for r in mpeg_audio.op5_mpeg_audio(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for k, t in texts.items():
        raw = t.encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = mpeg_audio.pack(payload, len(raw))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    stored = mpeg_audio.store_media(odd, "text", "media")
    back = stored.select("slot", mpeg_audio.read_back("media").alias("m"), mpeg_audio.audio_features("media").alias("f")).collect()
    assert len(back) == len(ODD) + 1 and all(r["f"]["n_gaps"] == 0 and r["f"]["n_bad_crc"] == 0 for r in back)
    assert mpeg_audio.store_media(nothing, "text", "media").count() == 0


def frames(n, rate=9, version_byte=0xFB, start=0):
    four = bytes([0xFF, version_byte, rate << 4, 0xC0])
    size = mpeg_audio.header(four)[4]
    return b"".join(four + bytes([start + i & 0x7F] * (size - 4)) for i in range(n)), size


def id3(major, flags, frames):
    n = len(frames)
    return b"ID3" + bytes([major, 0, flags, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frames


def test_tags_of_all_versions():
    """Short frames, bytes kept from looking like frames, data lengths, packed frames; items of a tag behind."""
    two = b"TT2\x00\x00\x06\x00title" + b"TXX\x00\x00\x04\x00a\x00b" + b"PIC\x00\x00\x02\x00\x00"
    assert mpeg_audio.id3v2(id3(2, 0, two) + b"rest") == (10 + len(two), {"TT2": "title", "TXX:a": "b"})
    wide = b"TIT2\x00\x00\x00\x05\x00\x00\x01\xff\xfeA\x00"
    hidden = wide.replace(b"\xff", b"\xff\x00")
    assert mpeg_audio.id3v2(id3(3, 0x80, hidden))[1] == {"TIT2": "A"} == mpeg_audio.id3v2(id3(3, 0, wide))[1]
    packed = b"TIT1\x00\x00\x00\x02\x00\x80zz"
    assert mpeg_audio.id3v2(id3(3, 0, packed + wide))[1] == {"TIT2": "A"}
    four = b"TIT2\x00\x00\x00\x0a\x00\x03\x00\x00\x00\x05\x01\xff\x00\xfeA\x00" + b"TPE1\x00\x00\x00\x03\x00\x00\x03\xc3\xa9"
    assert mpeg_audio.id3v2(id3(4, 0x80, four))[1] == {"TIT2": "A", "TPE1": "é"}
    items = b"\x05\x00\x00\x00\x00\x00\x00\x00Title\x00s\xc3\xb6ng" + b"\x01\x00\x00\x00\x02\x00\x00\x00Cover\x00\xff"
    foot = lambda n, f: b"APETAGEX" + (2000).to_bytes(4, "little") + n.to_bytes(4, "little") + (2).to_bytes(4, "little") + f.to_bytes(4, "little") + bytes(8)
    tag = foot(len(items) + 32, 0xA0000000) + items + foot(len(items) + 32, 0x80000000)
    assert mpeg_audio.trailer(b"audio" + tag, 0) == (5, {"ape:Title": "söng", "ape:bytes": str(len(tag))})
    for cut in range(len(tag)):  # broken tags are no error
        mpeg_audio.trailer(tag[cut:], 0)
        mpeg_audio.id3v2(id3(4, 0xC0, four)[: cut + 3])


def test_parser_resynchronises_and_reads_tags_and_tables():
    audio, size = frames(10)
    plain = mpeg_audio.parse(audio)
    assert (plain["n_frames"], plain["n_samples"], plain["sample_rate"], plain["table"], plain["n_gaps"]) == (10, 11520, 44100, "none", 0)
    assert plain["offsets"] == [i * size for i in range(10)] and plain["duration"] == 11520 / 44100
    junk = audio[: 3 * size] + b"\xff\xfbjunk" + audio[3 * size :]
    broken = mpeg_audio.parse(b"ID3\3\0\0\0\0\0\x0bTIT2\0\0\0\1\0\0\0" + junk + b"TAG" + b"song".ljust(125, b"\0"))
    assert (broken["n_frames"], broken["n_gaps"], broken["gap_bytes"]) == (10, 1, 6) and broken["tags"]["id3v1:title"] == "song"
    lead = mpeg_audio.parse(b"\0\xff\xfb\x90" + audio)
    assert (lead["n_frames"], lead["n_gaps"], lead["offsets"][0]) == (10, 1, 4)
    cut = mpeg_audio.parse(audio[: 9 * size + 100])
    assert (cut["n_frames"], cut["gap_bytes"]) == (9, 100)
    table = bytes([0xFF, 0xFB, 9 << 4, 0xC0]) + bytes(17) + b"Xing" + (3).to_bytes(4, "big") + (10).to_bytes(4, "big") + (5000).to_bytes(4, "big") + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    gapless = mpeg_audio.parse(table.ljust(size, b"\0") + audio)
    assert gapless["table"] == "Xing frames=10 bytes=5000 delay=576 padding=1000" and gapless["n_samples"] == 11520 - 1576
    vbri = bytes([0xFF, 0xFB, 9 << 4, 0xC0]).ljust(36, b"\0") + b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (10).to_bytes(4, "big") + bytes([0, 2, 0, 1, 0, 2, 0, 5]) + bytes([0, 9, 0, 9])
    assert mpeg_audio.parse(vbri.ljust(size, b"\0") + audio)["table"] == "VBRI frames=10 bytes=5000"
    assert mpeg_audio.parse(b"")["n_frames"] == 0 and mpeg_audio.parse(b"\xff" * 50)["n_frames"] == 0
    other = mpeg_audio.parse(frames(5, 8, 0xF3)[0])
    assert (other["version"], other["n_samples"]) == ("2", 5 * 576)


def test_damage_is_found():
    payload = bytes(range(256)) * 8 + b"\xff\xfa\xe4\xc0TAG" * 64
    payload = payload.ljust(-(-len(payload) // 64) * 64, b"\0")
    media = bytearray(mpeg_audio.pack(payload, 5))
    assert mpeg_audio.unpack(bytes(media)) == (payload, 5)
    at = mpeg_audio.parse(bytes(media))["offsets"][0]
    for place in (at + 10, at + 500):
        worse = bytearray(media)
        worse[place] ^= 1
        with pytest.raises(ValueError):
            mpeg_audio.unpack(bytes(worse))


def bitwise_crc(bits):
    """CRC-16 of a string of 0 and 1, by long division."""
    c = [1] * 16
    for b in bits:
        top = c.pop(0) ^ int(b)
        c.append(0)
        c = [x ^ (top & int(y)) for x, y in zip(c, f"{0x8005:016b}")]
    return int("".join(map(str, c)), 2).to_bytes(2, "big")


def in_bits(data):
    return "".join(f"{b:08b}" for b in data)


LAYERS = [
    ("I mono", bytes([0xFF, 0xFE, 9 << 4, 0xC0]), lambda body: 128),
    ("I stereo", bytes([0xFF, 0xFE, 9 << 4, 0x00]), lambda body: 256),
    ("I joint 8", bytes([0xFF, 0xFE, 9 << 4, 0x50]), lambda body: 160),
    ("II mono 128", bytes([0xFF, 0xFC, 8 << 4, 0xC0]), lambda body: 94 + 2 * 1),
    ("II stereo 64", bytes([0xFF, 0xFC, 4 << 4 | 1 << 2, 0x00]), lambda body: 2 * (8 + 18) + 2 * 1),
    ("II low", bytes([0xFF, 0xF4, 8 << 4, 0xC0]), lambda body: 16 + 21 + 38 + 2 * 1),
]


@pytest.mark.parametrize("name, four, covered", LAYERS)
def test_checksums_of_the_other_layers(name, four, covered):
    size = mpeg_audio.header(four)[4]
    body = bytearray(size - 6)
    body[0] = 0x10  # one subband of one channel is allotted bits
    n = covered(body)
    crc = bitwise_crc(in_bits(four[2:]) + in_bits(body)[:n])
    audio = bytearray((four + crc + body) * 4)
    good = mpeg_audio.parse(bytes(audio))
    assert (good["n_frames"], good["n_checked"], good["n_bad_crc"]) == (4, 4, 0), name
    for bit, bad in ((n - 1, 1), (n, 0)):
        worse = bytearray(audio)
        worse[size + 6 + bit // 8] ^= 128 >> bit % 8
        assert mpeg_audio.parse(bytes(worse))["n_bad_crc"] == bad, name


def test_free_format():
    four, padded = bytes([0xFF, 0xFB, 0, 0xC0]), bytes([0xFF, 0xFB, 2, 0xC0])
    body = b"\xff\xfb\x00" + bytes(773 - 7)
    audio = b"".join((padded if i % 3 == 1 else four) + body + bytes(i % 3 == 1) for i in range(9))
    got = mpeg_audio.parse(audio)
    assert (got["n_frames"], got["n_gaps"], got["n_samples"]) == (9, 0, 9 * 1152) and got["offsets"][1:3] == [773, 2 * 773 + 1]
    assert got["mean_kbps"] == 773 * 44100 // 144_000
    audio = audio.replace(body, bytes(len(body)))  # without what looks like headers
    broken = mpeg_audio.parse(audio[:773] + b"junk" + audio[773:])
    assert (broken["n_frames"], broken["gap_bytes"]) in ((9, 4), (8, 777))
    assert mpeg_audio.parse(four + bytes(3000))["n_frames"] == 0


# 6 secrets


def brute_base(text):
    out = []
    t = text or ""
    for m in re.finditer(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(x[2] for x in sorted(out))


AKIA, BLOB = "AKIA" + "A1B2C3D4E5F6G7H8", "aB3" * 13 + "x"
SECRETS = [None, "", "🙂 password = 'abc' token:x=12345 " + "ab12" * 6, f"secret=token:{AKIA} api_key=\"k.k-k_\"", f"é {AKIA}x {BLOB} https://host.example.com/a", f"{BLOB} alone, client_id=me77 " + "z " * 600 + "password: longenough", "https://a.b.c account_id: 12345 " + BLOB, "AKIA12345678 near token=abcdefgh", "password=abcdef" * 3, "PASSWORD:AAAAAA passwd = \"\"", "K token=ſecret=abcdefg"]


def test_base_spans_equal_brute_force(spark, sf_dir):
    rows = list(enumerate(SECRETS))
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")
    got = secret_links.with_secrets(df).collect()
    assert len(got) == len(SECRETS) + 1
    for r in got:
        assert r["secrets"]["base"] == brute_base(r["text"])
        assert set(filter(None, r["secrets"]["base"].split(","))) <= set(r["secrets"]["spans"].split(","))
    weak = {r["doc_id"]: {k: len(r["secrets"][k]) for k in secret_links.WEAK} for r in got}
    assert weak[4] == {"ident": 0, "blob": 1, "endpoint": 1}
    assert weak[5] == {"ident": 1, "blob": 1, "endpoint": 0}
    assert weak[6] == {"ident": 1, "blob": 1, "endpoint": 1}
    assert weak[7] == {"ident": 1, "blob": 0, "endpoint": 0}
    assert weak[1] == weak[2] == weak[8] == {"ident": 0, "blob": 0, "endpoint": 0}
    for r in secret_links.op6_secret_links(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        assert r["base_sha256"] == hashlib.sha256(brute_base(r["text"]).encode()).hexdigest()


def test_linked_parts_equal_sql(spark, tmp_path):
    r = random.Random(4)
    parts = [AKIA, BLOB, "token=abcdefgh", "https://x.y.z", "client_id=abc", "f" * 24, "AKIA1234", "host=a.b.c"]
    texts = [" ".join(r.choice([*parts, "w " * r.choice([1, 60, 150, 220])]) for _ in range(r.randint(0, 9))) for _ in range(150)]
    spark.createDataFrame([*enumerate(texts), (150, None)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    (tmp_path / "documents.parquet").write_bytes(b"".join(p.read_bytes() for p in sorted((tmp_path / "d").glob("part-*"))[:0]) or next((tmp_path / "d").glob("part-*")).read_bytes())
    assert_same(secret_links.op6_secret_links(spark, str(tmp_path)), secret_links.op6_sql(), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "documents.parquet")).count() > 10


def test_secrets_are_marked_out(spark, nothing):
    df = spark.createDataFrame([(1, f"é {AKIA} und token=abcdefgh!"), (2, "clean"), (3, None)], "doc_id long, text string")
    found = secret_links.with_secrets(df)
    got = {r["doc_id"]: r["x"] for r in found.select("doc_id", secret_links.redacted(F.col("text"), F.col("secrets")).alias("x")).collect()}
    assert got == {1: "é [SECRET] und [SECRET]!", 2: "clean", 3: None}
    assert secret_links.with_secrets(nothing).count() == 0


HUGE = {
    "host labels": "server=a" + ".a" * 500_000,
    "url": "https://" + "a." * 500_000,
    "key words": "password" * 125_000,
    "blanks": "token=" + " " * 1_000_000 + "abcdef",
    "one value": "secret=" + "a1B" * 330_000,
    "hexadecimal": "0f" * 500_000,
    "identifiers": "AKIA" * 250_000,
    "account": "client_id=" + "x" * 1_000_000 + " token=abcdefgh",
    "many matches": "é token=abcdef " * 100_000,
    "long blob": "Ab1/" * 200 + " " + AKIA,
}


def test_very_long_texts(spark):
    df = spark.createDataFrame(list(HUGE.items()), "doc_id string, text string").repartition(4)
    found = secret_links.with_secrets(df)
    got = {r["doc_id"]: r for r in found.select("doc_id", "secrets", secret_links.redacted(F.col("text"), F.col("secrets")).alias("x")).collect()}
    for k in HUGE:
        if k != "many matches":
            assert got[k]["secrets"]["base"] == brute_base(HUGE[k]), k
    many = got["many matches"]["secrets"]["assign"]
    assert [tuple(x) for x in many] == [(2 + 15 * i, 14 + 15 * i) for i in range(100_000)]
    assert got["many matches"]["x"] == "é [SECRET] " * 100_000
    assert [tuple(x) for x in got["account"]["secrets"]["ident"]] == [(0, 1_000_010)] and got["account"]["x"] == "[SECRET] [SECRET]"
    assert [tuple(x) for x in got["long blob"]["secrets"]["blob"]] == [(0, 800)] and got["long blob"]["x"] == "[SECRET] [SECRET]"


def test_endpoints_of_many_labels(spark):
    df = spark.createDataFrame([(1, f"server=a{'.a' * 500_000} {AKIA} token=abcdefgh")], "doc_id long, text string")
    (r,) = secret_links.with_secrets(df).collect()
    assert [tuple(x) for x in r["secrets"]["endpoint"]] == [(0, 1_000_008)]


def test_secrets_of_odd_rows(spark, odd):
    tail = F.lit(" token=abcdefgh")
    rows = odd.withColumn("text", F.concat("text", tail)).withColumns({k: F.lit(k) for k in ("row", "scan", "text_key", "whole", "linked", "secrets", "base")})
    got = secret_links.with_secrets(rows)
    assert got.columns == [c for c in rows.columns if c != "secrets"] + ["secrets"]
    for r in got.collect():
        assert r["secrets"]["base"] == brute_base(r["text"]) and (r["row"], r["scan"], r["linked"]) == ("row", "scan", "linked")
    assert got.count() == rows.count() and got.where("doc_id is null").count() == 1


def test_running_sums_and_maxima(spark):
    for n in (0, 1, 2, 3, 7, 64, 1000):
        v = [(i * 7919) % 101 for i in range(n)]
        (r,) = spark.createDataFrame([(v,)], "v array<int>").select(shared.running(F.col("v"), lambda a, b: a + b).alias("s"), shared.running(F.col("v"), F.greatest).alias("m")).collect()
        assert r["s"] == list(np.cumsum(v, dtype=int)) and r["m"] == [max(v[: i + 1]) for i in range(n)]


# 7 language


def test_languages_are_told_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = language_id.op7_language_id(spark, sf_dir).join(docs, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def all_ways(word, p):
    """Every segmentation, one by one."""
    if not word:
        return 1.0
    return sum(p[word[:i]] * all_ways(word[i:], p) for i in range(1, len(word) + 1) if word[:i] in p)


def all_counts(word, p):
    """(summed weight of all segmentations, weighted counts of their pieces), one by one."""
    if not word:
        return 1.0, Counter()
    total, counts = 0.0, Counter()
    for i in range(1, len(word) + 1):
        if word[:i] in p:
            rest, inner = all_counts(word[i:], p)
            weight = p[word[:i]] * rest
            total += weight
            counts[word[:i]] += weight
            for x, v in inner.items():
                counts[x] += p[word[:i]] * v
    return total, counts


def test_forward_sums_all_segmentations():
    r = random.Random(0)
    pieces = [b"a", b"b", b"ab", b"ba", b"aab", b"bab"]
    p = np.array([[r.random() for _ in range(2)] for _ in pieces])
    table = {x: row.tolist() for x, row in zip(pieces, p)}
    index = language_id.Pieces(pieces)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 11))).encode() for _ in range(60)]
    many = language_id.many_forward(words, index, p)
    for w, got in zip(words, many):
        for k in range(2):
            want = math.log(all_ways(w, {x: v[k] for x, v in table.items()}))
            assert got[k] == pytest.approx(want) and language_id.forward(w, index, p)[k] == pytest.approx(want)
    one = {x: v[0] for x, v in table.items()}
    counts = language_id.many_expected(words, np.ones(len(words)), index, p[:, 0])
    want = np.zeros(len(pieces))
    for w in words:
        total, found = all_counts(w, one)
        for x, v in found.items():
            want[pieces.index(x)] += v / total
    assert counts == pytest.approx(want) and (counts * [len(x) for x in pieces]).sum() == pytest.approx(sum(map(len, words)))


def test_small_probabilities_are_not_lost():
    """Words whose likelihoods lie far below the smallest double keep their order, short and long ones."""
    pieces = [bytes([b]) for b in range(256)]
    p = np.full((256, 2), 1e-11)
    p[ord("b"), 1] = 1e-12
    index = language_id.Pieces(pieces)
    for n in (32, 33, 500):
        word = b"a" * (n - 1) + b"b"
        want = [math.log(1e-11) * n, math.log(1e-11) * (n - 1) + math.log(1e-12)]
        got = language_id.many_forward([word], index, p)[0].tolist() if n <= language_id.SHORT else language_id.forward(word, index, p).tolist()
        assert got == pytest.approx(want)
        assert language_id.many_expected([word], np.ones(1), index, p[:, 0])[[ord("a"), ord("b")]] == pytest.approx([n - 1, 1])


def test_long_words_are_fitted_whole():
    r = random.Random(3)
    pieces = [b"a", b"b", b"ab", b"ba", b"aab", b"bab"]
    p = np.array([r.random() for _ in pieces])
    index = language_id.Pieces(pieces)
    for word in [b"abaabbab", b"aabab" * 2]:
        which, x = language_id.long_expected(word, index, p)
        total, found = all_counts(word, dict(zip(pieces, p)))
        assert np.bincount(which, x, len(pieces)) == pytest.approx([found[k] / total for k in pieces])
    long = b"aab" * 20_000
    which, x = language_id.long_expected(long, index, p / 50)
    assert (np.bincount(which, x, len(pieces)) * [len(k) for k in pieces]).sum() == pytest.approx(len(long))


@pytest.mark.parametrize("stretch", [7, 64, 1 << 18])
def test_parts_multiply_to_the_whole(monkeypatch, stretch):
    """Cuts lie where no piece does, in any stretches; likelihoods and expected counts over parts are those of the whole word."""
    monkeypatch.setattr(language_id, "STRETCH", stretch)
    r = random.Random(stretch)
    listed = ["日本", "本語", "です", "ます", " 日", "は今", "天気", "ไทย", "ภา", "ab", "bcd", "cc"]
    pieces = [*dict.fromkeys(x.encode() for x in listed), *(bytes([b]) for b in range(256))]
    p = np.array([[r.random() / 9 for _ in range(3)] for _ in pieces])
    index = language_id.Pieces(pieces)
    for n in (1, 5, 60, 300):
        word = (" " + "".join(r.choice("日本語です今は天気ますไทยภาabcd") for _ in range(n))).encode()
        parts = index.parts(word)
        assert b"".join(parts) == word
        inside = {i for i in range(1, len(word)) if not any(word[j:k] in index.index for j in range(max(0, i - 9), i) for k in range(i + 1, min(len(word), i + 9) + 1))}
        cuts = np.cumsum([len(x) for x in parts])[:-1].tolist()
        assert set(cuts) == inside
        whole = language_id.forward(word, index, p)
        assert sum(language_id.forward(x, index, p) for x in parts) == pytest.approx(whole)
        assert language_id.Predictor.of(predictor(index, p), [word[1:].decode()])[0] == pytest.approx(whole)
        which, x = language_id.long_expected(word, index, p[:, 0])
        assert language_id.many_expected([word], np.ones(1), index, p[:, 0]) == pytest.approx(np.bincount(which, x, len(pieces)))


def predictor(index, p):
    out = language_id.Predictor.__new__(language_id.Predictor)
    out.pieces, out.columns, out.width, out.kept = index, p, p.shape[1], 100
    out.clear()
    return out


def test_texts_without_blanks_cost_about_as_much_as_others():
    import time

    model = language_id.Model(["a", "b", "c", "d"], language_id.pieces_of(language_id.default_vocabulary()), None)
    r = random.Random(4)
    kana = [chr(c) for c in [*range(0x3042, 0x3094), *range(0x4E00, 0x4F00)]]
    unspaced = "".join(r.choice(kana) for _ in range(32_000))
    spaced = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(16_000))
    took = []
    for text in (spaced, unspaced):
        guess = language_id.Predictor(model)
        began = time.perf_counter()
        guess.predict(text)
        took.append((time.perf_counter() - began) / len(text.encode()))
    assert took[1] < 6 * took[0]


def test_predictions_equal_brute_force(spark, tmp_path):
    """Fitting and prediction, stated segmentation by segmentation, with a small list of pieces."""
    listed = [b" a", b" b", b"ab", b"ba", b"abc", b"bc", " é".encode(), b"cc"]
    path = tmp_path / "pieces.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(x) + b" %d" % i for i, x in enumerate(listed)))
    train = [("x", "abc ab abcbc éé"), ("x", "ab abc"), ("y", "ba bacc ccba b"), ("y", "bc ba"), ("z", "abcba cc"), (None, "ab"), ("x", None)]
    asked = [None, "", "12 !", "ab", "ba ba", "abc bacc", "éé", "zz qq", "ab ba", "abcabcabc"]
    pieces = [*listed, *(bytes([b]) for b in range(256) if bytes([b]) not in listed)]
    p = {k: {x: 1 / len(pieces) for x in pieces} for k in "xyz"}
    for _ in range(language_id.ROUNDS):
        for k in p:
            counts = Counter()
            for lang, text in train:
                for w in (text or "").split() if lang == k else ():
                    total, found = all_counts(b" " + w.encode(), p[k])
                    for x, v in found.items():
                        counts[x] += v / total
            whole = sum(counts.values()) + language_id.SMOOTH * len(pieces)
            p[k] = {x: (counts[x] + language_id.SMOOTH) / whole for x in pieces}
    model = language_id.fit(spark.createDataFrame([(i, *x) for i, x in enumerate(train)], "doc_id long, lang string, text string"), vocabulary=str(path))
    got = language_id.with_language(spark.createDataFrame(list(enumerate(asked)), "i int, text string"), model).orderBy("i").collect()
    for r in got:
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert tuple(r["language"]) == ("und", 0.0)
            continue
        like = {k: math.prod(all_ways(b" " + w.encode(), p[k]) for w in r["text"].split()) for k in p}
        best = max(sorted(like), key=like.get)
        assert r["language"]["lang"] == best and r["language"]["score"] == pytest.approx(like[best] / sum(like.values()))


def test_language_of_odd_rows(spark, odd, nothing):
    model = language_id.fit(odd)
    assert model.languages == ["en"]
    got = language_id.with_language(odd, model, into="hits").collect()
    assert len(got) == len(ODD) + 1
    assert {r["hits"]["lang"] for r in got if not re.search(r"[^\W\d_]", r["text"] or "")} == {"und"}
    empty = language_id.fit(nothing)
    assert {r["hits"]["lang"] for r in language_id.with_language(odd, empty, into="hits").collect()} == {"und"}
    assert language_id.with_language(nothing, model).count() == 0


def test_small_caches_change_nothing():
    model = language_id.Model(["a", "b"], language_id.pieces_of(language_id.default_vocabulary())[:3000] + [bytes([b]) for b in range(256) if bytes([b]) not in language_id.pieces_of(language_id.default_vocabulary())[:3000]], None)
    model.p = np.random.default_rng(1).random(model.p.shape)
    texts = [None, "a b c", " ".join(f"w{i}" for i in range(200)), "a b d", "x" * 400, ""] * 3
    big, small = language_id.Predictor(model).predict_many(texts), language_id.Predictor(model, kept=20).predict_many(texts)
    assert [x[0] for x in big] == [x[0] for x in small] and [x[1] for x in big] == pytest.approx([x[1] for x in small])


# 8 WARC


PAGES = [
    (1, "http://a", "<p>é</p>"),
    (2, "http://b", "<p>é</p>"),
    (5, "http://c", None),
    (7, None, ""),
    (None, "http://d", "<p>é</p>"),
    (9, "http://e%20f", "x" * 100_000),
    (2, "http://b", "<p>é</p>"),
    (None, "u", "lone\r\n\r\nWARC/1.1"),
    (20, "a\u2028WARC-Refers-To: <urn:page:5:1>\u0085WARC-Type: revisit\u2029x", "own"),
    (21, "b\r\nWARC-Refers-To: <urn:page:5:1>\r\n%0D\x00\r\n\r\n", "page"),
    (-3, "", "minus"),
]


@pytest.mark.parametrize("hot", [None, 1])
def test_archive_restores_records(spark, tmp_path, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(shared, "HOT_ROWS", hot)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "row": F.lit(1), "payload": F.lit(2)})
    folder = str(tmp_path / "w")
    warc_store.write_archive(df, folder)
    assert spark.read.parquet(folder + "/payloads").count() == 7
    back = warc_store.with_payloads(spark, folder).collect()
    assert Counter((r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in back) == Counter((p, u, h or "") for p, u, h in PAGES)
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in back} == {(1, "revisit", 2), (2, "response", None), (5, "revisit", 7), (7, "response", None), (None, "revisit", 2), (9, "response", None), (None, "response", None), (20, "response", None), (21, "response", None), (-3, "response", None)}
    ids = set()
    for r in back:
        fields, content = warc_store.parse_records(bytes(r["bytes"]) * 2)[1]
        ids.add(fields["WARC-Record-ID"])
        assert fields["WARC-Type"] == r["record_type"] and content == (b"" if r["record_type"] == "revisit" else bytes(r["payload"])) == bytes(r["content"])
        digest = base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode()
        assert fields["WARC-Payload-Digest"] == f"sha1:{digest}" and r["sha1"] == digest and r["size"] == len(bytes(r["payload"]))
    assert len(ids) == len(PAGES) and {f.split("WARC-Refers-To: ")[1].split("\r\n")[0] for f in (r["header"] for r in back if r["record_type"] == "revisit")} <= ids
    assert [f for r in back for f in [warc_store.parse_records(bytes(r["bytes"]))[0][0]["WARC-Type"]] if f != r["record_type"]] == []
    short = str(tmp_path / "s")
    warc_store.write_archive(df, short, least=1000)
    assert warc_store.restored(spark, short).where("record_type = 'revisit'").count() == 0


def test_damage_to_an_archive_is_found(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    warc_store.write_archive(df, folder)
    payloads, records = spark.read.parquet(folder + "/payloads"), spark.read.parquet(folder + "/records")
    cases = {"a": (payloads.withColumn("payload", F.lit(b"other")), records, "damaged payload"), "b": (payloads, records.withColumn("header", F.replace("header", F.lit("Content-Length: 9"), F.lit("Content-Length: 8"))), "is cut|differs"), "c": (payloads, records.withColumn("header", F.regexp_replace("header", "sha1:[A-Z2-7]{4}", "sha1:AAAA")), "payload differs")}
    for name, (p, r, message) in cases.items():
        p.write.parquet(f"{folder}{name}/payloads")
        r.write.parquet(f"{folder}{name}/records")
        spark.read.parquet(folder + "/uses").write.parquet(f"{folder}{name}/uses")
        with pytest.raises(Exception, match=message):
            warc_store.restored(spark, folder + name).collect()
    warc_store.write_archive(df.limit(0), str(tmp_path / "e"))
    assert warc_store.with_payloads(spark, str(tmp_path / "e")).count() == 0


def test_joins_of_hot_keys(spark):
    many = spark.range(1000).select((F.col("id") % 7 % 4).alias("k"), "id")
    one = many.groupBy("k").agg(F.count("*").alias("n"))
    for hot in (10, 200, 10_000):
        got = shared.join_hot(many, one, "k", "n", hot)
        assert got.columns == ["k", "id", "n"] and got.count() == 1000 and got.select("id").distinct().count() == 1000


def test_a_cluster_without_shared_folder_is_an_error(monkeypatch):
    class Context:
        master = "spark://x:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Session())


# 9 language model


def brute_model(train, texts, order):
    """(training tokens, (n_tokens, n_known, base, score) of each text), the model stated over plain counters."""
    tok = lambda x: [*re.findall(r"[^\x20\x09-\x0D]+", lower(x)), None]
    grams = lambda w: zip(*[(["<begin>"] * (order - 1) + w)[i:] for i in range(order)])
    uni, counts = Counter(), {order: Counter()}
    for t in train:
        uni.update(tok(t))
        counts[order].update(grams(tok(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter()
        for g, c in counts[k + 1].items():
            counts[k][g[1:]] += c if k > 1 and g[1] == "<begin>" else 1
    d = {k: kneser_ney.discounts([sum(c == i for c in x.values()) for i in (1, 2, 3, 4)]) for k, x in counts.items()}
    total, follow = Counter(), {}
    for k, x in counts.items():
        for g, c in x.items():
            total[k, g[:-1]] += c
            follow.setdefault((k, g[:-1]), [0, 0, 0])[min(c, 3) - 1] += 1
    n, v = sum(uni.values()), len(uni)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (v + 1)
        if not total[k, g[:-1]]:
            return p(g[1:])
        c = counts[k][g]
        return (max(c - d[k][min(c, 3)], 0) + sum(f * d[k][i + 1] for i, f in enumerate(follow[k, g[:-1]])) * p(g[1:])) / total[k, g[:-1]]

    out = []
    for t in texts:
        w = tok(t)
        out.append((len(w), sum(uni[x] > 0 for x in w), sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(g)) for g in grams(w))))
    return n, out


SMALL = {"SHARD": 3000, "WORDS": 3000, "PORTION": 20_000, "HOT": 200, "FAN": 3, "SEGMENT": 700}


@pytest.mark.parametrize("settings", [{}, SMALL, SMALL | {"ORDER": 3, "NARROW": 0}])
def test_scores_equal_brute_force(spark, sf_dir, monkeypatch, settings):
    """With one shard, and with many shards and portions, contexts that are spread, and texts that go on in other portions."""
    for k, x in settings.items():
        monkeypatch.setattr(kneser_ney, k, x)
    texts = texts_of(spark, sf_dir)
    keys = sorted(texts)
    n, want = brute_model([texts[k] for k in keys if zlib.crc32(str(k).encode()) % 7 != 2], [texts[k] for k in keys], kneser_ney.ORDER)
    got = {r["doc_id"]: r for r in kneser_ney.op9_kneser_ney(spark, sf_dir).collect()}
    for k, (tokens, known, base, score) in zip(keys, want):
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n) and r["held_out"] == (zlib.crc32(str(k).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


@pytest.mark.parametrize("order", [1, 3, 4])
def test_other_orders_on_odd_rows(spark, odd, nothing, order):
    rows = odd.collect()
    n, want = brute_model([r["text"] for r in rows], [r["text"] for r in rows], order)
    model = kneser_ney.train(odd, order=order)
    got = kneser_ney.with_scores(odd.withColumns({"lm": F.lit(1), "row": F.lit(2), "at": F.lit(3)}), model)
    assert model.total == n and got.columns == [*odd.columns, "row", "at", "lm"]
    key = lambda r: (r[0] or "", r[1])
    for a, b in zip(sorted(((r["text"], r["lm"]["n_tokens"], r["lm"]["score"]) for r in got.collect()), key=key), sorted(((r["text"], w[0], w[3]) for r, w in zip(rows, want)), key=key)):
        assert a[1] == b[1] and a[2] == pytest.approx(b[2])
    assert kneser_ney.with_scores(nothing, model).count() == 0


def test_scores_without_training_rows(spark, odd, nothing):
    empty = kneser_ney.train(nothing)
    assert {r["lm"]["score"] for r in kneser_ney.with_scores(odd, empty).collect()} == {0.0}
    assert kneser_ney.with_scores(nothing, empty).count() == 0


def test_probabilities_sum_to_one(spark):
    """Over all texts of up to two words: what a third word would take is one minus their sum, so it must lie between 0 and 1 for every beginning."""
    train, words = ["a b a b c", "b c d", "a b", "d d a"], ["a", "b", "c", "d", "unseen"]
    _, brute = brute_model(train, [""], kneser_ney.ORDER)
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in train], "text string"))
    asked = ["", *words]
    p = {r["text"]: 10 ** r["lm"]["score"] for r in kneser_ney.with_scores(spark.createDataFrame([(t,) for t in asked], "text string"), model).collect()}
    assert p[""] == pytest.approx(10 ** brute[0][3]) and 0 < sum(p.values()) < 1


def test_words_with_equal_polynomial_hashes_are_told_apart(spark):
    """Two words of 1,024 bytes that any polynomial modulo 2^64 gives the same hash."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    model = kneser_ney.train(spark.createDataFrame([(a,), (a,), ("c",)], "text string"))
    got = {r["text"]: r["lm"] for r in kneser_ney.with_scores(spark.createDataFrame([(a,), (b,)], "text string"), model).collect()}
    assert model.distinct == 3 and (got[a]["n_known"], got[b]["n_known"]) == (2, 1)


def test_packed_columns_round_trip():
    r = np.random.default_rng(0)
    columns = [np.sort(r.integers(0, 1 << 63, 1000).astype(np.uint64)), r.integers(0, 2000, 1000).astype(np.uint64), np.full(1000, kneser_ney.UNKNOWN)]
    for n in (1000, 1, 0):
        got = kneser_ney.unpacked(kneser_ney.packed([c[:n] for c in columns], True))
        assert all((a == c[:n]).all() and len(a) == n for a, c in zip(got, columns))


def test_counts_beyond_32_bits():
    """Counts that don't fit 32 bits stay whole when they are merged and stored."""
    big = np.array([1 << 40, 5], np.uint64)
    (keys,), (counts,), _ = kneser_ney.merged([np.array([7, 7], np.uint64)], [big])
    assert counts.tolist() == [(1 << 40) + 5] and kneser_ney.smallest(counts).tolist() == counts.tolist()
    assert kneser_ney.smallest(np.array([3], np.uint64)).dtype == np.uint32


# 10 licenses


def sequences(words):
    return [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]


def brute_licenses(text, templates):
    """All matches by one table over all hits of a template, without retrieval and hashes; (name, containment, start, stop)."""
    words = [w.decode() for w in shared.alnum_words(text)]
    out = []
    for name, t in templates:
        own = sequences([w.decode() for w in shared.alnum_words(t)])
        hits = [(p, q) for p, g in enumerate(sequences(words)) if g in own for q, h in enumerate(own) if g == h]
        need, far = math.ceil(0.8 * len(own) - 1e-9), max(2 * len(own), 64) + 5
        state = []  # (hits of the cut, hits of the chain, chain, the cut before it)
        for i, (p, q) in enumerate(hits):
            done = max((s for (e, _), s in zip(hits, state) if e + 5 <= p and s[1] >= need), key=lambda s: s[0], default=(0, 0, [], []))
            way = (done[0] + 1, 1, [p], done[3] + [done[2]] * bool(done[2]))
            for k in range(i - 1, -1, -1):
                s = state[k]
                if p > hits[k][0] >= p - far and hits[k][1] < q and ((s[0] + 1, s[1] + 1) > way[:2] or ((s[0] + 1, s[1] + 1) == way[:2] and len(way[2]) == 1)):
                    way = (s[0] + 1, s[1] + 1, s[2] + [p], s[3])
            state.append(way)
        best = max((s for s in state if s[1] >= need), key=lambda s: s[0], default=None)
        out += [(name, len(c) / len(own), c[0], c[-1] + 5) for c in (best[3] + [best[2]] if best else [])]
    return sorted(out, key=lambda x: (x[2], x[0]))


def found_licenses(index, texts):
    found = index.scan([shared.alnum_words(t) for t in texts])
    return [sorted(found.get(i, []), key=lambda x: (x[2], x[0])) for i in range(len(texts))]


def test_notices_equal_brute_force():
    """Notices with changed words, stretches put in, words gone, in a row, cut short, inside one another's words."""
    r = random.Random(3)
    index, texts = license_scan.Index(license_scan.TEMPLATES), []
    for name, t in license_scan.TEMPLATES:
        for edits in (0, 1, 2, 3):
            w = t.split()
            for _ in range(edits):
                k = r.randrange(len(w))
                w[k : k + r.randrange(3)] = [f"z{r.randrange(99)}" for _ in range(r.choice((0, 1, 1, 9, len(w))))]
            texts.append(" ".join([f"f{r.randrange(999)}" for _ in range(r.randrange(30))] + w + [f"b{r.randrange(999)}" for _ in range(r.randrange(30))]))
        w = t.split()
        texts += [f"{t} {t}", " ".join(w[: len(w) * 9 // 10] + w + w[len(w) // 2 :] + w)]
    assert found_licenses(index, texts) == [brute_licenses(t, license_scan.TEMPLATES) for t in texts]


def test_an_inserted_stretch_is_found():
    """Whatever is put into a notice, up to its reach: found if 0.8 of its shingles are left."""
    r = random.Random(8)
    index = license_scan.Index(license_scan.TEMPLATES)
    for name, t in license_scan.TEMPLATES:
        w, n = t.split(), len(shared.alnum_words(t)) - 4
        for _ in range(12):
            k = r.randrange(1, len(w))
            text = " ".join(w[:k] + [f"z{r.randrange(999)}" for _ in range(r.choice((1, 7, max(64, 2 * n) - 4)))] + w[k:])
            if n - 4 >= 0.8 * n:
                assert name in {x[0] for x in found_licenses(index, [text])[0]}


def test_two_thousand_copies_are_two_thousand():
    isc = dict(license_scan.TEMPLATES)["isc"]
    found = [x for x in found_licenses(license_scan.Index(license_scan.TEMPLATES), [" ".join([isc] * 2000)])[0] if x[0] == "isc"]
    assert found == [("isc", 1.0, 34 * k, 34 * k + 34) for k in range(2000)]


def test_licenses_of_documents_equal_brute_force(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    rows = license_scan.op10_license_scan(spark, sf_dir).collect()
    assert any(r["n_licenses"] for r in rows) and len(rows) == len(texts)
    for x in rows:
        want = brute_licenses(texts[x["doc_id"]], license_scan.TEMPLATES)
        assert x["spans"] == ",".join(f"{m[0]}:{m[2]}:{m[3]}" for m in want) and x["n_licenses"] == len(want)
        assert x["license_ids"] == ",".join(sorted({m[0] for m in want})) and x["best_containment"] == max((m[1] for m in want), default=0.0)


def test_licenses_of_odd_rows(spark, odd, nothing):
    got = license_scan.with_licenses(odd, into="hits", templates=[("x", "lorem ipsum lorem ipsum lorem ipsum")]).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        assert (r["hits"]["n"] > 0) == (r["text"] == LONG)
    assert license_scan.with_licenses(nothing).count() == 0
    assert {r["licenses"]["n"] for r in license_scan.with_licenses(odd, templates=[]).collect()} == {0}
    with pytest.raises(ValueError):
        license_scan.with_licenses(odd, templates=[("x", "too short")])


# shared


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {x["node"]: x["root"] for x in shared.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for node in (x for e in edges for x in e):
        seen, front = {node}, [node]
        while front:
            for y in near[front.pop()] - seen:
                seen.add(y)
                front.append(y)
        assert got.get(node, node) == min(seen)
    assert shared.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows_of_sql_helpers(sf_dir):
    names, rows = duck("SELECT 1 AS b, 2 AS a", sf_dir)
    assert bag(names, rows) == Counter([(2, 1)])
