"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of WINDOW consecutive words of benchmark items (an item of fewer words is one shorter
window). Words become numbers of the benchmark's vocabulary, 0 for all others, and patterns of equal length share:

* a shift table over blocks of two words: how far the search may jump when such a block ends at the cursor;
* suffix-hash buckets: where the jump is 0, the window's last and first block select the test strings;
* direct comparison of all words of the window with each selected string.

The cursors of many stretches of a batch move at once, as numpy vectors; stretches overlap by a pattern's length less
one word, so none is missed, and a gap word between texts keeps matches inside a text.

The benchmark is measured first, each item counted once however often its row repeats. While its words stay below max_words it
is one automaton, which is broadcast. Beyond that, items are cut into pieces that overlap by a window less one word, so that
every window lies in a piece, and the pieces go to blocks whose words are counted and, while one is above the bound, halved.
Every block runs over all texts, one broadcast at a time in a worker.

Null or wordless texts have no words and no hits; null or wordless items have no windows, and an item whose id is null
goes by the name null. Very long texts are searched whole, by many cursors. Repeated rows of texts give repeated rows, repeated item ids
count once; items that share a window are all reported. Empty tables are allowed on either side. Other columns stay, whatever
their names; the result is one struct column that the caller names, in place of one of that name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.session import spread

from .shared import alnum_words, bound_batches, discard, map_file, mixed, new_folder, put_file, settle

#: Words of a window; benchmark words in one broadcast; words that one cursor searches.
WINDOW, MAX_WORDS, STRETCH = 10, 300_000, 256
SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start: int, stop: int>>"
MIX = np.uint64(0x9E3779B97F4A7C15)


def stops(jump: np.ndarray, m: int) -> np.ndarray:
    """The places where cursors that jump so far from each place, one for each stretch, find no jump: possible ends of patterns of length m."""
    n, found = len(jump), [np.empty(0, np.int64)]
    at = np.arange(m - 1, n, STRETCH)
    last = np.minimum(at + STRETCH, n)
    while len(at):
        step = jump[at]
        if len(hit := at[step == 0]):
            found.append(hit)
        at = at + np.maximum(step, 1)
        live = at < last
        at, last = at[live], last[live]
    return np.concatenate(found)


class Group:
    """The patterns of one length."""

    def __init__(self, rows: np.ndarray, owners: list[set[str]]):
        self.rows, self.owners = rows, owners
        self.m = rows.shape[1]
        self.b = min(2, self.m)
        codes = self.blocks(rows.reshape(-1)).reshape(rows.shape)  # code of the block that ends at each place
        self.bits = max(10, int(rows.size).bit_length() + 3)
        self.shift = np.full(1 << self.bits, self.m - self.b + 1, np.int32)
        for j in range(self.b - 1, self.m):
            np.minimum.at(self.shift, self.slot(codes[:, j]), self.m - 1 - j)
        both = self.both(codes[:, self.m - 1], codes[:, self.b - 1])
        self.order = np.argsort(both, kind="stable")
        self.keys = both[self.order]

    def blocks(self, ids: np.ndarray) -> np.ndarray:
        """The code of the block of b words that ends at each place."""
        if self.b == 1:
            return ids.astype(np.uint64)
        out = ids.astype(np.uint64)
        out[1:] |= ids[:-1].astype(np.uint64) << np.uint64(32)
        return out

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def both(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return (suffix * MIX) ^ ((prefix + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence in ids."""
        m, n = self.m, len(ids)
        if n < m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = self.blocks(ids)
        jump = self.shift[self.slot(codes)]
        jump[ids == 0] = m
        ends = stops(jump, m)
        if not len(ends):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = self.both(codes[ends], codes[ends - m + self.b])
        low, high = np.searchsorted(self.keys, both, "left"), np.searchsorted(self.keys, both, "right")
        starts, which = [], []
        for k in range(int((high - low).max(initial=0))):
            live = low + k < high
            e, p = ends[live], self.order[low[live] + k]
            same = np.ones(len(e), bool)
            for j in range(m):
                same &= ids[e - m + 1 + j] == self.rows[p, j]
            starts.append(e[same] - m + 1)
            which.append(p[same])
        return (np.concatenate(starts), np.concatenate(which)) if starts else (np.empty(0, np.int64), np.empty(0, np.int64))


class Automaton:
    """All patterns of a block of items (id, text)."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        by: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for name, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in alnum_words(text)]
            k = min(window, len(words))
            for i in range(len(words) - k + 1 if k else 0):
                by.setdefault(k, {}).setdefault(tuple(words[i : i + k]), set()).add(name)
        self.groups = [Group(np.array(list(found), np.int64), list(found.values())) for _, found in sorted(by.items())]

    def search(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """(first place of each text, hit places, items by text) over the texts' words laid end to end with one gap word each."""
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(w) + 1 for w in texts], out=starts[1:])
        get, ids = self.ids.get, np.zeros(int(starts[-1]), np.int64)
        for s, words in zip(starts, texts):
            ids[s : s + len(words)] = [get(w, 0) for w in words]
        edge, items = np.zeros(len(ids) + 1, np.int32), {}
        for g in self.groups:
            at, which = g.find(ids)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + g.m, -1)
            pairs = np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, which], 1), axis=0) if len(at) else ()
            for d, p in pairs:
                items.setdefault(int(d), set()).update(g.owners[p])
        return starts, np.cumsum(edge)[:-1] > 0, items


def digest(n_words: int, n_hit: int, items, spans) -> tuple:
    names = sorted(items)
    return n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0, names, spans


def runs(hit: np.ndarray) -> list[dict[str, int]]:
    """The stretches of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2])]


HITS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"]


def hit_rows(words: list[list[bytes]], starts: np.ndarray, hit: np.ndarray, items: dict[int, set[str]]) -> list[tuple]:
    """Rows of SCHEMA, of what a search gives."""
    total, rows = np.concatenate(([0], np.cumsum(hit))), []
    for d, w in enumerate(words):
        a, b = int(starts[d]), int(starts[d]) + len(w)
        k = int(total[b] - total[a])
        rows.append(digest(len(w), k, items.get(d, ()), runs(hit[a:b]) if k else []))
    return rows


def searcher(shared):
    """Pandas function from texts to SCHEMA, over the automaton in a broadcast."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        for texts in batches:
            words = [alnum_words(t) for t in texts]
            yield pd.DataFrame(hit_rows(words, *automaton.search(words)), columns=HITS)

    return run.asNondeterministic()


#: A word of a text whose A-Z aren't lower-cased yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows of a shard, about; bits of the slots in one range of a shift table; files that a worker keeps mapped.
SHARD, RANGE, MAPPED = 200_000, 20, 500
ROW = np.dtype([("at", "<u8"), ("size", "<u4"), ("name", "<u4")])


def block_codes(h: np.ndarray, b: int) -> np.ndarray:
    """The code of the block of b words that ends at each place of hashed words (along the last axis)."""
    if b == 1:
        return mixed(h, 1)
    out = h.copy()
    with np.errstate(over="ignore"):
        out[..., 1:] ^= h[..., :-1] * MIX
    return mixed(out, 2)


def hashed_words(words: list[bytes]) -> np.ndarray:
    import xxhash

    index = dict(zip(dict.fromkeys(words), count()))
    values = np.fromiter((xxhash.xxh64_intdigest(w) if w else 0 for w in index), np.uint64, len(index))
    return values[np.fromiter(map(index.__getitem__, words), np.int64, len(words))]


class Tables:
    """A benchmark's shift tables and windows in files. lengths: windows by their number of words; bits: of the slots of a length's shift table, and of those in one file; shards of its windows."""

    def __init__(self, folder: str, bits: dict[int, int], shards: dict[int, int], part: int):
        self.folder, self.bits, self.shards, self.part = folder, bits, shards, part
        self.there: dict[str, object] = {}

    def file(self, name: str, kind):
        """A file's array, or None if there is none."""
        if name not in self.there:
            if len(self.there) >= MAPPED:
                self.there.clear()
            try:
                self.there[name] = map_file(f"{self.folder}/{name}").view(kind)
            except FileNotFoundError:
                self.there[name] = None
        return self.there[name]

    def jumps(self, codes: np.ndarray, m: int, b: int) -> np.ndarray:
        slots = (codes >> np.uint64(64 - self.bits[m])).astype(np.int64)
        out = np.full(len(slots), m - b + 1, np.int32)
        order = np.argsort(slots, kind="stable")
        ranges = slots[order] >> self.part
        cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            table = self.file(f"shift-{m}-{ranges[i]}", np.uint8)
            if table is not None:
                own = order[i:j]
                out[own] = np.minimum(table[slots[own] & ((1 << self.part) - 1)], m - b + 1)
        return out

    def find(self, words: list[bytes], h: np.ndarray, m: int) -> Iterator[tuple[int, str]]:
        """(start, item) of every window of m words in words."""
        b = min(2, m)
        codes = block_codes(h, b)
        jump = self.jumps(codes, m, b)
        jump[h == 0] = m
        ends = stops(jump, m)
        both = Group.both(codes[ends], codes[ends - m + b])
        shard = both % np.uint64(self.shards[m])
        for k in np.unique(shard).tolist():
            keys = self.file(f"keys-{m}-{k}", "<u8")
            if keys is None:
                continue
            own = np.flatnonzero(shard == k)
            low, high = np.searchsorted(keys, both[own], "left"), np.searchsorted(keys, both[own], "right")
            rows, blob = self.file(f"rows-{m}-{k}", ROW), self.file(f"text-{m}-{k}", np.uint8)
            for i in np.flatnonzero(high > low).tolist():
                end = int(ends[own[i]])
                text = b" ".join(words[end - m + 1 : end + 1])
                for r in rows[low[i] : high[i]]:
                    at = int(r["at"])
                    if r["size"] == len(text) and blob[at : at + len(text)].tobytes() == text:
                        yield end - m + 1, blob[at + len(text) : at + len(text) + int(r["name"])].tobytes().decode("utf-8", "surrogatepass")


def tables_of(items: DataFrame, window: int) -> Tables:
    """Writes the tables of items (id, text)."""
    folder = new_folder(items.sparkSession, "benchmark")
    words = items.select("id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    m = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - m + 1)
    windows = words.select("id", "w", m.alias("m"), F.explode(starts).alias("at")).select("id", "m", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("text"))
    windows = settle(windows.distinct())
    sizes = {r["m"]: r["count"] for r in windows.groupBy("m").count().collect()}
    bits = {k: max(12, int(n * k).bit_length() + 3) for k, n in sizes.items()}
    shards = {k: n // SHARD + 1 for k, n in sizes.items()}

    def hashed(frame: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, list[bytes], np.ndarray]]:
        """By length: (length, rows, words joined, codes)."""
        for k, part in frame.groupby("m"):
            split = [alnum_words(t) for t in part["text"]]
            yield int(k), part, [b" ".join(w) for w in split], block_codes(hashed_words([w for s in split for w in s]).reshape(len(part), int(k)), min(2, int(k)))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for k, part, joined, codes in hashed(frame):
                both = Group.both(codes[:, k - 1], codes[:, min(2, k) - 1])
                yield pd.DataFrame({"m": k, "shard": (both % np.uint64(shards[k])).astype(np.int64), "both": both.view(np.int64), "text": joined, "id": part["id"]})

    def shifts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for k, _, _, codes in hashed(frame):
                for j in range(min(2, k) - 1, k):
                    yield pd.DataFrame({"m": k, "slot": np.unique((codes[:, j] >> np.uint64(64 - bits[k])).astype(np.int64)), "shift": k - 1 - j})

    def write_shard(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        k, shard = key
        frame = frame.drop_duplicates(["text", "id"])
        both = frame["both"].to_numpy().view(np.uint64)
        order = np.argsort(both, kind="stable")
        texts, names = frame["text"].tolist(), [x.encode("utf-8", "surrogatepass") for x in frame["id"]]
        rows, blob, at = np.zeros(len(order), ROW), [], 0
        for i, j in enumerate(order.tolist()):
            rows[i] = at, len(texts[j]), len(names[j])
            blob += [texts[j], names[j]]
            at += len(texts[j]) + len(names[j])
        for name, data in (("keys", both[order].astype("<u8").tobytes()), ("rows", rows.tobytes()), ("text", b"".join(blob))):
            put_file(f"{folder}/{name}-{k}-{shard}", data)
        return pd.DataFrame({"m": [k]})

    def write_range(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        k, part = key
        table = np.full(1 << min(RANGE, bits[int(k)]), 255, np.uint8)
        table[frame["slot"].to_numpy() & ((1 << RANGE) - 1)] = frame["shift"].to_numpy()
        put_file(f"{folder}/shift-{k}-{part}", table.tobytes())
        return pd.DataFrame({"m": [k]})

    windows.mapInPandas(keyed, "m long, shard long, both long, text binary, id string").groupBy("m", "shard").applyInPandas(write_shard, "m long").count()
    low = windows.mapInPandas(shifts, "m long, slot long, shift long").groupBy("m", "slot").agg(F.min("shift").alias("shift"))
    low.groupBy("m", F.shiftright("slot", RANGE).alias("part")).applyInPandas(write_range, "m long").count()
    discard(windows)
    return Tables(folder, bits, shards, RANGE)


def file_searcher(tables: Tables):
    """searcher over tables in files."""
    folder, bits, shards, part = tables.folder, tables.bits, tables.shards, tables.part

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Tables(folder, bits, shards, part)
        for texts in batches:
            words = [alnum_words(t) for t in texts]
            flat = [w for t in words for w in (*t, b"")]
            starts = np.cumsum([0, *(len(t) + 1 for t in words)])
            h, edge, items = hashed_words(flat), np.zeros(len(flat) + 1, np.int32), {}
            for m in sorted(bits):
                for at, item in own.find(flat, h, m):
                    edge[at] += 1
                    edge[at + m] -= 1
                    items.setdefault(int(np.searchsorted(starts, at, "right")) - 1, set()).add(item)
            hit = np.cumsum(edge)[:-1] > 0
            yield pd.DataFrame(hit_rows(words, starts, hit, items), columns=HITS)

    return run.asNondeterministic()


def with_benchmark_hits(df: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "hits", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """df and a struct column: words, words hit, items (number, digest, names) and spans of hit words of each text."""
    spark = df.sparkSession
    bound_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("text")).distinct()
    size = items.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if (size["n"] or 0) <= max_words and (size["bytes"] or 0) <= 16 * max_words:
        automaton = spark.sparkContext.broadcast(Automaton([(r["id"], r["text"]) for r in items.collect()], window))
        return df.withColumn(into, searcher(automaton)(df[text]))
    return df.withColumn(into, file_searcher(tables_of(items, window))(df[text]))


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text")
    out = with_benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "hits.n_words", "hits.n_hit", "hits.n_items", "hits.items_sha256", "hits.contaminated")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, i, n, item FROM grams JOIN win USING (n, s)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS names FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""
