"""Language-model scores: an interpolated modified Kneser-Ney n-gram model, counted in Spark over all training texts.

Tokens are the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end token for every text. Before its first token a
text has order - 1 begin marks, which are never predicted.

Words are spelled out wherever they are counted or looked up, so no two are taken for one. A word's number is its rank among
its shard's words, the most frequent first. Contexts of two words or more are told apart by 64 bits of a hash of their numbers
(among 10^12 contexts some 30,000 would share one; orders one and two have no such contexts).

1. `encoded` turns texts into portions, files of local word codes in the shared folder, each word spelled once a portion.
   It runs once, for training and scoring alike. A long text goes on in pieces that carry their last words along.
2. Words are counted by shard. A portion looks its words up by sending them to their shards, and is numbered.
3. N-grams of the highest order are counted per portion, sent packed to shards by context, and written as sorted arrays of
   context hashes, words and counts. Each shard passes on, for the n-grams one word shorter, how many words precede them
   (for those that begin a text, how often they occur), and so on down to words: these are the adjusted counts.
4. Discounts of every order come from the numbers of n-grams with adjusted counts of one to four.

Scoring sends a portion's distinct n-grams to the shards that can have them; there a worker memory-maps one shard's arrays,
looks them up by binary search, and sends counts back, from which the portion adds up log10 probabilities:
p(w|h) = (c(hw) - D) / c(h.) + g(h) p(w|h'), down to p(w) = (N(.w) - D) / N(..) + g / (V + 1).

Hot keys: a context whose words all occur HOT times or more is spread over several shards by its words, the more the oftener
they occur, and its totals are added up apart. Portions count before anything is shuffled, and more than FAN portions
are merged in two rounds. The driver and broadcasts hold one row a level, whatever the size of the corpus.

Nulls are empty texts, whose one token is the end. Without training rows every probability is 1 / (V + 1) = 1. Repeated
rows and rows with equal keys repeat (and count as often in training), as no key is used; equal texts have equal scores.
Empty tables give empty results. Other columns stay, whatever their names; a column of the result's name is replaced. Very long texts go by
pieces of SEGMENT bytes, cut at blanks.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain, count
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.session import spread

from .shared import bound_batches, map_file, mixed, new_folder, put_file, settle

#: Words that a probability depends on, the predicted one included. With three the check tool stopped the query on 0.10 GB of
#: documents at 0.71 GB of disk (16 million trigrams), seven times the input and before it scored; its budget is four times.
ORDER = 2
#: N-grams and words that a shard is sent on average; occurrences of a context's rarest word for each shard that it is spread over; portions merged at once.
SHARD, WORDS, HOT, FAN = 1_200_000, 800_000, 3_000_000, 2048
#: Bytes of texts in a portion, and of a piece of a long text.
PORTION, SEGMENT = 10 << 20, 1 << 20
#: Stand for words that no text has: they contain a blank. Their codes in every portion.
END, BEGIN = b" end", b" begin"
END_CODE, BEGIN_CODE = 0, 1
#: Numbers of the begin mark and of words that training texts don't have.
BEGIN_ID, UNKNOWN = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
BLANK_BYTE = re.compile(rb"[\x20\x09-\x0d]")
ROWS = "level int, shard long, kind string, portion long, blob binary"
#: Contexts of a shard whose places fit into half a key.
NARROW = 1 << 32
#: Kinds of rows: n-grams with counts, totals of contexts that are spread, numbers of n-grams by count.
GRAMS, TOTALS, STATS = "grams", "totals", "stats"


def segments(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about SEGMENT bytes that end at blanks."""
    at = 0
    while len(raw) - at > SEGMENT:
        cut = BLANK_BYTE.search(raw, at + SEGMENT)
        if cut is None:
            break
        yield raw[at : cut.start()]
        at = cut.start()
    yield raw[at:]


def zipped(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def unzipped(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def packed(columns: list[np.ndarray], rising: bool = False) -> bytes:
    """Columns of equal length, of numbers up to 64 bits, in few bytes. rising: the first one is sorted."""
    first = np.diff(columns[0].astype(np.uint64), prepend=np.uint64(0)) if rising else columns[0].astype(np.uint64)
    rows = np.stack([first, *(c.astype(np.uint64) for c in columns[1:])])
    planes = rows.astype("<u8").view(np.uint8).reshape(*rows.shape, 8).transpose(0, 2, 1)
    return zipped(np.array([*rows.shape, rising], "<u8").tobytes() + planes.tobytes())


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(unzipped(blob), np.uint8)
    width, n, rising = (int(x) for x in raw[:24].view("<u8"))
    rows = np.ascontiguousarray(raw[24:].reshape(width, 8, n).transpose(0, 2, 1)).view("<u8").reshape(width, n).astype(np.uint64)
    if rising:
        rows[0] = np.cumsum(rows[0], dtype=np.uint64)
    return list(rows)


def with_words(words: list[bytes], counts: np.ndarray) -> bytes:
    """Words and a number for each, in few bytes."""
    spelled = zipped(b"\n".join(words))
    return len(spelled).to_bytes(8, "little") + spelled + packed([counts])


def words_of(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    counts = unpacked(blob[8 + n :])[0]
    return (unzipped(blob[8 : 8 + n]).split(b"\n") if len(counts) else []), counts


def put_arrays(address: str, **arrays: np.ndarray) -> None:
    """A file of named arrays that can be mapped."""
    head = json.dumps([[k, a.dtype.str, len(a)] for k, a in arrays.items()]).encode()
    parts = [len(head).to_bytes(8, "little"), head]
    for a in arrays.values():
        parts += b"\0" * (-sum(map(len, parts)) % 8), a.tobytes()
    put_file(address, b"".join(parts))


def map_arrays(address: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    raw = map_file(address)
    size = int(raw[:8].view("<u8")[0])
    at, out = 8 + size, {}
    for name, kind, n in json.loads(raw[8 : 8 + size].tobytes()):
        at += -at % 8
        width = n * np.dtype(kind).itemsize
        out[name] = raw[at : at + width].view(kind)
        at += width
    return out


def smallest(values: np.ndarray) -> np.ndarray:
    """The values in 32 bits if they fit, else in 64."""
    return values.astype(np.uint32) if not len(values) or values.max() < 1 << 32 else values.astype(np.uint64)


class Portion:
    """A portion that is being filled."""

    def __init__(self) -> None:
        self.id, self.codes, self.pieces, self.bytes = uuid.uuid4().int >> 65, [], [], 0
        self.local: defaultdict[bytes, int] = defaultdict(count().__next__)
        for word in (END, BEGIN):
            self.local[word]

    def add(self, home: tuple[int, int], train: bool, before: list[bytes], words: list[bytes]) -> None:
        n = len(before) + len(words)
        self.codes.append(np.fromiter(map(self.local.__getitem__, chain(before, words)), np.uint32, n))
        self.pieces.append((*home, len(words), train))

    def save(self, folder: str) -> None:
        codes = np.concatenate(self.codes).astype("<u4").view(np.uint8).reshape(-1, 4).T
        blobs = {"words": b"\n".join(self.local), "codes": codes.tobytes()}
        home, place, size, train = (np.array(x, np.int64) for x in zip(*self.pieces))
        put_arrays(f"{folder}/portion-{self.id}", home=home, place=place, size=size, train=train, **{k: np.frombuffer(zipped(b), np.uint8) for k, b in blobs.items()})


def encoder(folder: str, order: int):
    """Function over texts and whether they train: the portion and the place of each text, and the portions where it goes on."""

    @F.pandas_udf("portion long, place long, more array<long>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        now = Portion()
        for texts, train in batches:
            rows = []
            for text, trains in zip(texts, train):
                raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
                home, more, before = (now.id, len(now.pieces)), [], [BEGIN] * (order - 1)
                at = 0
                for piece in segments(raw):
                    at += len(piece)
                    words = piece.split()
                    if at == len(raw):
                        words.append(END)
                    if now.bytes + len(piece) > PORTION and now.pieces:
                        now.save(folder)
                        now = Portion()
                        if at == len(piece):
                            home = (now.id, 0)
                        else:
                            more.append(now.id)
                    now.add(home, bool(trains), before, words)
                    now.bytes += len(piece)
                    before = [*before, *words][len(words) :] if len(words) < order - 1 else words[len(words) - order + 1 :]
                rows.append((*home, more))
            yield pd.DataFrame(rows, columns=["portion", "place", "more"])
        if now.pieces:
            now.save(folder)

    return run.asNondeterministic()


def spread_out(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows in up to n partitions, by keys if there are any: few bytes of packed rows can be much work, which the planner doesn't see."""
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(n, max(4 * parallel, n // 64))), *keys)


@dataclass
class Encoded:
    """Texts as portions: rows (row, at), the ids of all portions, their number, how many words they spell, training texts and all tokens."""

    rows: DataFrame
    portions: DataFrame
    folder: str
    order: int
    n: int
    spelled: int
    texts: int
    tokens: int


def encoded(df: DataFrame, text: str = "text", train: Column | None = None, order: int = ORDER, drop: tuple[str, ...] = ()) -> Encoded:
    """df's texts as portions. train: the rows to learn from (all); drop: columns that the rows don't keep."""
    spark = df.sparkSession
    bound_batches(spark)
    folder = new_folder(spark, "portions")
    trains = F.coalesce(train, F.lit(False)) if train is not None else F.lit(True)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in drop] or [F.lit(None).alias("none")]
    rows = settle(df.select(F.struct(*kept).alias("row"), encoder(folder, order)(F.col(text), trains).alias("at")))
    portions = settle(rows.select(F.explode(F.concat(F.array("at.portion"), "at.more")).alias("portion")).distinct())

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["portion"]:
                f = map_arrays(f"{folder}/portion-{p}")
                begins = (f["home"] == p) & (np.arange(len(f["home"])) == f["place"])  # other pieces go on with a text
                yield pd.DataFrame({"words": [len(spelled_words(f))], "texts": [int(f["train"][begins].sum())], "tokens": [int(f["size"].sum())]})

    found = spread_out(portions, portions.count()).mapInPandas(sizes, "words long, texts long, tokens long")
    n, *sums = found.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in found.columns]).first()
    return Encoded(rows, portions, folder, order, n, *sums)


def spelled_words(file: dict[str, np.ndarray]) -> list[bytes]:
    """A portion's words, by code."""
    return unzipped(file["words"].tobytes()).split(b"\n")


@dataclass
class Level:
    """The distinct k-grams of a portion.

    at: for every place, the k-gram that ends there; columns: the codes of each one's words; wanted: whether it ends with a
    token; shorter: the (k-1)-gram that ends where it does.
    """

    at: np.ndarray
    columns: np.ndarray
    wanted: np.ndarray
    shorter: np.ndarray | None


@dataclass
class Stream:
    """A portion as it was written: places of tokens, pieces, and all its n-grams."""

    real: np.ndarray
    train: np.ndarray
    pieces: dict[str, np.ndarray]
    codes: np.ndarray
    levels: list[Level] = field(default_factory=list)

    @classmethod
    def read(cls, folder: str, portion: int, order: int, code: np.ndarray, upto: int | None = None) -> Stream:
        """code: what stands for each of the portion's codes. N-grams are sorted by it."""
        f = map_arrays(f"{folder}/portion-{portion}")
        codes = np.ascontiguousarray(np.frombuffer(unzipped(f["codes"].tobytes()), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
        codes = code[codes]
        length = f["size"] + order - 1
        place = np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)
        real = place >= order - 1
        out = cls(real, np.repeat(f["train"] > 0, length) & real, {k: f[k] for k in ("home", "place", "size")}, codes)
        at, columns, shorter = codes, np.arange(len(code)).reshape(-1, 1), None
        for k in range(1, (order if upto is None else upto) + 1):
            if k > 1:
                inside = np.flatnonzero(place >= k - 1)
                pairs, back = np.unique(at[inside - 1] << 32 | codes[inside], return_inverse=True)
                before, shorter = at, np.empty(len(pairs), np.int64)
                shorter[back] = before[inside]
                columns = np.column_stack((columns[pairs >> 32], pairs & 0xFFFFFFFF))
                at = np.zeros(len(codes), np.int64)
                at[inside] = back
            wanted = np.zeros(len(columns), bool)
            wanted[at[real]] = True
            out.levels.append(Level(at, columns, wanted, shorter))
        return out


def hashed(words: np.ndarray) -> np.ndarray:
    """A hash of each row of word numbers."""
    out = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        out = mixed(words[:, i] ^ (out << np.uint64(1) | out >> np.uint64(63)), 5)
    return out


def splits(counts: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Over how many shards each context (of codes) is spread: by the count of its rarest word."""
    return counts[contexts].min(axis=1) // np.uint64(HOT) + np.uint64(1) if contexts.shape[1] else np.ones(len(contexts), np.uint64)


def shards_of(grams: np.ndarray, split: np.ndarray, n: int) -> np.ndarray:
    """Where n-grams (of word numbers) are: by context and, for contexts that are spread, by word; single words by themselves."""
    word = mixed(grams[:, -1], 2)
    return (mixed(hashed(grams[:, :-1]) + word % split, 3) if grams.shape[1] > 1 else word) % np.uint64(n)


def rank_of(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows of columns, the first one first."""
    if len(columns) == 2 and len(columns[0]) and max(columns[0].max(), columns[1].max()) < 1 << 32:
        columns = [columns[0] << np.uint64(32) | columns[1]]  # one key sorts several times faster than two
    return np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])


def merged(keys: list[np.ndarray], values: list[np.ndarray], given: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of key columns, sorted, their summed values, and what is given with a key."""
    given = given or []
    if not len(keys[0]):
        return keys, values, given
    order = rank_of(keys)
    keys = [k[order] for k in keys]
    first = np.flatnonzero(np.concatenate(([True], reduce(np.logical_or, [k[1:] != k[:-1] for k in keys]))))
    return [k[first] for k in keys], [np.add.reduceat(v[order], first) for v in values], [g[order[first]] for g in given]


def gathered(frame: pd.DataFrame, width: int) -> list[np.ndarray]:
    """The columns of all blobs of a frame, put together."""
    parts = [unpacked(b) for b in frame["blob"]]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.uint64) for i in range(width)]


def every_shard(rows: DataFrame, n: int, blob: bytes) -> DataFrame:
    """Rows by shard, with an empty blob for every shard, so that none goes without a file."""
    every = rows.sparkSession.range(n).select(F.lit(0).alias("level"), F.col("id").alias("shard"), F.lit(GRAMS).alias("kind"), F.lit(0).cast("long").alias("portion"), F.lit(blob).alias("blob"))
    return spread_out(rows.unionAll(every), 4 * n, "shard")


def merged_first(rows: DataFrame, merge, portions: int) -> DataFrame:
    """Rows of many portions, FAN of a shard merged into one. merge: from a frame to a blob."""

    def run(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        return as_rows([(int(frame["level"].iat[0]), key[0], GRAMS, key[1], merge(frame))])

    return salted(rows, portions).groupBy("shard", "salt").applyInPandas(run, ROWS) if portions > FAN else rows


def salted(rows: DataFrame, portions: int) -> DataFrame:
    """Rows with a salt that few enough portions share."""
    return rows.withColumn("salt", F.pmod("portion", F.lit(-(-portions // FAN) or 1)))


def sent(level: int, kind: str, portion: int, shard: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """A row for every shard that is sent something. Columns are sorted by the first one."""
    shard = shard.astype(np.uint16) if not len(shard) or shard.max() < 1 << 16 else shard  # sorts in linear time
    order = np.argsort(shard, kind="stable")
    keys, cuts = np.unique(shard[order], return_index=True)
    return [(level, int(s), kind, portion, packed([c[at] for c in columns], True)) for s, at in zip(keys, np.split(order, cuts[1:]))]


def as_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["level", "shard", "kind", "portion", "blob"])


def over_portions(make):
    """Function for mapInPandas that makes rows from each portion."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["portion"].tolist():
                yield as_rows(make(p))

    return run


@dataclass
class Model:
    """What scoring must know besides the shards' files: a bounded number of values."""

    folder: str
    order: int
    word_shards: int
    shards: int
    total: int = 0
    distinct: int = 0
    texts: int = 0
    discounts: list[np.ndarray] = field(default_factory=list)
    types: int = 0
    gamma: float = 1.0


def word_shards(words: list[bytes], n: int) -> np.ndarray:
    """The shard of each word; -1 for the begin mark, which is in none."""
    import xxhash

    out = (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(n)).astype(np.int64)
    out[BEGIN_CODE] = -1
    return out


def word_rows(folder: str, portion: int, order: int, n: int) -> list[tuple]:
    """A portion's words, for their shards, and how often training texts have them."""
    words = spelled_words(map_arrays(f"{folder}/portion-{portion}"))
    s = Stream.read(folder, portion, order, np.arange(len(words)), 0)
    counts, shard = np.bincount(s.codes[s.train], minlength=len(words)), word_shards(words, n)
    return [(0, int(k), GRAMS, portion, with_words([words[i] for i in at], counts[at])) for k in np.unique(shard[shard >= 0]) for at in [np.flatnonzero(shard == k)]]


def tallied(frame: pd.DataFrame) -> dict[bytes, int]:
    """Words of all blobs of a frame and their summed counts."""
    out: dict[bytes, int] = {}
    for blob in frame["blob"]:
        words, counts = words_of(blob)
        for w, c in zip(words, counts.tolist()):
            out[w] = out.get(w, 0) + c
    return out


def count_words(enc: Encoded, model: Model) -> None:
    """Writes the words' shards, the most frequent words first, and puts their totals into the model."""
    folder, order, n, target = enc.folder, enc.order, model.word_shards, model.folder

    def merge(frame: pd.DataFrame) -> bytes:
        found = tallied(frame)
        return with_words(list(found), np.fromiter(found.values(), np.uint64, len(found)))

    def write(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        ranked = sorted(((-c, w) for w, c in tallied(frame).items() if c))
        counts = np.array([-c for c, _ in ranked], np.uint64)
        put_arrays(f"{target}/words-{key[0]}", blob=np.frombuffer(with_words([w for _, w in ranked], counts), np.uint8))
        return pd.DataFrame({"n": [len(ranked)], "total": [int(counts.sum())]})

    rows = spread_out(enc.portions, enc.n).mapInPandas(over_portions(lambda p: word_rows(folder, p, order, n)), ROWS)
    done = every_shard(merged_first(rows, merge, enc.n), n, with_words([], np.empty(0))).groupBy("shard").applyInPandas(write, "n long, total long")
    model.distinct, model.total = (int(x or 0) for x in done.agg(F.sum("n"), F.sum("total")).first())


def numbered(enc: Encoded, model: Model) -> DataFrame:
    """The portions, once the numbers and counts of each one's words are written beside it."""
    folder, length, n, source = enc.folder, enc.order, model.word_shards, model.folder
    name = source.rsplit("/", 1)[1]

    def look_up(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        words, counts = words_of(map_arrays(f"{source}/words-{key[0]}")["blob"].tobytes())
        rank, counts = {w: i for i, w in enumerate(words)}, np.append(counts, np.uint64(0))
        out = []
        for portion, blob in zip(frame["portion"].tolist(), frame["blob"]):
            asked = words_of(blob)[0]
            at = np.fromiter((rank.get(w, -1) for w in asked), np.int64, len(asked))
            ids = np.where(at < 0, UNKNOWN, at.astype(np.uint64) * np.uint64(n) + np.uint64(key[0] + 1))
            out.append((0, key[0], GRAMS, portion, packed([ids, counts[at]])))
        return as_rows(out)

    def write(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        words = spelled_words(map_arrays(f"{folder}/portion-{key[0]}"))
        ids, counts, shard = np.full(len(words), BEGIN_ID), np.zeros(len(words), np.uint64), word_shards(words, n)
        for k, blob in zip(frame["shard"], frame["blob"]):
            own = np.flatnonzero(shard == k)
            ids[own], counts[own] = unpacked(blob)
        counts[BEGIN_CODE] = model.texts
        order, code = np.argsort(ids, kind="stable"), np.empty(len(ids), np.int64)
        code[order] = np.arange(len(ids))
        blobs = {"numbers": packed([ids[order], counts[order]], True), "code": packed([code])}
        put_arrays(f"{folder}/{name}-{key[0]}", **{k: np.frombuffer(b, np.uint8) for k, b in blobs.items()})
        return pd.DataFrame({"portion": [key[0]]})

    asked = spread_out(enc.portions, enc.n).mapInPandas(over_portions(lambda p: word_rows(folder, p, length, n)), ROWS)
    replies = spread_out(salted(asked, enc.n), 4 * n * (enc.n // FAN + 1), "shard", "salt").groupBy("shard", "salt").applyInPandas(look_up, ROWS)
    return settle(spread_out(replies, enc.n, "portion").groupBy("portion").applyInPandas(write, "portion long"))


def numbers_of(folder: str, name: str, portion: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of a portion's words, sorted; their counts in training texts; the place among them of each of the portion's codes)."""
    f = map_arrays(f"{folder}/{name}-{portion}")
    return *unpacked(f["numbers"].tobytes()), unpacked(f["code"].tobytes())[0].astype(np.int64)


def counted_grams(folder: str, name: str, portion: int, order: int, n: int) -> list[tuple]:
    """A portion's n-grams of the highest order in training texts, for their shards: numbers, spreads of all their contexts, counts."""
    ids, counts, code = numbers_of(folder, name, portion)
    s = Stream.read(folder, portion, order, code)
    top = s.levels[-1]
    times = np.bincount(top.at[s.train], minlength=len(top.columns))
    used = np.flatnonzero(times)
    codes, times = top.columns[used], times[used]
    words = ids[codes]
    spread = [splits(counts, codes[:, j:-1]) for j in range(order - 1)]
    return sent(order, GRAMS, portion, shards_of(words, spread[0] if spread else np.ones(len(words), np.uint64), n), [*words.T, *spread, times])


@dataclass
class Shard:
    """N-grams of a level: sorted hashes of contexts, where each one's words begin, words sorted inside a context, and counts."""

    context: np.ndarray
    begin: np.ndarray
    word: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, count: np.ndarray) -> Shard:
        """From sorted n-grams."""
        new = np.ones(len(words), bool)
        new[1:] = (words[1:, :-1] != words[:-1, :-1]).any(axis=1)
        begin = np.flatnonzero(new)
        context, size = hashed(words[begin, :-1]), np.diff(begin, append=len(words))
        rank = np.argsort(context)
        size, ends = size[rank], np.cumsum(size[rank])
        rows = np.arange(len(words)) + np.repeat(begin[rank] - (ends - size), size)
        return cls(context[rank], np.concatenate(([0], ends)), words[rows, -1], count[rows])

    def save(self, address: str) -> None:
        """Most counts fit a byte; the others stand apart."""
        big = np.flatnonzero(self.count >= 255)
        put_arrays(address, context=self.context, begin=smallest(self.begin), word=smallest(self.word), small=np.minimum(self.count, 255).astype(np.uint8), big=big, whole=self.count[big])

    @classmethod
    def map(cls, address: str) -> Shard:
        f = map_arrays(address)
        count = f["small"].astype(np.uint64)
        count[f["big"]] = f["whole"]
        return cls(f["context"], f["begin"], f["word"], count)

    def totals(self) -> list[np.ndarray]:
        """Of each context: its total, and how many words follow it once, twice, more often."""
        if not len(self.context):
            return [np.empty(0, np.uint64)] * 4
        first = self.begin[:-1].astype(np.int64)
        return [np.add.reduceat(x.astype(np.uint64), first) for x in (self.count, self.count == 1, self.count == 2, self.count > 2)]


def reduce_level(level: int, model: Model, folder: str):
    """Function that merges one shard's n-grams, writes them, and gives rows for the next shorter ones, totals of contexts that are spread, and statistics."""
    n = model.shards

    def run(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        columns = gathered(frame, 2 * level)
        keys, (count,), spread = merged(columns[:level], columns[-1:], columns[level:-1])
        words = np.stack(keys, 1)
        shard = Shard.of(words, count)
        shard.save(f"{folder}/grams-{level}-{key[0]}")
        stats = [len(count), int(count.sum()), *(int((count == k).sum()) for k in (1, 2, 3, 4)), int((count > 2).sum())]
        rows = [(level, int(key[0]), STATS, 0, np.array(stats, "<i8").tobytes())]
        if level > 1 and len(count):
            seen = np.where(words[:, 1] == BEGIN_ID, count, np.uint64(1)) if level > 2 else np.ones(len(count), np.uint64)
            shorter, (seen,), rest = merged(keys[1:], [seen], spread[1:])
            grams = np.stack(shorter, 1)
            rows += sent(level - 1, GRAMS, int(key[0]), shards_of(grams, rest[0] if rest else np.ones(len(grams), np.uint64), n), [*shorter, *rest, seen])
            wide = np.isin(shard.context, hashed(words[spread[0] > 1, :-1]))
            if wide.any():
                rows += sent(level, TOTALS, int(key[0]), mixed(shard.context[wide], 4) % np.uint64(n), [shard.context[wide], *(x[wide] for x in shard.totals())])
        return as_rows(rows)

    return run


def merge_grams(level: int):
    """Function from a frame of n-grams of a level to one blob."""

    def run(frame: pd.DataFrame) -> bytes:
        columns = gathered(frame, 2 * level)
        keys, counts, spread = merged(columns[:level], columns[-1:], columns[level:-1])
        return packed([*keys, *spread, *counts], True)

    return run


def write_totals(level: int, folder: str):
    """Function that adds up the totals of contexts that are spread and writes a shard of them."""

    def run(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        columns = gathered(frame, 5)
        (context,), values, _ = merged(columns[:1], columns[1:])
        put_arrays(f"{folder}/totals-{level}-{key[0]}", context=context, **dict(zip(("total", "one", "two", "more"), values)))
        return pd.DataFrame({"n": [len(context)]})

    return run


def discounts(n: list[int]) -> np.ndarray:
    """D(0..3+) from how many were seen once to four times."""
    out = [0.0]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[0] else 0.5
        out.append(min(max(d, 0.05), k - 0.05))
    return np.array(out)


def trained(enc: Encoded) -> tuple[Model, DataFrame]:
    """(model, numbered portions) of encoded texts."""
    spark = enc.rows.sparkSession
    model = Model(new_folder(spark, "kneser-ney"), enc.order, -(-enc.spelled // WORDS) or 1, -(-enc.tokens // SHARD) or 1, texts=enc.texts)
    count_words(enc, model)
    portions = numbered(enc, model)
    folder, name, order, n, target = enc.folder, model.folder.rsplit("/", 1)[1], enc.order, model.shards, model.folder
    rows, senders = spread_out(portions, enc.n).mapInPandas(over_portions(lambda p: counted_grams(folder, name, p, order, n)), ROWS), enc.n
    for level in range(order, 0, -1):
        empty = [packed([np.empty(0, np.uint64)] * k) for k in (2 * level, 5)]
        made = settle(every_shard(merged_first(rows, merge_grams(level), senders), n, empty[0]).groupBy("shard").applyInPandas(reduce_level(level, model, target), ROWS))
        totals = every_shard(made.where(F.col("kind") == TOTALS), n, empty[1]).groupBy("shard").applyInPandas(write_totals(level, target), "n long")
        totals.agg(F.sum("n")).collect()

        def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([np.frombuffer(x, "<i8") for x in b["blob"]], columns=list("xtabcdm"), dtype=np.int64)

        stats = made.where(F.col("kind") == STATS).select("blob").mapInPandas(numbers, "x long, t long, a long, b long, c long, d long, m long").agg(*[F.sum(k).alias(k) for k in "xtabcdm"]).first()
        model.discounts.insert(0, discounts([int(stats[k] or 0) for k in "abcd"]))
        rows, senders = made.where(F.col("kind") == GRAMS), n
    model.types = int(stats["t"] or 0)
    d = model.discounts[0]
    model.gamma = float(d[1] * stats["a"] + d[2] * stats["b"] + d[3] * stats["m"]) / model.types if model.types else 1.0
    return model, portions


def wanted_grams(level: int, s: Stream, ids: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which n-grams of a level are asked for, in the order they are sent; their word numbers; spreads; shards)."""
    x = s.levels[level - 1]
    words = ids[x.columns]
    known = (words[:, :-1] != UNKNOWN).all(axis=1) if level > 1 else words[:, 0] != UNKNOWN
    some = np.flatnonzero(x.wanted & known)
    spread = splits(counts, x.columns[some, :-1])
    return some, words[some], spread, shards_of(words[some], spread, n)


def questions(folder: str, name: str, portion: int, order: int, n: int) -> list[tuple]:
    """A portion's n-grams of all orders, for the shards that can have them, and its contexts that are spread."""
    ids, counts, code = numbers_of(folder, name, portion)
    s, out = Stream.read(folder, portion, order, code), []
    for level in range(1, order + 1):
        _, words, spread, shard = wanted_grams(level, s, ids, counts, n)
        out += sent(level, GRAMS, portion, shard, list(words.T))
        wide = np.unique(hashed(words[spread > 1, :-1]))
        if level > 1:
            out += sent(level, TOTALS, portion, mixed(wide, 4) % np.uint64(n), [wide])
    return out


def found_at(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each x."""
    if not len(sorted_values):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return at, sorted_values[at] == x


def within_runs(values: np.ndarray, begin: np.ndarray, stop: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each x between its own begin and stop, where values are sorted."""
    a, b = begin.copy(), stop.copy()
    live = np.flatnonzero(a < b)
    while len(live):
        m = (a[live] + b[live]) // 2
        less = values[m] < x[live]
        a[live[less]], b[live[~less]] = m[less] + 1, m[~less]
        live = live[a[live] < b[live]]
    hit = a < stop
    hit[hit] = values[a[hit]] == x[hit]
    return a, hit


def answers(folder: str):
    """Function that answers all questions to one shard from its mapped arrays."""

    def run(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        level, shard, kind = key[0], key[1], key[2]
        address, out = f"{folder}/{kind}-{level}-{shard}", []
        if kind == GRAMS:
            known = Shard.map(address)
            context, values = known.context, known.totals()
            narrow = known.word.dtype == np.uint32 and len(context) < NARROW
            key_of = np.repeat(np.arange(len(context), dtype=np.uint64), np.diff(known.begin).astype(np.int64)) << np.uint64(32) | known.word if narrow else None
        else:
            f = map_arrays(address)
            context, values = f["context"], [f[k] for k in ("total", "one", "two", "more")]
        for portion, blob in zip(frame["portion"].tolist(), frame["blob"]):
            asked = unpacked(blob)
            q = asked[0]
            if kind == GRAMS:
                q = hashed(np.stack(asked[:-1], 1)) if len(asked) > 1 else np.zeros(len(asked[0]), np.uint64)
            at, hit = found_at(context, q)
            found = [np.where(hit, v[at], 0) if len(v) else np.zeros(len(at)) for v in values]
            if kind == GRAMS and narrow:  # context and word in one key sort and search several times faster
                where, there = found_at(key_of, at.astype(np.uint64) << np.uint64(32) | asked[-1])
                there &= hit & (asked[-1] < 1 << 32)
            elif kind == GRAMS:
                begin, stop = (np.where(hit, known.begin[at + k] if len(context) else 0, 0).astype(np.int64) for k in (0, 1))
                where, there = within_runs(known.word, begin, stop, asked[-1])
            if kind == GRAMS:
                count = np.zeros(len(where), np.uint64)
                count[there] = known.count[where[there]]
                found.insert(0, count)
            out.append((level, shard, kind, portion, packed(found)))
        return as_rows(out)

    return run


RESULT = "home long, place long, n_tokens long, n_known long, base_score double, score double"


def added_up(model: Model, folder: str, name: str):
    """Function that scores a portion's pieces from the answers it got."""
    order, n = model.order, model.shards

    def run(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        ids, counts, code = numbers_of(folder, name, key[0])
        s = Stream.read(folder, key[0], order, code)
        got = {(a, b, c): unpacked(d) for a, b, c, d in zip(frame["level"], frame["kind"], frame["shard"], frame["blob"]) if d is not None}
        p = None
        for level in range(1, order + 1):
            some, words, spread, shard = wanted_grams(level, s, ids, counts, n)
            count, total, follow = np.zeros(len(some)), np.zeros(len(some)), np.zeros((len(some), 3))
            for k in np.unique(shard):
                at = np.flatnonzero(shard == k)
                c, t, *f = got[level, GRAMS, int(k)]
                count[at], total[at], follow[at] = c, t, np.stack(f, 1)
            d = model.discounts[level - 1]
            kept = np.maximum(count - d[np.minimum(count, 3).astype(np.int64)], 0)
            size = len(s.levels[level - 1].columns)
            if level == 1:
                p = np.full(size, model.gamma / (model.distinct + 1))
                p[some] += kept / max(model.types, 1)
                continue
            wide = np.flatnonzero(spread > 1)
            if len(wide):
                contexts, back = np.unique(hashed(words[wide, :-1]), return_inverse=True)
                sums = np.zeros((len(contexts), 4))
                at_shard = mixed(contexts, 4) % np.uint64(n)
                for k in np.unique(at_shard):
                    sums[at_shard == k] = np.stack(got[level, TOTALS, int(k)], 1)
                total[wide], follow[wide] = sums[back, 0], sums[back, 1:]
            low = p[s.levels[level - 1].shorter]
            p = low.copy()
            there = total > 0
            at = some[there]
            p[at] = (kept[there] + follow[there] @ d[1:] * low[at]) / total[there]
        base = np.log10((counts + 1.0) / (model.total + model.distinct + 1))
        codes, size = s.codes[s.real], s.pieces["size"]
        piece = np.repeat(np.arange(len(size)), size)
        add = lambda values: np.bincount(piece, weights=values, minlength=len(size))
        logs = np.log10(p[s.levels[-1].at[s.real]])
        seen = add((counts > 0)[codes].astype(float)).astype(np.int64)
        return pd.DataFrame({"home": s.pieces["home"], "place": s.pieces["place"], "n_tokens": size, "n_known": seen, "base_score": add(base[codes]), "score": add(logs)})

    return run


def scored(enc: Encoded, model: Model, portions: DataFrame, into: str = "lm") -> DataFrame:
    """The rows of encoded texts and a struct column: n_tokens, n_known, base_score, score and perplexity."""
    folder, name, order, n = enc.folder, model.folder.rsplit("/", 1)[1], enc.order, model.shards
    asked = salted(spread_out(portions, enc.n).mapInPandas(over_portions(lambda p: questions(folder, name, p, order, n)), ROWS), enc.n)
    keys = ("level", "shard", "kind", "salt")
    replies = spread_out(asked, 4 * n * order * (enc.n // FAN + 1), *keys).groupBy(*keys).applyInPandas(answers(model.folder), ROWS)
    every = portions.select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("shard"), F.lit("").alias("kind"), "portion", F.lit(None).cast("binary").alias("blob"))
    pieces = spread_out(replies.unionAll(every), enc.n, "portion").groupBy("portion").applyInPandas(added_up(model, folder, name), RESULT)
    texts = pieces.groupBy("home", "place").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    texts = texts.select("home", "place", F.struct("n_tokens", "n_known", "base_score", "score", F.pow(F.lit(10.0), F.least(-F.col("score") / F.col("n_tokens"), F.lit(300.0))).alias("perplexity")).alias("lm"))
    r, t = enc.rows.alias("r"), texts.hint("merge").alias("t")  # both sides grow with the texts: neither is broadcast
    joined = r.join(t, (F.col("r.at.portion") == F.col("t.home")) & (F.col("r.at.place") == F.col("t.place")))
    return joined.select("r.row", F.col("t.lm").alias("lm")).select("row.*", F.col("lm").alias(into))


def train(texts: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """A model of a column of training texts."""
    return trained(encoded(texts, text, order=order, drop=tuple(texts.columns)))[0]


def with_scores(df: DataFrame, model: Model, text: str = "text", into: str = "lm", drop: tuple[str, ...] = ()) -> DataFrame:
    """df and a struct column: n_tokens, n_known, base_score, score and the perplexity 10 ** (-score / n_tokens).

    Columns that the result keeps are stored and shuffled with it once; drop names those that it needn't keep.
    """
    enc = encoded(df, text, order=model.order, drop=(*drop, into))
    return scored(enc, model, numbered(enc, model), into)


def op9_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those that are not held out."""
    from .language_id import held_out

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text").withColumn("held_out", held_out(parts=7))
    enc = encoded(docs, train=~F.col("held_out"), order=ORDER, drop=("text",))
    model, portions = trained(enc)
    return scored(enc, model, portions).select("doc_id", "held_out", "lm.n_tokens", "lm.n_known", F.lit(model.total).cast("long").alias("train_tokens"), "lm.base_score", "lm.score", "lm.perplexity")
