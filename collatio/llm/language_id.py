"""Language identification by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public byte vocabulary. A word (with a blank in front) can be
cut into pieces in many ways; its probability in a language is the sum over all of them, by the forward algorithm. A
text's likelihood is the product over its words. The prediction is the language of the greatest likelihood (ties: the
first name), the score its share among all languages' likelihoods.

Fitting counts words by language in Spark, over at most about PER_LANGUAGE training texts of each language (all
of them if there are fewer; the choice goes by a hash of the text's key), then runs expectation-maximisation: the forward and
backward algorithms give every piece's expected count in every word, over all segmentations. Counts are smoothed, so
that every piece has a probability in every language, and single bytes make every word segmentable. What comes to the
driver is bounded by the vocabulary times the number of languages, which may be MAX_LANGUAGES at most.

A long word (all that has no blank, in some scripts a whole text) falls into parts wherever no piece of the vocabulary lies across a place: every
segmentation cuts there, so that its sum is exactly the product of the parts' sums. Most parts are short and repeat, so that texts of such scripts
take the way of short words, many at once; a part that stays long is summed place by place. Sums are rescaled, so that no product of
small probabilities is lost: those of short words by SCALE for each byte, those of long parts as they run.

A text that is null or has no letter is `und` with score 0, and so is every text if nothing was learned. Training rows
with a null text or language teach nothing. Very long texts are read whole, their words part by part. Repeated rows repeat; empty
tables are allowed; other columns stay, whatever their names, and the result is one struct column that the caller names, in place of one of that name.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.session import spread

from .shared import bound_batches, mixed, settle

#: Training texts of a language, about; rounds of expectation-maximisation; count added to every piece; languages at most.
PER_LANGUAGE, ROUNDS, SMOOTH, MAX_LANGUAGES = 5000, 2, 0.05, 256
#: Bytes of a word, with its blank, up to which many are computed at once; what sums are multiplied by for each byte; words whose probabilities a worker keeps.
SHORT, SCALE, KEPT = 33, 4096.0, 200_000
#: Bytes of words whose segmentations are computed together.
GROUP = 200_000
#: Bytes of a long word that are looked through at once.
STRETCH = 1 << 18
#: Words that fitting holds at a time.
HELD = 200_000
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def default_vocabulary() -> str:
    """The address of the vocabulary that queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pieces_of(path: str) -> list[bytes]:
    """The vocabulary's pieces, and all single bytes."""
    with open(path, "rb") as f:
        found = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return list(dict.fromkeys([*found, *(bytes([b]) for b in range(256))]))


def long_expected(word: bytes, pieces: "Pieces", p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, expected counts) over all segmentations of one word of any length, by sums that are rescaled as they run."""
    n, longest = len(word), pieces.longest
    cuts: list[list[tuple[int, int]]] = [[], *([(i - size, k) for size, k in ways] for i, ways in enumerate(pieces.ways(word), 1))]  # by end: (begin, piece)
    begins: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for i, ways in enumerate(cuts):
        for j, k in ways:
            begins[j].append((i, k))

    def logs(order: range, ways: list[list[tuple[int, int]]]) -> list[float]:
        """Log of the sum at each place, which is added up from places that come before it in the order."""
        value, shift, out = [0.0] * (n + 1), 0.0, [0.0] * (n + 1)
        value[order[0]] = 1.0
        for step, i in enumerate(order[1:], 1):
            value[i] = sum(value[j] * p[k] for j, k in ways[i])
            if value[i] < 1e-100:
                top = max(value[j] for j in order[max(0, step - longest) : step + 1])
                for j in order[max(0, step - longest) : step + 1]:
                    value[j] /= top
                shift += math.log(top)
            out[i] = math.log(max(value[i], 1e-320)) + shift
        return out

    ahead, behind = logs(range(n + 1), cuts), logs(range(n, -1, -1), begins)
    which = np.array([k for c in cuts for _, k in c], np.int64)
    j, i = (np.array(x, np.int64) for x in ([b for c in cuts for b, _ in c], [e for e, c in enumerate(cuts) for _ in c]))
    return which, np.exp(np.array(ahead)[j] + np.log(p[which]) + np.array(behind)[i] - ahead[n])


class Pieces:
    """The vocabulary as hash tables over 64-bit hashes of byte strings, for many substrings at once."""

    BASE = np.uint64(0x100000001B3)

    def __init__(self, pieces: list[bytes]):
        self.sizes = sorted({len(x) for x in pieces if len(x.split()) < 2 and not x[1:2].isspace()})  # others are in no word
        self.longest = self.sizes[-1]
        self.index = {x: i for i, x in enumerate(pieces)}
        self.hashes = np.array([self.hash(p) for p in pieces], np.uint64)
        if len(np.unique(self.hashes)) < len(pieces):
            raise ValueError("two pieces share a hash")
        self.bits = max(12, len(pieces).bit_length() + 2)
        self.tables, left = [], np.arange(len(pieces))
        while len(left):  # a piece is in the first table where its slot was free
            slots = self.slot(self.hashes[left], len(self.tables))
            first = np.unique(slots, return_index=True)[1]
            table = np.full(1 << self.bits, -1, np.int32)
            table[slots[first]] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)

    def hash(self, piece: bytes) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + c + 1) % (1 << 64)
        return h

    def slot(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return (mixed(hashes, 77 + k) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in hashes, pieces) of the hashes that are pieces."""
        at, which, rest = [], [], np.arange(len(hashes))
        for k, table in enumerate(self.tables):
            got = table[self.slot(hashes[rest], k)]
            used = got >= 0  # a piece goes to a later table only if an earlier slot is taken
            rest, got = rest[used], got[used]
            same = self.hashes[got] == hashes[rest]
            at.append(rest[same])
            which.append(got[same])
            rest = rest[~same]
        return np.concatenate(at), np.concatenate(which)

    def spans(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, piece) of all pieces in a row of bytes."""
        begins, sizes, found, h = [], [], [], np.zeros(len(data) + 1, np.uint64)
        for size in range(1, min(self.longest, len(data)) + 1):
            h = h[:-1] * self.BASE + data[size - 1 :] + np.uint64(1)
            if size in self.sizes:
                at, which = self.find(h)
                begins.append(at)
                sizes.append(np.full(len(at), size))
                found.append(which)
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (begins, sizes, found))

    def parts(self, word: bytes) -> list[bytes]:
        """A word, cut wherever no piece lies across: every segmentation cuts there, so that its sum is the product of the parts'."""
        data, cuts = np.frombuffer(word, np.uint8), [0]
        for start in range(0, len(data), STRETCH):
            a, b = max(0, start - self.longest), min(len(data), start + STRETCH + self.longest)
            begin, size, _ = self.spans(data[a:b])
            edges = np.bincount(begin + 1, minlength=b - a + 1) - np.bincount(begin + size, minlength=b - a + 1)[: b - a + 1]
            free = np.flatnonzero(np.cumsum(edges) == 0) + a
            cuts += free[(free > max(0, start - 1)) & (free < min(len(data), start + STRETCH))].tolist()
        return [word[i:j] for i, j in zip(cuts, [*cuts[1:], len(word)])]

    def ways(self, word: bytes) -> Iterator[list[tuple[int, int]]]:
        """For each place of a word behind the first byte, (size, piece) of the pieces that end there."""
        data = np.frombuffer(word, np.uint8)
        for start in range(0, len(data), STRETCH):
            a, b = max(0, start - self.longest), min(len(data), start + STRETCH)
            begin, size, which = self.spans(data[a:b])
            end = begin + size + a
            own = np.flatnonzero(end > start)
            order = own[np.argsort(end[own], kind="stable")]
            listed = list(zip(size[order].tolist(), which[order].tolist()))
            edges = np.searchsorted(end[order], np.arange(start + 1, b + 2)).tolist()
            for i, j in zip(edges, edges[1:]):
                yield listed[i:j]

    def lattice(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words, pieces) of all pieces in words of equal length, a row of bytes each; by end."""
        n, out = words.shape[1], []
        prefix = [np.zeros(len(words), np.uint64)]
        for i in range(n):
            prefix.append(prefix[-1] * self.BASE + words[:, i] + np.uint64(1))
        power = [np.uint64(pow(int(self.BASE), k, 1 << 64)) for k in range(n + 1)]
        for i in range(1, n + 1):
            for j in [i - size for size in reversed(self.sizes) if size <= i]:
                at, which = self.find(prefix[i] - prefix[j] * power[i - j])
                if len(at):
                    out.append((j, i, at, which))
        return out


def grouped(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes) of words of equal length, in groups of bounded size."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        places = np.flatnonzero(sizes == n)
        step = max(1, GROUP // int(n))
        for k in range(0, len(places), step):
            part = places[k : k + step]
            yield part, np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), n)


def forward(word: bytes, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """For each language, the log of the sum over all segmentations of a word of any length. p: a row for each piece, a column for each language."""
    width, ring, shift = p.shape[1], pieces.longest + 1, 0.0
    sums: list[list[float]] = [[1.0] * width for _ in range(ring)]
    rows: dict[int, list[float]] = {}
    for i, ways in enumerate(pieces.ways(word), 1):
        total = [0.0] * width
        for size, k in ways:
            row = rows.get(k) or rows.setdefault(k, p[k].tolist())
            total = [t + a * x for t, a, x in zip(total, sums[(i - size) % ring], row)]
        sums[i % ring] = total
        if i % 8 == 0 and (top := max(total)) < 1e-100:
            sums = [[x / top for x in s] for s in sums]
            shift += math.log(top)
    return np.log(np.maximum(sums[len(word) % ring], 1e-320)) + shift


def many_forward(words: list[bytes], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """forward for many words of at most SHORT bytes."""
    out = np.empty((len(words), p.shape[1]))
    for part, rows in grouped(words):
        sums = [np.zeros((len(part), p.shape[1])) for _ in range(rows.shape[1] + 1)]
        sums[0] += 1
        for j, i, at, which in pieces.lattice(rows):
            sums[i][at] += sums[j][at] * (p[which] * SCALE ** (i - j))
        out[part] = np.log(np.maximum(sums[-1], 1e-320)) - rows.shape[1] * math.log(SCALE)
    return out


def many_expected(words: list[bytes], times: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Each piece's expected count, over all segmentations of words that occur so many times, by one language's probabilities."""
    out, found = np.zeros(len(p)), Counter()
    for w, n in zip(words, times.tolist()):
        for x in [w] if len(w) <= SHORT else pieces.parts(w):
            found[x] += n
    for w in [w for w in found if len(w) > SHORT]:
        which, x = long_expected(w, pieces, p)
        out += np.bincount(which, x * found.pop(w), len(p))
    words, times = list(found), np.array(list(found.values()))
    for part, rows in grouped(words):
        n = rows.shape[1]
        ahead, behind = np.zeros((n + 1, len(part))), np.zeros((n + 1, len(part)))
        ahead[0] = behind[n] = 1
        cuts = pieces.lattice(rows)
        for j, i, at, which in cuts:
            ahead[i][at] += ahead[j][at] * p[which] * SCALE ** (i - j)
        for j, i, at, which in reversed(cuts):
            behind[j][at] += behind[i][at] * p[which] * SCALE ** (i - j)
        scale = times[part] / ahead[n]
        for j, i, at, which in cuts:
            out += np.bincount(which, ahead[j][at] * (p[which] * SCALE ** (i - j)) * scale[at] * behind[i][at], len(p))
    return out


class Model:
    """Languages and, for each piece, its probability in each of them."""

    def __init__(self, languages: list[str], pieces: list[bytes], counts: np.ndarray | None):
        self.languages, self.pieces = languages, pieces
        if counts is None:
            counts = np.ones((len(languages), len(pieces)))
        smooth = counts + SMOOTH
        self.p = smooth / smooth.sum(axis=1, keepdims=True)


class Predictor:
    """Predicts texts, and keeps the likelihoods of words it has seen."""

    def __init__(self, model: Model, kept: int = KEPT):
        self.model, self.kept = model, kept
        self.width = len(model.languages)
        self.pieces, self.columns = Pieces(model.pieces), np.ascontiguousarray(model.p.T)
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.parts: dict[bytes, np.ndarray] = {}
        self.logs = np.empty((self.kept + 1, self.width))

    def of(self, words: list[str]) -> np.ndarray:
        """Likelihoods of words; those of long ones from their parts."""
        raw = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
        out = np.zeros((len(raw), self.width))
        short = [i for i, w in enumerate(raw) if len(w) <= SHORT]
        if short:
            out[short] = many_forward([raw[i] for i in short], self.pieces, self.columns)
        for i in set(range(len(raw))).difference(short):
            cut = Counter(self.pieces.parts(raw[i]))
            if len(self.parts) > self.kept:
                self.parts.clear()
            new = [x for x in cut if x not in self.parts]
            small = [x for x in new if len(x) <= SHORT]
            known = dict(zip(small, many_forward(small, self.pieces, self.columns))) if small else {}
            known |= {x: forward(x, self.pieces, self.columns) for x in new if len(x) > SHORT}
            out[i] = sum(n * (known[x] if x in known else self.parts[x]) for x, n in cut.items())
            self.parts |= {x: v for x, v in known.items() if len(x) <= SHORT}
        return out

    def learn(self, words: set[str]) -> None:
        listed, k = list(words), len(self.row)
        self.logs[k : k + len(listed)] = self.of(listed)
        self.row.update(zip(listed, range(k, k + len(listed))))

    def predict_many(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Predictions of many texts; the words of as many texts as fit are learned together."""
        out: list[tuple[str, float]] = []
        if not self.width:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.row) > self.kept // 2:
            self.clear()
        while len(out) < len(texts):
            new: set[str] = set()
            stop = len(out)
            while stop < len(texts):
                more = set((texts[stop] or "").split()).difference(self.row, new)
                if len(self.row) + len(new) + len(more) > self.kept:
                    break
                new |= more
                stop += 1
            self.learn(new)
            if stop == len(out):
                if self.row:  # room for the next text
                    self.clear()
                    continue
                stop += 1  # a text of too many words goes part by part
            out += [self.predict(t) for t in texts[len(out) : stop]]
        return out

    def likelihoods(self, text: str) -> np.ndarray:
        words = text.split()
        total = np.zeros(self.width)
        size = min(50_000, self.kept)
        for i in range(0, len(words), size):
            part = words[i : i + size]
            new = set(part).difference(self.row)
            if len(self.row) + len(new) > self.kept:
                self.clear()
                new = set(part)
            self.learn(new)
            total += self.logs[list(map(self.row.__getitem__, part))].sum(axis=0)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.width or not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        x = self.likelihoods(text)
        share = np.exp(x - x.max())
        k = int(np.argmax(x))
        return self.model.languages[k], float(share[k] / share.sum())


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of rows (lang, text); words are bytes with a blank in front."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter = Counter()
            for lang, text in zip(b["lang"], b["text"]):
                for w, n in Counter(text.split()).items():
                    found[lang, b" " + w.encode("utf-8", "surrogatepass")] += n
            if found:  # an empty frame has no types
                yield pd.DataFrame({"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())})

    return rows.mapInPandas(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def piece_counts(words: DataFrame, model: Model, shared) -> np.ndarray:
    """Expected counts of every piece in every language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        at, pieces = {k: i for i, k in enumerate(m.languages)}, Pieces(m.pieces)
        found = np.zeros(m.p.shape)
        held, n = [], 0

        def add() -> None:
            for lang, part in pd.concat(held).groupby("lang"):
                found[at[lang]] += many_expected([bytes(w) for w in part["word"]], part["n"].to_numpy(), pieces, m.p[at[lang]])

        for b in batches:
            held.append(b)
            n += len(b)
            if n > HELD:
                add()
                held, n = [], 0
        if n:
            add()
        k, i = np.nonzero(found)
        yield pd.DataFrame({"lang": k, "piece": i, "x": found[k, i]})

    got = words.mapInPandas(count, "lang int, piece int, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(model.p.shape)
    out[got["lang"].to_numpy(), got["piece"].to_numpy()] = got["x"].to_numpy()
    return out


def fit(training: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", vocabulary: str | None = None, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """A model of the languages of the training rows."""
    spark: SparkSession = training.sparkSession
    bound_batches(spark)
    rows = training.select(F.col(key).cast("string").alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages, pieces = sorted(sizes), pieces_of(vocabulary or default_vocabulary())
    model = Model(languages, pieces, None)
    if not languages:
        return model
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    chance = F.pmod(F.xxhash64(F.lit("fit"), F.coalesce("key", F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    words = settle(word_counts(rows.where(chance < share[F.col("lang")]).select("lang", "text")))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        model = Model(languages, pieces, piece_counts(words, model, shared))
        shared.unpersist()
    return model


def with_language(df: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """df and a struct column lang, score."""
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(shared.value)
        for texts in batches:
            yield pd.DataFrame(predictor.predict_many(list(texts)), columns=["lang", "score"])

    return df.withColumn(into, run.asNondeterministic()(F.col(text)))


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether a row is kept out of training."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts == part


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = fit(docs.where(~held_out()))
    out = with_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")
