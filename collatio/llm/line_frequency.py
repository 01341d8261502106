"""Quality rules: measures of each text, and lines that many documents of a host share.

Lines are hashed in a normal form: A-Z lower-cased, every digit 0-9 as 0, blanks squeezed. The hash (XXH64) is seeded by the host's, so that
a line of two hosts is two lines; it is used together with the host's, where 10^9 lines of one host give a wrong match with its frequent ones
(at most 100 times the lines of its mean document, by `share`) about once in 10^6 runs. For each line of a host its distinct documents are counted,
by the digests of their texts: exact copies are one document, so that a text which is copied often isn't its own boilerplate. A line
is frequent if it is in more than `least` of its host's documents and in more than `share` of them. Frequent lines are removed, and a document
is depleted if less than `left` of its words remain.

Only hashes and counts are shuffled, never texts. Distinct (line, document) pairs are spread by both, so that a line that a third of all documents have
is no hot key; frequent lines come back to documents by a broadcast of a checked number, beyond which hot lines are split.

A null text has no lines and no words, and fails; a null host is a host of its own. An empty text or line has no words; lines without a word are
neither counted nor removed. Very long texts are measured whole. Repeated rows repeat and count as one document. There are no ties: limits are
exceeded or not. Empty tables give empty results. Other columns stay, whatever their names; the result is one struct column that the caller
names, in place of one of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.session import spread

from .shared import SENT, bound_batches, discard, join_hot, settle

#: Documents of a host from which a line may be frequent; share of them; words that must remain.
LEAST, SHARE, LEFT = 20, 0.01, 0.5
#: The base rules: fewest words, most words (of 100) in repeated windows, words of a window.
FEWEST, REPEATED, WINDOW = 50, 50, 3
BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = "host long, digest long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, h array<long>, n array<long>"


def as_long(x: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return x - (1 << 64) if x >> 63 else x


def host_seed(host: str | None) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b"-" if host is None else b"=" + host.encode())


def line_hash(words: list[bytes], seed: int) -> int:
    """Of a line, by its words."""
    import xxhash

    return as_long(xxhash.xxh64_intdigest(b" ".join(words).translate(NORMAL), seed))


def repeated_words(texts: list[list[bytes]]) -> np.ndarray:
    """How many words of each text lie in a window that the text has twice or more."""
    out = np.zeros(len(texts), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    words = [w for t in texts for w in t]
    if len(words) < WINDOW:
        return out
    index = dict(zip(dict.fromkeys(words), count()))
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(owner[: 1 - WINDOW] == owner[WINDOW - 1 :])
    if not len(at):
        return out
    # equal windows of a text lie side by side in this order
    columns = [ids[at + k] for k in range(WINDOW)] + [owner[at]]
    order = np.lexsort(columns)
    same = np.ones(len(at) - 1, bool)
    for c in columns:
        s = c[order]
        same &= s[1:] == s[:-1]
    twice = np.append(same, False) | np.append(False, same)
    hit = np.zeros(len(words), bool)
    for k in range(WINDOW):
        hit[at[order[twice]] + k] = True
    np.add.at(out, owner[hit], 1)
    return out


def lines_of(raw: bytes, seed: int) -> tuple[int, dict[int, int]]:
    """(lines that are equal to an earlier one, words by hash of line) of a text."""
    seen: set[bytes] = set()
    words: dict[int, int] = {}
    n = 0
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        n += line in seen
        seen.add(line)
        h = line_hash(own, seed)
        words[h] = words.get(h, 0) + len(own)
    return n, words


def measured(texts: list[str | None], hosts: list[str | None]) -> pd.DataFrame:
    """MEASURES of texts."""
    import xxhash

    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seeds = [host_seed(h) for h in hosts]
    split = [r.split() for r in raw]
    found = [lines_of(r, s) for r, s in zip(raw, seeds)]
    return pd.DataFrame({
        "host": [as_long(s) for s in seeds],
        "digest": [as_long(xxhash.xxh3_64_intdigest(r)) for r in raw],
        "n_words": [len(w) for w in split],
        "word_chars": [len(t or "") - (len(r) - len(r.translate(None, BLANKS))) for t, r in zip(texts, raw)],
        "n_symbols": [len(r) - len(r.translate(None, SYMBOLS)) for r in raw],
        "n_dup_lines": [n for n, _ in found],
        "n_repeat_words": repeated_words(split),
        "h": [np.fromiter(w, np.int64, len(w)) for _, w in found],
        "n": [np.fromiter(w.values(), np.int64, len(w)) for _, w in found],
    })


def measures(text: Column, host: Column) -> Column:
    @F.pandas_udf(MEASURES)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, hosts in batches:
            yield measured(texts.tolist(), hosts.tolist())

    return run.asNondeterministic()(text, host)


def frequent_lines(rows: DataFrame, least: int, share: float) -> DataFrame:
    """(host, h, n): a host's frequent lines, and how many of its distinct documents have them. rows: the columns host, digest, h of MEASURES."""
    each = rows.select("host", "digest", F.explode("h").alias("h"))
    often = each.distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > least)
    docs = rows.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    return often.join(docs, "host").where(F.col("n") > share * F.col("docs")).select("host", "h", "n")


def line_quality(df: DataFrame, text: str = "text", host: str = "source", into: str = "quality", least: int = LEAST, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """df without its text, and a struct column: BASE, base_failed, words_left, frequent (hashes of the lines to remove), depleted, kept."""
    bound_batches(df.sparkSession)
    own = [c for c in df.columns if c not in (text, into)]
    host_text = F.col(f"`{host}`").cast("string") if host in df.columns else F.lit(None).cast("string")
    rows = settle(df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), measures(F.col(f"`{text}`"), host_text).alias("m")).select("row", "m.*", F.monotonically_increasing_id().alias("id")))
    often = settle(frequent_lines(rows, least, share))
    each = rows.select("id", "host", F.explode(F.arrays_zip("h", "n")).alias("x")).select("id", "host", "x.h", F.col("x.n").alias("words"))
    hit = each.join(F.broadcast(often.drop("n")), ["host", "h"]) if often.count() <= SENT else join_hot(each, often, ["host", "h"], "n")
    gone = hit.groupBy("id").agg(F.sum("words").alias("gone"), F.sort_array(F.collect_list("h")).alias("frequent"))
    words, failed = F.col("n_words"), (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    rest = words - F.coalesce("gone", F.lit(0))
    depleted = rest < left * words
    found = F.struct(*BASE, failed.alias("base_failed"), rest.alias("words_left"), F.coalesce("frequent", F.array().cast("array<long>")).alias("frequent"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept"))
    out = settle(rows.drop("h", "n").join(gone, "id", "left").select("row", found.alias("found")))
    discard(rows, often)
    return out.select(*[F.col("row").getField(c).alias(c) for c in own], F.col("found").alias(into))


def without_lines(text: Column, host: Column, hashes: Column) -> Column:
    """text without the lines that have one of some hashes."""

    def rest(t: str | None, host: str | None, gone) -> str | None:
        if t is None or gone is None or not len(gone):
            return t
        seed, out = host_seed(host), set(gone.tolist())
        keep = lambda x: not (w := x.split()) or line_hash(w, seed) not in out
        return b"\n".join(x for x in t.encode("utf-8", "surrogatepass").split(b"\n") if keep(x)).decode("utf-8", "surrogatepass")

    @F.pandas_udf("string")
    def run(texts: pd.Series, hosts: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([rest(*x) for x in zip(texts, hosts, hashes)], dtype="object")

    return run.asNondeterministic()(text, host, hashes)


def kept_documents(df: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The documents that pass all rules, without their frequent lines; the columns of df. Texts are stored once and joined by row number."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text])
    host_text = F.col(f"`{host}`").cast("string") if host in df.columns else F.lit(None).cast("string")
    rows = settle(df.select(whole.alias("row"), F.col(f"`{text}`").alias("text"), host_text.alias("host"), F.monotonically_increasing_id().alias("id")))
    good = line_quality(rows.select("id", "host", "text"), "text", "host", "found", **limits).where("found.kept").select("id", "found.frequent")
    clean = rows.join(good, "id").select("row", without_lines(F.col("text"), F.col("host"), F.col("frequent")).alias("text"))
    return clean.select(*[(F.col("text") if c == text else F.col("row").getField(c)).alias(c) for c in df.columns])


def op13_line_frequency(spark, sf_dir: str) -> DataFrame:
    """Measures, frequent lines of the source and verdict of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    q = F.col("quality")
    return line_quality(docs).select("doc_id", *[q[c].alias(c) for c in BASE], q["base_failed"].alias("base_failed"), q["kept"].alias("kept"), q["words_left"].alias("words_left"), F.size(q["frequent"]).alias("n_frequent"))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = r"list_filter(regexp_split_to_array(coalesce(%s, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, source, text, {WORDS % 'text'} AS w FROM documents),
t AS (SELECT id, i, w[i : i + 2] AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
r AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM t JOIN (SELECT id, g FROM t GROUP BY id, g HAVING count(*) >= 2) AS u USING (id, g)) GROUP BY id),
l AS (SELECT id, source, text, line, {WORDS % 'line'} AS lw FROM (SELECT id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)),
n AS (SELECT id, source, text, line, len(lw) AS words, translate(array_to_string(lw, ' '), '{LETTERS}123456789', '{LETTERS.lower()}000000000') AS norm FROM l WHERE len(lw) > 0),
u AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM n GROUP BY id),
hosts AS (SELECT source, count(DISTINCT coalesce(text, '')) AS docs FROM documents GROUP BY source),
f AS (SELECT a.source, norm FROM (SELECT source, norm, count(DISTINCT text) AS k FROM n GROUP BY source, norm) a JOIN hosts h ON a.source IS NOT DISTINCT FROM h.source WHERE k > {LEAST} AND k > {SHARE} * docs),
g AS (SELECT id, sum(words) AS gone, count(DISTINCT n.norm) AS lines FROM n JOIN f ON n.source IS NOT DISTINCT FROM f.source AND n.norm = f.norm GROUP BY id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(w) - coalesce(gone, 0) AS BIGINT) AS words_left, CAST(coalesce(lines, 0) AS INTEGER) AS n_frequent FROM d LEFT JOIN r USING (id) LEFT JOIN u USING (id) LEFT JOIN g USING (id))
SELECT *, n_words < {FEWEST} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed, NOT (n_words < {FEWEST} OR 100 * n_repeat_words > {REPEATED} * n_words) AND words_left >= {LEFT} * n_words AS kept FROM m"""
