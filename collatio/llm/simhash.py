"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has 64 bits: bit b is set if more than half of the XXH64 values (seed 42) of its word shingles have
it. Fingerprints link at a distance of up to `distance` bits, and groups are what links connect.

Search, over distinct fingerprints (copies meet in the aggregation that makes them distinct):

1. Statistics of all fingerprints: how often each bit, and each two bits together, are set.
2. Bits are grouped so that correlated bits share a partition; partitions have about equal sizes.
3. For m partitions, thresholds t(i) >= -1 that sum to distance - m + 1 suffice: two fingerprints within the distance are
   within t(i) in some partition i. Dynamic programming allots them by estimated cost: the expected candidates of a
   partition and threshold (the distribution of the number of differing bits, from the bits' frequencies, with
   the partition's correlations counted as fewer independent bits), and the probes it takes. The m of least cost wins.
4. Probe: for each partition a fingerprint goes to the keys of its bits with every choice of t(i) of them blanked; two
   values within t(i) share such a key. A key's fingerprints are sorted together and stream through a worker.
5. Verify: distances are counted over all 64 bits. Inside a bucket, a search that compares each reached fingerprint with
   those not yet reached gives a spanning forest of its links. So a bucket yields fewer rows than it has members, and no
   two members that links connect are parted.
6. A bucket of more than HOT fingerprints is divided first: two that link agree in one of distance + 1 groups of bits, by the same
   principle, and each group's value makes a smaller bucket of its own. What stays large is divided again by other groups, LEVELS
   times at most; the rest is cut into blocks, and every two of them are a bucket, so that no task holds more than two blocks.

Connected components of the links run as group-bys over edges; nothing of it comes to the driver but the bit statistics.

A text of fewer words than a shingle is one shingle; one without words, and null, has fingerprint 0, which links like
any other. Bits that are set in exactly half of the shingles are 0. Very long texts are hashed whole. A group's id is its smallest
non-null key. Repeated rows repeat; rows of one fingerprint, however many, are joined to their group in parts; empty tables give empty
results. Other columns stay, whatever their names; the result's column is replaced.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.session import spread

from .shared import SENT, ascii_lower_words, bound_batches, components, join_hot, mixed, settle

BITS, SEED = 64, 42
#: Members from which a bucket is divided; divisions at most.
HOT, LEVELS = 4096, 3
#: Cost of a verified candidate against that of one probe row.
VERIFY = 0.02


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of `width` words, repeats included."""
    import xxhash

    words = ascii_lower_words(text)
    if len(words) < width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint(text: str | None, width: int) -> int:
    """The fingerprint of one text, with shingles of `width` words."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(text: Column | str, width: int = 3) -> Column:
    """The fingerprint of a text column, as a signed long."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return run.asNondeterministic()(text)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, how often bits i and j are both set) over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = b["fp"].to_numpy().view(np.uint64)
            for i in range(0, len(x), 1 << 14):
                bits = np.unpackbits(x[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += bits.T @ bits
            n += len(x)
        if n:
            yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "n": np.append(both.reshape(-1), n).astype(np.int64)})

    both = np.zeros(BITS * BITS + 1, np.int64)
    for r in prints.select("fp").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        both[r["cell"]] = r["n"]
    return int(both[-1]), both[:-1].reshape(BITS, BITS)


def correlations(n: int, both: np.ndarray) -> np.ndarray:
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    c = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(c, 0)
    return np.minimum(c, 1)


def grouped_bits(c: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of about equal size; each grows from the most correlated free bit by the bit most correlated to it."""
    free, out = list(range(len(c))), []
    for k in range(m):
        size = len(c) * (k + 1) // m - len(c) * k // m
        group = [max(free, key=lambda b: c[b, free].sum())]
        free.remove(group[0])
        while len(group) < size:
            b = max(free, key=lambda x: c[x, group].mean())
            group.append(b)
            free.remove(b)
        out.append(sorted(group))
    return out


def within(p: np.ndarray, c: np.ndarray, bits: list[int], most: int) -> list[float]:
    """For t = 0..most, the chance that two fingerprints differ in up to t of these bits."""
    q = 2 * p[bits] * (1 - p[bits])
    spread = np.zeros(len(bits) + 1)
    spread[0] = 1
    for x in q:
        spread[1:] = spread[1:] * (1 - x) + spread[:-1] * x
        spread[0] *= 1 - x
    inner = c[np.ix_(bits, bits)]
    independent = len(bits) / (1 + inner.sum() / max(1, len(bits)))  # correlated bits count as fewer
    return [float(min(1.0, max(x, 1e-300)) ** (independent / len(bits))) for x in np.cumsum(spread)[: most + 1]]


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 or more, one for each row of costs) that sum to total, at the least cost. costs[i][t + 1] is for t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t in range(-1, len(row) - 1):
                x = (cost + row[t + 1], [*chosen, t])
                if s + t not in new or x[0] < new[s + t][0]:
                    new[s + t] = x
        best = new
    return best[total]


def plan(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """The partitions to probe and their thresholds."""
    p, c = np.diag(both) / max(n, 1), correlations(n, both)
    n = max(n, 1)  # so that probes cost something in an empty table too
    options = []
    for m in range(1, min(distance + 2, 16) + 1):
        groups = grouped_bits(c, m)
        costs = []
        for g in groups:
            near = within(p, c, g, distance)
            costs.append([0.0] + [n * comb(len(g), t) + VERIFY * comb(len(g), t) * n * n * near[t] / 2 for t in range(min(distance, len(g)) + 1)])
        cost, chosen = allot(costs, distance - m + 1)
        options.append((cost, [(g, t) for g, t in zip(groups, chosen) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


def masks(bits: list[int], t: int) -> list[int]:
    """The bits to keep, for every choice of t bits that are blanked."""
    whole = sum(1 << b for b in bits)
    return [whole & ~sum(1 << b for b in out) for out in combinations(bits, t)]


def keyed(masks: list[int]):
    """Function that gives each fingerprint its key under every mask."""
    kept = np.array(masks, np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b["fp"].to_numpy().view(np.uint64)
            for i in range(0, len(x), 1 << 13):
                part = x[i : i + (1 << 13)]
                key = mixed(part[:, None] & kept[None, :], np.arange(len(kept), dtype=np.uint64)[None, :])
                yield pd.DataFrame({"key": key.reshape(-1).view(np.int64), "mask": np.tile(np.arange(len(kept), dtype=np.int32), len(part)), "fp": np.repeat(part, len(kept)).view(np.int64)})

    return run


def forest(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all members of x that links of up to `distance` bits connect; a few times len(x) at most."""
    a, b, found = [], [], 0
    step = max(1, (1 << 20) // len(x))
    for i in range(0, len(x), step):
        u, v = np.nonzero(np.bitwise_count(x[i : i + step, None] ^ x[None, i:]) <= distance)
        later = v > u
        a.append(x[u[later] + i])
        b.append(x[v[later] + i])
        found += len(a[-1])
        if found > 2 * len(x) + 64:  # dense: a search that leaves out what it has reached
            return reached(x, distance)
    return np.concatenate(a), np.concatenate(b)


def reached(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of up to `distance` bits, by comparing each reached member with those not yet reached."""
    a, b = [], []
    rest = x
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            seed, front = front[0], front[1:]
            hit = np.bitwise_count(rest ^ seed) <= distance
            if hit.any():
                new = rest[hit]
                a.append(np.full(len(new), seed))
                b.append(new)
                front, rest = np.concatenate((front, new)), rest[~hit]
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def bucket_links(distance: int):
    """Function over rows sorted by key: the links inside every key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last key, which may go on

        def solve(key: np.ndarray, x: np.ndarray) -> pd.DataFrame | None:
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
            size = ends - starts
            u, v = [], []
            two = starts[size == 2]
            near = np.bitwise_count(x[two] ^ x[two + 1]) <= distance
            u.append(x[two][near])
            v.append(x[two + 1][near])
            for s, e in zip(starts[size > 2], ends[size > 2]):
                a, b = forest(x[s:e], distance)
                u.append(a)
                v.append(b)
            u, v = np.concatenate(u), np.concatenate(v)
            return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)}) if len(u) else None

        for batch in batches:
            key, x = batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut or (held and held[-1][0][-1] != key[0]):
                done = [np.concatenate(c) for c in zip(*held, (key[:cut], x[:cut]))]
                held = []
                if len(done[0]) and (out := solve(*done)) is not None:
                    yield out
            held.append((key[cut:], x[cut:]))
        done = [np.concatenate(c) for c in zip(*held)]
        if held and len(done[0]) > 1 and (out := solve(*done)) is not None:
            yield out

    return run


def dealt_bits(groups: int, level: int) -> list[list[int]]:
    """All bits, dealt out to groups in another way at every level."""
    bits = list(range(64))
    random.Random(level).shuffle(bits)
    return [bits[g::groups] for g in range(groups)]


def links(prints: DataFrame, distance: int, hot: int = HOT) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints `fp` which links of up to `distance` bits connect."""
    n, both = bit_statistics(prints)
    chosen = plan(n, both, distance)
    kept = [(mask, g, t) for g, t in chosen for mask in masks(g, t)]
    probes = settle(prints.select("fp").mapInPandas(keyed([k[0] for k in kept]), "key long, mask int, fp long"))
    usual = max(n / 2.0 ** (len(g) - t) for g, t in chosen)  # members of a bucket if all were alike
    bound, done = max(hot, 16 * usual), None
    rows = probes.select("key", "fp")
    for level in range(LEVELS + 1):
        crowded = settle(rows.groupBy("key").count().where(F.col("count") > bound))
        size = crowded.count()
        if not size:
            break
        few = (lambda df: F.broadcast(df)) if size <= SENT else (lambda df: df)
        apart = rows.join(few(crowded.select("key")), "key", "left_anti")
        done = apart if done is None else done.unionAll(apart)
        inside = rows.join(few(crowded), "key")
        if level == LEVELS:  # what no division makes smaller is cut into blocks, and every two of them meet
            blocks = F.ceil(F.col("count") / bound).cast("int")
            own = inside.withColumn("own", F.pmod(F.xxhash64("fp"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            rows = own.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
            break
        # two that differ in up to `distance` bits agree in one of more groups of bits, whatever the groups are
        groups = grouped_bits(correlations(n, both), distance + 1) if level == 0 else dealt_bits(distance + 1, level)
        finer = [sum(1 << b for b in g) for g in groups]
        split = inside.withColumn("part", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >= 1 << 63 else m)).alias("v")) for i, m in enumerate(finer)])))
        rows = settle(split.select(F.xxhash64("key", "part.i", "part.v").alias("key"), "fp"))
    probes = rows if done is None else done.unionAll(rows)
    sorted_probes = probes.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return sorted_probes.mapInPandas(bucket_links(distance), "u long, v long").distinct()


def with_groups(df: DataFrame, text: str = "text", key: str = "doc_id", into: str = "near", width: int = 3, distance: int = 2, hot: int = HOT, share: float | None = None, keep_text: bool = True) -> DataFrame:
    """df and a struct column: fp, component (the smallest key of the group) and root (the group's smallest fingerprint).

    share: if given, links are all pairs of texts that share as much of their shingles, whatever their distance, found and
    counted exactly (near_copies); the struct then has a node in place of fp.
    keep_text: whether the result has the text column, which is then stored once more on the way.
    """
    if share is not None:
        from . import near_copies

        return near_copies.with_groups(df, text, key, into, width, share)
    bound_batches(df.sparkSession)
    own = [F.col(f"`{c}`") for c in df.columns if c != into and (keep_text or c != text)]
    rows = settle(df.select(F.struct(*own).alias("row"), F.col(key).alias("key"), fingerprints(F.col(text), width).alias("fp")))
    prints = settle(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    edges = links(prints, distance, hot)
    roots = components(edges)
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("members"))
    groups = join_hot(placed, least, "root", "members").select("fp", "n", F.struct("fp", "component", "root").alias("near"))
    return join_hot(rows, settle(groups), "fp", "n").select("row.*", F.col("near").alias(into))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text")
    out = with_groups(docs, keep_text=False)
    return out.select("doc_id", F.lower(F.lpad(F.hex("near.fp"), 16, "0")).alias("fingerprint"), F.col("near.component").alias("component_id"))
