"""Near copies by SimHash, completed: groups of the texts that share at least `share` of their word shingles.

Nodes are distinct sets of shingles (XXH64 of `width` words, as in simhash), so that texts with equal sets are one node. A
link is a pair with Jaccard of at least `share`; groups are what links connect. No link is missed, and none is taken unread.

1. All shingles have one order: those that a sample of texts repeats come last, the others follow their hashes. Any order gives
   the same links; this one keeps common lines out of what follows.
2. A set's first n - ceil(share * n) + 1 shingles are its prefix. Two sets that link have a common shingle in their prefixes
   (prefix filter), so every link lies inside the bucket of one shingle. Buckets where no two sizes fit are left out.
3. The sets of the rest's nodes are written to files of the shared folder once, which workers map.
4. Nodes of crowded buckets are searched by simhash first: pairs of fingerprints within NEAR bits, by generalised pigeonhole, each verified over
   whole sets. This connects what is nearly equal, which is most of a large group of copies, and spares the comparisons inside it. Where
   there are no crowded buckets it would cost more than it spares, and is left out. It can't be all, as two texts that share 0.8 of their shingles
   differ in 9.7 of 64 bits on average: one pair in five lies beyond 12 bits, the most that can be searched. Then every member of a crowded bucket is
   compared with a few hubs, members that no earlier hub connects, in one stream over the bucket. This connects most of what copies of copies are.
5. Buckets whose members are connected already are dropped. One that still has more than LARGE unconnected parts is divided: sets that link
   share two shingles within prefixes that are longer by one, so that every link of the bucket lies in the smaller bucket of another shingle too; and
   so on, with three, while buckets are large and the division makes progress. What has more than BLOCK members even so is cut
   into blocks, and every two of them are a bucket. No task holds more than two blocks.
6. Inside a bucket each member is compared, over whole sets, with all later ones whose size fits and which verified links
   haven't connected to it yet. Nothing counts as connected but by a verified link. What a task has connected, and which
   pairs have failed, holds for its next buckets. A task yields fewer links than it has nodes.

A text of fewer words than a shingle is one shingle; texts without words, and null, are one group. Very long texts are one set each,
in memory while they are compared. A group's component is its smallest non-null key. Repeated rows repeat (with_groups); rows with one key and
different texts are different members; empty tables give empty results. Other columns stay, whatever their names; the result's column is
replaced.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from math import ceil
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .shared import SENT, Ranges, bound_batches, components, discard, drop_shuffles, filesystem, join_hot, map_file, new_folder, place, put_file, settle, standing
from .simhash import SEED, shingle_hashes

#: Bits by which fingerprints of the first pass may differ.
NEAR = 3
#: Texts of the sample; the shingles that it says are common at most (an order only, no shingle is left out).
SAMPLE, COMMON = 4000, 100_000
#: Members of a crowded bucket, its hubs; unconnected parts from which a bucket is divided, members of a block, shingles by which a bucket is divided at most.
CROWDED, HUBS, LARGE, BLOCK, DEEP = 200, 16, 1000, 100_000, 6
#: Rows that a division makes at a time.
MADE = 20_000
#: Files that a worker keeps mapped; nodes and failed pairs that a task remembers.
MAPPED, REMEMBERED = 600, 300_000


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, width))


def node_of(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.astype("<u8").tobytes(), SEED)).view(np.int64))


def nodes(text: Column, width: int) -> Column:
    """The node of a text column, the size of its set, and the set's fingerprint."""

    @F.pandas_udf("node long, size long, fp long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t, width) for t in texts]
            yield pd.DataFrame({"node": np.array([node_of(s) for s in sets], np.int64), "size": np.array([len(s) for s in sets], np.int64), "fp": np.array([simhash.fingerprint_of(s) for s in sets], np.uint64).view(np.int64)})

    return run.asNondeterministic()(text)


def common_shingles(texts: DataFrame, n: int, width: int) -> tuple[np.ndarray, list[int]]:
    """Shingles that a sample of about SAMPLE of the n nodes has three times or more, the most frequent last; and those among them that, by the sample, more than BLOCK nodes have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["text"]:
                s = shingle_set(text, width)
                yield pd.DataFrame({"node": node_of(s), "h": s.view(np.int64)})

    step = max(1, n // SAMPLE)
    some = texts.select("text").where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)
    counts = some.mapInPandas(run, "node long, h long").distinct().groupBy("h").count().where("count >= 3")
    top = counts.orderBy(F.desc("count"), "h").limit(COMMON).collect()
    return np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64), [r["h"] for r in top if r["count"] * step > BLOCK]


def prefix(s: np.ndarray, share: float, common: tuple[np.ndarray, np.ndarray], more: int = 0) -> np.ndarray:
    """The first shingles of a sorted set: as many as two sets that link have one, and `more`, of in common. common: sorted, and their ranks."""
    n = len(s) - ceil(share * len(s) - 1e-9) + 1 + more
    known, rank = common
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        last = known[at] == s
        s = np.concatenate((s[~last], s[last][np.argsort(rank[at[last]])]))
    return s[:n]


def ranked(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common shingles, sorted; the rank of each)."""
    order = np.argsort(common)
    return common[order], order


def prefixes(width: int, share: float, common: np.ndarray):
    """Function over texts: a row (h, node, size) for each shingle of a node's prefix."""
    known = ranked(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # copies meet later too; this spares most of their rows
        for b in batches:
            out, node, size = [], [], []
            for text in b["text"]:
                s = shingle_set(text, width)
                if len(s) and (k := node_of(s)) not in seen:
                    seen.add(k)
                    out.append(prefix(s, share, known))
                    node.append(k)
                    size.append(len(s))
            if len(seen) > REMEMBERED:
                seen.clear()
            if out:
                times = [len(x) for x in out]
                yield pd.DataFrame({"h": np.concatenate(out).view(np.int64), "node": np.repeat(np.array(node, np.int64), times), "size": np.repeat(np.array(size, np.int64), times)})

    return run


def whole_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by h, cut so that no h goes on in the next one."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        h = b["h"].to_numpy()
        cut = int(np.searchsorted(h, h[-1], "left"))
        if cut or (held and held[-1]["h"].iat[-1] != h[0]):
            if held and held[-1]["h"].iat[-1] != h[0]:
                yield pd.concat(held, ignore_index=True)
                held = []
            if cut:
                yield pd.concat([*held, b.iloc[:cut]], ignore_index=True)
                held = []
        held.append(b.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def buckets(share: float):
    """Function over (h, node, size, …) sorted by h, size and node: the rows, once each, that have a row of a fitting size in their bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, left = None, False  # the last row so far, and whether the one before it fits
        for b in batches:
            if not len(b):
                continue
            b = (b if held is None else pd.concat([held, b])).drop_duplicates(["h", "node"])
            h, size = b["h"].to_numpy(), b["size"].to_numpy()
            fits = (h[1:] == h[:-1]) & (size[:-1] >= share * size[1:] - 1e-9)
            keep = np.append(fits, False) | np.append(left, fits)
            if keep[:-1].any():
                yield b.iloc[:-1][keep[:-1]]
            held, left = b.iloc[-1:], bool(fits[-1]) if len(fits) else left
        if held is not None and left:
            yield held

    return run


def stored_sets(width: int, folder: str):
    """Function over texts: writes sets to files of the folder; (node, file, start, size) of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sets = [shingle_set(t, width) for t in b["text"]]
            name = uuid.uuid4().hex
            put_file(f"{folder}/{name}", np.concatenate(sets).astype("<u8").tobytes())
            size = np.array([len(x) for x in sets], np.int64)
            yield pd.DataFrame({"node": np.array([node_of(x) for x in sets], np.int64), "file": name, "start": np.cumsum(size) - size, "size": size})

    return run


class Sets:
    """The stored sets of a folder."""

    def __init__(self, folder: str):
        self.folder, self.maps = folder, OrderedDict()

    def get(self, file: str, start: int, size: int) -> np.ndarray:
        if file not in self.maps:
            self.maps[file] = Ranges(f"{self.folder}/{file}")
            if len(self.maps) > MAPPED:
                self.maps.popitem(last=False)
        return self.maps[file].get(8 * start, 8 * size).view("<u8")


def shared_with(s: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of s each of the other sets has."""
    x = np.concatenate(others)
    hit = s[np.minimum(np.searchsorted(s, x), len(s) - 1)] == x
    return np.add.reduceat(hit, np.cumsum([0, *map(len, others)])[:-1], dtype=np.int64)


def verified_pairs(share: float, folder: str):
    """Function over pairs (u, v) and the places of their sets: those that share enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Sets(folder)
        for b in batches:
            good = np.zeros(len(b), bool)
            for i, (a, c) in enumerate(zip(zip(b["u_file"], b["u_start"], b["u_size"]), zip(b["v_file"], b["v_start"], b["v_size"]))):
                both = int(shared_with(sets.get(*a), [sets.get(*c)])[0])
                good[i] = both >= share * (a[2] + c[2] - both)
            yield b.loc[good, ["u", "v"]]

    return run


def nearly_equal(prints: DataFrame, places: DataFrame, share: float, folder: str) -> DataFrame:
    """Links (u, v), stored, among nodes whose fingerprints differ by up to NEAR bits. prints: (node, fp); places: (node, file, start, size).

    A fingerprint's first node stands for it in links to other fingerprints, and all its nodes are compared with that one.
    """
    first = settle(prints.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    near = simhash.links(first.select("fp"), NEAR)
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in ("u", "v"))
    pairs = near.join(a, "u").join(b, "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    pairs = pairs.unionAll(join_hot(prints, first.where("n > 1"), "fp", "n").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v")))
    for c in ("u", "v"):
        pairs = pairs.join(places.select(F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("file", "start", "size")]), c)
    return settle(pairs.mapInPandas(verified_pairs(share, folder), "u long, v long").distinct())


class Forest:
    """What links connect so far; each tree has its smallest node as root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, k: int) -> int:
        while (p := self.up.get(k, k)) != k:
            self.up[k] = self.up.get(p, p)
            k = p
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def hub_links(share: float, folder: str):
    """Function over BUCKET rows sorted by h and size: links (u, v) of members with hubs of their bucket. A bucket streams by; only its hubs are kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, trees, at = Sets(folder), Forest(), None
        hubs: list[tuple[int, int, np.ndarray]] = []
        for b in batches:
            out: list[tuple[int, int]] = []
            for h, node, size, label, file, start in zip(b["h"], b["node"], b["size"], b["label"], b["file"], b["start"]):
                if h != at:
                    at, hubs = h, []
                trees.join(node, label)
                own = trees.root(node)
                near = [x for x in hubs if trees.root(x[0]) != own and x[1] >= share * size - 1e-6]
                if len(hubs) - len(near) and any(trees.root(x[0]) == own for x in hubs):
                    continue
                s = sets.get(file, start, size) if near or len(hubs) < HUBS else None
                linked = False
                if near:
                    both = shared_with(s, [x[2] for x in near])
                    for x, n in zip(near, both.tolist()):
                        if n >= share * (size + x[1] - n):
                            out.append((x[0], node))
                            trees.join(x[0], node)
                            linked = True
                if not linked and len(hubs) < HUBS:
                    hubs.append((node, size, np.array(s)))
            if len(trees.up) > REMEMBERED:
                trees.up.clear()
            if out:
                yield pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    return run


def verified_links(share: float, folder: str):
    """Function over buckets sorted by h and size: links (u, v) that, with the ones known before (a node's label), connect all nodes which links of at least `share` connect."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, trees, failed = Sets(folder), Forest(), set()
        root = trees.root

        def search(node: list[int], size: np.ndarray, file: list[str], start: list[int], out: list[tuple[int, int]]) -> None:
            label = np.array([root(k) for k in node], np.int64)
            for i in range(len(node) - 1):
                if (label == label[0]).all():
                    return
                end = int(np.searchsorted(size, size[i] / share + 1e-6, "right"))
                late = [j for j in (np.flatnonzero(label[i + 1 : end] != label[i]) + i + 1).tolist() if (node[i], node[j]) not in failed]
                s = sets.get(file[i], start[i], size[i]) if late else None
                for k in range(0, len(late), 256):
                    part = late[k : k + 256]
                    both = shared_with(s, [sets.get(file[j], start[j], size[j]) for j in part])
                    good = both >= share * (size[i] + size[part] - both)
                    for j, ok in zip(part, good.tolist()):
                        if not ok:
                            if len(failed) < REMEMBERED:
                                failed.add((node[i], node[j]))
                        elif label[j] != label[i]:
                            out.append((node[i], node[j]))
                            a, b = root(node[i]), root(node[j])
                            trees.join(a, b)
                            label[(label == a) | (label == b)] = min(a, b)

        for b in whole_keys(batches):
            h, size = b["h"].to_numpy(), b["size"].to_numpy()
            node, file, start = b["node"].tolist(), b["file"].tolist(), b["start"].tolist()
            for k, label in zip(node, b["label"].tolist()):
                if k != label:
                    trees.join(k, label)
            cuts = (np.flatnonzero(np.diff(h)) + 1).tolist()
            out: list[tuple[int, int]] = []
            for s, e in zip([0, *cuts], [*cuts, len(h)]):
                search(node[s:e], size[s:e], file[s:e], start[s:e], out)
                if len(failed) >= REMEMBERED:  # forgetting costs comparisons, no links
                    failed.clear()
                if len(trees.up) > REMEMBERED:
                    trees.up.clear()
            if out:
                yield pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    return run


BUCKET = "h long, taken array<long>, node long, size long, label long, file string, start long"


def divided(share: float, folder: str, common: np.ndarray):
    """Function over BUCKET rows: a row for each further shingle of the member's prefix, longer by as many as are taken. The bucket of two shingles is the
    same, whichever of them came first."""
    import xxhash

    known = ranked(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Sets(folder)
        for b in batches:
            out: list[tuple[int, list[int], int]] = []

            def rows() -> pd.DataFrame:
                made = b.iloc[[i for _, _, i in out]].copy()
                made["h"], made["taken"] = np.array([h for h, _, _ in out], np.uint64).view(np.int64), [t for _, t, _ in out]
                return made

            for i, (taken, size, file, start) in enumerate(zip(b["taken"], b["size"], b["file"], b["start"])):
                own = set(taken.tolist())
                for h in prefix(sets.get(file, start, size), share, known, len(own)).view(np.int64).tolist():
                    if h not in own:
                        both = sorted((*own, h))
                        out.append((xxhash.xxh64_intdigest(np.array(both, np.int64).tobytes(), SEED), both, i))
                        if len(out) >= MADE:
                            yield rows()
                            out = []
            if out:
                yield rows()

    return run


def by_size(df: DataFrame) -> DataFrame:
    return df.repartition("h").sortWithinPartitions("h", "size", "node")


def small_buckets(rows: DataFrame, share: float, folder: str, common: np.ndarray) -> DataFrame:
    """BUCKET rows cut into buckets that one task can hold and compare; links of unconnected members are all inside one. rows are of settle, and deleted."""
    done, before = None, None
    for depth in range(1, DEEP + 1):
        parts = rows.groupBy("h", "label").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("labels"))
        parts = settle(parts.where("labels > 1"))
        joined = settle(join_hot(rows, parts, "h", "n"))
        large = joined.where(F.col("labels") > LARGE)
        work = parts.where(F.col("labels") > LARGE).agg(F.max("labels")).first()[0]
        # a division that leaves the largest bucket as it is would only repeat its rows
        last = work is None or depth == DEEP or (before is not None and work > 0.9 * before)
        discard(rows, parts)
        drop_shuffles(joined.sparkSession)
        fine = joined if last else joined.where(F.col("labels") <= LARGE)
        done = fine if done is None else done.unionAll(fine)
        if last:
            break
        before = work
        cut = large.drop("n", "labels").mapInPandas(divided(share, folder, common), BUCKET)
        rows = settle(by_size(cut).mapInPandas(buckets(share), BUCKET))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    one = done.where(F.col("n") <= BLOCK).select("h", "node", "size", "label", "file", "start")
    own = done.where(F.col("n") > BLOCK).withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return one.unionAll(own.select(F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")).alias("h"), "node", "size", "label", "file", "start"))


def links(texts: DataFrame, prints: DataFrame, n: int, width: int, share: float) -> DataFrame:
    """Links (u, v), stored, that connect all nodes of the texts (id, text) which links connect. prints: (id, node, fp) of texts with words, stored; n: about how many nodes there are."""
    common, hot = common_shingles(texts, n, width)
    rows = texts.select("text").mapInPandas(prefixes(width, share, common), "h long, node long, size long")
    if hot:  # the members of these buckets are not one task's; they have rows of fitting sizes
        rows = settle(rows)
        busy = F.broadcast(texts.sparkSession.createDataFrame([(h,) for h in hot], "h long"))
        close = by_size(rows.join(busy, "h", "left_anti")).mapInPandas(buckets(share), "h long, node long, size long").unionAll(rows.join(busy, "h", "left_semi").distinct())
    else:
        close = by_size(rows).mapInPandas(buckets(share), "h long, node long, size long")
    close = settle(close)
    if hot:
        discard(rows)
    drop_shuffles(texts.sparkSession)
    # one text of each node that has a row
    wanted = settle(prints.join(close.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")).select("id"))
    some = texts.join(F.broadcast(wanted), "id") if wanted.count() <= SENT else texts.where(Listed(wanted).has("id"))
    folder = new_folder(texts.sparkSession, "sets")
    places = settle(some.select("text").mapInPandas(stored_sets(width, folder), "node long, file string, start long, size long"))
    crowded = settle(close.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED))
    label = lambda edges: places.drop("size").join(components(edges).select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    columns = [F.col("h"), F.array("h").alias("taken"), *map(F.col, ("node", "size", "label", "file", "start"))]
    first = None
    if crowded.isEmpty():
        members = close.join(places.drop("size").withColumn("label", F.col("node")), "node").select("h", "node", "size", "label", "file", "start")
        found = by_size(members).mapInPandas(verified_links(share, folder), "u long, v long")
    else:
        busy = settle(join_hot(close, crowded, "h", "n").drop("n"))
        many = busy.select("node").distinct()
        first = nearly_equal(settle(prints.select("node", "fp").distinct().join(many, "node")), places, share, folder)
        hubs = by_size(busy.join(label(first), "node").select(*columns)).mapInPandas(hub_links(share, folder), "u long, v long")
        first = settle(first.unionAll(hubs).distinct())
        members = settle(close.join(label(first), "node").select(*columns))
        discard(busy, close)
        drop_shuffles(texts.sparkSession)
        members = small_buckets(members, share, folder, common)
        found = by_size(members).mapInPandas(verified_links(share, folder), "u long, v long").unionAll(first)
    found = settle(found.distinct())
    drop_shuffles(texts.sparkSession)
    store, path = filesystem(folder)
    if not places.isEmpty():
        store.delete_dir(path)  # links are stored, nothing reads the sets again
    discard(wanted, places, crowded, *([close] if first is None else []))
    return found


def grouped(df: DataFrame, text: str, key: str, width: int, share: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, rows, placed): df's rows (row, text, id), where they lie; (id, key, node, fp) of them, stored; and the root of every node, with the node's first row and its number of rows."""
    bound_batches(df.sparkSession)
    df = standing(df)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text])
    texts = df.select(whole.alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), place(df).alias("id"))
    rows = settle(texts.select("id", "key", nodes(F.col("text"), width).alias("set")).select("id", "key", "set.*"))
    known = settle(rows.groupBy("node").agg(F.min(F.struct(F.col("key").isNull().alias("without"), "key", "id")).alias("first"), F.count("*").alias("n")))
    edges = links(texts.select("id", "text"), rows.where("size > 0").select("id", "node", "fp"), known.count(), width, share)
    roots = components(edges).withColumnRenamed("node", "member")
    return texts, rows, known.join(roots, known["node"] == roots["member"], "left").select("node", "first", "n", F.coalesce("root", "node").alias("root"))


def restored(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The user's columns, in their order, of rows (row, text)."""
    return rows.select(*[(F.col("text") if c == text else F.col("row").getField(c)).alias(c) for c in columns])


def with_groups(df: DataFrame, text: str = "text", key: str = "doc_id", into: str = "near", width: int = 5, share: float = 0.8) -> DataFrame:
    """df and a struct column: node, component (the smallest key of the group) and root (the group's smallest node)."""
    own = [c for c in df.columns if c != into]
    texts, rows, placed = grouped(df if own == df.columns else df.select(*[F.col(f"`{c}`") for c in own]), text, key, width, share)
    least = placed.groupBy("root").agg(F.min("first.key").alias("component"), F.count("*").alias("nodes"))
    groups = join_hot(placed, least, "root", "nodes").select("node", "n", F.struct("node", "component", "root").alias("near"))
    joined = join_hot(texts.join(rows.select("id", "node"), "id").select("row", "text", "node"), settle(groups), "node", "n")
    return joined.select(*[(F.col("text") if c == text else F.col("row").getField(c)).alias(c) for c in own], F.col("near").alias(into))


def first_of_groups(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, share: float = 0.8) -> DataFrame:
    """One row of each group: that of the smallest key (null if there is no other), and of its repetitions one.

    The numbers of all other rows go to files, so that texts aren't shuffled.
    """
    texts, rows, placed = grouped(df, text, key, width, share)
    kept = placed.groupBy("root").agg(F.min("first").alias("first")).select("first.id")
    listed = Listed(rows.select("id").join(kept, "id", "left_anti"))
    return restored(texts.where(~listed.has("id")), df.columns, text)


class Listed:
    """The ids of a data frame, in sorted files of the shared folder that workers map."""

    def __init__(self, ids: DataFrame):
        self.folder = folder = new_folder(ids.sparkSession, "ids")
        ids = settle(ids)
        self.files = files = max(64, ids.count() // REMEMBERED + 1)

        def write(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
            put_file(f"{folder}/{key[0]}", np.sort(frame["id"].to_numpy()).astype("<i8").tobytes())
            return pd.DataFrame({"file": [key[0]]})

        file = F.pmod(F.xxhash64("id"), F.lit(files)).cast("int").alias("file")
        self.found = {r["file"] for r in ids.groupBy(file).applyInPandas(write, "file int").collect()}

    def has(self, column: str) -> Column:
        folder, found = self.folder, self.found

        @F.pandas_udf("boolean")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            maps: dict[int, np.ndarray] = {}
            for ids, file in batches:
                x, at, out = ids.to_numpy(), file.to_numpy(), np.zeros(len(ids), bool)
                for k in found.intersection(np.unique(at).tolist()):
                    if k not in maps:
                        if len(maps) >= MAPPED:
                            maps.clear()
                        maps[k] = map_file(f"{folder}/{k}").view("<i8")
                    own = np.flatnonzero(at == k)
                    out[own] = maps[k][np.minimum(np.searchsorted(maps[k], x[own]), len(maps[k]) - 1)] == x[own]
                yield pd.Series(out)

        return run.asNondeterministic()(F.col(column), F.pmod(F.xxhash64(column), F.lit(self.files)).cast("int"))
