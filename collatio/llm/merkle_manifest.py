"""Merkle dataset manifest: a forest of trees over rows, built by mountain ranges, and a proof for every row.

A tree's leaves are digests in the order of a key. While a level has more than one node, every `fanout` consecutive ones (a run; the last may be
shorter, nothing is padded) become the SHA-256 of their hexadecimal texts, end to end. What remains is the tree's subroot; the subroots, in the
order of their trees' names, are the leaves of one more tree, whose subroot is the root.

1. Leaves (64 bytes and a key for each row, no texts) are sorted by range over (tree, key, digest, row number) and packed in chunks of at most CHUNK
   consecutive leaves. Running sums, inside a partition and over partitions, give each chunk its place in its tree.
2. A mountain range takes a chunk's leaves: a stack with a pending run for each level. A full run is hashed and carried to the next level, where it
   may fill a run in turn. Completed nodes are records, by level in slices; nodes of runs that begin or end outside the chunk are its peaks.
3. Peaks of MERGED neighbouring chunks meet in one group, where the runs that they fill are hashed; what is still open meets the next 64 groups, until
   a tree is one group. So a task holds some thousand nodes, and trees of any size take log64(chunks) rounds.
4. A chunk's rows are proved from its own records and from the merged runs at its two edges (two for each level at most). Runs near the root
   are wanted by all chunks of a tree; these joins split hot keys.

A null tree is a tree of its own, the first; trees are ordered by UTF-8 bytes. Null keys come first. Rows of one key are ordered by digest; repeated
rows are leaves of their own. Null fields of a row are `-`, empty texts have length 0, very long texts are hashed whole, in place. Empty tables give
empty results. Columns that aren't named as fields, key or tree are neither hashed nor returned, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from collatio.session import spread

from .shared import bound_batches, discard, join_hot, settle

FANOUT, CHUNK, MERGED = 8, 16_384, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Characters of a digest.
WIDE = 64


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 of columns, each as its byte count, a colon and its text, or `-` if it is null."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def tree_name(column: Column) -> Column:
    """A text that sorts as the column does, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


class Mountains:
    """A stack of pending runs over the nodes from `start` of a tree of `total` leaves.

    levels[k]: (index of the first, digests) of the level's nodes that were pushed or completed here; peaks: (level, index, digest) of those that
    no run completed here has.
    """

    def __init__(self, start: int, total: int, fanout: int):
        self.fanout, self.levels, self.peaks, self.sizes = fanout, [], [], [total]
        self.pending: list[tuple[int, bytes]] = []
        self.open_level(start)

    def open_level(self, first: int) -> None:
        self.levels.append((first, []))
        self.pending.append((first, b""))
        self.sizes.append(-(-self.sizes[-1] // self.fanout))

    def push(self, digests: bytes, level: int = 0) -> None:
        """Nodes, end to end, that follow those already on their level; runs that they fill are carried."""
        while digests:
            self.levels[level][1].append(digests)
            size = self.sizes[level]
            first, held = self.pending[level]
            held += digests
            if size == 1:
                self.pending[level] = first, held
                return
            edge = -first % self.fanout * WIDE  # of a run that begins outside
            if edge:
                self.peaks += [(level, first + i, held[WIDE * i : WIDE * i + WIDE]) for i in range(min(edge, len(held)) // WIDE)]
                gone = min(edge, len(held)) // WIDE
                first, held = first + gone, held[WIDE * gone :]
            width, end = WIDE * self.fanout, first + len(held) // WIDE
            whole = len(held) if end == size else len(held) // width * width
            self.pending[level] = first + whole // WIDE, held[whole:]
            if not whole:
                return
            if level + 1 == len(self.levels):
                self.open_level(first // self.fanout)
            digests, level = b"".join([sha(held[i : min(i + width, whole)]) for i in range(0, whole, width)]), level + 1

    def close(self) -> list[tuple[int, int, bytes]]:
        """All peaks."""
        rest = [(level, first + i, held[WIDE * i : WIDE * i + WIDE]) for level, (first, held) in enumerate(self.pending) for i in range(len(held) // WIDE)]
        return self.peaks + rest

    def records(self) -> list[tuple[int, bytes]]:
        """(index of the first, digests end to end) of every level's nodes."""
        return [(first, b"".join(parts)) for first, parts in self.levels]


def packed_chunks(leaves: DataFrame, chunk: int) -> DataFrame:
    """(tree, part, seq, n, keys, leaves, changed): runs of up to `chunk` consecutive leaves of (tree, key, leaf, changed, id), stored."""
    ordered = leaves.repartitionByRange("tree", "key", "leaf", "id").sortWithinPartitions("tree", "key", "leaf", "id").drop("id")
    kind = leaves.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def row(tables: list[pa.Table]) -> pa.RecordBatch:
            t = pa.concat_tables(tables)
            keys = t["key"].combine_chunks()
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            joined = [pa.array([b"".join(t[c].to_pylist())], pa.large_binary()) for c in ("leaf", "changed")]
            return pa.RecordBatch.from_arrays([pa.array([t["tree"][0].as_py()]), pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(keys)], pa.int64()), lists, *(x.cast(pa.binary()) for x in joined)], names=["tree", "part", "seq", "n", "keys", "leaves", "changed"])

        for b in batches:
            t, at = pa.Table.from_batches([b]), 0
            names = b.column("tree").to_pylist()
            while at < len(names):
                if held and (held[0]["tree"][0].as_py() != names[at] or n == chunk):
                    yield row(held)
                    seq, held, n = seq + 1, [], 0
                end, limit = at, min(len(names), at + chunk - n)
                while end < limit and names[end] == names[at]:
                    end += 1
                held.append(t.slice(at, end - at))
                n, at = n + end - at, end
        if held:
            yield row(held)

    schema = StructType([StructField("tree", StringType()), *(StructField(c, LongType()) for c in ("part", "seq", "n")), StructField("keys", ArrayType(kind)), StructField("leaves", BinaryType()), StructField("changed", BinaryType())])
    return settle(ordered.mapInArrow(run, schema))


def placed(chunks: DataFrame) -> DataFrame:
    """(tree, part, seq, start, rank, total): where each chunk begins in its tree, and how many come before it; sums inside a partition, then over partitions."""
    inside = Window.partitionBy("tree", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("tree")
    own = chunks.select("tree", "part", "seq", "n").withColumns({"a": F.coalesce(F.sum("n").over(inside), F.lit(0)), "b": F.row_number().over(Window.partitionBy("tree", "part").orderBy("seq")) - 1})
    parts = chunks.groupBy("tree", "part").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    parts = parts.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("c"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("d"), F.sum("n").over(whole).alias("total"))
    return own.join(parts, ["tree", "part"]).select("tree", "part", "seq", "n", (F.col("a") + F.col("c")).alias("start"), (F.col("b") + F.col("d")).alias("rank"), "total")


PEAKS = "array<struct<level: int, at: long, digest: binary>>"
LEVELS = "array<struct<first: long, digests: binary>>"


def climbed(chunks: DataFrame, fanout: int) -> DataFrame:
    """chunks, with levels (records of the levels above the leaves) and peaks."""

    @F.pandas_udf(f"levels {LEVELS}, peaks {PEAKS}")
    def climb(starts: pd.Series, totals: pd.Series, leaves: pd.Series) -> pd.DataFrame:
        out = []
        for start, total, data in zip(starts, totals, leaves):
            m = Mountains(start, total, fanout)
            m.push(data.hex().encode())
            levels = [{"first": first, "digests": raw(d)} for first, d in m.records()[1:]]
            out.append((levels, [{"level": k, "at": i, "digest": raw(d)} for k, i, d in m.close()]))
        return pd.DataFrame(out, columns=["levels", "peaks"])

    return chunks.withColumn("m", climb.asNondeterministic()("start", "total", "leaves")).select("tree", "rank", "start", "total", "n", "keys", "leaves", "changed", "m.*")


def raw(digests: bytes) -> bytes:
    return bytes.fromhex(digests.decode())


def filled(total: int, fanout: int, peaks: list[tuple[int, int, bytes]]) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, int, bytes]]]:
    """(runs, peaks): runs (level, index, nodes end to end) that some peaks of a tree fill, level by level, and the peaks that are left."""
    runs, rest, size, level = [], [], total, 0
    by_level: dict[int, dict[int, bytes]] = {}
    for k, i, d in peaks:
        by_level.setdefault(k, {})[i] = d
    while size > 1:
        found: dict[int, list[tuple[int, bytes]]] = {}
        for i, d in sorted(by_level.get(level, {}).items()):
            found.setdefault(i // fanout, []).append((i, d))
        for j, nodes in found.items():
            if len(nodes) == min(fanout, size - fanout * j):
                children = b"".join(d for _, d in nodes)
                runs.append((level, j, children))
                by_level.setdefault(level + 1, {})[j] = sha(children)
            else:
                rest += [(level, i, d) for i, d in nodes]
        size, level = -(-size // fanout), level + 1
    return runs, rest + [(level, i, d) for i, d in by_level.get(level, {}).items()]


MEETING = "tree string, total long, block long, run boolean, level int, at long, data binary"


def merged(chunks: DataFrame, fanout: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(runs, tops): the runs that chunks fill together, (tree, level, at, data), and the last peak of every tree, (tree, total, data)."""

    def meet(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        total = int(frame["total"].iat[0])
        runs, rest = filled(total, fanout, [(k, i, d.hex().encode()) for k, i, d in zip(frame["level"], frame["at"], frame["data"])])
        rows = [(key[0], total, key[1], is_run, k, i, raw(d)) for is_run, listed in ((True, runs), (False, rest)) for k, i, d in listed]
        return pd.DataFrame(rows, columns=["tree", "total", "block", "run", "level", "at", "data"])

    peaks = chunks.select("tree", "total", F.col("rank").alias("block"), F.explode("peaks").alias("p")).select("tree", "total", "block", "p.level", "p.at", F.col("p.digest").alias("data"))
    runs = None
    while most > 0:
        most //= MERGED
        met = settle(peaks.withColumn("block", F.expr(f"block div {MERGED}")).groupBy("tree", "block").applyInPandas(meet, MEETING))
        peaks = met.where("not run").drop("run")
        new = met.where("run").select("tree", "level", "at", "data")
        runs = new if runs is None else runs.unionAll(new)
    if runs is None:
        runs = peaks.where("false").select("tree", "level", "at", "data")
    return runs, peaks.select("tree", "total", "data")


class Forest(NamedTuple):
    """chunks: (tree, rank, start, total, n, keys, leaves, changed, levels, peaks); runs and tops of merged. All stored."""

    chunks: DataFrame
    runs: DataFrame
    tops: DataFrame
    fanout: int


def forest(leaves: DataFrame, fanout: int = FANOUT, chunk: int = CHUNK) -> Forest:
    """The trees over leaves (tree, key, leaf, changed, id). changed: another digest of the row that will be held against the tree; id: any number that tells rows apart."""
    bound_batches(leaves.sparkSession)
    packed = packed_chunks(leaves, chunk)
    places = settle(placed(packed))
    chunks = settle(climbed(packed.drop("n").join(places, ["tree", "part", "seq"]), fanout))
    most = places.agg(F.max("rank")).first()[0] or 0
    runs, tops = merged(chunks, fanout, most)
    discard(packed, places)
    return Forest(chunks, runs, tops, fanout)


def node_records(f: Forest) -> DataFrame:
    """(tree, level, first, digests): all nodes, in slices of consecutive ones of a level; leaves are level 0."""
    own = f.chunks.select("tree", "start", "leaves", F.posexplode("levels").alias("pos", "x")).where(F.length("x.digests") > 0)
    lowest = f.chunks.select("tree", F.lit(0).alias("level"), F.col("start").alias("first"), F.col("leaves").alias("digests"))
    upper = own.select("tree", (F.col("pos") + 1).alias("level"), "x.first", "x.digests")
    met = f.runs.select("tree", (F.col("level") + 1).alias("level"), F.col("at").alias("first"), F.unhex(F.sha2(F.lower(F.hex("data")).cast("binary"), 256)).alias("digests"))
    return lowest.unionAll(upper).unionAll(met)


def edge_runs(f: Forest) -> DataFrame:
    """(tree, rank, edges): for each chunk the merged runs that hold its first or last node on some level."""
    powers = [f.fanout**k for k in range(63) if f.fanout**k < 1 << 62]
    power = F.element_at(F.array(*[F.lit(p).cast("long") for p in powers]), F.col("level") + 1)
    ends = f.chunks.select("tree", "rank", "start", (F.col("start") + F.col("n") - 1).alias("stop"), "total", F.explode(F.sequence(F.lit(0), F.lit(len(powers) - 2))).alias("level"))
    ends = ends.withColumn("p", power).where("(total - 1) div p >= 1")
    wanted = ends.select("tree", "rank", "level", F.explode(F.array_distinct(F.array(F.expr(f"start div p div {f.fanout}"), F.expr(f"stop div p div {f.fanout}")))).alias("at"))
    times = wanted.groupBy("tree", "level", "at").agg(F.count("*").alias("times"))
    found = join_hot(wanted, f.runs.join(times, ["tree", "level", "at"]), ["tree", "level", "at"], "times")
    return found.groupBy("tree", "rank").agg(F.collect_list(F.struct("level", "at", "data")).alias("edges"))


class Paths:
    """The runs on the way from each leaf of a chunk to its subroot."""

    def __init__(self, start: int, total: int, leaves: bytes, levels, edges, fanout: int):
        self.start, self.fanout, self.sizes = start, fanout, [total]
        self.records = [(start, leaves.hex().encode())] + [(x["first"], x["digests"].hex().encode()) for x in levels]
        self.edges = {(e["level"], e["at"]): e["data"].hex().encode() for e in edges}
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // fanout))

    def children(self, level: int, at: int) -> bytes:
        if (level, at) in self.edges:
            return self.edges[level, at]
        first, nodes = self.records[level]
        a, b = self.fanout * at - first, min(self.fanout * at + self.fanout, self.sizes[level]) - first
        if a < 0 or WIDE * b > len(nodes):
            raise ValueError(f"run {at} of level {level} is neither a chunk's own nor merged")
        return nodes[WIDE * a : WIDE * b]

    def above(self, level: int, at: int) -> list[tuple[int, bytes]]:
        """(place in the run, run) of node `at` of a level, and of its ancestors."""
        out = []
        while level < len(self.sizes) - 1:
            out.append((at % self.fanout, self.children(level, at // self.fanout)))
            level, at = level + 1, at // self.fanout
        return out


def others(place: int, run: bytes) -> bytes:
    return run[: WIDE * place] + run[WIDE * place + WIDE :]


def folded(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The top of a path, with another digest at its bottom."""
    for place, run in path:
        digest = sha(run[: WIDE * place] + digest + run[WIDE * place + WIDE :])
    return digest


def whole_paths(f: Forest) -> DataFrame:
    """(tree, key, path) of all leaves, path: array of (place, run)."""
    fanout = f.fanout

    @F.pandas_udf("array<struct<key: string, path: array<struct<place: int, run: binary>>>>")
    def of(starts: pd.Series, totals: pd.Series, keys: pd.Series, leaves: pd.Series, levels: pd.Series, edges: pd.Series) -> pd.Series:
        out = []
        for start, total, names, data, upper, edge in zip(starts, totals, keys, leaves, levels, edges):
            p = Paths(start, total, data, upper, edge if edge is not None else [], fanout)
            out.append([{"key": k, "path": [{"place": place, "run": raw(run)} for place, run in p.above(0, start + i)]} for i, k in enumerate(names)])
        return pd.Series(out)

    rows = f.chunks.join(edge_runs(f), ["tree", "rank"], "left")
    return rows.select("tree", F.explode(of.asNondeterministic()("start", "total", "keys", "leaves", "levels", "edges")).alias("x")).select("tree", "x.*")


def proofs(f: Forest) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of a forest.

    The proof is the digest of all siblings, level by level from the leaf's run to that of its subroot; folded_root is what they give with the
    changed digest in the leaf's place, and the row is verified if that is the root.
    """
    fanout = f.fanout
    tops = settle(f.tops)
    over = forest(tops.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("data").alias("leaf"), F.col("data").alias("changed"), F.lit(0).alias("id")), fanout)
    root = over.tops.select(F.col("data").alias("root"))
    counts = f.chunks.groupBy("tree").agg(F.count("*").alias("n_chunks"))
    ways = whole_paths(over).select(F.col("key").alias("tree"), F.col("path").alias("way")).join(tops.select("tree", F.col("data").alias("subroot")), "tree").join(counts, "tree").crossJoin(F.broadcast(root))
    more = f.chunks.select("tree", "rank").join(edge_runs(f), ["tree", "rank"], "left")
    more = join_hot(more, settle(ways), "tree", "n_chunks").drop("n_chunks")
    kind = f.chunks.schema["keys"].dataType.elementType
    text = ("leaf", "subroot", "root", "proof_sha256", "folded_root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("start", "total", "leaves", "changed", "levels", "edges", "way", "subroot", "root")}
                p = Paths(r["start"], r["total"], r["leaves"], r["levels"], r["edges"] or [], fanout)
                way = [(x["place"], x["run"].hex().encode()) for x in r["way"]]
                top = b"".join(others(*x) for x in way)
                leaves, changed = r["leaves"].hex(), r["changed"].hex().encode()
                proof, fold, upper, suffix, last = [], [], [], b"", -1
                for k in range(len(leaves) // WIDE):
                    at = r["start"] + k
                    if at // fanout != last:  # the leaves of a run share what is above it
                        last = at // fanout
                        upper = p.above(1, last) + way if len(p.sizes) > 1 else way
                        suffix = b"".join(others(*x) for x in upper[: len(upper) - len(way)]) + top
                    own = [(at % fanout, p.children(0, last))] if len(p.sizes) > 1 else []
                    proof.append(sha(b"".join(others(*x) for x in own) + suffix).decode())
                    fold.append(folded(changed[WIDE * k : WIDE * k + WIDE], own + upper).decode())
                n, whole = len(proof), r["root"].hex()
                values = ([leaves[WIDE * k : WIDE * k + WIDE] for k in range(n)], [r["subroot"].hex()] * n, [whole] * n, proof, fold)
                yield pa.RecordBatch.from_arrays([b.column("keys").slice(i, 1).flatten(), *map(pa.array, values), pa.array([x == whole for x in fold])], names=["key", *text, "verified"])

    schema = StructType([StructField("key", kind), *(StructField(c, StringType()) for c in text), StructField("verified", BooleanType())])
    rows = f.chunks.drop("peaks", "n").join(more, ["tree", "rank"])
    return rows.mapInArrow(run, schema)


def leaves_of(df: DataFrame, key: str, tree: str, digest: Column, changed: Column) -> DataFrame:
    """(tree, key, leaf, changed, id), stored."""
    return settle(df.select(tree_name(F.col(tree)).alias("tree"), F.col(key).alias("key"), digest.alias("leaf"), changed.alias("changed"), F.monotonically_increasing_id().alias("id")))


def manifest(df: DataFrame, key: str = "doc_id", tree: str = "lang", fields: tuple[str, ...] = FIELDS, held: dict[str, Column] | None = None, fanout: int = FANOUT, chunk: int = CHUNK) -> Forest:
    """The forest of df's rows. held: columns that are to be held against it later, in place of fields of the same name (those that differ fail to verify)."""
    columns = lambda other: [other.get(c, F.col(f"`{c}`")) for c in fields]
    digest = row_digest(columns({}))
    leaves = leaves_of(df, key, tree, digest, row_digest(columns(held)) if held else digest)
    out = forest(leaves, fanout, chunk)
    discard(leaves)
    return out


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and root, and the root that a tampered third gives."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return proofs(manifest(docs, held={"text": tampered})).withColumnRenamed("key", "doc_id")


#: Levels that the SQL unrolls: trees of up to 8^7 rows, and 8^3 trees.
DEEP, WIDE_TREES = 7, 3


def op11_sql() -> str:
    """The same level by level, a level with one node being carried on as it is."""
    value = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in FIELDS) + ")"
    byte = "list_reduce(list_concat([xor(acc, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda acc, b: xor(acc // 256, {byte.replace('xor(acc, b)', 'xor(acc, b) % 256')})), 4294967295)"
    low = f"CASE WHEN {crc} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    parts = [
        f"d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '-') AS t, {leaf('text')} AS leaf, {leaf(low)} AS changed FROM documents)",
        "n0 AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS i, count(*) OVER (PARTITION BY t) AS size, leaf AS h, id FROM d)",
        "f0 AS (SELECT n0.id, n0.t, n0.i, '' AS sib, changed AS cur FROM n0 JOIN d USING (id))",
    ]

    def levels(first: int, count: int) -> None:
        for k in range(first, first + count):
            parts.append(f"r{k} AS (SELECT t, i // {FANOUT} AS j, any_value(size) AS size, list(h ORDER BY i) AS run FROM n{k} GROUP BY t, i // {FANOUT})")
            parts.append(f"n{k + 1} AS (SELECT t, j AS i, CAST(ceil(size / {FANOUT}) AS BIGINT) AS size, CASE WHEN size > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM r{k})")
            at = f"(i % {FANOUT})"
            parts.append(f"f{k + 1} AS (SELECT id, t, i // {FANOUT} AS i, CASE WHEN size > 1 THEN sib || array_to_string(list_concat(run[1 : {at}], run[{at} + 2 :]), '') ELSE sib END AS sib, CASE WHEN size > 1 THEN sha256(array_to_string(list_concat(run[1 : {at}], [cur], run[{at} + 2 :]), '')) ELSE cur END AS cur FROM f{k} JOIN r{k} USING (t) WHERE r{k}.j = f{k}.i // {FANOUT})")

    levels(0, DEEP)
    k = DEEP + 1
    parts.append(f"n{k} AS (SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS size, h, t AS tree FROM n{DEEP})")
    parts.append(f"f{k} AS (SELECT f.id, '' AS t, n.i, f.sib, f.cur FROM f{DEEP} f JOIN n{k} n ON n.tree = f.t)")
    levels(k, WIDE_TREES)
    last = k + WIDE_TREES
    return f"WITH {', '.join(p.replace(' AS (', ' AS MATERIALIZED (', 1) for p in parts)} SELECT doc_id, leaf, s.h AS subroot, x.h AS root, sha256(f.sib) AS proof_sha256, f.cur AS folded_root, f.cur = x.h AS verified FROM d JOIN f{last} f USING (id) JOIN n{DEEP} s ON s.t = d.t JOIN n{last} x ON true"
