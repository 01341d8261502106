"""Centroid clustering by delta Lloyd: assignments and global sums persist, and a round touches what changed.

Vectors are integers (floor(scale * x)), so that distances, sums and centroids are exact and independent of partitions. A round has two steps.

* Assign: a vector whose centroid stayed keeps its stored distance and is compared with the changed centroids only, as it was no farther
  from its own than from all others; a vector whose centroid moved is compared with all. Equal distances go to the smaller number.
* Transfer: vectors that changed owner are subtracted from the sums of the old one and added to those of the new one. A task adds up its
  signed transfers in k rows, these are grouped by centroid, added to the stored sums, and stored. A centroid becomes
  floor(sum / count) of its own; an empty one stays.

Every assignment is a table in the shared folder; the one before is deleted once it is stored. The driver holds k centroids and their sums (parameters
bound them), no vector but the k first ones. There is no key to be hot: nothing is shuffled but k rows a task. Rounds end early where no centroid changes.

Kept are vectors of exactly `size` components, none null, NaN or infinite; null vectors and others are left out. Starting centroids are the k kept rows
of the smallest SHA-256 of `1:` and the key in decimal (rows with a null key last; ties by the vector, component by component), so that repeated rows
may be two of them, and the larger number of two equal centroids stays empty and where it is. Fewer rows than k give as many centroids, an empty
table none and an empty result. Components beyond 2^27 in size, where 64-bit sums of squares end, raise an error that says so. Other columns stay, whatever
their names, but for the vector's; the result is one struct column that the caller names, in place of one of that name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from collatio.session import spread

from .shared import bound_batches, discard, settle

SIZE, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Largest component; sums up to this are exact in floating point.
MOST, EXACT = 1 << 27, 1 << 53
TRANSFERS = "cluster int, n long, sums array<long>"


def packed(x: np.ndarray) -> np.ndarray:
    """Rows of integers as bytes whose order is that of the rows."""
    return np.ascontiguousarray((x + (1 << 31)).astype(">u4"))


def unpacked(column, size: int) -> np.ndarray:
    """The rows of packed in a binary Arrow column."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, ">u4").reshape(-1, size).astype(np.int64) - (1 << 31)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows from all centroids, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)), 1)
    if 4 * x.shape[1] * most * most < EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def assigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) of every row after some centroids changed. Rows of owner -1 are new."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | changed[owner]
    if lost.any():
        d = distances(x[lost], centroids)
        owner[lost] = d.argmin(1)
        distance[lost] = d.min(1)
    rest, numbers = np.flatnonzero(~lost), np.flatnonzero(changed)
    if len(rest) and len(numbers):
        d = distances(x[rest], centroids[numbers])
        best, least = numbers[d.argmin(1)], d.min(1)
        nearer = (least < distance[rest]) | ((least == distance[rest]) & (best < owner[rest]))
        owner[rest[nearer]], distance[rest[nearer]] = best[nearer], least[nearer]
    return owner, distance


def whole_vectors(df: DataFrame, vector: str, into: str, size: int, scale: int) -> DataFrame:
    """(row, v): the kept rows, their other columns in one struct and their integers packed."""
    own = [c for c in df.columns if c not in (vector, into)]
    floats = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select((F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0))).alias("row"), floats.alias("v")).where(F.size("v") == size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            flat = lists.flatten()
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, size)  # nulls become NaN
            good = np.isfinite(x).all(1)
            x = np.floor(scale * x[good])
            if (np.abs(x) > MOST).any():
                raise ValueError(f"a component's size is beyond {MOST // scale}; distances would not be exact")
            v = pa.array([r.tobytes() for r in packed(x.astype(np.int64))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row").filter(pa.array(good)), v], names=["row", "v"])

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("v", BinaryType())]))


def assign(state: DataFrame, size: int, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """(row, v, owner, was, distance) after some centroids changed; was: the owner before, -1 for new rows."""
    fresh = "owner" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpacked(b.column("v"), size)
            was = np.full(len(x), -1, np.int32) if fresh else b.column("owner").to_numpy().astype(np.int32)
            before = np.zeros(len(x), np.int64) if fresh else b.column("distance").to_numpy()
            owner, distance = assigned(x, was, before, centroids, changed)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("v"), pa.array(owner.astype(np.int32)), pa.array(was), pa.array(distance)], names=["row", "v", "owner", "was", "distance"])

    kept = ["row", "v"] if fresh else ["row", "v", "owner", "distance"]
    schema = StructType([state.schema["row"], StructField("v", BinaryType()), StructField("owner", IntegerType()), StructField("was", IntegerType()), StructField("distance", LongType())])
    return state.select(*kept).mapInArrow(run, schema)


def transfers(state: DataFrame, size: int, k: int) -> DataFrame:
    """(cluster, n, sums): what each task's vectors of a new owner take from the old one and add to the new one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x = unpacked(b.column("v"), size)
            for sign, name in ((1, "owner"), (-1, "was")):
                at = b.column(name).to_numpy()
                for c in np.unique(at[at >= 0]).tolist():
                    own = at == c
                    sums[c] += sign * x[own].sum(0)
                    n[c] += sign * int(own.sum())
        touched = np.flatnonzero(n.astype(bool) | sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(touched.astype(np.int32)), pa.array(n[touched]), pa.array([s.tolist() for s in sums[touched]], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return state.where("owner <> was").select("v", "owner", "was").mapInArrow(run, TRANSFERS)


def added(rows: DataFrame) -> DataFrame:
    """(cluster, n, sums), a row for each cluster."""
    each = rows.select("cluster", F.posexplode(F.concat(F.array("n"), "sums")).alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("x"))
    listed = each.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("l")).select("cluster", F.transform("l", lambda p: p["x"]).alias("l"))
    return listed.select("cluster", F.col("l")[0].alias("n"), F.slice("l", 2, F.size("l")).alias("sums"))


def moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Every centroid at the floor of the mean of its vectors; empty ones stay."""
    out = centroids.copy()
    for r in sums.where("n > 0").collect():
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def first_centroids(vectors: DataFrame, key: str, size: int, k: int) -> np.ndarray:
    named = F.col("row").getField(key).cast("string")
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(named, F.lit(""))), 256)
    rows = vectors.select("v", named.isNull().alias("without"), digest.alias("digest")).orderBy("without", "digest", "v").limit(k).collect()
    return np.array([np.frombuffer(bytes(r["v"]), ">u4").astype(np.int64) - (1 << 31) for r in rows], np.int64).reshape(len(rows), size)


def with_clusters(df: DataFrame, vector: str = "embedding", key: str = "vec_id", into: str = "found", k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """The kept rows of df without the vector, and a struct column: cluster, distance, cluster_inertia, inertia, centroid (its integers), centroid_sha256."""
    spark = df.sparkSession
    bound_batches(spark)
    own = [c for c in df.columns if c not in (vector, into)]
    state = settle(whole_vectors(df, vector, into, size, scale))
    centroids = first_centroids(state, key, size, k)
    changed, sums = np.ones(len(centroids), bool), None
    for r in range(rounds + 1):
        if not changed.any():
            break
        new = settle(assign(state, size, centroids, changed))
        discard(state)
        state = new
        if r == rounds:
            break
        given = transfers(state, size, len(centroids))
        total = settle(added(given if sums is None else given.unionAll(sums)))
        if sums is not None:
            discard(sums)
        sums, before = total, centroids
        centroids = moved(before, sums)
        changed = (centroids != before).any(1)
    if sums is not None:
        discard(sums)
    if "owner" not in state.columns:  # no row at all
        state = state.withColumns({"owner": F.lit(0), "distance": F.lit(0).cast("long")})
    inertia = {r["owner"]: r["x"] for r in state.groupBy("owner").agg(F.sum("distance").alias("x")).collect()}
    listed = [(i, inertia.get(i, 0), sum(inertia.values()), c.tolist(), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    known = spark.createDataFrame(listed, "owner int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    joined = state.select("row", "owner", "distance").join(F.broadcast(known), "owner")
    found = F.struct(F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in own], found.alias(into))


def op12_delta_lloyd(spark, sf_dir: str) -> DataFrame:
    """The cluster of every kept vector."""
    vectors = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    names = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return with_clusters(vectors).select("vec_id", *[F.col(f"found.{c}").alias(c) for c in names])


def op12_sql() -> str:
    """The same by full comparisons in every round."""
    near = f"list_sum(list_transform(generate_series(1, {SIZE}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    parts = [
        f"x AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda e: isfinite(CAST(e AS DOUBLE)))) = {SIZE} AND len(embedding) = {SIZE})",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id IS NULL, sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INTEGER) AS c, v FROM x QUALIFY c < {CENTROIDS})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS (SELECT rid, CAST(min(d * {CENTROIDS} + c) % {CENTROIDS} AS INTEGER) AS c, min(d) AS d FROM (SELECT rid, c, {near} AS d FROM x, c{r} AS c) GROUP BY rid)")
        if r < ROUNDS:
            mean = f"(SELECT c, list(s ORDER BY i) AS v FROM (SELECT c, i, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS s FROM (SELECT c, unnest(generate_series(1, {SIZE})) AS i, unnest(v) AS e FROM a{r} JOIN x USING (rid)) GROUP BY c, i) GROUP BY c)"
            parts.append(f"c{r + 1} AS (SELECT c{r}.c, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN {mean} AS m USING (c))")
    return f"WITH {', '.join(p.replace(' AS (', ' AS MATERIALIZED (', 1) for p in parts)} SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN x USING (rid) JOIN (SELECT c, v AS cv FROM c{ROUNDS}) USING (c)".replace("array_to_string(v, ',')", "array_to_string(cv, ',')")
