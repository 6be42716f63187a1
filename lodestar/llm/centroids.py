"""Exact k-means by Yinyang: bounds by groups of centroids tell which distances needn't be computed.

Vectors are integers and stand in blocks. A block's state goes from round to round beside it: each vector's cluster, an
upper bound on the distance to its centroid, and for each group of centroids a lower bound on the distances to the
others in it. Centroids are put into groups once, by their first places. When centroids have moved, bounds move with
them; a vector is looked at if its upper bound reaches the least of its lower bounds (after the upper one was made
exact), only in groups whose bound is reached, and there all centroids are measured. Distances are compared as
integers, ties for the smaller number; bounds are widened by more than their rounding, so that nothing is skipped that
could tie.

Vectors are stored once, bucketed by block, and so is each round's state: a round reads both in place, joins them
without a shuffle, and writes the state alone (20 bytes a vector and 8 a group, where vectors have 64 numbers), with the
block's sums for the next centroids. Only centroids and their sums pass through the driver, k rows of one vector's size.
"""

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, shared_dir, stored, table

DIMENSIONS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 8, 10, "3", 1024
#: Groups of centroids. Yinyang takes a tenth of their number; with few centroids three groups let bounds differ.
GROUPS = 3
#: Vectors in a block.
BLOCK = 4096
#: Integers beyond this (exclusive) have no squared distances in 64 bits for certain.
LARGEST = 1 << 26
#: Bounds are widened by this share, which is more than the rounding of square roots and sums of some hundred rounds.
WIDER = 1e-9


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v array<long>) of the rows of (vec_id, embedding) that have so many components, none null, NaN or infinite."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = (F.size("embedding") == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * SCALE))
    fits = F.forall(x, lambda c: F.abs(c * SCALE) < LARGEST)
    kept = vectors.where(F.coalesce(whole, F.lit(False)))
    return kept.select("vec_id", F.when(fits, v).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST} / {SCALE}"))).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ids' hashes are smallest; rows without an id come last, equal ids by their vectors."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = rows.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in got], dtype=np.int64)


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """A group number for each centroid, by five rounds of k-means among them."""
    groups = max(1, min(groups, len(centroids)))
    heads = centroids[:groups].astype(np.float64)
    for _ in range(5):
        of = ((centroids[:, None, :] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(groups):
            if (of == g).any():
                heads[g] = centroids[of == g].mean(axis=0)
    return np.unique(of, return_inverse=True)[1]


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """The state of a block's vectors against centroids in groups."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.cluster, self.upper, self.lower = cluster, upper, lower

    @classmethod
    def first(cls, x: np.ndarray, centroids: np.ndarray, of: np.ndarray) -> "Bounds":
        """All distances."""
        d = np.stack([_squared(x, c) for c in centroids], axis=1)
        cluster = d.argmin(axis=1)
        root = np.sqrt(d.astype(np.float64))
        every = np.arange(len(x))
        upper = root[every, cluster] * (1 + WIDER)
        root[every, cluster] = np.inf
        lower = np.stack([root[:, of == g].min(axis=1) for g in range(of.max() + 1)], axis=1) * (1 - WIDER)
        return cls(cluster.astype(np.int32), upper, lower)

    def moved(self, step: np.ndarray, of: np.ndarray) -> None:
        """Centroids have gone so far."""
        self.upper = (self.upper + step[self.cluster]) * (1 + WIDER)
        far = np.array([step[of == g].max() for g in range(of.max() + 1)])
        less = far + np.where(np.isinf(self.lower), 0, np.abs(self.lower)) * WIDER  # infinite: no other centroid in the group
        self.lower = self.lower - less

    def assigned(self, x: np.ndarray, centroids: np.ndarray, of: np.ndarray) -> int:
        """Each vector to its nearest centroid; how many distances were computed."""
        some = np.flatnonzero(self.upper >= self.lower.min(axis=1))
        best = _squared(x[some], centroids[self.cluster[some]])
        count = len(some)
        self.upper[some] = np.sqrt(best.astype(np.float64)) * (1 + WIDER)
        still = self.upper[some] >= self.lower[some].min(axis=1)
        some, best = some[still], best[still]
        reached = self.upper[some, None] >= self.lower[some]
        old = self.cluster[some].copy()
        at, own = old.astype(np.int64), best.copy()
        scanned: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for g in range(of.max() + 1):
            rows = np.flatnonzero(reached[:, g])
            if not len(rows):
                continue
            members = np.flatnonzero(of == g)
            d = np.stack([_squared(x[some[rows]], centroids[c]) for c in members], axis=1)
            count += d.size
            scanned.append((g, rows, members, d))
            near = d.argmin(axis=1)  # members ascend, so ties go to the smaller number
            dist, number = d[np.arange(len(rows)), near], members[near]
            better = (dist < best[rows]) | ((dist == best[rows]) & (number < at[rows]))
            best[rows] = np.where(better, dist, best[rows])
            at[rows] = np.where(better, number, at[rows])
        for g, rows, members, d in scanned:  # a scanned group's bound is exact
            others = np.where(members[None] == at[rows, None], np.inf, np.sqrt(d.astype(np.float64)))
            self.lower[some[rows], g] = others.min(axis=1) * (1 - WIDER)
        # a centroid that was left is one of the others in its group now
        left = np.flatnonzero(at != old)
        group = of[old[left]]
        self.lower[some[left], group] = np.minimum(self.lower[some[left], group], np.sqrt(own[left].astype(np.float64)) * (1 - WIDER))
        self.cluster[some] = at
        self.upper[some] = np.sqrt(best.astype(np.float64)) * (1 + WIDER)
        return count


def _vectors(value: bytes, dimensions: int) -> np.ndarray:
    return np.frombuffer(value, "<i4").reshape(-1, dimensions).astype(np.int64)


def _blocks(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = np.asarray(part.column("v").flatten()).astype("<i4")
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id"))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids, pa.array([x.tobytes()], pa.binary())], ["block", "ids", "vectors"])
                block += 1

    return run


STATE = "block long, cluster binary, upper binary, lower binary, sums array<long>, measured long"


def _round(centroids: np.ndarray, of: np.ndarray, step: np.ndarray | None):
    """Blocks with their state (none in the first round) -> their new state, with the clusters' counts and sums."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                x = _vectors(row["vectors"].as_py(), dimensions)
                if step is None:
                    now, measured = Bounds.first(x, centroids, of), len(x) * k
                else:
                    read = lambda c, t: np.frombuffer(row[c].as_py(), t).copy()
                    now = Bounds(read("cluster", "<i4"), read("upper", "<f8"), read("lower", "<f8").reshape(len(x), -1))
                    now.moved(step, of)
                    measured = now.assigned(x, centroids, of)
                sums = np.zeros((k, dimensions + 1), np.int64)
                for c in range(k):
                    mine = x[now.cluster == c]
                    sums[c, 0], sums[c, 1:] = len(mine), mine.sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"].as_py()], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (now.cluster, now.upper, now.lower)), pa.array([sums.ravel().tolist()], pa.list_(pa.int64())), pa.array([measured], pa.int64())],
                    ["block", "cluster", "upper", "lower", "sums", "measured"],
                )

    return run


def _placed(centroids: np.ndarray):
    """Blocks with their last state -> (vec_id, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = _vectors(batch.column("vectors")[r].as_py(), centroids.shape[1])
                cluster = np.frombuffer(batch.column("cluster")[r].as_py(), "<i4")
                yield pa.RecordBatch.from_arrays([batch.column("ids")[r].values, pa.array(cluster), pa.array(_squared(x, centroids[cluster]))], ["vec_id", "cluster", "distance"])

    return run


class Bucketed:
    """Tables bucketed by block in the shared folder, deleted at the end. There are as many buckets as the given rows have
    partitions, and not fewer than shuffles have, as Spark would shuffle both sides of a join then."""

    def __init__(self, rows: DataFrame):
        self.spark, self.names = rows.sparkSession, []
        self.buckets = min(max(rows.rdd.getNumPartitions(), int(self.spark.conf.get("spark.sql.shuffle.partitions"))), 50_000)

    def written(self, df: DataFrame, what: str) -> DataFrame:
        name = f"{what}_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        df.write.bucketBy(self.buckets, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
        self.names.append((name, path))
        return self.spark.table(name)

    def dropped(self, keep: int = 0) -> None:
        """Drops all but the first and the last `keep` tables."""
        for name, path in self.names[1:len(self.names) - keep] if keep else self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            release(self.spark, [path])
        self.names = [self.names[0], *self.names[len(self.names) - keep:]] if keep else []


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, groups: int = GROUPS, seed: str = SEED, measured: list | None = None) -> DataFrame:
    """vectors (vec_id long, embedding array of numbers, ...) -> (vec_id, cluster int, distance long, cluster_inertia
    long, inertia long, centroid_sha256 string), a row for each vector that is kept.

    Kept are vectors of so many components, none null, NaN or infinite; each becomes floor(1024 * x). The first
    centroids are the k of smallest sha256 of `<seed>:<vec_id>`; fewer vectors than k make fewer clusters. `rounds`
    times every vector goes to the nearest centroid (squared distance; ties: the smaller number), which then becomes
    the floor of the mean; empty ones stay. Then vectors are assigned once more. Repeated rows and ids count each; rows
    without id are clustered like others but are first centroids only if ids don't suffice. A component of 65,536 or
    more is an error, as distances need not fit 64 bits. No vectors: no rows. Further columns are ignored.
    `measured`, a list, gets the number of distances computed in each round.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, dimensions)
    centroids = first_centroids(rows, k, seed)
    out = "vec_id {}, cluster int, distance long".format(vectors.schema["vec_id"].dataType.simpleString())
    if not len(centroids):
        empty = spark.createDataFrame([], out + ", cluster_inertia long, inertia long, centroid_sha256 string")
        return empty
    of = grouped(centroids, groups)
    tables = Bucketed(vectors)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    blocks = tables.written(rows.mapInArrow(_blocks(dimensions), f"block long, ids array<{id_type}>, vectors binary"), "vectors")
    state, step = None, None
    for r in range(rounds + 1):
        given = blocks.drop("ids") if state is None else blocks.drop("ids").join(state.select("block", "cluster", "upper", "lower").hint("shuffle_hash"), "block")
        state = tables.written(given.mapInArrow(_round(centroids, of, step), STATE), "bounds")
        tables.dropped(keep=1)
        if measured is not None:
            measured.append(state.agg(F.sum("measured")).first()[0])
        if r == rounds:
            break
        sums = state.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        total = np.zeros(len(centroids) * (dimensions + 1), dtype=object)
        for row in sums.collect():  # one number for each component of a centroid
            total[row["at"]] = int(row["s"])
        total = total.reshape(len(centroids), -1)
        moved = np.array([[int(s) // int(t[0]) for s in t[1:]] if t[0] else c.tolist() for t, c in zip(total, centroids)], dtype=np.int64)
        step = np.sqrt(((moved - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + WIDER)
        centroids = moved
    both = blocks.join(state.select("block", "cluster").hint("shuffle_hash"), "block")
    placed = stored(both.mapInArrow(_placed(centroids), out), "placed")
    tables.dropped()
    # k rows
    told = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    each = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    each = each.join(F.broadcast(spark.createDataFrame(told, "cluster int, centroid_sha256 string")), "cluster")
    whole = each.agg(F.sum("cluster_inertia").alias("inertia"))
    each = each.crossJoin(F.broadcast(whole))  # one row
    return placed.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Each round in two parts: vectors to their nearest centroids, and these moved."""
    distance = "list_sum(list_transform(range(1, 65), lambda j: (v[j] - c[j]) * (v[j] - c[j])))"
    floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v AS c FROM v ORDER BY sha256('3:' || vec_id), v LIMIT 8)",
    ]
    for r in range(11):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, v, min({{'d': d, 'k': k}}) AS best FROM (SELECT vec_id, v, k, ({distance})::BIGINT AS d FROM v CROSS JOIN c{r}) GROUP BY vec_id, v)"
        )
        if r < 10:
            parts.append(
                f"s{r} AS (SELECT k, list({floor} ORDER BY j) AS c FROM (SELECT best.k AS k, j, sum(v[j]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS j) GROUP BY ALL) GROUP BY k)"
            )
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(s{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN s{r} ON s{r}.k = c{r}.k)")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,"
        " (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c10.c, ',')) AS centroid_sha256 FROM a10 JOIN c10 ON c10.k = best.k"
    )


SQL = _sql()
