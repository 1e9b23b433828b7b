"""Exact top-k inner-product search: tiled matrix products, selection per tile, tree merging.

Vectors become integers (floor of `scale` times each component). Candidates are packed into shards and queries
into blocks, each one binary row of the narrowest integers that hold it, of at most `SHARD_ROWS` or `BLOCK_ROWS`
vectors and about `TILE_BYTES` as doubles. Only blocks are replicated, to every shard: a shard is shuffled once,
and stays in its task while the blocks stream past. A tile is one matrix product, from which each query keeps its
best k; lists are merged by a tree of bounded fan-in. Products run in doubles where the bound on the sum shows
them exact, else in Python's integers.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows
without vec_id; only vectors of equal dimension are compared; rows that repeat a vec_id are all queries and
candidates, never of one another, and only rows equal in both columns count once; scores beyond a long are
clipped to it before they are compared; fewer than k candidates give all of them; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARD_ROWS, BLOCK_ROWS, STEP_ROWS, FAN_IN = 8192, 2048, 256, 16
#: About so many bytes of doubles in a shard or block, whatever the dimension.
TILE_BYTES = 16 << 20
#: Integers that vectors are stored as, narrowest first; doubles hold the rest.
KINDS = ("i1", "<i2", "<i4", "<f8")
PACKED = "part int, dim int, kind string, ids binary, vectors binary"
LISTS = "query_id long, shard int, vec_id array<long>, score array<long>"
EXACT = float(1 << 53)


def narrow(m: np.ndarray) -> tuple[str, bytes]:
    """The narrowest kind that holds whole numbers exactly, and their bytes."""
    low, high = m.min(initial=0), m.max(initial=0)
    kind = next(k for k in KINDS if k == KINDS[-1] or np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, m.astype(kind).tobytes()


def packed(vectors: DataFrame, parts: int, scale: float) -> DataFrame:
    """Rows of (part, dim, kind, ids, vectors): what hashes to one part, in order of vec_id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            for dim, (ids, rows) in held.items():
                kind, raw = narrow(np.concatenate(rows) if rows else np.empty(0))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([dim], pa.int32()), pa.array([kind]), pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()), pa.array([raw], pa.binary())], names=["part", "dim", "kind", "ids", "vectors"])

        for batch in batches:
            own_parts, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            dims = np.diff(ends)
            edges = np.flatnonzero((np.diff(own_parts) != 0) | (np.diff(dims) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
                if lo == hi:
                    continue
                if own_parts[lo] != part:
                    yield from out()
                    part, held = int(own_parts[lo]), {}
                to = held.setdefault(int(dims[lo]), ([], []))
                to[0].append(ids[lo:hi])
                to[1].append(np.floor(scale * values[ends[lo] : ends[hi]]))
        yield from out()

    part = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(parts)).cast("int")
    dealt = vectors.withColumn("part", part).repartition(parts, "part").sortWithinPartitions("part", "vec_id", "embedding")
    return dealt.select("part", "vec_id", "embedding").mapInArrow(pack, PACKED)


def best(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """Each query's best k of one tile, ties to the smaller id; candidates stand in order of id."""
    bound = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * q.shape[1] if q.size and c.size else 0
    n = len(c_ids)
    if bound * n >= EXACT * 512:
        q, c = (np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape) for m in (q, c))
    exact = q.dtype != object and bound < EXACT
    if not exact and q.dtype != object:
        q, c = (np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape) for m in (q, c))
    least = k + int(np.unique(c_ids, return_counts=True)[1].max(initial=1))  # the query's own rows fall out
    turned, order = c.T.copy(), np.arange(n - 1, -1, -1)
    for at in range(0, len(q), STEP_ROWS):
        scores = q[at : at + STEP_ROWS] @ turned
        if exact:
            keys = scores.astype(np.int64) * n + order  # distinct, and in the order that is asked for
            for own, row in zip(q_ids[at : at + STEP_ROWS].tolist(), keys, strict=True):
                few = np.argpartition(row, n - least)[n - least :] if n > least else np.arange(n)
                few = few[np.argsort(row[few])[::-1]]
                few = few[c_ids[few] != own][:k]
                yield own, c_ids[few].tolist(), (row[few] // n).tolist()
        else:
            for own, row in zip(q_ids[at : at + STEP_ROWS].tolist(), scores.tolist(), strict=True):
                few = sorted((-max(-(1 << 63), min((1 << 63) - 1, s)), i) for s, i in zip(row, c_ids.tolist(), strict=True) if i != own)[:k]
                yield own, [i for _, i in few], [-s for s, _ in few]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score of the rows whose vec_id is divisible by `every`, against all rows."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", "embedding").distinct()
    asked = clean.where(F.col("vec_id") % every == 0)
    n, n_asked, most = vectors.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("embedding"))).first()
    in_tile = max(1, TILE_BYTES // (8 * max(most or 1, 1)))
    shards, blocks = -(-max(n, 1) // min(SHARD_ROWS, in_tile)), -(-max(n_asked, 1) // min(BLOCK_ROWS, in_tile))
    of = lambda df, name: df.select(F.col("part").alias(name), "dim", *(F.col(c).alias(f"{name}_{c}") for c in ("kind", "ids", "vectors")))
    left = of(packed(asked, blocks, scale), "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    tiles = left.join(of(packed(clean, shards, scale), "shard").hint("shuffle_merge"), ["shard", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                shard, dim, q_kind, qi, qv, c_kind, ci, cv = (c[at].as_py() for c in batch.columns)
                q_ids, c_ids = np.frombuffer(qi, "<i8"), np.frombuffer(ci, "<i8")
                q, c = (np.frombuffer(v, k).astype(np.float64).reshape(len(i), dim) for v, k, i in ((qv, q_kind, q_ids), (cv, c_kind, c_ids)))
                found = list(best(q, q_ids, c, c_ids, k))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([shard] * len(found), pa.int32()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.int64()))], names=["query_id", "shard", "vec_id", "score"])

    lists = tiles.select("shard", "dim", "block_kind", "block_ids", "block_vectors", "shard_kind", "shard_ids", "shard_vectors").mapInArrow(run, LISTS)
    rows = lists.select("query_id", "shard", F.explode(F.arrays_zip("vec_id", "score")).alias("x")).select("query_id", "shard", "x.vec_id", "x.score")
    while True:
        shards = -(-shards // FAN_IN)
        rows = rows.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        place = F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id"))
        rows = rows.withColumn("rank", place).where(F.col("rank") <= k)
        if shards == 1:
            return rows.select("query_id", "rank", "vec_id", "score")
        rows = rows.drop("rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (
  select query_id, vec_id, score,
         cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank
  from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
