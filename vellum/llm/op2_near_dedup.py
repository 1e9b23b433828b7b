"""MinHash near-dedup with banding, verification on full sets, and star components.

1. Each text becomes its set of five-word shingles (64-bit hashes), a 128-bit set id and band keys of
   universal hash minima. Equal sets are one class from here on, with its least doc_id.
2. A band key's members are linked to the least of them where their full sets are similar enough, and
   components are taken (alternating large-star and small-star). A key whose members now lie in one
   component needs no more work, however many they are.
3. Keys that still span components are finished. Up to `small` members: pairs across components. More:
   their members take part in an exact prefix-filter join on their rarer shingles (lengths and positions
   bound the overlap), so that a passage which a third of all documents share makes no pairs. Every pair is
   verified on its full sets; components are taken again.

With 40 bands of 4 rows, a pair of similarity 0.75 shares no key with a probability of 2.5e-7.

Defined cases: null or empty texts have empty sets and link with nothing; texts of fewer than five words
are one shingle; rows that repeat a doc_id are one vertex (their sets are linked); rows without doc_id
take no part, have a null component and are kept; other columns are carried untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, salt, table, without
from .components import components
from .shingles import Signer, shingle_set, similar

BANDS, ROWS, PERCENT, SMALL = 40, 4, 75, 32
#: Parts that rows of one set are dealt to.
SALTS = 512
#: The sample that orders shingles by how common they are: about so many sets at least, one of so many at least; bound of the table made from it.
ORDER_SAMPLE, SPARSEST, ORDER_TABLE = 2000, 1000, 200_000


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_id (null for an empty set) and band keys of every row."""

    def run(signer: Signer, ids: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": ids, "n_shingles": [], "set_id": [], "bands": []}
        for i, t in zip(ids, texts, strict=True):
            s = shingle_set(t)
            linked = i is not None and len(s) > 0
            out["n_shingles"].append(len(s))
            out["set_id"].append(xxhash.xxh3_128_digest(s.tobytes()) if linked else None)
            out["bands"].append(signer.keys(s).view(np.int64) if linked else None)
        return out

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, set_id binary, bands array<long>", lambda: (Signer(bands, rows),))


def _with_classes(signed: DataFrame, parts: int = SALTS) -> DataFrame:
    """Adds `id`, the least doc_id of the rows with the same set (null without a set); band keys stay with that row only.

    Rows are counted and joined by set and a salt of their doc_id, so that a set which a third of all rows hold
    is split; rows without a set take no part in the join.
    """
    known = signed.where("set_id is not null").withColumn("salt", salt(F.col("doc_id"), parts))
    each = known.groupBy("set_id", "salt").agg(F.min("doc_id").alias("least"))
    classes = each.groupBy("set_id").agg(F.min("least").alias("id"))
    found = known.join(each.join(classes, "set_id").select("set_id", "salt", "id"), ["set_id", "salt"])
    bands = F.when(F.col("doc_id") == F.col("id"), F.col("bands"))
    rest = signed.where("set_id is null").select("doc_id", "n_shingles", "set_id", F.lit(None).cast("long").alias("id"), "bands")
    return found.select("doc_id", "n_shingles", "set_id", "id", bands.alias("bands")).union(rest)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, set_id, shingles of the classes in `wanted` (id, set_id), from the text of the class's least document."""

    def run(ids: list, texts: list, set_ids: list) -> dict[str, list]:
        out: dict[str, list] = {"id": [], "set_id": [], "shingles": []}
        for i, t, own in zip(ids, texts, set_ids, strict=True):
            raw = shingle_set(t).tobytes()
            if xxhash.xxh3_128_digest(raw) == own:
                for k, v in zip(out, (i, own, raw), strict=True):
                    out[k].append(v)
        return out

    own, other = docs.select("doc_id", "text").alias("d"), wanted.alias("w")
    texts = own.join(other, F.col("d.doc_id") == F.col("w.id")).select("w.id", "d.text", "w.set_id")
    return arrow_map(texts, run, "id long, set_id binary, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, parts: int = 16) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough.

    v is often the centre of a star with many members: pairs are salted by u, and the set of v goes to those
    salts that occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, a, b = batch.columns
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    pairs = pairs.withColumn("salt", salt(F.col("u"), parts))
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("u_set"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("v_set")).join(pairs.select("v", "salt").distinct(), "v")
    return pairs.join(left, "u").join(right, ["v", "salt"]).select("u", "v", "u_set", "v_set").mapInArrow(run, "u long, v long")


COUNTS = "part int, shingles binary, counts binary"


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common in a sample of `rows`, sorted, with their counts.

    The sample grows with the input: every `SPARSEST`-th set by a hash of its id, or more often, so that there are about
    `ORDER_SAMPLE` of them at least. Counts are added by ranges of shingles, as packed arrays; each range gives its
    share of the `ORDER_TABLE` most common. They only set an order of shingles, which is exact whatever it is and
    fast when common ones come last.
    """
    n = rows.count()
    rate = max(1, min(SPARSEST, n // ORDER_SAMPLE))
    parts = 1 + n // rate // 1000

    def counted(raws: list) -> dict[str, list]:
        shingles, times = np.unique(np.concatenate([np.frombuffer(r, np.int64) for r in raws]) if raws else np.empty(0, np.int64), return_counts=True)
        cuts = np.searchsorted(shingles.astype(np.float64), np.linspace(-(2.0**63), 2.0**63, parts + 1)[1:-1])
        found = [(k, x.tobytes(), y.astype("<i8").tobytes()) for k, (x, y) in enumerate(zip(np.split(shingles, cuts), np.split(times, cuts), strict=True)) if len(x)]
        return {name: [f[k] for f in found] for k, name in enumerate(("part", "shingles", "counts"))}

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                if part in held:
                    x, y = np.concatenate([held[part][0], x]), np.concatenate([held[part][1], y])
                keys, at = np.unique(x, return_inverse=True)
                held[part] = keys, np.bincount(at, y).astype(np.int64)
        for part, (keys, times) in held.items():
            top = np.lexsort((keys, -times))[: ORDER_TABLE // parts + 1]
            top = np.sort(top[times[top] > 1])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([keys[top].tobytes()], pa.binary()), pa.array([times[top].tobytes()], pa.binary())], names=["part", "shingles", "counts"])

    few = rows.where(F.pmod(F.xxhash64("id"), F.lit(rate)) == 0).select("shingles").repartition(parts)
    got = arrow_map(few, counted, COUNTS).repartition(parts, "part").mapInArrow(added, COUNTS).orderBy("part").toArrow()
    whole = [np.frombuffer(b"".join(got[c].to_pylist()), np.int64) for c in ("shingles", "counts")]
    return whole[0], whole[1]


def _prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs across components among `rows` (id, component, shingles), exact for the threshold.

    Shingles stand in one order for all, common ones last. Two similar sets share one in the first
    n - ceil(t n) + 1 of the larger and the first n - ceil(2 t n / (1 + t)) + 1 of the smaller, and what
    follows it must be enough for the overlap that the threshold asks.
    """
    keys, counts = _common(rows)

    def spread(ids: list, comps: list, raws: list) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("id", "component", "n", "shingle", "pos", "indexed")}
        for i, c, raw in zip(ids, comps, raws, strict=True):
            s = np.frombuffer(raw, np.int64)
            n, often = len(s), np.zeros(len(s), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                often = np.where(keys[at] == s, counts[at], 0)
            probing, index = n + (-n * percent) // 100 + 1, n + (-n * 2 * percent) // (100 + percent) + 1
            first = s[np.lexsort((s, often))[:probing]].tolist()
            out["shingle"] += first
            out["pos"] += range(1, len(first) + 1)
            out["indexed"] += [k < index for k in range(len(first))]
            for k, v in (("id", i), ("component", c), ("n", n)):
                out[k] += [v] * len(first)
        return out

    placed = arrow_map(rows.select("id", "component", "shingles"), spread, "id long, component long, n long, shingle long, pos long, indexed boolean")
    large = placed.select("shingle", *(F.col(c).alias(f"x_{c}") for c in ("id", "component", "n", "pos")))
    small = placed.where("indexed").select("shingle", *(F.col(c).alias(f"y_{c}") for c in ("id", "component", "n", "pos")))
    x, y = F.col("x_n"), F.col("y_n")
    enough = (1 + F.least(x - F.col("x_pos"), y - F.col("y_pos"))) * (100 + percent) >= (x + y) * percent
    fits = (F.col("x_component") != F.col("y_component")) & (y <= x) & (100 * y >= percent * x) & enough
    return large.join(small, (large.shingle == small.shingle) & fits).select(F.greatest("x_id", "y_id").alias("u"), F.least("x_id", "y_id").alias("v")).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    signed = checkpointed(_with_classes(checkpointed(signatures(docs, bands, rows))))
    classes = signed.where(F.col("doc_id") == F.col("id"))
    members = classes.select("id", F.explode("bands").alias("key"))
    keys = members.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).where("least < most").drop("most")
    shared = checkpointed(members.join(keys, "key").select("key", "id", "least", "n"))

    wanted = classes.select("id", "set_id").join(shared.select("id").distinct(), "id").distinct()
    sets = checkpointed(_sets(docs, wanted).dropDuplicates(["id", "set_id"]))
    ends = signed.where("id is not null").groupBy("doc_id").agg(F.min("id").alias("v"), F.max("id").alias("u")).where("u > v")
    same_id = signed.select("doc_id", "id").join(ends.select("doc_id", "v"), "doc_id").select(F.col("id").alias("u"), "v").where("u > v")

    stars = shared.where("id > least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct()
    first = checkpointed(_verified(stars, sets, percent).union(same_id).distinct())
    parts = components(first)
    placed = shared.join(parts, shared.id == parts.node, "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    rest = checkpointed(placed.join(open_keys, "key").distinct())

    few = rest.where(F.col("n") <= small)
    x, y = (few.select("key", F.col("id").alias(k), F.col("component").alias(f"{k}_component")) for k in ("u", "v"))
    pairs = x.join(y, "key").where("u > v and u_component != v_component").select("u", "v").join(stars, ["u", "v"], "left_anti")
    many = rest.where(F.col("n") > small).select("id", "component").distinct().join(sets, "id")
    second = _verified(pairs.union(_prefix_pairs(many, percent)).distinct(), sets, percent)
    parts = components(first.union(second))

    own = signed.select("doc_id", "n_shingles", "id", salt(F.col("doc_id"), SALTS).alias("salt"))
    moved = own.select("id", "salt").distinct().join(parts, F.col("id") == F.col("node")).select("id", "salt", "component")
    component = F.coalesce("component", "id", "doc_id")
    return own.join(moved, ["id", "salt"], "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **how: int) -> DataFrame:
    """The rows of `docs` whose document stays, with their columns."""
    return without(docs, near_duplicates(docs, **how).where(~F.col("kept")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
