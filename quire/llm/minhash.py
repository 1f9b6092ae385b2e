"""b-bit MinHash near-duplicate detection.

1. Each document's set of word shingles gives K minima.  Bands of R full minima make bucket keys; of
   every minimum only the low B bits stay, packed as bit planes.
2. Documents with equal sets fold into the one with the smallest id, so a group of copies of any size
   is one document from there on.
3. A bucket proposes the pairs of its smallest member with each other one.  Similarity is estimated from
   bit counts of the packed planes, corrected for chance collisions; what lies more than ``SIGMAS``
   standard errors below the limit is ruled out.  A bucket in which a pair is ruled out may hold others
   that are not: its members are compared by their planes in pairs of bounded blocks.  At the defaults
   two documents of similarity 0.8 share no bucket with probability 1.4e-7.
4. The components of the pairs that are left are candidate groups, so texts that only share buckets, or
   are joined by chains of such, move no further.  A group is cut into blocks of bounded size, and each
   pair of blocks is one piece of work: what the estimate leaves is confirmed on the full shingle sets.
   A piece returns a spanning forest of its confirmed links, so rows out stay below rows in even where
   all pairs of a group are linked.
5. The components of confirmed links are the near-duplicate groups.

Null texts are empty.  A text without words has an empty set, is linked with nothing and kept; a very
long text is read whole and may be a block by itself; an empty table gives no rows.  Rows that repeat a
doc_id are folded like copies when their texts are equal; different texts of one id count as linked, and
each stands for the id.  Null ids come out with a null component and are kept.  Ties: a
pair exactly at the limit is linked.  Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .components import components
from .store import Scratch

#: Minima, minima in a band, low bits that are kept of each minimum.
K, R, B = 312, 6, 4
#: Standard errors below the limit at which an estimate rules a pair out.
SIGMAS = 5.0
#: Documents and shingles in a block of a candidate group, and parts into which a group's members are dealt when they learn its size.
BLOCK_DOCS, BLOCK_SHINGLES, SALT = 512, 1 << 20, 8

_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 1 << 32, K, dtype=np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, K, dtype=np.uint32)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each block of texts: its first row and the sorted distinct shingle hashes of its documents."""
    for block in kernel.blocks(texts):
        w, h = kernel.words(block)
        g, at = kernel.grams(h, w.first, n)
        yield block.first, [np.unique(g[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """K minima (uint32) of each set; sets must not be empty."""
    low = np.concatenate(sets)
    low = (low >> np.uint64(32)).astype(np.uint32)
    at = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=at[1:])
    out = np.empty((K, len(sets)), np.uint32)
    for k in range(K):
        out[k] = np.minimum.reduceat((low ^ _XOR[k]) * _MUL[k], at)
    return np.ascontiguousarray(out.T)


def pack(m: np.ndarray) -> np.ndarray:
    """The low B bits of the minima as B bit planes: rows of B * K / 8 bytes."""
    return np.concatenate([np.packbits((m >> np.uint32(b)) & np.uint32(1), axis=1) for b in range(B)], axis=1)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of a packed signature, or of each row of them, to each of ``many``, corrected for chance collisions of B bits."""
    differ = (one ^ many).reshape(len(many), B, -1)
    other = np.bitwise_count(np.bitwise_or.reduce(differ, axis=1)).sum(axis=1, dtype=np.int64)
    chance = 0.5**B
    return ((K - other) / K - chance) / (1 - chance)


def floor_of(limit: float) -> float:
    """The estimate below which a pair of similarity ``limit`` would lie with odds of ``SIGMAS`` standard errors."""
    chance = 0.5**B
    p = limit + (1 - limit) * chance
    return limit - SIGMAS * (p * (1 - p) / K) ** 0.5 / (1 - chance)


SIGNATURE = "doc_id long, t long, n_shingles long, d1 long, d2 long, sig binary, bands array<long>"


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """Per document: a hash of its text, the size and two 64-bit digests of its set, packed planes and band keys (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), shingle):
                full = [i for i, s in enumerate(sets) if len(s)]
                n = len(sets)
                size = np.array([len(s) for s in sets], np.int64)
                d1, d2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
                sig: list = [None] * n
                bands: list = [None] * n
                if full:
                    m = minima([sets[i] for i in full])
                    planes = pack(m)
                    wide = m.reshape(len(full), K // R, R).astype(np.uint64)
                    keys = np.zeros((len(full), K // R), np.uint64)
                    for r in range(R):
                        keys = kernel.mix(keys * np.uint64(31) + wide[:, :, r] + np.uint64(1))
                    keys = kernel.mix(keys + np.arange(K // R, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    for j, i in enumerate(full):
                        d1[i] = sets[i].sum(dtype=np.uint64).view(np.int64)
                        d2[i] = kernel.mix(sets[i] ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)
                        sig[i], bands[i] = planes[j].tobytes(), keys[j]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(size), pa.array(d1), pa.array(d2), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "t", "n_shingles", "d1", "d2", "sig", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, SIGNATURE)


class Forest:
    """Sets that are joined one by one."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, i: int, j: int) -> bool:
        """Joins the sets of two members; whether they were apart."""
        a, b = self.find(i), self.find(j)
        self.root[b] = a
        return a != b


def fits(one: np.ndarray, many: np.ndarray, limit: tuple[int, int]) -> np.ndarray:
    """Whether sizes are within the limit of each other, without which there is no link."""
    return limit[1] * np.minimum(one, many) >= limit[0] * np.maximum(one, many)


def links(side: np.ndarray, size: np.ndarray, sig: np.ndarray, limit: tuple[int, int], sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs, or of those between the two sides if both are there, that the estimate leaves and that the full sets, if given, confirm."""
    up, down = limit
    least, forest, out = floor_of(up / down), Forest(len(size)), []
    two = len(side) > 0 and side[0] != side[-1]
    for i in range(len(size) - 1):
        guess = estimate(sig[i], sig[i + 1 :])
        ok = (guess >= least) & fits(size[i], size[i + 1 :], limit)
        if two:
            ok &= side[i + 1 :] != side[i]
        hit = np.flatnonzero(ok)
        for j in (hit[np.argsort(-guess[hit], kind="stable")] + i + 1).tolist():
            if forest.find(i) == forest.find(j):
                continue
            if sets is not None:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if down * both < up * (len(sets[i]) + len(sets[j]) - both):
                    continue
            forest.join(i, j)
            out.append((i, j))
    return out


def planes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def by_piece(shingle: int, limit: tuple[int, int], confirm: bool):
    """Works through sorted rows (group, p, q, side, doc_id, n_shingles, sig, and text to confirm), one piece (group, p, q) at a time."""

    def piece(rows: pa.Table) -> pa.RecordBatch:
        sets = [s for _, part in shingle_sets(rows["text"], shingle) for s in part] if confirm else None
        ids = rows["doc_id"].to_numpy()
        found = links(rows["side"].to_numpy(), rows["n_shingles"].to_numpy(), planes(rows["sig"]), limit, sets)
        return pa.RecordBatch.from_arrays([pa.array([int(ids[i]) for i, _ in found], pa.int64()), pa.array([int(ids[j]) for _, j in found], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = [batch.column(k).to_numpy() for k in range(3)]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for at, to in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                part = batch.slice(at, to - at)
                if held and any(part.column(k)[0] != held[0].column(k)[0] for k in range(3)):
                    yield piece(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield piece(pa.Table.from_batches(held))

    return run


PIECE = ["group", "p", "q", "side", "doc_id"]


def in_blocks(member: DataFrame, shingles: bool) -> DataFrame:
    """The members (group, doc_id, t, n_shingles, sig) of groups in pieces: every pair of a group's blocks, with the member's side; blocks are bounded in documents, and in ``shingles`` if asked."""
    member = member.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    weight = F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES if shingles else F.lit(0.0))
    size = member.groupBy("group").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("shingles"))
    size = size.select("group", F.ceil(weight).cast("int").alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    cut = member.join(size, ["group", "salt"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    cut = cut.select("group", "doc_id", "t", "n_shingles", "sig", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return cut.select("group", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "doc_id", "t", "n_shingles", "sig")


def candidates(reps: DataFrame, limit: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Pairs (a, b) that share a bucket and that the estimate leaves, enough of them to join all such documents; ``reps`` has doc_id, t, n_shingles, sig, bands."""
    least = floor_of(limit[0] / limit[1])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ok = (estimate(planes(batch.column(4)), planes(batch.column(5))) >= least) & fits(batch.column(2).to_numpy(), batch.column(3).to_numpy(), limit)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["a", "b", "ok"])

    rows = reps.select(F.explode("bands").alias("key"), "doc_id")
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("docs")).where("least <> most")
    # merge joins: the plan, and what it moves, is the same at every size
    star = scratch.keep(rows.join(shared.select("key", "least", "docs").hint("merge"), "key").where("doc_id <> least"), "star")
    side = lambda a: reps.select(F.col("doc_id").alias(a), F.col("n_shingles").alias(f"n{a}"), F.col("sig").alias(f"s{a}"))
    pairs = star.select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()
    pairs = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "na", "nb", "sa", "sb")
    tested = scratch.keep(pairs.mapInArrow(test, "a long, b long, ok boolean"), "tested")
    # other pairs of the buckets in which one was ruled out
    out = tested.where("not ok").select(F.col("a").alias("doc_id"), F.col("b").alias("least"))
    mixed = star.where("docs > 2").join(out.hint("merge"), ["doc_id", "least"], "left_semi").select("key").distinct()
    member = rows.join(mixed.hint("merge"), "key").select(F.col("key").alias("group"), "doc_id")
    member = member.join(reps.select("doc_id", "t", "n_shingles", "sig").hint("merge"), "doc_id")
    work = in_blocks(member, False).select(*PIECE, "n_shingles", "sig").repartition("group", "p", "q").sortWithinPartitions(*PIECE)
    more = work.mapInArrow(by_piece(0, limit, False), "a long, b long")
    return tested.where("ok").select("a", "b").unionByName(more)


def near_duplicates(docs: DataFrame, shingle: int = 5, limit: tuple[int, int] = (4, 5)) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, kept for each document; ``limit`` is the least Jaccard similarity as a fraction."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    sig = scratch.keep(signatures(docs, shingle), "sig")
    own = sig.where("n_shingles > 0 and doc_id is not null")
    sets = scratch.keep(own.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets")

    reps = own.join(sets.select(F.col("rep").alias("doc_id"), "d1", "d2", "n_shingles"), ["doc_id", "d1", "d2", "n_shingles"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"])
    reps = scratch.keep(reps.select("doc_id", "t", "n_shingles", "sig", "bands"), "reps")
    groups = components(candidates(reps, limit, scratch), scratch, "group")
    member = groups.select(F.col("node").alias("doc_id"), F.col("root").alias("group")).join(reps.select("doc_id", "t", "n_shingles", "sig").hint("merge"), "doc_id")
    member = scratch.keep(member, "member")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    texts = texts.join(member.select("doc_id", "t").hint("merge"), ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"])
    work = in_blocks(member, True).join(texts, ["doc_id", "t"]).select(*PIECE, "n_shingles", "sig", "text")
    work = work.repartition("group", "p", "q").sortWithinPartitions(*PIECE)
    found = scratch.keep(work.mapInArrow(by_piece(shingle, limit, True), "a long, b long"), "links")
    joined = scratch.keep(components(found, scratch, "link"), "joined")

    same = sets.join(joined.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 or root is not null")
    same = scratch.keep(same.select("d1", "d2", "n_shingles", F.coalesce("root", "rep").alias("component")), "same")
    out = sig.select("doc_id", "n_shingles", "d1", "d2").join(same, ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
