"""Lexical retrieval packing.

Documents become byte-level BPE ids and are dealt to tasks in the order of a lexical route (the
smallest hash of their runs of ids), so copies and texts that share passages lie side by side.  A
task cuts its documents into shards of bounded size.  Each shard has a BM25 inverted index over ids,
with document frequencies and mean length of the whole corpus.  The oldest document not yet packed is
a seed; its best unused neighbours, by BM25 with the seed as the query, fill its window one after the
other.  The neighbour that crosses the window's end is cut there, and its rest is the next seed.  What
a shard cannot fill begins the next one; what a task cannot fill is cut into windows of powers of two,
which need no padding.

Ids are those of the vocabulary file as it stands: the string of a special token in a text is that
token.  Null and empty texts are the single id 1.  Repeated rows are packed each.  Equal scores keep the
order of the route, equal routes that of doc_id and a hash of the ids.  A very long text fills whole
windows and may be a shard by itself.  An empty table gives no rows.  Columns other than doc_id and text
are ignored, whatever their names.  Sequence ids are unique, not consecutive: the number of the task in
the high bits.  Where a task's range ends is drawn from a sample by Spark, so two runs may cut and pack
differently; a task that is run again within a run does not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .store import Scratch
from .tokens import UnitEncoder

#: Ids in a window, id at the end of a document, ids in a shard, size of the vocabulary.
WINDOW, END, SHARD, VOCABULARY = 2048, 1, 1 << 20, 50_257
#: Shards in a task; the number of tasks grows with the corpus.
TASK_SHARDS = 16
K1, B = 1.2, 0.75
#: Ids in the runs whose smallest hash is the route.
ROUTE = 8
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Columns doc_id, ids (little-endian uint16, with the end id), n, route of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder.shared(vocabulary, ranks)
        for batch in batches:
            for first, ids in encoder.encode(batch.column(1)):
                ids = [np.append(i, np.uint16(END)) for i in ids]
                flat = np.concatenate(ids)
                at = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
                g, cut = kernel.grams(kernel.mix(flat.astype(np.uint64) + np.uint64(1)), at, ROUTE)
                route = np.minimum.reduceat(g, cut[:-1]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(ids)), pa.array([i.astype("<u2").tobytes() for i in ids], pa.binary()), pa.array(np.diff(at)), pa.array(route)], ["doc_id", "ids", "n", "route"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, n long, route long")


def frequencies(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """How many documents hold each id, the number of documents, and the number of all their ids.

    The driver gets one row for each id of the vocabulary at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total[np.unique(np.frombuffer(ids.as_py(), "<u2"))] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["id", "df"])

    df = np.zeros(VOCABULARY, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        df[r.id] = r.df
    n, total = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return df, n, total


class Index:
    """A BM25 inverted index over the ids of a shard's documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.terms, tf, at = [], [], []
        for d, ids in enumerate(docs):
            t, c = np.unique(ids, return_counts=True)
            useful = idf[t] > 0
            t, c = t[useful], c[useful]
            self.terms.append(t)
            tf.append(c * (K1 + 1) / (c + K1 * (1 - B + B * len(ids) / mean)) * idf[t])
            at.append(np.full(len(t), d, np.int64))
        term = np.concatenate(self.terms)
        order = np.argsort(term, kind="stable")
        self.weight, self.doc = np.concatenate(tf)[order], np.concatenate(at)[order]
        self.begin = np.searchsorted(term[order], np.arange(VOCABULARY + 1))
        self.size = len(docs)

    def scores(self, d: int) -> np.ndarray:
        """BM25 of every document with document ``d`` as the query."""
        t = self.terms[d].astype(np.int64)
        n = self.begin[t + 1] - self.begin[t]
        to = np.concatenate([[0], np.cumsum(n)])
        post = np.repeat(self.begin[t] - to[:-1], n) + np.arange(to[-1])
        return np.bincount(self.doc[post], self.weight[post], self.size)


class Packer:
    """Fills windows; pieces are (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, idf: np.ndarray, mean: float, first: int):
        self.idf, self.mean, self.sequence = idf, mean, first
        self.open: list[tuple] = []  # pieces of the window that is being filled
        self.filled = 0
        self.out: list[tuple] = []

    def add(self, doc: tuple, start: int) -> int:
        """Puts a document's ids from ``start`` into the open window as far as they fit; returns where its rest begins."""
        doc_id, ids = doc
        take = min(len(ids) - start, WINDOW - self.filled)
        self.open.append((doc_id, start, ids[start : start + take], len(ids), self.sequence, self.filled))
        self.filled += take
        if self.filled == WINDOW:
            self.out += self.open
            self.open, self.filled = [], 0
            self.sequence += 1
        return start + take

    def shard(self, docs: list[tuple]) -> None:
        """Packs a shard; the last window may stay open.  A shard of no documents changes nothing."""
        if not docs:
            return
        index = Index([ids for _, ids in docs], self.idf, self.mean)
        unused = np.ones(len(docs), bool)
        seed, start, oldest = -1, 0, 0
        while True:
            if seed < 0:
                while oldest < len(docs) and not unused[oldest]:
                    oldest += 1
                if oldest == len(docs):
                    return
                seed, start = oldest, 0
                unused[seed] = False
            # whole windows of a long seed, then its rest
            while seed >= 0 and start < len(docs[seed][1]):
                start = self.add(docs[seed], start)
            query, seed = seed, -1
            if not self.filled:
                continue
            near = np.flatnonzero(unused)
            s = index.scores(query)[near]
            # equal scores keep the order of the route, in which copies are neighbours
            want = min(len(near), 64)
            order = np.argsort(-s, kind="stable") if want == len(near) else None
            done = 0
            while self.filled and done < len(near):
                if order is None:
                    top = np.sort(np.argpartition(-s, min(want, len(near) - 1))[: want + 1])
                    ranked = top[np.argsort(-s[top], kind="stable")]
                    if done >= len(ranked):
                        order = np.argsort(-s, kind="stable")
                        ranked = order
                else:
                    ranked = order
                d = int(near[ranked[done]])
                done += 1
                if not unused[d]:
                    continue
                unused[d] = False
                stop = self.add(docs[d], 0)
                if stop < len(docs[d][1]):
                    seed, start = d, stop
                    break

    def close(self) -> None:
        """Cuts what is open into windows of powers of two."""
        left, self.open, self.filled = self.open, [], 0
        total = sum(len(p[2]) for p in left)
        room = 0
        for doc_id, start, ids, n, _, _ in left:
            while len(ids):
                if not room:
                    room = size = 1 << (total.bit_length() - 1)
                take = min(room, len(ids))
                self.out.append((doc_id, start, ids[:take], n, self.sequence, size - room))
                start, ids, room, total = start + take, ids[take:], room - take, total - take
                self.sequence += not room


def batch_of(pieces: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*pieces, strict=True)) if pieces else [[]] * 6
    cols = [
        pa.array(columns[0], pa.int64()),
        pa.array(columns[1], pa.int64()),
        pa.array([len(i) for i in columns[2]], pa.int64()),
        pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in columns[2]], pa.int64()),
        pa.array(columns[3], pa.int64()),
        pa.array(columns[4], pa.int64()),
        pa.array(columns[5], pa.int64()),
    ]
    names = [x.split()[0] for x in PIECE.split(", ")]
    if with_ids:
        cols.append(pa.array([i.astype(np.int32) for i in columns[2]], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names)


def pack(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row per piece in the columns of PIECE, with the ids themselves if asked."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    tokens = scratch.keep(tokenised(docs), "tokens")
    df, n, ids_in_all = frequencies(tokens)
    mean = ids_in_all / max(n, 1)
    idf = np.log((n - df + 0.5) / (df + 0.5)).astype(np.float64)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids_in_all // (TASK_SHARDS * SHARD)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(idf, mean, TaskContext.get().partitionId() << 32)
        held: list[tuple] = []
        total = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((doc_id, np.frombuffer(ids.as_py(), "<u2")))
                total += len(held[-1][1])
                if total >= SHARD:
                    packer.shard(held)
                    held, total = [], 0
                    yield batch_of(packer.out, with_ids)
                    packer.out = []
        packer.shard(held)
        packer.close()
        yield batch_of(packer.out, with_ids)

    # rows of one id and route are ordered by their ids, so a task that is run again packs alike
    order = ("route", "doc_id", F.xxhash64("ids"))
    ordered = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    return ordered.mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))
