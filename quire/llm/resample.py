"""Importance resampling towards a target: documents drawn by how likely their words are in the target.

Features of a text are its words and pairs of neighbouring words.  Their strings are counted over all documents and over the
target in one dictionary of distinct strings; each is hashed once, and the buckets' counts give a bucket its gain,
the log ratio of its share in the target to that in the documents.  Gains go back to the counts of features of each
document, whose mean gain is its weight; with a Gumbel key of the id added, the greatest scores are a
weighted draw without replacement.

Texts are taken in blocks of about ``BLOCK`` bytes, so what is shuffled are the distinct strings of a block with their
counts, sorted and compressed, dealt to parts by a hash: a string that is in every document costs a part one entry a block.
A part is the dictionary of its strings; parts grow in number with the text.  Pairs go by their first word, whose pairs
then compress together, and those of words that a sample finds frequent by both words; where a string goes
decides nothing but the plan.  The buckets of a part's
strings return to the blocks that hold them in the order in which they came.  Only the ``BUCKETS`` gains go through the
driver.  Tables that cut lineage are written to the shared folder.

Null texts and texts without words have weight 0; repeated rows are counted and drawn each for itself; rows without an id
hash as an empty id and come last among equal scores; an empty target, or no documents, gives gains from
the added ones alone; further columns are left out.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .store import Scratch

BUCKETS = 10_000
SEED = 7
#: Percent of the documents of at least ``LEAST`` words that are drawn.
SHARE, LEAST = 25, 20
#: Bytes of text in a block, and characters of text for each part of the dictionary.
BLOCK, PART = 16 << 20, 8 << 20
#: Parts in which the pairs of a block are told apart, and counts of features that are weighed together.
SLICES, WEIGHED = 8, 1 << 19
#: Characters of the sample that frequent words are taken from; a word is frequent that has a quarter of a part's share of it.
SAMPLE = 4 << 20


def _pack(a: np.ndarray) -> bytes:
    """Numbers compressed byte by byte: all lowest bytes first."""
    return _zip(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def _zip(raw: bytes, level: int = 3) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def _raw(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_raw(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


class Counted:
    """The features of a block of texts: strings by part, and counts of each document by place in that order."""

    def __init__(self, texts: pa.Array, parts: int, frequent: pa.Array):
        doc, codes, known = self._words(texts)
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        base = len(known) + 1
        at, kinds = self._kinds(codes, pair, base)
        del codes
        part = self._parts(known, (kinds // base).astype(np.int32), (kinds % base).astype(np.int32) - 1, parts, frequent)
        order = np.lexsort((kinds, part))
        kinds, part, distinct = kinds[order], part[order], max(1, len(kinds))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        at = place[at]
        del order, place
        count = np.bincount(at, minlength=len(kinds)).astype(np.int32)
        edge = np.searchsorted(part, np.arange(parts + 1))
        self.rows = []
        for p in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
            own = kinds[edge[p] : edge[p + 1]]
            second = own % base - 1
            strings = pc.binary_join_element_wise(known.take(pa.array(own // base)), known.take(pa.array(np.maximum(second, 0), mask=second < 0)), pa.scalar(" ", pa.large_string()), null_handling="skip")
            text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(own)], pa.int64()), strings), pa.scalar("\n", pa.large_string()))[0].as_py()
            self.rows.append((p, _zip(text.encode(), 9), _pack(count[edge[p] : edge[p + 1]])))
        del kinds, part
        # places of each document in order, with how often each is there
        both = np.concatenate([doc, doc[pair]]).astype(np.int64)
        del doc, pair
        both *= distinct
        both += at
        del at
        both.sort()
        start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        times = np.diff(np.append(start, len(both))).astype(np.int32)
        both = both[start]
        of, held = (both // distinct).astype(np.int32), (both % distinct).astype(np.int32)
        self.size = np.bincount(of, minlength=len(self.words))
        gap = np.diff(held, prepend=np.int32(0))
        fresh = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
        gap[fresh] = held[fresh]
        self.counts = _pack(gap), _pack(times)

    @staticmethod
    def _kinds(codes: np.ndarray, pair: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """The kind of each word and of each pair, and the kinds: ``base`` times the first word, plus one more than the second if there is one.

        Words are kinds as they are; pairs are told apart in slices, so that the table of one is small.
        """
        at = np.empty(len(codes) + len(pair), np.int32)
        at[: len(codes)] = codes
        kinds, n = [np.arange(base - 1, dtype=np.int64) * base], base - 1
        slices = (codes[pair] + codes[pair + 1]) % SLICES
        for k in range(SLICES):
            own = np.flatnonzero(slices == k)
            first = pair[own]
            coded = pa.array(codes[first] * np.int64(base) + codes[first + 1] + 1).dictionary_encode()
            at[len(codes) + own] = coded.indices.to_numpy() + n
            kinds.append(coded.dictionary.to_numpy())
            n += len(kinds[-1])
        return at, np.concatenate(kinds)

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Document and number of each word, and the words by number, in order."""
        whole = next(kernel.blocks(texts, 1 << 62))
        inside = kernel.WORDY[whole.data]
        w = kernel.runs(inside, whole.offsets)
        self.words = np.diff(w.first)
        to = np.zeros(len(w.start) + 1, np.int64)
        np.cumsum(w.end - w.start, out=to[1:])
        letters = kernel.LOWER[whole.data[inside]]
        coded = pa.LargeStringArray.from_buffers(len(w.start), pa.py_buffer(to), pa.py_buffer(letters)).dictionary_encode()
        # numbers in the order of the words, so that strings of features come sorted
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int32)
        rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        doc = np.repeat(np.arange(len(self.words), dtype=np.int32), self.words)
        return doc, rank[coded.indices.to_numpy()], coded.dictionary.take(order)

    @staticmethod
    def _parts(known: pa.Array, a: np.ndarray, b: np.ndarray, parts: int, frequent: pa.Array) -> np.ndarray:
        """The part of each feature, by the hash of its first word, and of its second word where the first is frequent."""
        if not len(a):
            return np.zeros(0, np.int64)
        off = np.frombuffer(known.buffers()[1], np.int64)[known.offset : known.offset + len(known) + 1]
        raw = known.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        h = np.concatenate([kernel.hashes(data, off[:-1], off[1:]), np.zeros(1, np.uint64)])
        both = np.array(pc.is_in(known, frequent), bool)[a]
        return (kernel.mix(h[a] * np.uint64(kernel.BASE) + np.where(both, h[b], np.uint64(0))) % np.uint64(parts)).astype(np.int64)


BLOCKS = "kind int, block string, side int, part int, features binary, counts binary, ids binary, words binary, size binary, held binary, times binary"


def frequent_words(docs: DataFrame, chars: int, parts: int) -> list[str]:
    """Words of at least a quarter of a part's share of a sample: at most four for each part."""
    part = docs.sample(min(1.0, SAMPLE / max(1, chars)), SEED)
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = part.select(F.explode(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    return [r.w for r in words.where(F.col("n") * 4 * parts >= total).collect()]


def blocks(docs: DataFrame, parts: int, side: int, with_documents: bool, frequent: list[str] | None = None) -> DataFrame:
    """Rows of kind 1, the strings of a block and part with their counts, and if asked a row of kind 0 for each block: the counts of its documents."""

    limit, hot = BLOCK, list(frequent or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            made, name = Counted(rows.column(1).chunk(0), parts, pa.array(hot, pa.large_string())), uuid.uuid4().hex
            for p, features, counts in made.rows:
                yield _row(kind=1, block=name, side=side, part=p, features=features, counts=counts)
            if with_documents:
                ids = rows.column(0).chunk(0)
                known = np.array(ids.is_valid(), bool)
                packed = _pack(np.stack([np.array(pc.fill_null(ids, 0), np.int64), known.astype(np.int64)]))
                yield _row(kind=0, block=name, side=side, ids=packed, words=_pack(made.words.astype(np.int64)), size=_pack(made.size.astype(np.int64)), held=made.counts[0], times=made.counts[1])
            del made, rows
            # what Arrow holds in reserve would stay with the idle worker
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for k in range(0, len(batch), 16):
                part = batch.slice(k, 16)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column(1))).as_py()
                if size >= limit:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    rows = docs.select(F.col(docs.columns[0]).cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, BLOCKS)


_FIELDS = pa.schema([(n, {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in BLOCKS.split(", "))])


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([values], _FIELDS)


def dictionary(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Of rows of kind 1: for each block and part the bucket of each string, and for each part (block null) the counts of buckets on both sides."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [pc.split_pattern(pa.array([_raw(f).decode()], pa.large_string()), "\n").flatten() for f in pdf["features"]]
        counts = [_unpack(c, np.int32) for c in pdf["counts"]]
        codes, strings = _numbered(pa.chunked_array(texts).combine_chunks())
        # the one place where strings are hashed
        bucket = np.fromiter((zlib.crc32(s.as_py().encode()) % n_buckets for s in strings), np.int64, len(strings))
        totals, out, at = [np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)], [], 0
        for block, side, count in zip(pdf["block"], pdf["side"], counts, strict=True):
            own = bucket[codes[at : at + len(count)]]
            at += len(count)
            np.add.at(totals[side], own, count)
            if side == 0:
                out.append((block, key[0], own.astype(np.uint16).tobytes(), None, None))
        out.append((None, key[0], None, totals[0], totals[1]))
        return pd.DataFrame(out, columns=["block", "part", "buckets", "s", "t"])

    if n_buckets > 1 << 16:
        raise ValueError("a bucket takes two bytes")
    return rows.groupBy("part").applyInPandas(merge, "block string, part int, buckets binary, s array<long>, t array<long>")


def gains(found: DataFrame, n_buckets: int) -> np.ndarray:
    """The gain of each bucket, floor(1000 ln) of its share in the target to its share in the documents, with one added to each count."""
    each = found.where("block is null").select(F.posexplode(F.arrays_zip("s", "t")).alias("bucket", "n"))
    each = each.groupBy("bucket").agg(F.sum("n.s").alias("s"), F.sum("n.t").alias("t"))
    total = each.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    gain = F.floor(1000 * F.log((t + 1) * float(total.s + n_buckets) / ((s + 1) * float(total.t + n_buckets))))
    out = np.zeros(n_buckets, np.int64)
    for row in each.select("bucket", gain.alias("gain")).collect():
        out[row.bucket] = row.gain
    return out


def _sums(size: np.ndarray, held: np.ndarray, times: np.ndarray, bucket: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and floored mean gain of the features of each document, whose places are gaps; a few documents at a time."""
    to = np.concatenate([[0], np.cumsum(size)])
    n, weight = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    a = 0
    while a < len(size):
        z = max(a + 1, int(np.searchsorted(to, to[a] + WEIGHED, "right")) - 1)
        own, at = slice(to[a], to[z]), to[a : z + 1] - to[a]
        place = np.cumsum(held[own], dtype=np.int64)
        place -= np.repeat(np.concatenate([[0], place])[at[:-1]], size[a:z])
        total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v, dtype=np.int64)])[at])  # noqa: B023, E731
        n[a:z] = total(times[own])
        weight[a:z] = total(gain[bucket[place]] * times[own]) // np.maximum(n[a:z], 1)
        a = z
    return n, weight


WEIGHTS = "doc_id long, n_words long, n_features long, weight long"


def weighed(rows: DataFrame, found: DataFrame, gain: np.ndarray) -> DataFrame:
    """Columns doc_id, n_words, n_features, weight from the blocks' counts and the buckets of their strings."""

    def weigh(key: tuple, own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        bucket = np.frombuffer(b"".join(parts.sort_values("part")["buckets"]), np.uint16)
        ids, known = _unpack(own["ids"].iloc[0], np.int64).reshape(2, -1)
        words, size, held, times = (_unpack(own[c].iloc[0], k) for c, k in (("words", np.int64), ("size", np.int64), ("held", np.int32), ("times", np.int32)))
        n, weight = _sums(size, held, times, bucket, gain)
        return pd.DataFrame({"doc_id": pd.arrays.IntegerArray(ids.copy(), known == 0), "n_words": words, "n_features": n, "weight": weight})

    return rows.groupBy("block").cogroup(found.where("block is not null").select("block", "part", "buckets").groupBy("block")).applyInPandas(weigh, WEIGHTS)


def gumbel(seed: int) -> Column:
    """floor(1000 G) of a Gumbel variable G from a hash of the seed and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scores: DataFrame, scratch: Scratch, share: int, least: int) -> DataFrame:
    """The rank of each drawn row: the best ``share`` percent of those of at least ``least`` words by score, then id; null for the others.

    Rows are dealt to ranges of the score and numbered in each; the ranges' sizes give where each begins.
    """
    able = scores.where(F.col("n_words") >= least)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.desc("n_features")]
    sorted_ = able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    sorted_ = scratch.keep(sorted_, "ranges")
    part, pos = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # a row for each task of the sort
    sizes = {r.part: r.n for r in sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn, begin, at = share * sum(sizes.values()) // 100, [], 0
    for p in sorted(sizes):
        begin.append((p, at))
        at += sizes[p]
    begins = scores.sparkSession.createDataFrame(begin, "part long, begin long")
    rank = F.col("begin") + pos + 1
    out = sorted_.withColumn("part", part).join(F.broadcast(begins), "part").withColumn("rank", F.when(rank <= drawn, rank))
    rest = scores.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return out.select(*rest.columns).unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, seed: int = SEED, share: int = SHARE, least: int = LEAST, n_buckets: int = BUCKETS) -> DataFrame:
    """Columns doc_id, n_features, weight, score, rank of each document (the first column of ``docs`` and of ``target`` is the id, ``text`` the text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    docs, target = docs.select("doc_id", "text"), target.select(target.columns[0], "text")
    chars = sum(d.agg(F.coalesce(F.sum(F.length(F.col("text").cast("string"))), F.lit(0))).first()[0] for d in (docs, target))
    parts = 1 + chars // PART
    frequent = frequent_words(docs, chars, parts)
    made = blocks(docs, parts, 0, True, frequent).unionByName(blocks(target, parts, 1, False, frequent))
    made.write.partitionBy("kind").option("compression", "zstd").parquet(scratch.path("blocks"))
    kinds = ", ".join(c for c in BLOCKS.split(", ") if c != "kind int")
    read = lambda kind: spark.read.schema(kinds).parquet(f"{scratch.path('blocks')}/kind={kind}") if _there(scratch, f"blocks/kind={kind}") else spark.createDataFrame([], kinds)
    found = scratch.keep(dictionary(read(1).select("block", "side", "part", "features", "counts"), n_buckets), "buckets")
    scratch.drop("blocks/kind=1")
    weights = weighed(read(0).select("block", "ids", "words", "size", "held", "times"), found, gains(found, n_buckets))
    scores = scratch.keep(weights.withColumn("score", F.col("weight") + gumbel(seed)), "scores")
    scratch.drop("blocks", "buckets")
    return ranked(scores, scratch, share, least).select("doc_id", "n_features", "weight", "score", "rank")


def _there(scratch: Scratch, name: str) -> bool:
    fs, at = scratch._at(name)
    return fs.exists(at)
