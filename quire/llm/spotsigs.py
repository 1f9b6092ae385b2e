"""SpotSigs document fingerprints.

A signature is a common word (the anchor) with the chain of the next content words after it; a
document's fingerprint is the set of its signatures.  Likeness is the Jaccard similarity of two sets.
Pairs are found by partitioning sets by length and comparing only sets whose lengths allow the
limit, through an inverted index over the prefix of each set that any partner must share.

A text whose words never give a signature (no anchor followed by a content word) has its whole word
sequence as its one signature; a text without words, empty or null, has the empty set.  Equal sets,
two empty ones too, have likeness 1.  Very long texts are read whole; an empty table gives no rows.
Repeated rows are fingerprinted each; ties in the order of documents (equal or null ids, which come last)
are broken by a hash of the text.  Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernel
from .store import Scratch

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which who will with you what "
    "aber als am an auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella en era es esta este fue ha hay la las lo los más me mi muy no o para pero por que se ser si sin su sus también un una y ya"
).split()
#: Content words in a chain.
CHAIN = 2
#: Text that a worker holds at once, in characters.
HELD = 2_000_000


def _anchors() -> np.ndarray:
    block = next(kernel.blocks(pa.array(sorted(set(ANCHORS)))))
    w = kernel.runs(kernel.WORDY[block.data], block.offsets)
    return np.sort(kernel.hashes(block.data, w.start, w.end))


_ANCHORS = _anchors()


def signature_sets(texts: pa.Array, chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted signature hashes (uint64) of each text."""
    out: list[np.ndarray] = []
    for block in kernel.blocks(pc.utf8_lower(texts)):
        w = kernel.runs(kernel.WORDY[block.data], block.offsets)
        h = kernel.hashes(block.data, w.start, w.end)
        at = np.minimum(np.searchsorted(_ANCHORS, h), len(_ANCHORS) - 1)
        anchor = _ANCHORS[at] == h
        content = h[~anchor]
        before = np.zeros(len(h) + 1, np.int64)
        np.cumsum(~anchor, out=before[1:])
        spot = np.flatnonzero(anchor)
        doc = np.searchsorted(w.first, spot, "right") - 1
        k, end = before[spot], before[w.first[1:]][doc]
        spot, k, end = (x[k < end] for x in (spot, k, end))
        sig = h[spot] * kernel._salts[0]
        for j in range(chain):
            ok = k + j < end
            sig[ok] += content[k[ok] + j] * kernel._salts[j + 1]
        sig = kernel.mix(sig)
        cut = np.searchsorted(spot, w.first)
        for d in range(len(cut) - 1):
            own = np.unique(sig[cut[d] : cut[d + 1]])
            if not len(own) and w.first[d + 1] > w.first[d]:
                words = h[w.first[d] : w.first[d + 1]]
                own = kernel.mix((words * kernel.powers(len(words))[0][: len(words)]).sum(dtype=np.uint64).reshape(1))
            out.append(own)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(s: np.ndarray) -> str:
    """A fingerprint's string: the length of the set and 128 bits of its content."""
    return f"{len(s)}-{hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest()}"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Columns doc_id, fingerprint, n_signatures and signatures (sorted array<long>) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = signature_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([digest(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "fingerprint", "n_signatures", "signatures"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string, n_signatures long, signatures array<long>")


def near_pairs(prints: DataFrame, limit: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of different fingerprints with likeness of at least ``limit``; a and b are each the smallest id of their fingerprint.

    ``prints`` is what ``fingerprints`` returns.  Equal fingerprints fold first.  Sets are dealt to
    partitions by length, each spanning a factor of 1 / limit, so partners are in the same partition
    or the next.  Of a set's signatures, rarest first, the first ``n - ceil(limit * n) + 1`` hold one that
    any partner's have too; a pair is proposed by the first signature that both prefixes share, once, if
    what follows in both can still reach the limit.
    """
    reps = prints.where("n_signatures > 0 and doc_id is not null").groupBy("fingerprint").agg(F.min_by(F.struct("doc_id", "n_signatures", "signatures"), "doc_id").alias("r")).select("r.*")
    each = reps.select("doc_id", F.col("n_signatures").alias("n"), F.explode("signatures").alias("sig"))
    often = each.groupBy("sig").agg(F.count(F.lit(1)).alias("held"))
    # a signature of one set joins nothing, but has its place in the order
    ranked = each.join(often, "sig").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("held", "sig")))
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / limit)) + F.lit(1e-9)).cast("int")
    prefix = F.col("n") - F.ceil(F.col("n") * limit - 1e-9) + 1
    index = ranked.where((F.col("rank") <= prefix) & (F.col("held") > 1)).select("doc_id", "n", part.alias("part"), "sig", F.col("rank").cast("int").alias("rank"))
    left = index.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("rank").alias("ra"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = index.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("rank").alias("rb"), "sig", "part")
    # the shorter set, or of equal ones the smaller id, is on the left; lengths and places prune
    shorter = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    needed = (F.col("na") + F.col("nb")) * (limit / (1 + limit)) - 1e-9
    reach = F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) + 1
    met = left.join(right, ["part", "sig"]).where(shorter & (F.col("na") >= limit * F.col("nb") - 1e-9))
    # of the signatures that a pair shares the first has most behind it
    pairs = met.groupBy("a", "b").agg(F.max(reach - needed).alias("room")).where("room >= 0").select("a", "b")
    full = pairs.join(reps.select(F.col("doc_id").alias("a"), F.col("signatures").alias("sa")), "a").join(reps.select(F.col("doc_id").alias("b"), F.col("signatures").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    likeness = both / (F.size("sa") + F.size("sb") - both)
    return full.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness.alias("likeness")).where(F.col("likeness") >= limit)


def near_classes(docs: DataFrame, limit: float = 0.8) -> DataFrame:
    """A row per document: doc_id, fingerprint, class_id (the smallest id of the fingerprint) and n_links, the classes that are near its own."""
    scratch = Scratch(docs.sparkSession, "spotsigs")
    prints = scratch.keep(fingerprints(docs), "prints")
    pairs = near_pairs(prints, limit)
    count = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")).join(count, "class_id", "left")
    return prints.select("doc_id", "fingerprint").join(least, "fingerprint").select("doc_id", "fingerprint", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (range, follower, doc_id, text): a row's next document is the row after it in its range."""

    def flush(ids: list, texts: list[str], after: list[int]) -> pa.RecordBatch:
        done = [i for i, n in enumerate(after) if n >= 0]
        edited = []
        for i in done:
            t, k = texts[i], len(texts[i]) // 2
            edited.append(t[: len(t) - k] + texts[after[i]][:k])
        own, new = signature_sets(pa.array(texts, pa.string())), signature_sets(pa.array(edited, pa.string()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in done], pa.int64()),
                pa.array([len(texts[i]) for i in done], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([digest(own[i]) for i in done], pa.string()),
                pa.array([digest(s) for s in new], pa.string()),
                pa.array([jaccard(own[i], s) for i, s in zip(done, new, strict=True)], pa.float64()),
                pa.array([jaccard(own[i], own[after[i]]) for i in done], pa.float64()),
                pa.array([len(own[i]) for i in done], pa.int64()),
            ],
            [x.split()[0] for x in EDITED.split(", ")],
        )

    ids: list = []
    texts: list[str] = []
    after: list[int] = []
    held, now, waits = 0, None, False
    for batch in batches:
        for part, follower, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            same = part == now
            if not same:
                waits = False
            if follower and not waits:
                continue
            ids.append(doc)
            texts.append(text)
            after.append(-1)
            if waits:
                after[-2] = len(texts) - 1
            waits, now = not follower, part
            held += len(text)
            if held > HELD:
                yield flush(ids, texts, after)
                ids, texts, after = ids[-1:], texts[-1:], [-1]
                held = len(texts[0])
    if len(texts) > 1:
        yield flush(ids, texts, after)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edit with the next document, descending doc_id, and their likeness.

    Documents are dealt to ranges of doc_id and sorted there; the first document of each range also
    goes to the end of the range before it, the very first to the end of the last.  No range is a
    single task's whole table, and every text is shuffled once.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = 8 * n
    bounds = docs.agg(F.percentile_approx("doc_id", [k / cuts for k in range(1, cuts)], 20 * cuts)).first()[0] or []
    edges = np.array(sorted(set(bounds)), np.int64)

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        # ranges in descending order; null ids are last
        known = pc.fill_null(ids, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array((len(edges) - np.searchsorted(edges, known, "right")).astype(np.int32))

    whole = docs.select("doc_id", F.coalesce(part_of("doc_id"), F.lit(0)).alias("part"))
    tops = sorted((r.part, r.top) for r in whole.groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    # (first id of a range, the range before it)
    follow = spark.createDataFrame([(p, t, tops[k - 1][0]) for k, (p, t) in enumerate(tops)] or [(-1, None, -1)], "part int, top long, before int")
    # a row for each range, of which there are a fixed number for each shuffle partition
    marked = docs.withColumn("part", part_of("doc_id")).join(F.broadcast(follow), "part")
    places = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(F.struct(F.col("part").alias("p"), F.lit(False).alias("follower")), F.struct(F.col("before").alias("p"), F.lit(True).alias("follower"))))
    rows = marked.select("doc_id", "text", F.explode(F.coalesce(places, F.array(F.struct(F.col("part").alias("p"), F.lit(False).alias("follower"))))).alias("x"))
    rows = rows.select(F.col("x.p").alias("p"), F.col("x.follower").alias("follower"), "doc_id", "text")
    rows = rows.repartition(n, "p").sortWithinPartitions("p", "follower", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    return rows.mapInArrow(_edit, EDITED)
