"""Problem 9: evaluation texts inside training texts, by spaced seeds.

A seed is a fixed mask over a span of consecutive words; positions with 0 are ignored, so a hit survives substituted
words there. Every mask spans ``min_words`` words or fewer, hence a common run of min_words words always gives a hit of every mask.
Hits are verified along their diagonal: the longest run of equal words, and the longest stretch around it that
tolerates substitutions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.operators.skew import meeting
from loreloom.session import cut

#: Fixed masks; each has 8 of 12 positions.
MASKS = ("110110101011", "111010011011", "101101110101")
MIN_WORDS = 12
#: With more test fingerprints than this, they are not broadcast but joined by a shuffle.
MAX_BROADCAST = 4_000_000
#: A fingerprint that stands this often in the documents is joined by several tasks.
HOT_SEED = 10_000
#: Up to this many documents with hits (8 bytes each), their ids are broadcast to keep the others from being shuffled.
FEW_IDS = 1_000_000
OUT = "doc_id bigint, item_id bigint, part string, run int, stretch int, mismatches int"


def words(c: Column) -> Column:
    """64-bit hashes of the words: unbroken runs of letters and digits, letter case ignored."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.xxhash64(w))


def _mix(tokens: np.ndarray, mask: int) -> np.ndarray:
    """The fingerprint of each position of one flat array of word hashes under one mask."""
    shape = MASKS[mask]
    n = len(tokens) - len(shape) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    t = tokens.astype(np.int64).view(np.uint64)
    h = np.full(n, 0x51_7C_C1_B7_27_22_0A_95 + mask, np.uint64)
    for at, on in enumerate(shape):
        if on == "1":
            h = (h ^ t[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _verify(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Along one diagonal (doc position minus item position): longest run of equal words, longest stretch with at most one mismatch in any three words, and its mismatches."""
    a, b = max(0, shift), min(len(doc), len(item) + shift)
    same = doc[a:b] == item[a - shift : b - shift]
    run = best = start = miss = stretch = missed = 0
    gap = 0
    for k, ok in enumerate(same.tolist()):
        if ok:
            run += 1
            best = max(best, run)
            gap += 1
            if k + 1 - start > stretch:
                stretch, missed = k + 1 - start, miss
        else:
            run = 0
            if k > start and gap >= 2:
                miss += 1
            else:
                start, miss = k + 1, 0
            gap = 0
    return best, stretch, missed


def _seeds(items: list[tuple[int, str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted fingerprints of the test parts, with the part's number and position of each."""
    h, p, at = [], [], []
    for k, (_, _, t) in enumerate(items):
        for m in range(len(MASKS)):
            f = _mix(t, m)
            h.append(f)
            p.append(np.full(len(f), k))
            at.append(np.arange(len(f)))
    h, p, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, p, at))
    order = np.argsort(h, kind="stable")
    return h[order].astype(np.uint64), p[order], at[order]


def _rows(found: dict[tuple[int, int, str], tuple[int, int, int]]) -> pa.RecordBatch:
    k, v = list(found), list(found.values())
    return pa.RecordBatch.from_pydict(
        {"doc_id": pa.array([x[0] for x in k], pa.int64()), "item_id": pa.array([x[1] for x in k], pa.int64()), "part": pa.array([x[2] for x in k], pa.string()), "run": pa.array([x[0] for x in v], pa.int32()), "stretch": pa.array([x[1] for x in v], pa.int32()), "mismatches": pa.array([x[2] for x in v], pa.int32())}
    )


def _scan(batches: Iterator[pa.RecordBatch], items: list, seeds: tuple) -> Iterator[pa.RecordBatch]:
    h, part, at = seeds
    for b in batches:
        ids, col = b.column(0).to_pylist(), b.column(1)
        offsets, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
        lo, hi = offsets[0], offsets[-1]
        flat, offsets = flat[lo:hi], offsets - lo
        found: dict = {}
        tried: set = set()
        for m in range(len(MASKS)):
            f = _mix(flat, m)
            left = np.searchsorted(h, f, "left")
            hit = np.flatnonzero((left < len(h)) & (h[np.minimum(left, len(h) - 1)] == f)) if len(h) else np.zeros(0, int)
            owner = np.searchsorted(offsets, hit, "right") - 1
            inside = hit + len(MASKS[m]) <= offsets[owner + 1]
            for pos, d in zip(hit[inside].tolist(), owner[inside].tolist(), strict=True):
                k = int(left[pos])
                while k < len(h) and h[k] == f[pos]:
                    p, shift = int(part[k]), int(pos - offsets[d] - at[k])
                    k += 1
                    if (d, p, shift) not in tried:
                        tried.add((d, p, shift))
                        item, name, t = items[p]
                        got, key = _verify(flat[offsets[d] : offsets[d + 1]], t, shift), (ids[d], item, name)
                        found[key] = max(found.get(key, (0, 0, 0)), got)
        if found:
            yield _rows(found)


def _doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, at) of every seed of every text, for a whole batch of texts at once."""
    for b in batches:
        col = b.column(1)
        offsets, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
        flat, offsets = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for m in range(len(MASKS)):
            f = _mix(flat, m)
            owner = np.searchsorted(offsets, np.arange(len(f)), "right") - 1
            ok = np.arange(len(f)) + len(MASKS[m]) <= offsets[owner + 1]
            owner = owner[ok]
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids[owner].astype(np.int64)), "h": pa.array(f[ok].view(np.int64)), "at": pa.array((np.flatnonzero(ok) - offsets[owner]).astype(np.int32))})


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [dict(zip(b.schema.names, x, strict=True)) for x in zip(*[c.to_pylist() if c.type in (pa.int64(), pa.int32(), pa.string()) else [v.values.to_numpy(zero_copy_only=False) for v in c] for c in b.columns], strict=True)]
        for r in rows:
            yield _rows({(r["doc_id"], r["item_id"], r["part"]): _verify(r["words"], r["item_words"], r["shift"])})


def overlaps(docs: DataFrame, items: DataFrame, parts: tuple[str, ...] = ("passage", "question"), max_broadcast: int = MAX_BROADCAST, hot: int = HOT_SEED) -> DataFrame:
    """(doc_id, item_id, part, run, stretch, mismatches) of each document and test text with a common seed.

    run: the most consecutive words in common; stretch: the longest overlap that tolerates single substituted words
    between two equal ones, with its mismatches. Null or blank texts have no words and no rows; rows with a null id are left
    out; columns beside doc_id, text, item_id and parts are ignored. A test set of at most max_broadcast fingerprints goes to every
    executor; a larger one is joined by a shuffle on fingerprints, where a fingerprint of more than hot occurrences is split.
    """
    spark = docs.sparkSession
    d = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), words(F.col("text")).alias("words"))
    t = None
    for p in parts:
        x = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.lit(p).alias("part"), words(F.col(p)).alias("item_words"))
        t = x if t is None else t.unionByName(x)
    size = (t.agg(F.sum(F.size("item_words"))).first()[0] or 0) * len(MASKS)
    if size <= max_broadcast:
        held = [(r["item_id"], r["part"], np.array(r["item_words"], np.int64)) for r in t.distinct().collect()]
        shared = spark.sparkContext.broadcast((held, _seeds(held)))
        return d.filter(F.size("words") >= MIN_WORDS).mapInArrow(lambda b: _scan(b, *shared.value), OUT).distinct()
    t = t.distinct().withColumn("id", F.xxhash64("item_id", "part"))
    mine = t.select("id", F.col("item_words").alias("w")).mapInArrow(_doc_seeds, "id bigint, h bigint, at int").withColumnsRenamed({"id": "item_part", "at": "item_at"})
    theirs = d.mapInArrow(_doc_seeds, "id bigint, h bigint, at int")
    x, y = meeting(theirs, mine, "h", hot)
    pairs = cut(x.join(y, ["h", "_part"]).select(F.col("id").alias("doc_id"), F.col("item_part").alias("id"), (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    # only documents with hits go on
    hits = pairs.select("doc_id").distinct()
    mostly = hits.count() > FEW_IDS
    asked = d.join(hits if mostly else F.broadcast(hits), "doc_id", "left_semi")
    full = pairs.join(t, "id").join(asked, "doc_id").select("doc_id", "item_id", "part", "shift", "words", "item_words")
    return full.mapInArrow(_check, OUT).groupBy("doc_id", "item_id", "part").agg(F.max(F.struct("run", "stretch", "mismatches")).alias("m")).select("doc_id", "item_id", "part", "m.*")


def leaked(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, **kw) -> DataFrame:
    """(doc_id, item_id): the document holds at least min_words consecutive words of the item."""
    return overlaps(docs, items, **kw).filter(F.col("run") >= min_words).select("doc_id", "item_id").distinct()
