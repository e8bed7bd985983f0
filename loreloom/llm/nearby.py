"""Problem 1: records that tell one thing with small edits, by self-joins of binary tries.

A record is the set of its distinct words. Its fingerprint in a tree is a parity sketch: each word flips one of 128 bits, so two sketches differ
in at most as many bits as there are words in only one of the records. Records with a similarity (common words over all words) of at least s have at
most D = (1 - s) / (1 + s) of their words in only one of them; that is the Hamming error budget of the pair.

The sketches stand in a forest of binary tries. The path to a trie is a hash of a few least word hashes, and every tree has hashes and sketches of its own. In each trie,
pairs of nodes are traversed together, level by level, differing bits add up, and a pair of nodes is pruned as soon as it exceeds the
budget of its depth: of D differing words, the number that falls on the first d of 128 bits is binomial, so the budget at depth d is a quantile
of that and D itself at the full depth. A pair at the threshold stays within all budgets of one tree with a chance of at least 1 - ``LOSS``, and there are so many
trees that it is lost in all of them with a chance of at most ``miss``. What is left is verified exactly. ``miss=0`` is the
exact mode: one trie of everything and no budget but D, which loses nothing and prunes less.

A hot trie is split along itself: by as many leading bits as make its parts small. A record goes to the node pairs of its own prefix with
each prefix within the budget of that depth, and to no others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.components import components
from loreloom.operators.skew import lookup
from loreloom.session import cut, spread

BITS = 128
ROWS = 3
MISS = 1e-4
#: Chance that a pair at the threshold exceeds the budget of some depth in one tree.
LOSS = 0.1
#: Depths at which budgets are set.
DEPTHS = (8, 12, 16, 24, 32, 48, 64, 96)
#: Pairs with a budget over this have none but the full one: their sketches are too full to tell them apart.
MOST_BUDGET = 256
#: Tries with more records than this are worked on as pairs of parts.
PART = 4096
#: Node pairs with at most this many record pairs are compared at once.
LEAF = 32
#: Up to this many records with candidates, their ids (8 bytes each) are broadcast to keep the others out of the check's shuffle.
FEW_IDS = 1_000_000
#: Classes of more copies than this are expanded into pairs by several tasks.
BLOCK = 1000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(*texts: Column) -> Column:
    """Sorted distinct 64-bit hashes of the words (runs of letters and digits, letter case ignored) of all texts."""
    text = F.lower(F.concat_ws(" ", *texts))
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.xxhash64(w))))


def trees(threshold: float, rows: int = ROWS, miss: float = MISS, loss: float = LOSS) -> int:
    """How many trees a pair at the threshold needs to meet within the budgets of one with a chance of 1 - miss."""
    return 1 if threshold >= 1 or miss <= 0 else math.ceil(math.log(miss) / math.log(1 - threshold**rows * (1 - loss)))


def budgets(loss: float) -> np.ndarray:
    """[D, depth]: the most differing bits on the first bits of two sketches of records with D words in only one of them. With loss 0, D everywhere."""
    out = np.empty((MOST_BUDGET + 1, BITS + 1), np.int64)
    out[:] = np.arange(MOST_BUDGET + 1)[:, None]
    out[MOST_BUDGET] = BITS
    if loss > 0:
        for d in range(1, MOST_BUDGET):
            k = np.arange(d + 1)
            logs = np.cumsum(np.concatenate([[0.0], np.log(d - k[1:] + 1) - np.log(k[1:])]))
            last = 0
            for depth in DEPTHS:
                p = depth / BITS
                tail = np.cumsum(np.exp(logs + k * math.log(p) + (d - k) * math.log(1 - p)))
                most = int(np.searchsorted(tail, 1 - loss / len(DEPTHS)))
                out[d, last + 1 : depth + 1] = np.minimum(most, out[d, last + 1 : depth + 1])
                last = depth
    return out


def _plant(batches: Iterator[pa.RecordBatch], n_trees: int, rows: int, paths_only: bool = False) -> Iterator[pa.RecordBatch]:
    """One row per record and tree: the trie it is in, its id, its sketch and its number of words; or only the trie."""
    rng = np.random.default_rng(20240229)
    mult = rng.integers(1, 1 << 63, n_trees * (rows + 1), dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, n_trees * (rows + 1), dtype=np.uint64)
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            c = b.slice(at, 1000)
            col = c.column(1)
            offsets = col.offsets.to_numpy()
            flat = col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64).view(np.uint64)
            starts = (offsets - offsets[0])[:-1]
            n = np.diff(offsets)
            if not len(flat):
                continue
            keys, sketch = np.empty((len(n), n_trees), np.uint64), np.empty((len(n), n_trees, 2), np.uint64)
            owner = np.repeat(np.arange(len(n)) * BITS, n)
            for t in range(n_trees):
                k = np.full(len(n), t + 1, np.uint64)
                for r in range(rows):
                    h = flat * mult[t * (rows + 1) + r] + add[t * (rows + 1) + r]
                    h ^= h >> np.uint64(32)
                    k = (k ^ np.minimum.reduceat(h, starts)) * _MIX
                    k ^= k >> np.uint64(31)
                keys[:, t] = k
                if paths_only:
                    continue
                bit = ((flat + add[t * (rows + 1) + rows]) * mult[t * (rows + 1) + rows] >> np.uint64(57)).astype(np.int64)
                flips = np.bincount(owner + bit, minlength=len(n) * BITS).reshape(len(n), BITS) & 1
                sketch[:, t] = np.packbits(flips.astype(np.uint8), axis=1).view(">u8")
            if paths_only:
                yield pa.RecordBatch.from_pydict({"trie": pa.array(keys.reshape(-1).view(np.int64))})
                continue
            ids = c.column(0).to_numpy(zero_copy_only=False)
            s = sketch.reshape(-1, 2)
            yield pa.RecordBatch.from_pydict(
                {"trie": pa.array(keys.reshape(-1).view(np.int64)), "id": pa.array(np.repeat(ids, n_trees)), "s0": pa.array(s[:, 0].copy().view(np.int64)), "s1": pa.array(s[:, 1].copy().view(np.int64)), "n": pa.array(np.repeat(n, n_trees).astype(np.int32))}
            )


def trie_join(s: np.ndarray, n: np.ndarray, first: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], share: float, caps: np.ndarray, told: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of positions, i < j, under the first node pairs, whose sketches stay within the budgets.

    s: sketches, one row of two words each, sorted within each trie. n: numbers of words. first: the node pairs to begin with, as ranges of positions [a0, a1) and [b0, b1), equal or apart. All
    node pairs of a level are worked on at once. told, if given, gets the numbers of node pairs visited and pruned, and of record pairs under
    pruned nodes, pruned on the way down two single paths, and compared to the last bit.
    """
    seen = told if told is not None else {}
    for k in ("visited", "nodes_pruned", "pairs_under_pruned_nodes", "pairs_pruned_on_paths", "pairs_compared"):
        seen.setdefault(k, 0)
    a0, a1, b0, b1 = (x.astype(np.int64) for x in first)
    err = np.zeros(len(a0), np.int64)

    # budgets by depth and by the words of both records together
    words = np.minimum(np.floor(share * np.arange(2 * int(n.max(initial=0)) + 1) + 1e-9).astype(np.int64), MOST_BUDGET)
    of: dict[int, np.ndarray] = {}

    def limit(most: np.ndarray, depth: int) -> np.ndarray:
        if depth not in of:
            of[depth] = caps[words, depth].astype(np.int16)
        return of[depth][most]

    # largest values of n over runs of 1, 2, 4, ... positions
    table = [n.astype(np.int32)]
    longest = int(max((a1 - a0).max(), (b1 - b0).max())) if len(a0) else 0
    while 2 << len(table) - 1 <= longest:
        half = 1 << len(table) - 1
        table.append(np.maximum(table[-1][:-half], table[-1][half:]))

    def most_of(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = (np.frexp(hi - lo)[1] - 1).astype(np.int64)
        out = np.zeros(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.maximum(table[k][lo[at]], table[k][hi[at] - (1 << int(k))])
        return out

    def pairs_of(a0, a1, b0, b1) -> int:
        same = (a0 == b0) & (a1 == b1)
        return int(np.where(same, (a1 - a0) * (a1 - a0 - 1) // 2, (a1 - a0) * (b1 - b0)).sum())

    def split(word: np.ndarray, bit: np.uint64, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first position of each range with the bit set; set bits come last in a range."""
        lo, hi = lo.copy(), hi.copy()
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            on = (word[np.minimum(mid, len(word) - 1)] >> bit & np.uint64(1)).astype(bool)
            open_ = lo < hi
            hi = np.where(open_ & on, mid, hi)
            lo = np.where(open_ & ~on, mid + 1, lo)
        return lo

    out_i, out_j = [], []

    def leaves(a0, a1, b0, b1) -> None:
        """Follow all pairs of single paths under small node pairs, dropping each at the first budget it exceeds."""
        nb = b1 - b0
        size = (a1 - a0) * nb
        step = np.cumsum(size)
        cutting = np.searchsorted(step, np.arange(0, (step[-1] if len(step) else 0) + 1, 4_000_000), "left")
        edges = np.unique(np.append(cutting, len(size)))
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            sz = size[x:y]
            which = np.repeat(np.arange(x, y), sz)
            at = np.arange(sz.sum()) - np.repeat(np.cumsum(sz) - sz, sz)
            i, j = a0[which] + at // nb[which], b0[which] + at % nb[which]
            ok = i < j
            i, j = i[ok], j[ok]
            most = n[i] + n[j]
            d = s[i, 0] ^ s[j, 0]
            for depth in (32, 64):
                ok = np.bitwise_count(d >> np.uint64(64 - depth)) <= limit(most, depth)
                seen["pairs_pruned_on_paths"] += int((~ok).sum())
                i, j, most, d = i[ok], j[ok], most[ok], d[ok]
            seen["pairs_compared"] += len(i)
            ok = np.bitwise_count(d).astype(np.int64) + np.bitwise_count(s[i, 1] ^ s[j, 1]) <= limit(most, BITS)
            out_i.append(i[ok])
            out_j.append(j[ok])

    for depth in range(BITS + 1):
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (depth == BITS)
        if small.any():
            leaves(a0[small], a1[small], b0[small], b1[small])
            big = ~small
            a0, a1, b0, b1, err = a0[big], a1[big], b0[big], b1[big], err[big]
        if not len(a0):
            break
        seen["visited"] += len(a0)
        word, bit = s[:, depth // 64], np.uint64(63 - depth % 64)
        if 40 * len(a0) > len(s):
            ones = np.concatenate([[0], np.cumsum(word >> bit & np.uint64(1))]).astype(np.int64)
            am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        else:  # few nodes are left: look for the first set bit of each
            am, bm = split(word, bit, a0, a1), split(word, bit, b0, b1)
        same = (a0 == b0) & (a1 == b1)
        new = []
        for p0, p1, q0, q1, e, skip in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, same)):
            ok = (p1 > p0) & (q1 > q0)
            if skip is not None:
                ok &= ~skip
            # a node pair of one record with itself holds no pair
            ok &= ~((p0 == q0) & (p1 == q1) & (p1 - p0 == 1))
            new.append((p0[ok], p1[ok], q0[ok], q1[ok], err[ok] + e))
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*new, strict=True))
        if len(a0) and (depth + 1) % 4 == 0:
            ok = err <= limit(most_of(a0, a1) + most_of(b0, b1), depth + 1)
            seen["nodes_pruned"] += int((~ok).sum())
            if told is not None:
                seen["pairs_under_pruned_nodes"] += pairs_of(a0[~ok], a1[~ok], b0[~ok], b1[~ok])
            a0, a1, b0, b1, err = a0[ok], a1[ok], b0[ok], b1[ok], err[ok]
    empty = np.zeros(0, np.int64)
    return np.concatenate([*out_i, empty]), np.concatenate([*out_j, empty])


def _walk(batches: Iterator[pa.RecordBatch], share: float, loss: float) -> Iterator[pa.RecordBatch]:
    """Joins the node pairs of one partition, whose rows come sorted by node pair (trie). code: 4 times the number of words, plus 2 in a pair of different nodes, plus 1 in its second node."""
    caps = budgets(loss)

    def join(t: pa.Table) -> Iterator[pa.RecordBatch]:
        trie = t.column("trie").to_numpy()
        edge = np.append(np.flatnonzero(np.diff(trie)) + 1, len(trie))
        size = np.diff(edge, prepend=0)
        # a node pair of one row holds no pair
        keep = np.flatnonzero(np.repeat(size > 1, size))
        if not len(keep):
            return
        ids, s0, s1, code = (t.column(c).to_numpy()[keep] for c in ("id", "s0", "s1", "code"))
        size = size[size > 1]
        order = np.lexsort((s1.view(np.uint64), s0.view(np.uint64), code & 1, np.repeat(np.arange(len(size)), size)))
        ids, code, s = ids[order], code[order], np.stack([s0.view(np.uint64), s1.view(np.uint64)], 1)[order]
        hi = np.cumsum(size)
        lo = hi - size
        mid = hi - np.add.reduceat((code & 1).astype(np.int64), lo)
        one = code[lo] & 2 == 0
        ok = one | (mid > lo) & (mid < hi)
        i, j = trie_join(s, (code >> 2).astype(np.int64), (lo[ok], np.where(one, hi, mid)[ok], np.where(one, lo, mid)[ok], hi[ok]), share, caps)
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        if len(a):
            u = np.unique(np.stack([a, b], 1), axis=0)
            yield pa.RecordBatch.from_pydict({"a": pa.array(u[:, 0]), "b": pa.array(u[:, 1])})

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= 300_000:
            t = pa.Table.from_batches(held).combine_chunks()
            edge = np.flatnonzero(np.diff(t.column("trie").to_numpy()))
            if len(edge):
                end = int(edge[-1]) + 1
                yield from join(t.slice(0, end))
                held, rows = t.slice(end).to_batches(), t.num_rows - end
    if rows:
        yield from join(pa.Table.from_batches(held).combine_chunks())


def _may_be_hot(reps: DataFrame, n_trees: int, rows: int, part: int) -> DataFrame | None:
    """(trie) of all tries of more than part records, and some smaller ones; None where there are too many partitions to tell: a trie of more than part records has more than its share of them in one partition."""
    least = part // max(1, reps.rdd.getNumPartitions())
    if least < 8:
        return None

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [b.column(0).to_numpy() for b in _plant(batches, n_trees, rows, paths_only=True)]
        if tries:
            t, n = np.unique(np.concatenate(tries), return_counts=True)
            yield pa.RecordBatch.from_pydict({"trie": pa.array(t[n > least])})

    return cut(reps.mapInArrow(large, "trie bigint").distinct())


def _node_pairs(reps: DataFrame, n_trees: int, rows: int, part: int, share: float, loss: float) -> DataFrame:
    """(trie, id, s0, s1, code) of every record in each of its node pairs, see ``_walk``. A trie of more than part records is cut at a depth that makes its nodes small; its node pairs within the budget of that depth are worked on apart.

    Where one node still holds more, because its records are alike, the trie's nodes are cut once more by a hash of the id, so that no task holds more than two pieces of about part records.
    """
    planted = reps.mapInArrow(lambda b: _plant(b, n_trees, rows), "trie bigint, id bigint, s0 bigint, s1 bigint, n int")
    whole = lambda df: df.select("trie", "id", "s0", "s1", (F.col("n") * 4).alias("code"))
    some = _may_be_hot(reps, n_trees, rows, part)
    number = None if some is None else some.count()
    if number == 0:
        return whole(planted)
    planted = cut(planted)
    counted = planted if some is None else planted.join(F.broadcast(some) if number <= 100_000 else some, "trie", "left_semi")
    sizes = cut(counted.groupBy("trie").agg(F.count("*").alias("size"), F.max("n").alias("most")).filter(F.col("size") > part))

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caps = budgets(loss)
        for pdf in batches:
            depth = np.minimum(np.ceil(np.log2(pdf["size"] / part)).astype(int), 12)
            d = np.minimum(np.floor(2 * share * pdf["most"] + 1e-9).astype(int), MOST_BUDGET)
            yield pd.DataFrame({"trie": pdf["trie"], "depth": depth.astype("int32"), "most": caps[d, depth].astype("int32")})

    hot = sizes.mapInPandas(plan, "trie bigint, depth int, most int")
    prefix = F.expr("CASE WHEN depth > 0 THEN CAST(shiftrightunsigned(s0, 64 - depth) AS INT) ELSE 0 END")
    few = sizes.count() <= 10_000
    near = F.broadcast if few else (lambda x: x)
    filled = planted.join(near(hot), "trie").groupBy("trie", "depth", "most", prefix.alias("prefix")).agg(F.count("*").alias("size"))
    hot = cut(filled.groupBy("trie", "depth", "most").agg(F.ceil(F.max("size") / part).cast("int").alias("pieces")))
    masks = F.expr("filter(sequence(0, shiftleft(1, depth) - 1), m -> bit_count(m) <= most)")
    placed = planted.join(near(hot), "trie").withColumn("own", prefix).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    met = placed.withColumn("mask", F.explode(masks)).withColumn("there", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    mine, other = F.col("own") * F.col("pieces") + F.col("piece"), F.col("own").bitwiseXOR(F.col("mask")) * F.col("pieces") + F.col("there")
    apart = (mine != other).cast("int")
    split = met.select(F.xxhash64("trie", F.least(mine, other), F.greatest(mine, other)).alias("trie"), "id", "s0", "s1", (F.col("n") * 4 + 2 * apart + apart * (mine > other).cast("int")).alias("code"))
    return whole(planted.join(near(hot.select("trie")), "trie", "left_anti")).unionByName(split)


def event_words(events: DataFrame, key: str = "event_key", texts: tuple[str, ...] = ("summary", "explanation")) -> DataFrame:
    """(key, at, words, h) of every delivery; null keys are left out, null texts count as empty. h: 128 bits of hash of the set of words."""
    rows = events.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col("loaded_at").alias("at"), words_of(*texts).alias("words"))
    # words are taken out of the texts once; what follows reads them three times
    return cut(rows.withColumn("h", F.struct(F.xxhash64("words").alias("x"), F.xxhash64(F.lit(7), "words").alias("y"))))


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(key, rep, copies) of every record key with words; (rep, copies, words) of every distinct set of words; the number of keys. Of a key delivered again the first delivery counts."""
    # only hashes are shuffled by key; the words go once, by hash
    first = cut(rows.groupBy("key").agg(F.min(F.struct("at", "h", F.size("words").alias("n"))).alias("r")).select("key", "r.h", "r.n"))
    total = first.count()
    some = first.filter("n > 0")
    sets = some.groupBy("h").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    words = rows.filter(F.size("words") > 0).groupBy("h").agg(F.any_value("words").alias("words"))
    reps = cut(sets.join(words, "h").select("h", "rep", "copies", "words"))
    return cut(lookup(some.select("key", "h"), reps.select("h", "rep", "copies"), "h", "copies", total).select("key", "rep", "copies")), reps.select("rep", "copies", "words"), total


def links(rows: DataFrame, threshold: float = 0.8, n_rows: int = ROWS, miss: float = MISS, part: int = PART) -> tuple[DataFrame, DataFrame, int]:
    """The membership and the number of keys as of ``classes``, and the links (a, b, similarity, copies_a, copies_b) between representatives of distinct word sets with at least the threshold.

    A pair right at the threshold is lost with a chance of at most miss, a closer one with a smaller one; with miss 0, none is.
    """
    members, reps, total = classes(rows)
    loss = LOSS if 0 < miss and threshold < 1 else 0.0
    share = (1 - threshold) / (1 + threshold)
    n_trees, n_rows = trees(threshold, n_rows, miss), n_rows if miss > 0 else 0
    ready = _node_pairs(spread(reps.select("rep", "words")), n_trees, n_rows, part, share, loss)
    sorted_ = ready.repartition("trie").sortWithinPartitions("trie")
    near = cut(sorted_.mapInArrow(lambda b: _walk(b, share, loss), "a bigint, b bigint").distinct())
    ids = near.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    met = ids.count()
    asked = reps.join(F.broadcast(ids), "rep", "left_semi") if met <= FEW_IDS else reps
    pairs = near
    for c in ("a", "b"):  # a record with very many candidates is looked up where these lie
        sizes = near.groupBy(F.col(c).alias("rep")).agg(F.count("*").alias("size"))
        of = asked.join(sizes, "rep").select(F.col("rep").alias(c), "size", F.col("words").alias(f"w{c}"), F.col("copies").alias(f"copies_{c}"))
        pairs = lookup(pairs, of, c, "size", met).drop("size")
    both = F.size(F.array_intersect("wa", "wb"))
    alike = both / (F.size("wa") + F.size("wb") - both)
    return members, cut(pairs.select("a", "b", alike.alias("similarity"), "copies_a", "copies_b").filter(F.col("similarity") >= threshold - 1e-9)), total


def groups(events: DataFrame, threshold: float = 0.8, key: str = "event_key", **kw) -> DataFrame:
    """(event_key, group_key, links, copies): each record with the least key of its group, its number of similar word sets and of exact copies.

    Records without words stand for themselves. Copies are not expanded into pairs. Of a key delivered again the first delivery counts; null keys are left out.
    """
    rows = event_words(events, key)
    members, linked, total = links(rows, threshold, **kw)
    comp = components(linked.select("a", "b")).select(F.col("id").alias("rep"), "component")
    n = linked.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("size"))
    table = sizes.join(comp, "rep", "left").join(n, "rep", "left").select("rep", "size", F.coalesce("component", "rep").alias("group_key"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    full = lookup(members.select("key", "rep"), table, "rep", "size", total).select("key", "group_key", "links", F.col("size").alias("copies"))
    blank = rows.groupBy("key").agg(F.min(F.struct("at", "h", F.size("words").alias("n")))["n"].alias("n")).filter("n = 0")
    return full.unionByName(blank.select("key", F.col("key").alias("group_key"), F.lit(0).cast("bigint").alias("links"), F.lit(1).cast("bigint").alias("copies"))).withColumnRenamed("key", key)


def _blocks(copies: str) -> Column:
    return F.greatest(F.ceil(F.col(copies) / BLOCK), F.lit(1)).cast("int")


def found(events: DataFrame, threshold: float = 0.6, key: str = "event_key", **kw) -> DataFrame:
    """(key_a, key_b): every pair of records, smaller key first, with a similarity of at least the threshold.

    This result has exact copies expanded into pairs, as its definition asks; ``groups`` has not. A class of many copies is expanded by blocks of its members, one task each.
    Of a key delivered again the first delivery counts; null keys and records without words have no rows; an empty table gives none.
    """
    members, linked, _ = links(event_words(events, key), threshold, **kw)
    blocks = members.withColumn("blocks", _blocks("copies"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    several = blocks.filter("copies > 1")
    x = several.select("rep", F.col("key").alias("x"), block.alias("block"))
    y = several.select("rep", F.col("key").alias("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    copies = x.join(y, ["rep", "block"]).filter("x < y").select("x", "y")
    across = linked.select("a", "b", "copies_a", "copies_b")
    for c, name in (("a", "x"), ("b", "y")):
        of = blocks.select(F.col("rep").alias(c), block.alias("block"), F.col("key").alias(name))
        across = across.withColumn("block", F.explode(F.sequence(F.lit(0), _blocks(f"copies_{c}") - 1))).join(of, [c, "block"]).drop("block")
    return copies.unionByName(across.select("x", "y")).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
