"""Problem 5: cutting oversized texts at natural boundaries by content-defined chunking.

A rolling hash over the last few words marks landmarks that depend on nothing but those words. Each cut starts from
the first landmark between the smallest and the largest piece and snaps to the nearest boundary of the best kind about it: a blank line, then
the end of a sentence, then a line break or clause, then any white space. An edit therefore moves only the cuts near it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space as Python's str.isspace has it.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_WORD = re.compile(r"\S+")
_HASH_WORDS = 4
_LANDMARK = 16
_CLOSE = "\"'”’»)]}」』›“"
_ENDS = ".!?…。！？।؟"
_CLAUSES = ",;:—–、，；："
OUT = "key bigint, piece int, first_word int, words int, overlap int, text string"


def n_words(c: Column) -> Column:
    """Number of runs of characters other than white space; null has none."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), WS + "+"), lambda w: w != ""))


def _strength(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each word, how natural a cut before it is: 3 blank line, 2 sentence end or list item, 1 line break or clause, 0 other."""
    out = np.zeros(len(spans), np.int8)
    for k in range(1, len(spans)):
        gap = text[spans[k - 1][1] : spans[k][0]]
        last = text[spans[k - 1][0] : spans[k - 1][1]].rstrip(_CLOSE)[-1:]
        if gap.count("\n") > 1 or " " in gap:
            out[k] = 3
        elif last and last in _ENDS and not text[spans[k][0]].islower():
            out[k] = 2
        elif "\n" in gap or last and last in _CLAUSES:
            out[k] = 1
    return out


def _landmarks(words: list[str]) -> np.ndarray:
    """Positions before which a cut may start: the rolling hash of the last words, letter case ignored, is a multiple of _LANDMARK."""
    import zlib

    h = np.array([zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    roll = np.zeros(len(h), np.uint64)
    for k in range(_HASH_WORDS):
        roll[_HASH_WORDS - 1 :] = roll[_HASH_WORDS - 1 :] * np.uint64(1_000_003) + h[k : len(h) - _HASH_WORDS + 1 + k]
    roll = (roll ^ (roll >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return np.flatnonzero(roll % np.uint64(_LANDMARK) == 0) + 1


def _snap(strength: np.ndarray, at: int, lo: int, hi: int) -> int:
    """The nearest position to at, within [lo, hi], of the strongest kind that a boundary there has; blank lines and sentence ends first."""
    s = strength[lo : hi + 1]
    for kind in (3, 2, 1):
        near = np.flatnonzero(s >= kind) if kind < 3 else np.flatnonzero(s == 3)
        if kind == 3:
            near = near[np.abs(near + lo - at) <= (hi - lo) // 4]
        if len(near):
            return int(near[np.argmin(np.abs(near + lo - at))] + lo)
    return at


def cut_points(text: str, most: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(first word, end word, first character, end character) of each piece; a text within the limit is one piece."""
    spans = [m.span() for m in _WORD.finditer(text)]
    n = len(spans)
    if n <= most:
        return [(0, n, 0, len(text))]
    slack = min(overlap // 4, max(0, most - overlap - 1))
    body = max(1, most - overlap - slack)
    least = max(1, body // 2)
    strength, marks = _strength(text, spans), _landmarks([text[a:b] for a, b in spans])
    cuts, at = [0], 0
    while n - at > (most if at == 0 else body):
        lo, hi = at + least, min(at + body, n - min(least // 2, n - at - 1))
        lo = min(lo, hi)
        k = np.searchsorted(marks, lo)
        mark = int(marks[k]) if k < len(marks) and marks[k] <= hi else (lo + hi) // 2
        at = _snap(strength, mark, lo, hi)
        cuts.append(at)
    out = []
    for k, a in enumerate(cuts):
        end = cuts[k + 1] if k + 1 < len(cuts) else n
        first = a
        if k and overlap:
            want = max(0, a - overlap)
            lo, hi = max(0, want - slack), min(a - 1, want + slack)
            good = np.flatnonzero(strength[lo : hi + 1] >= 2) + lo
            first = int(good[np.argmin(np.abs(good - want))]) if len(good) else want
        out.append((first, end, spans[first][0] if first else 0, spans[end - 1][1] if end < n else len(text)))
    return out


def _cut(batches: Iterator[pd.DataFrame], most: int, overlap: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, text in zip(pdf["key"], pdf["text"], strict=True):
            end = 0
            for k, (a, b, x, y) in enumerate(cut_points(text, most, overlap)):
                rows.append((key, k, a, b - a, max(0, end - a), text[x:y]))
                end = b
        yield pd.DataFrame(rows, columns=["key", "piece", "first_word", "words", "overlap", "text"])


def oversized(chunks: DataFrame, most: int, key: str = "chunk_key") -> DataFrame:
    """One row per record key whose text is over the limit, in as few columns as the cut needs; of a key delivered again, the first delivery."""
    over = chunks.filter(F.col(key).isNotNull() & (n_words(F.col("text")) > most))
    row = F.struct(F.col("loaded_at").alias("t"), F.col("text").alias("text"), F.col("chapter").alias("chapter"), F.col("page_start").alias("page_start"), F.col("page_end").alias("page_end"))
    return over.groupBy(F.col(key).alias("key")).agg(F.min(row).alias("r")).select("key", "r.text", "r.chapter", "r.page_start", "r.page_end")


def split(chunks: DataFrame, most: int, overlap: int, key: str = "chunk_key") -> DataFrame:
    """(chunk_key, piece, first_word, words, overlap, text, chapter, page_start, page_end) of every chunk of more than most words.

    Every piece has at most most words; each after the first repeats about overlap words of the one before (a sentence start within a quarter of
    that, else exactly as many). Null and blank texts have no words and no pieces; a null chapter or page stays null; a null key is left out.
    """
    if not 0 <= overlap < most:
        raise ValueError("overlap must be less than the limit")
    src = oversized(chunks, most, key)
    pieces = src.select("key", "text", "chapter", "page_start", "page_end")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = pdf.drop(columns="text").astype({"page_start": "Int32", "page_end": "Int32"})
            for got in _cut(iter([pdf]), most, overlap):
                yield got.merge(keep, on="key")

    return pieces.mapInPandas(run, OUT + ", chapter string, page_start int, page_end int").withColumnRenamed("key", key)


def found(chunks: DataFrame, most: int, overlap: int, key: str = "chunk_key") -> DataFrame:
    """(chunk_key): the chunks that were cut."""
    return split(chunks, most, overlap, key).filter(F.col("piece") == 1).select(key)
