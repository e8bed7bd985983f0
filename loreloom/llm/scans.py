"""Problem 6: repairing text extracted from scanned pages.

Line-pair classifiers (logistic regression) decide which lines are running furniture and which line ends join the next word. Corrections of
misread words come from an inverted join on positional character q-grams between rare and common words, ranked by gradient boosting.

Corpus statistics cover all chunks. Common words, which every executor holds, are those with a share of at least ``COMMON_SHARE`` of all words, so there
can be at most 1 / COMMON_SHARE of them. That share bounds memory only: what line ends need to know of other words is looked up by a join, and a correction
may be any word with at least ``LEAST`` occurrences. All models are trained on made examples of common words: at most ``TRAIN_WORDS`` of them.
"""

from __future__ import annotations

import math
import random
import re
from collections import ChainMap
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreloom.llm.learners import Boosted, Logistic
from loreloom.session import by_key, cut, spread

COMMON_SHARE = 2e-6
#: A word with fewer occurrences counts as none, however large the corpus.
LEAST = 4
TRAIN_WORDS = 1500
#: A correction must be this many times as frequent as the word it replaces.
RATIO = 6
#: Two parts without a hyphen may be one word if it is this many times as frequent as they would meet by chance.
APART = 1000
Q = 3
#: Less than what any change that is no known confusion costs.
MOST_COST = 0.95
#: Characters and what scanning makes of them.
CONFUSIONS = (("e", "c"), ("a", "ä"), ("d", "cl"), ("o", "0"), ("l", "1"), ("n", "ri"), ("s", "5"), ("i", "!"), ("h", "b"), ("u", "ii"), ("g", "9"), ("b", "6"), ("w", "vv"), ("m", "rn"), ("v", "y"), ("li", "h"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("i", "1"), ("l", "i"), ("b", "8"), ("e", "f"), ("z", "2"), ("t", "+"), ("i", "l"), ("o", "c"), ("c", "e"), ("in", "m"), ("nn", "rm"), ("cl", "d"), ("q", "9"), ("o", "ö"), ("u", "ü"), ("l", "|"), ("i", "|"), ("s", "$"), ("y", "v"), ("t", "f"), ("n", "u"), ("u", "n"))
HYPHENS = "-‐‑–¬­="
_EDGE = ".,;:!?\"“”‘’()[]{}—–…*•·«»_"
_NUMBER = re.compile(r"^[\W_]*(?:page|p\.|pg\.|seite|s\.)?\s*(\d{1,5})[\W_]*$", re.I)
_SIDE = re.compile(r"^[\W_]*(\d{1,5})(?=\s{2,}|\s*[—–|·-])|(?:\s{2,}|[—–|·-]\s*)(\d{1,5})[\W_]*$")
_AT_SIDE = re.compile(r"^[\W_]*\d{1,5}(?=\s{2,}|\s*[—–|·-])|(?:\s{2,}|[—–|·-]\s*)\d{1,5}[\W_]*$")
_DIGIT = re.compile(r"\d")
#: A line less like every title than this is no running head.
LIKE = 0.74
_CHAPTER = re.compile(r"^\s*(?:chapter\s+(?:[ivxlcdm]+|\d+)\.?:?|(?:[ivxlcdm]+|\d+)\.)\s*", re.I)
_LISTED = re.compile(r"^\s*(?:[*•—–-]|\d{1,3}[.)])\s")
_WORD = re.compile(r"\S+")
_PARAGRAPH = re.compile(r"[^\S\n]*\n\s*\n\s*")
#: What a correction looks like.
CLEAN = r"^[\p{L}'’-]{3,}$"
#: Words with fewer characters are too like each other to tell a misreading from a word.
SHORTEST = 3
BREAK = "struct<k:int,a:string,b:string,hyphen:boolean,space:boolean>"
STRIPPED = f"chunk_key bigint, noise array<string>, body string, breaks array<{BREAK}>, asked array<string>"
PARSED = "chunk_key bigint, noise array<string>, rare array<string>, clean string"


def fold(s: str) -> str:
    """Letters and digits, with what scanning confuses made equal."""
    s = re.sub(r"[\s\W_]+", "", s.lower())
    for a, b in (("rn", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("ri", "n"), ("li", "h"), ("ﬁ", "fi")):
        s = s.replace(a, b)
    return s.translate(str.maketrans("015!968cfhyä", "olsigbbeebva"))


_folded = lru_cache(maxsize=50_000)(fold)


def similar(a: str, b: str) -> float:
    """1 less the edit distance over the longer length, 0 when the lengths differ much; texts of up to three characters are alike only if equal. The distance is counted by columns of bits."""
    n = max(len(a), len(b))
    if not n or abs(len(a) - len(b)) > 0.3 * n:
        return 0.0
    if a == b:
        return 1.0
    if min(len(a), len(b)) < 4:
        return 0.0
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    last, full = 1 << len(a) - 1, (1 << len(a)) - 1
    up, down, distance = full, 0, len(a)
    for c in b:
        x = at.get(c, 0)
        d = ((x & up) + up ^ up | x | down) & full
        plus, minus = down | ~(d | up) & full, d & up
        distance += (plus & last != 0) - (minus & last != 0)
        plus = (plus << 1 | 1) & full
        up, down = minus << 1 & full | ~(d | plus) & full, plus & d
    return 1 - distance / n


def bare(token: str) -> str:
    return token.strip(_EDGE).lower()


def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, n): how often each word stands in all texts, letter case and outer punctuation ignored. Tokens are counted as they stand, and stripped once for each different token."""
    tokens = chunks.select(F.explode(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[\s\p{Z}]+")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return tokens.select(F.btrim("t", F.lit(_EDGE)).alias("word"), "n").filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


# --- line pairs -------------------------------------------------------------------------------------------------


def likeness(line: str, names: list[tuple[str, bool]]) -> tuple[float, float, str]:
    """How like a line without the number at its side is to the chunk's own titles and to others, and that line."""
    body = _AT_SIDE.sub("", line) if _DIGIT.search(line) else line
    f = fold(body)
    own = max((similar(f, x) for x, mine in names if mine), default=0.0) if f else 0.0
    other = max((similar(f, x) for x, mine in names if not mine), default=0.0) if f and own < 0.8 else 0.0
    return own, other, body


def furniture_features(line: str, before: str, after: str, names: list[tuple[str, bool]], pages: tuple[int | None, int | None], first: bool, always: bool = False) -> list[float] | None:
    """What tells a running head or page number from text: likeness to the titles, a number that is the page's, what stands about it. None for a line that is neither like a name nor a number, unless always."""
    own, other, body = likeness(line, names)
    lone = _NUMBER.match(line)
    if own < LIKE and other < LIKE and not lone and not always:
        return None
    m = lone or _SIDE.search(line)
    number = int(next(g for g in m.groups() if g)) if m else None
    lo, hi = pages
    near = number is not None and lo is not None and lo <= number <= (hi if hi is not None else lo + 2)
    head = bool(re.match(r"[\W\d_]*[A-ZÀ-Þ]", body))
    between = bool(before.strip()) and bool(after.strip())
    return [own**4, (other**4) * head * between, float(near), float(bool(lone)), float(bool(lone) and near), float(between), float(first), float(bool(_LISTED.match(line))), float(len(line) > 60)]


def train_furniture(names: list[str], seed: int = 7) -> Logistic:
    """Fitted on made pages: titles and numbers, corrupted and set in lines, against lines of text, list items, headings and other numbers."""
    rnd = random.Random(seed)
    names = [n for n in names if n] or ["The Old House", "A Long Way Home", "Chapter One The River"]
    text = ["the lamp stood behind the old mill when", "carried a narrow coat across the yard.", "In the morning they left, and"]
    x, y = [], []

    def add(line: str, before: str, after: str, own: str, page: int, first: bool, label: int, known: bool = True) -> None:
        f = furniture_features(line, before, after, [(fold(own), known), *[(fold(n), False) for n in rnd.sample(names, min(3, len(names)))]], (page, page + rnd.randint(0, 1)), first, always=True)
        x.append(f)
        y.append(label)

    for _ in range(250):
        n, page = rnd.choice(names), rnd.randint(1, 400)
        shown = rnd.choice([n, n.upper(), corrupt(n, rnd), " ".join(n.upper())])
        line = rnd.choice([shown, f"{page}   {shown}", f"{shown}    {page}", f"{shown} —"])
        add(line, rnd.choice(text), rnd.choice(text), n, page, False, 1, rnd.random() < 0.6)
        add(rnd.choice(["{}", "— {} —", "- {} -", "Page {}", "p. {}", "[{}]", "· {} ·"]).format(page), rnd.choice(text), rnd.choice(text), n, page, False, 1)
        add(shown, "", "", n, page, True, 0)
        add(rnd.choice(["{}.", "{})", "{}"]).format(page + rnd.choice([-300, -40, 30, 200])), rnd.choice(text), rnd.choice(text), n, page, False, 0)
        add(rnd.choice(text), rnd.choice(text), rnd.choice([*text, ""]), n, page, rnd.random() < 0.1, 0)
        add(f"* {rnd.choice(names).lower()}", rnd.choice(text), rnd.choice(text), n, page, False, 0)
        add(rnd.choice(names), "", "", n, page, rnd.random() < 0.5, 0)
    return Logistic().fit(np.array(x), np.array(y, float))


def join_features(a: str, b: str, hyphen: bool, space: bool, count: Mapping[str, int]) -> list[float]:
    """What tells a broken word from two words or a compound: how frequent the whole, the compound and the parts are."""
    whole, compound = count.get(a + b, 0), count.get(f"{a}-{b}", 0)
    ca, cb = count.get(a, 0), count.get(b, 0)
    return [math.log1p(whole), math.log1p(compound), math.log1p(min(ca, cb)), float(hyphen), float(space), float(whole > 3 * min(ca, cb)), float(compound > whole), float(hyphen and not compound and min(ca, cb) == 0)]


def train_joins(common: dict[str, int], seed: int = 11) -> Logistic:
    """Fitted on common words broken at random places, against pairs of common words and compounds broken at their own hyphen."""
    rnd = random.Random(seed)
    words = sorted((w for w in common if w.isalpha() and len(w) > 3), key=lambda w: (hash_of(w), w))[:TRAIN_WORDS]
    split = [w for w in common if re.fullmatch(r"[a-zà-ÿ]+-[a-zà-ÿ]+", w)][:TRAIN_WORDS] or ["half-open"]
    words = words or ["lantern", "window", "garden"]
    x, y = [], []
    for w in words:
        k = rnd.randint(1, len(w) - 1)
        hyphen = rnd.random() < 0.7
        x.append(join_features(w[:k], w[k:], hyphen, rnd.random() < 0.2, common))
        y.append(1)
        x.append(join_features(w, rnd.choice(words), False, rnd.random() < 0.5, common))
        y.append(0)
        if hyphen:  # a whole that no other text holds
            x.append(join_features(w[:k] + "q", w[k:], True, False, {}))
            y.append(1)
    for w in [rnd.choice(split) for _ in range(max(50, len(words) // 3))]:
        a, b = w.split("-")
        x.append(join_features(a, b, True, rnd.random() < 0.2, common | {w: max(3, common.get(w, 0))}))
        y.append(0)
    return Logistic().fit(np.array(x), np.array(y, float))


def hash_of(w: str) -> int:
    import zlib

    return zlib.crc32(w.encode("utf-8", "surrogatepass"))


# --- corrections ------------------------------------------------------------------------------------------------


def corrupt(w: str, rnd: random.Random) -> str:
    """One or two confusions somewhere in w."""
    for _ in range(rnd.choice([1, 1, 2])):
        able = [(a, b) for a, b in CONFUSIONS[:18] if a in w]
        if not able:
            return w
        a, b = rnd.choice(able)
        k = rnd.choice([m.start() for m in re.finditer(re.escape(a), w)])
        w = w[:k] + b + w[k + len(a) :]
    return w


_COST: dict[tuple[str, str], float] = {(a, b): 0.1 + 0.01 * k for k, (a, b) in reversed(list(enumerate(CONFUSIONS)))}


def confusion_cost(clean: str, seen: str) -> float:
    """Least cost of reading clean as seen: little for a known confusion, 1 for any other change of a character."""
    n, m = len(clean), len(seen)
    best = [[9.0] * (m + 3) for _ in range(n + 3)]
    best[0][0] = 0.0
    for i in range(n + 1):
        row = best[i]
        for j in range(max(0, i - 4), min(m, i + 4) + 1):  # at most four characters more or fewer
            v = row[j]
            if v >= 4:
                continue
            if v + 1 < best[i + 1][j]:
                best[i + 1][j] = v + 1
            if v + 1 < row[j + 1]:
                row[j + 1] = v + 1
            if i < n and j < m and clean[i] == seen[j]:
                if v < best[i + 1][j + 1]:
                    best[i + 1][j + 1] = v
            elif v + 1 < best[i + 1][j + 1]:
                best[i + 1][j + 1] = v + 1
            for a in (1, 2):
                for b in (1, 2):
                    if i + a <= n and j + b <= m:
                        c = _COST.get((clean[i : i + a], seen[j : j + b]))
                        if c is not None and v + c < best[i + a][j + b]:
                            best[i + a][j + b] = v + c
    return best[n][m]


def confusions(clean: str, seen: str, most: float) -> float | None:
    """The cost of reading clean as seen by known confusions alone, None if that takes most or more. As confusion_cost, but quick to give up."""
    best = most
    open_ = [(0, 0, 0.0)]
    while open_:
        i, j, cost = open_.pop()
        while i < len(clean) and j < len(seen) and clean[i] == seen[j]:
            i, j = i + 1, j + 1
        if i == len(clean) and j == len(seen):
            best = min(best, cost)
            continue
        for a in (1, 2):
            for b in (1, 2):
                if i + a <= len(clean) and j + b <= len(seen):
                    c = _COST.get((clean[i : i + a], seen[j : j + b]))
                    if c is not None and cost + c < best:
                        open_.append((i + a, j + b, cost + c))
    return best if best < most else None


def rank_features(seen: str, clean: str, n_seen: int, n_clean: int) -> list[float]:
    odd = sum(not c.isalpha() for c in seen) - sum(not c.isalpha() for c in clean)
    return [confusion_cost(clean, seen), math.log1p(n_clean) - math.log1p(n_seen), float(odd > 0), float(len(seen)), float(abs(len(seen) - len(clean))), float(any(ord(c) > 127 for c in seen) and not any(ord(c) > 127 for c in clean))]


def train_ranking(common: dict[str, int], seed: int = 13) -> Boosted:
    """Fitted on misread common words with their originals, against other common words and changes that are no confusion."""
    rnd = random.Random(seed)
    words = sorted((w for w in common if w.isalpha() and len(w) > 3), key=lambda w: (hash_of(w), w))[:TRAIN_WORDS] or ["lantern", "window", "garden"]
    x, y = [], []
    for w in words:
        n = max(common.get(w, 1), 20)
        seen = corrupt(w, rnd)
        if seen != w:
            x.append(rank_features(seen, w, rnd.randint(1, max(1, n // 30)), n))
            y.append(1)
        k = rnd.randrange(len(w))
        other = "".join(c for c in "abdgjklmopqrstxz" if (w[k], c) not in _COST and c != w[k])
        odd = rnd.choice([w[:k] + rnd.choice(other) + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w + rnd.choice("sd")])
        x.append(rank_features(odd, w, rnd.randint(1, max(1, n // 10)), n))
        y.append(0)
        v = rnd.choice(words)
        x.append(rank_features(seen, v, 1, max(common.get(v, 1), 20)))
        y.append(0)
    return Boosted().fit(np.array(x), np.array(y, float))


def _grams(c: str = "word"):
    """Positional q-grams, counted from the start in the first half and from the end in the second, so that one change of length leaves the other half alone."""
    w = F.col(c)
    n = F.length(w)
    at = F.sequence(F.lit(1), F.greatest(n - Q + 1, F.lit(1)))
    grams = F.transform(at, lambda i: F.when(i * 2 <= n - Q + 2, F.concat(F.lit("^"), i.cast("string"), F.lit(":"), F.substr(w, i, F.lit(Q)))).otherwise(F.concat(F.lit("$"), (n - i).cast("string"), F.lit(":"), F.substr(w, i, F.lit(Q)))))
    # one change in a short word leaves no gram alone, but both ends, or the letters at one
    one = lambda mark, x: F.concat(F.lit(mark), x)
    ends = F.when(n <= 7, F.array(one("^$", F.concat(F.left(w, F.lit(1)), F.right(w, F.lit(1)))))).otherwise(F.array().cast("array<string>"))
    short = F.when(n <= 4, F.array(one("^^", F.left(w, F.lit(2))), one("$$", F.right(w, F.lit(2))))).otherwise(F.array().cast("array<string>"))
    return F.concat(grams, ends, short)


def corrections(counts: DataFrame, rare: DataFrame, model: Boosted) -> DataFrame:
    """(word, fixed): misread words with the best-ranked word of at least RATIO times their count, by an inverted join on q-grams."""
    shared = rare.sparkSession.sparkContext.broadcast(model)
    common = counts.filter((F.col("n") >= max(LEAST, RATIO)) & F.col("word").rlike(CLEAN)).select(F.col("word").alias("clean"), F.col("n").alias("n_clean"))
    seen = rare.filter(F.length("word") >= SHORTEST).join(counts, "word").filter(F.col("word").rlike(r"\p{L}"))
    b = common.select("clean", "n_clean", F.explode(F.array_distinct(_grams("clean"))).alias("g"))
    # of a long word only its rarest grams are looked up: one confusion spoils at most Q + 1 of them, so that a word with as many confusions as errors allows keeps one
    errors = F.greatest(F.lit(2), F.floor(F.length("word") / 6))
    a = seen.select("word", "n", F.explode(F.array_distinct(_grams("word"))).alias("g")).join(b.groupBy("g").agg(F.count("*").alias("words")), "g")
    a = a.withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy("words", "g"))).filter(F.col("place") <= (Q + 1) * errors + 1).drop("place", "words")
    n = F.length("word")
    near = a.join(b, "g").filter((F.col("n_clean") >= RATIO * F.col("n")) & (F.abs(n - F.length("clean")) <= F.greatest(F.lit(2), n / 6)) & (F.col("word") != F.col("clean")))
    pairs = near.select("word", "clean", "n", "n_clean").distinct().filter(F.levenshtein("word", "clean") <= F.greatest(F.lit(4), n / 3))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            # only words that confusions alone explain can be corrections
            pdf = pdf[[confusions(c, w, MOST_COST) is not None for w, c in zip(pdf["word"], pdf["clean"], strict=True)]]
            if len(pdf):
                f = np.array([rank_features(*r) for r in zip(pdf["word"], pdf["clean"], pdf["n"], pdf["n_clean"], strict=True)])
                yield pdf[["word", "clean"]].assign(p=m.predict(f), cost=f[:, 0])

    ranked = pairs.mapInPandas(score, "word string, clean string, p double, cost double").filter((F.col("p") >= 0.5) & (F.col("cost") < MOST_COST))
    return ranked.groupBy("word").agg(F.max_by("clean", F.struct(F.col("p"), -F.col("cost"), F.col("clean"))).alias("fixed"))


# --- chunks -----------------------------------------------------------------------------------------------------


def strip(text: str, title: str | None, chapter: str | None, others: list[str], pages: tuple[int | None, int | None], furniture: Logistic) -> tuple[list[str], str]:
    """(kinds of furniture, text without it)."""
    noise: set[str] = set()
    lines = text.split("\n")
    kept: list[str] = []
    names = [(f, True) for f in dict.fromkeys(_folded(x) for x in (title or "", _CHAPTER.sub("", chapter or ""), chapter or "")) if f]
    names += [(f, False) for f in map(_folded, others) if f] if not chapter or len(fold(_CHAPTER.sub("", chapter))) < 4 or chapter.strip().lower() in ("unknown", "none", "n/a") else []
    # a line is like a name only if it is about as long; folding may shorten it by half, and letters may be set apart
    longest = 4 * max((len(f) for f, _ in names), default=0) + 16
    filled = [k for k, x in enumerate(lines) if x.strip()]
    feats, at = [], []
    for k in filled:
        line = lines[k]
        if len(line) <= longest or _NUMBER.match(line):
            f = furniture_features(line, lines[k - 1] if k else "", lines[k + 1] if k + 1 < len(lines) else "", names, pages, k == filled[0])
            if f and (f[0] > 0.3 or f[1] > 0.3 or f[3]):
                feats.append(f)
                at.append(k)
    out = set()
    if feats:
        for k, f, p in zip(at, feats, furniture.predict(np.array(feats)), strict=True):
            if p < 0.5:
                continue
            out.add(k)
            if f[0] > 0.4 or f[1] > 0.4:
                noise.add("header")
            if f[2]:
                noise.add("page_number")
    kept = [x for k, x in enumerate(lines) if k not in out]
    return sorted(noise), "\n".join(kept)


def breaks(body: str, common: Mapping[str, int]) -> list[tuple[int, str, str, bool, bool]]:
    """(k, a, b, hyphen, space): where a line end, or the space it has become, may stand within the word a + b, from token k to the next."""
    tokens = body.split()
    words = [w.strip(_EDGE).lower() for w in tokens]
    known = [w in common for w in words]
    # most neighbours are two common words that make no third one
    some = [k for k in range(len(tokens) - 1) if tokens[k][-1] in HYPHENS or not (known[k] and known[k + 1]) or words[k] + words[k + 1] in common]
    if not some:
        return []
    spans = [m.span() for m in _WORD.finditer(body)]
    out = []
    for k in some:
        left, right = tokens[k], tokens[k + 1]
        hyphen = left[-1] in HYPHENS and len(left) > 1 and left[-2].isalnum()
        if not right[0].isalnum() or not hyphen and (not left[-1].isalnum() or right[0].isupper()):
            continue
        a, b = bare(left[:-1]) if hyphen else words[k], words[k + 1]
        if a and b and a[-1].isalpha() and b[0].isalpha():
            gap = body[spans[k][1] : spans[k + 1][0]]
            if gap.count("\n") < 2:
                out.append((k, a, b, hyphen, "\n" not in gap))
    return out


def one_word(a: str, b: str, known: Mapping[str, int], total: int) -> bool:
    """Whether a + b is frequent beside its rarer part and beside what two words so frequent would meet by chance; total: the count of all words."""
    whole, ca, cb = known.get(a + b, 0), known.get(a, 0), known.get(b, 0)
    return whole > 0 and whole >= 3 * min(ca, cb) and whole * total >= APART * ca * cb


def asked(found: list[tuple[int, str, str, bool, bool]], common: Mapping[str, int], total: int) -> list[str]:
    """The words beyond the common ones whose counts mend() needs."""
    out: set[str] = set()
    for _, a, b, hyphen, _ in found:
        if hyphen or a not in common or b not in common or one_word(a, b, common, total):
            out.update(w for w in (a, b, a + b, f"{a}-{b}") if w not in common)
    return sorted(out)


def mend(body: str, common: dict[str, int], others: dict[str, int], total: int, misread: set[str] | frozenset[str], joins: Logistic, found: list[tuple[int, str, str, bool, bool]] | None = None) -> tuple[bool, list[str], str]:
    """(whether words were broken, words that may be misread, text with joined words and paragraphs on one line).

    others: counts of words that aren't common. total: the count of all words. misread: the common words that have a correction; any word that isn't common may have one. found: the breaks of body, if they are known.
    """
    known = ChainMap(others, common)
    glue, met, where = {}, [], []
    for k, a, b, hyphen, space in breaks(body, common) if found is None else found:
        if not hyphen and not one_word(a, b, known, total):
            continue
        met.append(join_features(a, b, hyphen, space, known))
        where.append((k, hyphen, f"{a}-{b}"))
    broken = False
    if met:
        for (k, hyphen, compound), p in zip(where, joins.predict(np.array(met)), strict=True):
            if p >= 0.5:
                glue[k] = (hyphen, "")
                broken = True
            elif hyphen and compound in known:
                glue[k] = (False, "")
    paragraphs = []
    k = -1
    for part in _PARAGRAPH.split(body):
        rebuilt: list[str] = []
        for token in part.split():
            k += 1
            if k and k - 1 in glue and rebuilt:
                rebuilt[-1] = (rebuilt[-1][:-1] if glue[k - 1][0] else rebuilt[-1]) + token
            else:
                rebuilt.append(token)
        if rebuilt:
            paragraphs.append(rebuilt)
    rare = {w for w in {t.strip(_EDGE).lower() for p in paragraphs for t in p} if (w not in common or w in misread) and len(w) >= SHORTEST and any(c.isalpha() for c in w)}
    return broken, sorted(rare), "\n\n".join(" ".join(p) for p in paragraphs)


def parsed(chunks: DataFrame, books: DataFrame, counts: DataFrame, common: dict[str, int], misread: frozenset[str], key: str = "chunk_key") -> DataFrame:
    """One row per chunk key: its noise but for misread words, its words, and its text without furniture and with joined words."""
    sc = chunks.sparkSession.sparkContext
    one = by_key(chunks.filter(F.col(key).isNotNull() & F.col("text").isNotNull()).withColumn(key, F.col(key).cast("bigint")), key).groupBy(F.col(key).alias("chunk_key")).agg(F.min(F.struct("loaded_at", "book_id", "chapter", "page_start", "page_end", "text")).alias("r")).select("chunk_key", "r.book_id", "r.chapter", "r.page_start", "r.page_end", "r.text")
    titles = books.groupBy("book_id").agg(F.min("title").alias("title"))
    heads = chunks.filter("chapter IS NOT NULL").select("book_id", F.trim(F.regexp_replace(F.lower("chapter"), _CHAPTER.pattern.replace("^", "^(?i)", 1), "")).alias("c")).filter(F.length("c") > 3).distinct().groupBy("book_id").agg(F.sort_array(F.collect_set("c")).alias("heads"))
    full = one.join(titles, "book_id", "left").join(heads, "book_id", "left").drop("book_id")
    sample = [r["title"] for r in titles.filter("title IS NOT NULL").orderBy(F.xxhash64("book_id")).limit(200).collect()]
    held = sc.broadcast((common, train_furniture(sample), train_joins(common), misread))
    total = counts.agg(F.sum("n")).first()[0] or 0

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, furniture, *_ = held.value
        for b in batches:
            rows = []
            for r in b.to_pylist():
                noise, body = strip(r["text"], r["title"], r["chapter"], r["heads"] or [], (r["page_start"], r["page_end"]), furniture)
                met = breaks(body, common)
                rows.append({"chunk_key": r["chunk_key"], "noise": noise, "body": body, "breaks": [dict(zip(("k", "a", "b", "hyphen", "space"), x, strict=True)) for x in met], "asked": asked(met, common, total)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("chunk_key", pa.int64()), ("noise", pa.list_(pa.string())), ("body", pa.string()), ("breaks", pa.list_(pa.struct([("k", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("hyphen", pa.bool_()), ("space", pa.bool_())]))), ("asked", pa.list_(pa.string()))]))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, _, joins, misread = held.value
        for b in batches:
            rows = []
            for r in b.to_pylist():
                broken, rare, clean = mend(r["body"], common, dict(r["others"] or []), total, misread, joins, [(x["k"], x["a"], x["b"], x["hyphen"], x["space"]) for x in r["breaks"]])
                rows.append({"chunk_key": r["chunk_key"], "noise": sorted([*r["noise"], *["hyphenation"] * broken]), "rare": rare, "clean": clean})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("chunk_key", pa.int64()), ("noise", pa.list_(pa.string())), ("rare", pa.list_(pa.string())), ("clean", pa.string())]))

    stripped = cut(full.mapInArrow(lines, STRIPPED))
    others = stripped.select("chunk_key", F.explode("asked").alias("word")).join(counts.filter(F.col("n") >= LEAST), "word").groupBy("chunk_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("others"))
    return by_key(stripped.drop("asked"), "chunk_key").join(others, "chunk_key", "left").mapInArrow(words, PARSED)


def common_words(counts: DataFrame) -> dict[str, int]:
    """Words with at least COMMON_SHARE of all, hence at most 1 / COMMON_SHARE words, with their counts."""
    return {r["word"]: r["n"] for r in counts.filter(F.col("n") >= _least_common(counts)).toLocalIterator()}


def _least_common(counts: DataFrame) -> int:
    return max(LEAST, math.ceil((counts.agg(F.sum("n")).first()[0] or 0) * COMMON_SHARE))


def _stages(chunks: DataFrame, books: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    counts = cut(word_counts(spread(chunks.select("text"))))
    common = common_words(counts)
    # every word but those too frequent for any correction; what line ends are joined to is among them
    top = counts.filter(F.col("word").rlike(CLEAN)).agg(F.max("n")).first()[0] or 0
    fixes = cut(corrections(counts, counts.filter(F.col("n") * RATIO <= top).select("word"), train_ranking(common)))
    misread = frozenset(r["word"] for r in fixes.join(counts.filter(F.col("n") >= _least_common(counts)), "word", "left_semi").select("word").toLocalIterator())
    return cut(parsed(chunks, books, counts, common, misread, key)), fixes


def noise(chunks: DataFrame, books: DataFrame, key: str = "chunk_key") -> DataFrame:
    """(chunk_key, noise): one row per chunk and kind of noise present: hyphenation, misread, header, page_number.

    Null or blank texts have none. Of a key delivered again the first delivery counts; null keys are left out. A null chapter or book leaves
    the book's other chapters, or nothing, to compare heads with; without page numbers no line is a page number.
    """
    found, fixes = _stages(chunks, books, key)
    plain = found.select("chunk_key", F.explode("noise").alias("noise"))
    misread = found.select("chunk_key", F.explode("rare").alias("word")).join(fixes.select("word"), "word", "left_semi").select("chunk_key", F.lit("misread").alias("noise")).distinct()
    return plain.unionByName(misread)


def repair(chunks: DataFrame, books: DataFrame, key: str = "chunk_key") -> DataFrame:
    """(chunk_key, text): every chunk as continuous paragraphs, without furniture, with broken words joined and misread words corrected."""
    found, fixes = _stages(chunks, books, key)
    per = found.select("chunk_key", F.explode("rare").alias("word")).join(fixes, "word").groupBy("chunk_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "fixed"))).alias("fixes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                fix = dict(r["fixes"] or [])

                def swap(m: re.Match, fix: dict = fix) -> str:
                    t = m.group()
                    core = t.strip(_EDGE)
                    new = fix.get(core.lower())
                    if new is None:
                        return t
                    new = new.upper() if core.isupper() and len(core) > 1 else new.capitalize() if core[:1].isupper() else new
                    return t.replace(core, new, 1)

                rows.append({"chunk_key": r["chunk_key"], "text": _WORD.sub(swap, r["clean"]) if fix else r["clean"]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("chunk_key", pa.int64()), ("text", pa.string())]))

    return found.join(per, "chunk_key", "left").select("chunk_key", "clean", "fixes").mapInArrow(run, "chunk_key bigint, text string")
