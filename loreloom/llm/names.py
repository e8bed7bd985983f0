"""Problem 2: linking the spellings of one person or organisation by merge-and-rematch resolution.

Each distinct string of a book starts as a profile: surnames, given names, initials, titles, or place and kind of an organisation. Profiles meet
in blocks of (book, surname or place with one character left out). Profiles that match are merged; the union of their
spellings, given names and initials is a richer profile that enters blocking again, until no merge happens. A short form (initial, bare surname, acronym)
joins only when exactly one fuller profile of its block fits it, which a merge may first bring about.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.operators.skew import halves
from loreloom.session import by_key, cut, shuffled

#: Given names with their usual short forms.
SHORT_FORMS = (
    "abigail abby abbie nabby gail", "alexander alec alex sandy sasha xander", "anastasia stacy stacey ana anna nastya", "anne ann anna annie nan nancy", "arthur art artie", "benjamin ben benny benji", "catherine cathy cat kate katie kitty", "charles charlie chuck chas", "charlotte lottie charlie",
    "christopher chris kit kris topher", "daniel dan danny", "david dave davy", "dorothy dolly dot dottie dora", "edward ed eddie ned ted teddy", "eleanor ellie nell nora", "elizabeth liz lizzie lizzy betsy betty beth bess eliza elsie libby", "emma em", "frances fanny fran francie frankie", "francis frank",
    "frederick fred freddie freddy", "george georgie", "gilbert gil gib bert", "grace gracie", "gwendolen gwen gwennie wendy", "harriet hattie harry harrie", "henry harry hal hank", "isabella bella izzy belle isa", "james jim jimmy jamie jem", "john jack johnny", "joseph joe joey", "josephine jo josie fina", "katherine kate katie kitty kathy kay",
    "lawrence larry laurie lawrie", "louisa lou lulu", "margaret meg peggy maggie madge greta daisy", "martha mattie patty", "mary molly polly may mamie", "matthew matt", "michael mick mike mickey micky", "nathaniel nat nate", "nicholas nick nicky", "oliver ollie noll", "oswald oz ozzie ossie", "patrick paddy pat", "peter pete", "philip phil",
    "rebecca becky becca", "richard dick rick rich richie", "robert bob rob bobby robbie", "rosalind roz ros rosie", "samuel sam sammy", "sarah sally sadie", "stephen steve", "susannah sue sukey susie susan", "theodora thea dora theo", "theodore ted theo teddy", "thomas tom tommy", "victoria vicky vic tori", "vincent vin vince vinny", "walter wally walt",
    "wilhelmina mina minnie willa billie", "william will bill billy willy", "zachary zack zach zac",
    "johannes hans hannes johann", "friedrich fritz", "josef sepp jupp", "elisabeth lisl elsbeth lisbeth", "margarete gretchen grete", "heinrich heinz heiner", "jose pepe", "francisco paco pancho curro", "guadalupe lupe", "dolores lola", "ignacio nacho", "jesus chucho", "mercedes merche", "giuseppe beppe peppino", "giovanni gianni nino", "mikhail misha", "aleksandr sasha shura", "yekaterina katya", "dmitri mitya dima", "nikolai kolya", "tatyana tanya", "ivan vanya",
)
#: Titles, and the sex they tell.
TITLES = {"mr": "m", "mister": "m", "sir": "m", "lord": "m", "master": "m", "herr": "m", "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "madame": "f", "mme": "f", "lady": "f", "dame": "f", "frau": "f", "dr": "", "doctor": "", "capt": "", "captain": "", "prof": "", "professor": "", "rev": "", "reverend": "", "col": "", "colonel": "", "hon": "", "judge": "", "major": ""}
WOMEN = frozenset("abigail anastasia anne catherine charlotte dorothy eleanor elizabeth emma frances grace gwendolen harriet isabella josephine katherine louisa margaret martha mary rebecca rosalind sarah susannah theodora victoria wilhelmina".split())
#: Usual abbreviations of organisations, and the words that make a name one. Other abbreviations are told by their letters, other words of a name by their place in it.
ORG_SHORT = {"co": "company", "coy": "company", "cie": "company", "bros": "brothers", "inst": "institute", "soc": "society", "assoc": "association", "assn": "association", "ltd": "limited", "corp": "corporation", "univ": "university", "dept": "department"}
ORG_HEADS = frozenset("company brothers brotherhood institute society trust office guild association limited corporation foundry university department library bank club college school union league works firm agency bureau council committee press railway ministry academy museum theatre hospital church order fellowship".split())
SMALL = {"the", "of", "and", "&", "a", "an", "for", "de", "von", "van"}

CANON: dict[str, frozenset] = {}
for _row in SHORT_FORMS:
    for _n in _row.split():
        CANON[_n] = CANON.get(_n, frozenset()) | {_row.split()[0]}
_BY_DELETION: dict[str, set] = {}
for _n in CANON:
    if len(_n) >= 4:
        for _k in range(len(_n)):
            _BY_DELETION.setdefault(_n[:_k] + _n[_k + 1 :], set()).add(_n)
        _BY_DELETION.setdefault(_n, set()).add(_n)

PROFILE = T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("surnames", "givens", "initials", "sexes", "orgs", "acronyms")]])
MERGED = ("kind", "surnames", "givens", "initials", "sexes", "orgs", "acronyms")


_MEN = frozenset(r.split()[0] for r in SHORT_FORMS) - WOMEN


def diminutive(short: str, full: str) -> bool:
    """Whether short, without its ending -i, -y, -ie or -ey and a doubled letter before that, begins full: so a short form that no table has."""
    stem = re.sub(r"(?:ie|ey|i|y)$", "", short)
    if stem == short or len(full) <= len(short):
        return False
    return len(stem) >= 2 and (full.startswith(stem) or stem[-1:] == stem[-2:-1] and len(stem) > 2 and full.startswith(stem[:-1]))


@lru_cache(maxsize=100_000)
def sex_by_ending(name: str) -> str:
    """The sex of the known names with the longest ending in common with an unknown one (three letters or more), if they have one sex; else empty."""
    for k in range(min(len(name) - 1, 6), 2, -1):
        women, men = (sum(n.endswith(name[-k:]) for n in x) for x in (WOMEN, _MEN))
        if women + men > 1:
            return "f" if not men else "m" if not women else ""
    return ""


@lru_cache(maxsize=100_000)
def abbreviates(short: str, full: str) -> bool:
    """Whether short is full left out letters of: the first letter, and the others in order; a plural s at its end does not count."""
    if short in ORG_SHORT and ORG_SHORT[short] == full:
        return True
    if len(short) < 2 or len(short) >= len(full) or short[0] != full[0]:
        return False
    for s in (short, short[:-1]) if short.endswith("s") and len(short) > 2 else (short,):
        rest = iter(full)
        if all(c in rest for c in s):
            return True
    return False


@lru_cache(maxsize=100_000)
def is_head(word: str, cut_short: bool) -> bool:
    """Whether a word makes a name an organisation's: a head, nearly one, its usual abbreviation, or (cut_short: with a full stop, or without vowels) letters of one."""
    if word in ORG_HEADS or word in ORG_SHORT or len(word) > 5 and any(near(word, h) for h in ORG_HEADS if len(h) > 5):
        return True
    return cut_short and len(word) < 8 and any(abbreviates(word, h) for h in ORG_HEADS)


@lru_cache(maxsize=100_000)
def same_word(a: str, b: str) -> bool:
    return a == b or near(a, b) or abbreviates(a, b) or abbreviates(b, a)


def covers(few: list[str], many: list[str]) -> bool:
    """Whether each word of few has a word of its own in many."""
    left = list(many)
    for w in few:
        at = next((k for k, x in enumerate(left) if x == w), next((k for k, x in enumerate(left) if same_word(w, x)), None))
        if at is None:
            return False
        left.pop(at)
    return True


def same_kinds(a: list[str], b: list[str], part: bool = False) -> bool:
    """Whether one of the readings in a has the same words as one in b; part: or only some of them."""
    return any((part or len(x.split()) == len(y.split())) and covers(x.split(), y.split()) for x in a for y in b)


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or exchange of neighbours; short words must be equal."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :] or a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]


def plain(s: str) -> str:
    s = unicodedata.normalize("NFKD", s)
    return "".join(c for c in s if not unicodedata.combining(c)).lower().replace("’", "'")


@lru_cache(maxsize=100_000)
def given_forms(t: str) -> frozenset:
    """The full names a given name may stand for: by the table, by one slip of the pen from it, else itself."""
    if t in CANON:
        return CANON[t]
    if len(t) >= 4:
        close = {n for k in [t, *[t[:i] + t[i + 1 :] for i in range(len(t))]] for n in _BY_DELETION.get(k, ()) if near(n, t)}
        if close:
            return frozenset(x for n in close for x in CANON[n])
    return frozenset({t})


def is_given(t: str) -> bool:
    return t in CANON or len(t) >= 4 and given_forms(t) != frozenset({t})


def parse(name: str) -> dict | None:
    """The profile of one string; None when it holds no name (blank, or only small words, titles and lower-case roles)."""
    s = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name)).strip()
    if not s:
        return None
    out: dict = {"kind": "", "surnames": [], "givens": [], "initials": [], "sexes": [], "orgs": [], "acronyms": []}
    nick = re.search(r"[“\"‘(]([^”\"’)]+)[”\"’)]", s)
    if nick and 0 < nick.start():
        s = s[: nick.start()] + " " + s[nick.end() :]
    bare = re.sub(r"[^\w]", "", s)
    if re.fullmatch(r"\W*(?:[A-ZÀ-Þ]\.?\W*){2,6}", s) and len(bare) <= 6 and " " not in s.strip():
        return out | {"kind": "acronym", "acronyms": [plain(bare)]}
    raw = re.findall(r"[\w'’.&-]+|,", s)
    low = [plain(t) for t in raw]
    tokens = [(w.strip(".'-"), w.endswith(".")) for w in low if w != ","]
    tokens = [(p, d) for w, d in tokens if w for p in (w.split("-") if "-" in w and any(is_head(x, False) for x in w.split("-")) else [w])]
    last = [k for k, (w, _) in enumerate(tokens) if w in ("of", "for")] + [len(tokens)]
    ends = {k - 1 for k in last}  # where an abbreviated head may stand
    vowels = set("aeiouy")
    heads = [w for k, (w, d) in enumerate(tokens) if is_head(w, k > 0 and k in ends and "," not in low and (d or not set(w) & vowels))]
    dotted = [t for t in raw if re.fullmatch(r"(?:[A-ZÀ-Þ]\.){2,5}", t)]
    if heads:
        words = [w for w, _ in tokens]
        after = words.index("of") if "of" in words else None
        body = [(w, after is not None and k > after) for k, w in enumerate(words) if w not in SMALL]
        # the place stands after "of" or a comma, else it is the first word that is no head
        tail = [w.strip(".'-") for w in low[low.index(",") + 1 :] if w != ","] if "," in low else []
        if after is None and tail and not any(w in heads for w in tail):
            body = [(w, w in tail) for w, _ in body]
        place = [w for w, far in body if far] or next(([w] for w, _ in body if w not in heads), [])
        if not place or set(place) <= set(heads):
            return None
        kinds = [w for w, far in body if not far and w not in place]
        readings = [(place, kinds)]
        if "-" in place[0] and len(place) == 1:  # the hyphen parts the place from the rest, or was written into it
            first, *more = place[0].split("-")
            readings.append(([first], [*more, *kinds]))
        readings = [(["".join(p).replace("-", "")], [k.replace("-", "") for k in q]) for p, q in readings]
        # "X & Co" leaves the rest of the kinds out
        partial = len(kinds) == 1 and ("&" in low or "and" in low)
        letters = ["".join(x[0] for x in [*p, *q] if x) for p, q in readings]
        return out | {"kind": "org" if not partial else "orgpart", "surnames": [p[0] for p, _ in readings], "orgs": [" ".join(sorted(q)) for _, q in readings], "acronyms": letters if not partial else []}
    if dotted and len(raw) == 2 and raw[-1] == dotted[0]:  # "Place S.T.", unless it is a person with the name after
        return out | {"kind": "orgshort", "surnames": [low[0].replace("-", "")], "acronyms": [plain(re.sub(r"\W", "", dotted[0]))]}
    sexes, rest, comma = [], [], None
    for t, w in zip(raw, low, strict=True):
        if w == ",":
            comma = len(rest)
            continue
        core = w.strip(".'-")
        if core in TITLES and not rest:
            sexes.append(TITLES[core])
            continue
        if not core or core in SMALL and not w.endswith("."):
            if not rest and core in ("the", "a", "an"):
                sexes.append("the")
            continue
        if re.fullmatch(r"(?:\w\.){2,4}", w):
            rest += [(x + ".", x) for x in core.split(".") if x]
        else:
            rest.append((t, core.replace("-", "").replace("'", "")))
    if "the" in sexes and (len(rest) != 1 or rest[0][0][:1].islower()):
        return None  # a role, not a name
    if not rest or all(len(w) == 1 for _, w in rest):
        return None
    out["sexes"] = [x for x in sexes if x in ("m", "f")]
    if comma and comma < len(rest):
        rest = rest[comma:] + rest[:comma]
    elif len(rest) == 2 and not sexes and is_given(rest[1][1]) and not is_given(rest[0][1]) and len(rest[0][1]) > 1:
        rest = rest[::-1]
    if len(rest) == 2 and len(rest[1][1]) == 1 and len(rest[0][1]) > 1:
        rest = rest[::-1]
    surname = rest[-1][1]
    if len(surname) < 2:
        return None
    out["surnames"] = [surname]
    first = rest[:-1]
    if nick and nick.start():
        first = [*first, (nick[1], plain(nick[1].strip()))]
    if not first:
        return out | {"kind": "bare"}
    t, w = first[0]
    if len(w) == 1:
        out["initials"] = [w]
        out["kind"] = "initial"
        more = [x for _, x in first[1:] if len(x) > 2]
        if more:
            out["givens"] = more[:1]
            out["kind"] = "person"
    elif t.endswith("."):  # cut short, unless it is a short form with a stop
        out["givens"] = [w + "*", *([w] if w in CANON else [])]
        out["initials"] = [w[0], *([x[0] for x in given_forms(w)] if w in CANON else [])]
        out["kind"] = "person"
    else:
        out["givens"] = [w, *([first[-1][1]] if nick and len(first) > 1 else [])]
        out["initials"] = [w[0], *[x[0] for x in given_forms(w)]]
        out["kind"] = "person"
    return out


def keys(surnames: list[str], acronyms: list[str], kind: str) -> list[str]:
    """Blocks: the surname or place, and each of its forms with one character left out; acronyms for organisations."""
    out = set()
    for s in surnames:
        out.add(s)
        if len(s) >= 4:
            out.update(s[:k] + s[k + 1 :] for k in range(len(s)))
    if kind in ("acronym", "org"):
        out.update("#" + a for a in acronyms)
    return sorted(out)


def _givens_agree(a: list[str], b: list[str]) -> bool:
    for x in a:
        for y in b:
            if x.endswith("*") or y.endswith("*"):
                p, q = x.rstrip("*"), y.rstrip("*")
                pool_q = {q} if y.endswith("*") else {q, *given_forms(q)}
                pool_p = {p} if x.endswith("*") else {p, *given_forms(p)}
                if any(u.startswith(v) or v.startswith(u) for u in pool_p for v in pool_q if min(len(u), len(v)) >= 3):
                    return True
            elif x == y or given_forms(x) & given_forms(y) or near(x, y):
                return True
            elif not (is_given(x) or is_given(y)) and (diminutive(x, y) or diminutive(y, x)):
                return True
    return False


def _sex(p: dict) -> set:
    full = {f for g in p["givens"] if not g.endswith("*") for f in given_forms(g)}
    told = set(p["sexes"])
    if full & WOMEN and not full - WOMEN:
        told.add("f")
    elif full and not full & WOMEN and any(g in CANON for g in full):
        told.add("m")
    elif not full & WOMEN and not full & _MEN:
        told |= {x for x in {sex_by_ending(g) for g in full} if x}
    return told


def compare(a: dict, b: dict) -> int:
    """0: differ; 1: the same; 2: a is a short form that fits b; 3: b is a short form that fits a."""
    ka, kb = a["kind"], b["kind"]
    if "acronym" in (ka, kb):
        if ka == kb:
            return int(bool(set(a["acronyms"]) & set(b["acronyms"])))
        short, full = (a, b) if ka == "acronym" else (b, a)
        return (2 if short is a else 3) if full["kind"] == "org" and set(short["acronyms"]) & set(full["acronyms"]) else 0
    if not any(near(x, y) for x in a["surnames"] for y in b["surnames"]):
        return 0
    orgs = {"org", "orgpart", "orgshort"}
    if ka in orgs and kb in orgs:
        if ka == kb == "org":
            return int(same_kinds(a["orgs"], b["orgs"]))
        if ka == kb:
            return int(ka == "orgpart" and same_kinds(a["orgs"], b["orgs"]) or bool(set(a["acronyms"]) & set(b["acronyms"])))
        short, full = (a, b) if kb == "org" else (b, a)
        if full["kind"] != "org":
            return 0
        if short["kind"] == "orgshort" and not {sorted_tail(x) for x in full["acronyms"]} & {"".join(sorted(x)) for x in short["acronyms"]}:
            return 0
        if short["kind"] == "orgpart" and not same_kinds(short["orgs"], full["orgs"], part=True):
            return 0
        return 2 if short is a else 3
    if ka in orgs or kb in orgs:
        org, other = (a, b) if ka in orgs else (b, a)
        return (2 if other is a else 3) if other["kind"] == "bare" and org["kind"] == "org" and not other["sexes"] else 0
    sa, sb = _sex(a), _sex(b)
    if ka == kb == "person":
        return int(_givens_agree(a["givens"], b["givens"]))
    if sa and sb and not sa & sb:
        return 0
    if ka == kb == "initial":
        return int(a["initials"][0] == b["initials"][0])
    if ka == kb == "bare":
        return 1 if set(a["sexes"]) == set(b["sexes"]) else 0
    if "bare" in (ka, kb):
        return 2 if ka == "bare" else 3
    short, full = (a, b) if ka == "initial" else (b, a)
    return (2 if short is a else 3) if set(short["initials"]) & set(full["initials"]) else 0


def sorted_tail(x: str) -> str:
    return "".join(sorted(x[1:]))


@F.pandas_udf(PROFILE)
def _profile(names: pd.Series) -> pd.DataFrame:
    empty = {"kind": None, **{c: [] for c in MERGED[1:]}}
    return pd.DataFrame([parse(n) or empty for n in names], columns=list(MERGED))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys(surnames: pd.Series, acronyms: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([keys(list(s), list(a), k) for s, a, k in zip(surnames, acronyms, kind, strict=True)])


@lru_cache(maxsize=200_000)
def _unpack(profile: str) -> dict:
    return {"kind": "", **{c: [] for c in MERGED[1:]}} | json.loads(profile)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        verdicts = np.array([compare(_unpack(x), _unpack(y)) for x, y in zip(b.column("pa").to_pylist(), b.column("pb").to_pylist(), strict=True)], np.int32)
        keep = pa.array(verdicts > 0)
        yield pa.RecordBatch.from_pydict({c: b.column(c).filter(keep) for c in ("book_id", "a", "b")} | {"v": pa.array(verdicts).filter(keep)})


def spellings(characters: DataFrame, aliases: DataFrame) -> DataFrame:
    """(book_id, name): every distinct string of a book, as stored."""
    all_ = characters.select("book_id", "name").unionByName(aliases.select("book_id", F.col("canonical").alias("name"))).unionByName(aliases.select("book_id", F.explode("aliases").alias("name")))
    return all_.filter(F.col("name").isNotNull() & F.col("book_id").isNotNull()).distinct()


def _rank(kind):
    return F.when(kind == "person", 3).when(kind == "org", 3).when(kind == "initial", 2).when(kind == "orgshort", 2).when(kind == "orgpart", 2).otherwise(1)


def resolve(characters: DataFrame, aliases: DataFrame) -> DataFrame:
    """(book_id, name, entity): every string that holds a name, with its entity (the least id of its strings).

    Null and blank strings, and roles without a name, have no row. A null book_id is left out. Strings of different books are never linked.
    Equal strings of a book are one.
    """
    strings = by_key(spellings(characters, aliases), "book_id", "name")
    base = strings.withColumn("p", _profile("name")).filter("p.kind IS NOT NULL").select("book_id", "name", F.xxhash64("book_id", "name").alias("entity"), "p.*", F.lit(True).alias("fresh"))
    nodes = cut(base)
    weak = False
    while True:
        members = nodes.groupBy("book_id", "entity").agg(F.max_by("kind", _rank(F.col("kind"))).alias("kind"), *[F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in MERGED[1:]], F.max("fresh").alias("fresh"))
        profiles = cut(members.select("book_id", "entity", "fresh", "kind", F.to_json(F.struct(*MERGED)).alias("p"), _keys("surnames", "acronyms", "kind").alias("keys")))
        x, y = halves(profiles.select("book_id", "entity", "fresh", F.explode("keys").alias("key")), ["book_id", "key"], "entity")
        met = x.withColumnsRenamed({"entity": "a", "fresh": "fa"}).join(shuffled(y.withColumnsRenamed({"entity": "b", "fresh": "fb"})), ["book_id", "key", "_part"]).filter("a <> b")
        if not weak:  # two profiles that stayed as they were differ as they did before
            met = met.filter("fa OR fb")
        pairs = met.select("book_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        of = lambda e, p: shuffled(profiles.select("book_id", F.col("entity").alias(e), F.col("p").alias(p)))
        verdicts = pairs.join(of("a", "pa"), ["book_id", "a"]).join(of("b", "pb"), ["book_id", "b"]).mapInArrow(_compare, "book_id bigint, a bigint, b bigint, v int")
        if not weak:
            edges = verdicts.filter("v = 1").select("book_id", "a", "b")
        else:
            verdicts = cut(verdicts)
            fits = verdicts.filter("v > 1").select("book_id", F.when(F.col("v") == 2, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(F.col("v") == 2, F.col("b")).otherwise(F.col("a")).alias("f"))
            strength = shuffled(profiles.select("book_id", F.col("entity").alias("f"), _rank(F.col("kind")).alias("rank")))
            best = fits.join(strength, ["book_id", "f"]).groupBy("book_id", "s").agg(F.max_by(F.col("f"), F.col("rank")).alias("f"), F.sum(F.when(F.col("rank") == 3, 1).otherwise(0)).alias("full"), F.count("*").alias("n"))
            one = best.filter("full = 1 OR full = 0 AND n = 1").select("book_id", F.least("s", "f").alias("a"), F.greatest("s", "f").alias("b"))
            edges = verdicts.filter("v = 1").select("book_id", "a", "b").unionByName(one)
        down = edges.select("book_id", F.col("b").alias("entity"), F.col("a").alias("to"))
        moves = cut(down.groupBy("book_id", "entity").agg(F.min("to").alias("to")))
        if moves.isEmpty():
            if weak:
                return nodes.select("book_id", "name", "entity")
            weak = True
            continue
        # both the entities that moved and those they moved to have new profiles
        touched = moves.select("book_id", "entity").unionByName(moves.select("book_id", F.col("to").alias("entity"))).distinct().withColumn("new", F.lit(True))
        moved = nodes.join(shuffled(moves.join(shuffled(touched), ["book_id", "entity"], "right")), ["book_id", "entity"], "left")
        nodes = cut(moved.withColumn("entity", F.coalesce("to", "entity")).withColumn("fresh", F.coalesce("new", F.lit(False))).select(nodes.columns))


def found(characters: DataFrame, aliases: DataFrame) -> DataFrame:
    """(book_id, name_a, name_b): the pairs of different strings of one entity, the first one earlier in code-point order."""
    r = resolve(characters, aliases)
    a, b = halves(r, ["book_id", "entity"], "name")
    both = a.withColumnRenamed("name", "name_a").join(shuffled(b.withColumnRenamed("name", "name_b")), ["book_id", "entity", "_part"])
    # every pair meets twice, once from either side
    return both.filter("name_a < name_b").select("book_id", "name_a", "name_b")
