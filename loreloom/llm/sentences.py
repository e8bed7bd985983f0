"""Problem 10: sentence boundaries by cascading segmentation rules.

A text is cut into blocks at blank lines. Within a block, every place where a sentence could end is a candidate: after a
run of terminators and the closers attached to it, or, in scripts without full stops, at a space. Each candidate is
decided by the first rule whose pattern before it and pattern after it both match. The rules are ordered in tables: what a writing system
asks for first, then the table of the language, then the rest of the writing system. The writing system is that of the letter before
the candidate, so that each part of a mixed text is cut by rules of its own; the language of Latin and Han texts is that of the document's
frequent words and signs, and where these are divided, the tables of all languages of that writing system are asked in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.session import spread

OUT = "doc_id bigint, sent_no int, sent_start int, sent_end int"

_CLOSE = r"[\"'”’»)\]}」』）】›“‘*_]"
#: Verbs that attribute a quotation to a speaker.
_SAID = "asked|said|cried|answered|began|replied|shouted|called|whispered|murmured|demanded|added|continued|exclaimed|muttered|declared|insisted|laughed|snapped|told|inquired|wondered|repeated|agreed|warned|sighed"
_SPEAKER = r"(?:(?:the|a|an|his|her|Mr\.|Mrs\.|Ms\.|Miss|Dr\.|Prof\.|Capt\.|St\.)\s+)?(?:[\p{Lu}][\p{L}'’.-]*|of|the|and)(?:\s+(?:[\p{Lu}][\p{L}'’.-]*|of|the|and))*"
_QUOTED = rf"[?!…]{_CLOSE}+$|\.\.\.{_CLOSE}+$|[,.—–-]{_CLOSE}+$"
#: Abbreviations, by language, after which a sentence goes on with whatever follows.
_ABBREVIATIONS = {
    "en": "Mr|Mrs|Ms|Mx|Messrs|Dr|Prof|Capt|Col|Gen|Lt|Sgt|Rev|Hon|St|Sr|Jr|Sir|Maj|Cdr|Fig|fig|Figs|figs|vs|cf|Cf|viz|approx|ca|Eq|eq|Ch|ch|Vol|vol|Sec|sec|Chap|chap|pp|p|ed|eds|op|Yrs|Mt|Ft|N\\.B|P\\.S|P\\.P\\.S|i\\.e|e\\.g",
    "de": "Dr|Prof|Hr|Fr|Frl|Herr|St|Bd|Abb|bzw|vgl|Vgl|usw|evtl|ggf|sog|Hg|Anm|ca|z\\.\\s?B|d\\.\\s?h|u\\.\\s?a|o\\.\\s?ä|z\\.\\s?T|i\\.\\s?d\\.\\s?R",
    "fr": "M|MM|Mme|Mmes|Mlle|Mons|Dr|Pr|St|Ste|p\\.\\s?ex|c\\.-à-d|env|chap|éd|vol|pp|p",
    "es": "Sr|Sra|Srta|Sres|Dr|Dra|Dña|D|Ud|Uds|p\\.\\s?ej|núm|Núm|pág|págs|aprox",
    "it": "[Ss]ig|[Ss]igg|[Ss]ig\\.ra|[Dd]ott|[Pp]rof|[Aa]vv|[Ii]ng|S|p\\.\\s?es|pagg",
    "pt": "[Ss]r|[Ss]ra|[Ss]rs|[Dd]r|[Dd]ra|[Pp]rof|[Ee]ng|p\\.\\s?ex|pág|págs|núm",
    "nl": "[Dd]hr|[Mm]evr|[Mm]w|[Dd]r|[Pp]rof|St|bijv|bv|d\\.\\s?w\\.\\s?z|o\\.\\s?a|blz|nr|ca|z\\.\\s?g",
    "ru": "т\\.\\s?е|т\\.\\s?д|т\\.\\s?п|т\\.\\s?к|и\\.\\s?о|г-н|г-жа|проф|акад|им|ул|стр|см|ср|рис|гл|д-р|тов|гр|св|т",
    "el": "π\\.\\s?χ|κ\\.\\s?ά|κ\\.\\s?λ\\.\\s?π|δηλ|βλ|σελ|κ|κα|δρ|καθ|αρ",
    "hi": "डॉ|श्री|प्रो|पं|कु|सं|रु|क्र|स्व",
    "ar": "[\\p{L}]|أ\\.د|ص|ج|م|هـ|ق\\.م",
    "th": "พ|ค|ดร|นาย|น|ม|ก|ฯ",
}
_MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Kapitel|Band"
#: Frequent short words of the languages in Latin letters.
_FREQUENT = {
    "en": "the of and was were is are to with at which what who when that this his her he she it in on by from for but not had",
    "de": "der die das und ist nicht wo wer den dem des ein eine einen im am zum zur mit von auf um nach vor bei sich er sie es war hatte",
    "fr": "le la les et est un une des du de au aux qui que où dans ne pas se sa son ses il elle ce cette avec par sur était à",
    "es": "el la los las y es un una de del al que quién dónde por para con sin en no su sus se vio lo había",
    "it": "il lo la gli e è un una di del della che chi dove per con non si suo sua nel alla era più",
    "pt": "o a os as e é um uma de do da que quem onde por para com não se seu sua no na era mais",
    "nl": "de het een en is niet wie waar van met op in aan bij naar voor zijn haar hij zij was dat",
}


def _short(language: str) -> tuple[bool, str, str]:
    return (False, rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:{_ABBREVIATIONS[language]})\.$", r"\s")


#: One rule: break here or not, what must stand before the candidate (up to its end), what must follow it.
RULES: dict[str, list[tuple[bool, str, str]]] = {
    "latin first": [
        # a list item begins
        (True, r"", r"\s+[*•‣▪·]\s+\S"),
        # a reference that opens a note
        (False, r"(?<!\p{L})(?:[Cc]f|[Vv]gl|pp?|ch|vol)\.$", r"\s"),
        (True, r"", r"\s+(?:cf|vgl|p|pp|ch|vol|see|siehe|voir|véase)\.?\s+(?:[a-z]{1,4}\.\s*)?[\d–-]+(?:\s*ff?\.)?:\s"),
        # a number at the start of a line counts the line
        (False, r"(?:^|\n)\s*(?:\d{1,3}|[a-zA-Z]|[ivxlc]{1,5}|[IVXLC]{1,5})\.$", r"[ \t]"),
    ],
    "en": [
        # a street ends a sentence before upper case, a saint does not
        (True, r"\p{Lu}[\p{L}'’-]+\s(?:St|Rd|Ave|Sq)\.$", r"\s+[\"'“‘«(\[]?\p{Lu}"),
        # abbreviated "number" before its number
        (False, r"\b(?:[Nn]os?|[Aa]rt|[Pp]ar|[Vv]ol|[Pp]p?|[Ff]ig|[Cc]h|[Cc]a|[Vv]ers)\.$", r"\s*[\d#ivxlc]"),
        _short("en"),
        # a quotation belongs to the sentence that says who spoke
        (False, _QUOTED, rf",?\s+{_SPEAKER}\s+(?:{_SAID})\b"),
        (False, _QUOTED, rf",?\s+(?:{_SAID})\s+(?:{_SPEAKER}|\p{{Ll}})"),
    ],
    "de": [
        # ordinals before a month
        (False, r"\b\d{1,2}\.$", rf"\s+(?:{_MONTHS})\b"),
        (False, r"\b(?:[Nn]r|[Aa]rt|[Bb]d|[Ss]|[Cc]a|[Kk]ap|[Aa]bb)\.$", r"\s*[\d#ivxlc]"),
        _short("de"),
        (False, r"(?<![\p{L}\p{N}'’])[zdubosv]\.$", r"\s+\p{L}"),
    ],
    "fr": [(False, r"\b(?:[Nn]os?|[Aa]rt|[Vv]ol|[Pp]p?|[Cc]h|[Vv]ers)\.$", r"\s*[\d#ivxlc]"), _short("fr")],
    "es": [(False, r"\b(?:[Nn]úm|[Aa]rt|[Vv]ol|[Pp]p?|[Cc]ap)\.$", r"\s*[\d#ivxlc]"), _short("es")],
    "it": [(False, r"\b(?:[Nn]|[Aa]rt|[Vv]ol|[Pp]p?|[Cc]ap)\.$", r"\s*[\d#ivxlc]"), _short("it")],
    "pt": [(False, r"\b(?:[Nn]|[Aa]rt|[Vv]ol|[Pp]p?|[Cc]ap)\.$", r"\s*[\d#ivxlc]"), _short("pt")],
    "nl": [(False, r"\b(?:[Nn]r|[Aa]rt|[Bb]lz|[Pp]p?|[Hh]fdst)\.$", r"\s*[\d#ivxlc]"), _short("nl")],
    "latin": [
        # initials
        (False, r"(?<![\p{L}\p{N}'’])(?:\p{Lu}\.(?:[ -]?\p{Lu}\.)*)$", r"\s*[\p{Lu}\p{N}]"),
        # quotations go on after a dash or in lower case
        (False, r"[?!….]$", r"\s+[—–-]\s+\p{Ll}"),
        # a closing guillemet that stands apart belongs to the end
        (False, r"", r"[   ]+[»!?]"),
        (False, r"", rf"\s*{_CLOSE}*\s+[\"'“‘«(\[]?\p{{Ll}}"),
        (False, r"", r"\s*[,;:]"),
        # "?" and "!" inside brackets or before more of the same
        (False, r"[\p{L}\p{N}]\.$", r"[\p{L}\p{N}]"),
        (False, r"(?:^|\s)\.\.\.?\.?$|(?:^|\s)…$", r"\s*[\p{Ll}]"),
        (True, r"", r"\s"),
    ],
    "cjk first": [
        # an ellipsis only pauses
        (False, r"…$|・・・$|\.\.\.$", r""),
    ],
    # a quotation with the particle or the speaker that belongs to it
    "ja": [(False, r"[。！？!?…][」』”’]+$", r"\s*(?:と|って|との|という|などと|とか)")],
    "zh": [
        (True, r"[：:，,][“‘「『][^“”「」]*[。！？!?…]+[”’」』]+$", r""),
        (False, r"[。！？!?…]+[”’」』]+$", r"\s*[^。！？!?“”「」\n]*(?:问道|说道|答道|喊道|叫道|问|说|道|喊)[，,。！]"),
    ],
    "cjk": [(True, r"", r"")],
    "hi": [
        _short("hi"),
        (False, r"(?<![\p{L}\p{M}])[\p{L}]\p{M}*\.$", r"\s*[\p{L}]"),
        (False, rf"[।?!…]{_CLOSE}+$", r"\s+[^।?!“”\n]+(?:पूछा|कहा|बोला|बोली|बोले|चिल्लाया|चिल्लाई|जवाब दिया|उत्तर दिया)\s*[।!?]"),
    ],
    "ar": [
        _short("ar"),
        (False, rf"[.؟?!…]{_CLOSE}+$", r"\s+(?:سأل|سألت|قال|قالت|صاح|صاحت|أجاب|أجابت|رد|ردت|همس|همست|هتف|نادى|تساءل)\b"),
    ],
    "ru": [
        _short("ru"),
        (False, r"(?<![\p{L}\p{N}])\p{Lu}\.$", r"\s*\p{Lu}"),
        (False, r"[?!….][»“”\"]*$", r"\s+[—–-]\s+\p{Ll}"),
        (False, r"", r"\s*[»“”)\]]*\s+[«“„\"(]?\p{Ll}"),
    ],
    "el": [
        _short("el"),
        (False, r"(?<![\p{L}\p{N}])\p{Lu}\.$", r"\s*\p{Lu}"),
        (False, r"", r"\s*[»“”)\]]*\s+[«“„\"(]?\p{Ll}"),
    ],
    "th": [
        (False, r"\p{N}$", r"\s"),
        (False, r"", r"\s*\p{N}"),
        (False, rf"(?:\b(?:{_ABBREVIATIONS['th']})\.)$", r"\s"),
    ],
    "spaced": [
        (False, r"\.$", r"[\p{L}\p{N}]"),
        (False, r"", r"\s*[,;:،؛]"),
        (True, r"", r"\s"),
    ],
    # signs that end a sentence whether or not a space follows
    "signs": [
        (False, r"[.?!]$", r"\S"),
        (False, r"", r"\s*[།༎]"),
        (True, r"", r""),
    ],
}
#: The tables of each writing system in order; None stands for the language's.
CASCADES: dict[str, tuple[str | None, ...]] = {
    "latin": ("latin first", None, "latin"), "cjk": ("cjk first", None, "cjk"), "devanagari": ("hi", "spaced"), "arabic": ("ar", "spaced"), "cyrillic": ("ru", "spaced"), "greek": ("el", "spaced"), "thai": ("th", "spaced"),
    "hebrew": ("spaced",), "armenian": ("spaced",), "khmer": ("signs",), "tibetan": ("signs",), "ethiopic": ("signs",), "myanmar": ("signs",),
}
LANGUAGES = {"latin": tuple(_FREQUENT), "cjk": ("ja", "zh")}
_BLANK = r"[^\S\n\r ]"
_BLOCK = regex.compile(rf"(?:\r\n|\n|\r| ){_BLANK}*(?:(?:\r\n|\n|\r| ){_BLANK}*)+| ")
_STOPS = regex.compile(rf"(?:[.!?…؟۔।॥։។៕៚༎།።፧፨]|(?<=\p{{Greek}})[;;]|\p{{Thai}}(?=[ \t ]))+(?:{_CLOSE}|(?<=[.!?…])[   ]»)*|[。！？…｡．]+[！？。…]*[」』”’）】\"]*")
_SCRIPT = (
    ("cjk", regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}。！？「」『』]")), ("devanagari", regex.compile(r"[\p{Devanagari}]")), ("arabic", regex.compile(r"[\p{Arabic}]")), ("cyrillic", regex.compile(r"[\p{Cyrillic}]")), ("thai", regex.compile(r"[\p{Thai}]")), ("greek", regex.compile(r"[\p{Greek}]")),
    ("hebrew", regex.compile(r"[\p{Hebrew}]")), ("armenian", regex.compile(r"[\p{Armenian}]")), ("khmer", regex.compile(r"[\p{Khmer}]")), ("tibetan", regex.compile(r"[\p{Tibetan}]")), ("ethiopic", regex.compile(r"[\p{Ethiopic}]")), ("myanmar", regex.compile(r"[\p{Myanmar}]")), ("latin", regex.compile(r"[\p{L}]")),
)
_LATIN_WORD = regex.compile(r"\p{Latin}+")
_HAN, _KANA = regex.compile(r"\p{Han}"), regex.compile(r"[\p{Hiragana}\p{Katakana}]")


def language(text: str) -> dict[str, str | None]:
    """Of the Latin and the Han part of a text: the language whose frequent words or signs are most, None where none clearly is."""
    seen = set(_LATIN_WORD.findall(text.lower()))
    hits = sorted(((len(seen & words), name) for name, words in _WORDS.items()), reverse=True)
    latin = hits[0][1] if hits[0][0] >= 4 and hits[0][0] >= 2 * hits[1][0] else None
    cjk = ("ja" if _KANA.search(text) else "zh") if _HAN.search(text) or _KANA.search(text) else None
    return {"latin": latin, "cjk": cjk}


_WORDS = {k: frozenset(v.split()) for k, v in _FREQUENT.items()}


@cache
def _compiled(script: str, lang: str | None) -> dict[str, list]:
    """The rules of a cascade by the last character before a candidate: those that need a full stop stand only under it. Neighbouring rules of one verdict are one pattern."""
    names = [n for c in CASCADES[script] for n in ([c] if c else [lang] if lang else LANGUAGES[script])]
    rules = [r for n in names for r in RULES[n]]

    def make(rs: list) -> list:
        out: list = []
        for verdict, before, after in rs:
            one = (rf"(?<={before.replace('$', '')})" if before else "") + f"(?:{after})"
            if out and out[-1][0] == verdict:
                out[-1][1].append(one)
            else:
                out.append((verdict, [one]))
        return [(verdict, regex.compile("|".join(ps))) for verdict, ps in out]

    top = lambda x: regex.sub(r"\((?:[^()]|(?R))*\)", "", x)
    return {".": make(rules), "": make([r for r in rules if not (r[1].endswith(r"\.$") and "|" not in top(r[1]))])}


def _script(text: str, at: int, start: int) -> str:
    """The writing system of the last letter or full stop before the candidate."""
    for k in range(at - 1, start - 1, -1):
        c = text[k]
        if c < "ɐ":
            if c.isalpha():
                return "latin"
            continue
        for name, pattern in _SCRIPT:
            if pattern.match(c):
                return name
    return "latin"


def _breaks(text: str, start: int, at: int, end: int, langs: dict[str, str | None]) -> bool:
    name = _script(text, at, start)
    for verdict, pattern in _compiled(name, langs.get(name))["." if text[at - 1] == "." else ""]:
        if pattern.match(text, at, end):
            return verdict
    return False


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) in code points of every sentence; white space about them is left out."""
    out: list[tuple[int, int]] = []
    langs = language(text)

    def add(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))

    edges = [0]
    for m in _BLOCK.finditer(text):
        edges += [m.start(), m.end()]
    edges.append(len(text))
    for lo, hi in zip(edges[::2], edges[1::2], strict=True):
        a = lo
        for m in _STOPS.finditer(text, lo, hi):
            at = m.end()
            if at < hi and _breaks(text, lo, at, hi, langs):
                add(a, at)
                a = at
        add(a, hi)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, no, first, last = [], [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for k, (x, y) in enumerate(sentences(t)):
                ids.append(i)
                no.append(k)
                first.append(x)
                last.append(y)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "sent_no": pa.array(no, pa.int32()), "sent_start": pa.array(first, pa.int32()), "sent_end": pa.array(last, pa.int32())})


def split(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sent_no, sent_start, sent_end) of every sentence, as code points of the text.

    Null and blank texts have no rows. Equal rows give equal rows. Language labels, which may be missing or wrong, are not used: the text itself tells its language.
    """
    src = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return spread(src).mapInArrow(_scan, OUT)


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_end) of every sentence."""
    return split(docs).select("doc_id", "sent_end")
