"""Problem 3: broken question and answer pairs.

Ordered rules over built-in expressions: emptiness, copied question, refusal phrases in several languages, script and language mismatch,
unclosed delimiters and abrupt endings. Every triggered type is emitted with its rank; ``found`` keeps the first of each
answer. One rule is learned from all texts: an answer without final stop is abrupt if its last word is known from no other place, is one that hardly ever
closes a sentence, or is very rare beside a word that it begins. All of these compare counts with each other, so more text does not change the verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.session import by_key

DEFECTS = ("empty", "copied_question", "refusal", "other_language", "truncated")

#: Contents without content, after white space, brackets, quotes and signs are taken off.
HOLLOW = ("", "na", "none", "null", "nil", "nan", "answer", "response", "antwort", "reponse", "réponse", "respuesta", "ответ", "undefined", "noanswer", "empty", "blank", "tbd", "todo")
#: Lead-ins that may stand before a question that is given back.
LEAD = r"^(the)?(question|answer|response|q|a|youasked|frage|antwort|pregunta|respuesta|réponse|ответ|вопрос)?(question|answer)?"
#: Refusals, in lower case, at the start of a sentence.
REFUSALS = (
    r"(sorry|unfortunately|i('|’)?m sorry|i am sorry|apologies|i apologi[sz]e)?[,.!]?\s*(but )?(this|that|it|the question|your question) (cannot|can not|can(’|')t|could not) be (answered|determined|settled)",
    r"(i('|’)?m|i am) (afraid|sorry)[, ]+(but |that )?i (must|have to|need to|cannot|can(’|')t|can not|am unable to|am not able to|won(’|')t) (decline|refuse|answer|respond|help|say|tell|assist|provide|discuss)",
    r"(sorry|unfortunately)[, ]+(but )?(i (cannot|can(’|')t|am unable to|am not able to)|the (retrieved |supplied |given |provided )?(sections|passages|texts?|excerpts) (are|is) silent|there is (not enough|no))",
    r"i (must|have to) (decline|refuse)( to)? (answer|respond|say|comment)",
    r"i (can(’|')t|cannot|can not|am unable to|am not able to) (tell|say|answer|determine|respond|help|provide|discuss|assist|comply)( (this|that|it|the question))?( with (this|that))?( (from|based|to|on|because|given|without|here)|[.,]|$)",
    r"i (do not|don(’|')t) have (sufficient|enough|any|adequate) (information|context|evidence|details|data)",
    r"i (do not|don(’|')t) know( the answer)?[.]?$",
    r"(there is|there(’|')s|there are) (not enough|insufficient|no|not sufficient)( \w+){0,2} (information|context|evidence|in the|to (say|tell|answer))",
    r"(insufficient|not enough) (information|context|evidence)",
    r"i(('|’)d| would)? (would )?(rather|prefer) not (to )?(speculate|answer|say|guess|comment|discuss)",
    r"(that|this|it|the question) (falls|lies|is) (outside|beyond) (of )?(what|my|the scope)",
    r"(as|being) an? [\w ]{1,40}?,? ?i(('|’)m| am)? (not able|unable|cannot|can(’|')t|not allowed|not permitted)",
    r"no (answer|conclusion|statement) (can|could) be (drawn|found|given|derived|made)",
    r"the (supplied |retrieved |given |provided )?(passages|sections|texts?|excerpts|evidence|context|sources?) (supplied |given |provided |at hand )?(do|does) not (settle|say|answer|mention|contain|state|tell|provide|allow)",
    r"the (supplied |retrieved |given |provided )?(passages|sections|texts?|excerpts) (are|is) silent",
    r"(dazu|hierzu|darüber|dazu leider) (kann|darf|möchte) ich (leider )?(keine|nichts)",
    r"(das|dies|die frage|diese frage)( \w+){0,2} (lässt|laesst|kann|läßt)( \w+){0,6} nicht (beantwort|sagen|beurteil|entscheid)",
    r"(ich kann|leider kann ich)( \w+){0,5} nicht (beantworten|sagen|helfen)",
    r"(es tut mir leid|leider)[, ]",
    r"(désolée?|je regrette|malheureusement)[, ]",
    r"je ne (suis pas (en mesure|capable|autorisée?)|peux pas|sais pas|dispose pas|puis pas)",
    r"les (passages|extraits|textes)( \w+){0,2} ne permettent pas",
    r"il (est|m(’|')est) impossible de (répondre|dire)",
    r"(lo siento|lo lamento|disculpe|lamentablemente|por desgracia)[, ]",
    r"no (puedo|es posible|se puede|dispongo|tengo)( \w+){0,3} (responder|contestar|decir|decirlo|información)",
    r"(el|los|la|las) (textos?|pasajes?|fragmentos?)( \w+){0,2} no (bastan?|permiten?|alcanzan?|dicen?|mencionan?)",
    r"(к сожалению|извините|я не могу (ответить|сказать))",
    r"(mi dispiace|purtroppo|não posso|desculpe|helaas|ik kan (dat|deze|die) )",
    r"(申し訳|お答えできません|回答できません|抱歉|对不起，我|无法回答|很遗憾)",
    r"(क्षमा करें|माफ़ कीजिए|खेद है)",
    r"(عذرا|عذراً|للأسف|لا أستطيع الإجابة)",
    r"(ขออภัย|ไม่สามารถตอบ)",
)
#: Frequent short words by language.
FUNCTION_WORDS = {
    "en": "the a an of and was were is are to with at which what who why how did does do where when that this his her he she it in on by from for but until because while after before near into beneath page pages so not you tell me about us",
    "de": "der die das und ist nicht wo wer warum hat dem den des ein eine einen im am zum zur mit von auf um nach vor bei sich er sie es wie was wann zu ging kam sah sagte fragte schon niemand sein ihre herr frau kostete",
    "fr": "le la les et est un une des du de au aux qui que où pourquoi dans ne pas se sa son ses il elle à ce cette avec par sur vers avant après personne était était-il comment mon ma encore quand quoi m mme",
    "it": "il lo gli le e è un una di del della al che chi dove perché per con non si suo sua nel nella era ma più da dal questo questa come quando",
    "pt": "o os as e é um uma de do da ao que quem onde por para com não se seu sua no na era mas mais este esta como quando",
    "nl": "de het een en is niet wie waar waarom van met op in aan bij naar voor zijn haar hij zij was dat maar toen deze dit hoe wat",
    "es": "el la los las y es un una de del al que quién qué dónde por para con sin en no su sus se vio antes después nadie como cómo lo le él ella sr sra doña don cuando más volvió está este esta",
}
#: Abbreviations that cannot close a text.
ABBREVIATIONS = r"(?i)(^|[^\p{L}])(mr|mrs|ms|dr|prof|capt|st|rev|sr|sra|nr|núm|mme|m|z|b|p|pp|ex|ch|vol|fig|vs|cf|e\.g|i\.e|approx|no)\.$"
#: A word that closes a sentence more rarely than this share does not close one; ``DOUBT`` closings are added to those seen, so that a few sightings prove nothing.
RARE, DOUBT = 0.01, 0.4
#: A last word more than this many times rarer than a longer word that it begins is that word cut off.
CUT_OFF = 1000
#: A refusal counts if what is said before it is less than this share of all that the answer says.
PREFACE = 0.5
SCRIPTS = {"kana": r"[\p{IsHiragana}\p{IsKatakana}]", "han": r"\p{IsHan}", "hangul": r"\p{IsHangul}", "cyrillic": r"\p{IsCyrillic}", "arabic": r"\p{IsArabic}", "devanagari": r"\p{IsDevanagari}", "thai": r"\p{IsThai}", "greek": r"\p{IsGreek}", "hebrew": r"\p{IsHebrew}"}
QUOTED = r"«[^«»]*»|„[^„“”]*[“”]|“[^“”]*”|\"[^\"]*\"|「[^」]*」"
CITATION = r"\[?\(?\b(pages?|p|pp)\.?\s*\d+(\s*[-–—]\s*\d+)?[\])]?|\[\d+\]"
BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}\p{Cf}]"
STOP = r"[.!?。！？।؟]"
CLOSERS = r"[\"'”’»)\]}」』›“*_\s\p{Z}]*"


def _trim(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"^{BLANK}+|{BLANK}+$", "")


def _bare(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def script(c: Column) -> Column:
    """The script of most letters: latin unless another one has three in ten of them (kana counts together with han)."""

    def of(x: Column) -> Column:
        def told(letters: Column) -> Column:
            out = F.lit("latin")
            for name, pattern in reversed(SCRIPTS.items()):
                out = F.when(F.regexp_count(x, F.lit(pattern)) >= letters * (0.1 if name == "kana" else 0.3), F.lit(name)).otherwise(out)
            return out

        return F.when(x.rlike(r"[\u0370-\uffff&&\p{L}]"), let(F.greatest(F.regexp_count(x, F.lit(r"\p{L}")), F.lit(1)), told)).otherwise("latin")

    return let(c, of)


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}]+)"), F.lit(1))


def hits(words: Column) -> Column:
    """How many different frequent words of each language occur, in the order of FUNCTION_WORDS."""
    some = lambda xs: F.array(*[F.lit(x) for x in xs])
    every = some(dict.fromkeys(x for v in FUNCTION_WORDS.values() for x in v.split()))
    return let(F.array_intersect(every, words), lambda w: F.array(*[F.size(F.array_intersect(some(v.split()), w)) for v in FUNCTION_WORDS.values()]))


def language(hits_: Column) -> Column:
    """The Latin-script language with most hits, null where there are none or in a tie."""

    def of(h: Column) -> Column:
        top = F.array_max(h)
        out = F.lit(None).cast("string")
        for k, name in enumerate(FUNCTION_WORDS):
            out = F.when(h[k] == top, F.lit(name)).otherwise(out)
        return F.when((top >= 1) & (F.size(F.filter(h, lambda x: x == top)) == 1), out)

    return let(hits_, of)


def arms(results: DataFrame, key: str = "result_key") -> DataFrame:
    """One row per record key and arm, with the question, whether it can be answered, and the answer."""
    one = results.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("result_key"),
        F.coalesce(F.col("question"), F.lit("")).alias("question"),
        (F.coalesce(F.col("unanswerable"), F.lit(False)) | (F.coalesce(F.col("category"), F.lit("")) == "unanswerable") & F.col("unanswerable").isNull()).alias("unanswerable"),
        F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"{a}.answer").alias("answer")) for a in ("story_only", "hybrid")])).alias("x"),
    )
    return by_key(one.select("result_key", "question", "unanswerable", "x.arm", "x.answer"), "result_key").dropDuplicates(["result_key", "arm"])


def last_token(c: Column) -> Column:
    return F.element_at(F.split(c, r"\s+"), -1)


def word_endings(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(last_word, seen, closing) over all texts: how often a word stands before more text, and how often of these it closes a sentence or stands before a citation.

    Tokens are counted as they stand, and taken apart once for each different token.
    """
    word = r"[\p{L}\p{N}'’-]+"
    both = answers.select(F.col("answer").alias("x"), F.lit(1).alias("answer")).unionByName(questions.select(F.col("question").alias("x"), F.lit(0).alias("answer")))
    text = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("x", F.lit(""))), rf"{BLANK}+$", ""), r"\s+(?=\[page|\(p)", ".")
    # the last word of a text may be cut off and is no evidence
    kept = lambda a: F.when(F.element_at(a, -1).rlike(rf"{word}[\"”’»…]*$"), F.slice(a, 1, F.size(a) - 1)).otherwise(a)
    counted = both.select(F.explode(let(F.split(text, r"\s+"), kept)).alias("t"), "answer").groupBy("t", "answer").agg(F.count("*").alias("n"))
    closes = rf"({word})(?=[.!?…][\"”’»)\]\[(]|[.!?…]$)"
    each = counted.select("n", "answer", F.regexp_extract_all("t", F.lit(f"({word})"), F.lit(1)).alias("w"), F.regexp_extract_all("t", F.lit(closes), F.lit(1)).alias("c"))
    zero = F.lit(0).cast("bigint")
    row = lambda seen, closing: lambda w: F.struct(w.alias("last_word"), seen.alias("seen"), closing.alias("closing"))
    rows = F.concat(F.transform("w", row(F.col("n"), zero)), F.when(F.col("answer") == 1, F.transform("c", row(zero, F.col("n")))).otherwise(F.array()))
    return each.select(F.explode(rows).alias("r")).groupBy("r.last_word").agg(F.sum("r.seen").alias("seen"), F.sum("r.closing").alias("closing"))


def with_longer(counts: DataFrame) -> DataFrame:
    """counts with longer: the count of the most frequent word that the word begins, 0 if there is none."""
    n, zero = F.col("seen") + F.col("closing"), F.lit(0).cast("bigint")
    begins = F.transform(F.sequence(F.lit(1), F.greatest(F.length("last_word") - 1, F.lit(1))), lambda i: F.struct(F.left("last_word", i).alias("last_word"), zero.alias("seen"), zero.alias("closing"), F.when(i < F.length("last_word"), n).otherwise(0).alias("longer")))
    rows = F.concat(F.array(F.struct("last_word", "seen", "closing", zero.alias("longer"))), begins)
    return counts.select(F.explode(rows).alias("r")).groupBy("r.last_word").agg(F.sum("r.seen").alias("seen"), F.sum("r.closing").alias("closing"), F.max("r.longer").alias("longer"))


def signals(pairs: DataFrame) -> DataFrame:
    """pairs with one boolean a defect type but truncated, and what that one needs."""
    t = pairs.withColumn("t", _trim(F.col("answer"))).withColumn("q", _trim(F.col("question")))
    t = t.withColumn("bare", _bare(F.col("t"))).withColumn("bare_q", _bare(F.col("q")))
    t = t.withColumn("empty", F.col("bare").isin(*HOLLOW))
    near = lambda x: (F.col("bare_q") != "") & (F.abs(F.length(x) - F.length("bare_q")) <= F.length("bare_q") / 10 + 1) & (F.levenshtein(x, F.col("bare_q")) <= F.length("bare_q") / 10 + 1)
    # only an answer about as long as its question can give it back, with a lead-in or twice
    might = (F.length("bare") <= 2 * F.length("bare_q") + 40) & (F.length("bare") * 2 >= F.length("bare_q"))
    twice = F.col("bare") == F.concat("bare_q", "bare_q")
    t = t.withColumn("copied_question", ~F.col("empty") & might & (near(F.col("bare")) | near(F.regexp_replace("bare", LEAD, "")) | twice & (F.col("bare_q") != "")))
    # what the answer says itself, without quotations and citations
    quoted = F.when(F.col("t").rlike(r"[«„“\"「]"), F.regexp_replace("t", QUOTED, " ")).otherwise(F.col("t"))
    t = t.withColumn("said", F.regexp_replace(quoted, "(?i)" + CITATION, " "))
    t = t.withColumn("low", F.lower("said"))
    first = F.trim(F.regexp_replace(F.regexp_replace("low", r"^\W*(you asked (about|whether|if|me)?[^.?!]*[.?!]?|(answer|antwort|réponse|respuesta)\W*)\s*", ""), r"^[\s*_>#\-–—\"“”«»„:.]+", ""))
    refusal = "(?:" + "|".join(REFUSALS) + ")"
    # what stands before the first sentence that refuses; the whole text where none does
    before = F.regexp_replace("low", rf"(?s)(?<=[.?!])\s+{refusal}.*$", "")
    late = let(before, lambda b: (b != F.col("low")) & (F.length(b) <= F.length("low") * PREFACE))
    t = t.withColumn("declines", ~F.col("empty") & (first.rlike(f"^{refusal}") | F.col("low").rlike(r"[.?!]\s") & late))
    t = t.withColumn("refusal", F.col("declines") & ~F.col("unanswerable"))
    # to decline what cannot be answered is right, however it is put
    t = t.withColumn("judged", ~F.col("empty") & ~(F.col("declines") & F.col("unanswerable")))
    t = t.withColumn("script_said", script(F.col("said"))).withColumn("script_q", script(F.col("q")))
    t = t.withColumn("script_a", F.when(F.col("script_said") == "latin", script(F.col("t"))).otherwise(F.col("script_said")))
    t = t.withColumn("own_words", F.regexp_extract_all("low", F.lit(r"(\p{L}+)"), F.lit(1)))
    t = t.withColumn("hits_q", hits(_words(F.col("q")))).withColumn("hits", hits(F.when(F.size("own_words") < 4, _words(F.col("t"))).otherwise(F.col("own_words"))))
    t = t.withColumn("lang_q", F.coalesce(language(F.col("hits_q")), F.lit("en"))).withColumn("lang_a", language(F.col("hits")))
    own = F.element_at("hits", F.array_position(F.array(*[F.lit(x) for x in FUNCTION_WORDS]), F.col("lang_q")).cast("int"))
    most = F.array_max("hits")
    # most letters of the answer itself; a text with a heading of its own (a name and a dash) counts without it
    few = F.col("said").rlike(r"\p{L}\W*$") & (F.size("own_words") < 4)
    other = (F.col("script_a") != F.col("script_q")) & (few | (F.col("script_said") != "latin")) | (F.col("script_a") == "latin") & (F.col("script_q") == "latin") & (most >= 2) & (most > 2 * own)
    t = t.withColumn("other_language", F.col("judged") & other)
    # abrupt endings: a bracket or quotation mark that is not closed, or no stop
    t = t.withColumn("body", F.regexp_replace("t", r"[*_]+$", ""))
    t = t.withColumn("end", last_token(F.col("body")))
    # whole quotations are taken out before an open one is looked for
    bare = F.when(F.col("body").rlike(r"[“„«「]"), F.regexp_replace("body", QUOTED, " ")).otherwise(F.col("body"))
    dots = F.col("body").rlike(r"(\.\.\.|…)" + CLOSERS + "$")
    stopped = F.col("body").rlike(STOP + CLOSERS + "$") & ~F.col("end").rlike(ABBREVIATIONS) & ~dots | F.col("end").rlike(r"[)\]」』]$")
    t = t.withColumn("stopped", stopped)
    # quotations within quotations are not told apart, so a stop ends the text even if a mark seems open
    unclosed = F.col("body").rlike(r"[\[(“„«「]") & (F.col("body").rlike(r"[\[(][^\])]*$") | ~F.col("stopped") & bare.rlike(r"[“„«「]"))
    t = t.withColumn("unclosed", unclosed).withColumn("dots", dots)
    t = t.withColumn("last_word", F.when(F.col("judged") & ~F.col("stopped"), F.lower(F.regexp_extract("end", r"([\p{L}\p{N}'’-]+)[\"”’»…]*$", 1))))
    t = t.withColumn("named", F.col("last_word").isNotNull() & F.col("body").rlike(r"^[\"“]?(\p{Lu}[\p{L}'’.-]*\s*){1,5}$"))
    return t.withColumn("brief", (F.size(F.split("body", r"\s+")) <= 5) & ~F.col("body").contains("\n"))


def defects(results: DataFrame, key: str = "result_key") -> DataFrame:
    """(result_key, arm, defect, rank): every triggered defect type of each answer, rank 1 first; an answer may have several.

    A null struct, answer, blank or hollow answer is empty and nothing else. Declining is no defect where unanswerable is true (null: only if the category is "unanswerable"), whatever its form.
    A null question cannot be copied and counts as English. Keys delivered again count once; null keys are left out.
    """
    pairs = arms(results, key)
    t = signals(pairs).select("result_key", "arm", *DEFECTS[:-1], "judged", "unclosed", "stopped", "dots", "named", "brief", "lang_a", "last_word")
    t = t.join(with_longer(word_endings(pairs, results.select("question"))), "last_word", "left")
    n = F.col("seen") + F.col("closing")
    open_word = F.col("closing") + DOUBT < F.when(F.col("brief"), RARE / 10).otherwise(RARE) * F.col("seen")
    cut_off = F.coalesce(F.col("longer") > CUT_OFF * n, F.lit(False))
    whole = F.coalesce(n > 0, F.lit(False)) & ~F.coalesce(open_word, F.lit(False)) & ~cut_off & (~F.col("dots") | F.coalesce(F.col("lang_a") == "fr", F.lit(False))) | F.col("named") & ~F.col("dots")
    t = t.withColumn("truncated", F.col("judged") & (F.col("unclosed") | ~F.col("stopped") & ~whole))
    triggered = F.filter(F.array(*[F.when(F.col(d), F.lit(d)) for d in DEFECTS]), lambda x: x.isNotNull())
    return t.select("result_key", "arm", F.posexplode(triggered).alias("rank", "defect")).select("result_key", "arm", "defect", (F.col("rank") + 1).alias("rank"))


def found(results: DataFrame, key: str = "result_key") -> DataFrame:
    """(result_key, arm, defect): the first defect of each defective answer."""
    return defects(results, key).filter("rank = 1").select("result_key", "arm", "defect")
