"""Word and character error rates over corpora: normalisers, tokenisers, skipped references, rates per slice.

Every row carries its own distance and reference length, so rates of any slice are sums that combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions import text_udf as U
from evalspark.functions.spoken_chinese import spoken_numerals
from evalspark.functions.spoken_english import spoken_numbers
from evalspark.functions.text import CJK, let, squeeze, strip, words

# Fillers and placeholders of references, contractions and titles of English.
FILLER_CHARS = "呃啊嗯唉诶哦噢哈呀哼额"
FILLER_WORDS = ("hmm", "mm", "mhm", "mmm", "uh", "um", "uhhuh", "huh", "aha")
PLACEHOLDERS = ("xxx", "x", "xx", "unk", "spn", "garbage")
CONTRACTIONS = (
    ("\\bwon't\\b", "will not"), ("\\bcan't\\b", "can not"), ("\\blet's\\b", "let us"), ("\\bain't\\b", "aint"), ("\\by'all\\b", "you all"),
    ("\\bwanna\\b", "want to"), ("\\bgotta\\b", "got to"), ("\\bgonna\\b", "going to"), ("\\bi'ma\\b", "i am going to"), ("\\bimma\\b", "i am going to"),
    ("\\bwoulda\\b", "would have"), ("\\bcoulda\\b", "could have"), ("\\bshoulda\\b", "should have"), ("\\bma'am\\b", "madam"),
    ("\\bmr\\b", "mister "), ("\\bmrs\\b", "missus "), ("\\bst\\b", "saint "), ("\\bdr\\b", "doctor "), ("\\bprof\\b", "professor "),
    ("\\bcapt\\b", "captain "), ("\\bgov\\b", "governor "), ("\\bald\\b", "alderman "), ("\\bgen\\b", "general "), ("\\bsen\\b", "senator "),
    ("\\brep\\b", "representative "), ("\\bpres\\b", "president "), ("\\brev\\b", "reverend "), ("\\bhon\\b", "honorable "), ("\\basst\\b", "assistant "),
    ("\\bassoc\\b", "associate "), ("\\blt\\b", "lieutenant "), ("\\bcol\\b", "colonel "), ("\\bjr\\b", "junior "), ("\\bsr\\b", "senior "), ("\\besq\\b", "esquire "),
    ("'d been\\b", " had been"), ("'s been\\b", " has been"), ("'d gone\\b", " had gone"), ("'s gone\\b", " has gone"), ("'d done\\b", " had done"), ("'s got\\b", " has got"),
    ("n't\\b", " not"), ("'re\\b", " are"), ("'s\\b", " is"), ("'d\\b", " would"), ("'ll\\b", " will"), ("'t\\b", " not"), ("'ve\\b", " have"), ("'m\\b", " am"),
)
#: Where the standard tokeniser of machine translation sets blanks (fixed values).
SPLITS = (("([{-~\\[-` -&(-+:-@/])", " $1 "), ("([^0-9])([.,])", "$1 $2 "), ("([.,])([^0-9])", " $1 $2"), ("([0-9])(-)", "$1 $2 "))


def normalize_english(text: Column, spellings: dict[str, str] | None = None) -> Column:
    """Lower case, bracketed parts and fillers dropped, contractions and titles written out, diacritics and symbols
    dropped but for those of numbers, spelled-out numbers as figures, words spelled as `spellings` has them (a table of
    British by American spellings, say, which the library doesn't hold)."""
    t = F.lower(text)
    for pattern, by in (("[<\\[][^>\\]]*[>\\]]", ""), ("\\([^)]+?\\)", ""), ("（[a-z A-Z]+?）", ""), ("\\b(hmm|mm|mhm|mmm|uh|um)\\b", ""), ("\\s+'", "'"), *CONTRACTIONS, ("(\\d),(\\d)", "$1$2"), ("\\.([^0-9]|$)", " $1")):
        t = F.regexp_replace(t, pattern, by)
    t = F.regexp_replace(U.unmarked(t), "(?![.%$¢€£])[\\p{M}\\p{S}\\p{P}]", " ")
    t = spoken_numbers(spellings)(t)
    t = F.regexp_replace(F.regexp_replace(t, "[.$¢€£]([^0-9])", " $1"), "([^0-9])%", "$1 ")
    return F.regexp_replace(t, "\\s+", " ")


def normalized(text: Column, language: str = "en", spellings: dict[str, str] | None = None) -> Column:
    """What a language's rates compare: English normalisation, and for Chinese figures as they are said."""
    t = normalize_english(text, spellings)
    return spoken_numerals(t) if language in ("zh", "yue") else t


def translation_tokens(text: Column, chinese: bool = False) -> Column:
    """Tokens of the standard tokeniser of machine translation; CJK characters on their own if asked for."""
    t = F.replace(F.regexp_replace(F.regexp_replace(text, "<skipped>|-\\n", ""), "\\n", " "), F.lit("&quot;"), F.lit('"'))
    for mark, by in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(mark), F.lit(by))
    t = F.concat(F.lit(" "), F.regexp_replace(t, f"({CJK})", " $1 ") if chinese else t, F.lit(" "))
    for pattern, by in SPLITS:
        t = F.regexp_replace(t, pattern, by)
    return words(t)


def bare_tokens(text: Column, language: str) -> Column:
    """Words without punctuation but for apostrophes, in lower case; characters for languages written without blanks."""
    t = F.regexp_replace(text, "(?!')[\\p{P}!-/:-@\\[-`{-~]", "")
    return F.filter(F.split(t, ""), lambda c: strip(c) != "") if language in ("zh", "ja", "yue", "th", "ko") else words(F.lower(t))


def practice_tokens(text: Column, language: str = "en", spellings: dict[str, str] | None = None) -> Column:
    """Tokens of a normalised text; Chinese characters on their own."""
    return translation_tokens(F.lower(normalized(text, language, spellings)), language in ("zh", "yue"))


def practice(rows: DataFrame, reference: str, hypothesis: str, language: str = "en", spellings: dict[str, str] | None = None) -> DataFrame:
    """rows with skipped (why the reference can't be scored, or null), and of the others errors and n, by the language's
    normalisation and tokens: all that its rates are made of."""
    tokens = lambda c: practice_tokens(F.col(c), language, spellings)
    why = rows.withColumn("skipped", skip_reason(F.col(reference), language))
    # of a skipped reference nothing is compared
    r, h = (F.when(F.col("skipped").isNull(), tokens(c)) for c in (reference, hypothesis))
    scored = why.withColumn("_e", parts(r, F.coalesce(h, F.array().cast("array<string>"))))
    return scored.withColumns({c: F.when(F.col("skipped").isNull(), F.col(f"_e.{c}")) for c in ("errors", "n")}).drop("_e")


def skip_reason(reference: Column, language: str = "en") -> Column:
    """Why a reference can't be scored: placeholder_ref, filler_only, or null if it can."""
    bare = strip(F.regexp_replace(F.lower(reference), "[\\p{P}!-/:-@\\[-`{-~]", ""))
    every = lambda toks, good: (F.size(toks) > 0) & F.forall(toks, good)
    odd = lambda w: w.isin(*PLACEHOLDERS) | w.rlike("^x+$")
    if language in ("zh", "yue"):
        compact = F.replace(bare, F.lit(" "), F.lit(""))
        placeholder, filler = (compact != "") & odd(compact), compact.rlike(f"^[{FILLER_CHARS}]+$")
    else:
        placeholder = every(F.regexp_extract_all(bare, F.lit("[a-z0-9]+"), 0), odd)
        filler = every(F.regexp_extract_all(F.lower(reference), F.lit("[a-z]+"), 0), lambda w: w.isin(*FILLER_WORDS))
    empty = F.size(practice_tokens(reference, language)) == 0
    return F.when(placeholder, "placeholder_ref").when(empty | filler, "filler_only")


def parts(reference: Column, hypothesis: Column) -> Column:
    """(errors, n) of one pair of token arrays: the statistics that all rates are made of."""
    return F.struct(U.edit_distance(reference, hypothesis).alias("errors"), F.size(reference).cast("long").alias("n"))


def rate(errors: Column, n: Column) -> Column:
    """Per cent of the summed reference length; null where that is 0."""
    return F.try_divide(100.0 * F.sum(errors), F.sum(n).cast("double"))


def rate_by_slice(rows: DataFrame, keys: list[str], errors: str, n: str, language: str) -> DataFrame:
    """(keys, rate, sample_count) per slice; null for a slice of several languages, whose tokens don't compare."""
    alone = F.coalesce(F.min(F.lower(language)) == F.max(F.lower(language)), F.lit(False))
    return rows.groupBy(*keys).agg(F.when(alone, rate(F.col(errors), F.col(n))).alias("rate"), F.when(alone, F.count(F.lit(1))).alias("sample_count"))


def mixed_tokens(text: Column) -> Column:
    """NFKC, lower case, punctuation to blanks; characters where any is CJK, words otherwise."""
    t = squeeze(F.regexp_replace(F.lower(U.nfkc(text)), "[\\p{P}!-/:-@\\[-`{-~]", " "))
    return let(t, lambda x: F.when(x.rlike(CJK), F.filter(F.split(x, ""), lambda c: F.trim(c) != "")).otherwise(words(x)))


def clean_transcript(text: Column, fillers: tuple[str, ...]) -> Column:
    """Upper case, hyphens to blanks, filler words dropped, repeats kept."""
    return F.array_join(F.filter(words(F.replace(F.upper(text), F.lit("-"), F.lit(" "))), lambda w: ~w.isin(*fillers)), " ")
