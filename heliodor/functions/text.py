"""Text functions: normalisation, query understanding, reply parsing, stemming."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from heliodor.functions.scalars import let

# Words that a full-text query drops.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall",
    "should", "may", "might", "must", "can", "could", "i", "me", "my", "we", "our", "you", "your", "he", "she", "it", "its",
    "they", "them", "their", "this", "that", "these", "those", "what", "which", "who", "whom", "where", "when", "how", "why",
    "if", "then", "else", "so", "than", "too", "very", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as",
    "into", "through", "during", "before", "after", "above", "below", "between", "about", "against", "over", "under",
    "and", "but", "or", "nor", "not", "no", "yet", "give", "answer", "response", "relying", "shown", "details",
    "provide", "using", "use", "based", "following", "assume", "primarily", "information", "question",
)
# Aliases of companies whose file code differs from their name.
ALIASES = {
    "j&j": "JOHNSON_JOHNSON", "jnj": "JOHNSON_JOHNSON", "johnson & johnson": "JOHNSON_JOHNSON", "johnson and johnson": "JOHNSON_JOHNSON",
    "pg&e": "PG_E", "pacific gas": "PG_E", "coca-cola": "COCACOLA", "coca cola": "COCACOLA", "american express": "AMERICANEXPRESS", "amex": "AMERICANEXPRESS",
    "american water works": "AMERICANWATERWORKS", "american water": "AMERICANWATERWORKS", "activision blizzard": "ACTIVISIONBLIZZARD", "activision": "ACTIVISIONBLIZZARD",
    "aes corporation": "AES", "boston properties": "BOSTONPROPERTIES", "best buy": "BESTBUY", "cvs health": "CVSHEALTH", "cvs": "CVSHEALTH",
    "general mills": "GENERALMILLS", "kraft heinz": "KRAFTHEINZ", "lockheed martin": "LOCKHEEDMARTIN", "lockheed": "LOCKHEEDMARTIN", "mcdonald's": "MCDONALDS",
    "mcdonalds": "MCDONALDS", "mgm resorts": "MGMRESORTS", "mgm": "MGMRESORTS", "foot locker": "FOOTLOCKER", "jpmorgan": "JPMORGAN", "jp morgan": "JPMORGAN",
    "jpmorgan chase": "JPMORGAN", "ulta beauty": "ULTABEAUTY", "ulta": "ULTABEAUTY", "salesforce": "SALESFORCE",
}
# How a reasoning sentence starts; what a rewritten query may be prefixed with.
REASONING = ("thus", "so", "therefore", "hence", "consequently", "as a result", "in conclusion", "this means", "that means")
REWRITE_PREFIXES = ("rewritten query:", "optimized query:", "improved query:", "new query:", "query:")


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin("a", "an", "the")), " ")


def words(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def fts_tokens(c: Column) -> Column:
    """Tokens of a full-text query: no operators, special signs or stop words."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?i)\b(AND|OR|NOT|NEAR)\b", " "), r'["*\-+(){}^~:]', " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: (t != "") & ~F.lower(t).isin(*STOP_WORDS))


def fts_query(c: Column) -> Column:
    return F.array_join(F.transform(fts_tokens(c), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def years(c: Column) -> Column:
    """Sorted distinct years that a query names."""
    found = [
        F.regexp_extract_all(c, F.lit(r"(?i)Q([1-4])\s+(?:of\s+)?FY\s*(\d{4})"), F.lit(2)),
        F.regexp_extract_all(c, F.lit(r"(?i)(?:FY|fiscal\s+year)\s*(\d{4})"), F.lit(1)),
        F.regexp_extract_all(c, F.lit(r"(?i)(?:in|for|during|as\s+of|from|between)\s+(\d{4})"), F.lit(1)),
    ]
    return F.transform(F.array_sort(F.array_distinct(F.concat(*found))), lambda y: y.cast("int"))


def quarter(c: Column) -> Column:
    """Qn of the last quarter that a query names with its fiscal year; null if none."""
    q = F.regexp_extract_all(c, F.lit(r"(?i)Q([1-4])\s+(?:of\s+)?FY\s*(\d{4})"), F.lit(1))
    return F.when(F.size(q) > 0, F.concat(F.lit("Q"), F.element_at(q, -1)))


def company_code(file_name: Column) -> Column:
    """What stands before _YYYY or _8K in a file name."""
    return F.coalesce(F.nullif(F.regexp_extract(file_name, r"^(.+?)_\d{4}", 1), F.lit("")), F.nullif(F.regexp_extract(file_name, r"^(.+?)_8K", 1), F.lit("")))


def alias_hit(query: Column, alias: Column) -> Column:
    """An alias up to 3 signs needs neighbours that are no letters; a longer one may stand anywhere."""
    q = F.lower(query)
    spaced = F.concat(F.lit(" "), F.regexp_replace(q, "[^a-z&]+", " "), F.lit(" "))
    return F.when(F.length(alias) <= 3, F.contains(spaced, F.concat(F.lit(" "), alias, F.lit(" ")))).otherwise(F.contains(q, alias))


def complexity(reply: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.upper(reply), "[ABC]", 0), F.lit("")), F.lit("B"))


def is_reasoning(sentence: Column) -> Column:
    lower = F.trim(F.lower(sentence))
    starts = F.lit(False)
    for word in REASONING:
        starts = starts | F.startswith(lower, F.lit(word))
    return starts | F.rlike(sentence, F.lit(r"\d+\s*[+\-*/]\s*\d+"))


def first_sentence(c: Column) -> Column:
    t = F.trim(c)
    hit = F.trim(F.regexp_extract(t, r"^([^.!?]+[.!?])", 1))
    return F.when(hit != "", hit).otherwise(F.substring(t, 1, 200))


def answer_found(sentence: Column) -> Column:
    hit = F.regexp_extract(sentence, r"(?i).*answer is:?\s*(.*?)\.", 1)
    return F.when(F.rlike(sentence, F.lit(r"(?i).*answer is:?\s*(.*?)\.")), F.trim(hit))


def numbered_list(reply: Column, most: int = 4) -> Column:
    return F.slice(F.transform(F.regexp_extract_all(reply, F.lit(r"\d+\.\s*(.+)"), F.lit(1)), lambda x: F.trim(x)), 1, most)


def keywords(reply: Column, raw: Column) -> Column:
    """A JSON list of keywords joined by spaces; the raw query where there is none."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), "array<string>")
    return F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(raw)


def selected_names(reply: Column) -> Column:
    """The names in the JSON list of a model's reply; [] if there is none."""
    return F.coalesce(F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), "array<string>"), F.array().cast("array<string>"))


def strip_rewrite_prefix(reply: Column) -> Column:
    out = F.btrim(F.trim(reply), F.lit('"'))
    for prefix in REWRITE_PREFIXES:
        out = F.trim(F.regexp_replace(out, f"^(?i){re.escape(prefix)}", ""))
    return out


def needs_retrieval(query: Column) -> Column:
    """False for short greetings and thanks."""
    q = F.lower(F.trim(query))
    n = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    greeting = F.lit(False)
    for word in ("hello", "hi", "hey"):
        greeting = greeting | F.contains(q, F.lit(word))
    return ~((greeting & (n <= 3)) | (F.contains(q, F.lit("thank")) & (n <= 5)))


def sentence_pairs(c: Column, least: int = 5) -> Column:
    """Strips: pairs of sentences that have at least so many words."""
    sentences = F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= least)
    starts = lambda s: F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return let(sentences, lambda s: F.transform(starts(s), lambda i: F.array_join(F.slice(s, i, F.lit(2)), " ")))


def list_density(c: Column) -> Column:
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    marked = F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(r"^\s*([-*+]|\d+\.)\s+"))))
    return F.when(F.size(lines) > 0, F.least(marked / F.size(lines), F.lit(1.0))).otherwise(0.0)


_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(w: str) -> int:
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 3) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 1) and w[-1] not in "wxy"


# The suffixes of Porter's second, third and fourth step.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(w: str) -> str:
    """Porter's stemmer (1980)."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if _has_vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = max((e for e in table if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((e for e in _STEP4 if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)][-1:] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(ArrayType(StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    """Stems of tokens longer than 3 signs; others as they are."""
    known: dict[str, str] = {}

    def one(t: str) -> str:
        if t not in known:
            known[t] = porter(t) if len(t) > 3 else t
        return known[t]

    return tokens.map(lambda ts: None if ts is None else [one(t) for t in ts])
