"""Tokens, stems, term weights and snippets as column expressions.

Only Unicode compatibility folding needs Python; it is applied to the rows that hold something other than ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The index drops these words before stemming.
STOPWORDS = (
    "a an and are as at be by for from has have he her hers him his how i in "
    "is it its of on or our ours she that the their theirs there these they "
    "this those to was we were what when where which who whom will with you "
    "your yours not no do does did but if than then so such can could would "
    "should shall may might must about into over under again further "
    "once here also"
).split()
# Suffix, least length of a word that loses it.
STEM_RULES = (("ies", 7), ("ing", 7), ("ed", 6), ("es", 6), ("s", 5))
MIN_TOKEN = 2
WORD = r"[\p{L}\p{Nl}\p{No}]+|\p{Nd}+"
ASCII = r"^[\x00-\x7F]*$"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def nfkc_lower_strip(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower().strip())


def fold_term(df: DataFrame, column: str) -> DataFrame:
    """Replaces a term by NFKC, lower case, trimmed. Rows with a null term are dropped.

    One pass: ASCII terms are folded inside the JVM, and reach Python as nulls.
    """
    plain = F.col(column).rlike(ASCII)
    folded = F.when(plain, F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))).otherwise(nfkc_lower_strip(F.when(~plain, F.col(column))))
    return df.where(F.col(column).isNotNull()).withColumn(column, folded)


def folded_text(df: DataFrame, column: str, out: str = "_folded") -> DataFrame:
    """Adds NFKC and lower case of a text; null counts as empty. One pass, in which ASCII texts reach Python as nulls."""
    text = F.coalesce(F.col(column), F.lit(""))
    plain = text.rlike(ASCII)
    return df.withColumn(out, F.lower(F.when(plain, text).otherwise(nfkc(F.when(~plain, text)))))


def stem(word: Column) -> Column:
    """Cuts the first of ies, ing, ed, es, s that leaves four letters; ies becomes y. One pass."""
    out = F.when(word.endswith("ies") & (F.length(word) >= 7), F.concat(word.substr(F.lit(1), F.length(word) - 3), F.lit("y")))
    for suffix, least in STEM_RULES[1:]:
        out = out.when(word.endswith(suffix) & (F.length(word) >= least), word.substr(F.lit(1), F.length(word) - len(suffix)))
    return out.otherwise(word)


def tokens_of(folded: Column, stemmed: bool = True) -> Column:
    """Tokens of an already folded text, in order, with repeats: letters or digits in a row, two or more, no stop words.

    Null and empty texts give an empty array.
    """
    words = F.regexp_extract_all(F.coalesce(folded, F.lit("")), F.lit(WORD), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) >= MIN_TOKEN) & ~w.isin(STOPWORDS))
    if not stemmed:
        return kept
    return F.filter(F.transform(kept, lambda w: F.when(w.rlike(r"^\p{Nd}"), w).otherwise(stem(w))), lambda w: F.length(w) >= MIN_TOKEN)


def tokenize(text: str | None, stemmed: bool = True) -> list[str]:
    """The same tokens for one text on the driver: for query strings."""
    import regex

    out = []
    for w in regex.findall(WORD, unicodedata.normalize("NFKC", text or "").lower()):
        if len(w) >= MIN_TOKEN and w not in STOPWORDS:
            if stemmed and not w[0].isdecimal():
                cut = next((s for s, least in STEM_RULES if w.endswith(s) and len(w) >= least), "")
                w = w[: len(w) - len(cut)] + "y" * (cut == "ies")
            if len(w) >= MIN_TOKEN:
                out.append(w)
    return out


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of each text; texts without a token have no rows. Repeated keys add up.

    Words are exploded first, so that stop words and stems are compiled expressions, then counted with partial sums.
    """
    folded = folded_text(df.select(key, text), text)
    words = folded.select(key, F.explode(F.regexp_extract_all("_folded", F.lit(WORD), F.lit(0))).alias("w"))
    kept = words.where((F.length("w") >= MIN_TOKEN) & ~F.col("w").isin(STOPWORDS))
    w = F.col("w")
    terms = kept.select(key, F.when(w.rlike(r"^\p{Nd}"), w).otherwise(stem(w)).alias("term"))
    return terms.where(F.length("term") >= MIN_TOKEN).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tf_weight(tf: Column) -> Column:
    """1 + ln tf; 0 for null and below 1."""
    return F.when(tf > 0, 1 + F.log(tf)).otherwise(F.lit(0.0))


def idf(df: Column, n: Column) -> Column:
    """ln((1+N)/(1+df)) + 1; 0 where N is null or not positive; a null df counts as 0."""
    return F.when(n > 0, F.log((1 + n) / (1 + F.coalesce(df, F.lit(0)))) + 1).otherwise(F.lit(0.0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def snippet(text: Column, terms: list[str], window: int = 160) -> Column:
    """The surroundings of the earliest place where a term stands as a substring; without one, the first 2 * window characters.

    Null and empty texts give an empty string.
    """
    lower = F.lower(text)
    places = F.filter(F.array(*[F.instr(lower, t) for t in terms]), lambda p: p > 0) if terms else F.array().cast("array<int>")
    at = F.array_min(places) - 1
    start, end = F.greatest(F.lit(0), at - window // 2), F.least(F.length(text), at + window)
    cut = F.concat(
        F.when(start > 0, F.lit("… ")).otherwise(F.lit("")),
        text.substr(start + 1, end - start),
        F.when(end < F.length(text), F.lit(" …")).otherwise(F.lit("")),
    )
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit("")).otherwise(
        collapse(F.when(at.isNull(), F.substring(text, 1, 2 * window)).otherwise(cut))
    )
