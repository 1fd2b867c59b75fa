"""Abbreviations learned from text without labels, for sentence splitting.

Every word that ever stands with a final full stop is a candidate. By the published method of log-likelihood ratios (Kiss and Strunk, 2006) it is
an abbreviation if the stop is far likelier behind it than behind words at large, the likelier so the shorter it is, the more stops
it has inside, and the less often it stands without one. The counts are an aggregate over all texts of a language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The score from which a word is an abbreviation, and the share of stops behind one.
LEAST, BEHIND = 0.3, 0.99
_EDGES = "\"'“”‘’«»()[]{},;:!?…"


def counts(texts: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, word, dotted, bare): how often each word stands with a final full stop and without, in any case; numbers are no words."""
    token = F.btrim(F.lower(F.col("token")), F.lit(_EDGES))
    words = texts.select(F.col(lang_col).alias("lang"), F.explode(F.split(text_col, r"[ \t\n\x0B\f\r]+")).alias("token")).select("lang", token.alias("token"))
    # A map side without regular expressions: what counts is decided once a distinct token.
    seen = words.groupBy("lang", "token").agg(F.count("*").alias("n"))
    stop = F.col("token").endswith(".")
    word = F.when(stop, F.expr("left(token, length(token) - 1)")).otherwise(F.col("token"))
    found = seen.select("lang", word.alias("word"), F.when(stop, F.col("n")).otherwise(0).alias("dotted"), F.when(stop, 0).otherwise(F.col("n")).alias("bare"))
    found = found.where((F.col("word") != "") & ~F.col("word").endswith(".") & F.col("word").rlike(r"\p{L}"))
    return found.groupBy("lang", "word").agg(F.sum("dotted").alias("dotted"), F.sum("bare").alias("bare"))


def score(dotted: Column, bare: Column, word: Column, all_dotted: Column, everything: Column) -> Column:
    """The scaled log-likelihood ratio of a word."""
    n, p = dotted + bare, all_dotted / everything
    at_large = dotted * F.ln(p) + bare * F.ln(F.lit(1.0) - p)
    behind = dotted * F.ln(F.lit(BEHIND)) + bare * F.ln(F.lit(1.0 - BEHIND))
    inside = F.length(word) - F.length(F.replace(word, F.lit("."), F.lit("")))
    letters = (F.length(word) - inside).cast("double")
    return F.when(n > 0, F.lit(-2.0) * (at_large - behind) * F.exp(-letters) * (inside + 1) * F.pow(letters, -bare.cast("double")))


def learned(found: DataFrame, least: float = LEAST) -> DataFrame:
    """(lang, word, score): the abbreviations among ``counts``. A language whose words all end in full stops has none."""
    whole = found.groupBy("lang").agg(F.sum("dotted").alias("all_dotted"), F.sum(F.col("dotted") + F.col("bare")).alias("everything"))
    rows = found.where("dotted > 0").join(whole.where("all_dotted < everything"), "lang")
    value = score(F.col("dotted"), F.col("bare"), F.col("word"), F.col("all_dotted"), F.col("everything"))
    return rows.select("lang", "word", value.alias("score")).where(F.col("score") >= least)


def with_sentences(texts: DataFrame, abbreviations: DataFrame, lang_col: str = "lang", text_col: str = "text", output: str = "sentences") -> DataFrame:
    """``texts`` with their sentences, none of which ends at an abbreviation of its language.

    A language's abbreviations come beside its texts as one array; they are few, as the score of a word falls with the power of its length.
    """
    from quire.functions.text import sentences

    listed = abbreviations.groupBy(F.col("lang").alias("__lang")).agg(F.collect_set("word").alias("__words"))
    joined = texts.join(listed, F.col(lang_col).eqNullSafe(F.col("__lang")), "left")
    none = F.array().cast("array<string>")
    return joined.withColumn(output, sentences(F.col(text_col), abbreviations=F.coalesce("__words", none))).drop("__lang", "__words")
