"""Word lists as tables: membership with inflections, and separating a joined particle from the word after it.

A lexicon is a table of distinct words, given or counted from texts. Questions about words are asked once for each
distinct word and answered by joins by word, so neither the list nor the vocabulary has to fit a task; where the
answers meet the texts again, words that very many texts hold are dealt (`skew.spread_join`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.skew import spread_join
from spanloom.scratch import Scratch

#: A word: letters, digits and underscores. What stands between words is kept as it is.
WORD = r"[\p{L}\p{N}_]+"
PIECE = rf"{WORD}|[^\p{{L}}\p{{N}}_]+"


def counted(texts: DataFrame, text: str = "text") -> DataFrame:
    """word, n over all texts; a null text has no words."""
    return texts.select(F.explode(F.regexp_extract_all(text, F.lit(WORD), 0)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def from_texts(texts: DataFrame, least: int, text: str = "text") -> DataFrame:
    """A lexicon of the words that the texts hold `least` times or more: word."""
    return counted(texts, text).where(F.col("n") >= least).select("word")


def bases(word, suffixes: tuple[str, ...] = ()):
    """The word itself and, for each of the suffixes it ends in, what stands before that; never empty."""
    w = F.col(word) if isinstance(word, str) else word
    cut = [F.when(F.endswith(w, F.lit(s)) & (F.length(w) > len(s)), w.substr(F.lit(1), F.length(w) - len(s))) for s in suffixes]
    return F.array_distinct(F.array_compact(F.array(w, *cut)))


def members(words: DataFrame, lexicon: DataFrame, suffixes: tuple[str, ...] = (), word: str = "word") -> DataFrame:
    """The distinct words that are in the lexicon, as they stand or without one of the suffixes."""
    asked = words.select(F.col(word).alias("_w")).where("_w <> ''").distinct()
    forms = asked.select("_w", F.explode(bases("_w", suffixes)).alias("_base"))
    return forms.join(lexicon.select(F.col("word").alias("_base")), "_base", "left_semi").select(F.col("_w").alias(word)).distinct()


def separable(words: DataFrame, lexicon: DataFrame, prefix: str, suffixes: tuple[str, ...] = (), word: str = "word") -> DataFrame:
    """The distinct words to split after the prefix: what follows it is a word, and the whole is none. Else a word stays as it is."""
    k = len(prefix)
    joined = words.select(F.col(word).alias("word")).where(F.startswith("word", F.lit(prefix)) & (F.length("word") > k)).distinct()
    rest = joined.select("word", F.expr(f"substr(word, {k + 1})").alias("_rest"))
    good = rest.join(members(rest, lexicon, suffixes, "_rest"), "_rest", "left_semi")
    return good.join(members(joined, lexicon, suffixes), "word", "left_anti").select(F.col("word").alias(word))


def separate(texts: DataFrame, key: str, lexicon: DataFrame, prefix: str, suffixes: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """texts with the prefix separated from the words it was joined to, and `n_splits`.

    key names a text; rows of one key are each rewritten by what is separable in any of them, which gives the
    same texts, as whether a word is separable does not depend on its text. Null keys are kept and compare equal. A null
    text stays null, with no splits. Only words that begin with the prefix leave their text.
    """
    scratch, k = Scratch(texts.sparkSession, "lexicon"), len(prefix)
    found = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.startswith(w, F.lit(prefix)) & (F.length(w) > k)))
    rows = scratch.save(texts.select(F.col(key).alias("_key"), F.explode(found).alias("word")), "joined")
    held = rows.groupBy("word").agg(F.count("*").alias("n"))
    total = rows.count()
    lexicon = scratch.save(lexicon.select("word").distinct(), "lexicon")
    split = scratch.save(held.join(separable(held, lexicon, prefix, suffixes), "word", "left_semi"), "separable")
    own = spread_join(rows, split, ["word"], "n", total).groupBy("_key").agg(F.collect_set("word").alias("_words"))
    met = texts.join(own, texts[key].eqNullSafe(own["_key"]), "left").drop("_key")
    cut = lambda w: F.coalesce(F.array_contains("_words", w), F.lit(False))
    pieces = F.regexp_extract_all(text, F.lit(PIECE), 0)
    whole = F.array_join(F.transform(pieces, lambda w: F.when(cut(w), F.concat(F.lit(prefix + " "), w.substr(F.lit(k + 1), F.length(w)))).otherwise(w)), "")
    n = F.coalesce(F.size(F.filter(pieces, cut)).cast("long"), F.lit(0).cast("long"))
    return met.withColumn("n_splits", F.when(F.col(text).isNull(), 0).otherwise(n)).withColumn(text, F.when(F.col("_words").isNull(), F.col(text)).otherwise(whole)).drop("_words")


def word_shares(texts: DataFrame, key: str, lexicon: DataFrame, suffixes: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """key, n_tokens, n_words: words of each text, and how many of them are in the lexicon; texts of one key count together."""
    scratch = Scratch(texts.sparkSession, "lexicon")
    rows = texts.select(F.col(key).alias("_key"), F.explode(F.regexp_extract_all(text, F.lit(WORD), 0)).alias("word"))
    rows = scratch.save(rows.groupBy("_key", "word").agg(F.count("*").alias("times")), "tokens")
    held = rows.groupBy("word").agg(F.count("*").alias("n"))
    known = members(held, lexicon, suffixes).withColumn("known", F.lit(True))
    told = scratch.save(held.join(known, "word", "left"), "known")
    met = spread_join(rows, told, ["word"], "n", rows.count())
    counts = met.groupBy("_key").agg(F.sum("times").alias("n_tokens"), F.sum(F.when(F.col("known"), F.col("times")).otherwise(0)).alias("n_words"))
    every = texts.select(F.col(key).alias(key)).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.join(counts, every[key].eqNullSafe(counts["_key"]), "left").select(key, zero("n_tokens"), zero("n_words"))
