"""Text expressions: normalisation, tokens, n-grams, error rates, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.intervals import col

#: Characters written in several encodings, and the form kept.
ARABIC_YEH, ARABIC_KAF, FARSI_YEH, KEHEH = "ي", "ك", "ی", "ک"
HEH, NON_JOINER, AE = "ه", "‌", "ە"
EASTERN_DIGITS, FARSI_DIGITS, LATIN_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
#: Marks put around a word before its n-grams are cut.
PAD_LEFT, PAD_RIGHT = "\u0002", "\u0003"


def normalize(text) -> Column:
    """One encoding for each letter and digit; ends stripped, inner blanks kept."""
    t = F.regexp_replace(col(text), HEH + NON_JOINER, AE)
    t = F.translate(t, ARABIC_YEH + ARABIC_KAF + EASTERN_DIGITS + FARSI_DIGITS, FARSI_YEH + KEHEH + LATIN_DIGITS * 2)
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def tokens(text) -> Column:
    """Normalised words without punctuation; empty ones dropped."""
    parts = F.split(F.regexp_replace(normalize(text), r"\p{P}", ""), r"\s+")
    return F.filter(parts, lambda x: x != "")


def character_ngrams(word, size: int = 3) -> Column:
    """n-grams of the word between boundary marks; a word shorter than that is one n-gram."""
    padded = F.concat(F.lit(PAD_LEFT), col(word), F.lit(PAD_RIGHT))
    count = F.greatest(F.length(padded) - size + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(padded, i, F.lit(size)))


def cer(reference, hypothesis) -> Column:
    """Edits over the reference's length in code points; null for an empty reference."""
    return F.levenshtein(col(reference), col(hypothesis)) / F.nullif(F.length(col(reference)), F.lit(0))


def spacing_free_cer(reference, hypothesis) -> Column:
    return cer(F.regexp_replace(col(reference), r"\s+", ""), F.regexp_replace(col(hypothesis), r"\s+", ""))


def missing_share(text, needles) -> Column:
    """Share of the needles that the text does not contain; null without needles or text."""
    lost = F.filter(col(needles), lambda n: ~F.contains(col(text), n))
    return F.when(col(text).isNotNull(), F.size(lost) / F.nullif(F.size(col(needles)), F.lit(0)))


def substring_distance(needle, haystack) -> Column:
    """Least edits of the needle against any substring: a fold over the needle that carries one row of the table."""
    n, h = col(needle), col(haystack)
    letters = F.filter(F.split(n, ""), lambda x: x != "")
    target = F.filter(F.split(h, ""), lambda x: x != "")
    zero = F.transform(F.sequence(F.lit(0), F.size(target)), lambda _: F.lit(0))

    def row(before, letter):
        first = F.array(F.element_at(before, 1) + 1)
        return F.aggregate(
            F.sequence(F.lit(1), F.size(target)),
            first,
            lambda acc, j: F.concat(acc, F.array(F.least(F.element_at(before, j + 1) + 1, F.element_at(acc, -1) + 1, F.element_at(before, j) + F.when(F.element_at(target, j) == letter, 0).otherwise(1)))),
        )

    return F.when(F.size(target) == 0, F.size(letters)).otherwise(F.aggregate(letters, zero, row, lambda r: F.array_min(r)))


def jaccard(a, b) -> Column:
    """Similarity of two word sets; 0 if either is empty."""
    both, either = F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))
    return F.when((F.size(col(a)) == 0) | (F.size(col(b)) == 0), F.lit(0.0)).otherwise(both / either)


def letter_share(text, letters: str) -> Column:
    """Share of the letters that are in a character class (the inside of brackets); 0 without letters."""
    every = F.length(F.regexp_replace(col(text), r"[^\p{L}]", ""))
    own = F.length(F.regexp_replace(col(text), rf"[^\p{{L}}]|[^{letters}]", ""))
    return F.coalesce(own / F.nullif(every, F.lit(0)), F.lit(0.0))


def disagree(a, b, threshold: float = 0.15) -> Column:
    """Do two readings of one stretch of speech differ materially?"""
    blank = lambda x: F.trim(x) == ""
    either = blank(col(a)) | blank(col(b))
    return F.when(either, col(a) != col(b)).otherwise(cer(a, b) >= threshold)


def cited_times(text) -> Column:
    """Times that a text cites, in ms, by kind and then by place: `h:mm:ss`, `m:ss`, `300ms`, `12s`."""
    t = col(text)
    clocks = F.transform(
        F.regexp_extract_all(t, F.lit(r"(?<![\d:])(\d+(?::\d{2}){1,2})(?![\d:])"), 1),
        lambda x: F.aggregate(F.split(x, ":"), F.lit(0).cast("long"), lambda acc, p: acc * 60 + p.cast("long")) * 1000,
    )
    millis = F.transform(F.regexp_extract_all(t, F.lit(r"(?<![\d:])(\d+)\s*ms\b"), 1), lambda x: x.cast("long"))
    seconds = F.transform(F.regexp_extract_all(t, F.lit(r"(?<![\d:])(\d+)\s*s\b"), 1), lambda x: x.cast("long") * 1000)
    return F.concat(clocks, millis, seconds)
