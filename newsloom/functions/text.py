"""Text analysis as native column expressions.

All patterns stay in the subset Java and RE2 share, so the SQL oracle can use them too.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}_]+"
WORD_2 = "[\\p{L}\\p{N}_]{2,}"
NON_WORD = "[^\\p{L}\\p{N}_]"
SENTENCE_END = "[.!?]+\\s+|\\n+"
CAPITALISED = "^[^\\p{L}\\p{N}_]*\\p{Lu}"

# The usual English stop words of word search.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the "
    "their then there these they this to was will with"
).split()

# Frequent function words per language, for language detection.
LANGUAGE_PROFILES = {
    "de": "aber als auch auf das dem den der des die ein eine er es für ist mit nicht sich sie und von zu".split(),
    "en": "a and are as be by for from have he in is it of on that the this to was with".split(),
    "es": "con de del el en es la las lo los no para por que se su un una y".split(),
    "fr": "au avec ce dans des du elle est et il le les ne pas pour qui sur un une".split(),
}


def _accent_table() -> tuple[str, str]:
    """Lower-case accented letter -> base letter, where it decomposes to exactly one."""
    accented, plain = [], []
    for point in range(0x80, 0x3000):
        letter = chr(point)
        if not letter.isalpha() or letter != letter.lower():
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(x))
        if base != letter and len(base) == 1:
            accented.append(letter)
            plain.append(base)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), "\\p{Mn}+", "")


def tokens(c: Column) -> Column:
    """Lower-cased, accent-free words of two or more word characters."""
    text = strip_accents(F.lower(F.coalesce(c, F.lit(""))))
    return F.regexp_extract_all(text, F.lit(WORD_2), F.lit(0))


def search_words(c: Column) -> Column:
    """Words as the search clauses see them: lower case, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def char_ngrams(c: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams of one word, shorter lengths first."""
    length = F.length(c)

    def of_size(n: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: F.substring(c, i, n))
        return F.when(length >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), of_size))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(c, " "), 1, n), " ")


def fuzzy_tokens(c: Column) -> Column:
    """Space-separated pieces, punctuation blanked, lower case, trimmed; empty pieces dropped."""
    pieces = F.split(F.trim(c), " ")
    cleaned = F.transform(pieces, lambda t: F.trim(F.lower(F.regexp_replace(t, NON_WORD, " "))))
    return F.filter(cleaned, lambda t: t != "")


def clean_entity_word(w: Column) -> Column:
    return F.lower(F.regexp_replace(w, NON_WORD + "+", ""))


def sentences(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), SENTENCE_END)


def sentence_words(c: Column) -> Column:
    return F.filter(F.split(c, "\\s+"), lambda w: w != "")


def entity_tokens(c: Column) -> Column:
    """Words of capitalised runs.

    The first word of a sentence counts only when the second one is capitalised as well,
    because a lone capital there says nothing.
    """

    def of_sentence(words: Column) -> Column:
        second = F.coalesce(F.get(words, F.lit(1)), F.lit(""))
        return F.filter(
            words,
            lambda w, i: w.rlike(CAPITALISED) & ((i > 0) | second.rlike(CAPITALISED)),
        )

    # the words of a sentence are bound to a lambda variable, so they are split only once
    split_up = F.transform(sentences(c), sentence_words)
    cleaned = F.transform(F.flatten(F.transform(split_up, of_sentence)), clean_entity_word)
    return F.filter(cleaned, lambda w: w != "")


def marked_words(c: Column) -> Column:
    """Per sentence its cleaned words: ``word``, ``capital``, and ``entity`` for those of :func:`entity_tokens`."""

    def of_sentence(words: Column) -> Column:
        second = F.coalesce(F.get(words, F.lit(1)), F.lit(""))

        def mark(w: Column, i: Column) -> Column:
            capital = w.rlike(CAPITALISED)
            entity = capital & ((i > 0) | second.rlike(CAPITALISED))
            return F.struct(clean_entity_word(w).alias("word"), capital.alias("capital"), entity.alias("entity"))

        return F.filter(F.transform(words, mark), lambda m: m["word"] != "")

    return F.transform(F.transform(sentences(c), sentence_words), of_sentence)


def lone_first_words(c: Column) -> Column:
    """The capitalised first words :func:`entity_tokens` leaves out."""

    def of_sentence(words: Column) -> Column:
        first = F.coalesce(F.get(words, F.lit(0)), F.lit(""))
        second = F.coalesce(F.get(words, F.lit(1)), F.lit(""))
        return F.when(first.rlike(CAPITALISED) & ~second.rlike(CAPITALISED), clean_entity_word(first))

    words = F.transform(F.transform(sentences(c), sentence_words), of_sentence)
    return F.filter(words, lambda w: w.isNotNull() & (w != ""))


def language(c: Column) -> Column:
    """Language whose function words are most frequent; ``und`` when none occurs.

    Ties go to the alphabetically first code.  Map-side only: no join, no shuffle.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))

    def score(position: int, code: str, profile: list[str]) -> Column:
        hits = F.size(F.filter(words, lambda w: w.isin(profile)))
        return F.struct(hits.alias("hits"), F.lit(-position).alias("order"), F.lit(code).alias("code"))

    best = F.greatest(*[score(i, c, p) for i, (c, p) in enumerate(sorted(LANGUAGE_PROFILES.items()))])
    return F.when(best["hits"] > 0, best["code"]).otherwise(F.lit("und"))
