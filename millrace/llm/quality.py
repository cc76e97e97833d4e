"""Operator 5: line-first quality rules.

Lines that fail a rule are taken out first: by punctuation (long lines without
any, and lines in which repeated exclamation or question marks abound), lines
that are navigation, lines that are boilerplate (links, copyright notices, and
lines that consist of the phrases of web templates, as whole words, to a good
part), lines without letters, and lines of symbols.  A text that loses more than ``MOST_LOST`` of its word
characters is rejected, as is one whose base measures fail.  All of it is
expressions on one row: no shuffle, no Python.

The base measures are of the whole text: word characters, symbols, repeated
lines, and the words inside three-word windows that occur twice or more.
Windows are compared by 64-bit hashes of their words.

Defined results: null, empty and blank texts have no words, measures of 0, and
are rejected; repeated rows each give a row; other columns stay as they are,
but for those of a measure's name, which ``measured`` replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_names

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: The part of its word characters that a text may lose with its failing lines.
MOST_LOST = 0.5
#: A line is navigation with so many separators and no sentence end, or with so many separators a word.
NAVIGATION_MARKS, MANY_MARKS = 3, 0.3
#: Boilerplate removes lines of so many words or fewer.
SHORT_LINE_WORDS = 16
#: The part of such a line's characters that whole phrases make up: a sentence that only holds one stays.
LEAST_PHRASES = 0.3
#: A line of so many words has some punctuation; a line has fewer runs of exclamation and question marks a word.
LONG_LINE_WORDS, MANY_SHOUTS = 20, 0.3
#: The part of a line's words that may be links.
MOST_LINKS = 0.3
#: The part of a line's characters that may be symbols.
MOST_SYMBOLS = 0.3

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_text", "base_failed", "kept")

_BLANKS = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"
#: Beginnings or whole phrases of lines that web templates add.
BOILERPLATE = (
    "all rights reserved", "copyright", "cookie", "cookies", "click here", "javascript", "lorem ipsum", "privacy policy",
    "read more", "share this", "sign in", "sign up", "skip to", "subscribe", "terms of use", "terms of service",
    "alle rechte vorbehalten", "datenschutzerklärung", "impressum", "weiterlesen", "jetzt anmelden",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "lire la suite", "se connecter",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "leer más", "iniciar sesión",
)
#: A phrase as whole words.
_PHRASE = r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(BOILERPLATE) + r")(?:$|[^\p{L}\p{N}])"
#: Links and copyright notices.
_LINK, _NOTICE = r"https?://|www\.|[\w.+\-]+@[\w\-]+\.\w", r"^(©|\(c\)) ?[0-9]{4}"
_PUNCTUATION, _SHOUT = r"[.!?…:;,。！？；：，、]", r"[!?]{2,}"
#: Punctuation that ends a sentence, before closing quotes and brackets.
_SENTENCE_END = r"""[.!?…:;]["'”»)\]]*$"""


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def words_of(text: Column) -> Column:
    clean = squeezed(text)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def line_measures(lines: Column) -> Column:
    """Each line with what the rules look at, made once for all of them."""
    trimmed = F.transform(lines, lambda x: F.struct(x.alias("line"), F.trim(x).alias("t")))

    def measures(x: Column) -> Column:
        t = x["t"]
        return F.struct(x["line"].alias("line"), t.alias("t"), F.length(t).alias("size"), F.regexp_count(t, F.lit(r"\S+")).alias("words"), F.regexp_count(t, F.lit(r"[|»›•·]")).alias("marks"))

    return F.transform(trimmed, measures)


def fails(m: Column) -> Column:
    """Whether the rules remove a line, given its measures; blank lines stay."""
    t, size, words, marks = (m[c] for c in ("t", "size", "words", "marks"))
    punctuation = ((words >= LONG_LINE_WORDS) & ~t.rlike(_PUNCTUATION)) | (t.contains("!") & (F.regexp_count(t, F.lit(_SHOUT)) > MANY_SHOUTS * words))
    navigation = (marks > 0) & ((marks >= MANY_MARKS * words) | ((marks >= NAVIGATION_MARKS) & ~t.rlike(_SENTENCE_END)))
    low = F.lower(t)
    phrases = low.rlike(_PHRASE) & (F.length(low) - F.length(F.regexp_replace(low, _PHRASE, "")) >= F.length(low) * LEAST_PHRASES)
    boilerplate = (words <= SHORT_LINE_WORDS) & (phrases | low.rlike(_NOTICE) | (F.regexp_count(low, F.lit(_LINK)) > MOST_LINKS * words))
    symbols = F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,;:!?'\"()\-]")) > size * MOST_SYMBOLS
    return (size > 0) & (~t.rlike(r"\p{L}") | navigation | punctuation | symbols | boilerplate)


def line_fails(line: Column) -> Column:
    return F.get(F.transform(line_measures(F.array(line)), fails), F.lit(0))


def windows_of(words: Column) -> Column:
    """The hashes of the three-word windows of ``words``."""
    return F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<long>"))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns ``MEASURES`` in place of any of these names."""
    docs = docs.drop(*MEASURES)
    _text, _words, _windows, _sorted, _made = free_names(docs, "_text", "_words", "_windows", "_sorted", "_made")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n", -1)
    worded = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumn(_text, text).withColumn(_words, words_of(F.col(_text)))
    rows = rows.withColumn(_windows, windows_of(F.col(_words)))
    # windows sorted with their places: equal neighbours are repeats
    order = F.sort_array(F.transform(_windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.withColumn(_sorted, F.when(F.size(F.array_distinct(_windows)) < F.size(_windows), order))
    n = F.size(_sorted)

    def twice(x: Column, i: Column) -> Column:
        before, after = F.get(_sorted, i - 1), F.get(_sorted, i + 1)
        return F.coalesce((i > 0) & (before["w"] == x["w"]), F.lit(False)) | F.coalesce((i + 1 < n) & (after["w"] == x["w"]), F.lit(False))

    places = F.sort_array(F.transform(F.filter(_sorted, twice), lambda x: x["i"]))

    def add(held: Column, at: Column) -> Column:
        return F.struct(F.least(F.lit(3), at + 3 - held["end"]).alias("more"), (at + 3).alias("end"), (held["n"] + F.least(F.lit(3), at + 3 - held["end"])).alias("n"))

    zero = F.struct(F.lit(0).alias("more"), F.lit(0).alias("end"), F.lit(0).alias("n"))
    repeats = F.coalesce(F.aggregate(places, zero, add, lambda held: held["n"]), F.lit(0)).cast("long")
    kept_lines = F.transform(F.filter(line_measures(lines), lambda m: ~fails(m)), lambda m: m["line"])
    # exploding one struct keeps later filters on the measures from being pushed below and repeated there
    made = F.explode(F.array(F.struct(
        F.size(_words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(_text, _BLANKS, "")).cast("long").alias("word_chars"),
        F.regexp_count(_text, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        F.array_join(kept_lines, "\n").alias("kept_text"),
    )))
    rows = rows.select(*docs.columns, made.alias(_made)).select(*docs.columns, f"{_made}.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    left = F.length(F.regexp_replace("kept_text", _BLANKS, ""))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (left >= (1 - MOST_LOST) * F.col("word_chars")))


def cleaned(docs: DataFrame) -> DataFrame:
    """The kept documents with their failing lines taken out; the columns of ``docs``."""
    own = {c: f"_{i}_{c}" for i, c in enumerate(docs.columns) if c in MEASURES}  # these are not the measures' to replace here
    kept = measured(docs.withColumnsRenamed(own)).filter("kept").withColumn("text", F.col("kept_text"))
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))
