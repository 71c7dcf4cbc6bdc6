"""Quality rules, lines first: failing lines go, then documents that lost too much text.

All of it is DataFrame expressions on one row; a document never leaves its row and nothing
is shuffled.

Nulls and odd input: a null text has no words and no lines. Blank lines are neither judged
nor removed. A document without words fails. Repeated rows are judged alike. Columns whose
names clash with the measures are replaced; other extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document keeps at least this share of its word characters, in percent.
MIN_KEPT_PERCENT = 50
SYMBOL_PERCENT = 10
SHOUT_WORDS = 3
NAVIGATION_BARS = 2
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
TERMINAL = ".!?…。！？:;\"'”’»)]"
#: Fixed phrases of page furniture, matched in lower case.
BOILERPLATE = (
    "all rights reserved|privacy policy|terms of (use|service)|cookies?( policy|s on this| to improve)|"
    "enable javascript|subscribe to our|sign up for|click here|licensed under|released under the|copyright ©|"
    "powered by|log in to"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than blank, tab, line breaks and form feeds."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(
        F.array().cast("array<string>")
    )


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("bigint")


def symbol_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice; windows compare as 64-bit hashes.

    Windows are sorted with their places, so equal ones are neighbours; the places of those
    then go in order, and each adds the words the one before did not cover.
    """
    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(order: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(order, j)["h"] == x["h"], F.lit(False))
            return F.filter(order, lambda x, j: same(x, j - 1) | same(x, j + 1))

        places = F.array_sort(F.transform(let(placed, twice), lambda x: x["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")),
            lambda a: a["n"],
        )

    def counted(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )
        unique = lambda h: F.size(F.array_distinct(h)) == F.size(h)
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(
            let(windows, lambda h: F.when(unique(h), F.lit(0)).otherwise(covered(h)))
        )

    return let(words, counted).cast("bigint")


def has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACES))) > 0


def line_fails(line: Column) -> Column:
    """The line rules: punctuation, symbols, shouting, navigation and boilerplate."""
    def judged(s: Column) -> Column:
        chars = word_chars(s)
        bars = F.length(s) - F.length(F.translate(s, "|»›•", ""))
        blanks = F.length(s) - F.length(F.translate(s, " ", ""))
        return (
            (F.instr(F.lit(TERMINAL), F.substring(s, -1, 1)) == 0)
            | (symbol_count(s) * 100 >= chars * SYMBOL_PERCENT)
            | ((F.upper(s) == s) & (F.lower(s) != s) & (blanks >= SHOUT_WORDS - 1))
            | (bars >= NAVIGATION_BARS)
            | F.lower(s).rlike(BOILERPLATE)
        )

    return let(F.btrim(line, F.lit(SPACES)), judged)


def assess(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures, ``clean_text`` (the lines that pass), ``base_failed`` and ``kept``."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(body, "\n")
    worded = F.filter(lines, has_word)
    clean = F.array_join(F.filter(lines, lambda x: ~(has_word(x) & line_fails(x))), "\n")
    measured = docs.withColumns({
        "n_words": F.size(words_of(body)).cast("bigint"),
        "word_chars": word_chars(body),
        "n_symbols": symbol_count(body),
        "n_dup_lines": let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")),
        "n_repeat_words": repeated_words(words_of(body)),
        "clean_text": clean,
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        measured.withColumn("clean_chars", word_chars(F.col("clean_text")))
        .withColumn("base_failed", failed)
        .withColumn(
            "kept", ~F.col("base_failed") & (F.col("clean_chars") * 100 >= F.col("word_chars") * MIN_KEPT_PERCENT)
        )
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their failing lines removed and ``n_chars`` renewed."""
    passed = assess(docs.select("doc_id", "text", "lang", "source", "n_chars")).where("kept")
    return passed.select(
        "doc_id", F.col("clean_text").alias("text"), "lang", "source",
        F.length("clean_text").cast("bigint").alias("n_chars"),
    )
