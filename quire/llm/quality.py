"""Line-first cleaning: judge every line, remove failures, then judge the document.

DataFrame functions only. A line is what lies between line feeds; a word is a run
of characters outside ``[\\x20\\x09-\\x0D]``. A line without a word is dropped
silently and counts as no loss. A line with words fails when one of these holds:

* punctuation: marks of noise (``#*$%&<>!`` and ``|``) make up 8 % or more of its
  characters, or 30 words pass without any of ``. , ; : ? !``;
* navigation: one of ``| » › •`` for every six words or more often;
* boilerplate: it has one of ``BOILERPLATE`` (site furniture, not prose).

A document is kept when it passes the base rules and at least half of the
characters of its lines with words survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
NOISE = "#*$%&|<>!"
SEPARATORS = "|»›•"
STOPS = r"[.,;:?!]"
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use",
    "terms of service", "enable javascript", "lorem ipsum", "click here", "skip to content",
    "sign up for our newsletter", "back to top",
)


def _chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def window_hashes(ws: Column, size: int) -> Column:
    """One 64-bit hash per window of ``size`` words; empty for shorter texts."""

    # The one-element array binds the word hashes, so that windows don't compute them again.
    def windows(h: Column) -> Column:
        last = F.size(h) - size
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[h[i + k] for k in range(size)]))

    return F.element_at(F.transform(F.array(F.transform(ws, lambda w: F.xxhash64(w))), windows), 1)


def repeated_words(windows: Column, size: int) -> Column:
    """Words inside windows whose hash occurs more than once, the first occurrence included."""

    def starts(s: Column) -> Column:
        # s: (hash, position) in order; neighbours of the same hash are repeats.
        n = F.size(s)
        hit = F.filter(
            s,
            lambda x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == x["h"]))
            | ((j < n - 1) & (s[F.least(j + 1, n - 1)]["h"] == x["h"])),
        )
        return F.array_sort(F.transform(hit, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        n = F.size(p)
        gaps = F.transform(p, lambda x, j: F.when(j < n - 1, F.least(F.lit(size), p[F.least(j + 1, n - 1)] - x)).otherwise(F.lit(size)))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = F.element_at(F.transform(F.transform(F.array(pairs), starts), covered), 1)
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), found).otherwise(F.lit(0))


def line_fails(line: Column) -> Column:
    n_words = F.size(F.split(F.regexp_replace(line, rf"^{SPACE}|{SPACE}\z", ""), SPACE))
    noise = 100 * _chars(line, NOISE) >= 8 * F.length(line)
    no_stops = (n_words >= 30) & ~line.rlike(STOPS)
    navigation = (_chars(line, SEPARATORS) > 0) & (6 * _chars(line, SEPARATORS) >= n_words)
    low = F.lower(line)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | low.contains(phrase)
    return noise | no_stops | navigation | boilerplate


def clean_lines(
    docs: DataFrame, text_col: str = "text", window: int = 5, min_words: int = 10, max_repeat_pct: int = 20, min_kept_pct: int = 50
) -> DataFrame:
    """Every row of ``docs`` with its counts, its cleaned text and whether to keep it.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_failed_lines, kept_chars, line_chars (long), base_failed, kept (boolean),
    cleaned (string: the lines that pass, joined by line feeds). Columns of those
    names in the input are replaced. A null text counts as empty: no words, so the
    base rules fail it. Each row is judged alone; equal rows get equal results.
    """
    made = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        "n_failed_lines", "kept_chars", "line_chars", "base_failed", "kept", "cleaned",
    ]
    kept = [c for c in docs.columns if c not in made]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ws = words(text)
    step = docs.select(
        *kept,
        ws.alias("_words"),
        lines.alias("_lines"),
        (F.length(text) - _chars(text, SPACE_CHARS)).alias("_word_chars"),
        _chars(text, SYMBOLS).alias("_symbols"),
    )
    step = step.withColumn("_windows", window_hashes(F.col("_words"), window))
    step = step.withColumn("_pass", F.filter("_lines", lambda x: ~line_fails(x)))
    chars = lambda c: F.aggregate(F.col(c), F.lit(0), lambda a, x: a + F.length(x))
    step = step.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.col("_word_chars").cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_windows"), window).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_pass")).cast("long").alias("n_failed_lines"),
        chars("_pass").cast("long").alias("kept_chars"),
        chars("_lines").cast("long").alias("line_chars"),
        F.array_join("_pass", "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    ok = ~failed & (100 * F.col("kept_chars") >= min_kept_pct * F.col("line_chars"))
    return step.select(*kept, *made[:9], failed.alias("base_failed"), ok.alias("kept"), "cleaned")
