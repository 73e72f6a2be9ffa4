"""Line-first cleaning of documents with DataFrame functions only.

Every line with a word is judged by itself:

- punctuation: marks such as # * $ % & make up a tenth or more as many characters as the line
  has words (marks that lead a list line and single marks beside a number do not count), or words
  end in doubled exclamation or question marks, or nothing but marks is left;
- navigation: two or more separators such as | or » between entries, or at most three words that
  no sentence mark ends, in a document of several lines;
- boilerplate: fixed phrases of web pages make up at least half of the line's characters.

Failing lines are removed.  A document is rejected if it fails the base rules (fewer than 50
words, or more than half of its words in repeated three-word windows) or if less than half of the
characters of its words is left.  Base figures are those of the uncleaned text.

Figures of a text come from its own arrays, so no row is exploded or shuffled and hot sources
do not matter.  Repeated windows are found by sorting 64-bit hashes of three words (whose places
share the sort key, which limits a text to 2**26 words).

Defined cases: null counts as empty; an empty text has zero figures and is rejected; rows with
null ids and repeated rows are judged like others; an empty table gives an empty result; other
columns are passed through by ``clean`` and ignored by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import columns_of, rows_of, text_of

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
MIN_LEFT = 0.5  # of the characters in words
SYMBOLS = "#*$%&|<>"
SHORT_LINE = 3
WHITE = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
PLACE_BITS = 26

# fixed values: phrases of page furniture, lower case
BOILERPLATE = (
    "all rights reserved",
    "accept all cookies",
    "we use cookies",
    "privacy policy",
    "terms of use",
    "enable javascript",
    "lorem ipsum",
    "click here to",
    "to our newsletter",
    "page not found",
    "back to top",
    "skip to content",
)
PHRASES = "|".join(BOILERPLATE)
LIST_MARKS = r"^(?:[\x20\x09-\x0D]*[*#>]{1,6}(?=[\x20\x09-\x0D]))+"
BESIDE_NUMBER = (
    r"(?<![#*$%&<>])(?:[#*&<>]\x20?|\$[\x20\xA0]?)(?=[-+]?\.?\p{Nd})"
    r"|(?<=\p{Nd})[\x20\xA0\u202F]?%(?![#*$%&<>])"
)
END_MARKS = ".!?…:;\"'”’»)"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _word_chars(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.length(_without(text, WHITE))).otherwise(F.length(plain))


def _with_figures(rows: DataFrame) -> DataFrame:
    """Adds the base figures of ``w_text``; each step is a column so that later steps do not repeat it."""
    last_place = (1 << PLACE_BITS) - 1

    def window_of(key: Column) -> Column:
        return F.get("w_window", key.bitwiseAND(F.lit(last_place)).cast("int"))

    def near(key: Column, other: Column) -> Column:
        return F.shiftrightunsigned(key.bitwiseXOR(other), PLACE_BITS) == 0

    n = F.size("w_hash")
    pairs = F.zip_with(F.slice("w_hash", 1, n - 2), F.slice("w_hash", 2, n - 2), lambda a, b: F.xxhash64(a, b))
    windows = F.when(
        F.col("n_words") > 3, F.zip_with(pairs, F.slice("w_hash", 3, n - 2), lambda a, b: F.xxhash64(a, b))
    )
    keyed = F.when(
        F.size(F.array_distinct("w_window")) < F.size("w_window"),
        F.sort_array(
            F.transform("w_window", lambda h, i: h.bitwiseAND(F.lit(~last_place)).bitwiseOR(i.cast("long")))
        ),
    )
    close = F.filter(
        "w_sorted", lambda x, j: near(x, F.get("w_sorted", j + 1)) | near(x, F.get("w_sorted", j - 1))
    )
    twice = F.filter(
        "w_close",
        lambda x, j: (window_of(x) == window_of(F.get("w_close", j + 1)))
        | (window_of(x) == window_of(F.get("w_close", j - 1))),
    )
    covered = F.aggregate(
        F.sort_array(F.transform("w_twice", lambda x: x.bitwiseAND(F.lit(last_place)))),
        F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split("w_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (
        rows.withColumn("w_hash", F.transform(words_of(F.col("w_text")), lambda w: F.xxhash64(w)))
        .withColumn("n_words", F.size("w_hash").cast("long"))
        .withColumn("w_window", windows)
        .drop("w_hash")
        .withColumn("w_sorted", keyed)
        .withColumn("w_close", close)
        .drop("w_sorted")
        .withColumn("w_twice", twice)
        .drop("w_window", "w_close")
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("w_twice")
        .withColumn("word_chars", _word_chars(F.col("w_text")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("w_text", F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("w_lines", lines)
        .withColumn("n_dup_lines", (F.size("w_lines") - F.size(F.array_distinct("w_lines"))).cast("long"))
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
        )
    )


def line_fails(line: Column, flags: Column) -> Column:
    """Whether a line that holds a word fails a rule.

    The bits of ``flags`` say that the document has marks, a phrase, other lines;
    each rule is looked at only in documents where it can fail.  They are one column, used several
    times, because the optimizer would move a column that is used once into the loop over the lines.
    """
    marked, phrased, several = (flags.bitwiseAND(F.lit(1 << bit)) != 0 for bit in range(3))
    n_words = F.size(words_of(line))
    marks = F.length(line) - F.length(_without(line, "#*$%&<>"))
    after_list = F.regexp_replace(line, LIST_MARKS, "")
    counted = F.length(after_list) - F.length(_without(after_list, "#*$%&<>")) - F.regexp_count(after_list, F.lit(BESIDE_NUMBER))
    separators = F.length(line) - F.length(_without(line, "|»·•›"))
    shouted = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    ended = F.length(_without(F.substring(F.rtrim(line), -1, 1), END_MARKS)) == 0
    return (
        (
            marked
            & (
                ((marks > 0) & (10 * marks >= n_words) & (counted > 0) & (10 * counted >= n_words))
                | (5 * shouted >= n_words)
                | ((separators >= 2) & (4 * separators >= n_words))
            )
        )
        | ~line.rlike(r"[\p{L}\p{N}]")
        | (several & ~ended & (n_words <= SHORT_LINE))
        | (phrased & _has_phrase(F.lower(line)) & _mostly_phrases(F.lower(F.trim(line))))
    )


def _mostly_phrases(lower: Column) -> Column:
    return 2 * F.length(F.regexp_replace(lower, PHRASES, "")) <= F.length(lower)


def _has_phrase(lower: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(lower, F.lit(phrase))
    return found


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` (under ``row``), the figures, the cleaned text and the verdict."""
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), text_of(docs, text_col).alias("w_text"))
    return _judged(rows)


def _judged(rows: DataFrame) -> DataFrame:
    marked = F.col("n_symbols") > 0
    for mark in ("!!", "»", "·", "•", "›"):
        marked = marked | F.contains("w_text", F.lit(mark))
    phrased = ~F.col("base_failed") & _has_phrase(F.col("w_lower"))
    bits = [marked, phrased, F.size("w_lines") > 1]
    flags = sum(F.when(flag, F.lit(1 << bit)).otherwise(F.lit(0)) for bit, flag in enumerate(bits))
    kept_lines = F.filter("w_lines", lambda line: ~line_fails(line, F.col("w_flags")))
    return (
        _with_figures(rows)
        .withColumn("w_lower", F.lower("w_text"))
        .withColumn("w_flags", flags)
        .drop("w_lower")
        .withColumn("w_kept", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(kept_lines))
        .withColumn("clean_text", F.array_join("w_kept", "\n"))
        .withColumn("n_lines_removed", (F.size("w_lines") - F.size("w_kept")).cast("long"))
        .withColumn(
            "chars_left",
            F.when(F.col("n_lines_removed") == 0, F.col("word_chars"))
            .otherwise(_word_chars(F.col("clean_text")))
            .cast("long"),
        )
        .withColumn("kept", ~F.col("base_failed") & (F.col("chars_left") >= MIN_LEFT * F.col("word_chars")))
        .drop("w_text", "w_lines", "w_kept", "w_flags")
    )


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base figures, base_failed, the lines removed and whether the document is kept."""
    judged = _judged(rows_of(docs, id_col, w_text=text_of(docs, text_col)))
    return judged.select("doc_id", *FIGURES, "base_failed", "kept", "n_lines_removed", "chars_left")
