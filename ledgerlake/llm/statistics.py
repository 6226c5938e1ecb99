"""Statistics of whole texts as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.llm.common import BLANKS, WORD

# The characters counted as symbols, and the window of repeated words.
SYMBOLS = r"#*$%&|<>"
WINDOW = 8


def _count(text: Column, keep: str) -> Column:
    """Code points of the class ``keep``."""
    return F.length(F.regexp_replace(text, F.lit(f"[^{keep}]+"), F.lit(""))).cast("long")


def _by_window(windows: Column) -> Column:
    """Windows with their places, equal ones next to each other."""
    return F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))


def _repeated_starts(placed: Column) -> Column:
    """Places of windows that occur twice or more, in order."""

    def twice(x: Column, j: Column) -> Column:
        same = [F.get(placed, j + step)["w"] == x["w"] for step in (-1, 1)]
        return F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False))

    return F.sort_array(F.transform(F.filter(placed, twice), lambda x: x["i"]))


def _paired(hashes: Column, step: int) -> Column:
    """The hash of each element and the one ``step`` places on."""
    count = F.size(hashes) - step
    return F.zip_with(
        F.slice(hashes, F.lit(1), count),
        F.slice(hashes, F.lit(step + 1), count),
        lambda x, y: F.xxhash64(x, y),
    )


def with_statistics(docs: DataFrame, *keep: str, repeats: bool = True) -> DataFrame:
    """The columns ``keep`` and the statistics of ``text`` (null: no text).

    ``n_chars``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_upper``, ``n_marks``
    (exclamation and question marks), ``n_distinct``, ``n_lines`` and ``n_dup_lines`` (lines
    with a word; those equal to an earlier one) and, with ``repeats``, ``n_repeat_words`` (words
    in windows of eight words found at least twice); all long.  Windows are compared by 64-bit hash.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    text_of = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("_text"))
    text = F.col("_text")
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare != "", F.split(bare, BLANKS)).otherwise(F.array().cast("array<string>"))
    blanks = F.length(F.regexp_replace(text, F.lit(WORD), F.lit("")))
    split = text_of.select(
        *keep,
        F.length(text).cast("long").alias("n_chars"),
        (F.length(text) - blanks).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
        _count(text, r"\p{Lu}").alias("n_upper"),
        _count(text, "!?").alias("n_marks"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
    )
    words, lines = F.col("_words"), F.col("_lines")
    counts = [
        *keep, "n_chars", "word_chars", "n_symbols", "n_upper", "n_marks",
        F.size(words).cast("long").alias("n_words"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    ]
    if not repeats:
        return split.select(*counts)
    # Hashes of 2, 4, then 8 words; a text of one window cannot repeat it.
    hashed = split.select(*counts, F.when(F.size(words) > WINDOW, words).alias("_windows"))
    for step in (1, 2, 4):
        hashed = hashed.withColumn("_windows", _paired(F.col("_windows"), step))
    # Most texts repeat no window and need no sort.
    windows = F.col("_windows")
    found = F.size(F.array_distinct(windows)) < F.size(windows)
    placed = hashed.withColumn("_placed", F.when(found, _by_window(windows))).drop("_windows")
    starts = placed.withColumn("_starts", _repeated_starts(F.col("_placed"))).drop("_placed")
    at = F.col("_starts")
    spans = F.transform(
        at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)))
    )
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x)
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).drop("_starts")


def ratios(repeats: bool = True) -> dict[str, Column]:
    """Measures that do not grow with the text, from the columns of ``with_statistics``."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    found = {"repeat_share": F.col("n_repeat_words") / words} if repeats else {}
    return found | {
        "symbols_per_word": F.col("n_symbols") / words,
        "upper_share": F.col("n_upper") / chars,
        "marks_per_word": F.col("n_marks") / words,
        "distinct_share": F.col("n_distinct") / words,
        "word_length": F.col("word_chars") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "words_per_line": F.col("n_words") / lines,
        "words": F.col("n_words").cast("double"),
    }
