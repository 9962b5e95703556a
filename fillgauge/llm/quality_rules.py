"""Line-first cleaning and document rules, in column expressions only.

Every line is judged by itself: by its signs (symbols and shouting against its
words), as navigation (menus and tables of short cells) and as boilerplate
(legal notices, cookie and script notices, where one makes up a stated share of the
line). Lines that fail are removed. A
document is then rejected for what it is (too few words, too much of it
repeated) or for losing too much text.

The words of a text are the runs between ASCII white space. A word counts as
repeated when it lies in a window of eight words that occurs twice or more in
the text. Windows are compared by a 64-bit hash of their words, and only texts
with a repeated hash are sorted.

All work is within one row, so no key can be hot and nothing is shuffled; a text
of a million words takes one sort of its windows.

Results in special cases: a null or empty text has no words and is rejected;
blank lines are kept but never counted; repeated rows and null ids stay; an
empty table gives an empty one; other columns are carried only by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgauge.llm import common

#: White space between words, words, and the characters that count as symbols.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Length of the windows whose repetition counts.
WINDOW = 8

#: Cells of menus and tables are parted by these.
SEPARATORS = "|»›•·"
#: What stands in lines that no author wrote for the text, in lower case.
BOILERPLATE = (
    "all rights reserved", "copyright (c)", "copyright ©", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "cookie settings", "we use cookies", "enable javascript", "javascript is disabled",
    "subscribe to our newsletter", "click here to", "licensed under the", "spdx-license-identifier",
)


@dataclass(frozen=True)
class Limits:
    """Where lines and documents fail."""

    line_symbols: float = 0.25  # symbols of a line per word
    line_shouts: float = 0.5  # exclamation marks of a line per word
    line_separators: int = 2  # separators of a line of cells
    line_cell_words: float = 2.5  # words per cell in a menu or table
    line_boilerplate_percent: int = 15  # characters of a line's longest boilerplate phrase of all its characters
    min_words: int = 20
    max_repeat_percent: int = 30  # repeated words of all words
    max_removed_percent: int = 50  # characters of removed lines of all lines with a word


def count_of(text: Column, signs: str) -> Column:
    """How many of ``signs`` are in a text."""
    return F.length(F.regexp_replace(text, "[^" + re.escape(signs) + "]+", ""))


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def has_legal(low: Column) -> Column:
    """Whether a lower-case text holds a boilerplate phrase."""
    return F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda p: F.contains(low, p))


def longest_legal(low: Column) -> Column:
    """The length of the longest boilerplate phrase in a lower-case text, 0 without any."""
    held = F.transform(F.array(*map(F.lit, BOILERPLATE)), lambda p: F.when(F.contains(low, p), F.length(p)).otherwise(0))
    return F.array_max(held)


def line_rules(limits: Limits) -> Mapping[str, Column]:
    """What makes a line fail, by rule, given the fields of a measured line ``x``."""
    return {
        "punctuation": lambda x: (x["symbols"] > limits.line_symbols * x["words"]) | (x["shouts"] > limits.line_shouts * x["words"]),
        "navigation": lambda x: (x["cells"] >= limits.line_separators) & (x["words"] <= limits.line_cell_words * (x["cells"] + 1)),
        # a text may mention what a notice consists of
        "boilerplate": lambda x: (x["phrase"] > 0) & (100 * x["phrase"] >= limits.line_boilerplate_percent * x["chars"]),
    }


def measured(line: Column) -> Column:
    """A line with what its rules look at; it has a word more than white space.

    Signs are counted only where the document has any of them.
    """

    def of_line(total: str, signs: str) -> Column:
        return F.when(F.col(total) > 0, count_of(line, signs)).otherwise(0)

    separators = of_line("n_separators", SEPARATORS)
    return F.struct(
        line.alias("line"),
        F.length(line).alias("chars"),
        line.rlike(r"[^\x20\x09-\x0D]").alias("worded"),
        # separators are no words, so that a table does not hide behind them
        F.when(F.col("n_signs") > 0, F.regexp_count(line, F.lit(WORD)) - separators).otherwise(1).alias("words"),
        of_line("n_symbols", SYMBOLS.replace("|", "")).alias("symbols"),
        of_line("n_shouts", "!").alias("shouts"),
        separators.alias("cells"),
        F.when(F.col("legal"), longest_legal(F.lower(line))).otherwise(0).alias("phrase"),
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Counts, the cleaned text and the verdict of every document.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, line_chars, removed_chars, n_punctuation, n_navigation,
    n_boilerplate, clean_text, kept``.
    """
    common.prepare(docs.sparkSession)
    rules = line_rules(limits)
    failed = lambda x: x["worded"] & (rules["punctuation"](x) | rules["navigation"](x) | rules["boilerplate"](x))

    text = F.col("text")
    parts = common.texts(docs, id_col, text_col).select(
        "doc_id", "text", common.once(word_list(text)).alias("words"),
        common.once(count_of(text, SYMBOLS)).alias("n_symbols"), count_of(text, "!").alias("n_shouts"),
        count_of(text, SEPARATORS).alias("n_separators"), common.once(F.lower(text)).alias("low"),
    )
    parts = parts.withColumn("legal", common.once(has_legal(F.col("low")))).withColumn("n_signs", common.once(F.col("n_symbols") + F.col("n_shouts") + F.col("n_separators")))
    # single words are fetched, as slice() would copy the whole list for every window
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))),
    )
    hashed = parts.select(
        "doc_id", "text", "words", "n_symbols",
        common.once(F.transform(F.split(text, "\n"), measured)).alias("lines"),
        common.once(F.when(F.size("words") >= WINDOW, windows)).alias("hashes"),
    )
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ordered = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = hashed.select(
        "doc_id", "lines", "n_symbols",
        common.once(F.filter("lines", lambda x: x["worded"])).alias("worded"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        common.once(F.when(repeats, ordered)).alias("ordered"),
    )
    twin = lambda x, k: (F.get("ordered", k - 1)["h"] == x["h"]) | (F.get("ordered", k + 1)["h"] == x["h"])
    places = F.array_sort(F.transform(F.filter("ordered", lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["total"] + p + WINDOW - F.greatest(p, a["end"])).alias("total")),
        lambda a: a["total"],
    )
    plain = F.transform("worded", lambda x: x["line"])
    of = lambda rule: F.size(F.filter("worded", rule)).cast("long")
    chars = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    counted = sorted_.select(
        "doc_id", "n_words", "word_chars", F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct(plain))).cast("long").alias("n_dup_lines"),
        common.once(F.coalesce(F.when(F.col("ordered").isNotNull(), covered), F.lit(0)).cast("long")).alias("n_repeat_words"),
        chars("worded").alias("line_chars"),
        common.once(chars(F.filter("worded", failed))).alias("removed_chars"),
        of(rules["punctuation"]).alias("n_punctuation"),
        of(rules["navigation"]).alias("n_navigation"),
        of(rules["boilerplate"]).alias("n_boilerplate"),
        F.array_join(F.transform(F.filter("lines", lambda x: ~failed(x)), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    base_failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    lost = 100 * F.col("removed_chars") > limits.max_removed_percent * F.col("line_chars")
    return counted.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & ~lost)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The documents kept, their texts without the lines that failed, and all their columns."""
    kept = "__quality_rules_row"
    carried = docs.withColumn(kept, F.struct(*(common.column(c) for c in docs.columns)))
    # the row rides along as the id, so that no join is needed to bring its columns back
    judged = judge(carried, kept, text_col, limits).where("kept")
    return judged.select(
        *(F.col("clean_text").alias(c) if c == text_col else F.col("doc_id").getField(c).alias(c) for c in docs.columns)
    )


ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT r, doc_id, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
word AS (SELECT r, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM base),
windows AS (
  SELECT r, i, concat_ws(' ', w, {", ".join(f"lead(w, {k}) OVER o" for k in range(1, 8))}) AS w
  FROM word WINDOW o AS (PARTITION BY r ORDER BY i)
  QUALIFY lead(w, 7) OVER o IS NOT NULL),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY r),
line AS (
  SELECT r, length(l) AS chars,
    len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) - length(regexp_replace(l, '[^|»›•·]', '', 'g')) AS words,
    length(regexp_replace(l, '[^#*$%&<>]', '', 'g')) AS symbols,
    length(regexp_replace(l, '[^!]', '', 'g')) AS shouts,
    length(regexp_replace(l, '[^|»›•·]', '', 'g')) AS cells,
    coalesce(list_max(list_transform(list_filter({list(BOILERPLATE)!r}, lambda p: contains(lower(l), p)), lambda p: length(p))), 0) AS phrase
  FROM (SELECT r, unnest(lines) AS l FROM base)),
lost AS (
  SELECT r, sum(chars) AS all_chars,
    sum(CASE WHEN symbols > 0.25 * words OR shouts > 0.5 * words OR (cells >= 2 AND words <= 2.5 * (cells + 1))
        OR (phrase > 0 AND 100 * phrase >= 15 * chars) THEN chars ELSE 0 END) AS removed
  FROM line GROUP BY r),
counts AS (
  SELECT b.r, doc_id, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    coalesce(removed, 0) AS removed, coalesce(all_chars, 0) AS all_chars
  FROM base b LEFT JOIN repeated p ON p.r = b.r LEFT JOIN lost x ON x.r = b.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT 100 * removed > 50 * all_chars AS kept
FROM counts
"""
