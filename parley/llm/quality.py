"""Quality rules from a threshold table, compiled into one projection (operator 2).

All measures are built-in column functions of the whole text, so the rules run inside
the scan, without a shuffle. Null and empty texts have no words and fail the base rule.
Repeated rows are judged each by itself.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.common import carried, let, prepare, words

WINDOW = 8
#: Symbol characters, and frequent short words of English, French, German and Spanish.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in is that for it as with on are by was this be at "
    "le la les de des du un une et en que est pour dans qui au par sur "
    "der die und das den von zu mit ist ein eine dem nicht für "
    "el los las y una se con del por lo su no es"
).split()


class Rule(NamedTuple):
    """Rejects a text of at least ``min_words`` words whose ``measure`` leaves [low, high]."""

    name: str
    measure: str
    low: float | None
    high: float | None
    min_words: int = 0


#: The threshold table. A measure is a key of ``ratios``.
RULES = (
    Rule("word_length", "mean_word_length", 2.0, 12.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("shouting", "marks_per_word", None, 0.5),
    Rule("capitals", "capital_share", None, 0.45),
    Rule("stop_words", "stop_word_share", 0.02, None, 100),
    Rule("repeated_lines", "repeated_line_share", None, 0.5, 50),
    Rule("line_length", "words_per_line", 1.5, None, 50),
)


def _repeated(w: Column) -> Column:
    """Words inside windows of WINDOW words found twice or more; ``w`` is a bound array."""
    shift = lambda a, n: F.slice(a, n + 1, F.size(a))
    pair = lambda a, n: F.zip_with(a, shift(a, n), lambda x, y: F.xxhash64(x, y))
    one = F.transform(w, lambda x: F.xxhash64(x))
    all_windows = let(one, lambda a: let(pair(a, 1), lambda b: let(pair(b, 2), lambda c: pair(c, 4))))
    windows = F.slice(all_windows, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))

    def starts(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            same = F.zip_with(s, shift(s, 1), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
            twice = let(same, lambda e: F.zip_with(e, F.concat(F.array(F.lit(False)), e), lambda x, y: F.coalesce(x, F.lit(False)) | y))
            return F.sort_array(F.array_compact(F.zip_with(s, twice, lambda x, f: F.when(f, x["i"]))))

        return let(ordered, flagged)

    def covered(h: Column) -> Column:
        width = lambda p: F.zip_with(p, shift(p, 1), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))))
        total = let(starts(h), lambda p: F.aggregate(width(p), F.lit(0), lambda t, x: t + x))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(total)

    return let(windows, covered)


def counts(text: Column) -> dict[str, Column]:
    """The counted measures of a text, each null-free."""
    t = F.coalesce(text, F.lit(""))
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    upper = F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))
    of_words = let(words(t), lambda w: F.struct(
        F.size(w).alias("n"), _repeated(w).alias("r"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("s")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return {
        "of_words": of_words, "of_lines": of_lines,
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")), "n_symbols": without(SYMBOLS),
        "n_marks": without("!?"), "n_capitals": upper,
    }


def ratios() -> dict[str, Column]:
    """What the threshold table may name, over the columns of ``measure``."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "marks_per_word": F.col("n_marks") / n,
        "capital_share": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "stop_word_share": F.col("n_stop_words") / n,
        "repeated_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def failed(rules: tuple[Rule, ...] = RULES) -> Column:
    """The first rule of the table that rejects, else null."""
    known, tests = ratios(), []
    for rule in rules:
        m = known[rule.measure]
        out = F.lit(False)
        if rule.low is not None:
            out = out | (m < rule.low)
        if rule.high is not None:
            out = out | (m > rule.high)
        tests.append(F.when((F.col("n_words") >= rule.min_words) & out, F.lit(rule.name)))
    return F.coalesce(*tests, F.lit(None).cast("string"))


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row`` (all columns of ``docs``), the counts, ``base_failed``, ``failed_rule`` and ``kept``."""
    prepare(docs.sparkSession)
    made = carried(docs, **counts(F.col(f"`{text_col}`")))
    flat = made.select(
        "row", F.col("of_words.n").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), F.col("of_lines.d").cast("long").alias("n_dup_lines"),
        F.col("of_words.r").cast("long").alias("n_repeat_words"), F.col("of_words.s").cast("long").alias("n_stop_words"),
        F.col("of_lines.n").cast("long").alias("n_lines"), "n_marks", "n_capitals")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return flat.withColumns({"base_failed": base, "failed_rule": failed(rules)}).withColumn(
        "kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    return judge(docs, text_col, rules).filter("kept").select("row.*")
