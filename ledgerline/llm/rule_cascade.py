"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule is a rejecting condition on a text and on measures of it.  Before the
run, each rule's cost and selectivity (the share of the sample that it
rejects) are estimated; rules then stand in order of rejections per cost and
are evaluated by one CASE, which stops at the first that rejects.  The order
changes what a run costs, never which documents are kept.

Cost is the time of a rule over the sample, which one task holds in memory
and goes through again and again until ``EVALUATIONS`` are made, less the time
of a loop that only reads the same columns; of ``TRIES`` the least counts.

``survivors`` computes a measure only where a rule that asks for it is
reached.  ``judge`` returns all measures of every row, so there the cascade
saves what the rules do with the text itself.

Plan: a scan and projections; no shuffle and no Python.  Measures are linear
in the text (repeats: n log n, for texts that have a repeat).

Defined results: a null or empty text has no words, all measures are 0 and
it fails the base rules; repeated rows are judged alike; other columns are
not read, so they may have any name; an empty table gives no rows (rules
then keep the order they were declared in, as do rules of equal gain).
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import GAP, WORD, bind, col

#: Documents that are sampled (each as likely as any other; this many are expected), and what is timed.
SAMPLE_ROWS, EVALUATIONS, TRIES = 256, 8192, 1
REPEAT_WINDOW = 5


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), GAP, "")).cast("long")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(tokens: Column, width: int = REPEAT_WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text.

    Windows are compared by a 64-bit hash of word hashes.  Sorted by (hash,
    place), equal windows are neighbours; the places of repeated windows, in
    order, each add the words up to the next place, ``width`` at most.
    """

    def covered(pairs: Column) -> Column:
        n = F.size(pairs)
        own = F.transform(
            pairs,
            lambda p, k: F.when(
                ((k > 0) & (F.get(pairs, k - 1)["h"] == p["h"])) | ((k < n - 1) & (F.get(pairs, k + 1)["h"] == p["h"])),
                p["i"],
            ),
        )
        places = F.array_sort(F.filter(own, lambda i: i.isNotNull()))
        return bind(
            places,
            lambda x: F.aggregate(
                F.transform(x, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(x, k + 1) - i, F.lit(width)))),
                F.lit(0).cast("long"),
                lambda a, b: a + b,
            ),
        )

    def of_windows(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(bind(pairs, covered))

    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) < 2 * 1 + width - 1, F.lit(0).cast("long")).otherwise(
        bind(hashed, lambda h: bind(F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])), of_windows))
    )


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, all long."""
    text = F.col(text_col)
    tokens = docs.withColumn("__words", words(text))
    return tokens.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": word_chars(text),
            "n_symbols": count_of(text, SYMBOLS),
            "n_dup_lines": duplicate_lines(text),
            "n_repeat_words": repeated_words(F.col("__words")),
        }
    ).drop("__words")


SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean column over the text column and the measures, as SQL."""

    name: str
    rejects: str


#: In SQL that Spark and other engines read alike, on ``text`` (never null there) and the measures.
RULES = (
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * (length(text) - length(replace(text, chr(10), '')) + 1)"),
    Rule("shouting", "10 * length(regexp_replace(text, '[^A-Z]', '{g}')) > 4 * word_chars"),
    Rule("exclamations", "10 * (length(text) - length(replace(text, '!', ''))) > n_words"),
    Rule("no_letters", "3 * length(regexp_replace(text, '[^0-9]', '{g}')) > word_chars"),
)


def spark_rule(rule: Rule) -> Column:
    return F.expr(rule.rejects.replace(", '{g}')", ", '')"))


#: The contract's own rules, for ``survivors``.
BASE = (Rule("few_words", "n_words < 10"), Rule("repeats", "100 * n_repeat_words > 20 * n_words"))


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 5) -> DataFrame:
    """About ``rows`` rows of ``docs``, in one task."""
    n = docs.count()
    return (docs.sample(min(1.0, rows / n), seed) if n else docs).repartition(1)


def ordered_by_gain(sample: DataFrame, rules: Sequence[Rule] = RULES, lazy: bool = False) -> list[tuple[Rule, float, float]]:
    """(rule, seconds an evaluation, share rejected) by rejections per cost, estimated on ``sample(text)``.

    With ``lazy`` a rule's cost includes the measures it needs.  The sample steers the order only.
    """
    held = (sample if lazy else with_measures(sample)).persist()
    try:
        n = held.count()
        if not n:
            return [(r, 0.0, 0.0) for r in rules]
        times = -(-EVALUATIONS // n)
        again = held.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.lit(times))))
        columns = [c for c in held.columns if c != "text"]

        def seconds(condition: Column, lazily: bool) -> tuple[float, int]:
            least = float("inf")
            for _ in range(TRIES):
                began = time.perf_counter()
                found = (with_measures(again) if lazily else again).agg(F.count_if(condition).alias("n")).first().n
                least = min(least, time.perf_counter() - began)
            return least, found

        nothing = F.octet_length("text") < 0
        for c in columns:
            nothing = nothing | F.col(c).isNull()
        empty, _ = seconds(nothing, False)
        found = []
        for rule in rules:
            took, rejected = seconds(spark_rule(rule), lazy)
            found.append((rule, max(took - empty, 0.0) / (n * times), rejected / (n * times)))
    finally:
        held.unpersist()
    return sorted(found, key=lambda x: -x[2] / max(x[1], 1e-9))


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule, in this order, that rejects; null if none does."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        out = out.when(spark_rule(rule), F.lit(rule.name))
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures of every row, base_failed, rejected_by (``base`` or a rule's name) and kept."""
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [rule for rule, _, _ in ordered_by_gain(sampled(rows.select("text")), rules)]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = with_measures(rows).withColumn("base_failed", base).withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order)))
    return judged.withColumn("kept", F.col("rejected_by").isNull()).drop("text")


def survivors(docs: DataFrame, rules: Sequence[Rule] = BASE + RULES, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, that no rule rejects; what the rules that were not reached need is not computed."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    rows = plain.withColumn("text", F.coalesce(F.col(f"c{docs.columns.index(text_col)}").cast("string"), F.lit("")))
    order = [rule for rule, _, _ in ordered_by_gain(sampled(rows.select("text")), rules, lazy=True)]
    return with_measures(rows).where(cascade(order).isNull()).select(*plain.columns).toDF(*docs.columns)
