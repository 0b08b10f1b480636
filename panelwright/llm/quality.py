"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a named predicate that is true for a document to reject. ``plan`` measures every rule on a random sample of bounded expected size: its cost (time
of a pass over the sample, the least of several) and its selectivity (share rejected), and sorts the rules by rejection per cost, the order that reaches a
verdict with the least expected work among independent rules. ``cascade`` then asks them in that order inside one CASE expression, so a rule is
evaluated only for documents that all earlier rules let pass. The order never changes a verdict of ``kept``, only the work and the name in ``rejected_by``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let

SYMBOLS = "[#*$%&|<>]"
#: Timings of each rule; the least counts.
REPEATS = 3


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def word_chars(words: Column) -> Column:
    """Code points in all words."""
    return F.length(F.array_join(words, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def capitals(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Z\u00c0-\u00d6\u00d8-\u00de]")).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines (split at \\n) that hold a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column, n: int = 3) -> Column:
    """Words that lie in a window of ``n`` words found twice or more in the text.

    The windows' 64-bit hashes are sorted with their places; equal neighbours are repeats; the places' gaps give the words covered.
    n log n in the text's length, and no row leaves its task.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.struct(F.xxhash64(*[F.get(h, i + k) for k in range(n)]).alias("h"), i.alias("p")))

    def repeats(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"]))

    start = F.struct(F.lit(0).alias("c"), F.lit(-n).alias("last"))
    covered = lambda places: F.aggregate(places, start, lambda a, p: F.struct((a["c"] + F.least(F.lit(n), p - a["last"])).alias("c"), p.alias("last")))["c"]
    counted = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(F.sort_array(windows(h)), lambda s: covered(repeats(s))))
    return F.when(F.size(words) < n, F.lit(0)).otherwise(counted).cast("long")


@dataclass(frozen=True)
class Rule:
    """``reject`` builds the predicate from the columns of ``measures`` that it names; a null predicate does not reject."""

    name: str
    reject: Callable[[], Column]


def base_rules(min_words: int = 50, max_repeat_percent: int = 50) -> list[Rule]:
    return [
        Rule("too_short", lambda: F.size("words") < min_words),
        Rule("repeats", lambda: 100 * repeated_words(F.col("words")) > max_repeat_percent * F.size("words")),
    ]


def shape_rules(max_symbols_per_word: float = 0.1, word_length: tuple[float, float] = (2.0, 15.0), max_duplicate_lines: float = 0.4, max_capitals: float = 0.3) -> list[Rule]:
    mean = lambda: word_chars(F.col("words")) / F.nullif(F.size("words"), F.lit(0))
    lines = lambda: F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    return [
        Rule("symbols", lambda: symbol_count(F.col("text")) > max_symbols_per_word * F.size("words")),
        Rule("word_length", lambda: (mean() < word_length[0]) | (mean() > word_length[1])),
        Rule("duplicate_lines", lambda: duplicate_lines(F.col("text")) > max_duplicate_lines * lines()),
        Rule("shouting", lambda: capitals(F.col("text")) > max_capitals * F.length("text")),
    ]


def default_rules() -> list[Rule]:
    return base_rules() + shape_rules()


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` (null: empty) and ``words``. The generator keeps the planner from splitting the text anew for each use."""
    return docs.withColumn(text, F.coalesce(F.col(text).cast("string"), F.lit(""))).select("*", F.explode(F.array(split_words(F.col(text)))).alias("words"))


def plan(docs: DataFrame, rules: list[Rule], prepare: Callable[[DataFrame], DataFrame] = None, sample_rows: int = 2000, seed: int = 17) -> list[Rule]:
    """``rules`` by rejection per cost, estimated on a random sample of about ``sample_rows`` whole documents, which stays on the executors.

    The rules are timed as they will run: on the columns that ``prepare`` makes (``with_words`` unless given), each ``REPEATS`` times.
    The sample bounds the cost of planning only; verdicts use every document. Ties and an empty table keep the given order.
    """
    share_kept = min(1.0, sample_rows / max(1, docs.count()))
    sample = (prepare or with_words)(docs.select("text").sample(share_kept, seed)).cache()
    try:
        sample.count()

        def timed(column: Column) -> tuple[float, float]:
            took, query = [], sample.agg(F.avg(F.coalesce(column, F.lit(False)).cast("int")))
            for _ in range(REPEATS):
                began = time.perf_counter()
                share = query.first()[0]
                took.append(time.perf_counter() - began)
            return min(took), share or 0.0

        floor = timed(F.length("text") < 0)[0]
        score = {}
        for rule in rules:
            cost, share = timed(rule.reject())
            score[rule.name] = share / max(cost - floor, 1e-3)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: -score[r.name])


def cascade(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rejected_by`` (name of the first rule that rejects, in the order given; null: none) and ``kept``.

    Needs ``text`` and ``words`` (``with_words``). Null and empty texts have no words; a null predicate lets a document pass;
    equal rows get equal verdicts; an empty table gives an empty one; other columns are carried along untouched.
    """
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.reject(), F.lit(False)), F.lit(rule.name)).otherwise(verdict)
    return docs.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())


def filter_documents(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The documents that no rule rejects, with their own columns and unchanged rows. Null texts count as empty and are rejected as too short."""
    rules = plan(docs, rules or default_rules())
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return cascade(with_words(row), rules).filter("kept").select("row.*")


def with_measures(docs: DataFrame) -> DataFrame:
    """``docs`` with ``words`` and the base measures, each computed once."""
    words = F.col("words")
    base = F.struct(F.size(words).cast("long").alias("n_words"), word_chars(words).alias("word_chars"), symbol_count(F.col("text")).alias("n_symbols"), duplicate_lines(F.col("text")).alias("n_dup_lines"), repeated_words(words).alias("n_repeat_words"))
    out = with_words(docs).select("*", F.explode(F.array(base)).alias("__m")).select(*docs.columns, "words", "__m.*")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def measured_rules() -> list[Rule]:
    """``shape_rules`` over the columns of ``with_measures``."""
    return [
        Rule("symbols", lambda: F.col("n_symbols") > 0.1 * F.col("n_words")),
        Rule("word_length", lambda: (F.col("word_chars") < 2.0 * F.col("n_words")) | (F.col("word_chars") > 15.0 * F.col("n_words"))),
        Rule("duplicate_lines", lambda: F.col("n_dup_lines") > 0.4 * F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))),
        Rule("shouting", lambda: capitals(F.col("text")) > 0.3 * F.length("text")),
    ]


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: the base measures, the base verdict and the cascade's. See ``op6`` in ``queries`` for the columns.

    Null texts count as empty; repeated rows are measured each; very long texts are measured whole; an empty table gives an empty one; other columns are not read.
    """
    slim = docs.select("doc_id", "text")
    rules = plan(slim, measured_rules(), lambda sample: with_measures(sample))
    first = [Rule("base", lambda: F.col("base_failed"))]
    return cascade(with_measures(slim), first + rules).drop("text", "words")
