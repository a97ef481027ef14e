"""Quality rules in a short-circuit cascade.

Every rule is a boolean column expression that holds for a text to be rejected.
On a bounded sample, taken from places spread over the table, each rule's cost is
timed and its selectivity counted; rules then run in the order of rejections per
second.  The cascade is one CASE expression, so a text that a cheap rule rejects
doesn't pay for the later ones.  The order changes what a text costs, never the
verdict.

``judge`` returns all counts of all rows and so has to make them all; its cascade
spares the rules behind the counts.  ``sieve`` returns the rows that pass and
makes every count inside the rule that asks for it, so that it spares the counts
too, the dear search for repeated windows among them.

Only DataFrame functions run here.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import fixed, fresh

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Most texts that costs and selectivities are estimated on, most files that they are taken from, how often a text counts
#: in a timing, and how many timings the least is taken of.
SAMPLE, PLACES, TIMES, TIMINGS = 256, 8, 4, 2


@dataclass(frozen=True)
class Rule:
    """``reject`` is true for rows to turn away; it may use any column of the table."""

    name: str
    reject: Column


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def word_chars(found: Column) -> Column:
    return F.length(F.array_join(found, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_repeat_words(found: Column, window: int = WINDOW) -> Column:
    """How many of the words (an array) lie in a window of ``window`` words that occurs twice or more.

    Windows are known by the 64-bit hash of their words.  Texts without a repeated window, which ``array_distinct``
    finds by hashing, skip the search for the places of repeated ones.
    """

    def covered(keys: Column) -> Column:
        """Sorted by key and place, a repeated window has its like beside it; each place covers what is left of its window
        before the next place."""

        def places(pairs: Column) -> Column:
            last = F.size(pairs) - 1
            like = lambda x, i: (i > 0) & (F.get(pairs, i - 1)["k"] == x["k"]) | (i < last) & (F.get(pairs, i + 1)["k"] == x["k"])
            return F.sort_array(F.transform(F.filter(pairs, lambda x, i: F.coalesce(like(x, i), F.lit(False))), lambda x: x["i"]))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda p, i: F.coalesce(F.least(F.lit(window), F.get(at, i + 1) - p), F.lit(window)))
            return F.aggregate(steps, F.lit(0), lambda x, y: x + y)

        pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), _let(_let(pairs, places), total)).otherwise(0)

    def windows(codes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(codes) - window), lambda i: F.xxhash64(*[F.get(codes, i + j) for j in range(window)]))

    codes = F.transform(found, lambda w: F.xxhash64(w))
    return F.when(F.size(found) >= window, _let(_let(codes, windows), covered)).otherwise(0).cast("long")


def with_counts(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) to each row.  A null text counts as empty."""
    t, found = F.coalesce(F.col(text), F.lit("")), fresh("words")
    out = docs.withColumn(found, fixed(words(t)))
    return out.withColumns({"n_words": F.size(found).cast("long"), "word_chars": word_chars(F.col(found)), "n_symbols": n_symbols(t), "n_dup_lines": n_dup_lines(t), "n_repeat_words": n_repeat_words(F.col(found), window)}).drop(found)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _rules(text: Column, n: Column, chars: Column, symbols: Column, dup_lines: Column) -> list[Rule]:
    return [
        Rule("symbols", 10 * symbols > n),
        Rule("long_words", chars > 15 * n),
        Rule("short_words", 2 * chars < 5 * n),
        Rule("repeated_lines", 5 * dup_lines > F.greatest(F.lit(3), F.size(F.split(text, "\n"))) * 2),
        Rule("stuttering", text.rlike(r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?:\x20\1){4}(?:[\x20\x09-\x0D]|$)")),
    ]


def default_rules() -> list[Rule]:
    """Rules over the columns of ``with_counts``, in whole numbers so that any engine decides alike."""
    return _rules(F.coalesce(F.col("text"), F.lit("")), *map(F.col, ("n_words", "word_chars", "n_symbols", "n_dup_lines")))


def text_rules(text: Column, found: Column) -> list[Rule]:
    """The base rules and the default ones over a text and its words alone."""
    n = F.size(found).cast("long")
    base = [Rule("few_words", n < 10), Rule("repeated_words", 100 * n_repeat_words(found) > 20 * n)]
    return base + _rules(text, n, word_chars(found), n_symbols(text), n_dup_lines(text))


def spread(df: DataFrame, sample: int = SAMPLE, places: int = PLACES) -> DataFrame:
    """At most ``sample`` rows: the first ones of at most ``places`` files that lie evenly among the files of a table.  A
    table that isn't read from several files gives its first rows."""
    files = sorted({f.rsplit("/", 1)[-1] for f in df.inputFiles()})
    if len(files) < 2:
        return df.limit(sample)
    places = min(places, len(files), sample)
    chosen = [files[i * len(files) // places] for i in range(places)]
    parts = [df.where(F.col("_metadata.file_path").endswith(f)).limit(sample // places) for f in chosen]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ordered(df: DataFrame, rules: list[Rule], sample: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected) in the order in which the cascade should run them.

    The first ``sample`` rows of ``df`` are looked at, each ``TIMES`` times in every timing.  What a timing takes without
    a rule is taken off.  Rules that reject nothing there come last, cheapest first.
    """
    rows = df.limit(sample).repartition(1).cache()
    hits = [F.sum(F.coalesce(rule.reject, F.lit(False)).cast("long")) for rule in rules]
    total, *rejected = rows.agg(F.count("*"), *hits).first()
    often = rows.withColumn(fresh("turn"), F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def seconds(what: Column) -> float:
        taken = []
        for _ in range(TIMINGS):
            began = time.perf_counter()
            often.agg(what).first()
            taken.append(time.perf_counter() - began)
        return min(taken)

    base = seconds(F.count("*"))
    cost = [max(1e-9, (seconds(hit) - base) / (TIMES * max(1, total))) for hit in hits]
    rows.unpersist()
    found = [(rule, c, (r or 0) / max(1, total)) for rule, c, r in zip(rules, cost, rejected, strict=True)]
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1]))


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects the row, null if none does.  CASE tries its branches in order."""
    out = None
    for rule in rules:
        hit = F.coalesce(rule.reject, F.lit(False))
        out = F.when(hit, F.lit(rule.name)) if out is None else out.when(hit, F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample: int = SAMPLE) -> DataFrame:
    """Adds the counts, base_failed, rejected_by (name of the rule, or null) and kept to each row of ``docs``.

    A null or empty text has no words and fails the base rule.  A very long text
    is judged whole; its words take some ten times its size while it is.  Repeated
    rows are judged alike, whatever their id.  Columns of ``docs`` that carry one
    of these names are replaced, others stay.  An empty table gives an empty
    result.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")
    rules = default_rules() if rules is None else rules
    order = [rule for rule, _, _ in ordered(with_counts(spread(docs, sample)), rules, sample)]
    out = with_counts(docs).withColumn("base_failed", base_failed())
    out = out.withColumn("rejected_by", fixed(F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order))))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def sieve(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps by its default rules, as they are."""
    text, found = F.coalesce(F.col("text"), F.lit("")), fresh("words")
    split = lambda df: df.withColumn(found, fixed(words(text)))
    order = [rule for rule, _, _ in ordered(split(spread(docs, sample)), text_rules(text, F.col(found)), sample)]
    return split(docs).where(cascade(order).isNull()).select(*docs.columns)
