"""Running filters: matching, visibility, distinct ids, newest first, a limit for each filter.

Many queries share two scans, one for the filters whose notes must be visible and
one for the others, so that notes of the others make no text and join no
visibility, and often no content is read for them: every note carries the list of
the (query, filter) pairs that it matches, visibility is joined once, and ids are
made distinct after the pairs are told apart.  Limits are taken in three steps: in each input
partition before anything is sent, over ``SALTS`` groups of partitions, and over
what these leave, so no more than a limit's worth of a partition is ever sent and
no task sorts all matches of a filter.  Ranks are dense, so copies of a note take
one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import text
from tidelog.operators.visibility import ALWAYS, MODES, SEARCH_ONLY, Visibility
from tidelog.plans.filters import Filter, all_of, any_of
from tidelog.schema import COLUMNS, newest_first

SALTS = 64


def matching(notes: DataFrame, filters: Sequence[Filter], searchable_kinds: list[int] | None = None, to: str = "hits") -> DataFrame:
    """Notes that match any of the filters, with the numbers of those in ``to``.

    Fields are looked at first, in the scan where it can; texts are made, once,
    only for what is left, unless the table has its column search_text; of a table
    that has content_folded, only what else belongs to a text.
    """
    by_day = "unix_day" in notes.columns
    fields = [f.fields(searchable_kinds, by_day) for f in filters]
    found = notes.where(any_of(fields))
    if not any(f.terms for f in filters):
        searched = fields
    else:
        name = "search_text"
        if name not in notes.columns:
            name = "__text"
            found = found.withColumn(name, text.matchable_text(F.col(text.FOLDED) if text.FOLDED in notes.columns else None))
        if len(filters) == 1:
            searched = [fields[0] & filters[0].text_has_terms(F.col(name))]
        else:  # each term is looked for once, however many filters have it
            terms = list(dict.fromkeys(t for f in filters for t in f.terms))
            has = F.array(*[F.contains(F.col(name), F.lit(t)) for t in terms])
            found = found.withColumn("__has", F.when(F.monotonically_increasing_id() >= 0, has))  # so that it isn't copied
            searched = [c & all_of([F.get("__has", F.lit(terms.index(t))) for t in dict.fromkeys(f.terms)]) for c, f in zip(fields, filters, strict=True)]
        found = found.where(any_of(searched))
    if len(filters) == 1:
        return found.withColumn(to, F.array(F.lit(0))).select(*notes.columns, to)
    hits = F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(searched)]), lambda x: x.isNotNull())
    return found.withColumn(to, hits).select(*notes.columns, to)


def _checks(f: Filter, visibility: str) -> bool:
    return visibility == ALWAYS or visibility == SEARCH_ONLY and bool(f.terms)


def run(notes: DataFrame, filters: Sequence[Filter], visibility: str = SEARCH_ONLY, searchable_kinds: list[int] | None = None, rules: Visibility | None = None) -> DataFrame:
    """Notes that match any of the filters, newest first, each id once.

    ``rules`` are the visibility tables of the whole store; without them they are
    made from ``notes``.
    """
    if visibility not in MODES:
        raise ValueError(f"visibility must be one of {MODES}")
    filters = list(filters) or [Filter()]
    if len(filters) > 1:
        return batch(notes, [filters], visibility, searchable_kinds, rules).drop("query").orderBy(*newest_first())
    (f,) = filters
    if f.limit == 0:
        return notes.select(*COLUMNS).limit(0)
    found = matching(notes, filters, searchable_kinds).select(*COLUMNS)
    if _checks(f, visibility):
        found = (rules or Visibility.of(notes)).visible(found)
    if f.limit is not None:
        found = ranked(found, [], F.lit(_int(f.limit)), _int(f.limit))
    found = found.dropDuplicates(["id"]).orderBy(*newest_first())
    return found if f.limit is None else found.limit(_int(f.limit))


def ranked(found: DataFrame, group: list[str], limit: Column, most: int) -> DataFrame:
    """What can be among the ``limit`` newest notes of each group, ``most`` at most, copies included."""
    part, place = "__part", "__place"
    found = found.withColumn(part, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    for keys in ([*group, part], group):
        found = found.withColumn(place, F.dense_rank().over(Window.partitionBy(*keys).orderBy(*newest_first()))).where((F.col(place) <= most) & (F.col(place) <= limit))
    return found.drop(part, place)


def _int(limit: int) -> int:
    return min(limit, 2**31 - 1)


def batch(notes: DataFrame, queries: Sequence[Sequence[Filter]], visibility: str = SEARCH_ONLY, searchable_kinds: list[int] | None = None, rules: Visibility | None = None, active: Sequence[bool] | None = None) -> DataFrame:
    """Results of many queries from two scans at most: the columns of a note and ``query`` (its number).

    Equal to running each query alone.  Queries that aren't active return nothing.
    """
    if visibility not in MODES:
        raise ValueError(f"visibility must be one of {MODES}")
    pairs = [(q, f) for q, many in enumerate(queries) if active is None or active[q] for f in (list(many) or [Filter()]) if f.limit != 0]
    if not pairs:
        return notes.select(*COLUMNS, F.lit(0).alias("query")).limit(0)
    filters = [f for _, f in pairs]
    checked = [i for i, f in enumerate(filters) if _checks(f, visibility)]
    free = [i for i in range(len(filters)) if i not in checked]
    parts = []
    for numbers in (checked, free):
        if numbers:
            part = matching(notes, [filters[i] for i in numbers], searchable_kinds, "__hits").select(*COLUMNS, "__hits")
            if numbers is checked:
                part = (rules or Visibility.of(notes)).visible(part)
            part = part.withColumn("__hit", F.explode("__hits"))
            parts.append(part.withColumn("__pair", F.element_at(F.array(*map(F.lit, numbers)), F.col("__hit") + 1)).drop("__hits", "__hit"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    limits = {i: _int(f.limit) for i, f in enumerate(filters) if f.limit is not None}
    parts = []
    if len(limits) < len(filters):
        parts.append(found.where(~F.col("__pair").isin(*limits)) if limits else found)
    if limits:
        most = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("__pair"))
        parts.append(ranked(found.where(F.col("__pair").isin(*limits)), ["__pair"], most, max(limits.values())))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    number = F.element_at(F.array(*[F.lit(q) for q, _ in pairs]), F.col("__pair") + 1)
    return found.withColumn("query", number).dropDuplicates(["query", "id"]).select(*COLUMNS, "query")


def newest_days(notes: DataFrame, f: Filter, days: Sequence[int], **options) -> DataFrame:
    """A limited query over day partitions, newest first: four times as many days each time until the limit is met.

    ``days`` are the days that hold notes.  Without a limit all are looked at.
    """
    left = sorted((d for d in days if (f.since is None or d >= f.since // 86400) and (f.until is None or d <= f.until // 86400)), reverse=True)
    if f.limit is None or not left:
        return run(notes, [f], **options)
    options.setdefault("rules", Visibility.of(notes) if _checks(f, options.get("visibility", SEARCH_ONLY)) else None)
    step = 1
    while step < len(left):
        found = run(notes.where(F.col("unix_day") >= left[step - 1]), [f], **options).persist()  # ``limit`` rows at most
        if found.count() >= f.limit:
            return found
        found.unpersist()
        step *= 4
    return run(notes, [f], **options)


def dedup_by_id(notes: DataFrame) -> DataFrame:
    return notes.dropDuplicates(["id"])
