"""Searches over a directory of people: optional facets, allow-listed orders, precedence of statuses, visibility."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Orders that a caller may name, and the column of each.
METRICS = {"rating": "rating", "wins": "wins", "activity": "last_date", "age": "age", "evidence": "evidence"}


def facet_predicates(as_of: str, q: str | None = None, division: str | None = None, promotion: str | None = None, region: str | None = None, country: str | None = None, management: str | None = None, contract: str | None = None, opportunity: str | None = None, age_min: int | None = None, age_max: int | None = None, rating_min: float | None = None, evidence_min: float | None = None, wins_min: int | None = None, active_months: int | None = None, finish_rate_min: float | None = None, title: bool | None = None) -> list[Column]:
    """A predicate for each facet that is given (P03); a person of unknown value fails the facets that ask for one."""
    c, out = F.col, []
    if q:
        out.append(F.instr(F.lower(F.concat_ws(" ", "name", "promotion", "country")), q.lower()) > 0)
    for name, value in (("division", division), ("promotion", promotion), ("region", region), ("country", country), ("management", management), ("contract", contract), ("opportunity", opportunity)):
        if value is not None:
            out.append(c(name) == value)
    for name, value in (("age", age_min), ("rating", rating_min), ("evidence", evidence_min), ("wins", wins_min)):
        if value is not None:
            out.append(c(name) >= value)
    if age_max is not None:
        out.append(c("age") <= age_max)
    if active_months is not None:
        out.append(c("last_date") >= F.add_months(F.lit(as_of).cast("date"), -active_months))
    if finish_rate_min is not None:
        out.append(F.try_divide(c("finishes").cast("double"), c("wins")) >= finish_rate_min)
    if title is not None:
        out.append((c("titles") > 0) == title)
    return [F.coalesce(p, F.lit(False)) for p in out]


def faceted(people: DataFrame, as_of: str, **facets) -> DataFrame:
    """people that satisfy every given facet; none given: all."""
    return people.where(reduce(and_, facet_predicates(as_of, **facets), F.lit(True)))


def checked(metric: str, page: int, skip: int, most: int = 100) -> tuple[str, int, int]:
    """(column, page, skip): the metric must be allowed, the page is held within 1 and most, the skip at 0 or more."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    return METRICS[metric], max(1, min(most, int(page))), max(0, int(skip))


def status_of(*sources: str) -> Column:
    """The first status that is there, else unknown."""
    return F.coalesce(*[F.nullif(F.trim(F.col(s)), F.lit("")) for s in sources], F.lit("unknown"))


def whole_location(*prefixes: str, parts: tuple[str, ...] = ("city", "region", "country")) -> list[Column]:
    """City, region and country from the first source that knows any of them; never mixed."""
    out = []
    for part in parts:
        value = F.lit(None).cast("string")
        for p in reversed(prefixes):
            value = F.when(F.coalesce(*[F.col(f"{p}_{x}") for x in parts]).isNotNull(), F.col(f"{p}_{part}")).otherwise(value)
        out.append(value.alias(part))
    return out


def visible(rows: DataFrame, controls: DataFrame, key: str) -> DataFrame:
    """rows whose control says public, or that have none (P08). controls(key, status): a key is hidden if any row hides it."""
    hidden = controls.where(F.coalesce("status", F.lit("public")) != "public").select(key).distinct()
    return rows.join(hidden, key, "left_anti")


#: What a question may ask for: intent and the word stems that show it, looked for in this order.
INTENTS = {"path": ("connect", "path", "between"), "similar": ("similar", "resembl", "like"), "future_wins": ("before their debut", "later debut"), "opponent_quality": ("toughest", "strongest schedule", "opposition"), "prospects": ("prospect", "rising", "under"), "rankings": ("rank", "top", "best")}


def question_plan(question: str, divisions: tuple[str, ...] = ()) -> dict:
    """Intent and filters of a question by rules (P12): {intent, limit, max_age, division}; what isn't asked is None."""
    text = " ".join((question or "").lower().split())
    intent = next((k for k, stems in INTENTS.items() if any(re.search(rf"\b{s}", text) for s in stems)), "rankings")
    limit = re.search(r"\b(?:top|best|first)\s+(\d{1,3})\b", text)
    age = re.search(r"\b(?:under|younger than|below)\s+(\d{2})\b", text)
    division = next((d for d in sorted(divisions, key=len, reverse=True) if d.lower() in text), None)
    return {"intent": intent, "limit": min(50, int(limit.group(1))) if limit else 10, "max_age": int(age.group(1)) - 1 if age else None, "division": division}


def intelligence_gaps(as_of: Column, **dates: tuple[Column, int]) -> Column:
    """Sorted array of what is missing or older than its days."""
    found = [F.when(d.isNull(), F.lit(f"{k} missing")).when(F.datediff(as_of, d) > days, F.lit(f"{k} stale")) for k, (d, days) in sorted(dates.items())]
    return F.array_sort(F.array_compact(F.array(*found)))
