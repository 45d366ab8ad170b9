"""Scalar functions over the texts of contests: duration, methods, outcomes, scorecards, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import parse_clock, slugify

# Upper bounds of the classes in kilograms, and what a finish is.
CLASS_KILOGRAMS = ((57.5, "Flyweight"), (61.7, "Bantamweight"), (66.7, "Featherweight"), (70.8, "Lightweight"), (77.7, "Welterweight"), (84.5, "Middleweight"), (93.5, "Light Heavyweight"))
FINISHES = ("KO/TKO", "TKO - Doctor's Stoppage", "Submission")


def duration_seconds(layout: Column, ended: Column, clock: Column) -> Column:
    """Completed rounds at the minutes that the layout gives in brackets, (5-5-5), else 5 each, plus the clock; 300 where
    that is 0, 30 at least (F10)."""
    minutes = F.transform(F.split(F.regexp_extract(F.coalesce(layout, F.lit("")), r"\(([0-9-]+)\)", 1), "-"), lambda x: x.try_cast("int"))
    done = F.greatest(F.coalesce(ended, F.lit(1)) - 1, F.lit(0)).cast("int")
    rounds = F.transform(F.slice(F.concat(F.slice(minutes, 1, done), F.array_repeat(F.lit(5), done)), 1, done), lambda m: F.coalesce(m, F.lit(5)) * 60)
    total = F.aggregate(rounds, F.lit(0), lambda a, x: a + x) + parse_clock(clock)
    return F.greatest(F.lit(30), F.when(total > 0, total).otherwise(300)).cast("long")


def finish_type(method: Column) -> Column:
    """SUB, KO or DEC, in that order of looking, else null."""
    m = F.lower(method)
    return F.when(F.contains(m, F.lit("sub")), "SUB").when(F.contains(m, F.lit("ko")), "KO").when(F.contains(m, F.lit("dec")), "DEC")


def outcome(winner: Column, side: Column, method: Column) -> Column:
    """W or L of a decided contest, NC and D where the method says so, U for unknown."""
    m = F.lower(F.coalesce(method, F.lit("")))
    return F.when(winner.isNotNull(), F.when(winner == side, "W").otherwise("L")).when(m.rlike("no contest|overturned"), "NC").when(F.contains(m, F.lit("draw")), "D").otherwise("U")


def is_decisive_finish(method: Column, decided: Column, anchored: bool = True) -> Column:
    """A decided contest that a finish ended (F21): by one of the named methods, or in the older rule by whatever isn't a decision."""
    found = method.isin(*FINISHES) if anchored else ~F.contains(F.lower(method), F.lit("decision"))
    return F.coalesce(decided & found, F.lit(False))


def is_finish_win(result: Column, method: Column) -> Column:
    """A win by a stated method that isn't a decision."""
    return F.coalesce((result == "W") & (F.trim(method) != "") & ~F.contains(F.lower(method), F.lit("decision")), F.lit(False))


def class_of_kilograms(kg: Column) -> Column:
    """The class whose bound a weight keeps; null stays null."""
    out = F.when(kg.isNotNull(), "Heavyweight")
    for most, name in reversed(CLASS_KILOGRAMS):
        out = F.when(kg <= most, name).otherwise(out)
    return out


def valid_scorecard(card: Column, rounds: Column) -> Column:
    """Whether array<struct<round,a,b>> has each round once, and each scored round a 10 and nothing below 7."""
    numbers = F.array_sort(F.transform(card, lambda r: r["round"]))
    right = F.forall(card, lambda r: (r["a"].isNull() & r["b"].isNull()) | F.coalesce((F.greatest(r["a"], r["b"]) == 10) & (F.least(r["a"], r["b"]) >= 7), F.lit(False)))
    return F.coalesce((numbers == F.sequence(F.lit(1), rounds.cast("int"))) & right, F.lit(False))


def scorecard_totals(card: Column) -> Column:
    """struct<a,b>: points over the rounds that are scored."""
    scored = F.filter(card, lambda r: r["a"].isNotNull() & r["b"].isNotNull())
    total = lambda k: F.aggregate(scored, F.lit(0).cast("long"), lambda s, r: s + r[k])
    return F.struct(total("a").alias("a"), total("b").alias("b"))


def event_slug(promotion: Column, name: Column, day: Column) -> Column:
    """promotion-name (110 characters at most) and the day, 180 at most in all."""
    stem = F.regexp_replace(F.substring(slugify(F.concat_ws(" ", promotion, name)), 1, 110), "-+$", "")
    return F.substring(F.regexp_replace(F.concat_ws("-", stem, F.date_format(day, "yyyy-MM-dd")), "-+", "-"), 1, 180)


def display_name(name: Column) -> Column:
    """Words capitalised if no letter is lower-case yet; parts after hyphens and apostrophes too, and what follows Mc."""
    low = F.lower(name)
    letters = F.split(low, "")
    before = F.concat(F.array(F.lit(" ")), letters)
    cased = F.transform(letters, lambda ch, i: F.when(F.element_at(before, i + 1).rlike(r"[\s\-'’]"), F.upper(ch)).otherwise(ch))
    cased = F.transform(cased, lambda ch, i: F.when((i >= 2) & (F.lower(F.get(cased, i - 1)) == "c") & (F.get(cased, i - 2) == "M"), F.upper(ch)).otherwise(ch))
    return F.when(F.length(F.regexp_replace(name, r"\p{Ll}", "")) < F.length(name), name).otherwise(F.array_join(cased, ""))
