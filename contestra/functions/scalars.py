"""Scalar functions of the contest domain as column expressions; Unicode folding alone needs Python (Arrow batches)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

DAY_YEAR = 365.2425


def clamp(c: Column, lo: float, hi: float) -> Column:
    """c within [lo, hi]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def parse_pair(text: Column) -> tuple[Column, Column]:
    """(landed, attempted) of "L of A"; 0 and 0 for anything else."""
    part = lambda i: F.coalesce(F.regexp_extract(text, r"(\d+)\s+of\s+(\d+)", i).try_cast("long"), F.lit(0).cast("long"))
    return part(1), part(2)


def parse_clock(text: Column) -> Column:
    """Seconds of "m:ss"; 0 for anything else."""
    part = lambda i: F.regexp_extract(text, r"^(\d+):(\d{2})$", i).try_cast("long")
    return F.coalesce(part(1) * 60 + part(2), F.lit(0).cast("long"))


def parse_day(text: Column) -> Column:
    """dd/MM/yyyy, else ISO, else null."""
    return F.coalesce(F.try_to_date(text, "dd/MM/yyyy"), F.try_to_date(text, "yyyy-MM-dd"))


def height_cm(text: Column) -> Column:
    """Centimetres of feet'inches; null for anything else."""
    part = lambda i: F.regexp_extract(text, r"(\d+)'\s*(\d+)", i).try_cast("double")
    return (part(1) * 12 + part(2)) * 2.54


@pandas_udf(StringType())
def _folded(text: pd.Series) -> pd.Series:
    def fold(x):
        return None if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)).lower()

    return text.map(fold)


def normalize_name(text: Column) -> Column:
    """Without marks, lower case, everything but letters a-z and digits as single spaces, trimmed."""
    return F.trim(F.regexp_replace(_folded(text), "[^a-z0-9]+", " "))


def slugify(text: Column) -> Column:
    return F.replace(normalize_name(text), F.lit(" "), F.lit("-"))


def reliability(minutes: Column, bouts: Column, share: float, per_minutes: float, per_bouts: float, lo: float, hi: float) -> Column:
    """Evidence that saturates with exposure and with the number of contests."""
    return clamp(share * (1 - F.exp(-minutes / per_minutes)) + (1 - share) * (1 - F.exp(-bouts / per_bouts)), lo, hi)


def sample_reliability(minutes: Column, bouts: Column) -> Column:
    return reliability(minutes, bouts, 0.62, 55.0, 6.0, 0.08, 0.985)


def ranking_reliability(minutes: Column, bouts: Column) -> Column:
    return reliability(minutes, bouts, 0.42, 45.0, 5.0, 0.08, 0.99)


def shrink(score: Column, weight: Column, center: float = 50.0) -> Column:
    return center + (score - center) * weight


def calibrated(score: Column) -> Column:
    return clamp(50 + 1.45 * (score - 50), 5.0, 99.0)


def sigmoid(x: Column, most: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -most, most)))


def elo_expected(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def age_years(born: Column, on: Column) -> Column:
    return F.floor(F.datediff(on, born) / DAY_YEAR)


def roster_status(last: Column, on: Column, override: Column | None = None, days: int = 548) -> Column:
    """The override where there is one, else active within so many days of the last contest."""
    found = F.when(F.datediff(on, last) <= days, "active").otherwise("inactive")
    return found if override is None else F.coalesce(override, found)


def is_probability(p: Column) -> Column:
    return F.coalesce(p.isNotNull() & ~F.isnan(p) & p.between(0, 1), F.lit(False))


def scorable_rounds(finish: Column, ended: Column, scheduled: Column) -> Column:
    """All scheduled rounds of a decision, those before the last of a finish; 5 at most."""
    return F.greatest(F.lit(0), F.least(F.lit(5), scheduled, F.when(finish, ended - 1).otherwise(scheduled)))


def pick_points(correct: Column, confidence: Column) -> Column:
    """100 and the confidence above 50 if correct, minus that confidence if wrong, 0 if correct is null."""
    return F.when(correct, 100 + confidence - 50).when(~correct, 50 - confidence).otherwise(0)


def normalize_phrase(text: Column) -> Column:
    """Like normalize_name, but apostrophes stay (curly ones straightened), for phrase patterns."""
    return F.trim(F.regexp_replace(F.replace(_folded(text), F.lit("’"), F.lit("'")), "[^a-z0-9']+", " "))


# Classes in the order in which they are looked for; the first found in the text names it.
DIVISIONS = ("Women's Strawweight", "Women's Flyweight", "Women's Bantamweight", "Women's Featherweight", "Light Heavyweight", "Heavyweight", "Middleweight", "Welterweight", "Lightweight", "Featherweight", "Bantamweight", "Flyweight", "Strawweight")
DIVISION_WORDS = r"(?i)Interim\s+|Title\s+Bout|\s+Bout$"
DIVISION_PREFIXES = (r"(?i)^UFC\s+", r"(?i)^Road to UFC\s+\d*\s*", r"(?i)^Ultimate Fighter\s+\d*\s*", r"(?i)\s+Tournament$")


def division_name(text: Column) -> Column:
    """The weight class that a bout's title names, else the title without its series; empty and null: Unknown."""
    raw = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), DIVISION_WORDS, " "))
    low, out = F.replace(F.lower(raw), F.lit("womens"), F.lit("women's")), raw
    for pattern in DIVISION_PREFIXES:
        out = F.regexp_replace(out, pattern, "")
    out = F.coalesce(F.nullif(F.trim(out), F.lit("")), F.lit("Unknown"))
    out = F.when(low.rlike("open ?weight"), "Open Weight").otherwise(out)
    for name in reversed(DIVISIONS):
        out = F.when(F.contains(low, F.lit(name.lower())), name).otherwise(out)
    return F.when(F.contains(low, F.lit("catch")), "Catch Weight").otherwise(out)
