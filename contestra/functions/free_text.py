"""Dates, places and name keys in free text, as expressions."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import normalize_name

MONTHS = {name.lower(): i for names in (calendar.month_name, calendar.month_abbr) for i, name in enumerate(names) if name} | {"sept": 9}
_MONTH = "(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + ")"
_NUMBER, _YEAR, _NTH = r"(\d{1,2})", r"(20\d\d)", "(?:st|nd|rd|th)?"
#: How dates are written, in the order of looking, and what the groups are. B: a month's name.
FORMS = (
    (rf"\b{_YEAR}[-/.]{_NUMBER}[-/.]{_NUMBER}\b", "ymd"),
    (rf"(?<!\d){_NUMBER}/{_NUMBER}/{_YEAR}(?!\d)", "dmy"),
    (rf"(?<!\d){_NUMBER}\.{_NUMBER}\.{_YEAR}(?!\d)", "dmy"),
    (rf"(?:{_YEAR}年\s*)?{_NUMBER}月\s*{_NUMBER}日", "ymd"),
    (rf"{_YEAR}년\s*{_NUMBER}월\s*{_NUMBER}일", "ymd"),
    (rf"(?i)\b{_MONTH}\s+{_NUMBER}{_NTH},?\s*{_YEAR}?\b", "Bdy"),
    (rf"(?i)\b{_NUMBER}{_NTH}\s+{_MONTH}\s*{_YEAR}?\b", "dBy"),
    (rf"(?<!\d){_NUMBER}\.{_NUMBER}(?!\.20\d\d|\d)", "md"),
)
# Codes of states.
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def date_from_text(text: Column, today: Column, back_days: int = 45) -> Column:
    """The date that the first fitting form gives; without a year that of today, or the next one if the day would lie more
    than back_days before today (F37). Days that don't exist are passed over. Null where nothing fits."""
    t = squeezed(text)
    months = F.create_map(*[F.lit(x) for item in MONTHS.items() for x in item])

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")

    found = []
    for pattern, parts in FORMS:
        group = {p: F.nullif(F.regexp_extract(t, pattern, i), F.lit("")) for i, p in enumerate(parts, 1)}
        m = months[F.lower(group["B"])] if "B" in group else group["m"].cast("int")
        d = group["d"].cast("int")
        near = day(F.year(today), m, d)
        guess = F.when(near < F.date_sub(today, back_days), day(F.year(today) + 1, m, d)).otherwise(near)
        found.append(F.when(group["y"].isNull(), guess).otherwise(day(group["y"].cast("int"), m, d)) if "y" in group else guess)
    return F.coalesce(*found)


def place(text: Column, countries: dict[str, str], default: str | None = None) -> Column:
    """struct<venue, city, region, country> of a place (F38): 'place・venue', or parts at commas and dashes that end in a
    state, a known country or the city. countries: names by normalised name. Empty text: default country only."""
    t = F.regexp_replace(squeezed(F.coalesce(text, F.lit(""))), r"\s+[–—-]\s+", ", ")
    t = F.regexp_replace(t, r"(?i)^[●◇◆■・]?\s*(?:venue|location|会場|場所|開催地)\s*[:：|]?\s*", "")
    t = F.regexp_replace(t, r"(?i)\s*(?:主催|organizer)\s*[:：].*$", "")
    pieces = lambda sep: F.filter(F.transform(F.split(t, sep), lambda x: F.trim(x)), lambda x: x != "")
    dots, parts = pieces("・"), pieces(",")
    last, before = F.get(parts, F.size(parts) - 1), F.get(parts, F.size(parts) - 2)
    known = F.create_map(*[F.lit(x) for item in countries.items() for x in item])[normalize_name(last)]
    state = F.upper(last).isin(STATES)
    none, home = F.lit(None).cast("string"), F.lit(default).cast("string")
    make = lambda v, c, r, n: F.struct(v.alias("venue"), c.alias("city"), r.alias("region"), n.alias("country"))
    dotted = make(F.array_join(F.slice(dots, 2, F.greatest(F.size(dots), F.lit(1))), "・"), F.get(dots, F.lit(0)), none, home)
    out = F.when(t == "", make(none, none, none, home)).when(F.contains(t, F.lit("・")) & (F.size(dots) > 1), dotted)
    out = out.when(F.size(parts) < 2, make(t, none, none, home)).when(state, make(t, before, F.upper(last), F.lit("United States")))
    return out.when(known.isNotNull(), make(t, before, none, known)).otherwise(make(t, last, none, home))


def alias_key(name: Column, aliases: dict[str, str]) -> Column:
    """Letters and digits of the normalised name, or what an alias map puts in their place."""
    key = F.replace(normalize_name(F.translate(name, "łŁđĐøØ", "lLdDoO")), F.lit(" "), F.lit(""))
    return F.coalesce(F.create_map(*[F.lit(x) for item in aliases.items() for x in item])[key], key) if aliases else key
