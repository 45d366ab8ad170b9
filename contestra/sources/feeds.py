"""JSON feeds of contests: cards with outcomes (S06) and totals with their checks (S07). What fails a check becomes a row
of `problem` and not an exception, so that a feed that fails leaves the others, and the state before, alone (Z04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = "struct<FighterId:string,Corner:string,Name:struct<FirstName:string,LastName:string>,Outcome:struct<Outcome:string>>"
CARD = f"struct<LiveEventDetail:struct<EventId:string,FightCard:array<struct<FightId:string,Status:string,Fighters:array<{SIDE}>,Result:struct<Method:string,EndingRound:string,EndingTime:string>>>>>"
PAIRS = {"sig": "SigStrikes", "total": "TotalStrikes", "takedowns": "Takedowns"}
SINGLES = {"knockdowns": "Knockdowns", "submissions": "SubmissionsAttempted"}
_LINE = ",".join(f"{x}:string" for x in ["FighterId", "ControlTime", *SINGLES.values(), *(p + e for p in PAIRS.values() for e in ("Landed", "Attempted"))])
TOTALS = f"struct<LiveFightDetail:struct<FightId:string,Fighters:array<{SIDE}>,FightStats:array<struct<{_LINE}>>>>"


def _corner(sides: Column, corner: str) -> Column:
    return F.get(F.filter(sides, lambda s: s["Corner"] == corner), F.lit(0))


def _name(side: Column) -> Column:
    words = F.concat_ws(" ", side["Name"]["FirstName"], side["Name"]["LastName"])
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def _won(side: Column) -> Column:
    return F.lower(F.trim(F.coalesce(side["Outcome"]["Outcome"], F.lit(""))))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns, behind a generator: the optimizer would else repeat their parsing and searching at every use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def live_contests(feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contests, problems) of feeds(event_id, payload). Only contests of status Final show outcome, method, round and
    time; a contest without both corners is left out. A feed of another event, without contests, with ids that aren't
    numbers or that repeat gives one row (event_id, problem) and no contests; so does null or broken JSON."""
    detail = F.col("detail")
    card = F.coalesce(detail["FightCard"], F.expr("array()"))
    full = F.filter(card, lambda f: _corner(f["Fighters"], "Red").isNotNull() & _corner(f["Fighters"], "Blue").isNotNull())
    ids = F.transform("full", lambda f: f["FightId"])
    problem = (
        F.when(F.coalesce(detail["EventId"] != F.col("event_id").cast("string"), F.lit(True)) | (F.size(card) == 0), "event mismatch or unavailable")
        .when(F.exists(card, lambda f: ~F.coalesce(f["FightId"].rlike(r"^\d+$"), F.lit(False)) | f["Fighters"].isNull()), "contest format unavailable")
        .when((F.size("full") == 0) | (F.size(F.array_distinct(ids)) < F.size(ids)), "empty or duplicate contest ids")
    )
    rows = _once(feeds.select("event_id", "payload"), detail=F.from_json("payload", CARD)["LiveEventDetail"])
    rows = _once(rows, full=full).select("event_id", "full", problem.alias("problem"))
    final = F.col("f.Status") == "Final"
    out = rows.where("problem is null").select("event_id", F.explode("full").alias("f"))
    red, blue = _corner(F.col("f.Fighters"), "Red"), _corner(F.col("f.Fighters"), "Blue")
    shown = {"red_outcome": _won(red), "blue_outcome": _won(blue), "method": F.col("f.Result.Method"), "ended_round": F.col("f.Result.EndingRound"), "ended_at": F.col("f.Result.EndingTime")}
    out = out.select("event_id", F.col("f.FightId").alias("contest_id"), _name(red).alias("red"), _name(blue).alias("blue"), *[F.when(final, c).alias(k) for k, c in shown.items()], F.coalesce("f.Status", F.lit("")).alias("status"))
    return out, rows.where("problem is not null").select("event_id", "problem")


def contest_totals(feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, problems) of feeds(contest_id, payload): per contest and corner what was landed of how many attempts,
    once all checks hold: that contest, two named corners with a line each, whole numbers, no more landed than attempted,
    control as m:ss, and one winner. The first check that fails is the problem."""
    red, blue = _corner(F.col("d.Fighters"), "Red"), _corner(F.col("d.Fighters"), "Blue")
    line = lambda side: F.get(F.filter("d.FightStats", lambda s: s["FighterId"] == side["FighterId"]), F.lit(0))
    rows = _once(feeds.select("contest_id", "payload"), d=F.from_json("payload", TOTALS)["LiveFightDetail"])
    rows = _once(_once(rows, red=red, blue=blue), x=line(F.col("red")), y=line(F.col("blue")))
    both = ("x", "y")
    fails = lambda c: ~F.coalesce(c, F.lit(False))
    any_ = lambda cs: F.greatest(*[c.cast("int") for c in cs]) == 1
    numbers = [*SINGLES.values(), *(p + e for p in PAIRS.values() for e in ("Landed", "Attempted"))]
    problem = (
        F.when(fails(F.col("d.FightId") == F.col("contest_id").cast("string")), "contest mismatch")
        .when(fails(F.size("d.Fighters") == 2) | F.col("red").isNull() | F.col("blue").isNull() | (_name(F.col("red")) == "") | (_name(F.col("blue")) == ""), "corners unavailable")
        .when(F.col("x").isNull() | F.col("y").isNull(), "totals unavailable")
        .when(any_([fails(F.col(f"{s}.{n}").rlike(r"^\d{1,9}$")) for s in both for n in numbers]), "not a whole number")
        .when(any_([fails(F.col(f"{s}.{p}Landed").try_cast("int") <= F.col(f"{s}.{p}Attempted").try_cast("int")) for s in both for p in PAIRS.values()]), "more landed than attempted")
        .when(any_([fails(F.trim(f"{s}.ControlTime").rlike(r"^\d+:[0-5]\d$")) for s in both]), "control time")
        .when(~(((_won(F.col("red")) == "win") & (_won(F.col("blue")) == "loss")) | ((_won(F.col("blue")) == "win") & (_won(F.col("red")) == "loss"))), "no winner")
    )
    rows = _once(rows, problem=problem)

    def side(corner: str, s: str) -> Column:
        pairs = [F.col(f"{s}.{p}{e}").try_cast("int").alias(f"{k}_{e.lower()}") for k, p in PAIRS.items() for e in ("Landed", "Attempted")]
        clock = F.split(F.trim(f"{s}.ControlTime"), ":")
        return F.struct(F.lit(corner).alias("corner"), _name(F.col(corner)).alias("name"), (_won(F.col(corner)) == "win").alias("won"), *[F.col(f"{s}.{n}").try_cast("int").alias(k) for k, n in SINGLES.items()], *pairs, (F.get(clock, F.lit(0)).try_cast("int") * 60 + F.get(clock, F.lit(1)).try_cast("int")).alias("control_seconds"))

    good = rows.where("problem is null").select("contest_id", F.inline(F.array(side("red", "x"), side("blue", "y"))))
    return good, rows.where("problem is not null").select("contest_id", "problem")
