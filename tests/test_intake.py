from contestra.functions.free_text import alias_key, date_from_text, place
from contestra.operators.biography import by_biography, by_history
from contestra.operators.facets import question_plan
from contestra.operators.skill_model import snapshot_key
from contestra.sources.feeds import contest_totals, live_contests
from pyspark.sql import functions as F

ROW = "fight long, side string, name string, id long, dob string, gym string, nationality string, height double, reach double, stance string"
PERSON = ROW.replace("fight long, side string, ", "")


def test_dates(spark):
    cases = {
        "31/02/2020 or 1 March 2020": "2020-03-01", "2020-13-01": None, "21st sept": "2020-09-21", "January 3": "2021-01-03", "12月31日": "2020-12-31", "3.11 card": "2021-03-11",
        "": None, "Maybe 5": None, "5.6.2021": "2021-06-05", "x" * 50_000 + " 2020/01/02": "2020-01-02", "29 February": None,
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string").select("t", date_from_text(F.col("t"), F.lit("2020-08-01").cast("date")).alias("d"))
    assert {r.t: r.d and str(r.d) for r in df.collect()} == cases | {None: None}


def test_places_and_keys(spark):
    df = spark.createDataFrame([("Organizer: x",), (None,), ("a, , tx",), ("・b",), ("c・",), (",",)], "t string").select(place(F.col("t"), {"japan": "Japan"}).alias("p")).select("p.*")
    none = (None,) * 4
    assert [tuple(r) for r in df.collect()] == [none, none, ("a, , tx", "a", "TX", "United States"), ("・b", None, None, None), ("c・", None, None, None), (",", None, None, None)]
    assert spark.createDataFrame([("Đỗ Ø",), (None,)], "n string").select(alias_key(F.col("n"), {}).alias("k")).collect() == [("doo",), (None,)]


def test_feeds_that_fail(spark):
    bad = [None, "", "{", "[]", '{"LiveEventDetail":{"EventId":1}}', '{"LiveEventDetail":{"EventId":1,"FightCard":[{"FightId":"a","Fighters":[]}]}}']
    rows, problems = live_contests(spark.createDataFrame([(1, p) for p in bad], "event_id long, payload string"))
    assert rows.count() == 0 and problems.count() == len(bad)
    rows, problems = contest_totals(spark.createDataFrame([(1, p) for p in bad], "contest_id long, payload string"))
    assert rows.count() == 0 and problems.count() == len(bad)
    assert live_contests(spark.createDataFrame([], "event_id long, payload string"))[0].count() == 0


def test_biography_and_history(spark):
    people = spark.createDataFrame([(1, "n", "d1", "g", "c", 180.0, 190.0, "left"), (2, "n", "d2", "g", "c", 181.0, 190.0, "left"), (3, None, "d1", None, None, None, None, None)], PERSON.replace("name string, id long", "id long, name string"))
    rows = spark.createDataFrame(
        [
            (1, "a", "n", None, "d1", "G ", None, None, None, None),  # 17 points; the other is ruled out by birth
            (1, "b", "m", 9, None, None, None, None, None, None),
            (2, "a", "n", None, None, "g", "c", 180.0, None, "left"),  # both fit alike
            (3, "a", "n", None, None, "g", None, None, None, None),  # one dimension
            (4, "a", None, None, "d1", None, None, None, None, None),  # no name
            (5, "a", "n", None, "d1", "q", None, None, 150.0, None),  # reach rules it out
            (6, "a", "n", None, "d1", None, None, None, None, None),
            (6, "b", "n", 1, None, None, None, None, None, None),  # the candidate is the other side
            (7, "a", "n", None, "d1", "q", "z", 180.0, None, None),
            (8, "a", "n", None, None, "q", "z", None, None, None),  # like fight 7, once that is resolved
        ],
        ROW,
    )
    found = by_biography(rows, people)
    assert sorted((r.fight, r.id, r.score, r.margin, r.confidence) for r in found.collect()) == [(1, 1, 17, 17, 0.995), (7, 1, 16, 16, 0.995)]
    more = {r.fight: (r.id, r["pass"]) for r in by_history(rows, found).collect()}
    assert more[8] == (1, 1) and more[1] == (1, 0) and 6 not in more and 4 not in more
    assert by_history(rows.limit(0), found.limit(0)).count() == 0


def test_snapshot_key_and_question(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    key = lambda df, sources: snapshot_key(df, ["k", "v"], sources).first().key
    assert key(rows, ["x", "y"]) == key(rows.orderBy(F.desc("k")), ["y", "x"]) != key(rows.distinct(), ["x", "y"])
    assert question_plan("Top 500 under 25", ())["limit"] == 50 and question_plan("", ())["max_age"] is None
