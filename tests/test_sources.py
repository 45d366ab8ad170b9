import pytest
from pyspark.sql import functions as F

from contestra.functions import scalars as S
from contestra.operators import publishing
from contestra.sources import texts


def test_delimited(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id;name;note\r\n1;"a;b";"he said ""no""\nthen left"\r\n;;\r\n2;c\r\n')
    rows = sorted(map(tuple, texts.delimited(spark, str(tmp_path / "x.csv"), required=("id",)).collect()))
    assert [(r[0], r[1], r[2].replace("\r", "")) for r in rows] == [("1", "a;b", 'he said "no"\nthen left'), ("2", "c", "")]
    with pytest.raises(ValueError):
        texts.delimited(spark, str(tmp_path / "x.csv"), required=("born",))
    _, twice = texts.unique_dimension(spark.createDataFrame([("A ",), ("a",), ("b",)], "k string"), "k")
    assert [tuple(r) for r in twice.collect()] == [("a", 2)]


def test_registry_and_supplement(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"slug": "s", "name": "Big Show", "aliases": ["BIG-SHOW", "bs"]}, {"slug": "t", "name": "Tee"}]')
    assert sorted(map(tuple, texts.registry(spark, str(tmp_path / "r.json")).collect())) == [("s", "big show"), ("s", "bs"), ("t", "tee")]
    base, extra = spark.sql("select 1 a, date'2020-01-02' d"), spark.sql("select 2 b, date'2020-01-02' d union all select 3, date'2020-01-03'")
    assert sorted(map(str, texts.newer_rows(base, extra, "d").select("a", "b").collect())) == ["Row(a=1, b=None)", "Row(a=None, b=3)"]
    assert texts.newer_rows(base.limit(0), extra, "d").count() == 2


def test_feeds_and_articles(spark):
    rss = "<rss><channel><item><title>T &amp; U</title><link>https://www.x.org/1</link><description>d</description><pubDate>p</pubDate></item><item><title>T2</title><link>https://evil.org/1</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="https://x.org/2"/><updated>u</updated></entry></feed>'
    df = spark.createDataFrame([(rss,), (rss,), (atom,), ("not xml",), ("",), (None,)], "b string")
    assert sorted(map(tuple, texts.feed_items(df, "b", ("x.org",)).collect())) == [("A", "https://x.org/2", "", "u"), ("T & U", "https://www.x.org/1", "d", "p")]
    html = "<nav><p>this is navigation</p></nav><p>A first long block</p><p>short</p><p>A first long block</p><li><a>one one</a> <a>two two</a> <a>3</a> <a>4</a></li><p>A second &amp; last block"
    got = [r.v for r in spark.createDataFrame([(html,), (None,), ("",)], "h string").select(texts.article_text("h").alias("v")).collect()]
    assert got == ["A first long block\nA second & last block", None, ""]


def test_pairs_fields_addresses(spark):
    df = spark.createDataFrame([(1, "Ana Ruiz vs. Bo Li"), (1, "BO LI v Ana Ruíz"), (1, "A vs B vs C"), (2, None), (2, "Ana versus Ana"), (2, " vs B")], "k int, t string")
    assert [tuple(r) for r in texts.versus_pairs(df, "k", "t").collect()] in ([(1, "Ana Ruiz", "Bo Li")], [(1, "BO LI", "Ana Ruíz")])
    one = spark.range(1).select(
        texts.infobox_field(F.lit("{{Infobox\n| name = Ana\n| am_win = 7 \n|empty=\n}}"), "am_win").alias("a"), texts.infobox_field(F.lit("|empty=\n| x = 1"), "empty").alias("b"),
        texts.public_emails(F.lit("Write to B@x.org, a@y.co.uk or b@X.org; no@where")).alias("c"), texts.public_emails(F.lit(None).cast("string")).alias("d"),
    ).first()
    assert (one.a, one.b, one.c, one.d) == ("7", None, ["a@y.co.uk", "b@x.org"], [])


@pytest.mark.parametrize("text, want", [("Light Heavyweight Bout", "Light Heavyweight"), ("UFC Interim Heavyweight Title Bout", "Heavyweight"), ("Womens Flyweight Bout", "Women's Flyweight"), ("Catch Weight Bout", "Catch Weight"), ("Openweight", "Open Weight"), ("UFC Superfight Tournament", "Superfight"), ("", "Unknown"), (None, "Unknown")])
def test_division_names(spark, text, want):
    assert spark.range(1).select(S.division_name(F.lit(text).cast("string")).alias("v")).first().v == want


def test_publishing(spark, tmp_path):
    with pytest.raises(ValueError):
        publishing.active(spark, str(tmp_path))
    for i in (1, 2):
        publishing.publish(spark.range(i), str(tmp_path), f"s{i}")
        assert publishing.active(spark, str(tmp_path)).count() == i
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "k int, s string")
    seen, kids = t.where("k = 1"), spark.createDataFrame([(3,)], "k int")
    assert sorted(r.k for r in publishing.reconciling_delete(t, seen, kids, "k", "s").collect()) == [1, 3, 4]
    swept = publishing.mark_and_sweep(t.withColumn("current", F.lit(True)), spark.createDataFrame([(1, "a"), (9, "a")], "k int, s string"), "k", "s")
    assert sorted(map(tuple, swept.collect())) == [(1, "a", True), (2, "a", False), (3, "a", False), (4, "b", True), (9, "a", True)]
    e = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, None), (2, 1, False)], "e int, d int, current boolean")
    assert sorted((r.e, r.d, r.current) for r in publishing.current_takeover(e, "e", "current", [F.desc("d")]).collect()) == [(1, 1, False), (1, 2, True), (1, 3, False), (2, 1, False)]


def test_matched_load_and_revisions(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "n string, id int")
    got = publishing.matched_load(spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "n string"), known, "n", "id").collect()
    assert sorted((str(r.n), r.id, r.outcome) for r in got) == [("None", None, "unmatched"), ("a", 1, "matched"), ("b", None, "ambiguous"), ("c", None, "unmatched")]
    t, u = spark.createDataFrame([(1, "x", 1), (2, "y", 5)], "k int, v string, revision int"), spark.createDataFrame([(1, "z", 1), (2, "w", 4), (3, "n", 1)], "k int, v string, revision int")
    new, conflicts = publishing.compare_and_set(t, u, "k", "v")
    assert sorted(map(tuple, new.collect())) == [(1, "z", 2), (2, "y", 5)] and sorted(r.k for r in conflicts.collect()) == [2, 3]
