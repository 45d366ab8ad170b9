"""Named queries over what comes in: feeds with their checks, free texts, and participants without an id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contest_text as T
from ..functions.free_text import alias_key, date_from_text, place
from ..operators.biography import by_biography, by_history
from ..sources.contests import contests, observations, read
from ..sources.feeds import contest_totals, live_contests
from .catalog import AS_OF, query

DIMS = ("dob", "gym", "nationality", "height", "reach", "stance")
ROWS_SQL = """people as (select s_suppkey as id, 'n' || (s_suppkey % 4) || '.' || (s_suppkey // 20) as name, case when s_suppkey % 6 > 0 then 'd' || (s_suppkey * 37 % 23) end as dob,
  case when s_suppkey % 5 > 0 then 'Gym ' || (s_suppkey % 9) end as gym, 'c' || (s_suppkey % 3) as nationality, (150 + s_suppkey * 7 % 40)::double as height,
  case when s_suppkey % 4 > 0 then (150 + s_suppkey * 11 % 45)::double end as reach, case when s_suppkey % 7 > 0 then case when s_suppkey % 2 = 0 then 'left' else 'right' end end as stance from supplier),
parts as (select seq as fight, side, name, case when (seq + case when side = 'b' then 1 else 0 end) % 4 > 0 then id end as id, case when seq % 3 = 0 then dob end as dob,
  case when seq % 4 > 0 then ' ' || upper(gym) || ' ' end as gym, case when seq % 2 = 0 then nationality end as nationality, case when seq % 7 > 0 then height + (seq % 5)::double * 0.9::double end as height,
  case when seq % 5 > 0 then reach + seq % 4 end as reach, case when seq % 3 = 1 then stance end as stance from obs join people on id = entity_id),
known0 as (select fight, side, id from parts where id is not null),
u0 as (select p.* exclude (id), k.id as opponent_id from parts p left join known0 k on k.fight = p.fight and k.side <> p.side where p.id is null),
c0 as (select u.fight, u.side, f.id, coalesce(u.dob = f.dob, false)::int as d, coalesce(lower(trim(u.gym)) = lower(trim(f.gym)), false)::int as g, coalesce(u.nationality = f.nationality, false)::int as n,
  coalesce(abs(u.height - f.height) <= 1.5, false)::int as h, coalesce(abs(u.reach - f.reach) <= 2, false)::int as r, coalesce(u.stance = f.stance, false)::int as s,
  case when abs(u.height - f.height) <= 1.5 then 4 when abs(u.height - f.height) <= 4 then 2 else 0 end + case when abs(u.reach - f.reach) <= 2 then 4 when abs(u.reach - f.reach) <= 5 then 2 else 0 end as body
  from u0 u join people f on f.name = u.name where (opponent_id is null or f.id <> opponent_id) and coalesce(u.dob = f.dob, true) and coalesce(abs(u.height - f.height) <= 12, true) and coalesce(abs(u.reach - f.reach) <= 15, true)),
r0 as (select *, row_number() over w as rn, lead(score) over w as nxt from (select fight, side, id, d, 12 * d + 5 * g + 3 * n + s + body as score, d + g + n + h + r + s as dims from c0) window w as (partition by fight, side order by score desc, id)),
a0 as (select fight, side, id, score::bigint as score, (score - coalesce(nxt, 0))::bigint as margin, (case when d = 1 and score >= 16 then 0.995 when score >= 14 then 0.99 when score >= 10 then 0.975 else 0.95 end)::double as confidence, 0 as pass
  from r0 where rn = 1 and score >= 7 and (d = 1 or dims >= 2) and (nxt is null or score - nxt >= 3))"""
PASS_SQL = """, f{k} as (select distinct p.name, a.id, p.dob, p.gym, p.nationality, p.height, p.reach, p.stance from parts p join a{j} a on a.fight = p.fight and a.side = p.side),
known{k} as (select * from known0 union all select fight, side, id from a{j}),
u{k} as (select p.* exclude (id), o.id as opponent_id from parts p left join known{k} o on o.fight = p.fight and o.side <> p.side where p.id is null and not exists (select 1 from a{j} a where a.fight = p.fight and a.side = p.side)),
c{k} as (select u.fight, u.side, f.id, max(coalesce(u.dob = f.dob, false)::int) as d, max(coalesce(lower(trim(u.gym)) = lower(trim(f.gym)), false)::int) as g, max(coalesce(u.nationality = f.nationality, false)::int) as n,
  max(coalesce(abs(u.height - f.height) <= 1.5, false)::int) as h, max(coalesce(abs(u.reach - f.reach) <= 2, false)::int) as r, max(coalesce(u.stance = f.stance, false)::int) as s
  from u{k} u join f{k} f on f.name = u.name where opponent_id is null or f.id <> opponent_id group by 1, 2, 3
  having not bool_or(coalesce(u.dob <> f.dob, false)) and not bool_or(coalesce(abs(u.height - f.height) > 12, false)) and not bool_or(coalesce(abs(u.reach - f.reach) > 15, false))),
r{k} as (select *, row_number() over w as rn, lead(score) over w as nxt from (select fight, side, id, d, 12 * d + 5 * g + 3 * n + 4 * h + 4 * r + s as score, d + g + n + h + r + s as dims from c{k}) window w as (partition by fight, side order by score desc, id)),
a{k} as (select * from a{j} union all select fight, side, id, score, score - coalesce(nxt, 0), (case when d = 1 and score >= 16 then 0.995 when score >= 14 then 0.99 when score >= 10 then 0.98 else 0.96 end)::double, {k}
  from r{k} where rn = 1 and score >= 8 and (d = 1 or dims >= 2) and (nxt is null or score - nxt >= 4))"""


def participants(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(rows, people): every side of every contest with part of its biography, a quarter of them without an id."""
    k = F.col("s_suppkey")
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    people = read(spark, d, "supplier").select(
        k.alias("id"), F.concat(text("n", k % 4), F.lit("."), F.floor(k / 20).cast("string")).alias("name"), F.when(k % 6 > 0, text("d", k * 37 % 23)).alias("dob"),
        F.when(k % 5 > 0, text("Gym ", k % 9)).alias("gym"), text("c", k % 3).alias("nationality"), (150 + k * 7 % 40).cast("double").alias("height"),
        F.when(k % 4 > 0, (150 + k * 11 % 45).cast("double")).alias("reach"), F.when(k % 7 > 0, F.when(k % 2 == 0, "left").otherwise("right")).alias("stance"),
    )
    s = F.col("seq")
    seen = {"dob": F.when(s % 3 == 0, F.col("dob")), "gym": F.when(s % 4 > 0, F.concat(F.lit(" "), F.upper("gym"), F.lit(" "))), "nationality": F.when(s % 2 == 0, F.col("nationality"))}
    seen |= {"height": F.when(s % 7 > 0, F.col("height") + (s % 5) * F.lit(0.9)), "reach": F.when(s % 5 > 0, F.col("reach") + s % 4), "stance": F.when(s % 3 == 1, F.col("stance"))}
    rows = observations(spark, d).join(people, F.col("entity_id") == F.col("id"))
    known = F.when((s + F.when(F.col("side") == "b", 1).otherwise(0)) % 4 > 0, F.col("id"))
    return rows.select(s.alias("fight"), "side", "name", known.alias("id"), *[seen[x].alias(x) for x in DIMS]), people


@query("i04_biography", ROWS_SQL + " select fight, side, id, score, margin, confidence from a0")
def i04(spark, d):
    return by_biography(*participants(spark, d))


@query("i05_history_passes", ROWS_SQL + "".join(PASS_SQL.format(k=k, j=k - 1) for k in range(1, 5)) + " select fight, side, id, score, margin, confidence, pass from a4")
def i05(spark, d):
    """What biographies resolve, carried on to rows that look like the resolved ones (G03: until a pass adds nothing)."""
    rows, people = participants(spark, d)
    return by_history(rows, by_biography(rows, people))


@query("f37_free_dates", f"""with x as (select o_orderkey, o_orderkey % 9 as k, cast(o_orderdate as date) + 4383 as day from orders),
y as (select *, try_cast('2001-' || strftime(day, '%m-%d') as date) as near, try_cast('2002-' || strftime(day, '%m-%d') as date) as later from x)
select o_orderkey, case when k < 7 then day when k = 7 then case when near < date '{AS_OF}' - 45 then later else near end end as day from y""".replace("with x", "select * from (with x") + ")", pre=False, dates=("day",))
def f37(spark, d):
    """Dates in seven written forms, without a year, and texts without any."""
    day, k = F.date_add(F.col("o_orderdate").cast("date"), 4383), F.col("o_orderkey") % 9
    forms = ["'Start 'yyyy/MM/dd' at 10:30'", "'am 'dd/MM/yyyy", "d.M.yyyy', Halle 3'", "yyyy年M月d日", "yyyy년 M월 d일", "'Card of 'MMMM d, yyyy", "'Doors 'd'th 'MMM yyyy", "'Card on 'MMMM d"]
    text = F.when(k == 8, F.when(F.col("o_orderkey") % 2 == 0, "to be announced, 99.99"))
    for i, form in enumerate(forms):
        text = F.when(k == i, F.date_format(day, form)).otherwise(text)
    return read(spark, d, "orders").select("o_orderkey", date_from_text(text, F.lit(AS_OF).cast("date")).alias("day"))


@query("f38_places", """with x as (select c_custkey, c_custkey % 6 as k, 'Town ' || c_nationkey as town from customer)
select c_custkey, case k when 0 then 'Hall ' || c_custkey || ', ' || town || ' , tx' when 1 then 'Arena, ' || town || ', England' when 2 then 'Hall A・B' when 3 then town when 5 then 'Dome, ' || town end as venue,
case when k in (0, 1, 2, 5) then town end as city, case when k = 0 then 'TX' end as region, case k when 0 then 'United States' when 1 then 'United Kingdom' else 'Japan' end as country from x""", pre=False)
def f38(spark, d):
    k, town = F.col("c_custkey") % 6, F.concat(F.lit("Town "), F.col("c_nationkey").cast("string"))
    texts = [F.concat(F.lit("Venue: Hall "), F.col("c_custkey").cast("string"), F.lit(",  "), town, F.lit(" , tx")), F.concat(F.lit("Arena – "), town, F.lit(" - England")), F.concat(town, F.lit(" ・ Hall A・B")), F.concat(town, F.lit(" 主催: x")), F.lit(None), F.concat(F.lit("会場: Dome, "), town)]
    p = place(F.element_at(F.array(*texts), (k + 1).cast("int")), {"england": "United Kingdom", "japan": "Japan"}, "Japan")
    return read(spark, d, "customer").select("c_custkey", p.alias("p")).select("c_custkey", "p.*")


@query("f08_name_keys", "select c_custkey, case when c_custkey = 7 then 'lost' else 'lukaszoconnor' || c_custkey end as name_key from customer", pre=False)
def f08(spark, d):
    name = F.concat(F.lit("Łukasz O'Cónnor  "), F.col("c_custkey").cast("string"))
    return read(spark, d, "customer").select("c_custkey", alias_key(name, {"lukaszoconnor7": "lost"}).alias("name_key"))


NAMES = {"ANNA MCKAY-O'NEIL": "Anna McKay-O'Neil", "jOHN d'arc": "jOHN d'arc", "LEE": "Lee", "MC ADAM": "Mc Adam", "": ""}


@query("f06_display_names", f"select c_custkey, [{', '.join(repr(n).replace(chr(34), chr(36) * 2) for n in NAMES.values())}][1 + c_custkey % {len(NAMES)}] as name from customer", pre=False)
def f06(spark, d):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("c_custkey") % len(NAMES) + 1).cast("int"))
    return read(spark, d, "customer").select("c_custkey", T.display_name(name).alias("name"))


@query("f48_event_slugs", "select o_orderkey, lower(replace(o_orderstatus, ' ', '-')) || '-night-' || o_orderkey || case when o_orderkey % 3 = 0 then repeat('x', 102 - length(o_orderkey::varchar)) else '' end || strftime(cast(o_orderdate as date), '-%Y-%m-%d') as slug from orders", pre=False)
def f48(spark, d):
    """Promotion, name and day; a third of the names are cut at 110 characters."""
    name = F.concat(F.lit("Night: "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, F.repeat(F.lit("x"), 200)).otherwise(F.lit(" !")))
    return read(spark, d, "orders").select("o_orderkey", T.event_slug(F.col("o_orderstatus"), name, F.col("o_orderdate").cast("date")).alias("slug"))


def _side(corner: str, x: str, won) -> F.Column:
    outcome = F.when(won == 1, "Win").when(won == 0, "Loss").otherwise("Draw")
    name = F.struct(F.lit(" E").alias("FirstName"), F.col(f"{x}_id").cast("string").alias("LastName"))
    return F.struct(F.col(f"{x}_id").alias("FighterId"), F.lit(corner).alias("Corner"), name.alias("Name"), F.struct(outcome.alias("Outcome")).alias("Outcome"))


def feeds(spark: SparkSession, d: str) -> DataFrame:
    """Cards of four contests at most; some name another event, repeat an id or lack a corner."""
    s, e = F.col("seq"), F.floor(F.col("seq") / 4)
    red, blue = _side("Red", "a", F.col("won_a")), _side("Blue", "b", 1 - F.col("won_a"))
    result = F.struct(F.when(F.col("finish"), "KO").alias("Method"), (1 + s % 5).cast("string").alias("EndingRound"), F.lit("4:59").alias("EndingTime"))
    one = F.struct(F.when(e % 11 == 0, 7).otherwise(s).alias("FightId"), F.when(s % 3 > 0, "Final").otherwise("Live").alias("Status"), F.when(s % 13 == 0, F.array(red)).otherwise(F.array(red, blue)).alias("Fighters"), result.alias("Result"))
    cards = contests(spark, d).groupBy(e.alias("event_id")).agg(F.collect_list(one).alias("FightCard"))
    detail = F.struct(F.when(F.col("event_id") % 7 == 0, -1).otherwise(F.col("event_id")).alias("EventId"), "FightCard")
    return cards.select("event_id", F.to_json(F.struct(detail.alias("LiveEventDetail"))).alias("payload"))


FEEDS = """e as (select *, seq // 4 as event_id, seq % 13 <> 0 as whole, seq % 3 > 0 as final from contests),
p as (select event_id, case when event_id % 7 = 0 then 'event mismatch or unavailable' when count(*) filter (whole) = 0 or (event_id % 11 = 0 and count(*) filter (whole) > 1) then 'empty or duplicate contest ids' end as problem from e group by 1)"""


@query("s06_live_feed", FEEDS + """ select event_id, case when event_id % 11 = 0 then '7' else seq::varchar end as contest_id, 'E ' || a_id as red, 'E ' || b_id as blue, case when final then case won_a when 1 then 'win' when 0 then 'loss' else 'draw' end end as red_outcome,
case when final then case won_a when 0 then 'win' when 1 then 'loss' else 'draw' end end as blue_outcome, case when final and finish then 'KO' end as method, case when final then (1 + seq % 5)::varchar end as ended_round, case when final then '4:59' end as ended_at, case when final then 'Final' else 'Live' end as status
from e join p using (event_id) where problem is null and whole""")
def s06(spark, d):
    return live_contests(feeds(spark, d))[0]


@query("z04_feed_problems", FEEDS + " select event_id, problem from p where problem is not null")
def z04(spark, d):
    """Feeds that fail a check, apart from those that pass."""
    return live_contests(feeds(spark, d))[1]


def totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of each contest; some name another contest, lack a line or break a check."""
    s = F.col("seq")

    def line(x):
        q = F.col(f"{x}_qty").cast("int")
        pairs = [v for p in ("SigStrikes", "TotalStrikes", "Takedowns") for v in (q.alias(f"{p}Landed"), F.when(s % 9 == 0, q - 1).otherwise(q + 5).alias(f"{p}Attempted"))]
        clock = F.when(s % 10 == 0, "3:77").otherwise(F.concat((s % 20).cast("string"), F.lit(":07")))
        return F.struct(F.col(f"{x}_id").alias("FighterId"), clock.alias("ControlTime"), F.when(s % 14 == 0, "2.5").otherwise((s % 3).cast("string")).alias("Knockdowns"), F.lit("1").alias("SubmissionsAttempted"), *pairs)

    lines = F.when(s % 8 == 0, F.array(line("a"))).otherwise(F.array(line("a"), line("b")))
    fight = F.struct(F.when(s % 12 == 0, -1).otherwise(s).alias("FightId"), F.array(_side("Red", "a", F.col("won_a")), _side("Blue", "b", 1 - F.col("won_a"))).alias("Fighters"), lines.alias("FightStats"))
    return contests(spark, d).select(s.alias("contest_id"), F.to_json(F.struct(fight.alias("LiveFightDetail"))).alias("payload"))


TOTALS = """x as (select *, case when seq % 12 = 0 then 'contest mismatch' when seq % 8 = 0 then 'totals unavailable' when seq % 14 = 0 then 'not a whole number' when seq % 9 = 0 then 'more landed than attempted'
  when seq % 10 = 0 then 'control time' when won_a = 0.5 then 'no winner' end as problem from contests)"""


def _totals_sql(x: str, corner: str, won: int) -> str:
    pairs = ", ".join(f"{x}_qty::int as {k}_landed, {x}_qty::int + 5 as {k}_attempted" for k in ("sig", "total", "takedowns"))
    return f"select seq as contest_id, '{corner}' as corner, 'E ' || {x}_id as name, won_a = {won} as won, (seq % 3)::int as knockdowns, 1 as submissions, {pairs}, (seq % 20 * 60 + 7)::int as control_seconds from x where problem is null"


@query("s07_contest_totals", f"{TOTALS} {_totals_sql('a', 'red', 1)} union all {_totals_sql('b', 'blue', 0)}")
def s07(spark, d):
    return contest_totals(totals(spark, d))[0]


@query("s07_total_problems", f"{TOTALS} select seq as contest_id, problem from x where problem is not null")
def s07_problems(spark, d):
    return contest_totals(totals(spark, d))[1]
