"""Tool-call linking: calls meet results by identifier, are ordered topologically, validated and serialised.

DataFrame expressions only. Calls and results are hash-joined on (conversation, identifier). A call needs the calls whose
identifiers it names; its level is one more than the highest of theirs. Chains of calls that need one call each are
shortened by pointer doubling, so a chain of n costs log n joins; calls that need several are settled in rounds once all
they need is settled. What never settles is a cycle or behind one. Arguments are parsed once into a variant, checked
against the tool's schema, and written as canonical JSON: keys sorted, no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged, unstage

#: JSON type -> pattern of Spark's name for it.
TYPES = {"string": "^STRING", "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY"}
#: Turns that are numbered together within a conversation and level.
SPAN = 64


def violations(name: Column, text: Column, schemas: dict[str, dict[str, tuple]]) -> Column:
    """Sorted array of what is wrong with the JSON text as arguments of the tool.

    schemas: tool -> field -> (type, required) or (type, required, least, most), the bounds being of a string's
    characters or of a number. A null field counts as missing.
    """
    args = F.try_parse_json(text)
    keys = F.json_object_keys(F.to_json(args))
    out = F.array(F.lit("unknown tool"))
    for tool, fields in sorted(schemas.items(), reverse=True):
        found = []
        for field, (kind, required, *bounds) in sorted(fields.items()):
            path = F.lit(f'$["{field}"]')
            have = F.schema_of_variant(F.try_variant_get(args, path, "variant"))
            none = have.isNull() | (have == "VOID")
            wrong = F.when(~none & ~have.rlike(TYPES[kind]), F.lit(f"{field}: not {kind}"))
            if bounds:
                value = F.char_length(F.try_variant_get(args, path, "string")) if kind == "string" else F.try_variant_get(args, path, "double")
                wrong = F.coalesce(wrong, F.when(~none & ~value.between(*bounds), F.lit(f"{field}: not within {bounds[0]} and {bounds[1]}")))
            found.append(F.coalesce(F.when(none, F.lit(f"{field}: missing")), wrong) if required else wrong)
        other = F.transform(F.array_except(keys, F.array(*[F.lit(f) for f in sorted(fields)]).cast("array<string>")), lambda k: F.concat(k, F.lit(": unexpected")))
        checks = F.array_sort(F.concat(F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"), other))
        out = F.when(name == tool, F.when(keys.isNull(), F.array(F.lit("arguments: not an object"))).otherwise(checks)).otherwise(out)
    return out


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that need others; level is null on and behind cycles. Needs that name no
    call of the conversation are ignored, and so are null identifiers; equal calls and repeated needs count once."""
    known = calls.select("conv_id", "call_id").distinct()
    needs = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    edges = needs.join(known.withColumnRenamed("call_id", "need"), ["conv_id", "need"])
    # One row a call: its only need, or that it has several.
    edges = staged(edges.groupBy("conv_id", "call_id").agg(F.min("need").alias("need"), (F.count("*") > 1).alias("several")).join(edges.withColumnRenamed("need", "each"), ["conv_id", "call_id"]), "needs")
    one = staged(edges.where("not several").select("conv_id", "call_id", "need", F.lit(1).cast("long").alias("far")), "pointers")
    # A pointer's target is a call with one need while it can go on; on a cycle it always can.
    most, reach = one.count(), 1
    while reach <= most:
        onward = one.select("conv_id", F.col("call_id").alias("need"), F.col("need").alias("next"), F.col("far").alias("more"))
        both = one.join(onward, ["conv_id", "need"], "left")
        if both.where("next is not null").isEmpty():
            break
        jumped = staged(both.select("conv_id", "call_id", F.coalesce("next", "need").alias("need"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")), "pointers")
        unstage(one)
        one, reach = jumped, 2 * reach
    ends = one.join(one.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti")  # not on or behind a cycle of single needs
    done = _settled(edges.where("several").select("conv_id", "call_id", "each"), one)
    tops = ends.join(done.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left").join(
        edges.where("several").select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("open")).distinct(), ["conv_id", "need"], "left"
    )
    single = tops.select("conv_id", "call_id", (F.col("far") + F.when(F.col("open"), F.col("level")).otherwise(F.lit(0))).cast("int").alias("level"))
    behind = edges.select("conv_id", "call_id").distinct()
    return behind.join(single.unionByName(done.select("conv_id", "call_id", F.col("level").cast("int").alias("level"))), ["conv_id", "call_id"], "left")


def _settled(several: DataFrame, one: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that need several, as far as they settle. one(conv_id, call_id, need, far)
    leads from a call with one need to the end of its chain."""
    # Of each need the end of its chain and how far that is; an end that itself leads on lies on a cycle.
    steps = several.join(one.select("conv_id", F.col("call_id").alias("each"), F.col("need").alias("end"), "far"), ["conv_id", "each"], "left")
    steps = steps.select("conv_id", "call_id", F.coalesce("end", "each").alias("end"), (1 + F.coalesce("far", F.lit(0))).alias("far"))
    cyclic = one.select("conv_id", F.col("call_id").alias("end"), F.lit(True).alias("cyclic"))
    inner = several.select("conv_id", F.col("call_id").alias("end"), F.lit(True).alias("waits")).distinct()
    steps = staged(steps.join(cyclic, ["conv_id", "end"], "left").join(inner, ["conv_id", "end"], "left"), "steps")
    done = staged(steps.limit(0).select("conv_id", "call_id", F.lit(0).cast("long").alias("level")), "levels")
    while not steps.isEmpty():
        met = steps.join(done.withColumnRenamed("call_id", "end"), ["conv_id", "end"], "left")
        open_ = F.coalesce("cyclic", F.lit(False)) | (F.coalesce("waits", F.lit(False)) & F.col("level").isNull())
        ready = met.groupBy("conv_id", "call_id").agg(F.max(F.col("far") + F.coalesce("level", F.lit(0))).alias("level"), F.count_if(open_).alias("open")).where("open = 0").drop("open")
        now = staged(ready, "levels")  # a call that was ready stays so
        grown = now.count() > done.count()
        unstage(done)
        done = now
        if not grown:
            break
    return done


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """A row per call and per result without call.

    calls(conv_id, turn, call_id, name, arguments, needs) and results(conv_id, turn, call_id, content); arguments is
    JSON text, needs an array of identifiers. Equal rows count once; of several results for a call the earliest turn
    (then content) is linked and n_results says how many there are; several calls with one identifier all link to it
    and n_calls says so. A null identifier or conversation links to nothing. status: linked, unanswered or orphan.
    level is null on cycles, which come last; position counts a conversation's rows from 0 in the order of level,
    turn and identifier, an orphan at level 0. Other columns of the inputs are left out; empty tables give an empty one.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "needs").distinct()
    results = results.select("conv_id", "turn", "call_id", "content").distinct()
    answers = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    same = calls.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_calls"))
    level = levels(calls)
    linked = calls.join(answers, ["conv_id", "call_id"], "left").join(same, ["conv_id", "call_id"], "left")
    linked = linked.join(level.withColumn("needy", F.lit(True)), ["conv_id", "call_id"], "left")
    wrong = violations(F.col("name"), F.col("arguments"), schemas)
    linked = linked.select(
        "conv_id", "turn", "call_id", "name",
        F.when(F.col("r").isNull(), "unanswered").otherwise("linked").alias("status"),
        F.col("r.turn").alias("result_turn"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.coalesce("n_calls", F.lit(1)).cast("long").alias("n_calls"),
        F.when(F.col("needy"), F.col("level")).otherwise(F.lit(0)).alias("level"),
        F.array_join(wrong, "; ").alias("violations"),
        F.try_parse_json("arguments").alias("args"), F.col("r.content").alias("content"),
    )
    orphans = results.join(same, ["conv_id", "call_id"], "left_anti").select(
        "conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit("orphan").alias("status"),
        F.col("turn").alias("result_turn"), F.lit(1).cast("long").alias("n_results"), F.lit(0).cast("long").alias("n_calls"), F.lit(0).alias("level"),
        F.lit("").alias("violations"), F.try_parse_json(F.lit(None).cast("string")).alias("args"), "content",
    )
    rows = linked.unionByName(orphans)
    rows = rows.select(
        "conv_id", "turn", "call_id", "status", "result_turn", "n_results", "n_calls", "level", (F.col("violations") == "").alias("valid"), "violations",
        F.to_json(F.struct(F.col("args").alias("arguments"), F.col("conv_id").alias("conversation"), F.col("call_id").alias("id"), "name", F.col("content").alias("result"), "turn")).alias("json"),
    )
    return with_positions(staged(rows, "calls"))


def with_positions(rows: DataFrame) -> DataFrame:
    """rows with `position`: counted by conversation, level and span of turns first, so that no conversation is sorted whole."""
    rows = rows.withColumn("__level", F.coalesce("level", F.lit(2**31 - 1))).withColumn("__span", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(2**62))))
    sums = rows.groupBy("conv_id", "__level", "__span").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("conv_id").orderBy("__level", "__span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("__c"), F.col("__level").alias("__l"), F.col("__span").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    inside = Window.partitionBy("conv_id", "__level", "__span").orderBy("turn", "call_id", "status", "json")
    rows = rows.withColumn("__r", F.row_number().over(inside))
    out = rows.join(sums, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__level") == F.col("__l")) & (F.col("__span") == F.col("__s")))
    return out.withColumn("position", (F.col("__from") + F.col("__r") - 1).cast("long")).drop("__level", "__span", "__r", "__c", "__l", "__s", "__from")


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in plain conversations(conv_id, turn, role, text): each user turn calls the tool `reply` with
    its text under the identifier <conv_id>:<turn>, and needs the call two turns before, whose answer it follows; an
    assistant turn answers the turn before it."""
    ident = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    calls = conversations.where("role = 'user'").select("conv_id", "turn", ident(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.array(ident(F.col("turn") - 2)).alias("needs"))
    results = conversations.where("role = 'assistant'").select("conv_id", "turn", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


#: A prompt of 1 to 350 characters, in the first seven turns.
REPLY = {"reply": {"prompt": ("string", True, 1, 350), "turn": ("integer", True, 0, 6)}}


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations' exchanges as linked calls. System turns neither call nor answer."""
    calls, results = exchanges(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return link_tool_calls(calls, results, REPLY)


OP1_SQL = """
with recursive m as (select distinct conv_id, turn, role, text from conversations),
calls as (select conv_id, turn, text, conv_id || ':' || turn as call_id from m where role = 'user'),
results as (select conv_id, turn, text, conv_id || ':' || (turn - 1) as call_id from m where role = 'assistant'),
answers as (select conv_id, call_id, arg_min(turn, (turn, text)) as result_turn, arg_min(text, (turn, text)) as content, count(*) as n_results from results group by all),
same as (select conv_id, call_id, count(*) as n_calls from calls group by all),
ids as (select distinct conv_id, turn from calls where conv_id is not null and turn is not null),
lv as (
  select conv_id, turn, 0 as level from ids i where not exists (select 1 from ids j where j.conv_id = i.conv_id and j.turn = i.turn - 2)
  union all select i.conv_id, i.turn, lv.level + 1 from lv join ids i on i.conv_id = lv.conv_id and i.turn = lv.turn + 2),
r as (
  select c.conv_id, c.turn, c.call_id, case when a.call_id is null then 'unanswered' else 'linked' end as status, a.result_turn,
    coalesce(a.n_results, 0) as n_results, coalesce(s.n_calls, 1) as n_calls, coalesce(lv.level, 0)::integer as level,
    concat_ws('; ', case when c.text is null then 'prompt: missing' when length(c.text) not between 1 and 350 then 'prompt: not within 1 and 350' end,
      case when c.turn is null then 'turn: missing' when c.turn not between 0 and 6 then 'turn: not within 0 and 6' end) as violations,
    '{"arguments":{' || concat_ws(',', '"prompt":' || to_json(c.text), '"turn":' || c.turn) || '}' || coalesce(',"conversation":' || c.conv_id, '') || coalesce(',"id":' || to_json(c.call_id), '')
      || ',"name":"reply"' || coalesce(',"result":' || to_json(a.content), '') || coalesce(',"turn":' || c.turn, '') || '}' as json
  from calls c left join answers a on a.conv_id = c.conv_id and a.call_id = c.call_id left join same s on s.conv_id = c.conv_id and s.call_id = c.call_id
    left join lv on lv.conv_id = c.conv_id and lv.turn = c.turn
  union all
  select t.conv_id, t.turn, t.call_id, 'orphan', t.turn, 1, 0, 0, '',
    '{' || concat_ws(',', '"conversation":' || t.conv_id, '"id":' || to_json(t.call_id), '"result":' || to_json(t.text), '"turn":' || t.turn) || '}'
  from results t where not exists (select 1 from same s where s.conv_id = t.conv_id and s.call_id = t.call_id))
select conv_id, turn, call_id, status, result_turn, n_results::bigint as n_results, n_calls::bigint as n_calls, level, violations = '' as valid, violations, json,
  row_number() over (partition by conv_id order by level, turn nulls first, call_id nulls first, status, json) - 1 as position
from r
"""
