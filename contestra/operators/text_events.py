"""Events read from short texts: signals, ordered event types, mentions of known names, candidates for review.

Phrases are written as words, `*` standing for the rest of a word and `..n` for up to n words between; they hold for texts
after normalize_phrase. A topic's events are tried in their order and the first that has a phrase in the text counts.
What the events mean is said beside them; the phrases follow from that and from the tests.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_name, normalize_phrase


def phrase_pattern(phrases: tuple[str, ...]) -> str:
    """A regular expression for any of the phrases, as whole words."""
    out = []
    for phrase in phrases:
        parts, gap = [], None
        for word in phrase.split():
            if word.startswith(".."):
                gap = int(word[2:])
                continue
            step = "[a-z0-9']*" if word == "*" else word.replace("*", "[a-z0-9']*")
            parts.append(step if not parts else (rf"(?: [a-z0-9']+){{0,{gap}}}? " if gap is not None else " ") + step)
            gap = None
        out.append("".join(parts))
    return r"(?<![a-z0-9'])(?:" + "|".join(out) + r")(?![a-z0-9'])"


@dataclass(frozen=True)
class Topic:
    """events: type -> phrases, in order; otherwise: the type of a signal without any; not_about: none of these may occur;
    more: phrases that are a signal though they name no event."""

    events: dict[str, tuple[str, ...]]
    otherwise: str
    not_about: tuple[str, ...] = ()
    more: tuple[str, ...] = field(default=())


INJURY = Topic(
    {
        # Someone is said not to be fit, or not yet; this comes before being fit, whose words it holds.
        "injury_disclosed": ("not ..4 cleared", "hasn't ..4 cleared", "isn't ..4 cleared", "can't ..4 cleared", "cannot ..4 cleared", "won't ..4 cleared", "never ..4 cleared"),
        # A doctor or commission lets someone take part again.
        "cleared_to_compete": ("medically cleared", "cleared to fight", "cleared to compete", "cleared to return", "cleared for competition"),
        # Somebody takes the place of one who can't take part.
        "replacement_announced": ("step* in", "replac* ..2 injured", "replacement announced", "replacement found", "short notice replacement", "late replacement"),
        # Someone leaves a contest before it takes place.
        "withdrawal": ("pull* ..1 out", "back* out", "withdr*", "forced ..2 out", "drop* out", "pullout"),
    },
    "injury_disclosed",
    ("pull* out a", "pull* out the"),  # winning late
    ("injury setback", "injury update", "suffer* ..3 injury", "ongoing injury", "fresh injury", "undergo* ..2 surgery", "medical setback"),
)
DOPING = Topic(
    {
        # The case ends without a violation.
        "cleared": ("cleared of ..5 violation", "officially cleared for return", "case dismissed"),
        # A suspension is over.
        "reinstated": ("complet* ..4 suspension", "complet* ..4 ban", "served ..4 suspension"),
        # A first finding or a stop until more is known.
        "flagged": ("provisional* suspen*", "flagged for ..3 potential", "flagged for ..3 violation"),
        # A test found something.
        "positive_test": ("test* positive for", "fail* ..2 drug test"),
        # A sanction holds.
        "suspended": ("suspended for", "suspended until", "accept* ..6 sanction", "accept* ..6 ineligibility"),
    },
    "status_update",
    ("sponsorship", "broadcast", "supplement policy", "supplement guidance"),
)
COACH = Topic(
    {
        # Coach and athlete go different ways.
        "parted_ways": ("part* ways with ..2 coach*", "part* with ..2 coach*", "split* from ..2 coach*", "leav* ..2 coach*", "fire* ..2 coach*"),
        # Somebody starts to coach.
        "hired": ("new coach is", "new head coach", "hire* ..2 coach*", "joined by ..2 coach*"),
    },
    "parted_ways",
)
CAMP = Topic(
    {
        # An athlete goes away from a gym.
        "left": ("left ..3 gym", "leav* ..3 gym", "left ..3 camp", "leav* ..3 camp", "part* ways with ..3 gym", "no longer trains at"),
        # An athlete starts at a gym.
        "joined": ("join* ..3 gym", "join* ..3 camp", "mov* to ..3 gym", "now trains at", "switch* to ..3 camp"),
    },
    "status_update",
    ("gym bag", "boot camp for", "camp out"),
    ("train* camp", "trains at"),
)
#: Contract events by language, in the order in which they are looked for: an agreement that is renewed or made longer,
#: an option that is used or let go, terms that are changed, an end, its running out, freedom to sign, a new agreement.
CONTRACTS = {
    "en": Topic({"renewal": ("re sign*", "new contract with", "renew* ..3 contract"), "extension": ("extend* ..3 contract", "contract extension"), "option_declined": ("declin* ..3 option",), "option_exercised": ("exercis* ..3 option",), "renegotiation": ("renegotiat* ..3 contract",), "release": ("release* from", "release* by", "part* ways with", "cut from"), "expiration": ("contract ..2 expire*", "last fight ..3 contract"), "free_agency": ("free agen*", "test* free agency"), "signing": ("sign* with", "sign* ..3 contract", "join* ..1 roster")}, "status_update", ("has not signed", "hasn't signed", "denies signing", "contract law")),
    "es": Topic({"renewal": ("renueva ..3 contrato", "renov* con"), "release": ("deja ..3 promocion", "despedid* ..1 por", "rescinde ..2 contrato"), "free_agency": ("agente libre",), "signing": ("firma con", "firmo con", "ficha* por")}, "status_update"),
    "fr": Topic({"renewal": ("resigne avec",), "extension": ("prolonge ..3 contrat",), "release": ("quitte ..2 organisation", "libere* par", "rompt ..3 contrat"), "free_agency": ("agent libre",), "signing": ("signe avec", "signe ..2 contrat", "rejoint ..2 organisation")}, "status_update", ("n'a pas signe", "dement avoir signe")),
    "pt": Topic({"renewal": ("renova* ..3 contrato", "renova* com"), "release": ("demitid* do", "deixa ..2 organizacao"), "free_agency": ("agente livre",), "signing": ("assina com", "assinou com")}, "status_update"),
    "pl": Topic({"extension": ("przedluz* ..2 kontrakt",), "release": ("zwolnion* z", "rozwiaz* ..2 kontrakt"), "free_agency": ("wolny agent", "wolnym agentem"), "signing": ("podpis* ..2 kontrakt", "podpis* z")}, "status_update"),
}
SUMMARY_CHARACTERS = 1600
#: Names, and tenths of their ids, that may be broadcast; more are joined.
FEW_NAMES = 100_000


def has_signal(text: Column, topic: Topic) -> Column:
    """Whether the text has a phrase of the topic and none of what it isn't about; null: false."""
    t = F.coalesce(normalize_phrase(text), F.lit(""))
    hit = t.rlike(phrase_pattern((*topic.more, *(p for ps in topic.events.values() for p in ps))))
    return hit & ~t.rlike(phrase_pattern(topic.not_about)) if topic.not_about else hit


def event_type(text: Column, topic: Topic) -> Column:
    t, out = F.coalesce(normalize_phrase(text), F.lit("")), F.lit(topic.otherwise)
    for name, phrases in reversed(topic.events.items()):
        out = F.when(t.rlike(phrase_pattern(phrases)), name).otherwise(out)
    return out


def contract_event(text: Column, language: Column) -> Column:
    """The contract event of a text in its language (E01, E02): null without a signal, and in languages without phrases."""
    out = F.lit(None).cast("string")
    for code, topic in CONTRACTS.items():
        out = F.when((language == code) & has_signal(text, topic), event_type(text, topic)).otherwise(out)
    return out


def coach_name(text: Column) -> Column:
    """Up to three capitalised words after the word coach (a following `is` is skipped), or null."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    plain = F.transform(words, lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z]", "")))
    at = F.array_position(F.transform(plain, lambda w: w.isin("coach", "coaches").cast("int")), 1).cast("int")
    skip = F.when(F.get(plain, at) == "is", 1).otherwise(0)
    tail = F.slice(words, at + skip + 1, 3)
    none = F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("name"))

    def step(acc, w):
        on = acc["on"] & w.rlike("^[A-Z]")
        return F.struct(on.alias("on"), F.when(on, F.array_append(acc["name"], F.regexp_replace(w, "[,.;:!?]+$", ""))).otherwise(acc["name"]).alias("name"))

    return F.when(at > 0, F.nullif(F.array_join(F.aggregate(tail, none, step)["name"], " "), F.lit("")))


def promotions_in(texts: DataFrame, aliases: DataFrame, key: str, text: str, otherwise: str | None = None) -> DataFrame:
    """(key, promotion): the promotion whose alias stands nearest to a contract word of the text.

    aliases(promotion, alias). Texts are split into words and met with the aliases by equality of their first word; of
    equally near ones the first in the text, then by name. Texts without any get `otherwise` if that is given.
    """
    known = aliases.select("promotion", F.split(normalize_name(F.col("alias")), " ").alias("a")).where("a[0] <> ''").withColumn("first", F.col("a")[0])
    words = texts.select(F.col(key).alias("__k"), F.split(normalize_name(F.col(text)), " ").alias("w"))
    signal = F.array_compact(F.transform("w", lambda x, i: F.when(x.rlike("^(sign|contract|deal|join|leav|releas|agree)"), i)))
    rows = words.withColumn("s", signal).select("__k", "w", "s", F.posexplode("w").alias("i", "first")).join(F.broadcast(known), "first")
    rows = rows.where(F.slice("w", F.col("i") + 1, F.size("a")) == F.col("a"))
    far = F.coalesce(F.array_min(F.transform("s", lambda x: F.abs(x - F.col("i")))), F.lit(1 << 20))
    best = rows.groupBy("__k").agg(F.min(F.struct(far.alias("far"), "i", "promotion")).alias("b")).select("__k", F.col("b.promotion").alias("promotion"))
    out = texts.select(F.col(key).alias("__k")).distinct().join(best, "__k", "left")
    out = out.withColumn("promotion", F.coalesce("promotion", F.lit(otherwise))) if otherwise else out.where("promotion is not null")
    return out.withColumnRenamed("__k", key)


def incidental(text: Column, name: Column) -> Column:
    """Whether a name occurs only as somebody's opponent, relative or model (E09): after such a word, and never else."""
    t, n = F.concat(F.lit(" "), normalize_name(text), F.lit(" ")), normalize_name(name)
    after = F.lit(" (?:over|against|beat|beats|defeated|versus|vs|brother of|sister of|like|alongside) ")
    every = F.size(F.regexp_extract_all(t, F.concat(F.lit("(?<= )"), n, F.lit("(?= )")), F.lit(0)))
    aside = F.size(F.regexp_extract_all(t, F.concat(after, n, F.lit("(?= )")), F.lit(0)))
    return (every > 0) & (every == aside)


def mentions(texts: DataFrame, names: DataFrame, key: str, text: str, name_id: str, name: str) -> DataFrame:
    """(key, name, name_ids, ambiguous): names that occur as whole words in a text, each once.

    Names of two words or more and six characters or more count; names shared by several rows are ambiguous. A text's
    runs of as many words as some name has meet the names by equality of the whole, so that names with the same first
    words don't meet, and names may be of any length. Ids are joined to what is found, once that is distinct.
    """
    known = names.select(normalize_name(F.col(name)).alias("__n"), name_id).where((F.length("__n") >= 6) & (F.size(F.split("__n", " ")) >= 2))
    known = known.groupBy("__n").agg(F.sort_array(F.collect_set(name_id)).alias("name_ids"))
    sizes = known.groupBy(F.size(F.split("__n", " ")).alias("words")).agg(F.count("*").alias("names"), F.sum(F.size("name_ids")).alias("ids")).orderBy("words").collect()
    few = sum(r.names for r in sizes) <= FEW_NAMES and sum(r.ids for r in sizes) <= 10 * FEW_NAMES
    short, known = (F.broadcast(known.select("__n")), F.broadcast(known)) if few else (known.select("__n"), known)
    words = texts.select(key, F.split(normalize_name(F.col(text)), " ").alias("w")).where(F.size("w") > 1)
    lengths = F.filter(F.array(*[F.lit(r.words) for r in sizes]).cast("array<int>"), lambda n: n <= F.size("w"))
    runs = F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))
    found = words.select(key, F.explode(F.array_distinct(F.flatten(runs))).alias("__n")).join(short, "__n").select(key, "__n").distinct()
    return found.join(known, "__n").select(key, F.col("__n").alias("name"), "name_ids", (F.size("name_ids") > 1).alias("ambiguous"))


def candidates(rows: DataFrame, url: str, name: str, event: str, summary: str, ambiguous: str, order: list[Column]) -> DataFrame:
    """(key, url, name, event, summary, status): the first row of each sha256 key of (url, name, event)."""
    key = F.sha2(F.concat_ws("|", F.coalesce(url, F.lit("")), F.coalesce(name, F.lit("")), F.coalesce(event, F.lit(""))), 256)
    first = rows.withColumn("key", key).withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("__r = 1")
    return first.select("key", F.col(url).alias("url"), F.col(name).alias("name"), F.col(event).alias("event"), F.substring(summary, 1, SUMMARY_CHARACTERS).alias("summary"), F.when(F.col(ambiguous), "needs_identity").otherwise("pending").alias("status"))


def reconcile(queue: DataFrame, found: DataFrame) -> DataFrame:
    """The queue(key, status, reviewed) after a discovery run found(key, status).

    Reviewed rows stay as they are. Others take the status found for their key; those no longer found are `superseded`.
    """
    q, f = queue.select("key", F.col("status").alias("__old"), F.coalesce("reviewed", F.lit(False)).alias("__rev")), found.select("key", F.col("status").alias("__new"))
    both = q.join(f, "key", "full_outer")
    status = F.when(F.col("__rev"), F.col("__old")).when(F.col("__new").isNotNull(), F.col("__new")).otherwise("superseded")
    return both.select("key", status.alias("status"), F.coalesce("__rev", F.lit(False)).alias("reviewed"))


def record_basis(born_a: Column, born_b: Column) -> Column:
    """pending if births agree, needs_identity if one is missing, null (drop) if they differ."""
    return F.when(born_a.isNull() | born_b.isNull(), "needs_identity").when(born_a == born_b, "pending")
