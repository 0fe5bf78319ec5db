"""Eligibility interviews over tables of answers: facts, outcomes, the question to ask next, result cards and slips.

A pack is a dict with `facts`, `sources`, `questions`, `schemes`, `actionable`
and texts (see ``validate``). Its rules become columns once, on the driver;
every person is one row, so there is no join with schemes or questions.

Answers are one row for each (person, question): person_id, qid, int_val,
str_val, arr_val, ord. Answers that the pack doesn't know are told in `problems`
and left out of the profile.
"""

from __future__ import annotations

import json
import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.logic import AGE_LEAST, AGE_MOST, CODE, NAMES, Scope, Vector, age_probes, any_of, name_of, nodes, trail, truth

# Statuses, the order of their groups, and the slip's words.
STATUS = {"T": "eligible", "L": "likely", "U": "check", "F": "not_eligible"}
GROUPS = ("eligible", "likely", "check", "unlock", "have", "not_eligible")
SLIP_TITLES = {
    "eligible": "ELIGIBLE", "likely": "LIKELY (needs proof)", "check": "CHECK AT OFFICE",
    "unlock": "AFTER OPENING A BANK ACCOUNT", "have": "ALREADY GETS",
}
SLIP_END = "No name stored. Guidance only; the office decides."
YEARS = {"en": "years", "hi": "साल"}

#: Groups worth a visit, and those whose documents are listed.
USEFUL, VISIT = GROUPS[:5], GROUPS[:3]
WORDS = "struct<en:string,hi:string>"
LANGS = ("en", "hi")


class PackError(ValueError):
    """All problems of a pack at once."""


def validate(pack: dict) -> None:
    """Raise PackError with every reference that doesn't hold."""
    facts, problems = set(pack["facts"]), []
    ids = [q["id"] for q in pack["questions"]]
    problems += ["duplicate question ids"] if len(set(ids)) < len(ids) else []
    names = [s["id"] for s in pack["schemes"]]
    problems += ["duplicate scheme ids"] if len(set(names)) < len(names) else []
    for q in pack["questions"]:
        if q["kind"] not in ("age", "single", "multi"):
            problems.append(f"{q['id']}: unknown kind {q['kind']}")
        for o in q.get("options", []):
            used = set(o.get("sets", {})) | ({o["fact"]} if "fact" in o else set())
            problems += [f"{q['id']}.{o['id']}: undeclared fact '{f}'" for f in sorted(used - facts)]
            problems += [f"{q['id']}.{o['id']}: bad truth value '{v}'" for v in o.get("sets", {}).values() if v not in CODE]
    for s in pack["schemes"]:
        problems += [f"{s['id']}: undeclared fact '{n['fact']}'" for n in nodes(s["rule"]) if "fact" in n and n["fact"] not in facts]
        problems += [f"{s['id']}: unknown source '{x}'" for x in s.get("sources", []) if x not in pack["sources"]]
        problems += [f"{s['id']}: missing {k}" for k in ("name", "what", "benefit", "documents", "where", "counter") if not s.get(k)]
    if "age" not in ids:
        problems.append("no age question")
    if problems:
        raise PackError("; ".join(problems))


def facts_of(answers: DataFrame, pack: dict) -> DataFrame:
    """One row a person: facts, age_low, age_high, answered (question ids), given (the answers), problems. Later answers overwrite facts.

    Each answer becomes entries of a map by expressions on the pack; one
    aggregate by person orders and merges them.
    """
    entry = "array<struct<k:string,v:tinyint>>"
    low = high = F.lit(None).cast("int")
    entries, problem = F.array().cast(entry), F.lit(None).cast("string")
    known = [q["id"] for q in pack["questions"]]

    def pairs(values: dict[str, str]) -> Column:
        return F.array(*(F.struct(F.lit(k).alias("k"), F.lit(CODE[v]).cast("tinyint").alias("v")) for k, v in values.items())).cast(entry)

    for q in pack["questions"]:
        own = F.col("qid") == q["id"]
        if q["kind"] == "age":
            bands = {b["id"]: b["range"] for b in q["bands"]}
            fits = F.col("int_val").between(AGE_LEAST, AGE_MOST)
            banded = F.col("str_val").isin(list(bands))
            for k, side in enumerate(("low", "high")):
                value = F.col("int_val")
                for b, r in bands.items():
                    value = F.when(F.col("int_val").isNull() & (F.col("str_val") == b), r[k]).otherwise(value)
                if side == "low":
                    low = F.when(own, value).otherwise(low)
                else:
                    high = F.when(own, value).otherwise(high)
            problem = F.when(own & F.coalesce(F.col("int_val").isNotNull() & ~fits, F.lit(False)), F.lit(f"age must be {AGE_LEAST}-{AGE_MOST}")).when(
                own & F.col("int_val").isNull() & ~F.coalesce(banded, F.lit(False)), F.concat(F.lit("unknown age band "), F.coalesce("str_val", F.lit("")))
            ).otherwise(problem)
        elif q["kind"] == "single":
            options = {o["id"]: o["sets"] for o in q["options"]}
            for o, sets in options.items():
                entries = F.when(own & (F.col("str_val") == o), pairs(sets)).otherwise(entries)
            problem = F.when(own & ~F.coalesce(F.col("str_val").isin(list(options)), F.lit(False)), F.concat(F.lit(f"not an answer to {q['id']}: "), F.coalesce("str_val", F.lit("")))).otherwise(problem)
        else:
            chosen = [F.struct(F.lit(o["fact"]).alias("k"), F.when(F.array_contains("arr_val", o["id"]), CODE["T"]).otherwise(CODE["F"]).cast("tinyint").alias("v")) for o in q["options"]]
            entries = F.when(own & F.col("arr_val").isNotNull(), F.array(*chosen).cast(entry)).otherwise(entries)
            bad = F.array_except("arr_val", F.lit([o["id"] for o in q["options"]]))
            problem = F.when(own & (F.col("arr_val").isNull() | (F.size(bad) > 0)), F.concat(F.lit(f"not answers to {q['id']}: "), F.coalesce(F.array_join(bad, ","), F.lit("")))).otherwise(problem)
    problem = F.when(~F.col("qid").isin(known), F.concat(F.lit("unknown question "), "qid")).otherwise(problem)
    read = answers.select("person_id", "ord", "qid", low.alias("low"), high.alias("high"), entries.alias("entries"), problem.alias("problem"), "int_val", "str_val", "arr_val")
    rows = F.array_sort(F.collect_list(F.struct("ord", "qid", "low", "high", "entries", "problem", "int_val", "str_val", "arr_val")))
    merged = F.aggregate(
        F.flatten(F.transform("rows", lambda r: r["entries"])), F.create_map().cast("map<string,tinyint>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.create_map(e["k"], e["v"])),
    )
    aged = F.filter("rows", lambda r: r["low"].isNotNull())
    return read.groupBy("person_id").agg(rows.alias("rows")).select(
        "person_id",
        merged.alias("facts"),
        F.coalesce(F.try_element_at(aged, F.lit(-1))["low"], F.lit(AGE_LEAST)).alias("age_low"),
        F.coalesce(F.try_element_at(aged, F.lit(-1))["high"], F.lit(AGE_MOST)).alias("age_high"),
        F.transform("rows", lambda r: r["qid"]).alias("answered"),
        F.transform("rows", lambda r: F.struct(r["qid"].alias("qid"), r["int_val"].alias("int_val"), r["str_val"].alias("str_val"), r["arr_val"].alias("arr_val"), r["problem"].alias("problem"))).alias("given"),
        F.filter(F.transform("rows", lambda r: r["problem"]), lambda p: p.isNotNull()).alias("problems"),
    )


def scope_of() -> Scope:
    return Scope(F.col("facts"), F.col("age_low"), F.col("age_high"))


def unlock(scheme: dict, pack: dict, scope: Scope) -> Column:
    """The first actionable fact that is F and would lift the rule above F if it were changed; else null."""
    found = F.lit(None).cast("string")
    for fact, spec in reversed(list(pack.get("actionable", {}).items())):
        lifts = truth(scheme["rule"], scope.given({fact: CODE[spec["to"]]})) > CODE["F"]
        found = F.when((scope.fact(fact) == CODE["F"]) & lifts, F.lit(fact)).otherwise(found)
    return F.when(truth(scheme["rule"], scope) == CODE["F"], found)


def outcomes(pack: dict, scope: Scope) -> Column:
    """A letter for each scheme: F, U, L, T, or u for a no that can be unlocked."""
    return F.concat(*(F.when(unlock(s, pack, scope).isNotNull(), F.lit("u")).otherwise(name_of(truth(s["rule"], scope))) for s in pack["schemes"]))


#: Schemes whose outcomes fit into one number of base 5.
IN_A_NUMBER = 27


def consulted(pack: dict) -> list[str]:
    """The facts that rules or unlocks ask for, in pack order; no other fact can change an outcome."""
    asked = {n["fact"] for s in pack["schemes"] for n in nodes(s["rule"]) if "fact" in n} | set(pack.get("actionable", {}))
    return [f for f in pack["facts"] if f in asked]


def vectors(people: DataFrame, pack: dict) -> DataFrame:
    """people with what decides their interview: the values of consulted facts (`_values`), and which questions of the pack are answered (`_told`)."""
    scope = scope_of()
    values = F.array(*(scope.fact(f).cast("tinyint") for f in consulted(pack))).cast("array<tinyint>")
    return people.withColumns({"_values": values, "_told": F.array(*(F.array_contains("answered", q["id"]) for q in pack["questions"]))})


def changes(pack: dict) -> list[dict]:
    """What each question's answers would change: its number, its option's number (-1: all are compared), an age or values for consulted facts."""
    facts, made = consulted(pack), []

    def change(q: int, o: int, sets: dict[str, str] | None = None, age: int | None = None) -> None:
        made.append({"q": q, "o": o, "age": age, "sets": [CODE[sets[f]] if sets and f in sets else None for f in facts]})

    for k, q in enumerate(pack["questions"]):
        if q["kind"] == "age":
            for age in age_probes([s["rule"] for s in pack["schemes"]]):
                change(k, -1, age=age)
        else:
            for n, o in enumerate(q["options"]):
                if q["kind"] == "single":
                    change(k, -1, o["sets"])
                else:
                    change(k, n, {o["fact"]: "T"})
                    change(k, n, {o["fact"]: "F"})
    return made


def shown_options(people: DataFrame, pack: dict) -> DataFrame:
    """The questions that matter, for each distinct vector of vectors(): _values, age_low, age_high, _told, q, o.

    A question that isn't answered yet gives a row if its answers lead to different outcomes, with o = -1;
    of several choices each that matters gives a row. The changes are a literal array, so rules are compiled
    once whatever the number of questions, and evaluated once for each distinct vector and change. All
    groupings lie within the partitions of the distinct vectors.
    """
    key = ["_values", "age_low", "age_high", "_told"]
    tried = F.from_json(F.lit(json.dumps(changes(pack))), "array<struct<q:int,o:int,age:int,sets:array<tinyint>>>")
    rows = people.select(key).distinct().select(*key, F.explode(tried).alias("c")).where(~F.get("_told", F.col("c.q")))
    changed = F.zip_with("c.sets", "_values", lambda new, old: F.coalesce(new, old))
    rows = rows.select(*key, "c.q", "c.o", changed.alias("_changed"), F.coalesce("c.age", "age_low").alias("_low"), F.coalesce("c.age", "age_high").alias("_high"))
    scope = Vector(consulted(pack), F.col("_changed"), F.col("_low"), F.col("_high"))
    digits = [F.when(unlock(s, pack, scope).isNotNull(), 4).otherwise(truth(s["rule"], scope)).cast("long") for s in pack["schemes"]]
    numbers = [reduce(lambda a, b: a * 5 + b, digits[k : k + IN_A_NUMBER]) for k in range(0, len(digits), IN_A_NUMBER)]
    rows = rows.select(*key, "q", "o", *(n.alias(f"_n{k}") for k, n in enumerate(numbers)))
    differ = any_of([F.min(f"_n{k}") != F.max(f"_n{k}") for k in range(len(numbers))])
    return rows.groupBy(*key, "q", "o").agg(differ.alias("_differ")).where("_differ").drop("_differ")


def next_question(people: DataFrame, pack: dict) -> DataFrame:
    """people (of facts_of) with next_question, next_options (ids) and question (all that is shown); null when the interview is over.

    What is asked depends on few values, so it is found for distinct ones and joined back by them.
    """
    key, most = ["_values", "age_low", "age_high", "_told"], int(pack.get("max_questions", 8))
    known = vectors(people, pack)
    shown = shown_options(known.where(F.size("answered") < most), pack)
    first = shown.groupBy(*key).agg(F.min("q").alias("_q"), F.array_sort(F.collect_set(F.struct("q", "o"))).alias("_shown"))
    first = first.withColumn("_shown", F.transform(F.filter("_shown", lambda x: x["q"] == F.col("_q")), lambda x: x["o"]))

    told = [
        {k: q.get(k) for k in ("id", "kind", "short", "text", "help", "none")} | {"options": [{"id": o["id"], "label": o["label"]} for o in q["bands" if q["kind"] == "age" else "options"]]}
        for q in pack["questions"]
    ]
    table = F.from_json(F.lit(json.dumps(told)), f"array<struct<id:string,kind:string,short:{WORDS},text:{WORDS},help:{WORDS},none:{WORDS},options:array<struct<id:string,label:{WORDS}>>>>")
    first = first.select(*key, F.get(table, F.col("_q")).alias("_question"), "_shown")
    options = F.filter("_question.options", lambda o, k: F.array_contains("_shown", -1) | F.array_contains("_shown", k))
    first = first.select(*key, "_question", options.alias("_options"))
    open_ = F.size("answered") < most
    question = F.struct(
        *(F.col(f"_question.{k}").alias(k) for k in ("id", "kind", "short", "text", "help")), (F.size("answered") + 1).alias("number"), F.lit(most).alias("max_questions"),
        F.col("_options").alias("options"), F.when(F.col("_question.kind") == "multi", F.col("_question.none")).alias("none"),
    )
    asked = known.join(first, key, "left").withColumn("question", F.when(open_ & F.col("_question").isNotNull(), question))
    return asked.select(*people.columns, F.col("question.id").alias("next_question"), F.transform("question.options", lambda o: o["id"]).alias("next_options"), "question")


def _words(text: dict) -> Column:
    return F.struct(*(F.lit(text[lang]).alias(lang) for lang in LANGS)).cast(WORDS)


def format_n(template: str, n: Column) -> Column:
    """A template of the pack with {n} filled in; doubled braces stand for themselves."""
    parts = []
    for plain, field, spec, conversion in string.Formatter().parse(template):
        parts.append(F.lit(plain))
        if field is not None:
            if field != "n" or spec or conversion:
                raise PackError(f"unsupported field in '{template}'")
            parts.append(n.cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def age_phrase(pack: dict, lang: str) -> Column:
    """An exact age in words, the phrase of the band that was chosen, or nothing."""
    exact = F.col("age_low") == F.col("age_high")
    phrase = F.when(exact, format_n(pack["age_phrase"]["exact"][lang], F.col("age_low")))
    for b in next(q for q in pack["questions"] if q["kind"] == "age")["bands"]:
        phrase = phrase.when((F.col("age_low") == b["range"][0]) & (F.col("age_high") == b["range"][1]), b["phrase"][lang])
    return phrase.otherwise("")


def profile(pack: dict) -> Column:
    """The answers of a person of facts_of in question order, in words: id, short, answer and code of each."""
    made = []
    for q in pack["questions"]:
        last = F.try_element_at(F.filter("given", _asked(q["id"])), F.lit(-1))
        if q["kind"] == "multi":
            chosen = F.filter(F.array(*(F.when(F.array_contains(last["arr_val"], o["id"]), F.struct(F.lit(o["id"]).alias("id"), *(F.lit(o["label"][lang]).alias(lang) for lang in LANGS))) for o in q["options"])), lambda o: o.isNotNull())
            joined = F.struct(*(F.array_join(F.transform(chosen, _part(lang)), "; ").alias(lang) for lang in LANGS)).cast(WORDS)
            answer = F.when(F.size(chosen) > 0, joined).otherwise(_words(q["none"]))
            code = F.when(F.size(chosen) > 0, F.array_join(F.transform(chosen, _part("id")), "+")).otherwise("none")
        else:
            answer, code = F.lit(None).cast(WORDS), last["str_val"]
            for o in q["bands"] if q["kind"] == "age" else q["options"]:
                answer = F.when(code == o["id"], _words(o["label"])).otherwise(answer)
            if q["kind"] == "age":
                years = F.struct(*(F.concat(last["int_val"].cast("string"), F.lit(f" {YEARS[lang]}")).alias(lang) for lang in LANGS)).cast(WORDS)
                answer, code = F.when(last["int_val"].isNotNull(), years).otherwise(answer), F.coalesce(last["int_val"].cast("string"), code)
        entry = F.struct(F.lit(q["id"]).alias("id"), _words(q["short"]).alias("short"), answer.alias("answer"), code.alias("code"))
        made.append(F.when(last.isNotNull() & last["problem"].isNull(), entry))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def card_list(pack: dict, have: str | None = None) -> Column:
    """A card for each scheme, in pack order, of a person of facts_of."""
    scope = scope_of()
    phrases = {lang: age_phrase(pack, lang) for lang in LANGS}

    def filled(text: str, lang: str) -> Column:
        return F.trim(F.regexp_replace(F.replace(F.lit(text), F.lit("{age_phrase}"), phrases[lang]), "\\s+", " "))

    made = []
    for k, s in enumerate(pack["schemes"]):
        value, said = trail(s["rule"], scope)
        key = unlock(s, pack, scope)
        held = F.array_contains(have, s["id"]) if have else F.lit(False)
        status = F.when(F.coalesce(held, F.lit(False)), "have").when(key.isNotNull(), "unlock")
        for name in NAMES:
            status = status.when(value == CODE[name], STATUS[name])
        reasons = F.array(*(F.struct(F.lit(t["en"]).alias("en"), F.lit(t["hi"]).alias("hi"), name_of(v).alias("truth")) for t, v in said)).cast("array<struct<en:string,hi:string,truth:string>>")
        reasons = F.when((value == CODE["F"]) & key.isNull(), F.filter(reasons, lambda r: r["truth"] == "F")).otherwise(reasons)
        now = {lang: F.lit(None).cast("string") for lang in LANGS}
        for v in reversed(s.get("benefit_now", [])):
            met = truth(v["when"], scope) == CODE["T"] if v.get("when") else F.lit(True)
            now = {lang: F.when(met, F.lit(v[lang])).otherwise(now[lang]) for lang in LANGS}
        default = s["counter"]["default"]
        counter = {lang: F.when(status == "check", filled((s["counter"].get("check") or default)[lang], lang)).otherwise(filled(default[lang], lang)) for lang in LANGS}
        made.append(F.struct(
            F.lit(k).alias("ord"), F.lit(s["id"]).alias("scheme"), F.lit(s["short"]).alias("short"), name_of(value).alias("truth"), status.alias("status"), key.alias("unlock"),
            reasons.alias("reasons"), now["en"].alias("benefit_now"), now["hi"].alias("benefit_now_hi"), counter["en"].alias("counter"), counter["hi"].alias("counter_hi"),
            F.lit(s["documents"]).cast("array<string>").alias("documents"), F.lit(s.get("sources", [])).cast("array<string>").alias("sources"),
        ))
    return F.array(*made)


def cards(people: DataFrame, pack: dict, have: str | None = None) -> DataFrame:
    """A row for each person and scheme: truth, status, reasons, unlock, counter text, benefit_now, documents, sources.

    have names a column of scheme ids that a person has already. Texts that are the same for all are in `scheme_texts`.
    """
    return people.select("person_id", F.explode(card_list(pack, have)).alias("card")).select("person_id", "card.*")


def scheme_texts(spark: SparkSession, pack: dict) -> DataFrame:
    """A row for each scheme of the pack: ord, scheme, short, family, name, what, benefit, where, notes, check_how, source_rows."""
    rows = [
        (k, s["id"], s["short"], s["family"], s["name"], s["what"], s["benefit"], s["where"], s.get("notes", []), s.get("check_how"),
         [{"id": x} | {name: str(v) for name, v in pack["sources"][x].items()} for x in s.get("sources", [])])
        for k, s in enumerate(pack["schemes"])
    ]
    return spark.createDataFrame(rows, f"ord int, scheme string, short string, family string, name {WORDS}, what {WORDS}, benefit {WORDS}, where {WORDS}, notes array<{WORDS}>, check_how {WORDS}, source_rows array<map<string,string>>")


def catalog(spark: SparkSession, pack: dict) -> DataFrame:
    """The schemes on offer: ord, scheme, short, family, name, what."""
    return scheme_texts(spark, pack).select("ord", "scheme", "short", "family", "name", "what")


def described(found: DataFrame, pack: dict) -> DataFrame:
    """Cards with their schemes' texts; check_how only where the status is check. The pack's rows, one a scheme, are broadcast."""
    texts = scheme_texts(found.sparkSession, pack).drop("ord", "short")
    return found.join(F.broadcast(texts), "scheme").withColumn("check_how", F.when(F.col("status") == "check", F.col("check_how")))


def groups(found: DataFrame) -> DataFrame:
    """(person_id, status, schemes): scheme ids of each status in pack order."""
    return found.groupBy("person_id", "status").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "scheme"))), lambda x: x["scheme"]).alias("schemes"))


def checklist(found: DataFrame) -> DataFrame:
    """(person_id, place, document, schemes): documents of schemes worth a visit, by their name before " (", the most wanted first."""
    name = F.trim(F.lower(F.substring_index("document", " (", 1)))
    rank = F.array_position(F.lit(list(VISIT)), F.col("status"))
    rows = found.where(F.col("status").isin(*VISIT)).select("person_id", "short", "ord", rank.alias("rank"), F.posexplode("documents").alias("pos", "document"))
    counted = rows.groupBy("person_id", name.alias("name")).agg(F.count_distinct("short").alias("schemes"), F.min(F.struct("rank", "ord", "pos", "document")).alias("first"))
    # A person's list is no longer than the documents of the pack.
    place = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("schemes"), "first"))
    return counted.select("person_id", place.alias("place"), F.col("first.document").alias("document"), "schemes")


def results(people: DataFrame, pack: dict, date: str, have: str | None = None) -> DataFrame:
    """The end of the interview in one row a person: asked, useful, profile, cards, groups, slip and problems; no shuffle."""
    made = people.select("person_id", F.size("answered").alias("asked"), "problems", profile(pack).alias("profile"), card_list(pack, have).alias("cards"))
    ids = {g: F.transform(F.filter("cards", _is(g)), _part("scheme")) for g in GROUPS}
    lines = [F.lit(f"{pack.get('slip_title', 'SLIP')} | {pack['pack']} pack {pack['version']} | {date}")]
    lines.append(F.array_join(F.transform("profile", lambda p: F.concat(p["id"], F.lit("="), p["code"])), "; "))
    for status, title in SLIP_TITLES.items():
        own = F.transform(F.filter("cards", _is(status)), _part("short"))
        lines.append(F.when(F.size(own) > 0, F.concat(F.lit(f"{title}: "), F.array_join(own, ", "))))
    return made.select(
        "person_id", "asked", F.size(F.filter("cards", lambda c: c["status"].isin(*USEFUL))).alias("useful"), "profile", "cards",
        F.struct(*(ids[g].alias(g) for g in GROUPS)).alias("groups"), F.concat_ws("\n", *lines, F.lit(SLIP_END)).alias("slip"), "problems",
    )


def slip(people: DataFrame, pack: dict, date: str, have: str | None = None) -> DataFrame:
    """(person_id, slip): the printed summary: the answers, and a line for each group that has schemes."""
    return results(people, pack, date, have).select("person_id", "slip")


def _is(status: str):
    return lambda x: x["status"] == status


def _asked(qid: str):
    return lambda x: x["qid"] == qid


def _part(name: str):
    return lambda x: x[name]
