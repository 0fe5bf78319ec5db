import copy
import itertools
import random

import pytest

from marlstone.operators import eligibility
from marlstone.plans import logic
from marlstone.plans.logic import CODE, Scope, evaluate, truth
from marlstone.sources import packs
from pyspark.sql import functions as F


def some_rule(rng, depth=3):
    kind = rng.choice(["all", "any", "not", "fact", "age"] if depth else ["fact", "age"])
    if kind in ("all", "any"):
        return {kind: [some_rule(rng, depth - 1) for _ in range(rng.randrange(0, 4))]}
    if kind == "not":
        return {"not": some_rule(rng, depth - 1)}
    if kind == "fact":
        return {"fact": rng.choice("abc")}
    low = rng.randrange(0, 100)
    return {"age": [low, rng.choice([None, low + rng.randrange(0, 40)])]}


def test_compiled_rules_equal_plain_ones(spark):
    rng = random.Random(2)
    rules = [some_rule(rng) for _ in range(40)]
    rows = [({f: rng.randrange(4) for f in rng.sample("abc", rng.randrange(4))}, lo := rng.randrange(0, 110), lo + rng.randrange(0, 30)) for _ in range(60)]
    df = spark.createDataFrame(rows, "facts map<string,tinyint>, lo int, hi int")
    scope = Scope(F.col("facts"), F.col("lo"), F.col("hi"))
    got = df.select("facts", "lo", "hi", *(truth(r, scope).alias(f"r{k}") for k, r in enumerate(rules))).collect()
    for row in got:
        assert list(row)[3:] == [evaluate(r, row["facts"], (row["lo"], row["hi"])) for r in rules]


def test_logic_constants():
    assert evaluate({"all": []}, {}, (0, 1)) == CODE["T"] and evaluate({"any": []}, {}, (0, 1)) == CODE["F"]
    assert [evaluate({"not": {"fact": "x"}}, {"x": v}, (0, 1)) for v in range(4)] == [3, 1, 1, 0]
    assert [evaluate({"age": b}, {}, (18, 59)) for b in ([18, 40], [60, None], [18, None])] == [CODE["U"], CODE["F"], CODE["T"]]
    with pytest.raises(ValueError):
        logic.trail({"odd": 1}, None)


@pytest.mark.parametrize("combine", [min, max])
def test_all_and_any_are_monotone(combine):
    for a, b, c in itertools.product(range(4), repeat=3):
        assert a > b or combine(a, c) <= combine(b, c)


def test_validate_tells_all_problems():
    eligibility.validate(packs.SCHEMES)
    bad = copy.deepcopy(packs.SCHEMES)
    bad["questions"][1]["options"][0]["sets"] = {"nope": "X"}
    bad["questions"][0]["id"] = "years"
    bad["schemes"][0]["sources"] = ["s9"]
    bad["schemes"][1]["where"] = None
    with pytest.raises(eligibility.PackError) as e:
        eligibility.validate(bad)
    for part in ("undeclared fact 'nope'", "bad truth value 'X'", "no age question", "unknown source 's9'", "missing where"):
        assert part in str(e.value)
    assert packs.check_signal_pack(packs.SIGNALS) == []
    assert packs.check_signal_pack({}) and any("unknown category" in p for p in packs.check_signal_pack(packs.SIGNALS | {"signals": {"x": {"weight": 1, "reason": {}, "category": "zz"}}}))


ANSWERS = "person_id long, ord int, qid string, int_val int, str_val string, arr_val array<string>"


def facts(spark, rows):
    return {r.person_id: r for r in eligibility.facts_of(spark.createDataFrame(rows, ANSWERS), packs.SCHEMES).collect()}


def test_facts_and_problems(spark):
    got = facts(spark, [
        (1, 0, "age", 70, None, None), (1, 1, "work", None, "farm", None), (1, 2, "work", None, "other", None), (1, 3, "more", None, None, ["widow"]),
        (2, 0, "age", None, "adult", None), (2, 1, "place", None, "moon", None), (2, 2, "nope", None, "x", None), (2, 3, "more", None, None, ["zz"]),
        (3, 0, "age", 400, None, None), (4, 0, "age", None, "old", None),
    ])
    assert got[1].facts == {"farmer": 0, "student": 0, "widow": 3, "taxpayer": 0} and (got[1].age_low, got[1].age_high) == (70, 70) and got[1].problems == []
    assert (got[2].age_low, got[2].age_high) == (18, 59) and len(got[2].problems) == 3
    assert got[3].problems == ["age must be 0-120"] and got[4].problems == ["unknown age band old"]


def test_interview_ends(spark):
    people = eligibility.facts_of(spark.createDataFrame([(1, k, q, None, "x", None) for k, q in enumerate("abcdefgh")] + [(2, 0, "place", None, "town", None)], ANSWERS), packs.SCHEMES)
    got = {r.person_id: r for r in eligibility.next_question(people, packs.SCHEMES).collect()}
    assert got[1].next_question is None and got[2].next_question == "age" and got[2].next_options == ["child", "adult", "senior"]


def test_cards_and_slip(spark):
    rows = [(1, 0, "age", 82, None, None), (1, 1, "account", None, "no", None), (1, 2, "work", None, "farm", None), (1, 3, "more", None, None, [])]
    people = eligibility.facts_of(spark.createDataFrame(rows, ANSWERS), packs.SCHEMES).withColumn("held", F.lit(["student_grant"]))
    got = {r.scheme: r for r in eligibility.cards(people, packs.SCHEMES, "held").collect()}
    assert got["farm_support"].status == "unlock" and got["farm_support"].unlock == "bank_account" and len(got["farm_support"].reasons) == 3
    assert got["old_age_pension"].status == "eligible" and got["old_age_pension"].benefit_now == "double" and got["old_age_pension"].counter == "Ask about old_age_pension, aged 82"
    assert got["student_grant"].status == "have" and [r.truth for r in got["student_grant"].reasons] == ["F", "F"]
    assert got["village_homes"].status == "check" and got["village_homes"].counter == "Ask whether homes are open"
    text = eligibility.slip(people, packs.SCHEMES, "2026-01-01", "held").first()["slip"]
    assert text.split("\n")[1:] == [
        "age=82; work=farm; account=no; more=none", "ELIGIBLE: old_age_pension", "CHECK AT OFFICE: village_homes", "AFTER OPENING A BANK ACCOUNT: farm_support", "ALREADY GETS: student_grant",
        "No name stored. Guidance only; the office decides.",
    ]


def test_profile_and_results(spark):
    rows = [
        (1, 0, "more", None, None, ["tax", "widow"]), (1, 1, "age", None, "senior", None), (1, 2, "place", None, "moon", None),
        (2, 0, "age", 400, None, None), (2, 1, "work", None, "study", None), (2, 2, "work", None, "farm", None), (3, 0, "more", None, None, []),
    ]
    people = eligibility.facts_of(spark.createDataFrame(rows, ANSWERS), packs.SCHEMES)
    got = {r.person_id: r for r in eligibility.results(people, packs.SCHEMES, "2026-01-01").collect()}
    assert [(p.id, p.answer.en, p.code) for p in got[1].profile] == [("age", "senior", "senior"), ("more", "widow; tax", "widow+tax")]
    assert [(p.id, p.code) for p in got[2].profile] == [("work", "farm")] and [(p.id, p.answer.en, p.code) for p in got[3].profile] == [("more", "none", "none")]
    assert got[1].asked == 3 and len(got[1].problems) == 1
    assert [c.scheme for c in got[1].cards] == [s["id"] for s in packs.SCHEMES["schemes"]]
    assert sum(len(getattr(got[1].groups, g)) for g in eligibility.GROUPS) == 4
    assert got[1].useful == 4 - len(got[1].groups.not_eligible)


def test_age_phrase_and_hindi(spark):
    people = eligibility.facts_of(spark.createDataFrame([(1, 0, "age", 70, None, None), (2, 0, "age", None, "adult", None), (3, 0, "work", None, "farm", None)], ANSWERS), packs.SCHEMES)
    got = {r.person_id: r for r in eligibility.cards(people, packs.SCHEMES).where("scheme = 'student_grant'").collect()}
    assert got[1].counter == "Ask about student_grant, aged 70" and got[1].counter_hi == "Ask about student_grant, 70 वर्ष के"
    assert got[2].counter == "Ask about student_grant, an adult" and got[3].counter == "Ask about student_grant,"
    n = spark.range(1).select(eligibility.format_n("{{{n}}} x", F.lit(7)).alias("x")).first().x
    assert n == "{7} x"
    with pytest.raises(eligibility.PackError):
        eligibility.format_n("{age}", F.lit(1))


def test_described_and_checklist(spark):
    people = eligibility.facts_of(spark.createDataFrame([(1, 0, "age", 20, None, None), (1, 1, "work", None, "study", None), (1, 2, "place", None, "unsure", None)], ANSWERS), packs.SCHEMES)
    pack = packs.SCHEMES | {"schemes": [s | {"check_how": {"en": "ask", "hi": "ask"}, "notes": [{"en": "note", "hi": "note"}]} for s in packs.SCHEMES["schemes"]]}
    got = {r.scheme: r for r in eligibility.described(eligibility.cards(people, pack), pack).collect()}
    assert got["student_grant"].status == "eligible" and got["student_grant"].check_how is None and got["student_grant"].notes[0].en == "note"
    assert got["student_grant"].source_rows == [{"id": "s1", "title": "made up"}]
    assert all((r.check_how is not None) == (r.status == "check") for r in got.values())
    docs = eligibility.checklist(eligibility.cards(people, packs.SCHEMES)).orderBy("place").collect()
    assert [d.place for d in docs] == list(range(1, len(docs) + 1)) and docs[0].document == "ID card"
    assert [d.schemes for d in docs] == sorted((d.schemes for d in docs), reverse=True)


def test_answers_from_link(spark):
    import base64

    text = '{"age": 30, "work": "farm", "more": ["tax"]}'
    link = base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
    df = spark.createDataFrame([(1, link)], "id long, link string").withColumn("json", packs.answers_from_link(F.col("link")))
    got = packs.read_answers(df, "id", "json").orderBy("ord").collect()
    assert [(r.qid, r.int_val, r.str_val, r.arr_val) for r in got] == [("age", 30, None, None), ("work", None, "farm", None), ("more", None, None, ["tax"])]


def test_answers_keep_their_types(spark):
    """No answer fails the job: bad ones are told as problems."""
    texts = {
        1: '{"work": "farm", "age": 7}', 2: '{"age": "7"}', 3: '{"age": 99999999999, "place": "town"}', 4: '{"age": 1.5}', 5: '{"age": true}', 6: '{"age": null}',
        7: '{"more": ["tax"], "zebra": 1, "account": ["yes"]}', 8: '{"more": [1]}', 9: "no json", 10: "[1]", 11: None, 12: '{"more": []}', 13: '{"work": "[x]"}',
    }
    rows = packs.read_answers(spark.createDataFrame(list(texts.items()), "id long, json string"), "id", "json")
    got = {(r.person_id, r.qid): (r.ord, r.int_val, r.str_val, r.arr_val) for r in rows.collect()}
    assert got[1, "work"] == (0, None, "farm", None) and got[1, "age"] == (1, 7, None, None)
    assert got[2, "age"] == (0, None, "7", None) and got[3, "age"][1:] == (None, "99999999999", None)
    assert [got[k, "age"][1:] for k in (4, 5)] == [(None, "1.5", None), (None, "true", None)]
    assert got[7, "more"] == (0, None, None, ["tax"]) and got[7, "zebra"] == (1, 1, None, None) and got[7, "account"] == (2, None, None, ["yes"])
    assert got[8, "more"][3] is None and got[12, "more"] == (0, None, None, []) and got[13, "work"] == (0, None, "[x]", None)
    assert {p for p, _ in got} == set(texts) - {9, 10, 11}
    known = {r.person_id: r for r in eligibility.facts_of(rows, packs.SCHEMES).collect()}
    assert not known[1].problems and not known[12].problems
    assert all(len(known[k].problems) == 1 for k in (2, 3, 4, 5, 6, 8, 13)) and len(known[7].problems) == 2
    assert (known[3].age_low, known[3].age_high) == (0, 120)
