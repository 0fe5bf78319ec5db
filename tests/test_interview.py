"""The interview over distinct vectors against a plain loop over questions, options and schemes."""

import random
import time

import pytest

from marlstone.operators import eligibility
from marlstone.plans.logic import CODE, NAMES, age_probes, evaluate
from marlstone.sources import packs

ANSWERS = "person_id long, ord int, qid string, int_val int, str_val string, arr_val array<string>"


def two(x):
    return {"en": x, "hi": x + " hi"}


def made_up(seed, n_schemes, n_questions, most=8):
    """A random pack of nested rules, single and multiple choices, unlocks and ages."""
    rng = random.Random(seed)
    questions = [packs.SCHEMES["questions"][0]]
    facts = []
    for k in range(n_questions - 1):
        own = [f"f{k}_{j}" for j in range(2)]
        facts += own
        if k % 3 == 2:
            questions.append({"id": f"q{k}", "kind": "multi", "short": two(f"q{k}"), "text": two(f"Q{k}?"), "none": two("none"), "options": [{"id": f, "label": two(f), "fact": f} for f in own]})
        else:
            options = [{"id": f"o{j}", "label": two(f"o{j}"), "sets": {f: rng.choice(NAMES) for f in own if rng.random() < 0.8}} for j in range(3)]
            questions.append({"id": f"q{k}", "kind": "single", "short": two(f"q{k}"), "text": two(f"Q{k}?"), "help": two("why") if k % 2 else None, "options": options})

    def rule(depth):
        kind = rng.choice(["fact", "fact", "age", "not", "all", "any"] if depth else ["fact", "age"])
        if kind == "fact":
            return {"fact": rng.choice(facts)}
        if kind == "age":
            low = rng.randrange(0, 90)
            return {"age": [low, rng.choice([None, low + rng.randrange(30), 120])]}
        return {"not": rule(depth - 1)} if kind == "not" else {kind: [rule(depth - 1) for _ in range(rng.randrange(1, 4))]}

    schemes = [{"id": f"s{k}", "rule": {"all": [rule(2), rule(2), rule(1)]}} for k in range(n_schemes)]
    return {"facts": dict.fromkeys(facts, 1), "questions": questions, "schemes": schemes, "actionable": {facts[0]: {"to": "T", "hint": two("do it")}, facts[-1]: {"to": "L", "hint": two("ask")}}, "max_questions": most}


def brute(pack, answers):
    """answers: (qid, answer) of one person, in order. Gives (id, option ids, number) or None."""
    facts, age = {}, (0, 120)
    by_id = {q["id"]: q for q in pack["questions"]}
    for qid, a in answers:
        q = by_id[qid]
        if q["kind"] == "age":
            age = (a, a) if isinstance(a, int) else tuple(next(b["range"] for b in q["bands"] if b["id"] == a))
        elif q["kind"] == "single":
            facts |= {k: CODE[v] for k, v in next(o["sets"] for o in q["options"] if o["id"] == a).items()}
        else:
            facts |= {o["fact"]: CODE["T" if o["id"] in a else "F"] for o in q["options"]}

    def outcome(facts, age):
        found = []
        for s in pack["schemes"]:
            value = evaluate(s["rule"], facts, age)
            lifted = value == 0 and any(facts.get(f, 1) == 0 and evaluate(s["rule"], facts | {f: CODE[x["to"]]}, age) > 0 for f, x in pack["actionable"].items())
            found.append("u" if lifted else NAMES[value])
        return "".join(found)

    if len(answers) >= pack["max_questions"]:
        return None
    for q in pack["questions"]:
        if q["id"] in {x for x, _ in answers}:
            continue
        if q["kind"] == "age":
            shown = [b["id"] for b in q["bands"]] if len({outcome(facts, (a, a)) for a in age_probes([s["rule"] for s in pack["schemes"]])}) > 1 else []
        elif q["kind"] == "single":
            shown = [o["id"] for o in q["options"]] if len({outcome(facts | {k: CODE[v] for k, v in o["sets"].items()}, age) for o in q["options"]}) > 1 else []
        else:
            shown = [o["id"] for o in q["options"] if outcome(facts | {o["fact"]: 3}, age) != outcome(facts | {o["fact"]: 0}, age)]
        if shown:
            return q["id"], shown, len(answers) + 1
    return None


def random_answers(pack, rng):
    given = []
    for q in rng.sample(pack["questions"], rng.randrange(0, min(len(pack["questions"]), pack["max_questions"] + 1) + 1)):
        if q["kind"] == "age":
            given.append((q["id"], rng.choice([rng.randrange(121), "child", "senior"])))
        elif q["kind"] == "single":
            given.append((q["id"], rng.choice(q["options"])["id"]))
        else:
            given.append((q["id"], [o["id"] for o in q["options"] if rng.random() < 0.4]))
    return given


def table(spark, people):
    rows = [
        (p, k, q, a if isinstance(a, int) else None, a if isinstance(a, str) else None, a if isinstance(a, list) else None) for p, given in people.items() for k, (q, a) in enumerate(given)
    ]
    return spark.createDataFrame(rows, ANSWERS)


@pytest.mark.parametrize("seed,n_schemes,n_questions", [(1, 3, 4), (2, 30, 5), (3, 6, 7)])
def test_random_packs(spark, seed, n_schemes, n_questions):
    pack, rng = made_up(seed, n_schemes, n_questions, most=4), random.Random(seed)
    people = {p: given for p in range(150) if (given := random_answers(pack, rng))}
    found = eligibility.next_question(eligibility.facts_of(table(spark, people), pack), pack)
    got = {r["person_id"]: r for r in found.collect()}
    assert set(got) == set(people)
    asked = set()
    for p, given in people.items():
        want = brute(pack, given)
        r = got[p]
        assert ((r["next_question"], r["next_options"], r["question"]["number"]) if r["next_question"] else None) == want
        asked.add(want and want[0])
    assert len(asked) > 2


def test_question_in_full(spark):
    pack = packs.SCHEMES
    people = {1: [("age", 70), ("work", "farm"), ("place", "town"), ("account", "yes")], 2: [("place", "town")]}
    got = {r["person_id"]: r for r in eligibility.next_question(eligibility.facts_of(table(spark, people), pack), pack).collect()}
    q = got[1]["question"]
    assert (q["id"], q["kind"], q["number"], q["max_questions"], q["help"]) == ("more", "multi", 5, 8, None)
    assert q["text"]["en"] == "Any of these?" and q["none"]["en"] == "none" and [o["label"]["en"] for o in q["options"]] == brute(pack, people[1])[1]
    q = got[2]["question"]
    assert (q["id"], q["number"], q["none"], [o["id"] for o in q["options"]]) == ("age", 2, None, ["child", "adult", "senior"])


def test_large_pack_is_planned_quickly(spark):
    """12 schemes and 12 questions: the plan grows with the pack, not with its square."""
    times, sizes = {}, {}
    for n in (4, 12, 12):
        pack = made_up(7, n, n)
        people = eligibility.facts_of(table(spark, {1: [("age", 30)], 2: [("q0", "o1"), ("q1", "o0")]}), pack)
        began = time.perf_counter()
        found = eligibility.next_question(people, pack)
        sizes[n] = len(found._jdf.queryExecution().optimizedPlan().toString())
        times[n] = time.perf_counter() - began
        assert found.count() == 2
    assert times[12] < 5
    assert sizes[12] < 12 * sizes[4]


def test_hot_vector_and_extra_columns(spark):
    """Many people of one vector, and columns of the caller's own."""
    pack = packs.SCHEMES
    people = {p: [("age", 20), ("work", "study")] for p in range(2000)} | {5000: [("age", 61)]}
    known = eligibility.facts_of(table(spark, people), pack)
    got = eligibility.next_question(known.selectExpr("*", "1 AS q", "2 AS o", "3 AS _q2"), pack)
    assert got.columns == [*known.columns, "q", "o", "_q2", "next_question", "next_options", "question"]
    rows = got.collect()
    assert len(rows) == 2001 and {(r["next_question"], r["q"], r["o"]) for r in rows} == {(brute(pack, given)[0], 1, 2) for given in people.values()}
