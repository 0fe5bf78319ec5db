"""Packs: rules as plain data. Readers, checks, and the packs that come along, which are synthetic and ours alone."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT = T.StructType([T.StructField("en", T.StringType()), T.StructField("hi", T.StringType())])
PATTERNS = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("version", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("sha256", T.StringType()), T.StructField("signed_by", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("threshold", T.DoubleType()),
        T.StructField("patterns", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "category", "text")]))),
    ])),
])
MESSAGES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("label", TEXT), T.StructField("text", T.StringType()),
    T.StructField("sender", T.StringType()), T.StructField("input_type", T.StringType()),
])
DEMO = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("version", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("examples", T.ArrayType(MESSAGES)),
        T.StructField("qr_examples", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("label", TEXT), T.StructField("payload", T.StringType())]))),
    ])),
])
INPUT_TYPES = ("text", "voice", "ocr", "qr", "call")


def read_envelope(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A one-row table of a pack file; the schema is given, never inferred."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, category, text, threshold) of a pattern pack."""
    return read_envelope(spark, path, PATTERNS).select("data.threshold", F.posexplode("data.patterns").alias("ord", "p")).select("ord", "p.*", F.coalesce("threshold", F.lit(0.5)).alias("threshold"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return read_envelope(spark, path, DEMO).select(F.posexplode("data.examples").alias("ord", "m")).select("ord", "m.*")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return read_envelope(spark, path, DEMO).select(F.posexplode("data.qr_examples").alias("ord", "m")).select("ord", "m.*")


def input_type(column: Column) -> Column:
    """The input type, `text` for any that isn't known."""
    return F.when(column.isin(*INPUT_TYPES), column).otherwise("text")


def pack_age_days(date: Column, now: Column) -> Column:
    return F.datediff(now, F.to_date(date))


def is_stale(date: Column, now: Column, most: int = 45) -> Column:
    return pack_age_days(date, now) > most


def answers_from_link(encoded: Column) -> Column:
    """The JSON text of a base64url answers parameter."""
    plain = F.translate(encoded, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    return F.decode(F.unbase64(padded), "utf-8")


def read_answers(people: DataFrame, person: str, text: str) -> DataFrame:
    """Answer rows (person_id, ord, qid, int_val, str_val, arr_val) of a JSON object of question id to answer.

    Answers keep their types: 7 is a number, "7" a text, and only a list of texts is a list. Whole numbers that
    no INT holds, and all else (null, true, 1.5, objects), become texts of their JSON, which no question takes, so
    that ``facts_of`` tells them as problems; no answer fails the job. A text that is no JSON object gives no rows.
    """
    keys = F.json_object_keys(text)
    rows = people.select(F.col(person).alias("person_id"), F.posexplode(keys).alias("ord", "qid"), F.try_parse_json(text).alias("_json"))
    typed = F.try_variant_get("_json", "$", "map<string,variant>")
    rows = rows.withColumn("_value", F.try_element_at(typed, F.col("qid")))
    kind, number = F.schema_of_variant("_value"), F.try_variant_get("_value", "$", "bigint")
    is_int = (kind == "BIGINT") & number.between(-(2**31), 2**31 - 1)
    items = F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get("_value", "$", "array<string>"))
    plain = F.when(kind == "STRING", F.try_variant_get("_value", "$", "string")).when(~is_int & items.isNull(), F.to_json("_value"))
    return rows.select("person_id", "ord", "qid", F.when(is_int, number.cast("int")).alias("int_val"), plain.alias("str_val"), items.alias("arr_val"))


def check_signal_pack(pack: dict) -> list[str]:
    """All problems of a signal pack: what its parts refer to and don't have."""
    problems = [f"missing {k}" for k in ("signals", "lexicons", "domains", "thresholds", "categories", "verdicts", "no_signs") if k not in pack]
    if problems:
        return problems
    for name, s in pack["signals"].items():
        problems += [f"{name}: missing {k}" for k in ("weight", "reason") if k not in s]
        if s.get("category") and s["category"] not in pack["categories"]:
            problems.append(f"{name}: unknown category {s['category']}")
    problems += [f"thresholds: missing {k}" for k in ("scam", "suspicious", "negative_floor") if k not in pack["thresholds"]]
    problems += [f"categories.{c}: missing {k}" for c, v in pack["categories"].items() for k in ("name", "priority", "actions") if k not in v]
    if "generic" not in pack["categories"]:
        problems.append("categories: missing generic")
    return problems


def write_pack(pack: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(pack, f, ensure_ascii=False, indent=1)


def _two(en: str, hi: str | None = None) -> dict:
    return {"en": en, "hi": hi or en}


def _signal(weight: float, en: str, category: str | None = None, hard: bool = False, **more) -> dict:
    return {"weight": weight, "reason": _two(en), "hard": hard} | ({"category": category} if category else {}) | more


#: A synthetic pack: every phrase, weight and threshold here is made up for this library and its tests.
SIGNALS: dict = {
    "pack": "synthetic-signals", "version": "1", "date": "2026-01-01",
    "signals": {
        "otp_request": _signal(3.0, "It asks for a one-time code", "otp_pin", True, sensitive=True),
        "personal_info_request": _signal(1.5, "It asks for personal details", "kyc", sensitive=True),
        "upi_receive": _signal(3.0, "Receiving money needs no PIN or scan", "upi_receive", True),
        "link_apk": _signal(2.5, "The link installs an app", "malicious_app", True),
        "link_ip": _signal(1.2, "The link is a bare address"), "link_shortener": _signal(0.8, "The link is shortened"),
        "link_suspicious_tld": _signal(0.8, "The link has an unusual ending"), "link_lookalike": _signal(1.5, "{domain} holds a known name"),
        "link_bank_unofficial": _signal(2.0, "{domain} is no bank's address", "kyc"), "link_present": _signal(0.3, "There is a link", show=False),
        "official_link": _signal(-1.0, "All links are official"), "link_hiding": _signal(1.5, "It asks to mend a broken link"),
        "call_mobile_claims_org": _signal(1.5, "A mobile number calls for an office", "impersonation"), "sender_mobile_claims_org": _signal(1.2, "A mobile number writes for an office", "impersonation"),
        "dlt_sender": _signal(-0.6, "The sender is registered"), "bank_1600_caller": _signal(-1.0, "The number is of the bank series"),
        "contact_mobile": _signal(0.7, "It gives a mobile number to call"), "org_contact_mobile": _signal(1.0, "An office gives a mobile number", "impersonation"),
        "fake_alert_callback": _signal(1.5, "An alert asks to call back", "impersonation"), "customer_care_bait": _signal(1.2, "A number poses as customer care", "customer_care"),
        "urgency": _signal(0.6, "It presses for time"), "digital_arrest": _signal(3.0, "No one is arrested by call", "digital_arrest", True), "threat_authority": _signal(1.2, "It threatens with an authority", "digital_arrest"),
        "courier_seized": _signal(1.5, "A parcel is said to be seized", "courier"), "delivery_fee": _signal(1.5, "A delivery asks for a fee by link", "courier"),
        "secrecy": _signal(1.5, "It asks for secrecy"), "prize": _signal(1.5, "It promises a prize", "prize"),
        "easy_money": _signal(1.5, "It promises easy money", "job_task"), "easy_money_weak": _signal(0.4, "It hints at easy money", "job_task", show=False),
        "investment_promise": _signal(1.5, "It promises returns", "investment"), "join_group": _signal(0.8, "It asks to join a group", "job_task"),
        "advance_fee": _signal(1.8, "It asks for money first", "loan_fee"), "job_fee": _signal(2.0, "A job asks for money", "job_task"), "loan_offer": _signal(0.8, "It offers a loan", "loan_fee"),
        "unseen_advance": _signal(1.8, "It asks to pay for what was not seen", "loan_fee"), "kyc_threat": _signal(1.8, "It threatens to block an account", "kyc"), "kyc_mention": _signal(0.4, "It speaks of KYC", "kyc"),
        "electricity_cut": _signal(2.0, "It threatens to cut power", "electricity"), "relative_emergency": _signal(2.0, "A relative is said to need money", "impersonation"),
        "new_number": _signal(0.8, "A known person has a new number", "impersonation"), "sim_swap": _signal(1.8, "It asks for a SIM change", "otp_pin"),
        "refund_bait": _signal(1.2, "It baits with a refund", "customer_care"), "wrong_transfer": _signal(1.8, "Money sent by mistake is asked back", "upi_receive"),
        "sextortion": _signal(3.0, "It blackmails", "sextortion", True, sensitive=True), "govt_scheme_bait": _signal(1.5, "A scheme is offered by link", "govt_scheme"), "scheme_click": _signal(1.2, "A free scheme asks to click", "govt_scheme"),
        "scheme_fee": _signal(1.5, "A scheme asks for a fee", "govt_scheme"), "donation_appeal": _signal(1.0, "A donation to a private handle", "generic"), "challan_link": _signal(1.5, "A fine by link", "govt_payment"),
        "tax_refund_bait": _signal(1.5, "A tax refund by link", "govt_payment"), "remote_access": _signal(2.5, "It asks for screen sharing", "malicious_app", True), "call_forwarding": _signal(2.5, "It forwards your calls", "otp_pin", True),
        "app_install": _signal(1.2, "It asks to install an app", "malicious_app"), "lookalike_text": _signal(1.2, "Letters of other scripts are mixed in"),
        "genuine_otp_delivery": _signal(-2.0, "It only delivers a code"), "genuine_txn_alert": _signal(-1.5, "It only tells of a payment"), "doorstep_code": _signal(-1.0, "A code for the agent at the door"), "advisory": _signal(-1.0, "It warns"),
        "no_pressure": _signal(-0.5, "Nothing presses"), "in_person": _signal(-0.8, "It asks to come in person"), "nothing_asked": _signal(-0.8, "Nothing was asked"),
        "pattern_match": {"weight": 1.5, "hard": False, "reason": _two("It resembles a known scam: {name}", "यह एक जाने हुए धोखे जैसा है: {name_hi}")}, "classifier_flag": _signal(0.8, "The model takes it for a scam", show=False),
    },
    "lexicons": {
        "account_terms": ["account", "a/c", "acct", "card"], "action_terms": ["click", "tap", "fill", "submit"], "advance_ask": ["advance", "token amount"], "advance_fee": ["registration fee", "processing fee", "fee"],
        "advisory": ["never share", "do not share", "don't share", "beware", "bank never asks"], "authority_terms": ["police", "customs", "cbi", "court", "income tax", "electricity board"], "bank_terms": ["bank", "sbi", "hdfc"],
        "branch_visit": ["visit your branch", "nearest branch"], "bring_items": ["original documents", "id card"], "bring_verbs": ["bring", "carry"], "call_verbs": ["call", "contact", "dial"], "challan_terms": ["challan", "traffic fine"],
        "click_terms": ["click", "tap"], "code_phrases": ["verification code", "security code"], "courier_terms": ["courier", "parcel", "shipment", "package"], "customer_care_terms": ["customer care", "helpline", "helpdesk"],
        "debit_credit_terms": ["debited", "credited", "spent"], "delivery_problem": ["could not be delivered", "address incomplete"], "digital_arrest": ["digital arrest", "stay on the video call"], "disconnect_terms": ["disconnected", "cut off"],
        "donation_terms": ["donate", "donation"], "easy_money": ["work from home", "earn daily", "part time income", "no experience needed"], "electricity_terms": ["electricity", "power supply", "power"], "emergency_terms": ["accident", "hospital", "emergency"],
        "family_terms": ["mom", "dad", "son", "daughter", "brother"], "free_terms": ["free"], "handover_done": ["delivered", "handed over"], "handover_to": ["to the delivery agent", "to the driver"], "handover_when": ["at delivery", "at the door"],
        "in_person": ["in person", "appointment"], "install_terms": ["install", "download"], "investment": ["guaranteed returns", "double your money", "trading tips"], "job_terms": ["job", "vacancy", "hiring"], "join_group": ["join our group", "join telegram"],
        "kyc_terms": ["kyc", "pan", "aadhaar"], "kyc_threat_terms": ["blocked", "suspended", "expire"], "link_hiding_terms": ["remove the spaces", "copy the link"], "loan": ["instant loan", "loan approved"], "maintenance_terms": ["maintenance"],
        "mistake_terms": ["by mistake", "wrongly"], "money_send_terms": ["send money", "transfer", "urgent money"], "money_terms": ["money", "rs", "rupees", "amount"], "negations_post": ["is not", "not required"], "negations_pre": ["never", "do not", "don't", "no", "not"],
        "new_number": ["new number", "changed my number"], "no_pressure": ["no hurry", "at your convenience"], "not_in_person": ["over the phone"], "nothing_asked": ["asked for nothing", "did not ask"], "otp_terms": ["otp", "one time password"],
        "personal_info_terms": ["aadhaar number", "date of birth", "card number", "cvv"], "pin_terms": ["pin", "upi pin"], "prize": ["won", "lottery", "lucky draw", "prize"], "refund_terms": ["refund"], "remote_access": ["anydesk", "teamviewer", "screen share"],
        "return_request": ["return it", "send it back"], "scheme_terms": ["yojana", "scheme", "subsidy"], "secrecy": ["keep it secret", "tell no one"], "seized_terms": ["seized", "drugs found"], "sextortion_explicit": ["private video", "nude"],
        "sextortion_media": ["video", "photos"], "sextortion_threat": ["leak", "make it viral"], "share_verbs": ["share", "send", "tell", "give"], "sim_action": ["upgrade", "swap", "deactivate"], "sim_terms": ["sim", "esim"],
        "tax_refund_terms": ["tax refund", "itr refund"], "threat_terms": ["warrant", "legal action", "fir"], "tonight_terms": ["tonight", "today at"], "unseen_terms": ["flat", "bike", "olx"], "urgency": ["urgent", "immediately", "within 24 hours", "last chance"],
    },
    "domains": {
        "shorteners": ["bit.ly", "tinyurl.com", "cutt.ly"], "suspicious_tlds": ["xyz", "top", "club", "icu", "click"], "official_suffixes": [".gov.in", ".nic.in", ".bank.in"],
        "official_domains": ["sbi.co.in", "hdfcbank.com", "npci.org.in"], "official_numbers": ["9223766666"], "brand_tokens": ["sbi", "hdfc", "paytm", "kyc", "amazon"], "bank_tokens": ["sbi", "hdfc"],
    },
    "thresholds": {"scam": 3.0, "suspicious": 1.5, "negative_floor": -3.0},
    "categories": {
        k: {"name": _two(k.replace("_", " ")), "priority": p, "actions": {"en": ["Do not reply", "Report it"], "hi": ["जवाब न दें", "शिकायत करें"]}}
        for p, k in enumerate(["generic", "job_task", "investment", "loan_fee", "prize", "govt_scheme", "govt_payment", "courier", "electricity", "customer_care", "impersonation", "kyc", "upi_receive", "malicious_app", "otp_pin", "sextortion", "digital_arrest"])
    },
    "verdicts": {
        "scam": {"label": _two("Scam"), "headline": _two("This is a {category} scam")}, "suspicious": {"label": _two("Be careful"), "headline": _two("This may be a {category} scam")},
        "no_signs": {"label": _two("No signs"), "headline": _two("No signs were found")}, "unreadable": {"label": _two("Not checked"), "headline": _two("{language} can't be read yet")},
    },
    "no_signs": {"default_reason": _two("Nothing stood out"), "actions": {"en": ["Stay careful"], "hi": ["सावधान रहें"]}},
    "unreadable": {"reason": _two("The script isn't read yet"), "actions": {"en": ["Ask someone"], "hi": ["किसी से पूछें"]}, "scripts": {k: _two(k) for k in ("bn", "pa", "gu", "or", "ta", "te", "kn", "ml", "ur", "sat", "mni", "mr")}},
    "helplines": [{"name": "helpline", "number": "0000"}],
}


def _option(key: str, **sets: str) -> dict:
    return {"id": key, "label": _two(key), "sets": sets}


def _scheme(key: str, rule: dict, documents: list[str], **more) -> dict:
    text = _two(key.replace("_", " "))
    return {"id": key, "short": key, "family": "made up", "name": text, "what": text, "benefit": text, "documents": documents, "where": text, "counter": {"default": _two(f"Ask about {key}, {{age_phrase}}")}, "rule": rule, "sources": ["s1"]} | more


#: A synthetic pack: made-up schemes and rules.
SCHEMES: dict = {
    "pack": "synthetic-schemes", "version": "1", "date": "2026-01-01", "max_questions": 8,
    "age_phrase": {"exact": _two("aged {n}", "{n} वर्ष के")},
    "facts": {"farmer": 1, "bank_account": 1, "urban": 1, "student": 1, "widow": 1, "taxpayer": 1},
    "sources": {"s1": {"title": "made up"}},
    "questions": [
        {"id": "age", "kind": "age", "short": _two("age"), "text": _two("How old?"), "bands": [
            {"id": "child", "label": _two("child"), "range": [0, 17], "phrase": _two("a child")}, {"id": "adult", "label": _two("adult"), "range": [18, 59], "phrase": _two("an adult")},
            {"id": "senior", "label": _two("senior"), "range": [60, 120], "phrase": _two("a senior")}]},
        {"id": "work", "kind": "single", "short": _two("work"), "text": _two("Work?"), "options": [_option("farm", farmer="T", student="F"), _option("study", farmer="F", student="T"), _option("other", farmer="F", student="F"), _option("unsure", farmer="L")]},
        {"id": "place", "kind": "single", "short": _two("place"), "text": _two("Where?"), "options": [_option("town", urban="T"), _option("village", urban="F"), _option("unsure", urban="U")]},
        {"id": "account", "kind": "single", "short": _two("account"), "text": _two("Account?"), "options": [_option("yes", bank_account="T"), _option("no", bank_account="F")]},
        {"id": "more", "kind": "multi", "short": _two("more"), "text": _two("Any of these?"), "none": _two("none"), "options": [{"id": "widow", "label": _two("widow"), "fact": "widow"}, {"id": "tax", "label": _two("tax"), "fact": "taxpayer"}]},
    ],
    "schemes": [
        _scheme("farm_support", {"all": [{"fact": "farmer", "say": _two("works on a farm")}, {"not": {"fact": "taxpayer"}, "say": _two("pays no tax")}, {"fact": "bank_account", "say": _two("has an account")}]}, ["ID card (any)", "Land record"]),
        _scheme("old_age_pension", {"all": [{"age": [60, None], "say": _two("is 60 or older")}, {"any": [{"not": {"fact": "taxpayer"}}, {"fact": "widow"}]}]}, ["id card (original)", "Age proof"], benefit_now=[{"when": {"age": [80, None]}, **_two("double")}, _two("single")]),
        _scheme("student_grant", {"all": [{"age": [16, 30], "say": _two("is 16 to 30")}, {"fact": "student", "say": _two("studies")}]}, ["ID card", "Marks"]),
        _scheme("village_homes", {"all": [{"not": {"fact": "urban"}, "say": _two("lives in a village")}, {"any": [{"fact": "farmer"}, {"fact": "widow"}]}, {"age": [18, None]}]}, ["ID card"], counter={"default": _two("Ask about homes"), "check": _two("Ask whether homes are open")}),
    ],
    "actionable": {"bank_account": {"to": "T", "hint": _two("Open an account")}},
}

#: A synthetic linear model of a few buckets.
MODEL: dict = {"threshold": 0.6, "intercept": -1.0, "signal_ids": ["otp_request", "urgency", "pattern_match"], "signal_coef": [2.0, 0.5, 1.5], "text_coef": {str(k * 97 % 65536): (k % 7 - 3) / 10 for k in range(700)}}
