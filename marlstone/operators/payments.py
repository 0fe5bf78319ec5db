"""Payment QR payloads: links of the form upi://, their facts, what they claim, and the text to check."""

from __future__ import annotations

import math
import re
from urllib.parse import parse_qs, unquote, urlsplit

from ..functions.text import udf

PAYLOAD_MOST, TEXT_MOST, LARGE = 500, 4000, 10_000
# Words that claim money comes in, names that pose as an office, and how links begin.
RECEIVE = re.compile(
    r"receive|refund|cashback|cash\s*back|prize|reward|lottery|winning|won\b|credit(?:ed)?\b|bonus|gift|"
    r"milega|milenge|paane|पाने|मिलेगा|मिलेंगे|इनाम|कैशबैक|रिफंड|लॉटरी|जीत",
    re.IGNORECASE,
)
OFFICE = re.compile(
    r"\b(?:sbi|hdfc|icici|axis|pnb|bank|rbi|npci|police|cbi|customs|court|government|govt|sarkar|pm[\s-]?kisan|"
    r"electricity|bijli|kyc|customer\s*care|helpline|income\s*tax|uidai|aadhaar)\b",
    re.IGNORECASE,
)
LINK_START = re.compile(r"https?://|www\.", re.IGNORECASE)
# What a code does, as it is told.
TOLD = {
    "en": ("Scanning this QR and entering your UPI PIN sends money from your account to {who}{amount}. A QR never brings money in.",
           'It says "{name}", but the money goes to the UPI ID {payee}. Banks, police and the government do not collect money by QR.'),
    "hi": ("इस QR को स्कैन करके UPI PIN डालने पर पैसे आपके खाते से {who} को जाते हैं{amount}। QR से पैसे कभी आते नहीं।",
           'नाम "{name}" लिखा है, पर पैसे UPI ID {payee} में जाएँगे। बैंक, पुलिस या सरकार QR से पैसे नहीं माँगते।'),
}
CLAIM_TEXT = "Scan the QR and enter your UPI PIN to receive money. {note} {name}"
PAY_TEXT = "Pay {amount} to {name} ({payee}). {note}"


def rupees(amount: float) -> str:
    """₹ and the whole rupees, from a lakh on in Indian groups, else in threes; paise if the amount isn't whole.

    Paise are the rounded amount's last two digits as Python's % gives them, so those of -0.25 are 75.
    """
    if not math.isfinite(amount):
        raise ValueError("amount must be finite")
    whole = int(amount)
    text = f"{whole:,}"
    if whole >= 100_000:
        head, tail = str(whole)[:-3], str(whole)[-3:]
        text = ",".join([*[head[max(0, k - 2) : k] for k in range(len(head), 0, -2)][::-1], tail])
    return f"₹{text}" + (f".{round(amount * 100) % 100:02d}" if amount != whole else "")


def parse(payload: str) -> dict | None:
    """Action, payee, name, amount, currency, note and merchant code of a upi:// link; None for others and for broken ones.

    Keys are told in lower case, a later spelling over an earlier one; the
    first value of a key counts and is decoded once more, as phones do.
    """
    if not payload.lower().startswith("upi://"):
        return None
    try:
        parts = urlsplit(payload)
    except ValueError:
        return None
    fields = {k.lower(): unquote(v[0]).strip() for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    try:
        amount = round(float(fields["am"]), 2)
    except (KeyError, ValueError, OverflowError):
        amount = None
    if amount is not None and not math.isfinite(amount):
        amount = None
    return {
        "action": (parts.netloc or "pay").lower(), "payee": fields.get("pa", ""), "name": fields.get("pn", ""), "amount": amount,
        "currency": fields.get("cu") or "INR", "note": fields.get("tn", ""), "merchant_code": fields.get("mc", ""),
    }


def analyse(payload: str) -> dict:
    """Kind (upi, link or text), fields, facts to tell, flags and the sentence to run the message check on.

    An amount of 0 counts as none.
    """
    found = parse(payload)
    out = {"payload": payload[:PAYLOAD_MOST], "kind": "text", "check_text": payload[:TEXT_MOST], "flags": [], "facts": [], "amount_text": None, "payee": None, "name": None, "note": None}
    if found is None:
        return out | {"kind": "link" if LINK_START.match(payload) else "text"}
    name, payee, note = found["name"], found["payee"], found["note"]
    money = rupees(found["amount"]) if found["amount"] else None
    claim, posing = bool(RECEIVE.search(f"{note} {name}")), bool(OFFICE.search(name)) and not found["merchant_code"]
    flags = [f for f, on in (("receive_claim", claim), ("official_name", posing), ("large_amount", (found["amount"] or 0) >= LARGE)) if on]
    slots = {"who": name or payee or "someone", "amount": f" ({money})" if money else "", "name": name, "payee": payee}
    facts = [{lang: TOLD[lang][k].format(**slots) for lang in TOLD} for k, on in enumerate((True, posing)) if on]
    text = CLAIM_TEXT.format(note=note, name=name) if claim else PAY_TEXT.format(amount=money or "money", name=name, payee=payee, note=note)
    return out | {"kind": "upi", "flags": flags, "facts": facts, "amount_text": money, "payee": payee, "name": name, "note": note, "check_text": text.strip()}


parse_col = udf(parse, "struct<action:string,payee:string,name:string,amount:double,currency:string,note:string,merchant_code:string>")
analyse_col = udf(analyse, "struct<payload:string,kind:string,check_text:string,flags:array<string>,facts:array<struct<en:string,hi:string>>,amount_text:string,payee:string,name:string,note:string>")
rupees_col = udf(lambda x: rupees(x) if math.isfinite(x) else None, "string")
