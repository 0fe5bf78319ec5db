"""Entities of a message: links, numbers, amounts, payment handles, sender kind, language and script.

Functions take folded text unless they say otherwise, and give code-point
positions where they give any.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TLD, udf

# Patterns of links, numbers, registered headers and payment handles.
LINK = re.compile(
    r"""(?:https?://|www\.)[^\s<>"'()]+"""
    r"""|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?/[^\s<>"'()]*"""
    rf"""|\b(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+{TLD}\b(?::\d{{2,5}})?(?:/[^\s<>"'()]*)?""",
    re.IGNORECASE,
)
DOTTED_QUAD = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
MOBILE = re.compile(r"(?<!\d)(?:\+?91[\s-]?|0)?([6-9]\d{4}[\s-]?\d{5})(?!\d)")
TOLL_FREE = re.compile(r"(?<!\d)(18[06]0[\s-]?\d{3}[\s-]?\d{3,4})(?!\d)")
SERIES_1600 = re.compile(r"(?<!\d)(1600\d{6})(?!\d)")
HEADER = re.compile(r"[a-z]{2}-[a-z0-9]{3,9}(?:-[pstg])?", re.IGNORECASE)
HANDLE = re.compile(r"(?<![\w.@-])([a-z0-9][a-z0-9._-]{1,255}@[a-z][a-z0-9]{1,63})(?![\w@]|\.[a-z])", re.IGNORECASE)

# Words for amounts.
UNITS = {"lakh": 1e5, "lac": 1e5, "लाख": 1e5, "crore": 1e7, "cr": 1e7, "करोड़": 1e7, "करोड": 1e7, "thousand": 1e3, "हजार": 1e3}
_NUMBER = r"(\d{1,3}(?:,\d{2,3})+|\d+)(?:\.(\d{1,2}))?"
_UNIT = "(" + "|".join(UNITS) + ")"
# The pattern of an amount, with its currency first or last.
AMOUNT = re.compile(
    rf"(?:₹|\brs\.?|\binr|\brupees?|रु\.?|रुपये|रुपए)\s?{_NUMBER}(?:\s*{_UNIT})?"
    rf"|(?<![\d.,]){_NUMBER}\s?(?:{_UNIT}\s?)?(?:rupees?\b|rs\b\.?|inr\b|रुपये|रुपए|रूपए|रूपये|रुपया|रूपया|रुपयों|/-)",
    re.IGNORECASE,
)
# Where links, handles, mobiles and amounts can be at all: a scan for these is far cheaper than trying their patterns everywhere.
LINK_SIGN = re.compile(r"\.(?=\S)|://")
AT_SIGN = re.compile("@")
BLANK = re.compile(r"\s")
FIVE_DIGITS = re.compile(r"\d{5,}")
DIGITS = re.compile(r"\d+")
CURRENCY = re.compile(r"(?:₹|\brs\.?|\binr|\brupees?|रु\.?|रुपये|रुपए)\s?\Z", re.IGNORECASE)
STOP = re.compile(r"[.!?।\n]")
# Cue words of a demand and of a bait.
PAY = re.compile(
    "(?<![a-z])(?:pay|paying|payment|send|transfer|deposit|fees?|charges?|fine|penalty|bhejo|bhejein|bhejiye|bhej|jama|bharo|bharein|bharna|shulk)(?![a-z])"
    "|भेज|जमा|भुगतान|शुल्क|फीस|जुर्माना|चार्ज"
)
BAIT = re.compile(
    "(?<![a-z])(?:won|win|winning|winner|prize|lottery|jackpot|reward|cashback|bonus|loan|limit|lucky|inaam|salary|earn|earning|income|profit|returns?)(?![a-z])"
    "|इनाम|जीत|लॉटरी|लोन|कमा|मुनाफ"
)
# Marker words of romanised Hindi, and of Marathi and Hindi.
ROMAN_HINDI = frozenset(
    "hai hain aap aapka aapke aapki kar karo karein kare ke ki ka nahi nahin mat paise paisa batao bhejo ho gaya jayega hoga kya "
    "se ko mein me abhi turant jaldi bhai beta yeh ye woh aur".split()
)
MARATHI = frozenset(
    "आहे आहेत नाही तुमचे तुमची तुमच्या तुम्ही आपले आपली आपल्या करा होईल जाईल झाले झाली आणि मध्ये साठी किंवा येथे लवकर".split()
)
HINDI = frozenset("है हैं नहीं आपका आपके आपकी करें करो में और का की के को से".split())
# Scripts that are told apart but not read, in this order.
SCRIPTS = {
    "bn": "\u0980-\u09ff", "pa": "\u0a00-\u0a7f", "gu": "\u0a80-\u0aff", "or": "\u0b00-\u0b7f", "ta": "\u0b80-\u0bff",
    "te": "\u0c00-\u0c7f", "kn": "\u0c80-\u0cff", "ml": "\u0d00-\u0d7f", "ur": "\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufeff",
    "sat": "\u1c50-\u1c7f", "mni": "\uabc0-\uabff",
}


#: A sign of one of these scripts, or of Devanagari.
TOLD_APART = re.compile("[\u0900-\u097f" + "".join(SCRIPTS.values()) + "]")


@dataclass(frozen=True)
class Link:
    raw: str
    host: str
    path: str
    is_ip: bool
    tld: str


def words_with(sign: re.Pattern, text: str) -> Iterator[str]:
    """The text's words between blanks that hold the sign. Patterns that hold it and no blank find in them what they find in the text."""
    low = 0
    while m := sign.search(text, low):
        start = m.start()
        while start > low and not text[start - 1].isspace():
            start -= 1
        end = BLANK.search(text, m.start())
        low = end.start() if end else len(text)
        yield text[start:low]


def mobile_matches(text: str) -> Iterator[re.Match]:
    """MOBILE.finditer(text): a number begins with the five digits or more of one run, or up to four signs before."""
    low = 0
    for run in FIVE_DIGITS.finditer(text):
        for start in range(max(low, run.start() - 4), run.start() + 1):
            if m := MOBILE.match(text, start):
                low = m.end()
                yield m
                break


def amount_matches(text: str) -> Iterator[re.Match]:
    """AMOUNT.finditer(text): an amount begins with a run of digits, or with the currency right before one."""
    low = 0
    while run := DIGITS.search(text, low):
        start = run.start()
        before = CURRENCY.search(text, max(low, start - 9), start)
        m = (before and AMOUNT.match(text, before.start())) or AMOUNT.match(text, start)
        low = m.end() if m else run.end()
        if m:
            yield m


def links(text: str) -> list[Link]:
    """The first link of each host, without trailing punctuation, port or leading www."""
    found: dict[str, Link] = {}
    for m in (m for word in words_with(LINK_SIGN, text) for m in LINK.finditer(word)):
        raw = m[0].rstrip(""".,;:!?)]}"'""")
        host, _, path = re.sub("^https?://", "", raw, flags=re.IGNORECASE).partition("/")
        host = host.split(":")[0].lower().removeprefix("www.")
        if host and host not in found:
            found[host] = Link(raw, host, f"/{path}" if path else "", bool(DOTTED_QUAD.fullmatch(host)), host.rpartition(".")[2])
    return list(found.values())


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdecimal())


def mobiles(text: str) -> list[str]:
    return list(dict.fromkeys(_digits(m[1]) for m in mobile_matches(text)))


def chat_numbers(found: list[Link]) -> list[str]:
    """Numbers in the paths of chat links: the last ten digits of runs of 10 to 12."""
    runs = [r for x in found if x.host in ("wa.me", "api.whatsapp.com") for r in re.findall(r"\d{10,12}", x.path)]
    return list(dict.fromkeys(r[-10:] for r in runs if r[-10] in "6789"))


def toll_free(text: str) -> list[str]:
    return [_digits(m[1]) for m in TOLL_FREE.finditer(text)]


def series_1600(text: str) -> list[str]:
    return [m[1] for m in SERIES_1600.finditer(text)]


def _value(m: re.Match) -> float:
    whole, part, unit = m.group(1, 2, 3) if m[1] else m.group(4, 5, 6)
    digits = "".join(str(unicodedata.digit(c)) for c in whole.replace(",", ""))
    return float(digits + ("." + "".join(str(unicodedata.digit(c)) for c in part) if part else "")) * UNITS.get((unit or "").lower(), 1)


def amounts(text: str) -> list[float]:
    return [_value(m) for m in amount_matches(text)]


def money_at_risk(text: str) -> float:
    """The largest amount that is asked for; else the largest without a cue; else 0.

    Each amount takes the nearest cue word of its sentence; a demand wins a tie.
    """
    asked, bare, known = [0.0], [0.0], {}
    found = list(amount_matches(text))
    stops = [m.start() for m in STOP.finditer(text)] if found else []
    for m in found:
        before, after = bisect_left(stops, m.start()), bisect_left(stops, m.end())
        window = (stops[before - 1] + 1 if before else 0, stops[after] if after < len(stops) else len(text))
        if window not in known:  # cue words are looked for once a sentence
            known[window] = [[c.span() for c in cue.finditer(text, *window)] for cue in (PAY, BAIT)]
        nearest = [_nearest(m.span(), cues) for cues in known[window]]
        if nearest == [None, None]:
            bare.append(_value(m))
        elif nearest[1] is None or (nearest[0] is not None and nearest[0] <= nearest[1]):
            asked.append(_value(m))
    return max(asked) if len(asked) > 1 else max(bare)


def _nearest(span: tuple[int, int], cues: list[tuple[int, int]]) -> int | None:
    """Signs to the nearest of spans that ascend and don't overlap: the last that begins before the span's end, or the next one."""
    k = bisect_left(cues, (span[1],))
    around = cues[max(0, k - 1) : k + 1]
    return min((max(span[0] - b, a - span[1], 0) for a, b in around), default=None)


def handles(text: str) -> list[str]:
    """Payment handles, not e-mail addresses, in lower case."""
    return list(dict.fromkeys(m[1].lower() for word in words_with(AT_SIGN, text) for m in HANDLE.finditer(word)))


def sender_kind(sender: str | None) -> str | None:
    """1600 (bank series), mobile, dlt (registered header) or other."""
    if not sender:
        return None
    plain = sender.strip()
    digits = _digits(plain)
    if len(digits) == 10 and digits.startswith("1600"):
        return "1600"
    if re.fullmatch(r"(?:91|0)?[6-9]\d{9}", digits) and not re.sub(r"[\d\s+()-]", "", plain):
        return "mobile"
    return "dlt" if HEADER.fullmatch(plain) else "other"


def language(text: str) -> str:
    """hi (mostly Devanagari), hinglish or en, of unfolded text."""
    deva, latin = len(re.findall("[\u0900-\u097f]", text)), len(re.findall("[A-Za-z]", text))
    if deva and deva >= 0.4 * (deva + latin):
        return "hi"
    words = re.findall("[a-z]+", text.lower())
    return "hinglish" if words and sum(w in ROMAN_HINDI for w in words) >= max(2, len(words) // 8) else "en"


def unread_script(text: str) -> str | None:
    """The script that a message is largely in and that isn't read; mr for Marathi; of unfolded text."""
    if not TOLD_APART.search(text):
        return None
    letters = [c for c in text if c.isalpha()]
    joined = "".join(letters)
    counts = {name: len(re.findall(f"[{span}]", joined)) for name, span in SCRIPTS.items()}
    unread = sum(counts.values())
    if unread >= 8 and unread >= 0.25 * len(letters):
        return max(counts, key=counts.__getitem__)
    words = re.findall("[\u0900-\u097f]+", text)
    marathi = sum(w in MARATHI for w in words)
    return "mr" if marathi >= 2 and marathi > sum(w in HINDI for w in words) else None


# ---------------------------------------------------------------- columns

links_col = udf(lambda t: [vars(x) for x in links(t)], "array<struct<raw:string,host:string,path:string,is_ip:boolean,tld:string>>")
amounts_col = udf(amounts, "array<double>")
money_at_risk_col = udf(money_at_risk, "double")
unread_script_col = udf(unread_script, "string")


def _where(able: Column, found: Column) -> Column:
    """found, which is an empty array where the text isn't able to have any; a null text stays null."""
    return F.when(~able, F.array().cast("array<string>")).otherwise(found)


def mobiles_col(text: Column) -> Column:
    """mobiles() in Catalyst, for ASCII digits."""
    found = _where(text.rlike(r"[6-9]\d{4}"), F.regexp_extract_all(text, F.lit(r"(?<!\d)(?:\+?91[\s-]?|0)?([6-9]\d{4}[\s-]?\d{5})(?!\d)"), F.lit(1)))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\D", "")))


def toll_free_col(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)(18[06]0[\s-]?\d{3}[\s-]?\d{3,4})(?!\d)"), F.lit(1))
    return F.transform(_where(text.contains("1800") | text.contains("1860"), found), lambda x: F.regexp_replace(x, r"\D", ""))


def series_1600_col(text: Column) -> Column:
    return _where(text.contains("1600"), F.regexp_extract_all(text, F.lit(r"(?<!\d)(1600\d{6})(?!\d)"), F.lit(1)))


def handles_col(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?<![\p{L}\p{N}_.@-])([a-z0-9][a-z0-9._-]{1,255}@[a-z][a-z0-9]{1,63})(?![\p{L}\p{N}_@]|\.[a-z])"), F.lit(1))
    found = _where(text.contains("@"), found)
    return F.array_distinct(F.transform(found, F.lower))


def sender_kind_col(sender: Column) -> Column:
    """sender_kind() in Catalyst, for ASCII digits."""
    plain = F.regexp_replace(sender, r"^\s+|\s+$", "")
    digits = F.regexp_replace(plain, r"\D", "")
    return (
        F.when(F.length(sender) == 0, F.lit(None))
        .when(digits.rlike("^1600[0-9]{6}$"), "1600")
        .when(digits.rlike("^(91|0)?[6-9][0-9]{9}$") & plain.rlike(r"^[\d\s+()-]*$"), "mobile")
        .when(plain.rlike("(?i)^[a-z]{2}-[a-z0-9]{3,9}(-[pstg])?$"), "dlt")
        .when(sender.isNotNull(), "other")
    )


def language_col(text: Column) -> Column:
    """language() in Catalyst."""
    deva, latin = F.regexp_count(text, F.lit("[\u0900-\u097f]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    marks = F.size(F.filter(words, lambda w: w.isin(sorted(ROMAN_HINDI))))
    return (
        F.when(text.isNull(), F.lit(None))
        .when((deva > 0) & (deva >= F.lit(0.4) * (deva + latin)), "hi")
        .when((F.size(words) > 0) & (marks >= F.greatest(F.lit(2), F.floor(F.size(words) / 8))), "hinglish")
        .otherwise("en")
    )
