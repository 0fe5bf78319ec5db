"""Text normalisation and Python-style string semantics.

Each operation has a plain Python form, which defines it, and an Arrow UDF.
Those that Catalyst can express have a Column form as well; it agrees with the
Python form on ASCII text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that look like Latin ones, after case folding.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "м": "m", "т": "t", "в": "b",
    "н": "h", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l", "ο": "o", "ν": "v", "α": "a", "ε": "e", "ι": "i",
    "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
# Endings that make a dotted name a link.
TLDS = (
    "com in net org xyz top online site club icu live shop info buzz click link vip rest work me co io ly gl cc tk ml ga cf gq "
    "app page biz ws to gd su ru cn support help monster cyou sbs cfd quest bond win loan cam today store space website fun pw "
    "at id gy ae be st us uk sh sbi bank gov nic fin"
).split()
# Digits read as letters inside words.
LEET = {"0": "o", "3": "e", "4": "a", "5": "s"}
# Typographic quotes.
QUOTES = {"’": "'", "‘": "'", "“": '"', "”": '"'}

NUKTA, CHANDRABINDU, ANUSVARA = "\u093c", "\u0901", "\u0902"
# The pieces below tell where a pattern can match at all, as a scan for one sign is far cheaper than trying the pattern everywhere.
SINGLE = str.maketrans({**LOOK_ALIKES, **{chr(0x966 + k): str(k) for k in range(10)}})
TLD = "(?:" + "|".join(TLDS) + ")"

# Patterns of links written apart, of words with digits for letters, and of tokens.
DEFANGED_SCHEME = re.compile(r"\bhxxp(s?)://")
DOT_IN_BRACKETS = re.compile(r"[\[({]\s*(?:\.|dot)\s*[\])}]\s*")
SPOKEN_DOT = re.compile(rf"(?<=[a-z0-9])\s+dot\s+(?={TLD}\b)")
LOOSE_DOT = re.compile(rf"(?<![a-z0-9-])(?P<name>[a-z0-9][a-z0-9-]*)\s+\.\s+(?P<end>{TLD}\b)(?P<path>/?)")
MIXED_WORD = re.compile(r"(?<![\w/.-])[a-z0-9]{3,}(?![\w/-]|\.\w)")
DEVANAGARI = re.compile("[\u0900-\u097f]")
LEET_DIGIT = re.compile("[0345]")
NOT_WORD = re.compile("[^a-z0-9]")
LONE_DOT = re.compile(r"\.(?<=\s\.)\s")
SINGLE_SIGN = re.compile("[" + "".join(map(chr, SINGLE)) + "]")
TOKEN = re.compile(r"""[^\s.,!?:;()"'/]+""")
OTHER_SCRIPT = re.compile("[\u0370-\u03ff\u0400-\u04ff]")


def _tight(m: re.Match) -> str:
    """A link whose dot stands between blanks, joined unless it may be the end of a sentence."""
    name, link_like = m["name"], m["path"] or "-" in m["name"] or any(map(str.isdigit, m["name"]))
    return f"{name}.{m['end']}{m['path']}" if link_like and re.search("[a-z]", name) else m[0]


def defang(text: str) -> str:
    """Links written so that filters miss them, as links."""
    if "hxxp" in text:
        text = DEFANGED_SCHEME.sub(r"http\1://", text)
    parts, low = [], 0
    for m in DOT_IN_BRACKETS.finditer(text):
        parts += [text[low : m.start()].rstrip(), "."]
        low = m.end()
    text = "".join(parts) + text[low:]
    if "dot" in text:
        text = SPOKEN_DOT.sub(".", text)
    return LOOSE_DOT.sub(_tight, text) if LONE_DOT.search(text) else text


def deleet(word: str) -> str:
    """Digits for letters, in a word of [a-z0-9] that is mostly letters: between two letters, or a 0 before one."""
    digits = sum(map(str.isdigit, word))
    if not 0 < digits < len(word) - digits:
        return word
    around = f" {word} "
    return "".join(
        LEET[c] if c in LEET and after.isalpha() and (before.isalpha() or (before == " " and c == "0")) else c
        for before, c, after in zip(around, word, around[2:], strict=False)
    )


def unleet(text: str) -> str:
    """deleet() of each MIXED_WORD. Only words that hold a digit that is read as a letter are looked at."""
    parts, low, at = [], 0, 0
    while m := LEET_DIGIT.search(text, at):
        start = m.start()
        while start > at and (("a" <= text[start - 1] <= "z") or ("0" <= text[start - 1] <= "9")):
            start -= 1
        end = NOT_WORD.search(text, m.end())
        at = end.start() if end else len(text)
        if word := MIXED_WORD.match(text, start):
            parts += [text[low:start], deleet(word[0])]
            low = at
    return "".join(parts) + text[low:]


def fold(text: str) -> str:
    """The form in which texts are searched: compatibility forms, case, look-alikes, digits, Hindi signs, links and leet."""
    text = unicodedata.normalize("NFKC", text).casefold()
    if SINGLE_SIGN.search(text):
        text = text.translate(SINGLE)
    if DEVANAGARI.search(text):  # only these have the sign
        text = unicodedata.normalize("NFD", text).replace(NUKTA, "")
    text = unicodedata.normalize("NFC", text).replace(CHANDRABINDU, ANUSVARA)
    for mark, plain in QUOTES.items():
        text = text.replace(mark, plain)
    if "  " in text or "\t" in text or "\u00a0" in text:
        text = re.sub("[ \t\u00a0]+", " ", text)
    return unleet(defang(text)).strip()


def mixed_script_tokens(text: str) -> list[str]:
    """Tokens that hold Latin letters beside Greek or Cyrillic ones."""
    text = unicodedata.normalize("NFKC", text)
    if not OTHER_SCRIPT.search(text):
        return []
    return [t for t in TOKEN.findall(text) if OTHER_SCRIPT.search(t) and re.search("[A-Za-z]", t)]


def fill(template: str, values: dict) -> str:
    """Every {key} of the template replaced by its value; unknown slots stay."""
    for key, value in values.items():
        template = template.replace("{" + key + "}", str(value))
    return template


def collapse_space(text: str) -> str:
    return " ".join(text.split())


def udf(function: Callable, returns: str) -> Callable[..., Column]:
    """A null-safe Arrow UDF of a function of one value; made when first used, as types need a session to be read."""

    is_struct = returns.startswith("struct<")

    def apply(column: pd.Series) -> pd.Series:
        # A struct can't be null in a frame, so it travels as a list of none or one.
        return column.map((lambda x: [y] if (y := function(x)) is not None else []) if is_struct else function, na_action="ignore")

    def column(value: Column | str) -> Column:
        return F.get(F.pandas_udf(apply, f"array<{returns}>")(value), F.lit(0)) if is_struct else F.pandas_udf(apply, returns)(value)

    return column


fold_col = udf(fold, "string")
mixed_script_col = udf(mixed_script_tokens, "array<string>")


def fold_ascii(text: Column) -> Column:
    """fold() for ASCII text without leet words or loose dots: all in Catalyst."""
    out = F.regexp_replace(F.lower(text), "[ \\t]+", " ")
    out = F.regexp_replace(out, "\\bhxxp(s?)://", "http$1://")
    out = F.regexp_replace(out, "\\s*[\\[({]\\s*(?:\\.|dot)\\s*[\\])}]\\s*", ".")
    return F.regexp_replace(out, "^\\s+|\\s+$", "")


def clip(text: Column, most: int = 4000) -> Column:
    return F.left(F.trim(text), F.lit(most))
