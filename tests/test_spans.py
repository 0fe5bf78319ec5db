"""The phrase automaton and the sorted indexes against plain scans with patterns, and their time on long texts."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.functions import extract
from marlstone.operators import signals, spans
from marlstone.operators.phrases import Phrases
from marlstone.sources import packs

LISTS = {
    "a": ["do not", "not share", "no", "share", "share it now"], "b": ["प्रधान", "न", "kyc अपडेट", "kyc", "मत दें"], "c": [], "d": ["don't", "a/c", "rs", "(x)"],
    "negations_pre": ["never", "do not", "नहीं", "no"], "negations_post": ["not", "is not", "मत"], "advisory": ["never share", "beware", "no no"],
}
PIECES = ["do", "not", "share", "no", "now", "it", "never", "beware", "don't", "a/c", "rs", "(x)", "kyc", "अपडेट", "प्रधान", "प्रधानों", "न", "मत", "दें", "नहीं", "ক", "কখ", "x", "1", " ", " ", " ", "  ", "\n", " \n", ".", ". ", "!", "।", ",", "'", "ा"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)
PATTERNS = {name: spans.Lexicon(x).pattern for name, x in LISTS.items()}
ALL = Phrases(LISTS)


class Plain:
    """A view by plain scans from the text's begin."""

    def __init__(self, text):
        self.text = text

    def seen(self, name, low, high):
        return bool(PATTERNS[name].search(self.text, low, high))

    def clause_start(self, at):
        return max((m.end() for m in spans.CLAUSE.finditer(self.text) if m.end() <= at), default=0)

    def sentence(self, span):
        start = max((m.end() for m in spans.SENTENCE.finditer(self.text, 0, span[0])), default=0)
        after = spans.SENTENCE.search(self.text, span[1])
        return start, after.start() if after else len(self.text)

    def negated(self, span):
        if self.seen("negations_pre", max(span[0] - 28, self.clause_start(span[0])), span[0]):
            return True
        stop = spans.CLAUSE.search(self.text, span[1], span[1] + 14)
        return self.seen("negations_post", span[1], stop.start() if stop else min(len(self.text), span[1] + 14))

    def unreadable(self, span):
        words = self.text[slice(*self.sentence(span))].split()
        unread = sum(bool(spans.UNREAD.search(w)) for w in words)
        return 0 < unread >= sum(bool(spans.READ.search(w)) and not spans.UNREAD.search(w) for w in words)

    def advisory(self, span):
        return self.seen("advisory", *self.sentence(span)) or self.negated(span) or self.unreadable(span)

    def negated_in_sentence(self, span):
        return self.seen("negations_pre", self.sentence(span)[0], span[0]) or self.unreadable(span)


@settings(max_examples=1500, deadline=None)
@given(TEXTS)
def test_spans_of_lists(text):
    view = spans.View(text, ALL)
    for name, pattern in PATTERNS.items():
        assert view.of(name) == ([m.span() for m in pattern.finditer(text)] if pattern else [])


@settings(max_examples=1500, deadline=None)
@given(TEXTS, st.integers(0, 60), st.integers(0, 60))
def test_windows(text, low, size):
    view, low = spans.View(text, ALL), min(low, len(text))
    high = min(low + size, len(text))
    for name, pattern in PATTERNS.items():
        if pattern:
            assert view.seen(name, low, high) == bool(pattern.search(text, low, high)), (name, low, high)


@settings(max_examples=1500, deadline=None)
@given(TEXTS, st.integers(0, 60), st.integers(0, 12))
def test_scopes(text, low, size):
    low = min(low, len(text))
    span = low, min(low + size, len(text))
    view, plain = spans.View(text, ALL), Plain(text)
    for what in ("sentence", "negated", "unreadable", "advisory", "negated_in_sentence"):
        assert getattr(view, what)(span) == getattr(plain, what)(span), what
    assert view.clause_start(span[0]) == plain.clause_start(span[0])


@settings(max_examples=500, deadline=None)
@given(TEXTS, st.lists(st.integers(0, 60), max_size=8))
def test_patterns_in_sentences(text, lows):
    view, plain = spans.View(text, ALL), Plain(text)
    for low in lows:
        span = min(low, len(text)), min(low + 2, len(text))
        for pattern in (PATTERNS["a"], PATTERNS["b"]):
            assert view.in_sentence(pattern, span) == bool(pattern.search(text, *plain.sentence(span)))


SPAN = st.tuples(st.integers(0, 40), st.integers(0, 9)).map(lambda x: (x[0], x[0] + x[1]))


@settings(max_examples=500, deadline=None)
@given(st.lists(SPAN, max_size=8), st.lists(SPAN, max_size=8), st.integers(0, 12))
def test_index(xs, ys, window):
    index = spans.Index(ys)
    for x in xs:
        assert index.near(x, window) == any(spans.gap(x, y) <= window for y in ys)
        assert index.around(x) == any(a <= x[0] and x[1] <= b for a, b in ys)
    assert spans.near(xs, ys, window) == any(spans.gap(x, y) <= window for x in xs for y in ys)


def plain_risk(text):
    asked, bare = [0.0], [0.0]
    for m in extract.AMOUNT.finditer(text):
        start = max((b.end() for b in extract.STOP.finditer(text, 0, m.start())), default=0)
        after = extract.STOP.search(text, m.end())
        window = start, after.start() if after else len(text)
        cues = [(max(m.start() - c.end(), c.start() - m.end(), 0), kind) for kind, cue in enumerate((extract.PAY, extract.BAIT)) for c in cue.finditer(text, *window)]
        if not cues:
            bare.append(extract._value(m))
        elif min(cues)[1] == 0:
            asked.append(extract._value(m))
    return max(asked) if len(asked) > 1 else max(bare)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["rs. 500", "₹20", "rs 7 lakh", "9 rupees", "pay", "won", "fee", "prize", "भेज", "इनाम", " ", " ", ". ", ".", "\n", "x", ", "]), max_size=25).map("".join))
def test_money_at_risk(text):
    assert extract.money_at_risk(text) == plain_risk(text)


ENGINE = signals.Engine(packs.SIGNALS)
PARTS = {
    "one long sentence": "please share the otp with the bank and pay rs 500 fee to kyc 9876543210 do not call ",
    "short sentences": "Share your OTP now. Pay Rs. 500 to claim the prize! Never share it? Bank.\n",
    "full stops before words": "otp .share .pay .rs5 .bank ",
    "an unread script": "দাও otp share টাকা ",
}


@pytest.mark.parametrize("kind", PARTS)
def test_linear_in_length(kind):
    """200,000 signs: all spans and scopes under a second, and near twice the time of half of them."""
    took = {}
    for n in (100_000, 200_000, 200_000):
        text = (PARTS[kind] * (n // len(PARTS[kind]) + 1))[:n].lower()
        began = time.perf_counter()
        view = spans.View(text, ENGINE.phrases)
        for name in ("share_verbs", "otp_terms", "money_terms"):
            for span in view.of(name):
                view.advisory(span)
                view.negated_in_sentence(span)
        spans.near(view.of("share_verbs"), view.of("otp_terms"), 0)
        spans.near(view.of("otp_terms"), view.of("seized_terms"), 40)
        extract.money_at_risk(text)
        took[n] = time.perf_counter() - began
    assert took[200_000] < 3.5 * took[100_000] + 0.2
    assert took[200_000] < 3


@pytest.mark.parametrize("kind", PARTS)
def test_signals_of_long_messages(kind):
    text = (PARTS[kind] * (200_000 // len(PARTS[kind]) + 1))[:200_000]
    began = time.perf_counter()
    ENGINE.run(text, None, "text")
    ENGINE.run(text, None, "call")
    assert time.perf_counter() - began < 20


def test_phrases_across_white_space():
    assert spans.View("do \n\t not", ALL).of("a") == [(0, 9)]
    assert re.compile(r"\s").match("\x1c") and spans.View("do\x1cnot", ALL).of("a") == [(0, 6)]
