"""Scans that look only where a pattern can match find what the pattern finds everywhere, and leave plain words alone."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.functions import extract, text
from marlstone.queries import QUERIES

PIECES = [
    "rs", "rs.", "₹", "inr", "rupees", "रु", "रुपये", " ", "  ", "\n", "\t", "5", "500", "1,00,000", ".", ".50", " lakh", "/-", "98765", "43210", "9876543210", "+91", "91-", "0", "@", "a.b@ybl",
    "www.", "http://", "a.com", "[.]", "( dot )", " dot ", "hxxps://", "p4ypal", "0tp", "h3ll0", "-", "_", "é", " ", "९", "1.2.3.4/", ",", "x", " ", "ſ", "RS", "क़",
]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=24).map("".join)


@settings(max_examples=500, deadline=None)
@given(TEXTS)
def test_scans_find_what_patterns_find(t):
    for found, pattern in ((extract.mobile_matches, extract.MOBILE), (extract.amount_matches, extract.AMOUNT)):
        assert [m.span() for m in found(t)] == [m.span() for m in pattern.finditer(t)]
    for sign, pattern in ((extract.LINK_SIGN, extract.LINK), (extract.AT_SIGN, extract.HANDLE)):
        assert [m[0] for w in extract.words_with(sign, t) for m in pattern.finditer(w)] == [m[0] for m in pattern.finditer(t)]
    assert text.unleet(t) == text.MIXED_WORD.sub(lambda m: text.deleet(m[0]), t)


def test_only_words_with_digits_are_read_as_leet(monkeypatch):
    """Before, each word of three signs or more was looked at by Python."""
    seen, plain = [], text.deleet
    monkeypatch.setattr(text, "deleet", lambda word: seen.append(word) or plain(word))
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefg", k=6)) for _ in range(2000)]
    assert text.fold(" ".join([*words, "acc0unt", "2024"])).endswith("account 2024")
    assert seen == ["acc0unt", "2024"]


@pytest.mark.parametrize("name", ["qr_check"])
def test_rules_run_on_all_cores(spark, name):
    """orders has one row group; before, one task did all the work."""
    assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
