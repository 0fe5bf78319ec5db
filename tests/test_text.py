import pytest

from marlstone.functions import extract, text
from marlstone.operators import classifier, payments
from marlstone.operators.spans import gap, has_code, lexicon, near


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("0TP bl0cked upd4te XX4421 covid19", "otp blocked update xx4421 covid19"), ("hxxps://Site[.]top/x", "https://site.top/x"), ("site (dot) in", "site.in"),
        ("go dot com", "go.com"), ("dlvry-in . help/pay", "dlvry-in.help/pay"), ("done . in the", "done . in the"), ("Straße ＡＢ १२३", "strasse ab 123"), ("SВI", "sbi"), ("क़ानून हँस", "कानून हंस"), ("", ""),
    ],
)
def test_fold(given, want):
    assert text.fold(given) == want
    assert text.fold(text.fold(given)) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("₹1,25,000", [125000]), ("Rs. 2.5 lakh", [250000]), ("10 हजार रुपये", [10000]), ("499/-", [499]), ("5 crore rupees", [5e7]), ("pay 100 or 200 rs", [200]), ("none", [])],
)
def test_amounts(given, want):
    assert extract.amounts(given) == want


@pytest.mark.parametrize(("given", "want"), [("+91 98765 43210", ["9876543210"]), ("09876543210", ["9876543210"]), ("1234567890", []), ("19876543210", []), ("98765-43210 and 9876543210", ["9876543210"])])
def test_mobiles(spark, given, want):
    assert extract.mobiles(given) == want
    assert spark.createDataFrame([(given,)], "t string").select(extract.mobiles_col(extract.F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("given", "want"), [("AX-HDFCBK-T", "dlt"), ("+91 98765 43210", "mobile"), ("1600123456", "1600"), ("HDFC Bank", "other"), ("", None), (None, None)])
def test_sender(spark, given, want):
    assert extract.sender_kind(given) == want
    assert spark.createDataFrame([(given,)], "t string").select(extract.sender_kind_col(extract.F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("https://www.Example.com:8080/a, and example.com/b", ["example.com"]), ("10.0.0.1/x and 10.0.0.2", ["10.0.0.1"]), ("a.b-c.co.in/x?y=1).", ["a.b-c.co.in"]), ("no link here.", [])],
)
def test_hosts(given, want):
    assert [x.host for x in extract.links(given)] == want


def test_handles_and_chat_numbers():
    assert extract.handles("Pay a.b@okbank, not a@b.com or x@ybl@z; A.B@OKBANK") == ["a.b@okbank"]
    assert extract.chat_numbers(extract.links("see https://wa.me/919876543210 now")) == ["9876543210"]


def test_money_at_risk():
    assert extract.money_at_risk("you won rs 5000. pay rs 99 now") == 99
    assert extract.money_at_risk("you won rs 5000") == 0
    assert extract.money_at_risk("rs 70 and rs 80") == 80
    assert extract.money_at_risk("") == 0


def test_language_and_scripts(spark):
    cases = {"आपका खाता": "hi", "aap ka otp batao bhai": "hinglish", "your account": "en", "": "en"}
    for given, want in cases.items():
        assert extract.language(given) == want
        assert spark.createDataFrame([(given,)], "t string").select(extract.language_col(extract.F.col("t"))).first()[0] == want
    assert extract.unread_script("আপনার অ্যাকাউন্ট বন্ধ হবে") == "bn"
    assert extract.unread_script("तुमचे खाते बंद होईल आहे") == "mr"
    assert extract.unread_script("hello") is None


def test_counts_equal_definition():
    from collections import Counter

    for given in ("", "a", "Hello, wörld 🙂 hello", "x" * 50):
        buckets, n = classifier.counts(given)
        assert dict(zip(buckets.tolist(), n.tolist(), strict=True)) == dict(Counter(map(classifier.bucket, classifier.grams(given))))


def test_murmur():
    assert classifier.murmur3(b"abc") == -1277324294 and classifier.bucket("abc") == 27654
    assert classifier.grams("hi", 3, 5) == [" hi", "hi ", " hi "]
    assert classifier.grams("abcd", 3, 5) == [" ab", "abc", "bcd", "cd ", " abc", "abcd", "bcd ", " abcd", "abcd "]


@pytest.mark.parametrize(("given", "want"), [(99999, "₹99,999"), (100000, "₹1,00,000"), (12345678, "₹1,23,45,678"), (10.5, "₹10.50"), (0, "₹0"), (999, "₹999"), (-5, "₹-5"), (-1234567.5, "₹-1,234,567.50"), (1.999, "₹1.00"), (-0.25, "₹0.75"), (100000.005, "₹1,00,000.00")])
def test_rupees(given, want):
    assert payments.rupees(given) == want


def test_rupees_refuses_infinite():
    for x in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            payments.rupees(x)


def test_parse_and_analyse():
    p = payments.parse("UPI://pay?pa=a%40b&PN=Shop%2520One&am=1_0&tn=&cu=")
    assert (p["payee"], p["name"], p["amount"], p["currency"], p["note"]) == ("a@b", "Shop One", 10.0, "INR", "")
    assert payments.parse("http://x") is None and payments.parse("upi://pay?am=abc")["amount"] is None and payments.parse("upi://[x") is None
    assert payments.analyse("upi://pay?pa=a@b&pn=X&am=4999&tn=cashback")["flags"] == ["receive_claim"]
    assert payments.analyse("upi://pay?pa=a@b&pn=SBI KYC&am=10")["flags"] == ["official_name"]
    shop = payments.analyse("upi://pay?pa=a@b&pn=Shop&am=250")
    assert shop["flags"] == [] and shop["amount_text"] == "₹250" and shop["check_text"] == "Pay ₹250 to Shop (a@b)."
    assert payments.analyse("https://x.y")["kind"] == "link" and payments.analyse("")["kind"] == "text"


def test_spans():
    word = lexicon(["Bank", "प्रधान", "न"])
    assert [m[0] for m in word.finditer("bank banking प्रधानमंत्री न पुराना")] == ["bank", "प्रधान", "न"]
    assert lexicon([]) is None and lexicon(["  "]) is None
    assert gap((0, 3), (5, 9)) == 2 and gap((0, 6), (5, 9)) == 0 and near([(0, 3)], [(5, 9)], 2) and not near([], [(0, 1)], 9)
    assert has_code("otp 482913") and not has_code("call 482913") and not has_code("xx4421") and not has_code("1930")
