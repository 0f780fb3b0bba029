"""Personal data against plain regular expressions, and what the parsers add."""

import hashlib
import random
import re
import time

import pytest

from citeflow.llm import pii

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def checksum(digits):
    total = 0
    for i, x in enumerate(reversed(digits)):
        twice = 2 * int(x)
        total += int(x) if i % 2 == 0 else twice - 9 if twice > 9 else twice
    return total % 10 == 0


def plain(text):
    out = []
    for place, (kind, rule) in enumerate(RULES.items()):
        for m in rule.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and checksum(d),
                "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), place, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def kinds(text):
    return [(text[a:b], kind) for a, b, kind in pii.Finder().find(text)[1]]


def test_base_rules_on_random_texts():
    rng, finder = random.Random(3), pii.Finder()
    alphabets = ["0123456789.", "a@b.- 1", "0189 -", "+12 ().-", "a.@1 +-:4é", "ab:12:f", "0123456789 +-.@a:/[]()"]
    for _ in range(20_000):
        some = rng.choice(alphabets)
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 60)))
        base, spans = finder.find(text)
        assert base == plain(text), text
        assert set(base) <= set(spans)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("account number: 123456789.", [("123456789", "account")]),
        ("no accountant number 12", []),
        ("DE89 3704 0044 0532 0130 00 DE88 3704 0044 0532 0130 00", [("DE89 3704 0044 0532 0130 00", "iban")]),
        ("GB82WEST12345698765432", [("GB82WEST12345698765432", "iban")]),
        ("ssn 078-05-1120 ssn 000-05-1120", [("078-05-1120", "tax_id")]),
        ("Tel: (030) 123 4567", [("(030) 123 4567", "local_phone")]),
        ("tel: +49 30 1234567890", [("+49 30 1234567890", "phone")]),
        ("https://bob:secret@host/x.", [("https://bob:secret@host/x", "login_url")]),
        ("(http://x.org/~bob/) http://x.org/about", [("http://x.org/~bob/", "profile_url")]),
        ("at 12:30:45 a::b 2001:db8::8a2e:370:7334", [("2001:db8::8a2e:370:7334", "ipv6")]),
        ("00:1B:44:11:3A:B7", [("00:1B:44:11:3A:B7", "mac")]),
        ("joe [at] mail [dot] example (dot) com", [("joe [at] mail [dot] example (dot) com", "masked_email")]),
        ("passport no. AB1234567, passport office", [("AB1234567", "passport")]),
        ("1234567890123456 4111111111111111", [("4111111111111111", "card_in_run")]),
        ("é 4111-1111-1111-1111", [("4111-1111-1111-1111", "card")]),
    ],
)
def test_what_the_parsers_add(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize("part", ["1", "1.", "a@", "+1 ", "://", "[at]", "aa:", "DE1", "tel: 1", "1 ", "@a.b", "4-"])
def test_long_texts_take_linear_time(part):
    finder, start = pii.Finder(), time.time()
    finder.find(part * 100_000)
    assert time.time() - start < 5


def test_rows(spark):
    rows = [(1, "x@y.org 10.0.0.1", "a"), (1, "x@y.org 10.0.0.1", "a"), (2, None, "b"), (3, "", "c"), (None, "+1 (212) 555-0100", "d"), (4, "é" * 200_000 + " a@b.co", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii.find_personal_data(docs).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows:
        base = plain(text or "")
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        want.append((doc_id, *([k for *_, k in base].count(x) for x in RULES), hashlib.sha256(line.encode()).hexdigest(), line))
    assert got == sorted(want, key=repr)
    assert pii.find_personal_data(docs.limit(0)).count() == 0
