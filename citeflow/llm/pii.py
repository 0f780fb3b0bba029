"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, digits next to a separator, and words
that announce an identifier. Each anchor starts a parser that expands to both sides by character class,
finds the boundaries and validates what lies between. Parsers never go back before the end of what they
have read, so a text of any length and content takes linear time, and texts without anchors take one pass.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of the base rules, then those that the method adds; spans that start together are in this order.
BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "card_in_run", "iban", "ipv6", "local_phone", "login_url", "mac", "masked_email", "passport", "profile_url", "tax_id")
PLACE = {kind: i for i, kind in enumerate(BASE + ADDED)}

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
HEX = DIGITS | frozenset("abcdefABCDEF")
ADDRESS = LETTERS | DIGITS | frozenset("-._~:/?#[]@!$&'()*+,;=%")

# Length of an international bank account number by its country (ISO 13616).
IBAN_LENGTHS = dict(
    x.split()
    for x in "AD 24,AE 23,AT 20,BE 16,BG 22,CH 21,CY 28,CZ 24,DE 22,DK 18,EE 20,ES 24,FI 18,FR 27,GB 22,GR 27,HR 21,HU 28,IE 22,IL 23,IT 27,LI 21,LT 20,LU 20,LV 21,MC 27,MT 31,NL 18,NO 15,PL 28,PT 25,RO 24,SA 24,SE 24,SI 19,SK 24,SM 27,TR 26".split(",")
)

# Words that announce an identifier, in lower case, by the parser that reads what follows.
CUES = {
    "account": "account number,account no,account #,acct no,acct #,acct:,a/c no,kontonummer,konto-nr,numéro de compte,número de cuenta,compte n°",
    "passport": "passport,reisepass,passeport,pasaporte",
    "tax_id": "ssn,social security,tax id,steuer-id,sozialversicherung",
    "local_phone": "tel:,tel.,telephone,phone,mobile,telefon,téléphone,teléfono,handy,fax",
}
# Ways to write an at-sign in words.
AT_WORDS = ("[at]", "(at)", "{at}")
# Path parts after which a web address names a person's page.
PERSON_PATHS = ("/~", "/@", "/in/", "/u/", "/user/", "/users/", "/profile/", "/people/", "/author/")

#: What may stand between an announcing word and its value.
_AFTER_CUE = re.compile(r"[ \t]{0,2}(?:(?:number|nummer|numéro|número|no|nr|num|n°|#|is|ist|est|es)(?![a-z0-9])\.?)?[ \t]{0,2}[:#=.-]?[ \t]{0,2}", re.I)
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9A-Za-z])")
_PASSPORT = re.compile(r"(?=[A-Z]{0,2}[0-9]{5})[A-Z]{0,2}[0-9]{5,9}(?![0-9A-Za-z])")
_TAX = re.compile(r"(?!000|666|9)[0-9]{3}([ -]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9A-Za-z])")
_LOCAL_PHONE = re.compile(r"\(?[0-9](?:[ ().-]{0,3}[0-9]){6,14}(?![0-9A-Za-z])")
_MASKED = re.compile(r"[ ]?([A-Za-z0-9-]{1,63}(?:[ ]?(?:\[dot\]|\(dot\)|\{dot\}|\.)[ ]?[A-Za-z0-9-]{1,63}){1,8})", re.I)
#: First digits of card numbers that are in use.
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|35|6011|65")
_MAC = re.compile(r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z:-])")


def run_left(text: str, at: int, low: int, inside: frozenset[str]) -> int:
    """Where the run of characters of ``inside`` that ends before ``at`` starts, not before ``low``."""
    while at > low and text[at - 1] in inside:
        at -= 1
    return at


def run_right(text: str, at: int, inside: frozenset[str], high: int | None = None) -> int:
    """Where the run of characters of ``inside`` from ``at`` ends."""
    high = len(text) if high is None else min(high, len(text))
    while at < high and text[at] in inside:
        at += 1
    return at


def host_end(text: str, at: int) -> int | None:
    """The end of labels joined by single dots, two at least, from ``at``; None without."""
    end = run_right(text, at, LABEL)
    labels = int(end > at)
    while labels and end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end = run_right(text, end + 1, LABEL)
        labels += 1
    return end if labels > 1 else None


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def iban_valid(value: str) -> bool:
    """Whether the check digits of a bank account number without spaces hold."""
    return int("".join(str(int(x, 36)) for x in value[4:] + value[:4])) % 97 == 1


def small_part(digits: str) -> bool:
    return len(digits.lstrip("0")) <= 3 and int(digits.lstrip("0") or "0") <= 255


class Reading:
    """One text while its anchors are read: what each base rule has consumed, and the spans found."""

    def __init__(self, text: str):
        self.text, self.done = text, dict.fromkeys(BASE, 0)
        self.base: list[tuple[int, int, str]] = []
        self.added: list[tuple[int, int, str]] = []

    # --- base rules: each consumes the leftmost match, then looks on behind it ---

    def email(self, start: int, end: int) -> None:
        """A local part up to the at-sign at ``start`` and a host of two labels or more behind it."""
        first = run_left(self.text, start, self.done["email"], LOCAL)
        stop = host_end(self.text, end)
        if first < start and stop is not None:
            self.base.append((first, stop, "email"))
            self.done["email"] = stop

    def ip(self, start: int, end: int) -> None:
        """Runs of digits joined by single dots, read four at a time from the left."""
        text, low = self.text, self.done["ip"]
        if start < low:
            return
        first = run_left(text, start + 1, low, DIGITS)
        parts, at = [], first
        while True:
            stop = run_right(text, at, DIGITS)
            parts.append((at, stop))
            if stop + 1 < len(text) and text[stop] == "." and text[stop + 1] in DIGITS:
                at = stop + 1
            else:
                break
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(small_part(text[a:b]) for a, b in four):
                self.base.append((four[0][0], four[-1][1], "ip"))
        self.done["ip"] = parts[-1][1]

    def card(self, start: int, end: int) -> None:
        """Digits with single spaces or hyphens between them, 14 to 19, whose check digit holds."""
        text, low = self.text, self.done["card"]
        if start < low:
            return
        # The run's first digits may precede the anchor only as part of an earlier anchor, which had been read.
        at = start
        while at + 1 < len(text):
            if text[at + 1] in DIGITS:
                at += 1
            elif text[at + 1] in " -" and at + 2 < len(text) and text[at + 2] in DIGITS:
                at += 2
            else:
                break
        self.done["card"] = at + 1
        if 14 <= at + 1 - start <= 37:
            digits = text[start : at + 1].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                self.base.append((start, at + 1, "card"))
                return
        # A run that is no card number as a whole may have one between its separators.
        group = start
        while group <= at:
            stop = run_right(text, group, DIGITS, at + 1)
            if stop - group < at + 1 - start and 14 <= stop - group <= 19 and _ISSUER.match(text, group) and luhn(text[group:stop]):
                self.add(group, stop, "card_in_run")
            group = stop + 1

    def phone(self, start: int, end: int) -> None:
        """A plus sign, a digit and more up to the last digit of the run, 10 to 15 digits."""
        text = self.text
        stop = run_right(text, end, PHONE)
        while stop > end and text[stop - 1] not in DIGITS:
            stop -= 1
        if stop > end + 1 and 10 <= sum(x in DIGITS for x in text[start:stop]) <= 15:
            self.base.append((start, stop, "phone"))

    # --- what the method adds ---

    def add(self, start: int, end: int, kind: str) -> None:
        self.added.append((start, end, kind))

    def announced(self, end: int, value: re.Pattern[str], kind: str) -> None:
        """A value of a given form right behind an announcing word."""
        at = _AFTER_CUE.match(self.text, end).end()
        found = value.match(self.text, at)
        if found:
            self.add(found.start(), found.end(), kind)

    def masked(self, start: int, end: int) -> None:
        """An address whose at-sign is a word in brackets."""
        text = self.text
        stop = start - 1 if start and text[start - 1] == " " else start
        first = run_left(text, stop, max(0, stop - 64), LOCAL)
        found = _MASKED.match(text, end)
        if first < stop and found:
            self.add(first, found.end(1), "masked_email")

    def web(self, start: int, end: int) -> None:
        """A web address with a user's name and secret, or of a person's page."""
        text = self.text
        if start < self.done.get("web", 0):
            return
        first = run_left(text, start, max(0, start - 16), LETTERS)
        self.done["web"] = stop = run_right(text, end, ADDRESS, end + 2048)
        while stop > end and text[stop - 1] in ".,;:!?)]'":
            stop -= 1
        if first == start or stop == end:
            return
        host, slash, path = text[end:stop].partition("/")
        user, at, _ = host.rpartition("@")
        if at and ":" in user.strip(":"):
            self.add(first, stop, "login_url")
        elif slash:
            for mark in PERSON_PATHS:
                place = ("/" + path).find(mark)
                if place >= 0 and run_right("/" + path, place + len(mark), LOCAL) > place + len(mark) + 1:
                    self.add(first, stop, "profile_url")
                    break

    def iban(self, start: int, end: int) -> None:
        """A bank account number, whole or in groups of four."""
        text = self.text
        if start and (text[start - 1] in LETTERS or text[start - 1] in DIGITS):
            return
        size, at, got = int(IBAN_LENGTHS[text[start : start + 2]]), start, []
        while at < len(text) and len(got) < size:
            if text[at] in DIGITS or "A" <= text[at] <= "Z":
                got.append(text[at])
            elif text[at] != " " or len(got) % 4 or not got:
                return
            at += 1
        if len(got) == size and not (at < len(text) and (text[at] in LETTERS or text[at] in DIGITS)) and iban_valid("".join(got)):
            self.add(start, at, "iban")

    def colons(self, start: int, end: int) -> None:
        """An address of six pairs or of eight groups of hexadecimal digits, the latter perhaps shortened."""
        text, inside = self.text, HEX | frozenset(":")
        first = run_left(text, start, max(0, start - 40), inside)
        if first and (text[first - 1] in LETTERS or text[first - 1] in DIGITS or text[first - 1] == ":"):
            return
        pairs = _MAC.match(text, first)
        if pairs:
            self.add(first, pairs.end(), "mac")
            return
        stop = run_right(text, end, inside, first + 40)
        if stop < len(text) and (text[stop] in LETTERS or text[stop] in DIGITS):
            return
        value = text[first:stop].rstrip(":") if not text[first:stop].endswith("::") else text[first:stop]
        if sum(map(bool, value.split(":"))) < 3 or not any(x in DIGITS for x in value):
            return
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return
        self.add(first, first + len(value), "ipv6")

    def spans(self) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(base spans, all spans), by start and kind. An added span that a base span covers is left out,
        as is one that starts inside an added span before it."""
        order = lambda s: (s[0], PLACE[s[2]], s[1])
        base = sorted(self.base, key=order)
        more, last = [], -1
        for span in sorted(set(self.added), key=lambda s: (s[0], -s[1], PLACE[s[2]])):
            if span[0] >= last:
                more.append(span)
                last = span[1]
        kept, i, reach = [], 0, -1
        for span in more:
            while i < len(base) and base[i][0] <= span[0]:
                reach = max(reach, base[i][1])
                i += 1
            if span[1] > reach:
                kept.append(span)
        return base, sorted(base + kept, key=order)


class Finder:
    """The automaton over all anchors, and which parser each of them starts."""

    def __init__(self):
        import ahocorasick

        self.parsers: dict[str, list[Callable[[Reading, int, int], None]]] = {}
        digits = sorted(DIGITS)
        self.on("@", Reading.email)
        self.on("://", Reading.web)
        for word in AT_WORDS:
            self.on(word, Reading.masked)
            self.on(word.upper(), Reading.masked)
        for a in digits:
            self.on(f"+{a}", Reading.phone)
            for b in digits:
                self.on(f"{a}.{b}", Reading.ip)
                for gap in ("", " ", "-"):
                    self.on(f"{a}{gap}{b}", Reading.card)
            for country in IBAN_LENGTHS:
                self.on(f"{country}{a}", Reading.iban)
        for a in sorted(HEX):
            for b in sorted(HEX | {":"}):
                self.on(f"{a}:{b}", self.first_colon)
        for kind, value in (("account", _ACCOUNT), ("passport", _PASSPORT), ("tax_id", _TAX), ("local_phone", _LOCAL_PHONE)):
            for word in CUES[kind].split(","):
                for form in {word, word.capitalize(), word.upper()}:
                    self.on(form, self.cue(value, kind))
        self.automaton = ahocorasick.Automaton()
        for anchor in self.parsers:
            self.automaton.add_word(anchor, anchor)
        self.automaton.make_automaton()

    def on(self, anchor: str, *parsers: Callable[[Reading, int, int], None]) -> None:
        self.parsers.setdefault(anchor, []).extend(parsers)

    @staticmethod
    def cue(value: re.Pattern[str], kind: str) -> Callable[[Reading, int, int], None]:
        def read(reading: Reading, start: int, end: int) -> None:
            before = reading.text[start - 1] if start else " "
            if not (before.isalnum() or before == "_"):
                reading.announced(end, value, kind)

        return read

    @staticmethod
    def first_colon(reading: Reading, start: int, end: int) -> None:
        """Reads an address from its first pair of colon and digit, as later ones belong to it."""
        if start >= reading.done.get("colons", 0):
            reading.colons(start + 1, start + 1)
            reading.done["colons"] = run_right(reading.text, start, HEX | frozenset(":"), start + 40)

    def find(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        reading = Reading(text)
        for last, anchor in self.automaton.iter(text):
            start = last + 1 - len(anchor)
            for parse in self.parsers[anchor]:
                parse(reading, start, last + 1)
        return reading.spans()


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Offsets count code points, ends are exclusive. Null text is empty and has no spans. Rows are read singly:
    repeated rows and null ids get answers of their own, an empty table an empty one, other columns are
    ignored. There is no shuffle; texts may be of any length, in linear time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    counts = [f"n_{k}" for k in BASE]
    names = [id_col, *counts, "base_sha256", "spans", "n_added"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = finder.find(text.as_py() or "")
                kinds = [k for _, _, k in base]
                rows.append((*map(kinds.count, BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string, n_added long"
    return docs.select(id_col, F.col(text_col)).mapInArrow(find, schema)
