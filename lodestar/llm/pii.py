"""Operator 7: personal data by candidate gradient boosting.

Base detectors find emails, IP addresses, card numbers (Luhn) and phone
numbers; their spans always stay. Beside them, high-recall generators propose
overlapping spans: anything like a mail address, four numbers in a row, groups of
digits and parts of such rows, long mixed tokens. All are linear in the text and
have no upper length, and so is the test whether a base span touches a candidate. Boosted
trees alone score each candidate by its format (its checksum and the like are features, no filter) and its context, and each kind has a threshold calibrated for ``PRECISION`` on held-back
candidates. Candidates above it, best first and clear of base and better
spans, are added.

Nobody has labelled the documents, so the trees learn from planted spans, of which
it is known whether they are personal data, since ``planted`` made them: right
and obfuscated ones of each kind and look-alikes (broken checksums, dates, lists,
versions, prose with an at sign, hashes), with and without a telling word
before them, in surroundings cut from the documents. What the documents
themselves propose are examples of what is not personal data, but for candidates
that base spans touch, which can't be added, and those for which form or context
speak (``evidence``), which may be personal data. Candidates with equal features
are on one side of the split into trees and calibration.

The model is fitted on bounded samples: for each kind the ``SAMPLE_SPANS``
distinct candidates with the smallest hashes, from all documents, and as many surroundings.

Spans are code points, end exclusive. Null texts are empty. Every row gives a
row; equal ids are separate documents.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .boosting import Trees
from .scratch import Scratch, load

KINDS = ("email", "ip", "card", "phone", "secret")
SAMPLE_SPANS = 4000
PRECISION = 0.98
#: Planted texts of each kind, and trees.
PLANTED = 1500
ROUNDS = 80
#: Characters before a candidate that are its context, and after it.
BEFORE, AFTER = 24, 2

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits, as the run is always taken whole.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|\(at\)|\[at\]")

# Generators. A match can't begin inside what another try has passed, so they are linear.
_AT_SIGN = re.compile(r"\s?(?:@|\(at\)|\[at\])\s?")
_OTHER_LOCAL = re.compile(r"[\w.%+-]")
_OTHER_DOMAIN = re.compile(r"[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]+)+")
_FOUR = re.compile(r"(?<![\d.,])\d+(?:(?:[.,]|\[\.\]|\(dot\)| \. )\d+){3,}")
_NUMBERS = re.compile(r"(?<!\w)\+?\(?\d(?:[ ().-]{0,2}\d)+(?!\w)")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*\d)[A-Za-z0-9_+/-]{16,}={0,2}")
_RUN = re.compile(r"\d+")
#: Digits of a number that can be dialled or paid with.
LEAST_DIGITS, MOST_DIGITS = 7, 19
_INTRO = re.compile(r"(?i)(?:token|secret|password|passwd|api[_ -]?key|key)\s{0,3}[=:]\s{0,3}[\"']?$")
_CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|write to|contact|reach)\b\W{0,4}(?:\w+\W{1,3})?$"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|addr|address|login|ping|gateway)\b\W{0,4}(?:\w+\W{1,3})?$"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|dial|ring|sms)\b\W{0,4}(?:\w+\W{1,3})?$"),
    "secret": _INTRO,
}
_AT, _DOT = re.compile(r"\s?(?:@|\(at\)|\[at\])\s?"), re.compile(r"\s?(?:\.|\(dot\)|\[dot\])\s?")
_ADDRESS = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
#: Ten digits as 3-3-4, or a trunk zero, or the international 00, in groups.
_NATIONAL = re.compile(r"(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\(0\d{1,4}\) ?\d{2,5}(?:[ .-]\d{2,5}){1,3}|00?[1-9]\d{0,3}(?:[ .-]\d{2,5}){2,4}|0\d{1,4}(?:[ .-]\d{3,5}){1,3}")
_DATE = re.compile(r"(?:\d{4}[ .-]\d{1,2}[ .-]\d{1,2}|\d{1,2}[ .-]\d{1,2}[ .-]\d{4})(?!\d)")
_PRIVATE = re.compile(r"(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.")
_WORDS = ("token", "key", "pass", "mail", "phone", "tel", "call", "card", "ip", "address")


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isdigit())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ backwards over local characters and forwards over the domain, which is linear where a search isn't."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            found.append((start, end))
        else:
            end = max(end, at + 1)  # what lies before this sign can't begin a match with a later one
        at = text.find("@", max(at + 1, end))
    return found


def _octet(digits: str) -> bool:
    """Whether it is at most 255, however many zeros it begins with."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base detectors' spans, by kind and start."""
    if not _ANY.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_octet(p) for p in m.group().split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """From each sign that may stand for @, backwards and forwards."""
    last = 0
    for sign in _AT_SIGN.finditer(text):
        start = sign.start()
        while start > last and _OTHER_LOCAL.match(text, start - 1):
            start -= 1
        last = sign.end()
        if start < sign.start() and (domain := _OTHER_DOMAIN.match(text, last)):
            yield start, domain.end()


def _fours(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers in a row, wherever a longer row may be cut."""
    for m in _FOUR.finditer(text):
        at = [r.span() for r in _RUN.finditer(text, *m.span())]
        yield from ((at[i][0], at[i + 3][1]) for i in range(len(at) - 3))


def _numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """Groups of digits, and each row of neighbouring groups of them with as many digits as a number may have; with the number of digits."""
    for m in _NUMBERS.finditer(text):
        start = m.start()
        at = [r.span() for r in _RUN.finditer(text, *m.span())]
        for i, (first, _) in enumerate(at):
            n, head = 0, start if i == 0 else first - (text[first - 1] == "(")
            for j in range(i, len(at)):
                n += at[j][1] - at[j][0]
                if n > MOST_DIGITS:
                    break
                if n >= LEAST_DIGITS:
                    yield head, at[j][1], n


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose; spans may overlap."""
    if not _ANY.search(text):
        return []
    out = [("email", a, b) for a, b in _mails(text)]
    out += [("ip", a, b) for a, b in _fours(text)]
    out += [("card" if n >= 15 and text[a] != "+" else "phone", a, b) for a, b, n in _numbers(text)]
    return out + [("secret", *m.span()) for m in _SECRET.finditer(text)]


def _plain(kind: str, s: str) -> str:
    """A span as the base detectors would want it written."""
    if kind == "email":
        return _DOT.sub(".", _AT.sub("@", s))
    return ".".join(_RUN.findall(s)) if kind == "ip" else s


def valid(kind: str, s: str) -> bool:
    """What a span says is possible: an address, four octets, an issuer's number, a dialled number."""
    if kind == "email":
        return bool(_ADDRESS.fullmatch(_plain(kind, s)))
    if kind == "ip":
        parts = _RUN.findall(s)
        return len(parts) == 4 and len(set(filter(None, _RUN.split(s)))) == 1 and all(p.isascii() and (p == "0" or p[0] != "0") and _octet(p) for p in parts)
    digits = _digits(s)
    if kind == "card":
        return 15 <= len(digits) <= 19 and (digits[:2] in ("34", "37") if len(digits) == 15 else digits[0] in "3456") and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15 and len(set(digits)) > 2 and not _DATE.match(s) and s.count("(") == s.count(")")
    return True


def evidence(text: str, kind: str, start: int, end: int) -> bool:
    """Whether form and context speak for a span that no base detector takes."""
    s = text[start:end]
    if not valid(kind, s):
        return False
    if kind == "email" and (not re.search(r"\s", s) or re.search(r"[(\[]at[)\]].*[(\[]dot[)\]]", s)):
        return True
    if kind == "ip" and _PRIVATE.match(_plain(kind, s)):
        return True
    if kind == "card" or kind == "phone" and _NATIONAL.fullmatch(s):
        return True
    return bool(_CONTEXT[kind].search(text[max(0, start - BEFORE) : start]))


def _more(beside: str, end: int) -> float:
    """Whether a row of digits goes on beside a candidate: 2 for a digit right there, 1 for one behind a sign."""
    return 2.0 if beside and beside[end].isdigit() else float(any(c.isdigit() for c in beside))


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a span. Form is that of the span put right, so an obfuscated one is like a plain one."""
    s = text[start:end]
    n = len(s)
    share = lambda test: sum(map(test, s)) / n
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(s).values())
    before, after = text[max(0, start - BEFORE) : start].lower(), text[end : end + AFTER]
    groups = re.findall(r"\d+", s)
    sizes = [*map(len, groups)]
    return [
        float(KINDS.index(kind)), n, share(str.isdigit), share(str.isalpha), share(str.isupper), entropy, s.count("."), s.count("-") + s.count(" "), float("@" in s),
        float(s[0] == "+"), float("(" in s), len(groups), max(sizes, default=0), max((int(g) for g in groups if len(g) < 6), default=0),
        float(before[-1:] in ("", " ", "\n")), float(before[-1:] in ('"', "'")), float("=" in before[-4:] or ":" in before[-4:]), float(after[:1] in ("", " ", "\n")),
        float(after[:1] in (".", ",")), *(float(w in before) for w in _WORDS),
        float(valid(kind, s)), sum(sizes), sizes[0] if sizes else 0, sizes[-1] if sizes else 0, min(sizes, default=0), float("0" == "".join(groups)[:1]),
        int(groups[0][:6]) if groups else 0, float("[" in s), float(any(c.isspace() for c in s)), float("dot" in s), float(bool(_NATIONAL.fullmatch(s)) if kind == "phone" else 0),
        float(kind in _CONTEXT and bool(_CONTEXT[kind].search(text[max(0, start - BEFORE) : start]))), _more(before[-3:], -1), _more(after, 0), float("," in s), float("[.]" in s or " . " in s),
        float(kind == "ip" and bool(_PRIVATE.match(_plain(kind, s)))),
    ]


class Covered:
    """Where spans are, as a row of stretches apart from each other; asking takes one search in it."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        at = bisect.bisect_right(self.ends, a)
        return at < len(self.starts) and self.starts[at] < b


def planted(surroundings: list[tuple[str, str]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates in texts with one planted span each.

    A candidate is a positive if it is the planted span and that is personal data; all others are negatives, parts of it too.
    ``surroundings`` (before, after) are cut from documents.
    """
    rng = random.Random(7)
    around = surroundings or [("", "")]
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    grouped = lambda digits, sep: sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    # Each maker gives a span, whether it is personal data whatever stands before it, and whether it is after a telling word.
    def email() -> tuple[str, bool, bool]:
        host = [word() for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.3:  # prose or arithmetic, which a telling word makes an address only if its end is one
            tail = rng.choice([word(), word().capitalize(), number(2)])
            return word() + rng.choice([" @ ", "@ ", " @"]) + rng.choice([". ", "."]).join([*host, tail]), False, tail.isalpha()
        at, dot = rng.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "(dot)"), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", ".")])
        return rng.choice([word(), word() + "." + word(), word() + number(2)]) + at + dot.join([*host, rng.choice(["org", "net", "com", "de", "fr", "edu"])]), True, True

    def ip() -> tuple[str, bool, bool]:
        sep = rng.choice([",", ",", "[.]", "(dot)", " . "])
        if rng.random() < 0.4:
            n = rng.choice([3, 4, 5, 6])
            return sep.join(str(rng.choice([rng.randint(0, 40), rng.randint(0, 999), rng.randint(1900, 2030)])) for _ in range(n)), False, False
        top = rng.choice(["10", "127", "192,168", "172,16", None])
        octet = lambda: str(rng.choice([0, 1, rng.randint(0, 255), rng.randint(0, 255), rng.randint(0, 255)]))
        parts = [str(rng.randint(1, 223)), octet(), octet(), octet()] if top is None else [*top.split(","), *(octet() for _ in range(3 - top.count(",")))]
        return sep.join(parts), top is not None or sep not in (",", " . "), True

    def card() -> tuple[str, bool, bool]:
        good, n = rng.random() < 0.6, rng.choice([15, 16, 16, 16, 19])
        digits = (rng.choice(["34", "37"]) if n == 15 else rng.choice("3456") + number(1)) + number(n - 2)
        digits = next(d for k in range(10) if luhn(d := digits[:-1] + str(k)) == good)
        return grouped(digits, rng.choice([".", ". ", "  ", "- ", "--", " "] if n > 15 else ["", " ", "-", "."])), good, good

    def phone() -> tuple[str, bool, bool]:
        sep = rng.choice("-. ")
        case = rng.random()
        if case < 0.3:  # ten digits, three, three and four
            three, rest = f"{rng.randint(2, 9)}{number(2)}", f"{number(3)}{sep}{number(4)}"
            return rng.choice([f"({three}) {rest}", f"{three}{sep}{rest}", f"1{sep}{three}{sep}{rest}"]), True, True
        if case < 0.55:  # trunk zero or international prefix
            area, rest = f"0{rng.randint(1, 9)}{number(rng.randint(1, 3))}", sep.join(number(rng.randint(3, 4)) for _ in range(2))
            return rng.choice([f"({area}) {rest}", f"{area}{sep}{rest}", f"00{rng.randint(1, 99)}{sep}{number(3)}{sep}{rest}"]), True, True
        if case < 0.7:
            return rng.choice([f"{rng.randint(1900, 2030)}{sep}{rng.randint(1, 12):02}{sep}{rng.randint(1, 28):02}", f"{rng.randint(1, 28):02}{sep}{rng.randint(1, 12):02}{sep}{rng.randint(1900, 2030)}"]), False, False
        return sep.join(number(k) for k in rng.choice([(4, 4), (4, 4), (8,), (10,), (3, 3, 3), (5, 5), (2, 2, 2, 2), (1, 3, 3), (6, 2), (12,), (3, 4)])), False, True

    def secret() -> tuple[str, bool, bool]:
        letters = rng.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"])
        return "".join(rng.choices(letters, k=rng.choice([rng.randint(16, 60), rng.randint(60, 600)]))), False, True

    telling = {
        email: ("mail ", "email: ", "contact "),
        ip: ("ip ", "host: ", "server at "),
        card: ("card ", "pay with ", "card: "),
        phone: ("call ", "tel: ", "phone number ", "mobile "),
        secret: ("token = ", "password: ", "api_key=", "secret = ", "key: "),
    }
    idle = ("id ", "no. ", "version ", "page ", "on ", "sum ", "order ", "commit ", "see ")
    x, y = [], []
    for make, words in telling.items():
        for _ in range(PLANTED):
            span, alone, told = make()
            tell = rng.random() < 0.4
            quote = rng.choice(["", "", '"', "'"]) if make is secret else ""
            before, after = rng.choice(around)
            if tell or rng.random() < 0.4:
                before = f"{before[: rng.choice([0, 8, BEFORE])]} {rng.choice(words if tell else idle)}"
            elif before[-1:].isalnum():
                before += " "
            if after[:1].isalnum():
                after = " " + after
            text = f"{before}{quote}{span}{quote}{rng.choice(['', '', '.', ',']) if not quote else ''}{after}"
            at = len(before) + len(quote)
            truth = alone or tell and told
            base = Covered(base_spans(text))
            for kind, a, b in candidates(text):
                if not base.touches(a, b):
                    x.append(describe(text, kind, a, b))
                    y.append(truth and kind == KINDS[list(telling).index(make)] and (a, b) == (at, at + len(span)))
    return np.array(x, np.float64), np.array(y, float)


@dataclass
class Model:
    trees: Trees
    thresholds: dict[str, float]


def train(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Model:
    """Trees from the rows that aren't ``held``, thresholds from those that are: the lowest score from which on the precision holds, or that of the best precision."""
    trees = Trees.fit(x[~held], y[~held], rounds=ROUNDS)
    chance, kinds = trees.chance(x[held]), x[held, 0]
    thresholds = {}
    for k, kind in enumerate(KINDS):
        p, truth = chance[kinds == k], y[held][kinds == k]
        order = np.argsort(-p, kind="stable")
        precision = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        # A threshold can't part equal scores, so only the last of equal ones counts.
        ends = np.append(np.diff(p[order]) < 0, True)
        if truth.any():
            good = np.flatnonzero((precision >= min(PRECISION, precision[ends].max())) & ends)
            # Halfway to the next lower score.
            thresholds[kind] = max(float(p[order][good[-1] : good[-1] + 2].mean()), 0.5)
    return Model(trees, thresholds)


def held_back(x: np.ndarray) -> np.ndarray:
    """A third of the rows; equal rows are on one side."""
    return np.array([int.from_bytes(hashlib.blake2b(row.tobytes(), digest_size=4).digest(), "big") % 3 == 0 for row in x.astype("<f4")], bool)


SAMPLE = "kind int, h long, x binary, before string, after string"
#: Parts in which the sample of a kind is ranked first.
_PARTS = 64
#: Kind of a row that holds surroundings.
_AROUND = -1


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each kind the task's SAMPLE_SPANS distinct candidates with the smallest hashes of span and surroundings, and as many surroundings of other places."""
    kept: dict[int, dict[int, tuple]] = {}
    limits: dict[int, int] = {}

    def offer(kind: int, near: str, row) -> None:
        h = int.from_bytes(hashlib.blake2b(near.encode(), digest_size=8).digest(), "big") >> 1
        mine = kept.setdefault(kind, {})
        if h in mine or h > limits.get(kind, 1 << 63):
            return
        mine[h] = row()
        if len(mine) >= 2 * SAMPLE_SPANS:
            kept[kind] = {k: mine[k] for k in sorted(mine)[:SAMPLE_SPANS]}
            limits[kind] = max(kept[kind])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if (at := text.find(" ", zlib.crc32(text.encode()) % (len(text) + 1))) >= 0:
                near = text[max(0, at + 1 - BEFORE) : at + 1], text[at : at + AFTER]
                offer(_AROUND, "\0".join(near), lambda: (None, *near))
            base = Covered(base_spans(text))
            for kind, a, b in candidates(text):
                if not base.touches(a, b) and not evidence(text, kind, a, b):
                    near = f"{kind} {text[max(0, a - BEFORE) : a]}\0{text[a:b]}\0{text[b : b + AFTER]}"
                    offer(KINDS.index(kind), near, lambda: (np.array(describe(text, kind, a, b), "<f4").tobytes(), None, None))
    for kind, mine in kept.items():
        rows = [(kind, h, *mine[h]) for h in sorted(mine)[:SAMPLE_SPANS]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.string()))], names=["kind", "h", "x", "before", "after"])


def fit(docs: DataFrame) -> Model:
    scratch = Scratch(docs.sparkSession, "pii")
    spans = scratch.write(docs.where("text is not null").select("text").mapInArrow(_samples, SAMPLE))
    least = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy("kind", *by).orderBy("h"))).where(f"rank <= {SAMPLE_SPANS}").drop("rank")
    distinct = spans.groupBy("kind", "h").agg(F.min(F.struct("x", "before", "after")).alias("v")).withColumn("part", F.expr(f"pmod(h, {_PARTS})"))
    # Within parts of a kind first, so that no task ranks all of a frequent one.
    rows = least(scratch.write(least(distinct, "part"))).select("kind", "h", "v.*").orderBy("kind", "h").collect()
    x, y = planted([(r.before, r.after) for r in rows if r.kind == _AROUND])
    found = [np.frombuffer(r.x, "<f4") for r in rows if r.kind != _AROUND]
    if found:
        x, y = np.vstack([x, np.array(found, np.float64)]), np.append(y, np.zeros(len(found)))
    return train(x, y, held_back(x))


#: Candidates scored at once.
_CHUNK = 50_000


def _scored(model: Model, texts: list[str], base: list[list[tuple[str, int, int]]]) -> Iterator[tuple[float, int, tuple[str, int, int]]]:
    """Chance, text and span of the candidates that reach their threshold."""
    of, spans, x = [], [], []

    def selected() -> Iterator[tuple[float, int, tuple[str, int, int]]]:
        if x:
            for p, i, span in zip(model.trees.chance(np.array(x, np.float64)), of, spans):
                if p >= model.thresholds[span[0]]:
                    yield float(p), i, span
        for part in (of, spans, x):
            part.clear()

    for i, text in enumerate(texts):
        covered = Covered(base[i])
        for kind, a, b in candidates(text):
            if kind in model.thresholds and not covered.touches(a, b):
                of.append(i)
                spans.append((kind, a, b))
                x.append(describe(text, kind, a, b))
                if len(x) == _CHUNK:
                    yield from selected()
    yield from selected()


def _added(model: Model, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Selected candidates of each text: best first, longer ones before shorter ones, clear of each other."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    taken: list[list[tuple[int, int]]] = [[] for _ in texts]
    for _, i, span in sorted(_scored(model, texts, base), key=lambda c: (-c[0], c[2][1] - c[2][2], c[2])):
        at = bisect.bisect(taken[i], span[1:])
        if (at == 0 or taken[i][at - 1][1] <= span[1]) and (at == len(taken[i]) or span[2] <= taken[i][at][0]):
            taken[i].insert(at, span[1:])
            out[i].append(span)
    return out


def _order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in _order(spans))


_FOUND = pa.struct([("n", pa.list_(pa.int64())), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])


def detector(spark: SparkSession, model: Model, redact: bool = False):
    """A column function: text to (n: base spans of each kind, base_sha256, spans, redacted if asked for)."""
    shared = spark.sparkContext.broadcast(model)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = [t or "" for t in column.to_pylist()]
            base = [base_spans(t) for t in texts]
            out = []
            for text, mine, more in zip(texts, base, _added(shared.value, texts, base)):
                per = Counter(k for k, _, _ in mine)
                out.append(
                    {
                        "n": [per[k] for k in KINDS[:4]],
                        "base_sha256": hashlib.sha256(joined(mine).encode()).hexdigest(),
                        "spans": joined(mine + more),
                        "redacted": redacted(text, mine + more) if redact else None,
                    }
                )
            yield pa.array(out, _FOUND)

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "struct<n:array<bigint>,base_sha256:string,spans:string,redacted:string>")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def detect(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = docs.select("doc_id", detector(docs.sparkSession, fit(docs))("text").alias("__f"))
    return found.select("doc_id", *[F.col("__f.n")[i].alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.col("__f.base_sha256").alias("base_sha256"), F.col("__f.spans").alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(load(spark, sf_dir, "documents"))
