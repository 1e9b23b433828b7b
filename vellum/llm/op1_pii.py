"""PII by candidate gradient boosting.

High-recall generators propose overlapping spans (runs of digits and separators, their parts between blanks,
letter-digit codes, spelled-out mail addresses). Boosted trees over format and context features score them; a
logistic calibration on examples that the trees have not seen gives probabilities, and the threshold is the
least one that reaches the asked precision there. Of overlapping spans over it the likeliest are added to the
base formats, which stay as they are. The trees are trained here, on examples made from value formats and
contexts (`examples`).

Defined cases: a null or empty text has no spans; every row is answered on its own, whatever its id, so that
repeated rows, null ids and empty tables come back as they are; other columns are never read. Time is linear in
the text, also for very long runs and very many spans; features are held for `HELD` candidates at a time.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import trees
from .common import arrow_map, table

KINDS = ("email", "ip", "card", "phone", "other")
#: The base formats. A mail address is found from its sign outwards, see `emails`.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|[\[(]at[\])]")
#: Generators of candidates.
SEPARATORS = " ().:/-"
PLAIN = LOCAL - frozenset("._%+-")
NUMBER = re.compile(r"[0-9](?:[ ().:/-]{0,2}[0-9])+")
CODE = re.compile(r"(?<![A-Z])[A-Z]{1,3}[0-9]{2}[A-Z0-9]{5,32}(?![A-Za-z0-9])")
PIECE = re.compile(r"[^ ]+")
SPELLED = re.compile(r"\s?[\[(]at[\])]\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[(]dot[\])])\s?[A-Za-z0-9-]+)+")
#: Words that make a value more or less likely to be personal, by group.
CONTEXT = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "llam"),
    "identity": ("ssn", "social", "passport", "licen", "national id", "tax id", "ausweis", "dni"),
    "bank": ("iban", "account", "bank", "konto", "cuenta", "card", "credit", "visa"),
    "birth": ("born", "birth", "dob", "geboren", "nacid", "né le"),
    "other": ("order", "version", "isbn", "price", "page", "invoice", "ref", "score", "total", "chapter", "build", "$"),
}
HINTS = [re.compile("|".join(map(re.escape, words))) for words in CONTEXT.values()]
CONTEXT_CHARS = 40
#: Parts of a run: at most so many pieces between blanks, with so many digits.
PIECES, LEAST_DIGITS, MOST_DIGITS = 5, 6, 19
HELD = 20_000
PRECISION = 0.95
_model: list[Model] = []


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether a run of digits is at most 255."""
    own = part.lstrip("0")
    return len(own) <= 3 and int(own or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    found, end = [], 0
    sign = text.find("@")
    while sign >= 0:
        a = sign
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        if a < sign and (m := DOMAIN.match(text, sign + 1)):
            end = m.end()
            found.append((a, end))
        sign = text.find("@", max(sign + 1, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(place of kind, start, end) of the base formats."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return found
    found += [(1, *m.span()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(generator, start, end); they may overlap each other and base spans."""
    for m in NUMBER.finditer(text):
        a, b = m.span()
        run = m[0]
        if len(run) >= LEAST_DIGITS and sum(map(str.isdigit, run)) >= LEAST_DIGITS:
            yield 0, _opened(text, a), b
            if " " in run:
                yield from _parts(text, run, a)
    for m in CODE.finditer(text):
        yield 1, *m.span()
    for m in SPELLED.finditer(text) if "at" in text else ():
        a = m.start()
        while a > 0 and text[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            yield 2, a, m.end()


def _opened(text: str, a: int) -> int:
    """`a`, or the place of an opening mark right before it."""
    while a > 0 and text[a - 1] in "(+":
        a -= 1
    return a


def _parts(text: str, run: str, at: int) -> Iterator[tuple[int, int, int]]:
    """The run's parts of up to `PIECES` neighbouring pieces between blanks, without the run itself."""
    pieces = [(m.start(), m.end(), sum(map(str.isdigit, m[0]))) for m in PIECE.finditer(run)]
    for i in range(len(pieces)):
        digits = 0
        for j in range(i, min(i + PIECES, len(pieces))):
            digits += pieces[j][2]
            if digits > MOST_DIGITS:
                break
            if digits >= LEAST_DIGITS and j - i + 1 < len(pieces):
                end = pieces[j][1]
                while run[end - 1] not in "0123456789":
                    end -= 1
                yield 0, _opened(text, at + pieces[i][0]), at + end


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def dated(groups: list[str]) -> bool:
    if len(groups) != 3 or any(len(g) > 4 for g in groups):
        return False
    y, m, d = groups if len(groups[0]) == 4 else (groups[2], groups[1], groups[0])
    m, d = int(m), int(d)
    return (len(y) == 4 and 1900 <= int(y) < 2030) and (1 <= m <= 12 and 1 <= d <= 31 or 1 <= d <= 12 and 1 <= m <= 31)


def features(text: str, generator: int, a: int, b: int) -> list[float]:
    own, before = text[a:b], text[max(0, a - CONTEXT_CHARS) : a].lower()
    groups = re.findall("[0-9]+", own)
    digits = "".join(groups)
    left, right = text[max(0, a - 3) : a], text[b : b + 3]
    sizes = [len(g) for g in groups[:4]] + [0] * 4
    separators = set(own) - PLAIN
    return [
        float(generator), float(len(own)), float(len(digits)), float(len(groups)), *map(float, sizes[:4]),
        float(len(separators)), float("." in separators), float("-" in separators), float("/" in separators), float(":" in separators), float("(" in own), float(own[:1] == "+"),
        float(len(digits) >= 12 and luhn(digits[:32])), float(generator == 1 and iban_ok(own)), float(dated(groups)), float(len(set(digits))),
        float(a > 0 and text[a - 1].isalnum()), float(b < len(text) and text[b].isalnum()),
        float(left[len(left.rstrip(SEPARATORS)) - 1 : len(left.rstrip(SEPARATORS))].isdigit()), float(right.lstrip(SEPARATORS)[:1].isdigit()),
        *(float(p.search(before) is not None) for p in HINTS),
    ]


def examples(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Features and truth of candidates in about `n` made sentences: values that are personal, or not, in made contexts.

    A candidate is true if it is the whole of a personal value; its parts, and runs that join it with a number
    beside it, are not.
    """
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    year, day, month = lambda: str(r.randint(1930, 2020)), lambda: f"{r.randint(1, 28):02}", lambda: f"{r.randint(1, 12):02}"
    name = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(3, 8)))

    def iban() -> str:
        country, body = r.choice(("DE", "FR", "GB", "ES", "IT", "NL")), num(r.randint(11, 23))
        check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        return f"{country}{check:02}{body}"

    def grouped(least: int, most: int) -> str:
        """Groups of digits with one separator, as telephone numbers are written."""
        sizes, mark = [r.randint(2, 4) for _ in range(r.randint(2, 5))], r.choice("  -./")
        if not least <= sum(sizes) <= most:
            return grouped(least, most)
        return mark.join(map(num, sizes))

    yes = (
        (lambda: f"{num(3)}-{num(2)}-{num(4)}", "identity", 0.6), (lambda: f"({num(3)}) {num(3)}-{num(4)}", "phone", 0.6), (lambda: f"{num(3)}-{num(3)}-{num(4)}", "phone", 0.6),
        (lambda: grouped(7, 12), "phone", 1.0), (lambda: "0" + grouped(7, 11), "phone", 1.0), (lambda: num(r.randint(8, 11)), "phone", 1.0), (iban, "bank", 0.5),
        (lambda: num(r.randint(8, 12)), "bank", 1.0), (lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}", "bank", 1.0),
        (lambda: f"{day()}{(c := r.choice('/.-'))}{month()}{c}{year()}", "birth", 1.0), (lambda: f"{year()}-{month()}-{day()}", "birth", 1.0),
        (lambda: f"{name()} [at] {name()} [dot] com", "phone", 0.1), (lambda: f"{name()}(at){name()}.org", "identity", 0.1), (lambda: r.choice("CLX") + num(8), "identity", 1.0),
        (lambda: num(r.randint(8, 11)), "identity", 1.0), (lambda: grouped(8, 12), "identity", 1.0),
    )
    no = (
        (lambda: num(r.randint(6, 20)), "other", 0.5), (lambda: num(16), "other", 0.2), (lambda: ".".join(num(r.randint(1, 3)) for _ in range(r.randint(3, 6))), "other", 0.5),
        (lambda: f"{year()}-{year()}", "other", 0.3), (lambda: f"{day()}/{month()}/{year()}", "other", 0.2), (lambda: f"{year()}-{month()}-{day()}", "other", 0.2), (lambda: f"{day()}.{month()}.{year()}", "other", 0.2),
        (lambda: " ".join(num(r.randint(1, 6)) for _ in range(r.randint(2, 6))), "other", 0.4), (lambda: "978" + num(10), "other", 0.7), (lambda: f"{num(4)}-{num(4)}-{num(4)}-{num(4)}", "other", 0.5),
        (lambda: r.choice("ABCDEFG") + num(8), "other", 0.5), (lambda: f"{num(2)}:{num(2)}:{num(2)}", "other", 0.2), (lambda: "DE" + num(20), "other", 0.4), (lambda: f"{num(3)}-{num(4)}-{num(3)}", "other", 0.4),
        (lambda: grouped(6, 14), "other", 0.5), (lambda: num(r.randint(1, 3)) + "".join("," + num(3) for _ in range(2)), "other", 0.3), (lambda: f"978-{num(1)}-{num(5)}-{num(3)}-{num(1)}", "other", 0.6),
    )
    x, y = [], []
    for _ in range(n):
        truth = r.random() < 0.5
        make, group, often = r.choice(yes if truth else no)
        value = make()
        hint = r.choice(CONTEXT[group]) if r.random() < often else ""
        before = f"{' '.join(name() for _ in range(r.randint(0, 5)))} {hint}{r.choice((' ', ': ', ' no. ', ' ', f' {name()} ', f' {name()} is '))}"
        if r.random() < 0.15:
            before += f"{r.choice(no)[0]()} "
        after = r.choice((" ", ". ", ", ", "")) + (name() if r.random() < 0.1 else "") + (f" {num(r.randint(2, 5))}" if r.random() < 0.1 else "")
        text, at = f"{before}{value}{after} {name()}", len(before)
        for g, a, b in candidates(text):
            if a < at + len(value) and at < b:
                x.append(features(text, g, a, b))
                y.append(float(truth and a == at and b == at + len(value)))
    return np.array(x), np.array(y)


@dataclass
class Model:
    boosted: trees.Boosted
    slope: float
    shift: float
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return trees.sigmoid(self.slope * self.boosted.scores(x) + self.shift)


def train(n: int = 6000, precision: float = PRECISION) -> Model:
    boosted = trees.fit(*examples(n, 1), rounds=60, depth=4, least=10)
    x, y = examples(n // 2, 2)
    z = boosted.scores(x)
    slope, shift = 1.0, 0.0
    for _ in range(25):  # Newton steps of the calibrating logistic fit
        p = trees.sigmoid(slope * z + shift)
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * z).sum(), (y - p).sum()])
        h = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        slope, shift = np.array([slope, shift]) + np.linalg.solve(h, g)
    p = trees.sigmoid(slope * z + shift)
    right = [t for t in np.linspace(0.5, 0.99, 50) if (p >= t).any() and y[p >= t].mean() >= precision]
    return Model(boosted, float(slope), float(shift), float(right[0] if right else 0.99))


def added_spans(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    """Candidates over the threshold that no base span and no likelier candidate overlaps."""
    taken: bytearray | None = None
    likely: list[tuple[float, int, int]] = []
    found = candidates(text)
    while some := list(itertools.islice(found, HELD)):
        if taken is None:
            taken = bytearray(len(text))
            for _, a, b in base:
                taken[a:b] = b"\x01" * (b - a)
        some = [c for c in some if taken.find(1, c[1], c[2]) < 0]
        if some:
            p = model.probability(np.array([features(text, *c) for c in some]))
            likely += [(-float(q), a, b) for q, (_, a, b) in zip(p, some, strict=True) if q >= model.threshold]
    kept: list[tuple[int, int, int]] = []
    for _, a, b in sorted(likely):
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\x01" * (b - a)
            kept.append((4, a, b))
    return kept


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    own = model or (_model or _model.append(train()) or _model)[0]

    def rows(ids: list, texts: list) -> dict[str, list]:
        base, more = [], []
        for t in texts:
            some = bool(t and ANY.search(t))
            base.append(sorted(base_spans(t)) if some else [])
            more.append(added_spans(t, base[-1], own) if some else [])
        count = lambda k: [sum(x[0] == k for x in b) for b in base]
        return {"doc_id": ids, **{f"n_{KINDS[k]}": count(k) for k in range(4)}, "base_sha256": [hashlib.sha256(listed(b).encode()).hexdigest() for b in base], "spans": [listed(b + a) for b, a in zip(base, more, strict=True)], "n_other": [len(a) for a in more], "n_pii": [len(a) + len(b) for a, b in zip(base, more, strict=True)]}

    return arrow_map(docs.select("doc_id", "text"), rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_other long, n_pii long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
