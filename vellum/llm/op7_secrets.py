"""Secret scan: fixed formats, and the guess cost of values that stand where a credential would.

A value after a word such as "pwd" or "login" is cut into spans so that the total guess cost (log10 of
guesses) is least; this is a dynamic program over the value's positions. Every span costs `SEGMENT` besides:
- a word costs its rank in a public vocabulary (the path is a parameter), and the choice of its capitals; words
  of the vocabulary with letters replaced by look-alike marks cost the choice of these besides;
- a date costs the number of days or years it is one of;
- a repeat is a block of up to `BLOCK` characters that stands twice or more (one character: three times); it
  costs the block's own best segmentation and the number of times. It starts at one of the first `STARTS`
  places of the run with that period, so that very long runs cost no more than their length;
- a keyboard walk of three keys or more in one direction costs its start, way and length, and starts alike;
- anything else is brute force, each character costed by the alphabet that its span uses.
Values that even the best segmentation leaves costly are secrets. A value is not read on where no way to go on
could be cheap enough, which bounds the work for long random values without changing the answer.

Defined cases: a null or empty text has no spans; every row is answered on its own, whatever its id, so that
repeated rows, null ids and empty tables come back as they are; other columns are never read. Time is linear
in the text, also with very many spans.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import math
import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

#: The base formats and least lengths, in the order in which kinds sort.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
#: Words before a credential, in any language of the corpus.
CONTEXT_KEYS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "login", "contrase", "mot de passe", "kennwort", "passwort")
CONTEXT = re.compile(r"(?:pass(?:word|wd|phrase|code|wort)?|pwd|secret|token|key|credentials?|auth|login|contraseña|mot de passe|kennwort)[\"']?[ \t]*(?::=|[:=]|->| is )[ \t]*[\"'`]?([^\s\"'`,;<>|]+)", re.I)
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
#: A value needs so many characters and so costly a best segmentation.
GUESS_LEAST, GUESS_COST = 8, 11.0
BLOCK, STARTS, CHECK_EVERY = 16, 4, 32
LONGEST_DATE = 10
SEGMENT = math.log10(2)
#: Sizes of digits, lower-case letters, upper-case letters, other ASCII, all else.
ALPHABETS = (10, 26, 26, 33, 1000)
#: Marks that stand for letters.
ALIKE = str.maketrans("4@301!$57", "aaeoiisst")
_words: dict[str, Words] = {}


class Words(dict):
    """log10 of the rank of every whole word of three letters or more, in order of the vocabulary.

    `ends` holds every end of every word, marks read as letters: where a span is not among them, no longer one is a word."""

    def __init__(self, ranked: Iterable[str]):
        super().__init__({w: math.log10(i + 2) for i, w in enumerate(ranked)})
        self.longest = max(map(len, self), default=0)
        self.ends = {plain[k:] for plain in (w.translate(ALIKE) for w in self) for k in range(len(plain))}


def word_costs(path: str) -> Words:
    if path not in _words:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        _words[path] = Words(w[:-4] for w in sorted(vocab, key=vocab.get) if w.endswith("</w>") and len(w) >= 7 and w[:-4].isalpha() and w.isascii())
    return _words[path]


def char_class(c: str) -> int:
    return 0 if c.isdigit() else (1 if c.islower() else 2) if c.isascii() and c.isalpha() else 3 if c.isascii() else 4


def char_cost(c: str) -> float:
    return math.log10(ALPHABETS[char_class(c)])


def date_cost(s: str) -> float | None:
    """Years of 1900 to 2049, and days in them, as digits with or without separators."""
    d = re.sub(r"[-/._]", "", s)
    if not d.isdigit() or not d.isascii():
        return None
    if len(d) == 4 and len(s) == 4 and 1900 <= int(d) < 2050:
        return math.log10(150)
    if len(d) != 8:
        return None
    for y, m, day in ((d[:4], d[4:6], d[6:]), (d[4:], d[2:4], d[:2]), (d[4:], d[:2], d[2:4])):
        if 1900 <= int(y) < 2050 and 1 <= int(m) <= 12 and 1 <= int(day) <= 31:
            return math.log10(150 * 366)
    return None


def _steps() -> dict[tuple[str, str], int]:
    found: dict[tuple[str, str], int] = {}
    for row in ROWS:
        for a, b in zip(row, row[1:], strict=False):
            found.setdefault((a, b), 1)
            found.setdefault((b, a), -1)
    return found


STEPS = _steps()


def word_cost(span: str, words: Words) -> float | None:
    """Cost of a span as a word: its rank, its capitals and its look-alike marks; None if it is no word."""
    low = span.lower()
    marks = 0.0
    cost = words.get(low)
    if cost is None:
        plain = low.translate(ALIKE)
        if plain == low or len(plain) != len(span) or (cost := words.get(plain)) is None:
            return None
        marks = SEGMENT * sum(x != y for x, y in zip(low, plain, strict=True))
    k, upper = len(span), sum(map(str.isupper, span))
    if not upper:
        return cost + marks
    return cost + marks + (SEGMENT if upper == k or upper == 1 and span[0].isupper() else math.log10(math.comb(k, min(upper, k - upper)) + 1))


def repeat_cost(block: str, times: int, words: Words) -> float:
    return guess_cost(block, words) + math.log10(times)


def walk_cost(length: int) -> float:
    return math.log10(47 * 4 * length)


def guess_cost(value: str, words: Words, enough: float = math.inf) -> float:
    """Least total cost of a segmentation of `value`; any number of at least `enough` where that is not less."""
    low, n = value.lower(), len(value)
    if len(low) != n:
        low = value
    plain = "".join(c.lower() if len(c.lower()) == 1 else c for c in value).translate(ALIKE)
    kinds = [1 << char_class(c) for c in value]
    used = reduce(or_, kinds, 0)
    costs = {m: math.log10(sum(a for k, a in enumerate(ALPHABETS) if m >> k & 1)) for m in range(1, used + 1) if m & used == m}
    brute = dict.fromkeys(costs, math.inf)  # of a span that ends here, by the classes its alphabet holds
    best = [0.0] + [math.inf] * n
    periods = range(1, min(BLOCK, n // 2) + 1)
    begin = dict.fromkeys(periods, 0)  # where the run with that period begins that holds the last character
    walk = way = 0  # likewise of the walk, and its direction
    blocks: dict[tuple[int, str], float] = {}
    longest = max(words.longest, LONGEST_DATE)
    for i in range(1, n + 1):
        before = best[i - 1]
        for m, cost in costs.items():
            brute[m] = min(brute[m], before) + cost if m & kinds[i - 1] else math.inf
        now = min(brute.values()) + SEGMENT
        for p in periods:
            if i > p and value[i - 1] != value[i - 1 - p]:
                begin[p] = i - p
            elif i > p:
                at = begin[p]
                for s in range(at, min(at + STARTS, i)):
                    times, rest = divmod(i - s, p)
                    if rest or times < 2 + (p == 1):
                        continue
                    block = value[s : s + p]
                    if (own := blocks.get((p, block))) is None:
                        own = blocks[p, block] = guess_cost(block, words)
                    now = min(now, best[s] + own + math.log10(times) + SEGMENT)
        if i > 1:
            step = STEPS.get((low[i - 2], low[i - 1]), 0)
            if not step:
                walk = i - 1
            elif step != way:
                walk = i - 2
            way = step
            for s in range(walk, min(walk + STARTS, i - 2)):
                now = min(now, best[s] + walk_cost(i - s) + SEGMENT)
        for k in range(1, min(i, words.longest) + 1):
            if plain[i - k : i] not in words.ends:
                break
            if k >= 3 and (cost := word_cost(value[i - k : i], words)) is not None:
                now = min(now, best[i - k] + cost + SEGMENT)
        if low[i - 1].isdigit():
            for k in (4, 8, 10):
                if k <= i and (cost := date_cost(value[i - k : i])) is not None:
                    now = min(now, best[i - k] + cost + SEGMENT)
        best[i] = now
        if i % CHECK_EVERY == 0 and i < n:
            open_runs = [best[s] for at in {*begin.values(), walk} for s in range(at, min(at + STARTS, i))]
            least = min([*best[max(0, i - longest - 2 * BLOCK) : i + 1], *brute.values(), *open_runs])
            if least >= enough:
                return least
    return best[n]


def spans_of(text: str, words: Words) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base and added spans as (start, place of kind, end)."""
    low = text.lower()
    base = []
    if any(k in low for k in ASSIGN_KEYS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    added = []
    if any(k in low for k in CONTEXT_KEYS):
        ends = list(itertools.accumulate((e for _, _, e in base), max))
        starts = [s for s, _, _ in base]
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            while b > a and text[b - 1] in ".!?:)]}":
                b -= 1
            k = bisect.bisect_left(starts, b)  # base spans that start before the value ends
            if b - a >= GUESS_LEAST and (not k or ends[k - 1] <= a) and guess_cost(text[a:b], words, GUESS_COST) >= GUESS_COST:
                added.append((a, 3, b))
    return base, added


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, vocab: str) -> DataFrame:
    def rows(words: Words, ids: list, texts: list) -> dict[str, list]:
        found = [spans_of(t or "", words) for t in texts]
        base = [b for b, _ in found]
        count = lambda k: [sum(x[1] == k for x in b) for b in base]
        return {"doc_id": ids, "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_sha256": [hashlib.sha256(listed(b).encode()).hexdigest() for b in base], "spans": [listed(b + a) for b, a in found], "n_guess": [len(a) for _, a in found], "n_secret": [len(a) + len(b) for b, a in found]}

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, n_secret long"
    return arrow_map(docs.select("doc_id", "text"), rows, schema, lambda: (word_costs(vocab),))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
