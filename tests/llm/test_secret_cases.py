"""Guess costs against every segmentation, and the scan on values written by hand."""

from __future__ import annotations

import itertools
import math
import random
import re
import time

import public_tokenizers
import pytest

from vellum.llm import op7_secrets as op

VOCAB = public_tokenizers.path("word_bpe_49k.json")
FEW = op.Words(["the", "abc", "pass", "password", "cab", "bus"])
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")


def ways(v, s, e):
    """Costs of value[s:e] as one span, by the definitions."""
    span = v[s:e]
    sizes = {"d": 10, "l": 26, "u": 26, "m": 33, "x": 1000}
    kind = lambda c: "d" if c.isdigit() else "l" if c.isascii() and c.islower() else "u" if c.isascii() and c.isupper() else "m" if c.isascii() else "x"
    yield len(span) * math.log10(sum(sizes[k] for k in {kind(c) for c in span}))
    cost = op.word_cost(span, FEW) if len(span) >= 3 else None
    if cost is not None:
        yield cost
    cost = op.date_cost(span) if len(span) in (4, 8, 10) else None
    if cost is not None:
        yield cost
    for p in range(1, 17):
        times, rest = divmod(len(span), p)
        if not rest and times >= (3 if p == 1 else 2) and span == span[:p] * times:
            left = s
            while left > 0 and v[left - 1] == v[left - 1 + p]:
                left -= 1
            if s - left < op.STARTS:
                yield cheapest(span[:p]) + math.log10(times)
    if len(span) >= 3:
        for way in (1, -1):
            step = lambda j: way == next((w for row in ROWS for a, b in zip(row, row[1:], strict=False) for w, pair in ((1, (a, b)), (-1, (b, a))) if pair == (v[j].lower(), v[j + 1].lower())), 0)  # noqa: B023, E731
            if all(step(j) for j in range(s, e - 1)):
                left = s
                while left > 0 and step(left - 1):
                    left -= 1
                if s - left < op.STARTS:
                    yield math.log10(188 * len(span))


def cheapest(v):
    """Over all 2 ** (n - 1) segmentations."""
    found = [0.0] if not v else []
    for k in range(len(v)):
        for cuts in itertools.combinations(range(1, len(v)), k):
            ends = [0, *cuts, len(v)]
            found.append(sum(min(ways(v, a, b)) + math.log10(2) for a, b in itertools.pairwise(ends)))
    return min(found)


def test_guess_cost_is_the_least_of_all_segmentations():
    r = random.Random(2)
    values = ["abcabc", "passpass", "aaaab", "P@ss1234", "1999abc", "qwerty1", "Xabab", "caaab", "zzzqwe", "20010911", "éaab"]
    values += ["".join(r.choice("abcp1") for _ in range(r.randint(1, 8))) for _ in range(120)]
    values += ["".join(r.choice(("abc", "ab", "1", "Q", "qw", "pass", "19")) for _ in range(4))[:9] for _ in range(60)]
    for v in values:
        assert op.guess_cost(v, FEW) == pytest.approx(cheapest(v)), v
    words = op.word_costs(VOCAB)
    for v in ["".join(r.choice(("abc", "x7", "Q", "qwerty", "summer", "1999", "zz", "#k")) for _ in range(40)) for _ in range(60)]:
        whole = op.guess_cost(v, words)
        assert (op.guess_cost(v, words, op.GUESS_COST) >= op.GUESS_COST) == (whole >= op.GUESS_COST)


SECRET = "x7Gq9zT2vLpR|kV3$wq8!Zt|Zr8#mQ2x|qP0vXz7LmB2n|9fGh2KdLx0Wq|Tz5-kWq9-Lx2v|m0Nk3yW1z4rdX|B7x!qT2@zL|wJ4tHq8sYv"
PLAIN = "password|Summer2019|qwertyuiop|abcabcabcabc|Xabc123abc123abc123|letmein1|aaaaaaaaaaaaaaaa|19900101|required|changeme123|P@ssw0rd|asdfghjkl1|welcome2020|hellohellohello"


def test_hand_written_values():
    words = op.word_costs(VOCAB)
    for context in ("pwd: {}", "my login is {} ok", 'auth="{}"', "Kennwort: {}."):
        for v in SECRET.split("|"):
            assert any(context.format(v)[a:b] == v for a, _, b in op.spans_of(context.format(v), words)[1]), v
        for v in PLAIN.split("|"):
            assert not op.spans_of(context.format(v), words)[1], v


def test_time_is_linear_in_spans_and_values():
    words = op.word_costs(VOCAB)
    for text in ("pwd: x7Gq9zT2vLpR\n" * 10_000, "0123456789abcdef " * 20_000, "pwd: " + "a" * 200_000, "pwd: " + "abc" * 60_000, "pwd: " + "x7Gq9zT2vL" * 20_000, "key=" * 50_000, "password" + " " * 300_000):
        began = time.time()
        base, added = op.spans_of(text, words)
        assert time.time() - began < 25, text[:20]
        spans = sorted((a, b) for a, _, b in added)
        assert all(x[1] <= y[0] for x, y in itertools.pairwise(spans))
    assert len(re.findall("pwd", "pwd: x7Gq9zT2vLpR\n" * 10)) == len(op.spans_of("pwd: x7Gq9zT2vLpR\n" * 10, words)[1])


def test_words_are_looked_up_only_where_one_can_end(monkeypatch):
    words, seen, plain = op.word_costs(VOCAB), [], op.word_cost
    monkeypatch.setattr(op, "word_cost", lambda span, w: seen.append(span) or plain(span, w))
    for v in ("x7Gq9zT2vL" * 500, "key=" * 500, "pAssw0rd$umm3r\u212aeyİtokenΣsun1ight" * 20):
        seen.clear()
        op.guess_cost(v, words)
        assert len(seen) <= 2 * len(v), v[:20]
        spans = {v[i - k : i] for i in range(len(v) + 1) for k in range(3, min(i, words.longest) + 1)}
        assert {x for x in spans if plain(x, words) is not None} <= set(seen)
