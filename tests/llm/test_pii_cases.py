"""The PII model on sentences written by hand, apart from its training generator; « » mark what is personal."""

from __future__ import annotations

import re
import time

from vellum.llm import op1_pii

PERSONAL = """
Please call me back on «020 7946 0958» after six.
Her mobile is «07700 900461», she said.
Tel.: «01 23 45 67 89»
You can phone «(212) 555-0187» for details.
fax «049/8924-3310»
Telefon «0176 5550 1234» bitte abends.
llamar al «91 555 01 23» por favor
cell «650.253.0199»
My phone number: «5550134728»
Home tel «44 1632 960983»
Call «1-800-555-0199» today
The SSN on the form was «078-05-1120».
Social security «219 09 9999»
Her social security number is «457-55-5462» according to the file.
passport no. «533380006»
Passport «C01X00T47»
DNI «12345678»
driver licence number «99999999»
national id «8504 1234 567»
Ausweis L01X00T47 and «LZ6311T47»
IBAN «GB82WEST12345698765432»
IBAN: «DE89370400440532013000»
Please pay to «FR1420041010050500013M02606»
Konto «532013000»
account number «12345678901»
bank account «0532013000», Berlin
Credit card «5105 1051 0510 5100» expired
born on «04/07/1976»
Geboren am «23.11.1969» in Ulm
date of birth «1988-02-29»
dob «12-05-1991»
nacida el «15/08/1979»
Write to «anna.berg [at] posteo [dot] de» for a copy.
Contact: «j_doe(at)university.edu»
mail «kim (at) lab (dot) org» please
call «555-123-4567» or fax «555-123-9876»
phone «415 555 2671» 3
ref 2024-01-05 call «555-867-5309»
""".strip().split("\n")
HARMLESS = """
Order 48213377 shipped on 2021-03-04.
Version 10.4.2.1187 fixes the bug.
ISBN 978-3-16-148410-0 is out of print.
The total was $1,299,000 in 2019.
Between 1939-1945 the city was rebuilt.
See pages 112-118 and 204-209.
The build 20240105123456 failed.
At 12:30:45 the score was 21-14, 21-19, 21-17.
Invoice 2024-000123456 is due.
Coordinates 48.8566 2.3522 and 40.7128 74.0060.
The distance is 384400 km and the mass 5972000 units.
Chapter 12 3 4 5 6 7 8
Population 8 804 190 in 2020
Part number AB12345678 is discontinued.
Room 101, floor 12, building 2024
Results: 10 20 30 40 50 60 70 80
0.000123456 and 1.618033988
Flight LH4021 leaves 2023-12-24 at 06:45.
sum = 1234567 + 7654321
The years 1990 1991 1992 1993 were dry.
RFC 2119 and RFC 8174, 1997 and 2017.
price 199999 per 100000 pieces
ticket 884213 closed 2022/08/31
Ratio 1/1000000 and 3/4000000
Published 14.07.2015 in Rome
""".strip().split("\n")


def found(text, model):
    base = op1_pii.base_spans(text)
    return {(a, b) for _, a, b in [*base, *op1_pii.added_spans(text, base, model)]}


def test_precision_and_recall_on_hand_written_sentences():
    model = op1_pii.train()
    right = wrong = wanted = 0
    missed = []
    for line in [*PERSONAL, *HARMLESS]:
        text, want = "", set()
        for k, part in enumerate(re.split("[«»]", line)):
            if k % 2:
                want.add((len(text), len(text) + len(part)))
            text += part
        got = found(text, model)
        right, wrong, wanted = right + len(got & want), wrong + len(got - want), wanted + len(want)
        missed += [line] * (got != want)
    print(f"precision {right / (right + wrong):.2f}, recall {right / wanted:.2f} of {wanted}", *missed, sep="\n")
    assert right / (right + wrong) >= 0.85 and right / wanted >= 0.75


def test_a_value_beside_another_number_is_found():
    model = op1_pii.train()
    text = "card 4111 1111 1111 1111 phone 555-123-4567"
    assert any(text[a:b] == "555-123-4567" for a, b in found(text, model))
    text = "call 2024-01-05 555-123-4567"
    assert any(text[a:b] == "555-123-4567" for a, b in found(text, model))


def test_time_is_linear_in_spans():
    model = op1_pii.train()
    for one in ("+1 (234) 555-1234\n", "555-123-4567 ", "12 ", "a@b.c "):
        text = one * (400_000 // len(one))
        began = time.time()
        found(text, model)
        assert time.time() - began < 25, one
