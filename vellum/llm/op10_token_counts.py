"""Token counts by a compiled finite-state transducer (see `bpe`), composed over chunks.

A text is cut into chunks of about `chunk_bytes`. The state map of a chunk takes the state before it to the
state after it and the number of tokens emitted between. Chunks are mapped independently, for the states that
may stand at their border, and maps are composed pair by pair, in a tree; the map of the whole text, applied to
the start state, gives the count. A text of one chunk is the same with one map.

A border is put where normalising and splitting see no further: behind white space or between two digits, where
the only state is the start; else inside a run of letters, or of other characters, where the state is the
transducer's and the byte that waits for its successor. The states expected there come from running up to the
border from a little before it: transducers of this kind soon forget where they began. A state that was not
expected is run through the chunk when it turns up, so that the count never depends on the guess. Maps hold
states and numbers; a chunk's bytes are read from the text, never carried.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); every row is answered on its own, so
repeated rows, ids and null ids come back as they are, and an empty table gives no rows; other columns are never
read. Special strings count as one token, as the library takes them. A vocabulary with other settings is refused.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession

from .bpe import SPECIAL, State, Transducer
from .common import arrow_map, kept, table

CHUNK_BYTES = 1 << 16
#: Words whose counts a worker keeps, in two generations; characters before a border from which its expected state is found.
WORDS_HELD, RUN_UP = 1_500_000, 48
BLANK = re.compile(r"[ \t\n\r\x0b\x0c]")
#: A state inside a piece: the transducer's, and the byte that may be the piece's last. None: between pieces.
Inside = tuple[State, int] | None


class Counts(dict):
    """Tokens by chunk of text without white space, filled through the transducer."""

    def __init__(self, path: str):
        self.machine = Transducer(path)
        self.older: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        n = self.older.get(word)
        if n is None:
            low = word.lower() if b"<|" not in word else word
            n = self[low] if low != word else sum(1 if isinstance(p, int) else self.machine.count(p) for p in self.machine.pieces(word))
        self[word] = n
        return n

    def trim(self, most: int = WORDS_HELD) -> None:
        if len(self) > most // 2:
            self.older = dict(self)
            self.clear()
        self.machine.trim()


def _class(c: str) -> str:
    """Letter, number or other, for characters that no neighbour changes; empty for the rest."""
    if not c.isascii() and (unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c) or len(c.lower()) != 1 or unicodedata.category(c)[0] == "M"):
        return ""
    return {"L": "L", "N": "N"}.get(unicodedata.category(c)[0], "" if c in "'<|>" or c.isspace() else "O")


def border(text: str, at: int) -> tuple[int, bool]:
    """The first place from `at` on where the text may be cut, and whether a piece goes on across it; the end if none."""
    for k in range(max(at, 1), len(text)):
        a, b = text[k - 1], text[k]
        if a in " \t\n\r\x0b\x0c":
            return k, False
        x = _class(a)
        if x and x == _class(b) and unicodedata.is_normalized("NFC", a + b):
            if x == "N":
                return k, False
            if "'" not in text[max(0, k - 4) : k + 4] and not ("\u1100" <= b <= "\u11ff"):
                return k, True
    return len(text), False


class ChunkMap:
    """Entry state -> (exit state, tokens) of text[begin:end]; entries that were not expected are added when asked for."""

    def __init__(self, text: str, begin: int, end: int, goes_on: bool, counts: Counts, expected: list[Inside]):
        self.text, self.begin, self.end, self.goes_on, self.counts = text, begin, end, goes_on, counts
        self.known: dict[Inside, tuple[Inside, int]] = {}
        for state in expected:
            self.known[state] = self._run(state)

    def __call__(self, state: Inside) -> tuple[Inside, int]:
        if state not in self.known:
            self.known[state] = self._run(state)
        return self.known[state]

    def _run(self, state: Inside) -> tuple[Inside, int]:
        machine, raw = self.counts.machine, self.text[self.begin : self.end].encode()
        if state is None and not self.goes_on:
            return None, sum(map(self.counts.__getitem__, raw.split()))
        words, n = raw.split(), 0
        first = machine.pieces(words[0]) if words and state is not None else []
        if state is not None:
            state, n = advanced(machine, state, first[0])
            rest, words = first[1:], words[1:]
            if rest or words or not self.goes_on:
                n += machine.end(*state)[1]
                state = None
            if words or not self.goes_on:
                n += sum(1 if isinstance(p, int) else machine.count(p) for p in rest)
            elif rest:
                words = [rest]
        if not self.goes_on:
            return None, n + sum(map(self.counts.__getitem__, words))
        if words:
            last = words[-1] if isinstance(words[-1], list) else machine.pieces(words[-1])
            n += sum(map(self.counts.__getitem__, words[:-1]))
            n += sum(1 if isinstance(p, int) else machine.count(p) for p in last[:-1])
            state, m = advanced(machine, (machine.start, -1), last[-1])
            n += m
        return state, n


def advanced(machine: Transducer, state: tuple[State, int], piece: bytes) -> tuple[tuple[State, int], int]:
    """The state after the bytes of `piece`, of which the last waits, and the tokens emitted."""
    now, held = state
    n = 0
    for byte in piece:
        if held >= 0:
            got = now.next.get(held) or machine.step(now, held)
            now = got[0]
            n += got[1]
        held = byte
    return (now, held), n


class Composed:
    """The map of two neighbouring stretches."""

    def __init__(self, a: ChunkMap | Composed, b: ChunkMap | Composed):
        self.a, self.b = a, b
        self.known: dict[Inside, tuple[Inside, int]] = {}
        for state in a.known:
            self(state)

    def __call__(self, state: Inside) -> tuple[Inside, int]:
        if state not in self.known:
            between, n = self.a(state)
            after, m = self.b(between)
            self.known[state] = after, n + m
        return self.known[state]


def state_maps(text: str, counts: Counts, chunk_bytes: int) -> list[ChunkMap]:
    """The maps of a text's chunks, each made without the others."""
    maps, begin, went_on = [], 0, False
    while begin < len(text) or not maps:
        end, goes_on = border(text, begin + chunk_bytes) if begin + chunk_bytes < len(text) else (len(text), False)
        expected: list[Inside] = [None]
        if went_on:
            near = text[max(0, begin - RUN_UP) : begin]
            piece = counts.machine.pieces(BLANK.split(near)[-1].encode())[-1]
            expected = [advanced(counts.machine, (counts.machine.start, -1), piece)[0]]
        maps.append(ChunkMap(text, begin, end, goes_on, counts, expected))
        begin, went_on = end, goes_on
    return maps


def composed(maps: list) -> ChunkMap | Composed:
    """All maps composed, neighbours first: the up-sweep of a prefix scan, as deep as the logarithm of the chunks."""
    while len(maps) > 1:
        maps = [Composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def tokens_of(text: str, counts: Counts, chunk_bytes: int = CHUNK_BYTES) -> int:
    n = 0
    for k, part in enumerate(SPECIAL.split(text) if "<|" in text else (text,)):
        n += 1 if k % 2 else composed(state_maps(part, counts, chunk_bytes))(None)[1]
    return n


def compiled(path: str) -> Counts:
    return kept(("counts", path), lambda: Counts(path))


def count_tokens(docs: DataFrame, vocab: str, limit: int = 2048, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of `docs` (doc_id, text)."""

    def rows(counts: Counts, ids: list, texts: list) -> dict[str, list]:
        counts.trim()
        texts = [t or "" for t in texts]
        tokens = [tokens_of(t, counts, chunk_bytes) for t in texts]
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    return arrow_map(docs.select("doc_id", "text"), rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", lambda: (compiled(vocab),))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
