"""Packing by shortest-pack-first over the length histogram.

1. Every document becomes token ids and an end id; it is cut into full pieces of `depth` tokens and a rest.
2. The histogram of piece lengths (at most `depth` bins, whatever the input) goes to the driver. Lengths
   are placed longest first, each into the pattern with the most room left that fits, for as many packs
   as both counts allow; packing-pattern counts are updated, not packs.
3. Patterns give, for each length, ranges of ranks with a first sequence and an offset. Pieces are ranked
   within their length (salted, so that a common length is no hot key) and looked up in those ranges.

A vocabulary whose settings are not those of `bpe.SETTINGS` is refused.

Defined cases: a null or empty text is the end id alone; repeated rows and ids are pieces of their own
(rows equal in every column are interchangeable); an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import SIMPLE, SPLIT, read_vocabulary
from .common import arrow_map, checkpointed, kept, salt, table

DEPTH = 4096
END_ID = 2
BATCH_WORDS = 2000
#: Words whose ids a worker keeps, in two generations; one just fits a table of 2^20 slots (half of 2^21, and no copy while it grows).
WORDS_HELD = 1_360_000


class Words(dict):
    """Ids (little-endian bytes) of chunks without white space, by the library's tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        read_vocabulary(path)  # words are cut at white space, which holds for the settings known there
        self.library = Tokenizer.from_file(path)
        ends = [i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self.older: dict[bytes, bytes] = {}

    def recalled(self, words: Iterable[bytes]) -> list[bytes]:
        """Those of `words`, none of them in the younger generation, that the older one lacks as well; what it holds comes back."""
        lost = []
        for w in words:
            ids = self.older.get(w)
            if ids is None:
                lost.append(w)
            else:
                self[w] = ids
        return lost

    def learn(self, words: Iterable[bytes]) -> None:
        """Add `words`, of which none is held. A word's ids are those of its pieces, as the splitter cuts it (`bpe.SPLIT`);
        pieces are encoded together and told apart at word ends. Words of other scripts go to the library one by one."""
        fresh, parts, other = {}, [], []
        for w in words:
            if w.isalpha():
                found = (w.lower(),)
            elif w[-1:] in b".,;:!?" and w[:-1].isalpha():
                found = (w[:-1].lower(), w[-1:])
            elif b"<|" in w or not SIMPLE.fullmatch(low := (text := w.decode()).lower()) or "\u0130" in text:
                other.append(w)
                continue
            else:
                found = [x.encode() for x in SPLIT.findall(low)]
            fresh.update(dict.fromkeys(found))
            if found[0] != w:
                parts.append((w, found))
        pieces = self.recalled([x for x in fresh if x not in self])
        for at in range(0, len(pieces), BATCH_WORDS):
            some = pieces[at : at + BATCH_WORDS]
            ids = self._ids(b" ".join(some))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            assert len(cuts) == len(some), "a piece without its end"
            raw, before = ids.tobytes(), 0
            for x, cut in zip(some, (cuts * 4).tolist(), strict=True):
                self[x] = raw[before:cut]
                before = cut
        for w in other:
            self[w] = self._ids(w).tobytes()
        for w, found in parts:
            self[w] = b"".join([self[x] for x in found])

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4")

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self) > WORDS_HELD // 2:
            self.older.clear()  # before the copy is made
            self.older = dict(self)
            self.clear()
        split = [t.split() for t in texts]
        found = [list(map(self.get, words)) for words in split]
        gaps = [[k for k, ids in enumerate(each) if ids is None] for each in found]
        self.learn(self.recalled({words[k] for words, gap in zip(split, gaps, strict=True) for k in gap}))
        for words, each, gap in zip(split, found, gaps, strict=True):
            for k in gap:
                each[k] = self[words[k]]
        return [b"".join(each) for each in found]


def loaded(path: str) -> Words:
    return kept(("words", path), lambda: Words(path))


def pieces(docs: DataFrame, vocab: str, depth: int = DEPTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""
    end = np.array([end_id], "<u4").tobytes()

    def rows(words: Words, ids: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        raws = [(t or "").encode() for t in texts]
        for lo in range(0, len(raws), 100):
            for i, raw in zip(ids[lo : lo + 100], words.encode(raws[lo : lo + 100]), strict=True):
                raw += end
                n = len(raw) // 4
                for at in range(0, n, depth):
                    part = raw[at * 4 : (at + depth) * 4]
                    for k, v in zip(out, (i, at, len(part) // 4, zlib.crc32(part), n), strict=True):
                        out[k].append(v)
        return out

    return arrow_map(docs.select("doc_id", "text"), rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long", lambda: (loaded(vocab),))


def shortest_pack_first(histogram: dict[int, int], depth: int = DEPTH) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packing patterns; lengths stand longest first."""
    room: dict[int, list[list]] = defaultdict(list)
    most = -1
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max((r for r, found in room.items() if found), default=-1)
            if most < length:
                room[depth - length].append([left, (length,)])
                break
            pattern = room[most][-1]
            k = min(left, pattern[0])
            pattern[0] -= k
            if not pattern[0]:
                room[most].pop()
            room[most - length].append([k, (*pattern[1], length)])
            left -= k
    return [(n, lengths) for _, found in sorted(room.items()) for n, lengths in found if n]


class Slots:
    """For each length, ranges of ranks with the sequence and offset of the first rank."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]]):
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        taken: dict[int, int] = defaultdict(int)
        base = 0
        for n, lengths in patterns:
            at = 0
            for length in lengths:
                found[length].append((taken[length], base, at))
                taken[length] += n
                at += length
            base += n
        self.by = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in found.items()}

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
        for length in np.unique(lengths):
            own = lengths == length
            first, base, at = self.by[int(length)]
            k = np.searchsorted(first, ranks[own], "right") - 1
            sequence[own], offset[own] = base[k] + ranks[own] - first[k], at[k]
        return sequence, offset


def ranked(cut: DataFrame, parts: int) -> DataFrame:
    """Adds `rank` from 0 within each length, by salted buckets: no window holds a whole common length."""
    cut = cut.withColumn("bucket", salt(F.struct("doc_id", "start"), parts))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return cut.withColumn("place", F.row_number().over(inside) - 1).join(first, ["length", "bucket"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("rank"))


def pack(docs: DataFrame, vocab: str, depth: int = DEPTH, end_id: int = END_ID, rows_a_bucket: int = 100_000) -> DataFrame:
    """Every piece with sequence_id and offset; sequences are filled from 0 without gaps."""
    cut = checkpointed(pieces(docs, vocab, depth, end_id))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = Slots(shortest_pack_first(histogram, depth))
    parts = max(16, sum(histogram.values()) // rows_a_bucket)

    def rows(ids: list, start: list, length: list, crc: list, tokens: list, rank: list) -> dict[str, list]:
        sequence, offset = slots.place(np.array(length, np.int64), np.array(rank, np.int64))
        return {"doc_id": ids, "start": start, "length": length, "ids_crc32": crc, "doc_tokens": tokens, "sequence_id": sequence.tolist(), "offset": offset.tolist()}

    return arrow_map(ranked(cut, parts), rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
