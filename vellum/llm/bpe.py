"""A byte-pair vocabulary with word ends, compiled into a deterministic finite-state transducer.

A word is read byte by byte. For every prefix there is one valid tokenization, and its last token fixes
the rest: it is the one token that ends there and may follow the prefix before it. Two tokens may stand
side by side when no merge crosses their border before each side is complete. A state therefore holds
only the part of the word that can still be inside a token, with the last token and the token count
(relative) at each position in it. States are interned and transitions are compiled when first used;
each transition carries the number of tokens that it adds.
"""

from __future__ import annotations

import json
import re

#: The normaliser lowers and composes, the splitter is SPLIT (for Latin letters), and the
#: vocabulary marks word ends with this suffix.
WORD_END = "</w>"
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
#: Letters whose lower case and composition need no library: Latin-1 letters and Latin Extended-A but I with dot.
LATIN = "a-zß-öø-ÿā-įı-ſ"
PLAIN = re.compile(f"[{LATIN}]+")
SIMPLE = re.compile(f"[\x00-\x7f{LATIN}]+")
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^{LATIN}0-9]+")
NO_RANK = 1 << 60
#: The settings of the vocabulary files that this module and the packer know.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
MODEL = {"type": "BPE", "end_of_word_suffix": WORD_END, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
SPECIALS = ("<|startoftext|>", "<|endoftext|>")


def read_vocabulary(path: str) -> dict:
    """The vocabulary file; one that normalises, splits or merges in another way is refused, since it would be counted wrongly."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    odd = [k for k, v in SETTINGS.items() if whole.get(k) != v] + [k for k, v in MODEL.items() if whole.get("model", {}).get(k) != v]
    if sorted(t["content"] for t in whole.get("added_tokens", ())) != sorted(SPECIALS):
        odd.append("added_tokens")
    if odd:
        raise ValueError(f"{path}: settings not known here: {', '.join(odd)}")
    return whole


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte, as byte-level vocabularies spell them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class State:
    __slots__ = ("ends", "final", "last", "lasts", "next", "suffix")

    def __init__(self, suffix: bytes, lasts: tuple, counts: tuple):
        self.suffix, self.lasts, self.ends = suffix, lasts, counts
        self.last = lasts[-1]
        self.next: dict[int, tuple[State, int]] = {}
        self.final: dict[int, tuple[int, int]] = {}


class Transducer:
    def __init__(self, path: str):
        whole = read_vocabulary(path)
        vocab, merges, letters = whole["model"]["vocab"], whole["model"]["merges"], byte_letters()
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.size = {}
        self.open: dict[bytes, int] = {}
        self.closed: dict[bytes, int] = {}
        spelled = {}
        for text, i in vocab.items():
            if text in self.special:
                continue
            end = text.endswith(WORD_END) and text != WORD_END
            try:
                spelled[i] = (bytes(letters[c] for c in (text[: -len(WORD_END)] if end else text)), end)
            except KeyError:
                continue
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.left: dict[int, list] = {}
        self.right: dict[int, list] = {}
        for i, (raw, end) in spelled.items():
            if len(raw) == 1:
                self._add(i, raw, end, [(i, NO_RANK)], [(i, NO_RANK)])
        for r, (a, b) in enumerate(pairs):
            x, y, i = vocab[a], vocab[b], vocab.get(a + b)
            if i is None or i in self.size or x not in self.size or y not in self.size or self._crossed(x, y, r):
                continue
            self._add(i, *spelled[i], [*((z, min(c, r)) for z, c in self.left[x]), (i, NO_RANK)], [*((z, min(c, r)) for z, c in self.right[y]), (i, NO_RANK)])
        self.inside = {raw[:k] for raw in [*self.open, *self.closed] for k in range(1, len(raw))}
        self.pair: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, State] = {}
        self.start = self._state(b"", (None,), (0,))
        self._library, self._path = None, path
        self.words: dict[bytes, tuple[int, ...]] = {}

    def _add(self, i: int, raw: bytes, end: bool, left: list, right: list) -> None:
        self.size[i] = len(raw)
        (self.closed if end else self.open)[raw] = i
        self.left[i], self.right[i] = left, right

    def _crossed(self, x: int, y: int, own: int) -> bool:
        """Whether a merge of rank other than `own` joins the end of x with the start of y in time."""
        for a, gone in self.right[x]:
            for b, taken in self.left[y]:
                m = self.rank.get((a, b))
                if m is not None and m != own and m < gone and m <= taken:
                    return True
        return False

    def follows(self, x: int | None, y: int) -> bool:
        if x is None:
            return True
        known = self.pair.get((x, y))
        if known is None:
            if len(self.pair) > 2_000_000:
                self.pair.clear()
            known = self.pair[x, y] = not self._crossed(x, y, -1)
        return known

    def _state(self, suffix: bytes, lasts: tuple, counts: tuple) -> State:
        key = (suffix, lasts, counts)
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = State(*key)
        return got

    def _token(self, state: State, raw: bytes, vocab: dict[bytes, int]) -> tuple[int, int]:
        """The token of `vocab` that ends after `raw` (the state's suffix and a byte), and the count added."""
        n = len(raw)
        for k in range(n, 0, -1):
            i = vocab.get(raw[n - k :])
            if i is not None and self.follows(state.lasts[n - k], i):
                return i, state.ends[n - k] + 1
        raise ValueError(f"no token ends {raw!r}")

    def step(self, state: State, byte: int) -> tuple[State, int]:
        got = state.next.get(byte)
        if got is None:
            raw = state.suffix + bytes((byte,))
            i, count = self._token(state, raw, self.open)
            lasts, counts = (*state.lasts, i), (*state.ends, count)
            cut = 0
            while cut < len(raw) and raw[cut:] not in self.inside:
                cut += 1
            got = state.next[byte] = (self._state(raw[cut:], lasts[cut:], tuple(c - count for c in counts[cut:])), count)
        return got

    def end(self, state: State, byte: int) -> tuple[int, int]:
        got = state.final.get(byte)
        if got is None:
            got = state.final[byte] = self._token(state, state.suffix + bytes((byte,)), self.closed)
        return got

    def trim(self, most: int = 400_000) -> None:
        """Forget compiled states and words beyond a bound; they are compiled again when needed."""
        if len(self.states) > most:
            self.states.clear()
            self.start = self._state(b"", (None,), (0,))
        if len(self.words) > 2 * most:
            self.words.clear()

    def count(self, piece: bytes) -> int:
        """Tokens of one piece: transitions add theirs, the last byte takes the word-end transition."""
        state, n = self.start, 0
        for byte in piece[:-1]:
            got = state.next.get(byte) or self.step(state, byte)
            state = got[0]
            n += got[1]
        return n + self.end(state, piece[-1])[1]

    def ids(self, piece: bytes) -> tuple[int, ...]:
        state, lasts = self.start, []
        for byte in piece[:-1]:
            state = (state.next.get(byte) or self.step(state, byte))[0]
            lasts.append(state.last)
        i = self.end(state, piece[-1])[0]
        out, at = [i], len(piece) - self.size[i]
        while at:
            out.append(i := lasts[at - 1])
            at -= self.size[i]
        return tuple(reversed(out))

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return self._library

    def pieces(self, chunk: bytes) -> list[bytes | int]:
        """Normalise and split a chunk without ASCII white space; special strings come as their ids."""
        text = chunk.decode("utf-8", "surrogatepass")
        if "<|" in text and len(parts := SPECIAL.split(text)) > 1:
            return [x for p in parts if p for x in ([self.special[p]] if p in self.special else self.pieces(p.encode()))]
        low = text.lower()
        if SIMPLE.fullmatch(low) and "İ" not in text:
            return [x.encode() for x in SPLIT.findall(low)]
        lib, letters = self.library(), self._letters()
        return [bytes(letters[c] for c in word) for word, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text)) if word.strip()]

    def _letters(self) -> dict[str, int]:
        if not hasattr(self, "_spelled"):
            self._spelled = byte_letters()
        return self._spelled
