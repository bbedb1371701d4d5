"""Fast exact byte-level BPE encoding on top of the tokenizers library.

Texts are cut into the pre-tokens of the tokenizer's pattern with array operations, each
distinct pre-token is encoded once by the library's model, and the ids are gathered.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are encoded in runs of about this many bytes.
RUN_BYTES = 1 << 21
#: Distinct pre-tokens whose ids a process keeps; later ones are encoded anew, with the same ids.
CACHE = 400_000
#: Pre-tokens of up to this many bytes are looked up by array operations, longer ones one by one.
PACKED = 15
END_ID = 2

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def _kind(cp: int) -> int:
    c = chr(cp)
    if c.isspace() and not 0x1C <= cp <= 0x1F:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)


_ASCII = np.array([_kind(i) for i in range(128)], np.uint8)
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _byte_letters() -> dict[int, str]:
    """The visible letter by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


class PackedSlots:
    """A hash table from short byte strings to 0, 1, 2..., probed for many at a time.

    A string of up to PACKED bytes and its length fill two 64-bit numbers, which are compared whole, so no two are mixed up.
    """

    def __init__(self, size: int = 1 << 12):
        self.n = 0
        self.low, self.high = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.table = np.full(2 * size, -1, np.int32)

    @staticmethod
    def pack(data: bytes, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = data + bytes(16)
        at = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        low = at[begin] & _FIRST[np.minimum(size, 8)]
        high = at[begin + 8 * (size > 8)] & _FIRST[np.maximum(size - 8, 0)]
        return low, high | size.astype(np.uint64) << np.uint64(56)

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each string, -1 if it is not held."""
        out = np.full(len(low), -1, np.int64)
        todo, place = np.arange(len(low)), self._home(low, high)
        while len(todo):
            held = self.table[place]
            same = (held >= 0) & (self.low[held] == low[todo]) & (self.high[held] == high[todo])
            out[todo[same]] = held[same]
            on = (held >= 0) & ~same
            todo, place = todo[on], (place[on] + 1) & (len(self.table) - 1)
        return out

    def _place(self, numbers: np.ndarray) -> None:
        place = self._home(self.low[numbers], self.high[numbers])
        while len(numbers):
            free = self.table[place] < 0
            self.table[place[free]] = numbers[free]
            on = self.table[place] != numbers
            numbers, place = numbers[on], (place[on] + 1) & (len(self.table) - 1)

    def add(self, low: np.ndarray, high: np.ndarray) -> None:
        """Distinct strings that are not held get the next numbers."""
        n = self.n + len(low)
        if n > len(self.low):
            size = 1 << (n - 1).bit_length()
            self.low, self.high = (np.concatenate([x, np.zeros(size - len(x), np.uint64)]) for x in (self.low, self.high))
            self.table = np.full(2 * size, -1, np.int32)
            self._place(np.arange(self.n, dtype=np.int32))
        self.low[self.n : n], self.high[self.n : n] = low, high
        self._place(np.arange(self.n, n, dtype=np.int32))
        self.n = n


class Encoder:
    """encode() gives the ids that Tokenizer.encode(text, add_special_tokens=False) gives.

    As there, a text that holds the string of an added token of the file (such as an end of text) has that token's id in
    its place; with plain=True such strings are ordinary text, as after encode_special_tokens = True.
    """

    _loaded: dict[tuple[str, bool], "Encoder"] = {}

    @classmethod
    def load(cls, path: str, plain: bool = False) -> "Encoder":
        if (path, plain) not in cls._loaded:
            cls._loaded[path, plain] = cls(path, plain)
        return cls._loaded[path, plain]

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = plain
        self.whole = whole
        self.added: list[bytes] = []  # strings that make a text one for the library itself
        for token in whole.get_added_tokens_decoder().values():
            if not (plain and token.special) and token.content:
                self.added.append(token.content.encode())
        if whole.normalizer is not None or type(whole.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError("only byte-level vocabularies without a normalizer are known here")
        self.model = whole.model
        self.letters = np.array([ord(c) for _, c in sorted(_byte_letters().items())], "<u4")
        self.kinds: dict[int, int] = {}
        self.short = PackedSlots()
        self.short_at = np.zeros((1 << 12, 2), np.uint32)  # where in flat the ids of a short pre-token begin and end
        self.long: dict[bytes, tuple[int, int]] = {}
        self.flat, self.used = np.zeros(1 << 14, np.uint32), 0  # ids of the kept pre-tokens on end

    def _gather(self, data: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, which lie in data between cuts: a flat array, and where in it each begins and ends."""
        size = np.diff(cuts)
        at = np.zeros((len(size), 2), np.int64)
        short = np.flatnonzero(size <= PACKED)
        low, high = PackedSlots.pack(data, cuts[short], size[short])
        slots = self.short.find(low, high)
        held = slots >= 0
        at[short[held]] = self.short_at[slots[held]]
        new = np.flatnonzero(~held)
        new_words = [data[a:b] for a, b in zip(cuts[short[new]].tolist(), cuts[short[new] + 1].tolist(), strict=True)]
        new_long: list[int] = []
        for i in np.flatnonzero(size > PACKED).tolist():
            word = data[cuts[i] : cuts[i + 1]]
            if word in self.long:
                at[i] = self.long[word]
            else:
                new_long.append(i)
                new_words.append(word)
        if not new_words:
            return self.flat, at[:, 0], at[:, 1]
        ids, ends = array("I"), array("q", [0])
        tokenize = self.model.tokenize
        lettered = self.letters[np.frombuffer(b"".join(new_words), np.uint8)].tobytes().decode("utf-32-le")
        a = 0
        for n in map(len, new_words):
            ids.extend([t.id for t in tokenize(lettered[a : a + n])])
            ends.append(len(ids))
            a += n
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        far = np.array(ends, np.int64) + self.used
        spans = np.stack([far[:-1], far[1:]], 1)
        at[short[new]], at[new_long] = spans[: len(new)], spans[len(new) :]
        if len(new_words) <= CACHE - self.short.n - len(self.long):  # ids of others lie behind those in use until the next call
            if (n := self.short.n + len(new)) > len(self.short_at):
                self.short_at = np.concatenate([self.short_at[: self.short.n], np.zeros((2 * n - self.short.n, 2), np.uint32)])
            self.short_at[self.short.n : n] = spans[: len(new)]
            self.short.add(low[new], high[new])
            self.long |= zip(new_words[len(new) :], map(tuple, spans[len(new) :].tolist()), strict=True)
            self.used = int(far[-1])
        return self.flat, at[:, 0], at[:, 1]

    def _classes(self, cps: np.ndarray) -> np.ndarray:
        out = _ASCII[np.minimum(cps, 127)]
        if len(far := np.flatnonzero(cps > 127)):
            seen, at = np.unique(cps[far], return_inverse=True)
            for c in seen.tolist():
                if c not in self.kinds:
                    self.kinds[c] = _kind(c)
            out[far] = np.array([self.kinds[c] for c in seen.tolist()], np.uint8)[at]
        return out

    def _starts(self, cps: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Whether each code point starts a pre-token. firsts: where texts start."""
        n = len(cps)
        kind = self._classes(cps)
        first = np.zeros(n, bool)
        first[firsts] = True
        last = np.zeros(n, bool)  # of a text
        last[:-1] = first[1:]
        last[-1] = True
        start = first.copy()
        turn = np.zeros(n, bool)
        turn[1:] = kind[1:] != kind[:-1]
        turn &= ~first
        after_space = np.zeros(n, bool)
        after_space[1:] = kind[:-1] == SPACE
        joined = np.zeros(n, bool)  # the plain space before is part of this pre-token
        joined[1:] = cps[:-1] == 0x20
        out_of_space = turn & after_space
        start |= turn & ~(out_of_space & joined)
        start[np.flatnonzero(out_of_space) - 1] = True  # the last white space stands alone or leads the next run
        marks = np.flatnonzero((cps == 0x27) & start & ~last)
        for i in marks.tolist():
            a = cps[i + 1]
            if a in (0x73, 0x74, 0x6D, 0x64):  # s t m d
                size = 1
            elif not last[i + 1] and (a, cps[i + 2]) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):  # re ve ll
                size = 2
            else:
                continue
            start[i + 1] = False
            if not last[i + size]:
                start[i + size + 1] = True
        return start

    def _run(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each has."""
        data = b"".join(texts)
        if not data:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        cps = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        width = 1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000)
        at = np.zeros(len(cps) + 1, np.int32)
        np.cumsum(width, out=at[1:])
        if at[-1] != len(data):
            raise ValueError("texts must be valid UTF-8")
        sizes = np.array([len(t) for t in texts])
        firsts = np.cumsum(sizes) - sizes
        firsts = np.searchsorted(at[:-1], firsts[sizes > 0])
        begins = at[:-1][self._starts(cps, firsts)]
        offsets = np.append(begins, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        index, distinct = coded.indices.to_numpy(), coded.dictionary
        cuts = np.frombuffer(distinct.buffers()[1], np.int32)[: len(distinct) + 1].astype(np.int64)
        flat, begin, end = self._gather(distinct.buffers()[2].to_pybytes(), cuts)
        n = (end - begin)[index]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin[index] - (ends - n), n) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(begins, np.cumsum(sizes))]
        return ids, np.diff(upto, prepend=0)

    def _with_added(self, text: bytes) -> np.ndarray:
        """Ids of a text that holds an added token's string, by the library."""
        return np.array(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text, without an end id. Long texts are cut where a pre-token must start."""
        held: list[bytes] = []
        parts: list[int] = []  # pieces of each text
        size = 0

        def flush() -> Iterator[np.ndarray]:
            ids, n = self._run(held)
            ends = np.cumsum(n)
            at = k = 0
            for p in parts:
                k += p
                end = int(ends[k - 1])
                yield ids[at:end]
                at = end

        for text in texts:
            if any(a in text for a in self.added):
                if parts:
                    yield from flush()
                    held, parts, size = [], [], 0
                yield self._with_added(text)
                continue
            if len(text) > RUN_BYTES:
                if parts:
                    yield from flush()
                    held, parts, size = [], [], 0
                yield np.concatenate([self._run([x])[0] for x in safe_cuts(text, RUN_BYTES)])
                continue
            held.append(text)
            parts.append(1)
            size += len(text)
            if size >= RUN_BYTES:
                yield from flush()
                held, parts, size = [], [], 0
        if parts:
            yield from flush()


def safe_cuts(text: bytes, size: int) -> Iterator[bytes]:
    """Cut before a space that follows a visible ASCII character: no pre-token spans that place."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text):
            end = text.find(b" ", end)
            if end < 0:
                end = len(text)
            elif 0x21 <= text[end - 1] <= 0x7E:
                break
            else:
                end += 1
        end = min(end, len(text))
        yield text[at:end]
        at = end


def with_end(ids: np.ndarray, end: int = END_ID) -> np.ndarray:
    return np.append(ids, np.uint32(end)).astype("<u4")
