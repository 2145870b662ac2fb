"""Pre-tokenisation and id lookup on whole Arrow buffers.

`boundaries` splits UTF-8 texts where the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
starts a match, without running a regex. Every byte gets the class of its code
point (letter, number, white space, other). Within a run of one class a byte's
transition function is the identity, so bytes compose to one function per run. A
run's function takes what the text before it owes (nothing, a plain space that joins
what follows, an apostrophe that may begin a contraction) to what it owes in turn; as
composition is associative, the functions of all runs are composed by a blocked
prefix scan, and each run then reads the state before it.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

LETTER, NUMBER, SPACE, OTHER = range(4)
# The White_Space code points of the Unicode standard.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    table[kinds == "L"], table[kinds == "N"] = LETTER, NUMBER
    table[WHITE] = SPACE
    return table


def byte_classes(buf: np.ndarray) -> np.ndarray:
    table = classes()
    cls = table[:256][buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = [buf[np.minimum(lead + k, len(buf) - 1)].astype(np.int32) & 0x3F for k in range(4)]
        b0, wide, wider = buf[lead].astype(np.int32), buf[lead] >= 0xE0, buf[lead] >= 0xF0
        cp = np.where(wider, (b0 & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3], np.where(wide, (b0 & 15) << 12 | b[1] << 6 | b[2], (b0 & 31) << 6 | b[1]))
        of = table[np.minimum(cp, 0x10FFFF)]
        cls[lead] = of
        cls[np.minimum(lead + 1, len(buf) - 1)] = of
        cls[lead[wide] + 2] = of[wide]
        cls[lead[wider] + 3] = of[wider]
    return cls


# States between runs, and the transition function of each kind of run as the row [state before] -> state after.
FREE, SPACED, QUOTED = range(3)
PLAIN, GIVES_SPACE, QUOTE = range(3)
TRANSITIONS = np.array([[FREE] * 3, [SPACED] * 3, [QUOTED, FREE, QUOTED]], np.uint8)


def scan(functions: np.ndarray, start: int = FREE, block: int = 32) -> np.ndarray:
    """The state before each of the functions (rows of [state] -> state), which are applied in turn.

    Rows are composed within blocks, all blocks side by side; the blocks' functions are
    composed by doubling; then all blocks are run from the states so found.
    """
    n, states = functions.shape
    blocks = -(-n // block)
    identity = np.arange(states, dtype=functions.dtype)
    f = np.concatenate([functions, np.broadcast_to(identity, (blocks * block - n, states))]).reshape(blocks, block, states)
    whole = f[:, 0]
    for k in range(1, block):
        whole = np.take_along_axis(f[:, k], whole, 1)
    step = 1
    while step < blocks:
        whole = np.concatenate([whole[:step], np.take_along_axis(whole[step:], whole[:-step], 1)])
        step *= 2
    state = np.concatenate([[start], whole[:-1, start]]) if blocks else np.zeros(0, functions.dtype)
    out = np.empty((blocks, block), functions.dtype)
    rows = np.arange(blocks)
    for k in range(block):
        out[:, k] = state
        state = f[rows, k, state]
    return out.reshape(-1)[:n]


def boundaries(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions, ascending, at which a match starts; texts never share one."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    cls = byte_classes(buf)
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    cut = first[:n].copy()
    cut[1:] |= cls[1:] != cls[:-1]
    at = np.flatnonzero(cut)
    end = np.append(at[1:], n)
    kind = cls[at]
    last = first[end] | (end == n)  # the run ends its text
    lead = end - 1  # where the run's last character starts; white space has 3 bytes at most
    for _ in range(3):
        lead = np.where((buf[lead] & 0xC0) == 0x80, lead - 1, lead)
    white = kind == SPACE
    open_ = white & ~last
    gives = open_ & (buf[end - 1] == 0x20)  # its last space joins what follows
    quote = (kind == OTHER) & (end - at == 1) & (buf[at] == 0x27) & ~last
    # the last run of a text owes nothing, so every text begins free
    function = np.where(gives, GIVES_SPACE, np.where(quote, QUOTE, PLAIN))
    before = scan(TRANSITIONS[function])
    start = at - (before == SPACED)
    # a quote may owe the letters that follow it to a contraction
    owed = np.flatnonzero((before == QUOTED) & (kind == LETTER))
    c1, c2 = buf[at[owed]], buf[np.minimum(at[owed] + 1, n - 1)]
    one = (c1 == ord("s")) | (c1 == ord("t")) | (c1 == ord("m")) | (c1 == ord("d"))
    two = (((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))) & (end[owed] - at[owed] >= 2)
    start[owed] += np.where(one, 1, np.where(two, 2, 0))
    mark = np.zeros(n + 1, bool)
    mark[start[~white & (start < end)]] = True
    mark[at[white & (last | (lead > at))]] = True
    mark[lead[open_ & ~gives]] = True
    return np.flatnonzero(mark[:n])


_MASK = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(17)], np.uint64)


class WordTable:
    """Ids of pretokens, by an open-addressing table on their bytes.

    encode: list of pretokens -> (ids of all, how many each has). Words of up to 16
    bytes are compared exactly as two integers and a length; longer ones by a dict.
    Both are bounded: when full, further words are encoded anew each time.
    """

    PROBES = 6

    def __init__(self, encode, bits: int = 20, longest: int = 50_000):
        self.encode, self.mask, self.longest = encode, np.int64((1 << bits) - 1), longest
        size = 1 << bits
        self.k1, self.k2 = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.n, self.at, self.count = np.zeros(size, np.uint8), np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.claim = np.zeros(size, np.int32)
        self.pool, self.used, self.filled = np.zeros(1 << 16, np.int32), 0, 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def _add(self, ids: np.ndarray) -> int:
        at = self.used
        while at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _slot(self, a, b, n):
        h = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + n.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) & self.mask

    def ids(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pretokens in order, how many each has); starts as by `boundaries`."""
        m = len(starts)
        if not m:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        raw = np.concatenate([buf, np.zeros(16, np.uint8)])
        words = np.ndarray((len(buf) + 9,), "<u8", raw, strides=(1,))
        length = np.diff(starts, append=len(buf))
        short = np.minimum(length, 16)
        a = words[starts] & _MASK[short]
        b = words[np.minimum(starts + 8, len(buf))] & _MASK[np.maximum(short - 8, 0)]
        n8 = short.astype(np.uint8)
        at, count = np.zeros(m, np.int32), np.full(m, -1, np.int32)
        slot = self._slot(a, b, n8)
        todo = np.flatnonzero(length <= 16)
        base = slot[todo]
        for _ in range(self.PROBES):
            s = base
            hit = (self.k1[s] == a[todo]) & (self.k2[s] == b[todo]) & (self.n[s] == n8[todo])
            found, fs = todo[hit], s[hit]
            at[found], count[found] = self.at[fs], self.count[fs]
            more = ~hit & (self.n[s] > 0)
            todo, base = todo[more], (s[more] + 1) & self.mask
            if not len(todo):
                break
        rest = np.flatnonzero(count < 0)
        keep = None
        if len(rest):
            if self.filled > len(self.k1) // 2:
                keep = self.used
            view = memoryview(raw)
            keys = [bytes(view[i:j]) for i, j in zip(starts[rest].tolist(), (starts[rest] + length[rest]).tolist(), strict=True)]
            new: dict[bytes, int] = {}
            which = [new.setdefault(k, len(new)) if k not in self.long else -1 for k in keys]
            which = np.array(which)
            ids, counts = self.encode(list(new)) if new else (np.zeros(0, np.int32), np.zeros(0, np.int32))
            first = self._add(np.asarray(ids, np.int32)) + np.cumsum(counts) - counts if new else np.zeros(0, np.int64)
            fresh = which >= 0
            at[rest[fresh]], count[rest[fresh]] = first[which[fresh]], counts[which[fresh]]
            for i in np.flatnonzero(~fresh).tolist():
                at[rest[i]], count[rest[i]] = self.long[keys[i]]
            if keep is None and new:
                one = np.full(len(new), -1, np.int64)
                one[which[fresh]] = rest[fresh]
                small = length[one] <= 16
                self._insert(a[one[small]], b[one[small]], n8[one[small]], first[small], counts[small])
                if len(self.long) < self.longest:
                    for i, k in enumerate(new):
                        if not small[i]:
                            self.long[k] = (int(first[i]), int(counts[i]))
        total = np.cumsum(count)
        out = self.pool[np.repeat(at - (total - count), count) + np.arange(total[-1])]
        if keep is not None:
            self.used = keep
        return out, count

    def _insert(self, a, b, n, at, count):
        s = self._slot(a, b, n)
        order = np.arange(len(s), dtype=np.int32)
        for _ in range(self.PROBES):
            free = self.n[s] == 0
            self.claim[s[free]] = order[free]
            won = free & (self.claim[s] == order)
            w = s[won]
            self.k1[w], self.k2[w], self.n[w], self.at[w], self.count[w] = a[won], b[won], n[won], at[won], count[won]
            self.filled += len(w)
            left = ~won
            if not left.any():
                break
            a, b, n, at, count, s = a[left], b[left], n[left], at[left], count[left], (s[left] + 1) & self.mask
            order = np.arange(len(s), dtype=np.int32)


class TextEncoder:
    """Whole texts to ids: boundaries, then looked-up pretokens.

    special: (string, id) pairs that are cut out of a text before it is split.
    """

    def __init__(self, encode, special: tuple[tuple[bytes, int], ...] = (), bits: int = 20):
        self.table, self.special = WordTable(encode, bits), special

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, offsets of each text's ids)."""
        if self.special and any(s in buf.tobytes() for s, _ in self.special):
            return self._split(buf, offs)
        starts = boundaries(buf, offs)
        ids, counts = self.table.ids(buf, starts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends[np.searchsorted(starts, offs)]

    def _split(self, buf, offs):
        import re

        by, pattern = dict(self.special), re.compile(b"|".join(re.escape(s) for s, _ in self.special))
        out, ends = [], [0]
        for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            text, p, parts = buf[i:j].tobytes(), 0, []
            for m in [*pattern.finditer(text), None]:
                piece = np.frombuffer(text[p : m.start() if m else len(text)], np.uint8)
                parts.append(self.table.ids(piece, boundaries(piece, np.array([0, len(piece)])))[0] if len(piece) else np.zeros(0, np.int32))
                if m:
                    parts.append(np.array([by[m[0]]], np.int32))
                    p = m.end()
            out += parts
            ends.append(ends[-1] + sum(map(len, parts)))
        return np.concatenate(out), np.array(ends)


@functools.cache
def library_encoder(path: str) -> TextEncoder:
    """Of the tokenizers library: its model encodes each distinct pretoken; one encoder per worker and file."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    # the library's own byte alphabet: the bytes that it leaves as they are, then the rest in order from U+0100
    same = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD) and (b < 0x7F or b > 0xA0)]
    letters = {b: chr(b) for b in same} | {b: chr(0x100 + k) for k, b in enumerate(x for x in range(256) if x not in set(same))}
    if set(letters.values()) != set(ByteLevel.alphabet()):
        raise ValueError("the tokenizer's byte alphabet is not the known one")

    def encode(words: list[bytes]):
        found = [[t.id for t in model.tokenize(w.decode("latin-1").translate(letters))] for w in words]
        counts = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter((i for x in found for i in x), np.int32, int(counts.sum())), counts

    special = tuple((t.content.encode(), i) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special)
    return TextEncoder(encode, special)
