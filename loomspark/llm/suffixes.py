"""Operator 6: repeated passages, by blockwise suffix sorting with difference-cover ranks.

A byte goes if a string of `width` bytes that covers it starts anywhere else too.

Suffix buckets. The start of every string of `width` bytes is dealt to the bucket of
its anchor: the leftmost position within the string at which a hash of eight bytes is
smallest. Equal strings have equal anchors at equal places, so a string's twins are
all in its bucket, and a bucket needs only the text around its anchors. Starts that
share an anchor are neighbours, so a bucket entry is one anchor and the text that its
strings cover. Entries with equal text are one entry with a count; buckets of one
entry hold no repeat between different texts and are never moved.

Sorting one bucket. Entries are sorted twice, by the text right of the anchor and by
the text left of it read backwards. The first 64 bytes are compared as integers. Longer
ties are resolved in one step each by the ranks of a difference-cover sample: for any
two positions there is a shift below the cover's period that takes both to sampled
positions, whose ranks were computed once by doubling. Memory is that of one block of
buckets. Neighbours' common lengths (LCP) then name the class of every left part and
right part, and a string repeats if its pair of classes occurs twice.

Large buckets. A bucket of over LARGE different entries is divided before it is sorted:
strings that reach far to the left of the anchor go by the text left of it, the others
by the text right of it, so an entry becomes two at most, and twins still meet. Each
division halves the text that a bucket's strings may differ in, so after nine all strings
of a bucket are equal, and no task sorts more than a bounded number of entries whatever
the data. Equal entries of a bucket are told by 128 bits of hash, all others by bytes.

Passages by words. The same is done with texts in which each word is a hash of eight
bytes, so that a string of 8 n bytes is n words whatever their lengths. Only words that
are covered whole go. What runs on for over LONG bytes without white space (scripts that
do not part words) is left as bytes, each eight of which weigh as much as a word.
"""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Workspace, partitions, release, slices, text_buffers, tidy

WIDTH = 400
ANCHOR = 48  # bytes whose hash names a bucket
# A perfect difference set; every residue of 57 is a difference of two of these.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
BLOCK = 4_000  # entries sorted at a time
LONG = 64  # bytes of the longest word that is told by its hash
LARGE = 1_000  # different entries of a bucket beyond which it is divided
WIDE = 10  # narrow rows that an entry with its text weighs as much as
PIECE = 1 << 20  # bytes of a text whose anchors are found at a time


@functools.cache
def _shifts() -> np.ndarray:
    """[r, s]: the least shift that takes residues r and s into the cover."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    out = np.full((PERIOD, PERIOD), -1)
    for k in reversed(range(PERIOD)):
        r = np.roll(inside, -k)
        out[np.ix_(r, r)] = k
    return out


class Text:
    """A block's text, with room to read past its end."""

    def __init__(self, text: np.ndarray, width: int):
        self.text = np.concatenate([text, np.zeros(width + 4 * PERIOD + 64, np.uint8)])

    def words(self, at: np.ndarray) -> list[np.ndarray]:
        """The 64 bytes at each position as eight integers in byte order."""
        view = np.ndarray((len(self.text) - 7,), ">u8", self.text, strides=(1,))
        return [view[np.minimum(at + 8 * k, len(view) - 1)].astype(np.uint64) for k in range(8)]

    def shared(self, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
        """Leading bytes that are equal, up to width."""
        out = np.empty(len(a), np.int64)
        span = np.arange(width)
        for k in range(0, len(a), 4096):
            differ = self.text[a[k : k + 4096, None] + span] != self.text[b[k : k + 4096, None] + span]
            out[k : k + 4096] = np.where(differ.any(1), differ.argmax(1), width)
        return out

    def presorted(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of the suffixes within groups by 64 bytes, whether each ties with the one before, whether it has its group)."""
        words = self.words(at)
        order = np.lexsort([*words[::-1], group])
        one = np.append(False, group[order][1:] == group[order][:-1])
        same = one.copy()
        for w in words:
            same[1:] &= w[order][1:] == w[order][:-1]
        return order, same, one


class CoverRanks(Text):
    """Ranks of the sampled suffixes of a block's text, by at least `width` bytes."""

    def __init__(self, text: np.ndarray, width: int):
        super().__init__(text, width)
        rows = -(-len(text) // PERIOD) + 1
        at = (np.arange(rows)[:, None] * PERIOD + np.array(COVER)).reshape(-1)
        at = at[at <= len(text) + PERIOD]
        self.place = np.full(PERIOD, -1)
        self.place[list(COVER)] = np.arange(len(COVER))
        rank = self.ranked(self.words(at))
        step, reach = PERIOD, 64
        while reach < width + PERIOD:
            ahead = np.append(rank, 0)[np.minimum(self.index(at + step), len(at))] + 1
            rank = np.unique(rank * (len(at) + 2) + ahead, return_inverse=True)[1]
            reach, step = reach + step, step * 2
        self.rank = np.append(rank, 0)

    @staticmethod
    def ranked(words: list[np.ndarray]) -> np.ndarray:
        """The rank of each 64-byte block; equal blocks are found by a hash, so only different ones are sorted."""
        h = np.zeros(len(words[0]), np.uint64)
        for w in words:
            h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        order = np.argsort(h)
        fresh = np.append(True, h[order][1:] != h[order][:-1]) if len(h) else np.zeros(0, bool)
        first, of = order[fresh], np.empty(len(h), np.int64)
        of[order] = np.cumsum(fresh) - 1
        if any((w[first][of] != w).any() for w in words):  # two blocks share a hash
            first, of = np.arange(len(h)), np.arange(len(h))
        few = [w[first] for w in words]
        order = np.lexsort(few[::-1])
        new = np.zeros(len(order), bool)
        for w in few:
            new[1:] |= w[order][1:] != w[order][:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank[of]

    def index(self, at):
        return at // PERIOD * len(COVER) + self.place[at % PERIOD]

    def sort(self, at: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(order of the suffixes within groups, bytes shared with the one before; -1 where a group begins)."""
        order, same, _ = self.presorted(at, group)
        ties = np.flatnonzero(np.append(same[1:], False) & ~same)
        ends = np.flatnonzero(same & ~np.append(same[1:], False)) + 1
        shift, rank, place, n_cover, top = _shifts(), self.rank, self.place, len(COVER), len(self.rank) - 1

        def before(x, y):
            k = shift[x % PERIOD, y % PERIOD]
            x, y = x + k, y + k
            a = rank[min(x // PERIOD * n_cover + place[x % PERIOD], top)]
            b = rank[min(y // PERIOD * n_cover + place[y % PERIOD], top)]
            return int(a > b) - int(a < b)

        by = functools.cmp_to_key(before)
        for i, j in zip(ties.tolist(), ends.tolist(), strict=True):
            own = order[i:j].tolist()
            order[i:j] = sorted(own, key=lambda e: by(int(at[e])))
        lcp = np.full(len(at), -1)
        inner = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
        lcp[inner] = self.shared(at[order[inner]], at[order[inner - 1]], width)
        return order, lcp


def repeats(keys: np.ndarray, texts: list[bytes], anchor: np.ndarray, width: int = WIDTH) -> list[tuple[int, int, int]]:
    """(entry, first, last): runs of strings, by where they start in the entry's text, that occur in another entry of its key.

    keys: ascending; texts: what the entry's strings cover; anchor: the anchor's place in it.
    """
    out, heads = [], np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(heads, append=len(keys))
    i = 0
    while i < len(heads):
        j, n = i, 0
        while j < len(heads) and (j == i or n + sizes[j] <= BLOCK):
            n += sizes[j]
            j += 1
        a = heads[i]
        out += [(a + e, lo, hi) for e, lo, hi in _block(keys[a : a + n], texts[a : a + n], anchor[a : a + n], width)]
        i = j
    return out


def _block(keys, texts, anchor, width):
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    # strings by their left part's length, anchor - start: those of entry e have lengths low[e] to anchor[e]
    low = anchor - (size - width)

    def sides(parts, length):
        at = np.cumsum(length) - length
        text = Text(np.frombuffer(b"".join(parts), np.uint8), width)
        order, same, one = text.presorted(at, keys)
        lcp = np.full(len(at), -1)
        inner = np.flatnonzero(one & ~same)
        lcp[inner] = text.shared(at[order[inner]], at[order[inner - 1]], 64)
        tied = np.flatnonzero(same | np.append(same[1:], False))
        if len(tied):  # only these need cover ranks
            own = order[tied]
            ranks = CoverRanks(np.frombuffer(b"".join([parts[k] for k in own.tolist()]), np.uint8), width)
            by, more = ranks.sort(np.cumsum(length[own]) - length[own], np.cumsum(~same[tied]), width)
            order[tied] = own[by]
            lcp[tied] = np.where(more >= 0, more, lcp[tied])
        place = np.empty(len(at), np.int64)
        place[order] = np.arange(len(at))
        # what an entry shares at most with any other of its key
        most = np.maximum(lcp, np.append(lcp[1:], -1))[place]
        return lcp, place, most

    r_lcp, r_place, r_most = sides([t[a:] for t, a in zip(texts, anchor.tolist(), strict=True)], size - anchor)
    l_lcp, l_place, l_most = sides([t[:a][::-1] for t, a in zip(texts, anchor.tolist(), strict=True)], anchor)
    first_a, last_a = np.maximum(low, width - r_most), np.minimum(anchor, l_most)
    flags = np.zeros((len(texts), int(anchor.max()) + 2), bool)
    live = np.flatnonzero(first_a <= last_a)
    for a in range(max(0, int(first_a[live].min(initial=0))), int(last_a[live].max(initial=-1)) + 1):
        own = live[(first_a[live] <= a) & (a <= last_a[live])]
        if len(own) < 2:
            continue
        r_class, l_class = np.cumsum(r_lcp < width - a), np.cumsum(l_lcp < a)
        both = l_class[l_place[own]] * (len(size) + 1) + r_class[r_place[own]]
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        flags[own[order], a] = np.append(same, False) | np.append(False, same)
    edge = np.diff(flags.astype(np.int8), axis=1, prepend=0)
    e, first = np.nonzero(edge == 1)
    e2, last = np.nonzero(edge == -1)
    # a longer left part starts earlier
    return [(int(x), int(anchor[x] - l + 1), int(anchor[x] - f)) for x, f, l in zip(e, first, last, strict=True)]


def anchors(buf: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first start, last start) of every anchor, places by the buffer."""
    n, span = len(buf), width - ANCHOR + 1
    size = np.diff(offs)
    long = np.flatnonzero(size >= width)
    if not len(long):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    raw = np.concatenate([buf, np.zeros(8, np.uint8)])
    h = np.ndarray((n,), "<u8", raw, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = h & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
    blocks = -(-(n + span) // span)
    h = np.concatenate([h, np.full(blocks * span - n, np.iinfo(np.uint64).max)]).reshape(blocks, span)
    ahead = np.minimum.accumulate(h, axis=1).reshape(-1)
    back = np.minimum.accumulate(h[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    low = np.minimum(back[: len(back) - span + 1], ahead[span - 1 :])
    count = size[long] - width + 1
    text = np.repeat(long, count)
    start = np.repeat(offs[long] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    p = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (text[1:] != text[:-1])))
    last = np.append(head[1:], len(p)) - 1
    return text[head], p[head], start[head], start[last]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_code(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, its offsets, and for each word: start and stop in buf, start in the code)."""
    n = len(buf)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    blank = _BLANK[buf]
    start = np.flatnonzero(~blank & (np.append(True, blank[:-1])[:n] | first[:n]))
    if not len(start):
        return np.zeros(0, np.uint8), np.zeros(len(offs), np.int64), start, start, start
    stop = np.flatnonzero(~blank & (np.append(blank[1:], True) | first[1:])) + 1
    length = stop - start
    # eight bytes of all words at a time
    raw = np.ndarray((n,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    h, own = length.astype(np.uint64), np.arange(len(start))
    for k in range(0, LONG, 8):
        own = own[length[own] > k]
        if not len(own):
            break
        x = (h[own] ^ (raw[start[own] + k] & _MASKS[np.minimum(length[own] - k, 8)])) * np.uint64(0x9E3779B97F4A7C15)
        h[own] = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    size = np.where(length <= LONG, 8, -(-length // 8) * 8)
    ends = np.append(0, np.cumsum(size))
    code = np.zeros(int(ends[-1]) // 8, np.uint64)
    code[ends[:-1] // 8] = h
    code = code.view(np.uint8)
    for w in np.flatnonzero(length > LONG).tolist():
        code[ends[w] : ends[w + 1]] = 0
        code[ends[w] : ends[w] + length[w]] = buf[start[w] : stop[w]]
    return code, ends[np.searchsorted(start, offs)], start, stop, ends[:-1]


def covered_bytes(own: np.ndarray, coded: tuple, gone: np.ndarray) -> np.ndarray:
    """Bytes of a text that go if those of its code (`word_code`) go: words covered whole, with the blanks up to the next word."""
    _, _, start, stop, at = coded
    ahead = np.append(start[1:], len(own))
    held = np.append(0, np.cumsum(gone))
    length = stop - start
    size = np.where(length <= LONG, 8, length)
    whole = held[at + size] - held[at] == size
    edge = np.zeros(len(own) + 1, np.int32)
    edge[start[whole]] += 1
    np.add.at(edge, ahead[whole], -1)
    out = np.cumsum(edge)[:-1] > 0
    for w in np.flatnonzero(~whole & (length > LONG)).tolist():
        out[start[w] : stop[w]] = gone[at[w] : at[w] + length[w]]
    if len(start) and whole[0]:
        out[: start[0]] = True
    return out


def anchor_keys(buf: np.ndarray, p: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes at each place."""
    words = np.ndarray((max(len(buf) - 7, 0),), "<u8", np.ascontiguousarray(buf), strides=(1,))
    h = np.full(len(p), ANCHOR, np.uint64)
    for k in range(0, ANCHOR, 8):
        h = (h ^ words[p + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def pieces(buf: np.ndarray, offs: np.ndarray, width: int):
    """`anchors` of all texts, a bounded part of a very long one at a time."""
    whole = len(buf) <= PIECE or len(offs) > 2
    for c in [0] if whole else range(0, max(1, len(buf) - width + 1), PIECE):
        sub = buf if whole else buf[c : c + PIECE + width - 1]
        t, *places = anchors(sub, offs if whole else np.array([0, len(sub)]), width)
        yield t, *(x + c for x in places)


def divide(text: bytes, a: int, left: int, right: int, width: int):
    """(side, known left, known right, first, last, shared): the one or two groups that an entry's strings fall into.

    a: the anchor's place in text; all strings of the bucket share `left` bytes before
    and `right` bytes from the anchor on. A string is told by the bytes it has before
    the anchor; first and last are the fewest and most of the group, shared what all
    strings of the new bucket have in common.
    """
    low, high = a - (len(text) - width), a
    far = left + -(-(width - left - right) // 2)
    if high >= far:
        yield b"l", far, right, max(low, far), high, text[a - far : a + right]
    if low < far:
        near = width - far + 1
        yield b"r", left, near, low, min(high, far - 1), text[a - left : a + near]


def _divided(modes):
    def run(batches):
        import xxhash

        h = xxhash.xxh3_64_intdigest
        names = ["doc", "th", "mode", "key", "body", "n", "a", "lo", "left", "right", "text"]
        for batch in batches:
            c = {x: batch.column(x).to_pylist() for x in ("mode", "key", "n", "a", "lo", "left", "right", "text")}
            out = {x: [] for x in ("i", *names[2:])}
            for i, (mode, key, n, a, lo, left, right, text) in enumerate(zip(*c.values(), strict=True)):
                width = modes[mode][0]
                for side, l, r, few, most, shared in divide(text, a, left, right, width):
                    own = text[a - most : a - few + width]
                    new = np.array([h(shared + side + key.to_bytes(8, "little", signed=True)), h(own, 1)], np.uint64).view(np.int64)
                    for x, value in zip(out, (i, mode, int(new[0]), int(new[1]), n, most, lo + a - most, l, r, own), strict=True):
                        out[x].append(value)
            of = pa.array(out["i"], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(of), batch.column("th").take(of), pa.array(out["mode"], pa.int32()), *(pa.array(out[x], pa.int64()) for x in names[3:-1]), pa.array(out["text"], pa.binary())], names)

    return run


def _spans(df: DataFrame, doc: str, text: str, modes: list[tuple[int, bool]], large: int, ws: Workspace) -> DataFrame:
    """(doc, th, mode, lo, hi): runs of starts of strings that occur elsewhere too; th is the text's hash.

    modes: (width, whether words are told by hashes); all are searched for side by side,
    in buckets of their own, so that texts are moved once.
    """
    import xxhash

    spark = df.sparkSession
    kind = dict(df.dtypes)[doc]
    own = df.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))

    def find(batches):
        h = xxhash.xxh3_64_intdigest
        for batch in batches:
            buf, offs = text_buffers(batch.column(2))
            for i, j in slices(offs, 1 << 17):
                for mode, (width, words) in enumerate(modes):
                    sub, own = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                    if words:
                        sub, own, *_ = word_code(sub, own)
                    data = sub.tobytes()
                    for t, p, lo, hi in pieces(sub, own, width):
                        key = anchor_keys(sub, p) + np.uint64(mode)
                        body = [h(data[a : b + width], 1) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                        zero = own[t]
                        of = pa.array(t + i)
                        at = (x - zero for x in (p, lo, hi))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(np.full(len(t), mode, np.int32)), pa.array(key.view(np.int64)), pa.array(np.array(body, np.uint64).view(np.int64)), *(pa.array(x.astype(np.int32)) for x in at)], ["doc", "th", "mode", "key", "body", "p", "lo", "hi"])

    least = min(width // 4 - 1 if words else width for width, words in modes)  # words of one byte and the blanks between
    found = ws.save(own.where(F.octet_length("text") >= least).mapInArrow(tidy(find), f"doc {kind}, th long, mode int, key long, body long, p int, lo int, hi int"), "anchors")
    # entries: texts of a bucket that differ; key and body together are 128 bits of hash
    entries = found.groupBy("key", "body").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("doc", "th", "mode", "p", "lo", "hi")))
    # tables of their own: joins then exchange both sides, so that a frequent key's rows can be split
    entries = ws.save(entries, "entries")
    whole = [ws.save(found.join(entries.where("n > 1").select("key", "body"), ["key", "body"], "left_semi").select("doc", "th", "mode", "lo", "hi"), "whole")]
    ws.drop("anchors")
    wide = ws.save(entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "wide")
    part = entries.join(wide, "key").select("doc", "th", F.struct("mode", "key", "n", "m", "p", "lo", "hi").alias("e"))
    lists = part.groupBy("doc", "th").agg(F.collect_list("e").alias("es"))  # bounded by the document's length
    with_text = own.alias("o").join(lists.alias("l"), F.col("o.doc").eqNullSafe(F.col("l.doc")) & F.col("o.th").eqNullSafe(F.col("l.th")))
    # rows that repeat a document, text and all, need its entries once
    with_text = with_text.select("o.doc", "o.th", "text", "es")

    def texts(batches):
        names = ("mode", "key", "n", "m", "a", "lo")
        for batch in batches:
            raw = text_buffers(batch.column(2))
            held = [word_code(*raw)[:2] if words else raw for _, words in modes]
            out = {k: [] for k in ("i", *names, "text")}
            for i, es in enumerate(batch.column(3).to_pylist()):
                for e in es:
                    mode = e["mode"]
                    own, ends = held[mode]
                    out["i"].append(i)
                    for k in ("mode", "key", "n", "m", "lo"):
                        out[k].append(e[k])
                    out["a"].append(e["p"] - e["lo"])
                    out["text"].append(own[ends[i] + e["lo"] : ends[i] + e["hi"] + modes[mode][0]].tobytes())
                if len(out["i"]) >= 5000 or i == batch.num_rows - 1:
                    of = pa.array(out["i"], pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(out["mode"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in names[1:]), pa.array(out["text"], pa.binary())], ["doc", "th", *names, "text"])
                    out = {k: [] for k in out}

    cut = ws.save(with_text.mapInArrow(tidy(texts), f"doc {kind}, th long, mode int, key long, n long, m long, a long, lo long, text binary"), "cut")

    def entry(rows):
        return rows.select("doc", "th", "mode", "key", "n", "a", "lo", "text")

    ready = [entry(cut.where(f"m <= {large}").dropDuplicates(["key", "doc", "th", "lo"]))]
    division = f"doc {kind}, th long, mode int, key long, body long, n long, a long, lo long, left long, right long, text binary"
    width_of = "element_at(array({}), mode + 1)".format(", ".join(str(width) for width, _ in modes))
    # the divisions end: each leaves less than half of the text that strings of a bucket may differ in
    many = lambda sizes: sizes.where(f"m > {large}").agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    level, some = 0, many(wide)
    rest = cut.where(f"m > {large}").dropDuplicates(["key", "doc", "th", "lo"]).withColumns({"left": F.lit(0).cast("long"), "right": F.lit(ANCHOR).cast("long")})
    while some:
        level += 1
        sub = ws.save(rest.mapInArrow(tidy(_divided(modes)), division), f"divided{level}", 2 * WIDE * some)
        one = ws.save(sub.groupBy("key", "body").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.first(F.struct("doc", "th", "mode", "a", "lo", "left", "right", "text")).alias("f")), f"entries{level}", 2 * WIDE * some)
        twins = sub.where("n = 1").select("key", "body", "doc", "th", "mode", F.col("lo").cast("int").alias("lo"), F.expr(f"cast(lo + octet_length(text) - {width_of} as int)").alias("hi"))
        twins = twins.join(one.where("c > 1").select("key", "body"), ["key", "body"], "left_semi").drop("key", "body")
        whole.append(ws.save(twins, f"whole{level}", 2 * some))
        sizes = ws.save(one.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), f"wide{level}", some)
        rows = one.join(sizes, "key").select("key", "n", "m", "f.*")
        ws.drop(f"divided{level}")
        ready.append(entry(rows.where(f"m <= {large}")))
        rest, some = rows.where(f"m > {large}").drop("m"), many(sizes)
    total = part.count()
    buckets = max(partitions(spark), -(-total // BLOCK))

    def sort(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("mode", "ascending"), ("key", "ascending")])
        modes_, keys, anchor = (table.column(c).to_numpy() for c in ("mode", "key", "a"))
        texts_, runs = table.column("text").to_pylist(), []
        for mode, (width, _) in enumerate(modes):
            i, j = np.searchsorted(modes_, [mode, mode + 1]).tolist()
            if i < j:
                runs += [(i + e, lo, hi) for e, lo, hi in repeats(keys[i:j], texts_[i:j], anchor[i:j], width)]
        del texts_
        n, lo = table.column("n").to_numpy(), table.column("lo").to_numpy()
        runs = [r for r in runs if n[r[0]] == 1]  # other entries repeat as a whole
        e = np.array([r[0] for r in runs], np.int64)
        rows = table.select(["doc", "th", "mode"]).take(pa.array(e))
        release()
        first, last = np.array([r[1] for r in runs], np.int64), np.array([r[2] for r in runs], np.int64)
        return pa.table({"doc": rows.column("doc"), "th": rows.column("th"), "mode": rows.column("mode"), "lo": pa.array((lo[e] + first).astype(np.int32)), "hi": pa.array((lo[e] + last).astype(np.int32))})

    rows = functools.reduce(DataFrame.unionByName, ready).withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets)))
    whole.append(ws.save(rows.groupBy("bucket").applyInArrow(sort, f"doc {kind}, th long, mode int, lo int, hi int"), "sorted"))
    return functools.reduce(DataFrame.unionByName, whole)


def remove(df: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, texts: bool = True, keep: tuple[str, ...] = (), large: int = LARGE, words: int = 0, passages: int = 0) -> DataFrame:
    """Documents without the bytes that repeat: of strings of `width` bytes, or of `words` words if that is set.

    (doc, *keep, n_bytes, n_removed, n_spans, kept_sha256); if passages is set,
    n_passage_bytes: the bytes, removed or not, of words in passages of that many words
    which occur elsewhere too; if texts is set, removed (array of struct from, to in
    bytes) and kept (binary; a cut may fall within a character). A null text is empty;
    texts shorter than width lose nothing; rows that repeat a document are each other's
    twins; null and equal keys are told apart by the text; other columns are left out; an
    empty table gives no row. The result is a written table, and what led to it is deleted.
    """
    ws = Workspace(df.sparkSession, "suffixes")
    width = 8 * words or width
    modes = [(width, words > 0), *([(8 * passages, True)] if passages else [])]
    found = _spans(df, doc, text, modes, large, ws)
    ws.drop(*(n for n in ws.names() if not n.startswith(("whole", "sorted"))))
    span = F.struct("lo", "hi")
    # sets: rows that repeat a document bring the same spans, so what is held is bounded by the document's length
    lists = found.groupBy("doc", "th").agg(F.collect_set(F.when(F.col("mode") == 0, span)).alias("spans"), F.collect_set(F.when(F.col("mode") == 1, span)).alias("passages"))
    carried = [f"_keep{k}" for k in range(len(keep))]
    own = df.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"), *(F.col(c).alias(k) for c, k in zip(keep, carried, strict=True)))
    rows = own.alias("o").join(lists.alias("l"), F.col("o.doc").eqNullSafe(F.col("l.doc")) & F.col("o.th").eqNullSafe(F.col("l.th")), "left")
    rows = rows.select("o.doc", "text", *(F.col(x) for f in ("spans", "passages") for x in (f"{f}.lo", f"{f}.hi")), *carried).toDF("doc", "text", "lo", "hi", "p_lo", "p_hi", *carried)

    def covered(coded, lo, hi, width):
        cover = np.zeros(len(coded) + 1, np.int32)
        np.add.at(cover, lo.values.to_numpy(), 1)
        np.add.at(cover, hi.values.to_numpy() + width, -1)
        return np.cumsum(cover)[:-1] > 0

    def cut(batches):
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            n, removed, spans, sha, told, where, kept = [], [], [], [], [], [], []
            for i, (lo, hi, p_lo, p_hi) in enumerate(zip(*batch.columns[2:6], strict=True)):
                own = buf[offs[i] : offs[i + 1]]
                gone, told_ = np.zeros(len(own), bool), 0
                some, more = lo.is_valid and len(lo) > 0, p_lo.is_valid and len(p_lo) > 0
                coded = word_code(own, np.array([0, len(own)])) if more or some and words else None
                if some:
                    gone = covered_bytes(own, coded, covered(coded[0], lo, hi, width)) if words else covered(own, lo, hi, width)
                if more:
                    told_ = int(covered_bytes(own, coded, covered(coded[0], p_lo, p_hi, 8 * passages)).sum())
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                rest = own[~gone].tobytes()
                n.append(len(own))
                removed.append(int(gone.sum()))
                spans.append(len(edge) // 2)
                sha.append(hashlib.sha256(rest).hexdigest())
                told.append(told_)
                if texts:
                    where.append([{"from": a, "to": b} for a, b in edge.reshape(-1, 2).tolist()])
                    kept.append(rest)
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha, pa.string())]
            if passages:
                cols.append(pa.array(told, pa.int64()))
            if texts:
                cols += [pa.array(where, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols + [batch.column(k) for k in carried], schema.names)

    of = df.schema
    schema = T.StructType([T.StructField("_doc", of[doc].dataType), *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    if passages:
        schema = schema.add("n_passage_bytes", "long")
    if texts:
        schema = schema.add("removed", T.ArrayType(T.StructType().add("from", "long").add("to", "long"))).add("kept", "binary")
    for k, c in zip(carried, keep, strict=True):
        schema = schema.add(k, of[c].dataType)
    return ws.result(rows.mapInArrow(tidy(cut), schema)).withColumnsRenamed({"_doc": doc} | dict(zip(carried, keep, strict=True)))


def query(spark, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), texts=False, passages=51)
