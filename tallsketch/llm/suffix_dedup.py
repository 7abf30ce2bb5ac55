"""Removal of byte strings that repeat from earlier documents, by a run-length index.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts in a document
with a smaller key.  The corpus is dealt out so that equal strings meet:

1. Whole copies of an earlier document are found by SHA-256 and go as a whole.
2. Anchors: of the grams of ``GRAM`` bytes in each string of ``LENGTH`` bytes, the one with the
   smallest hash.  Equal strings choose equal anchors, so a repeat needs an anchor that several
   documents have.
3. For those anchors alone, the bytes around (all strings that contain the anchor) are sent to
   the task that owns the anchor's hash.  Equal surroundings are collapsed before and after.
   A hot anchor's strings are sent one by one instead, as 128-bit hashes: the strings whose
   smallest gram it is, each once per batch by its first document.  The owner of a hash streams
   its documents in order and marks all but the first, so no group of surroundings gathers.
4. The owner builds an index of the surroundings that may share a string, a few hundred KB at a
   time: the run-compressed Burrows-Wheeler transform with text positions and match lengths sampled
   at the ends of its runs; text and suffix order are dropped.  From the samples, matching statistics
   stream over the text: the suffix before each one, and how far the two match.  Suffixes linked for
   ``LENGTH`` bytes form an interval; those whose document is not the interval's first are marked.

Documents without a key come after all others and never mark one another.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallsketch.llm.common import join_hot, small, stored, table
from tallsketch.session import ship_package

LENGTH = 50
GRAM = 16
#: Bytes of texts that are hashed at once, bytes of surroundings in an index.
CHUNK, INDEX = 1 << 19, 1 << 18
#: An anchor that occurs more often, and more often than in this share of all documents, is hot
#: (a repeated line makes it occur often in one): its strings are dealt out one by one.
HOT, HOT_SHARE = 5_000, 0.01
#: Strings of hot anchors that are collapsed at once; ``at`` of their rows.
STRINGS, HASHED = 1 << 19, -2
#: Rows of surroundings that are put together at once, text positions an index streams at once.
ROWS, STREAM = 1 << 16, 1 << 16
#: Documents with spans plus spans that may be broadcast.
MARKS = 1_500_000
_LAST = 2**63 - 1
_MUL = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MUL[2]
    return x ^ (x >> np.uint64(29))


def gram_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all grams of ``size`` bytes (a power of two), by doubling."""
    h, have = mix(x.astype(np.uint64) + np.uint64(1)), 1
    while have < size:
        h = mix(h[:-have] * _MUL[0] + h[have:])
        have *= 2
    return h


def slide(v: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over all windows of ``width`` values."""
    have, cur, n = 1, v, len(v) - width + 1
    while have * 2 <= width:
        cur = best(cur[:-have], cur[have:])
        have *= 2
    return best(cur[:n], cur[width - have : width - have + n]) if have < width else cur


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(text number, positions, hashes) of the anchors of each text of at least ``length`` bytes.

    All grams that tie for the smallest hash are anchors: the choice depends on the string only."""
    chunk, size = [], 0
    for k, t in enumerate(texts):
        if len(t) >= length:
            chunk.append(k)
            size += len(t)
        if chunk and (size >= CHUNK or k == len(texts) - 1):
            x = np.frombuffer(b"".join(texts[i] for i in chunk), np.uint8)
            h = gram_hashes(x, gram)
            width = length - gram + 1
            lengths = np.array([len(texts[i]) for i in chunk])
            ends = np.cumsum(lengths)
            low = slide(h, width, np.minimum)
            # strings that run over the end of a text choose nothing
            over = np.concatenate([np.arange(max(0, e - length + 1), min(e, len(low))) for e in ends])
            low[over] = 0
            edge = np.zeros(width - 1, np.uint64)
            pos = np.flatnonzero(slide(np.concatenate([edge, low, edge]), width, np.maximum) == h)
            cut = np.searchsorted(pos, ends)
            for i, a, b, begin in zip(chunk, np.concatenate([[0], cut[:-1]]), cut, ends - lengths):
                yield i, pos[a:b] - begin, h[pos[a:b]]
            chunk, size = [], 0


def _bytes(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _anchor_rows(length: int):
    """(h, ord, tag, several, times, local): an anchor once per batch, by its first document, with
    its occurrences in the batch; the other documents of the batch that have it are known to share
    it and carry the list along."""
    def run(batches):
        for b in batches:
            ords, tags = b.column("ord").to_numpy(), b.column("tag").to_numpy()
            hs, owners, times = [], [], []
            for i, _, h in anchors(_bytes(b.column("text")), length):
                u, c = np.unique(h, return_counts=True)
                hs.append(u)
                times.append(c)
                owners.append(np.full(len(u), i))
            if not hs:
                continue
            h, owner, c = np.concatenate(hs), np.concatenate(owners), np.concatenate(times)
            order = np.lexsort((ords[owner], h))
            h, owner, c = h[order], owner[order], c[order]
            first = np.concatenate([[True], h[1:] != h[:-1]])
            group = np.cumsum(first) - 1
            # several: documents of different keys in the batch have it
            n = np.bincount(group)
            last = np.cumsum(n) - 1
            several = ords[owner[first]] != ords[owner[last]]
            rest = ~first & several[group]
            local: dict[int, list[int]] = {}
            for i, x in zip(owner[rest].tolist(), h[rest].tolist()):
                local.setdefault(i, []).append(x)
            same = ~first & ~several[group]  # rows of one key: each takes part by itself
            k = np.concatenate([owner[first], owner[same]])
            s = np.concatenate([np.add.reduceat(np.where(same, 0, c), np.flatnonzero(first)), c[same]])
            flag = np.concatenate([several, np.zeros(same.sum(), bool)])
            out_h = np.concatenate([h[first], h[same]]).view(np.int64)
            extra = list(local)
            spread = mix(np.array(extra, np.uint64) + np.uint64(b.num_rows) + ords[extra].astype(np.uint64)).view(np.int64) if extra else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([out_h, spread])), pa.array(np.concatenate([ords[k], ords[extra].astype(np.int64)])),
                 pa.array(np.concatenate([tags[k], tags[extra].astype(np.int32)])), pa.array(np.concatenate([flag, np.ones(len(extra), bool)])),
                 pa.array(np.concatenate([s, np.ones(len(extra), np.int64)])),
                 pa.array([None] * len(k) + [np.array(local[i], np.uint64).tobytes() for i in extra], pa.binary())],
                names=["h", "ord", "tag", "several", "times", "local"])
    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


_ROWS = pa.schema([("key", pa.int64()), ("ord", pa.int64()), ("tag", pa.int32()), ("start", pa.int64()),
                   ("end", pa.int64()), ("at", pa.int32()), ("around", pa.binary())])
_COLUMNS = "key long, ord long, tag int, start long, end long, at int, around binary"


def _hot_starts(size: int, pos: np.ndarray, h: np.ndarray, hot: np.ndarray, length: int) -> np.ndarray:
    """Starts of the strings whose smallest gram is hot; ``pos`` and ``h`` are all anchors of a
    text of ``size`` bytes, so each string has its smallest gram among them."""
    low = np.full(size - GRAM + 1, np.uint64(2**64 - 1))
    low[pos] = h
    return np.flatnonzero(np.isin(slide(low, length - GRAM + 1, np.minimum), hot))


def _collapsed(owner: np.ndarray, start: np.ndarray, digests: bytes, ords: np.ndarray, tags: np.ndarray, length: int):
    """(rows, spans) of strings given by text number, start and hash: of each hash the rows of the
    smallest ord go to its owner, overlapping ones of a text as one; those of others are spans
    (text number, start, end)."""
    h = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    o = ords[owner]
    order = np.lexsort((start, owner, o, h[:, 1], h[:, 0]))
    h, o, owner, start = h[order], o[order], owner[order], start[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)])
    later = o > o[np.flatnonzero(new)][np.cumsum(new) - 1]

    def merged(owner, start, edge):
        edge = np.concatenate([[True], edge | (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + length)])
        at = np.flatnonzero(edge)
        return at, owner[at], start[at], start[np.append(at[1:], len(start)) - 1] + length

    rows = spans = None
    if later.any():
        by = np.lexsort((start[later], owner[later]))
        spans = merged(owner[later][by], start[later][by], False)[1:]
    h, owner, start, new = h[~later], owner[~later], start[~later], new[~later]
    at, i, a, e = merged(owner, start, (h[1:] != h[:-1]).any(axis=1))
    data = h[at].tobytes()
    rows = pa.RecordBatch.from_arrays(
        [pa.array(h[at, 0].view(np.int64)), pa.array(ords[i]), pa.array(tags[i]), pa.array(a), pa.array(e),
         pa.array(np.full(len(at), HASHED, np.int32)), pa.array([data[k : k + 16] for k in range(0, len(data), 16)], pa.binary())],
        schema=_ROWS)
    return rows, spans


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets


def _pieces(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the pieces of ``data`` put one after the other."""
    offsets = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def _binary(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    joined, offsets = _pieces(data, begin, size)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined)]).cast(pa.binary())


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; bytes beyond the end are zero."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _words(data: np.ndarray, begin: np.ndarray, size) -> Iterator[np.ndarray]:
    """Numbers that tell pieces of equal size apart, each of at most eight bytes of the pieces;
    the last ones overlap so that none reaches beyond its piece."""
    step = 8 if np.min(size) >= 8 else 1
    source = _eights(data) if step == 8 else data.astype(np.uint64)
    for j in range(0, int(np.max(size)), step):
        yield source[begin + np.minimum(j, size - step)]


def piece_hashes(data: np.ndarray, begin: np.ndarray, size, seed) -> np.ndarray:
    """64-bit hashes of pieces, their sizes and a seed."""
    h = mix(np.asarray(seed, np.uint64) * _MUL[1] + np.asarray(size, np.uint64) + np.zeros(len(begin), np.uint64))
    for w in _words(data, begin, size) if len(begin) else ():
        h = mix((h ^ w) * _MUL[0] + _MUL[1])
    return h


def _equal(data: np.ndarray, p: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the pieces from p and from q are the same bytes."""
    same = np.ones(len(p), bool)
    for v, w in zip(_words(data, p, size), _words(data, q, size)) if len(p) else ():
        same &= v == w
    return same


def _firsts(data, begin, size, h, ords) -> np.ndarray:
    """For each piece the one of the smallest ord among those of equal ``h`` (which covers the size)
    and bytes; of equal ords the first.  Pieces of equal ``h`` and other bytes stand for themselves."""
    order = np.lexsort((ords, h))
    new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    first = np.empty(len(h), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    at = np.flatnonzero(first != np.arange(len(h)))
    at = at[size[at] == size[first[at]]]
    same = np.zeros(len(h), bool)
    same[at] = _equal(data, begin[at], begin[first[at]], size[at])
    return np.where(same, first, np.arange(len(h)))


def _union(group: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(group, start, end): maximal runs of the overlapping or touching spans of each group."""
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    if not len(group):
        return group, start, end
    # the largest end so far, kept apart by group: spans of one group are compared only
    rank = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    width = int(end.max()) + 1
    far = np.maximum.accumulate(rank * width + end)
    new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (rank[1:] * width + start[1:] > far[:-1])])
    at = np.flatnonzero(new)
    return group[at], start[at], np.append(far[at[1:] - 1], far[-1]) - rank[at] * width


def _surroundings(length: int, hot: set[int]):
    """Rows (key, ord, tag, start, end, at, around) for shared anchors; rows without ``around`` are
    spans already known to repeat from an earlier document of the batch.  ``at`` is the anchor's
    place in ``around``.  For the strings of hot anchors, ``at`` is HASHED, ``around`` the hash."""
    reach = length - GRAM
    hot_hashes = np.array(sorted(hot), np.uint64)

    def run(batches):
        for b in batches:
            texts = _bytes(b.column("text"))
            data, offsets = _flat(b.column("text"))
            ords, tags = b.column("ord").to_numpy(), b.column("tag").to_numpy()
            hs, locals_ = b.column("hs"), b.column("locals")
            found = {i: (pos, h) for i, pos, h in anchors(texts, length)}
            spans, parts, waiting = [], [], 0
            owners, starts, digests, strings = [], [], [], 0

            def collapse():
                nonlocal owners, starts, digests, strings
                out, later = _collapsed(np.concatenate(owners), np.concatenate(starts), b"".join(digests), ords, tags, length)
                if later:
                    spans.append(_union(*later))
                owners, starts, digests, strings = [], [], [], 0
                return out

            def around(owner, pos, h):
                a = np.maximum(0, pos - reach)
                size = np.minimum(offsets[owner + 1] - offsets[owner], pos + length) - a
                begin, at = offsets[owner] + a, pos - a
                first = _firsts(data, begin, size, piece_hashes(data, begin, size, h + at.astype(np.uint64)), ords[owner])
                later = ords[first_owner := owner[first]] < ords[owner] if len(owner) else np.zeros(0, bool)
                later &= (h == h[first]) & (at == at[first]) & (first_owner != owner)
                if later.any():
                    spans.append(_union(owner[later], a[later], (a + size)[later]))
                k = np.flatnonzero(~later)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((h[k] ^ np.uint64(1 << 63)).view(np.int64)), pa.array(ords[owner[k]]), pa.array(tags[owner[k]]), pa.array(a[k]),
                     pa.array((a + size)[k]), pa.array(at[k].astype(np.int32)), _binary(data, begin[k], size[k])], schema=_ROWS)

            for i in sorted(found, key=lambda i: ords[i]):
                pos, h = found[i]
                own = [hs[i].values.to_numpy().view(np.uint64), *(np.frombuffer(x, np.uint64) for x in locals_[i].as_py())]
                shared = np.unique(np.concatenate(own))
                at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
                keep = shared[at] == h
                text = texts[i]
                if len(hot_hashes) and (hot_here := np.isin(h, hot_hashes)).any():
                    keep &= ~hot_here
                    at = _hot_starts(len(text), pos, h, hot_hashes, length)
                    owners.append(np.full(len(at), i))
                    starts.append(at)
                    digests.append(b"".join(xxhash.xxh3_128_digest(text[q : q + length]) for q in at.tolist()))
                    strings += len(at)
                    if strings >= STRINGS:
                        yield collapse()
                pos, h = pos[keep], h[keep]
                for k in range(0, len(pos), ROWS):
                    parts.append((np.full(len(pos[k : k + ROWS]), i), pos[k : k + ROWS], h[k : k + ROWS]))
                    waiting += len(parts[-1][0])
                    if waiting >= ROWS:
                        yield from around(*(np.concatenate(c) for c in zip(*parts)))
                        parts, waiting = [], 0
            if waiting:
                yield from around(*(np.concatenate(c) for c in zip(*parts)))
            if strings:
                yield collapse()
            if spans:
                i, a, e = _union(*(np.concatenate(c) for c in zip(*spans)))
                # spans pass through the owner's task; the key only deals them out
                key = mix(ords[i].astype(np.uint64) * _MUL[0] + a.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(ords[i]), pa.array(tags[i]), pa.array(a), pa.array(e),
                     pa.array(np.full(len(i), -1, np.int32)), pa.nulls(len(i), pa.binary())], schema=_ROWS)
    return run


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a list of strings, sampled at the ends of its runs.

    Every string ends with a symbol smaller than all bytes; of equal suffixes, that of the earlier
    string comes first.  For each run the index keeps its symbol, its length, the text position of
    its first suffix, that of the last suffix of the run before, and the length for which these two
    match: five numbers a run, however long the text.  Text and order of the suffixes are dropped
    when it is built.  Inside a run a suffix and the one before it have the same symbol on the left,
    so these two samples give the suffix before any other one, and how far it matches."""

    def __init__(self, strings: list[bytes], length: int = LENGTH):
        sizes = np.array([len(s) + 1 for s in strings])
        self.length, self.ends = length, np.cumsum(sizes)
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        n = len(text)
        left = np.repeat(self.ends, sizes) - np.arange(n)  # symbols up to the string's end, which counts
        order = self._sorted(text, left)
        before = np.where(left == 1, 0, text.astype(np.int16) + 1)[order - 1]  # the symbol on the left, cyclic
        # ends differ from one another, so each suffix that begins a string heads a run
        rows = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]) | (before == 0))
        self.run_symbols, self.run_lengths = before[rows], np.diff(np.append(rows, n))
        heads, tails = order[rows], order[rows - 1]
        match = self._match(text, left, heads, tails)
        match[0] = 0  # no suffix precedes the first one
        by = np.argsort(heads)
        self.heads, self.tails, self.match = heads[by], tails[by], match[by]

    @staticmethod
    def _sorted(text: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Text positions in the order of their suffixes: by 7 symbols of 9 bits, then by doubling
        among the suffixes that are not told apart yet."""
        n, have = len(text), 7
        padded = np.concatenate([text, np.zeros(have, np.uint8)])
        key = np.zeros(n, np.int64)
        for j in range(have):
            key = (key << 9) | np.where(j + 1 < left, padded[j : j + n].astype(np.int64) + 1, 0)
        order = np.argsort(key, kind="stable")
        rank, todo, k = np.empty(n, np.int64), np.arange(n), key[order]
        while len(todo):
            p = order[todo]
            # a suffix that ends within these symbols has its place: the text position decides
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (left[p[1:]] <= have) | (left[p[:-1]] <= have)])
            rank[p] = todo[np.flatnonzero(new)][np.cumsum(new) - 1]
            todo = todo[~(new & np.append(new[1:], True))]
            p = order[todo]
            k = rank[p] * (n + 1) + rank[np.minimum(p + have, n - 1)] + 1
            by = np.argsort(k, kind="stable")
            order[todo], k = p[by], k[by]
            have *= 2
        return order

    @staticmethod
    def _match(text: np.ndarray, left: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes from p and q share before an end symbol, eight at a time."""
        eights, most = _eights(text), np.minimum(left[p], left[q]) - 1
        out, live = np.zeros(len(p), np.int64), np.flatnonzero(most > 0)
        while len(live):
            differ = eights[p[live] + out[live]] ^ eights[q[live] + out[live]]
            lowest = differ & (~differ + np.uint64(1))
            out[live] += np.where(differ == 0, 8, np.log2(np.maximum(lowest, 1)).astype(np.int64) // 8)
            live = live[(differ == 0) & (out[live] < most[live])]
        return np.minimum(out, most)

    def statistics(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """For the text positions from start to end: the position of the suffix before each in
        order, and for how many symbols the two match, from the samples alone."""
        at = np.arange(start, end)
        run = np.searchsorted(self.heads, at, side="right") - 1
        past = at - self.heads[run]
        return self.tails[run] + past, np.maximum(0, self.match[run] - past)

    def marked(self, order: np.ndarray) -> np.ndarray:
        """Text positions at which a string of ``length`` bytes starts that also starts in an
        earlier string of smaller ``order`` (one number per string)."""
        linked, before = [], []
        for start in range(0, int(self.ends[-1]), STREAM):
            q, match = self.statistics(start, min(start + STREAM, int(self.ends[-1])))
            far = np.flatnonzero(match >= self.length)
            linked.append(far + start)
            before.append(q[far])
        p, q = np.concatenate(linked), np.concatenate(before)
        if not len(p):
            return p
        # each linked suffix leads to the one before it, and at last to the first of its interval
        nodes = np.unique(np.concatenate([p, q]))
        parent = np.arange(len(nodes))
        parent[np.searchsorted(nodes, p)] = np.searchsorted(nodes, q)
        while (parent != (further := parent[parent])).any():
            parent = further
        doc = np.asarray(order)[np.searchsorted(self.ends, nodes, side="right")]
        first = doc.copy()
        np.minimum.at(first, parent, doc)
        return nodes[doc > first[parent]]


def _merge(batches):
    for b in batches:
        merged = [[{"start": s, "end": e} for s, e in merge_spans([(x["start"], x["end"]) for x in spans])]
                  for spans in b.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("ord"), b.column("tag"), pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["ord", "tag", "spans"])


def _may_share(data: np.ndarray, begin, size, at, key, ords, length: int) -> np.ndarray:
    """Surroundings that may share a string of ``length`` bytes with one of the same key and another
    ord: such a string reaches ``half`` bytes beyond the anchor on its right, or the other bytes and
    one more on its left, and these are equal on both sides."""
    half = (length - GRAM) // 2
    left = length - GRAM - half + 1
    out = np.zeros(len(key), bool)
    for fits, start, width in ((size >= at + GRAM + half, begin + at + GRAM, half), (at >= left, begin + at - left, left)):
        k = np.flatnonzero(fits)
        if not len(k):
            continue
        h = piece_hashes(data, start[k], width, key[k].view(np.uint64)) if width else mix(key[k].view(np.uint64))
        by = np.argsort(h)
        edge = np.flatnonzero(np.concatenate([[True], h[by[1:]] != h[by[:-1]]]))
        o, n = ords[k[by]], np.diff(np.append(edge, len(k)))
        several = np.minimum.reduceat(o, edge) < np.maximum.reduceat(o, edge)
        out[k[by[np.repeat(several, n)]]] = True
    return out


def _judged(rows: pa.Table, length: int) -> Iterator[tuple]:
    """(ord, tag, start, end) arrays of what repeats among the surroundings of whole keys."""
    key, ords, tags, starts, at = (rows.column(c).to_numpy() for c in ("key", "ord", "tag", "start", "at"))
    data, offsets = _flat(rows.column("around").combine_chunks())
    begin, size = offsets[:-1], np.diff(offsets)
    same = _firsts(data, begin, size, piece_hashes(data, begin, size, key.view(np.uint64) + at.astype(np.uint64)), ords)
    same = np.where((key == key[same]) & (at == at[same]), same, np.arange(len(key)))
    later = np.flatnonzero(ords > ords[same])  # equal to surroundings of an earlier document
    yield ords[later], tags[later], starts[later], starts[later] + size[later]
    own = np.flatnonzero(ords == ords[same])
    own = own[_may_share(data, begin[own], size[own], at[own], key[own], ords[own], length)]
    # equal ones of one ord are indexed once and marked alike
    once = np.unique(same[own])
    once = once[np.argsort(key[once], kind="stable")]
    whole = np.concatenate([[True], key[once[1:]] != key[once[:-1]]]) if len(once) else np.empty(0, bool)
    total = np.cumsum(size[once])
    cut, cuts = 0, []
    for k in np.flatnonzero(whole).tolist():  # an index holds whole keys
        if total[k] - size[once[k]] - cut >= INDEX:
            cuts.append(k)
            cut = total[k] - size[once[k]]
    for part in np.split(once, cuts):
        if len(part):
            strings = [data[x : x + n].tobytes() for x, n in zip(begin[part].tolist(), size[part].tolist())]
            index = RunLengthIndex(strings, length)
            p = index.marked(ords[part])
            which = np.searchsorted(index.ends, p, side="right")
            p = p - (index.ends[which] - size[part][which] - 1)
            which, a, e = _union(which, p, p + length)
            # rows of each marked string: itself and its equals of the same ord
            place = np.searchsorted(np.sort(part), same[own])
            mine = own[(place < len(part)) & (np.sort(part)[np.minimum(place, len(part) - 1)] == same[own])]
            mine = mine[np.argsort(same[mine], kind="stable")]
            low, high = (np.searchsorted(same[mine], part[which], side=side) for side in ("left", "right"))
            n = high - low
            row = mine[np.repeat(low - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
            yield ords[row], tags[row], starts[row] + np.repeat(a, n), starts[row] + np.repeat(e, n)


def _mark(length: int):
    """Streams groups of one key, sorted by key and ord; yields (ord, tag, start, end) spans."""
    schema = pa.schema([("ord", pa.int64()), ("tag", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        out, found = [], 0
        # the hashed strings of the key that is under way, with their first documents
        hashed = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
        pending, waiting, limit = [], 0, ROWS

        def flush():
            nonlocal out, found
            ord_, tag, start, end = (np.concatenate(c) for c in zip(*out))
            out, found = [], 0
            _, group = np.unique(np.stack([ord_, tag.astype(np.int64)]), axis=1, return_inverse=True)
            group = group.reshape(-1)
            one = np.zeros(int(group.max()) + 1 if len(group) else 0, np.int64)
            one[group] = np.arange(len(group))
            group, start, end = _union(group, start, end)
            one = one[group]
            return pa.RecordBatch.from_arrays([pa.array(ord_[one]), pa.array(tag[one]), pa.array(start), pa.array(end)], schema=schema)

        def add(spans):
            nonlocal found
            out.append(spans)
            found += len(spans[0])

        def repeated(rows):
            """Hashed strings after the first document of each; a key may go on in the next batch."""
            nonlocal hashed
            key, ords = rows.column("key").to_numpy(), rows.column("ord").to_numpy()
            second = _flat(rows.column("around"))[0].view("<u8")[1::2]
            k, s, o = (np.concatenate([x, y]) for x, y in zip(hashed, (key, second, ords)))
            by = np.lexsort((o, s, k))
            new = np.concatenate([[True], (k[by[1:]] != k[by[:-1]]) | (s[by[1:]] != s[by[:-1]])])
            first = np.empty(len(k), np.int64)
            first[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
            at = np.flatnonzero((o > o[first])[len(hashed[0]) :])
            stay = by[new & (k[by] == key[-1])]
            hashed = (k[stay], s[stay], o[stay])
            add(tuple(rows.column(c).to_numpy()[at] for c in ("ord", "tag", "start", "end")))

        def judge(last):
            """Judge the whole keys among the rows that wait; unless it is the last time, the rows
            of the last key wait on."""
            nonlocal pending, waiting
            rows = pa.Table.from_batches(pending).combine_chunks()
            key = rows.column("key").to_numpy()
            n = len(key) if last else int(np.searchsorted(key, key[-1]))
            if n:
                for spans in _judged(rows.slice(0, n), length):
                    add(spans)
                pending = rows.slice(n).to_batches()
            waiting = len(key) - n

        for b in batches:
            at = b.column("at").to_numpy()
            # both kinds have few rows a key, so a batch of rows is a bounded amount
            if (known := at == -1).any():
                add(tuple(b.filter(pa.array(known)).column(c).to_numpy() for c in ("ord", "tag", "start", "end")))
            if (strings := at == HASHED).any():
                repeated(pa.RecordBatch.from_arrays(b.filter(pa.array(strings)).columns, names=b.schema.names))
            if (rest := at >= 0).any():
                pending.append(b.filter(pa.array(rest)))
                waiting += pending[-1].num_rows
            if waiting >= limit:
                judge(False)
                limit = max(ROWS, 2 * waiting)
            if found >= ROWS:
                yield flush()
        if pending:
            judge(True)
        if out:
            yield flush()
    return run


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with _ord (the key; null keys last), _sha, _tag (32 bits of it) and _bytes."""
    body = F.coalesce(F.col(text), F.lit(""))
    return (docs.withColumn("_ord", F.coalesce(F.col(key).cast("long"), F.lit(_LAST)))
            .withColumn("_sha", F.unhex(F.sha2(body, 256))).withColumn("_tag", F.hash("_sha"))
            .withColumn("_bytes", F.octet_length(body).cast("long")))


def marks(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(_ord, _tag, spans): the byte spans to remove, for documents that have any."""
    ship_package(docs.sparkSession)
    own = keyed(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key", "_text")
    heads = stored(own.select("_ord", "_sha", "_tag", "_bytes"), "suffix-heads", clean_up=True)
    firsts = stored(heads.groupBy("_sha").agg(F.min("_ord").alias("first"), F.count(F.lit(1)).alias("n"))
                    .filter("n > 1"), "suffix-firsts", clean_up=True)
    copies = stored(join_hot(heads, firsts, ["_sha"], heads.count(), "n").filter("_ord > first")
                    .select("_ord", "_sha", "_tag", "_bytes").distinct(), "suffix-copies", clean_up=True)
    once = own.join(small(copies).select("_ord", "_sha"), ["_ord", "_sha"], "left_anti")
    body = once.select(F.col("_ord").alias("ord"), F.col("_tag").alias("tag"), F.coalesce("_text", F.lit("")).alias("text"))
    rows = body.mapInArrow(_anchor_rows(length), "h long, ord long, tag int, several boolean, times long, local binary")
    hot_times = max(HOT, int(heads.count() * HOT_SHARE))
    same = Window.partitionBy("h")
    flagged = (
        rows.withColumn("lo", F.min("ord").over(same)).withColumn("hi", F.max("ord").over(same))
        .withColumn("any", F.max(F.col("several").cast("int")).over(same)).withColumn("all", F.sum("times").over(same))
        .filter("lo < hi or any = 1 or local is not null")
        .select("ord", "tag", F.when(F.col("local").isNull(), F.col("h")).alias("h"), "local",
                (F.col("all") > hot_times).alias("hot"))
    )
    lists = stored(flagged.groupBy("ord", "tag").agg(
        F.collect_list("h").alias("hs"), F.collect_list("local").alias("locals"),
        F.collect_list(F.when(F.col("hot"), F.col("h"))).alias("hots")), "suffix-lists", clean_up=True)
    # as many as the anchors of a document over HOT_SHARE: a bounded number
    hot = {r[0] % 2**64 for r in lists.select(F.explode("hots")).distinct().collect()}
    spans = (
        body.join(lists.select("ord", "tag", "hs", "locals"), ["ord", "tag"])
        .mapInArrow(_surroundings(length, hot), _COLUMNS)
        .repartition("key").sortWithinPartitions("key", "ord", "start")
        .mapInArrow(_mark(length), "ord long, tag int, start long, end long")
        .groupBy("ord", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        .mapInArrow(_merge, "ord long, tag int, spans array<struct<start: long, end: long>>")
    )
    whole = copies.filter(F.col("_bytes") >= length).select(
        "_ord", "_tag", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("_bytes").alias("end"))).alias("spans"))
    return stored(spans.select(F.col("ord").alias("_ord"), F.col("tag").alias("_tag"), "spans").unionByName(whole), "suffix-marks", clean_up=True)


def _cut(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """(bytes that stay, bytes removed, number of maximal removed runs)."""
    runs = merge_spans([(s["start"], s["end"]) for s in spans or []])
    at, keep = 0, []
    for a, e in runs:
        keep.append(text[at:a])
        at = e
    keep.append(text[at:])
    return b"".join(keep), sum(e - a for a, e in runs), len(runs)


def _joined(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    found = marks(docs, key, text, length)
    spans = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    if spans[0] + spans[1] <= MARKS:
        found = F.broadcast(found)
    return keyed(docs, key, text).drop("_sha", "_bytes").join(found, ["_ord", "_tag"], "left")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) per document.

    Null and short texts lose nothing; equal texts of one key keep what no smaller key has;
    a null key comes last.  Other columns are not read; empty input gives no rows."""
    def run(batches):
        for b in batches:
            rows = [_cut(t, s) + (len(t),) for t, s in zip(_bytes(b.column("text")), b.column("spans").to_pylist())]
            kept, removed, runs, size = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return _joined(own, "key", "text", length).select("key", "text", "spans").mapInArrow(
        run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; no row goes.  Characters that a
    removed run cuts through go as a whole.  Null texts stay null; equal texts of one key keep what
    no smaller key has; other columns stay, whatever their names; empty input gives no rows."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else _cut(t.encode("utf-8", "surrogatepass"), list(s))[0].decode("utf-8", "ignore")
                          for t, s in zip(texts, spans)])

    name = "`{}`".format
    rest = [c for c in docs.columns if c != text]
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.struct(*map(name, rest)).alias("rest"))
    return _joined(own, "key", "text", length).select(
        *(cut("text", "spans").alias(c) if c == text else F.col(f"rest.{name(c)}") for c in docs.columns))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
