"""Suffix-array de-duplication: removes every byte that a 50-byte string covers
which also starts in a document with a smaller doc_id.

The suffixes of all documents, cut at WIDTH bytes, are sorted by a distributed
merge sort that is aware of common prefixes:

1. Texts are dealt into runs by document.  Equal texts are found first, by
   digest: all but the smallest doc_id of a text go entirely (if they have
   WIDTH bytes), and take no further part.
2. *Which suffixes matter* (the duplicate detection by fingerprints that
   prefix-doubling string sorters use).  Of every WIDTH-byte window the
   smallest of the hashes of its K-byte strings is its anchor; equal windows
   have equal anchors at equal places.  Runs exchange fingerprints of their
   anchors, packed and sorted, and learn which of them another document has
   too.  A suffix whose anchor is in one document only cannot match and is
   never sent.
3. *Strings.*  For each shared anchor a run sends the suffix that begins there,
   cut at WIDTH bytes, and after it the bytes before the anchor, nearest first:
   together they hold every window of the anchor.  Each run sorts its strings,
   keeps one of each with its smallest document, and front-codes them: the
   length of the prefix shared with the string before, and the rest.
4. *Merge.*  A reducer merges the runs of its share with a loser tree that
   compares strings from the first byte not known to be equal: of two strings
   with different common prefixes with the last winner the longer prefix wins
   without reading a byte, and equal ones are compared only beyond it.  The
   merged order comes with the common prefixes of neighbours, so strings that
   agree on a window's bytes from the anchor on stand together; among them the
   bytes before the anchor tell which windows are equal.  Each run gets, per
   string, one bit for every window that a smaller document has too.
5. Runs turn bits into covered bytes, merge them into spans and cut them out.

The texts cross the network once: every pass reads the same exchange.  What a
run has learned travels on with what it sends, so no pass is computed twice.

Shares are dealt by a hash of the anchor; copies meet there as one string per
run.  Runs and shares are bounded by bytes (``RUN_BYTES``), their number grows
with the input.

Edge cases: a null text is empty; texts under WIDTH bytes lose nothing; a null
doc_id is compared with nothing and loses nothing, and rows that repeat a
doc_id do not count as smaller than one another; an empty table gives an empty
result; extra columns are left out.  One document must fit a task.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import read, saved
from corpuslab.llm.textnp import MUL, mixed, span_hashes

WIDTH = 50
K = 28
SIDE = WIDTH - K                # bytes on either side of an anchor that its windows reach
RUN_BYTES = 4 << 20             # of text in a run, about
STEP = 1 << 20                  # windows whose anchors are sought at once
ROW = WIDTH + SIDE + 2          # bytes of a string: from the anchor on, before it, both lengths
ALL = np.uint32((1 << SIDE + 1) - 1)
RANGES = 16                     # key ranges in which a share's fingerprints are compared


def _rolling(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-byte string of ``buf``, by doubling."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = (buf.astype(np.uint64) + np.uint64(1)) * np.uint64(MUL)
    out, have, size = None, 0, 1
    while True:
        if k & size:
            out = h[have:have + n].copy() if out is None else out[:n] * np.uint64(pow(MUL, size, 1 << 64)) + h[have:have + n]
            have += size
        if have == k:
            return mixed(out) | np.uint64(1)
        h = h[:-size] * np.uint64(pow(MUL, size, 1 << 64)) + h[size:]
        size *= 2


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[:len(x) - (w - size)], x[w - size:]) if w > size else x


class Run:
    """The documents of a run, smallest doc_id first, as one array of bytes."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = ids[order] if len(ids) else ids
        self.texts = [texts[i] for i in order]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.off = np.r_[0, np.cumsum(self.size)]
        self.buf = np.frombuffer(b"".join(self.texts), np.uint8)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, hash) of every anchor."""
        n = max(0, len(self.buf) - WIDTH + 1)
        at, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a in range(0, n, STEP):
            b = min(n, a + STEP)
            h = _rolling(self.buf[a:b + WIDTH - 1], K)     # of strings that start in a .. b + SIDE - 1
            low = _slide(h, SIDE + 1, np.minimum)
            place = np.arange(a, b)
            end = self.off[np.searchsorted(self.off, place, side="right")]
            low[place + WIDTH > end] = 0                   # windows do not cross documents
            # an anchor is the smallest of some window: the largest of its windows' smallest is its own hash
            hit = h == _slide(np.r_[np.zeros(SIDE, np.uint64), low, np.zeros(SIDE, np.uint64)], SIDE + 1, np.maximum)
            at.append(np.flatnonzero(hit) + a)
            keys.append(h[hit])
        at, first = np.unique(np.concatenate(at), return_index=True)
        return at, np.concatenate(keys)[first]

    def place(self, at: np.ndarray) -> None:
        """Take ``at`` as the anchors to work on."""
        self.at = at
        self.doc = np.searchsorted(self.off, at, side="right") - 1
        self.left = np.minimum(SIDE, at - self.off[self.doc])
        self.right = np.minimum(WIDTH, self.off[self.doc + 1] - at)

    def groups(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys, 1 for those that two documents of the run have)."""
        keys, where = np.unique(key, return_inverse=True)
        some_doc = np.zeros(len(keys), np.int64)
        some_doc[where] = self.doc
        shared = np.zeros(len(keys), np.uint8)
        shared[where[some_doc[where] != self.doc]] = 1
        return keys, shared


# -- step 2: fingerprints ---------------------------------------------------------------------

def _pack(keys: np.ndarray, shared: np.ndarray) -> bytes:
    """48 bits of sorted keys and their flags, laid out by byte so that they compress.

    Keys that agree in 48 bits by chance only cost strings that match nothing.
    """
    top = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return np.concatenate([top, shared[:, None]], axis=1).T.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = np.frombuffer(blob, np.uint8).reshape(7, -1).T
    k = np.zeros((len(m), 8), np.uint8)
    k[:, :6] = m[:, :6]
    return k.view(">u8").reshape(-1).astype(np.uint64), m[:, 6]


def share_of(keys: np.ndarray, shares: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)


def _fingerprints(shares: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        me, r, _ = _load(left, right)
        out: dict[str, list] = {"share": [], "run": [], "blob": []}
        if r is not None:
            at, key = r.anchors()
            r.place(at)
            keys, shared = r.groups(key)
            s = share_of(keys, shares)                     # keys are sorted, so shares are runs of keys
            cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
            for a, b in zip(cut, cut[1:]):
                out["share"].append(int(s[a]))
                out["run"].append(me)
                out["blob"].append(_pack(keys[a:b], shared[a:b]))
        return pa.table({"share": pa.array(out["share"], pa.int64()), "run": pa.array(out["run"], pa.int64()), "blob": pa.array(out["blob"], pa.binary())})
    return run


def _compare(table: pa.Table) -> pa.Table:
    """Flags of every run's keys, after all runs of a share are seen.

    Keys are sorted in every run, so a share is compared key range by key range and only the
    fingerprints themselves are held whole.
    """
    parts = [_unpack(b.as_buffer()) for b in table.column("blob")]
    out = [np.zeros(len(p[0]), np.uint8) for p in parts]
    longest = max((p[0] for p in parts), key=len)
    bounds = longest[np.arange(1, RANGES) * len(longest) // RANGES]
    cuts = [np.r_[0, np.searchsorted(p[0], bounds), len(p[0])] for p in parts]
    for j in range(RANGES):
        some = [slice(c[j], c[j + 1]) for c in cuts]
        key, flag = (np.concatenate([p[i][x] for p, x in zip(parts, some)]) for i in range(2))
        if not len(key):
            continue
        o = np.argsort(key, kind="stable")
        k, f = key[o], flag[o]
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        n = np.diff(np.r_[at, len(k)])
        flag[o] = np.repeat(np.bitwise_or.reduceat(f, at) | (n > 1), n)
        for whole, x, mine in zip(out, some, np.split(flag, np.cumsum([x.stop - x.start for x in some])[:-1])):
            whole[x] = mine
    return pa.table({"run": table.column("run"), "kind": pa.array([FLAGS] * len(table), pa.int32()), "share": table.column("share"),
                     "bits": pa.array([x.tobytes() for x in out], pa.binary())})


# -- steps 3 and 4: sorted, front-coded runs and their merge ----------------------------------

def _strings(r: Run) -> tuple[np.ndarray, np.ndarray]:
    """(rows, share keys) of the run's shared anchors.

    A row is the suffix that begins at the anchor, padded with zeros, the bytes
    before the anchor, nearest first, padded with zeros, and both lengths.
    """
    view = np.lib.stride_tricks.sliding_window_view
    buf = np.r_[np.zeros(SIDE, np.uint8), r.buf, np.zeros(WIDTH, np.uint8)]
    m = np.empty((len(r.at), ROW), np.uint8)
    m[:, :WIDTH] = view(buf, WIDTH)[r.at + SIDE]
    m[:, WIDTH:-2] = view(buf, SIDE)[r.at][:, ::-1]
    m[:, -2], m[:, -1] = r.right, r.left
    m[:, :WIDTH][np.arange(WIDTH)[None, :] >= r.right[:, None]] = 0
    m[:, WIDTH:-2][np.arange(SIDE)[None, :] >= r.left[:, None]] = 0
    return m, span_hashes(r.buf, r.at, r.at + K)


def _sorted_groups(rows: np.ndarray, keys: np.ndarray, shares: int):
    """(order, share of each, whether it begins a group of equal strings) with strings sorted inside shares."""
    s = share_of(keys, shares)
    text = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").reshape(-1) if len(rows) else np.zeros(0, "S1")
    # all rows have one length, so comparing without trailing zeros loses nothing
    o = np.lexsort((text, s)) if len(rows) else np.zeros(0, np.int64)
    t, s = rows[o], s[o]
    new = np.r_[True, (t[1:] != t[:-1]).any(axis=1) | (s[1:] != s[:-1])][:len(o)]
    return o, s, new


def _front_coded(rows: np.ndarray) -> tuple[bytes, bytes]:
    """(prefix lengths shared with the row before, the rests) of sorted rows."""
    n, w = rows.shape
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = rows[1:] != rows[:-1]
        lcp[1:] = differ.argmax(axis=1)
    keep = np.arange(w)[None, :] >= lcp[:, None]
    return lcp.astype(np.uint8).tobytes(), rows[keep].tobytes()


def _blobs(r: Run, shares: int, me: int, out: dict) -> None:
    rows, key = _strings(r)
    o, s, new = _sorted_groups(rows, key, shares)
    if not len(o):
        return
    least = np.minimum.reduceat(r.doc[o], np.flatnonzero(new))
    rows, s = rows[o][new], s[new]
    cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
    pack = zstandard.ZstdCompressor().compress
    for a, b in zip(cut, cut[1:]):
        lcp, rest = _front_coded(rows[a:b])
        _row(out, int(s[a]), me, STRINGS, pack(lcp), pack(rest), pack(r.ids[least[a:b]].astype(np.int64).tobytes()))


def _lost(r: Run, shares: int, bits: bytes) -> np.ndarray:
    """Of each shared anchor: a bit for every window that a smaller document has, in this run or by the bits from the shares."""
    rows, key = _strings(r)
    o, _, new = _sorted_groups(rows, key, shares)
    out = np.zeros(len(o), np.uint32)
    if len(o):
        g = np.cumsum(new) - 1
        least = np.minimum.reduceat(r.doc[o], np.flatnonzero(new))
        # what the run's smallest document keeps, the others lose to it
        out[o] = np.where(r.ids[r.doc[o]] > r.ids[least[g]], ALL, np.frombuffer(bits, "<u4")[g])
    return out


SENT = "share long, run long, kind int, lcp binary, rest binary, least binary"
FLAGS, WINDOWS, STRINGS = 0, 1, 9


def _row(out: dict, *values) -> None:
    for c, v in zip(out, values):
        out[c].append(v)


def _sent(out: dict) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})


def _new() -> dict:
    return {c: [] for c in ("share", "run", "kind", "lcp", "rest", "least")}


def _send(shares: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        me, r, (flags, _) = _load(left, right)
        out = _new()
        if r is not None:
            at, key = r.anchors()
            mine = np.frombuffer(flags, np.uint8)[np.unique(key, return_inverse=True)[1]] if len(at) else np.zeros(0, np.uint8)
            r.place(at[mine > 0])
            # what the run knows travels on beside its strings, in a share of its own
            _row(out, -1 - me, me, FLAGS, None, r.at.astype("<i8").tobytes(), None)
            _blobs(r, shares, me, out)
        return _sent(out)
    return run


def _common(x: bytes, y: bytes) -> int:
    """Bytes that two different strings of one length have in common at their start."""
    return len(x) - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7 >> 3)


def merged(runs: list[tuple[bytes, bytes]]):
    """(run, number in the run, bytes shared with the string before it in the merged order) of all strings in order.

    A loser tree over front-coded runs.  Each run's current string is known by
    the length of its common prefix with the last string that won.  When two
    meet, the longer prefix is smaller; only with equal prefixes are bytes
    compared, from there on, and the loser keeps its common prefix with the
    winner.
    """
    n = len(runs)
    size = 1
    while size < n:
        size *= 2
    DONE = -1
    at, pos = [0] * size, [0] * size
    total = [len(runs[i][0]) if i < n else 0 for i in range(size)]
    cur: list = [b""] * size
    lcp = [0] * size

    def first(i):
        if i >= n or not total[i]:
            lcp[i] = DONE
            return
        cur[i], pos[i] = runs[i][1][:ROW], ROW

    def beats(i, j):
        """Whether run i's string comes before run j's; the loser's prefix becomes its prefix with the winner."""
        a, b = lcp[i], lcp[j]
        if a != b:
            return a > b                                   # also for exhausted runs, whose prefix is -1
        if a == DONE:
            return True
        x, y = cur[i], cur[j]
        if a < ROW and x[a] != y[a]:                       # most differ in the first byte not known
            if x[a] < y[a]:
                lcp[j] = a
                return True
            lcp[i] = a
            return False
        x, y = x[a:], y[a:]
        if x == y:
            lcp[max(i, j)] = ROW
            return i < j
        k = a + _common(x, y)
        if x < y:
            lcp[j] = k
            return True
        lcp[i] = k
        return False

    for i in range(size):
        first(i)
    tree = [0] * size
    winners = list(range(size))
    level = winners
    base = size
    while base > 1:                                        # play all matches once
        base //= 2
        nxt = []
        for k in range(base):
            i, j = level[2 * k], level[2 * k + 1]
            if beats(i, j):
                tree[base + k] = j
                nxt.append(i)
            else:
                tree[base + k] = i
                nxt.append(j)
        level = nxt
    w = level[0]
    shared = 0
    while lcp[w] != DONE:
        yield w, at[w], shared
        last = cur[w]
        at[w] += 1
        if at[w] >= total[w]:
            lcp[w] = DONE
        else:
            p = runs[w][0][at[w]]
            cur[w] = last[:p] + runs[w][1][pos[w]:pos[w] + ROW - p]
            pos[w] += ROW - p
            lcp[w] = p
        node = (size + w) // 2
        while node:
            o = tree[node]
            a, b = lcp[w], lcp[o]
            if a == b:
                if not beats(w, o):
                    tree[node], w = w, o
            elif b > a:
                tree[node], w = w, o
            node //= 2
        shared = lcp[w]


def _tails(lcp: bytes, rest: bytes) -> np.ndarray:
    """What every string of a front-coded run has after its first WIDTH bytes."""
    p = np.frombuffer(lcp, np.uint8).astype(np.int64)
    data = np.frombuffer(rest, np.uint8)
    at, i = np.cumsum(ROW - p) - ROW, np.arange(len(p))    # at + c: where a string's byte c is, if it is spelt out
    out = np.empty((len(p), ROW - WIDTH), np.uint8)
    for c in range(WIDTH, ROW):
        out[:, c - WIDTH] = data[at[np.maximum.accumulate(np.where(p <= c, i, 0))] + c]
    return out


def lost_windows(shared: np.ndarray, tails: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Bit j of each string: a string of a smaller document has its window j too.

    Strings are distinct and in order; ``shared`` is the common prefix with the
    one before.  Window j has K + j bytes from the anchor on, which strings
    between two short prefixes have in common, and SIDE - j bytes before it.
    """
    out = np.zeros(len(docs), np.uint32)
    anchor = np.cumsum(shared < K)
    some = np.flatnonzero(np.bincount(anchor)[anchor] > 1)
    if not len(some):
        return out
    shared, tails, docs = shared[some], tails[some], docs[some]
    right, left = tails[:, SIDE], tails[:, SIDE + 1]
    back = np.ascontiguousarray(tails[:, :SIDE])
    o = np.argsort(back.view(f"S{SIDE}").reshape(-1), kind="stable")
    differ = back[o][1:] != back[o][:-1]
    agree = np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), SIDE)]  # with the one before, by the bytes before the anchor
    lost, before = np.zeros(len(some), np.uint32), np.zeros(len(some), np.int64)
    for j in range(SIDE + 1):
        ok = np.flatnonzero((right >= K + j) & (left >= SIDE - j))
        if not len(ok):
            continue
        before[o] = np.cumsum(agree < SIDE - j)
        key = (np.cumsum(shared < K + j) * (len(some) + 1) + before)[ok]
        by = np.argsort(key, kind="stable")
        k, d = key[by], docs[ok][by]
        g = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        later = np.repeat(np.minimum.reduceat(d, g), np.diff(np.r_[g, len(d)])) < d
        lost[ok[by[later]]] |= np.uint32(1 << j)
    out[some] = lost
    return out


def _merge(table: pa.Table) -> pa.Table:
    """Per run, the bits of each of its strings: which windows a run has from a smaller document than this run's smallest."""
    if table.column("share")[0].as_py() < 0:               # what a run knows goes back to it
        return pa.table({"run": table.column("run"), "kind": table.column("kind"), "share": table.column("share"), "bits": table.column("rest")})
    unpack = zstandard.ZstdDecompressor().decompress
    lcps, rests, ids = ([unpack(x.as_buffer()) for x in table.column(c)] for c in ("lcp", "rest", "least"))
    least = [np.frombuffer(x, np.int64) for x in ids]
    who, number, shared = array("i"), array("i"), bytearray()
    for w, i, p in merged(list(zip(lcps, rests))):
        who.append(w)
        number.append(i)
        shared.append(p)
    base = np.r_[0, np.cumsum([len(x) for x in least])]
    place = base[np.frombuffer(who, np.int32)] + np.frombuffer(number, np.int32)
    shared = np.frombuffer(shared, np.uint8)
    new = shared < ROW
    new[0] = True
    docs, g, of = np.concatenate(least)[place], np.flatnonzero(new), np.cumsum(new) - 1
    low = np.minimum.reduceat(docs, g)                     # of every distinct string
    tails = np.concatenate([_tails(*x) for x in zip(lcps, rests)])[place[g]]
    lost = lost_windows(np.r_[0, shared[g][1:]], tails, low)
    bits = np.zeros(len(docs), "<u4")
    bits[place] = np.where(low[of] < docs, ALL, lost[of])
    return pa.table({"run": table.column("run"), "kind": pa.array([WINDOWS] * len(table), pa.int32()), "share": table.column("share"),
                     "bits": pa.array([x.tobytes() for x in np.split(bits, base[1:-1])], pa.binary())})


# -- step 5: what goes -------------------------------------------------------------------------

def _cut(shares: int, with_kept: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, r, (state, bits) = _load(left, right)
        out: dict[str, list] = {c: [] for c in ("holder", "sha", "n_removed", "n_spans", "kept_sha256", "kept")[:6 if with_kept else 5]}
        if r is None:
            r = Run(np.zeros(0, np.int64), [])
        r.place(np.frombuffer(state, "<i8").astype(np.int64))
        # of a string's windows those that its document holds whole
        mine = (1 << r.right - K + 1) - (1 << SIDE - r.left)
        lost = _lost(r, shares, bits) & mine
        whole = lost == mine
        first, end = [(r.at - r.left)[whole]], [(r.at + r.right)[whole]]
        for j in range(SIDE + 1):
            first.append(r.at[~whole & (lost >> j & 1 > 0)] - (SIDE - j))
            end.append(first[-1] + WIDTH)
        gone = (np.bincount(np.concatenate(first), minlength=len(r.buf) + 1)
                - np.bincount(np.concatenate(end), minlength=len(r.buf) + 1))
        covered = np.cumsum(gone[:-1]) > 0
        for i, t in enumerate(r.texts):
            c = covered[r.off[i]:r.off[i + 1]]
            kept = r.buf[r.off[i]:r.off[i + 1]][~c].tobytes()
            for name, v in zip(out, (int(r.ids[i]), hashlib.sha256(t).hexdigest(), int(c.sum()),
                                     int((np.diff(np.r_[0, c.astype(np.int8)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept)):
                out[name].append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds)})
    return run


def _load(left: pa.Table, right: pa.Table):
    """(run number, Run, (flags of its distinct keys or its shared anchors, bits of its distinct strings)).

    ``right`` names the run's documents that take part (kind -1, doc_id) and has
    what came back from the shares, in their order.
    """
    kind = right.column("kind").to_numpy()
    part = set(right.column("doc_id").filter(pa.array(kind == -1)).to_pylist())
    back = []
    for k in (FLAGS, WINDOWS):
        some = right.filter(pa.array(kind == k)).sort_by("share")
        back.append(b"".join(some.column("bits").to_pylist()))
    unpack = zstandard.ZstdDecompressor().decompress
    ids, texts = left.column("doc_id").to_pylist(), [unpack(x) for x in left.column("data").to_pylist()]
    some = sorted({(d, t): i for i, (d, t) in enumerate(zip(ids, texts)) if d in part}.values())  # a repeated row is the same document
    me = left.column("run")[0].as_py() if left.num_rows else -1
    return me, Run(np.array([ids[i] for i in some], np.int64), [texts[i] for i in some]) if some else None, back


def _compressed(batches):
    pack = zstandard.ZstdCompressor().compress
    for batch in batches:
        data = pa.array([pack(x) for x in batch.column("data").to_pylist()], pa.binary())
        yield pa.record_batch([batch.column("run"), batch.column("doc_id"), data], names=["run", "doc_id", "data"])


def removed(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row of ``docs`` (doc_id, text)."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    facts = saved(d.select("doc_id", F.sha2("data", 256).alias("sha"), F.octet_length("data").cast("long").alias("n_bytes")), "suffix-facts")
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    runs = max(4, total // RUN_BYTES)
    shares = max(4, runs // 3)                             # a share compares about 12 MB of text
    of = F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("long")
    first = facts.groupBy("sha").agg(F.min("doc_id").alias("holder"))
    part = saved(first.where("holder is not null").select(F.col("holder").alias("doc_id")).distinct()
                 .select(of.alias("run"), F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("share"), "doc_id", F.lit(None).cast("binary").alias("bits")),
                 "suffix-part")
    # the texts cross the network once: all passes below read the same exchange
    dealt = (d.where("doc_id is not null").select(of.alias("run"), "doc_id", "data")
             .mapInArrow(_compressed, "run long, doc_id long, data binary"))

    def by_run(side: DataFrame, f, schema: str) -> DataFrame:
        return dealt.groupBy("run").cogroup(side.groupBy("run")).applyInArrow(f, schema)

    def back(df: DataFrame, f) -> DataFrame:
        df = df.groupBy("share").applyInArrow(f, "run long, kind int, share long, bits binary")
        return part.unionByName(df.select("run", "kind", "share", F.lit(None).cast("long").alias("doc_id"), "bits"))
    prints = by_run(part, _fingerprints(shares), "share long, run long, blob binary")
    strings = by_run(back(prints, _compare), _send(shares), SENT)
    gone = by_run(back(strings, _merge), _cut(shares, with_kept),
                  "holder long, sha string, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
    # a copy of a smaller document goes entirely if it has WIDTH bytes, else it stays as it is
    rows = facts.join(first, "sha").join(gone, ["sha", "holder"], "left")
    copy = F.col("doc_id") > F.col("holder")
    whole = F.when(copy & (F.col("n_bytes") >= WIDTH), F.lit(1)).when(copy | F.col("doc_id").isNull(), F.lit(0))
    out = rows.select(
        "doc_id", "n_bytes", F.coalesce(whole * F.col("n_bytes"), "n_removed").cast("long").alias("n_removed"),
        F.coalesce(whole, "n_spans").cast("long").alias("n_spans"),
        F.when(whole == 1, F.sha2(F.lit("").cast("binary"), 256)).when(whole == 0, F.col("sha")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(whole.isNull(), F.col("kept")).when(whole == 1, F.lit("").cast("binary")).alias("kept")] if with_kept else []))
    return out


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated 50-byte strings take out of ``documents``."""
    return removed(read(spark, sf_dir, "documents"))
