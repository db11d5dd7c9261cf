"""ROUGE scores.

Definition (the public ``rouge`` scorer the reference calls): each text is split
on '.', empty parts are dropped, whitespace inside a part is collapsed, and the
parts' words (split on single spaces) are concatenated; case is kept.

* ROUGE-N: sets of n-grams over the concatenated words; p = |H & R| / |H|,
  r = |H & R| / |R| (0 on an empty denominator), f = 2 p r / (p + r + 1e-8).
  Pure column expressions.
* ROUGE-L (summary level): for every reference sentence, the LCS token set with
  each hypothesis sentence joins one running union; the union's growth summed
  over reference sentences, divided by the distinct reference words (r) and the
  distinct hypothesis words (p); same f.  The LCS back-trace has no column
  expression, so it runs as an Arrow ``pandas_udf`` over whole batches.

An empty hypothesis or reference (no non-empty part) gives NULL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions.text import _c, let, ngrams, rouge_words

EPS = 1e-8


def _n_parts(c) -> Column:
    return F.size(F.filter(F.split(_c(c), r"\."), lambda s: F.length(s) > 0))


def rouge_n(hyp, ref, n: int = 1) -> Column:
    """ROUGE-N F score of two text columns."""
    def body(v):
        h, r = v["h"], v["r"]
        ov = F.size(F.array_intersect(h, r))
        p = F.when(F.size(h) > 0, ov / F.size(h)).otherwise(F.lit(0.0))
        rc = F.when(F.size(r) > 0, ov / F.size(r)).otherwise(F.lit(0.0))
        return let({"p": p, "r": rc}, lambda x: F.lit(2.0) * ((x["p"] * x["r"]) / (x["p"] + x["r"] + F.lit(EPS))))
    grams = lambda c: F.array_distinct(ngrams(rouge_words(c), n))
    score = let({"h": grams(hyp), "r": grams(ref)}, body)
    return F.when((_n_parts(hyp) > 0) & (_n_parts(ref) > 0), score)


# --- ROUGE-L (Python, Arrow batches) ---------------------------------------
def _sentences(text: str) -> list[list[str]]:
    return [" ".join(p.split()).split(" ") for p in text.split(".") if len(p) > 0]


def lcs_words(x: list[str], y: list[str]) -> set[str]:
    """Words on one LCS path (back-trace: diagonal on a match, else up when
    strictly larger, else left).

    A row of the length table is one integer: bit j is clear where the row grows
    between columns j and j + 1.  A row follows from the one above with an
    addition, and the back-trace needs only these bits: without a match the way
    up is strictly larger just where the row grows.
    """
    places: dict[str, int] = {}
    for j, w in enumerate(y):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(y)) - 1
    v, rows = full, []
    for w in x:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j, out = len(x) - 1, len(y) - 1, set()
    while i >= 0 and j >= 0:
        if x[i] == y[j]:
            out.add(x[i])
            i, j = i - 1, j - 1
        elif rows[i] >> j & 1:
            j -= 1
        else:
            i -= 1
    return out


def rouge_l_text(hyp: str | None, ref: str | None) -> float | None:
    if hyp is None or ref is None:
        return None
    hs, rs = _sentences(hyp), _sentences(ref)
    if not hs or not rs:
        return None
    m = len({w for s in rs for w in s})
    n = len({w for s in hs for w in s})
    union: set[str] = set()
    hits = 0
    for r in rs:
        before = len(union)
        for h in hs:
            union |= lcs_words(r, h)
        hits += len(union) - before
    r_, p_ = hits / m, hits / n
    return 2.0 * ((p_ * r_) / (p_ + r_ + EPS))


@F.pandas_udf(T.DoubleType())
def rouge_l(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """Summary-level ROUGE-L F (see module docstring)."""
    return pd.Series([rouge_l_text(h, r) for h, r in zip(hyp, ref)], dtype="float64")


# --- sentence-pair ROUGE-L, vectorised over the pairs of one document -------
#: Bytes that the tables of a batch of pairs may take.
BATCH_BYTES = 32 << 20


def _path_words(X: np.ndarray, Y: np.ndarray, lx: np.ndarray, ly: np.ndarray) -> np.ndarray:
    """Distinct reference words on the back-traced LCS path of every pair.

    X (pairs, mx) reference ids padded with -1, Y (pairs, my) hypothesis ids padded
    with -2.  As in ``lcs_words`` a row of a pair's length table is a bit
    vector, here of 64-bit words whose additions carry over.
    """
    p, mx = X.shape
    my = Y.shape[1]
    n_words = (my + 63) // 64
    one = np.uint64(1)
    V = np.full((n_words, p), ~np.uint64(0))
    rows = np.empty((mx, n_words, p), np.uint64)
    padded = np.zeros((p, n_words * 64), np.uint8)
    for i in range(mx):
        padded[:, :my] = Y == X[:, i:i + 1]
        M = np.packbits(padded, axis=1, bitorder="little").view("<u8").T
        carry = np.zeros(p, np.uint64)
        for k in range(n_words):
            v = V[k]
            u = v & M[k]
            t = v + u
            total = t + carry
            carry = ((t < v) | (total < t)).astype(np.uint64)
            V[k] = total | (v & ~M[k])
        rows[i] = V
    on_path = np.zeros((p, mx), bool)
    i, j = lx - 1, ly - 1
    live = np.flatnonzero((i >= 0) & (j >= 0))
    while len(live):
        a, b = i[live], j[live]
        match = X[live, a] == Y[live, b]
        stay = (rows[a, b >> 6, live] >> (b & 63).astype(np.uint64)) & one == one      # the row does not grow here: left
        on_path[live[match], a[match]] = True
        i[live[match | ~stay]] -= 1
        j[live[match | stay]] -= 1
        live = live[(i[live] >= 0) & (j[live] >= 0)]
    # a word is on the path if any of its places is
    ids = np.sort(np.where(on_path, X, -1), axis=1)
    return ((ids >= 0) & np.c_[np.ones((p, 1), bool), ids[:, 1:] != ids[:, :-1]]).sum(1).astype(np.float64)


def _lcs_lengths(flat: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """LCS length of every pair of sentences, as in ``_path_words`` but without rows kept and traced back.

    Sentence s is ``flat[at[s]:at[s + 1]]``.  Where a word stands in a hypothesis is a
    table of bit vectors over the references' words, made for some hypotheses at a
    time.  A length holds for both orders, so a pair that is there in both is worked on once.
    """
    lens = np.diff(at)
    _, pick, back = np.unique(np.minimum(left, right) * len(lens) + np.maximum(left, right), return_index=True, return_inverse=True)
    x, y = right[pick], left[pick]
    known = np.zeros(int(flat.max()) + 1, bool)            # the words of references, numbered
    for s in np.unique(x):
        known[flat[at[s]:at[s + 1]]] = True
    width = int(known.sum())
    column = np.where(known, np.cumsum(known) - 1, -1)
    out = np.empty(len(x), np.int64)
    order = np.lexsort((-lens[x], y, -lens[y]))            # a hypothesis's pairs together, the longest hypotheses first
    x, y = x[order], y[order]
    heads = np.flatnonzero(np.r_[True, y[1:] != y[:-1]])
    ends = np.r_[heads[1:], len(y)]
    h = 0
    while h < len(heads):
        n_words = int(lens[y[heads[h]]] + 63) // 64
        past = min(len(heads), h + max(1, BATCH_BYTES // (width * n_words * 8)))
        limit = heads[h] + max(1, BATCH_BYTES // (n_words * 64))
        past = max(h + 1, min(past, int(np.searchsorted(ends, limit, "right"))))
        hyps = y[heads[h:past]]
        table = np.zeros((n_words, len(hyps) * width), np.uint64)
        n = lens[hyps]
        slot = np.repeat(np.arange(len(hyps)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        col = column[flat[at[hyps][slot] + place]]
        hit = col >= 0
        np.bitwise_or.at(table, (place[hit] >> 6, slot[hit] * width + col[hit]), np.uint64(1) << (place[hit] & 63).astype(np.uint64))
        pairs = np.arange(heads[h], ends[past - 1])
        pairs = pairs[np.argsort(-lens[x[pairs]], kind="stable")]
        refs, base = x[pairs], (np.searchsorted(heads, pairs, "right") - 1 - h) * width
        left_of = np.searchsorted(-lens[refs], -np.arange(int(lens[refs[0]])), "left")   # pairs whose reference has a word i
        V = np.full((n_words, len(pairs)), ~np.uint64(0))
        for i, m in enumerate(left_of.tolist()):
            cell = base[:m] + column[flat[at[refs[:m]] + i]]
            carry = np.uint64(0)
            for k in range(n_words):
                v, mask = V[k, :m], table[k, cell]
                u = v & mask
                t = v + u
                total = t + carry
                if k + 1 < n_words:
                    carry = ((t < v) | (total < t)).astype(np.uint64)
                V[k, :m] = total | (v & ~mask)
        out[order[pairs]] = 64 * n_words - np.bitwise_count(V).sum(0, dtype=np.int64)
        h = past
    return out[back.ravel()]


def pair_rouge_l(words: list[list[str]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """ROUGE-L F of every pair (hyp = words[left[p]], ref = words[right[p]]) of
    single-part sentences.  If one of them repeats no word, the words on any path are all
    different, so their number is the LCS length; the others are traced back."""
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in s], np.int32) for s in words]
    lens = np.array([len(v) for v in ids])
    distinct = np.array([len(set(v.tolist())) for v in ids], dtype=np.float64)
    at = np.r_[0, np.cumsum(lens)]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    once = distinct == lens
    simple = once[left] | once[right]
    hits = np.empty(len(left), dtype=np.float64)
    if simple.any():
        hits[simple] = _lcs_lengths(flat, at, left[simple], right[simple])
    if not simple.all():
        hits[~simple] = _traced(flat, at, left[~simple], right[~simple])
    r, pr = hits / distinct[right], hits / distinct[left]
    return 2.0 * ((pr * r) / (pr + r + EPS))


def _traced(flat: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``_path_words`` of every pair: pairs are sorted by length and cut into batches whose
    tables take at most ``BATCH_BYTES`` (or are a single pair's)."""
    lens = np.diff(at)
    order = np.lexsort((lens[left], lens[right]))
    out = np.empty(len(left), dtype=np.float64)

    def rows_of(which: np.ndarray, pad: int) -> np.ndarray:
        n = lens[which]
        made = np.full((len(which), int(n.max())), pad, np.int32)
        cell = np.arange(made.shape[1])[None, :] < n[:, None]
        made[cell] = flat[np.repeat(at[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        return made
    start = 0
    while start < len(order):
        size = len(order) - start
        while True:
            idx = order[start:start + size]
            mx, my = int(lens[right[idx]].max()), int(lens[left[idx]].max())
            most = max(1, BATCH_BYTES // (mx * ((my + 63) // 64 * 8 + 5) + my * 6 + 64))
            if size <= most:
                break
            size = min(most, size - 1) if most < size else most
        li, ri = left[idx], right[idx]
        out[idx] = _path_words(rows_of(ri, -1), rows_of(li, -2), lens[ri], lens[li])
        start += size
    return out


#: Pairs of different sentences that are formed at once.
PAIRS_AT_ONCE = 1 << 18


def redundancy_pairs(sents, ordered_unequal: bool = False) -> float | None:
    """Mean sentence-pair ROUGE-L F of one document.

    unordered (default): pairs i < j; one sentence -> 0.0; no sentence, or a
    sentence without words (just '.'), -> None (the reference's 999).
    ordered_unequal: all ordered pairs with different text; none -> 998.0.

    Equal sentences are scored once: an ordered pair of different texts counts as
    often as its texts stand in that order (or in any, for the ordered mean),
    a text against itself as often as two of its copies do.  References are
    taken some at a time, so memory does not grow with the number of pairs.
    """
    sents = list(sents) if sents is not None else []
    if not sents:
        return None
    codes, texts = pd.factorize(np.array(sents, dtype=object))
    parts = [_sentences(s) for s in texts]
    if any(len(p) == 0 for p in parts):
        return None
    if not ordered_unequal and len(sents) == 1:
        return 0.0
    d, n = len(texts), len(sents)
    copies = np.bincount(codes, minlength=d)
    single = np.array([len(p) == 1 for p in parts])
    words = [p[0] for p in parts]
    pairs = int(n * n - (copies * copies).sum()) if ordered_unequal else n * (n - 1) // 2
    if not pairs:
        return 998.0
    total = 0.0
    if not ordered_unequal:
        for k in np.flatnonzero(copies > 1):
            total += copies[k] * (copies[k] - 1) / 2 * rouge_l_text(texts[k], texts[k])
    some = max(1, PAIRS_AT_ONCE // d)
    for first in range(0, d, some):
        refs = np.arange(first, min(d, first + some))
        if ordered_unequal:
            weight = copies[:, None] * copies[refs][None, :]
        else:                                              # how often a text stands before a reference's text
            weight, before = np.zeros((d, len(refs)), np.int64), np.zeros(d, np.int64)
            for c in codes.tolist():
                if first <= c < first + len(refs):
                    weight[:, c - first] += before
                before[c] += 1
        weight[refs, np.arange(len(refs))] = 0
        left, right = np.nonzero(weight)
        w = weight[left, right]
        right = refs[right]
        fast = single[left] & single[right]
        if fast.any():
            total += float((pair_rouge_l(words, left[fast], right[fast]) * w[fast]).sum())
        for x, y, m in zip(left[~fast], right[~fast], w[~fast]):   # several parts: the summary-level definition
            total += m * rouge_l_text(texts[x], texts[y])
    return round(total / pairs, 4)


@F.pandas_udf(T.DoubleType())
def redundancy_rouge(sents: pd.Series) -> pd.Series:
    return pd.Series([redundancy_pairs(s) for s in sents], dtype="float64")


@F.pandas_udf(T.DoubleType())
def redundancy_ordered(sents: pd.Series) -> pd.Series:
    return pd.Series([redundancy_pairs(s, ordered_unequal=True) for s in sents], dtype="float64")
