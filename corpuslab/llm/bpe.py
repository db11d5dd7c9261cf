"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding starts from single characters and keeps an agenda of adjacent pairs
whose concatenation is a piece, ordered by score and, for equal scores, from
left to right.  The best pair is merged, its two new neighbours enter the
agenda, until it is empty.  Characters without a piece become byte pieces.

Merges never cross the start of a ``▁`` after another character, nor a line
end, when no piece of the vocabulary does (checked when it is loaded), so a
text is a row of chunks that are encoded once per slice and cached by hash.  All short
chunks of a slice run their agendas side by side: a matrix holds the rank of
every adjacent pair, and each round merges the best pair of every row.  Longer
chunks use a heap.

Every chunk that is encoded is checked against the sentencepiece library, and
every decoded text against its ``decode``; a difference raises an error.

Edge cases: a null or empty text has no ids and decodes to the empty text;
``▁`` in a text is a blank, as for the library; repeated rows and null ids are
encoded row by row; other columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm.common import bounded_batches, read
from corpuslab.llm.textnp import slices, tidy

BLANK = "▁"
#: Longest chunk for the matrix, chunks and bytes of ids kept in the cache, bytes of text per slice.
WIDE, CACHED, CACHED_BYTES, SLICE = 24, 1_000_000, 64 << 20, 2 << 20
NONE = np.int32(2**31 - 1)
HASH_KEYS = ("first chunk hash", "other chunk hash")  # 16 bytes each


class Pieces:
    """A merge-type vocabulary: ids, scores and the pairs that merge."""

    def __init__(self, model: str):
        import sentencepiece
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        n = lib.vocab_size()
        self.text = [lib.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.control = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i)}
        self.id = {self.text[i]: i for i in range(n) if not (lib.is_byte(i) or i in self.control or lib.is_unused(i))}
        self.plain = frozenset(self.id.values())
        self.number = [str(i) for i in range(n)]
        by_score = sorted(self.id.values(), key=lambda i: -lib.get_score(i))
        rank, last, r = {}, None, -1                       # equal scores share a rank: then the left pair is first
        for i in by_score:
            r += lib.get_score(i) != last
            last, rank[i] = lib.get_score(i), r
        #: symbols: 0 is a character without a piece, others are piece id + 1
        self.pairs = {}
        for p, i in self.id.items():
            for k in range(1, len(p)):
                a, b = self.id.get(p[:k]), self.id.get(p[k:])
                if a is not None and b is not None:
                    self.pairs[(a + 1, b + 1)] = (rank[i], i + 1)
        key = np.array([a * (n + 1) + b for a, b in self.pairs], np.int64)
        o = np.argsort(key)
        self.key, self.n = np.r_[key[o], np.int64(2**62)], n
        self.rank = np.r_[np.array([r for r, _ in self.pairs.values()], np.int32)[o], NONE]
        self.to = np.r_[np.array([t for _, t in self.pairs.values()], np.int32)[o], np.int32(0)]
        self.char = {p: i + 1 for p, i in self.id.items() if len(p) == 1}
        whole = all(c in self.char for p in self.id for c in p)
        inside = all("\n" not in p and (BLANK not in p.lstrip(BLANK)) for p in self.id)
        if not (whole and inside and len(self.byte) == 256):
            raise ValueError("this vocabulary needs chunks of whole texts")
        self.cut = re.compile(" *[^ \n]+|\n| +")
        self.lead = lib.encode("\n")                       # what the library puts before a text after a line end
        self.forget()

    def forget(self) -> None:
        """Empty the cache: per chunk two 64-bit hashes (sorted by the first), the place of its first id and their number."""
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def coded(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``flat`` of the first id, number of ids) of distinct chunks; new ones are encoded and kept."""
        h, c = (pd.util.hash_array(chunks, hash_key=k, categorize=False) for k in HASH_KEYS)
        at = np.searchsorted(self.hash, h)
        known = at < len(self.hash)
        known[known] = (self.hash[at[known]] == h[known]) & (self.check[at[known]] == c[known])
        first, count = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        first[known], count[known] = self.first[at[known]], self.count[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            found = self.encode_chunks([x.replace(" ", BLANK) for x in chunks[new]])
            n = np.array([len(x) for x in found], np.int64)
            first[new], count[new] = len(self.flat) + np.cumsum(n) - n, n
            self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(n.sum()))]
            o = new[np.argsort(h[new], kind="stable")]
            self.hash, self.check, self.first, self.count = (
                np.insert(kept, at[o], x[o]) for kept, x in ((self.hash, h), (self.check, c), (self.first, first), (self.count, count)))
        return first, count

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair in the pair table; its last place for pairs that do not merge."""
        k = a.astype(np.int64) * (self.n + 1) + b
        at = np.searchsorted(self.key, k)
        return np.where(self.key[at] == k, at, len(self.key) - 1)

    def side_by_side(self, chunks: list[str]) -> list[list[int]]:
        """Symbols of short chunks, all agendas at once."""
        n, width = len(chunks), max(map(len, chunks))
        size = np.array([len(c) for c in chunks])
        flat = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        points, back = np.unique(flat, return_inverse=True)
        ids = np.array([self.char.get(chr(p), 0) for p in points], np.int32)
        sym = np.zeros((n, width + 1), np.int32)
        cell = np.arange(width + 1)[None, :] < size[:, None]
        sym[cell] = ids[back]
        out: list = [None] * n
        left = size.copy()
        pair = np.full((n, width), len(self.key) - 1, np.int64)
        live = cell[:, 1:]
        pair[live] = self.lookup(sym[:, :-1][live], sym[:, 1:][live])
        rank = self.rank[pair]
        row = np.arange(n)
        while True:
            best = rank.argmin(axis=1)
            r = np.arange(len(row))
            more = rank[r, best] != NONE
            done = np.flatnonzero(~more)
            for i, m, one in zip(row[done].tolist(), left[done].tolist(), sym[done].tolist()):
                out[i] = one[:m]
            if not more.any():
                return out
            row, sym, pair, rank, left, best = row[more], sym[more], pair[more], rank[more], left[more], best[more]
            r = np.arange(len(row))
            sym[r, best] = self.to[pair[r, best]]
            shift = np.arange(width)[None, :] + (np.arange(width)[None, :] > best[:, None])
            sym[:, :width] = np.take_along_axis(sym, shift, 1)
            sym[:, width] = 0
            left -= 1
            pair = np.take_along_axis(np.c_[pair, np.full(len(row), len(self.key) - 1)], shift, 1)
            for k, ok in ((best, best + 1 < left), (best - 1, best > 0)):
                q = np.flatnonzero(ok)
                pair[q, k[q]] = self.lookup(sym[q, k[q]], sym[q, k[q] + 1])
                q = np.flatnonzero(~ok & (k >= 0))
                pair[q, k[q]] = len(self.key) - 1
            rank = self.rank[pair]

    def agenda(self, chunk: str) -> list[int]:
        """Symbols of one chunk by a heap of (rank, place) over a linked list."""
        sym = [self.char.get(c, 0) for c in chunk]
        n = len(sym)
        right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list = []

        def add(a: int, b: int) -> None:
            hit = self.pairs.get((sym[a], sym[b]))
            if hit:
                heapq.heappush(heap, (hit[0], a, b, sym[a], sym[b], hit[1]))
        for k in range(n - 1):
            add(k, k + 1)
        while heap:
            _, a, b, x, y, to = heapq.heappop(heap)
            if not (alive[a] and alive[b]) or sym[a] != x or sym[b] != y or right[a] != b:
                continue
            sym[a], alive[b], right[a] = to, False, right[b]
            if right[b] < n:
                left[right[b]] = a
                add(a, right[b])
            if left[a] >= 0:
                add(left[a], a)
        return [s for s, ok in zip(sym, alive) if ok]

    def ids(self, chunk: str, symbols: list[int]) -> list[int]:
        """Ids of a chunk's symbols; a character without a piece gives its bytes."""
        if 0 not in symbols:
            return [s - 1 for s in symbols]
        out, at = [], 0
        for s in symbols:
            n = len(self.text[s - 1]) if s else 1
            out += [s - 1] if s else [self.byte[b] for b in chunk[at:at + n].encode()]
            at += n
        return out

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of distinct chunks (blanks written as ``▁``), checked against the library."""
        out: list = [None] * len(chunks)
        by_width: dict[int, list[int]] = {}
        for i, c in enumerate(chunks):
            if len(c) > WIDE:
                out[i] = self.ids(c, self.agenda(c))
            else:
                by_width.setdefault((len(c) + 3) // 4, []).append(i)
        for some in by_width.values():
            for i, s in zip(some, self.side_by_side([chunks[i] for i in some])):
                out[i] = self.ids(chunks[i], s)
        lead = len(self.lead)
        for c, mine, theirs in zip(chunks, out, self.lib.encode(["\n" + c for c in chunks], num_threads=1)):
            if mine != theirs[lead:]:
                raise ValueError(f"the library encodes {c!r} as {theirs[lead:]}, the agenda as {mine}")
        return out

    def split(self, text: str) -> list[str]:
        return self.cut.findall(" " + text.replace(BLANK, " ")) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        return [i for c in self.encode_chunks([c.replace(" ", BLANK) for c in self.split(text)] or []) for i in c] if text else []

    def decode(self, ids: list[int], start: bool = True) -> str:
        """The text of any ids: pieces joined, blanks restored, the first blank dropped (at the start of a text),
        invalid bytes replaced one by one."""
        if self.plain.issuperset(ids):
            text = "".join([self.text[i] for i in ids]).replace(BLANK, " ")
            return text[1:] if start and text[:1] == " " else text
        out, raw = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(raw):
                n = next((n for n in (1, 2, 3, 4) if _valid(bytes(raw[at:at + n]))), 0)
                out.append(bytes(raw[at:at + n]).decode() if n else "�")
                at += n or 1
            raw.clear()
        first = start
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                first = False
                continue
            flush()
            if i in self.control:
                out.append(" ⁇ " if self.lib.is_unknown(i) else "")
                first = first and not self.lib.is_unknown(i)
                continue
            t = self.text[i].replace(BLANK, " ")
            out.append(t[1:] if first and t[:1] == " " else t)
            first = False
        flush()
        return "".join(out)


def _valid(b: bytes) -> bool:
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


_loaded: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """The vocabulary of a worker process."""
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids and digests of every row."""
    bounded_batches(docs.sparkSession)
    return encode_table(docs, more=("ids",))


#: What ``encode_table`` gives if asked for.
MORE = {"ids": "array<int>", "decoded": "string"}


def encode_table(docs: DataFrame, model: str | None = None, more: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the columns ``more`` (ids, decoded) of every row of ``docs``."""
    model = model or model_path()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield _encoded(p, part, more)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {c} {MORE[c]}" for c in more)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _encoded(p: Pieces, part: pa.RecordBatch, more: tuple[str, ...]) -> pa.RecordBatch:
    chunks: list[str] = []
    ends = [0]
    for text in part.column("text").to_pylist():
        chunks += p.split(text or "")
        ends.append(len(chunks))
    codes, distinct = pd.factorize(np.array(chunks, dtype=object)) if chunks else (np.zeros(0, int), [])
    if len(p.hash) > CACHED or p.flat.nbytes > CACHED_BYTES:
        p.forget()
    first, count = p.coded(np.array(distinct, dtype=object))
    n = count[codes]                                       # of every chunk of every text
    upto = np.r_[0, np.cumsum(n)]
    flat = p.flat[np.arange(upto[-1]) + np.repeat(first[codes] - upto[:-1], n)]
    bound = upto[np.array(ends)]
    sha, back, decoded = [], [], []
    for a, b in zip(bound[:-1], bound[1:]):                # a text at a time: no list of all ids or decoded texts
        ids = flat[a:b].tolist()
        sha.append(hashlib.sha256(",".join([p.number[i] for i in ids]).encode()).hexdigest())
        mine, theirs = p.decode(ids), p.lib.decode(ids)
        if mine != theirs:
            raise ValueError(f"the library decodes otherwise: {theirs[:80]!r}, not {mine[:80]!r}")
        back.append(hashlib.sha256(mine.encode()).hexdigest())
        if "decoded" in more:
            decoded.append(mine)
    out = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(bound), pa.int64()), "ids_sha256": pa.array(sha, pa.string()),
           "decoded_sha256": pa.array(back, pa.string())}
    if "ids" in more:
        out["ids"] = pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(flat, pa.int32()))
    if "decoded" in more:
        out["decoded"] = pa.array(decoded, pa.string())
    return pa.record_batch([out[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *more)],
                           names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *more])


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every text of ``documents``."""
    return encode_table(read(spark, sf_dir, "documents"), more=())
