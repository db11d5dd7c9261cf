"""Subword (BPE-style) vocabulary of any size, and encoding with it.

The corpus is reduced once to a distinct-word table by a distributed count.
Learning goes in stages, each of a few jobs over that table and not one job a
merge:

1. All pairs of neighbouring symbols are counted (summed per Arrow batch, then
   by Spark); the count of the ``pairs``-th most frequent one is the floor.
2. Words are cut wherever a pair is below the floor.  A merge never raises the
   count of a pair that is there, and a pair with the merged symbol occurs at most
   as often as the pair its neighbour formed before, so no merge with a count at or
   above the floor can ever reach across a cut.  What is left, fragments with
   their counts, is far smaller than the words, and equal ones are summed.
3. One task learns all merges down to the floor from the fragments, with an index
   from pairs to fragments, in the same order as one by one: the highest count
   first, ties by the text of the pair in UTF-8 order.  The table of fragments is
   counted before; with more than ``FRAGMENTS`` of them the floor is raised.  Symbols are known by their text; a merge
   that gives a text that is there already ends the stage, as it may raise counts that were below the floor.
4. The merges are applied to the words, and the next stage begins.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.session import fitted_path, fresh_dir, read_or_none

#: Separates the two texts of a pair where they are compared.
SEP = "\u0001"
#: Pairs at or above a stage's floor at first, fragments that one task learns from, tied pairs that every task may hold,
#: fragments whose merged form a task keeps.
PAIRS, FRAGMENTS, TIED, KEPT = 8192, 400_000, 1 << 21, 200_000
# The special entries and their ids, as in the encoder-decoder model the inputs are for.
SPECIAL = ("<s>", "<pad>", "</s>", "<unk>", "<mask>")
BOS, PAD, EOS, UNK, MASK = range(5)
#: Symbols below are code points, those from here on are merges in their order.
FIRST = 0x110000


def word_table(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): whitespace words counted across the corpus."""
    words = texts.select(F.explode(F.split(F.col(text_col), r"\s+")).alias("word")).where(F.col("word") != "")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def alphabet(words: DataFrame) -> list[str]:
    """Distinct characters of the words, in code point order (as many as Unicode has at most)."""
    chars = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    return sorted(r["c"] for r in chars.collect())


# --- learning -----------------------------------------------------------------


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all symbols, offset of each word) of an array of symbol lists."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(sizes)]


def _pairs(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of the pair that starts at every symbol, whether there is one: not at a word's end)."""
    inside = np.ones(len(flat), bool)
    inside[off[1:][off[1:] > 0] - 1] = False
    code = np.zeros(len(flat), np.int64)
    code[:-1] = (flat[:-1] << 32) | flat[1:]
    return code, inside


def _known(code: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each code is in a sorted table."""
    if not len(table):
        return np.zeros(len(code), bool)
    at = np.searchsorted(table, code)
    return table[np.minimum(at, len(table) - 1)] == code


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, off = _lists(batch.column("symbols"))
        code, inside = _pairs(flat, off)
        n = np.repeat(batch.column("n").to_numpy(), np.diff(off))[inside]
        order = np.argsort(code[inside], kind="stable")
        code = code[inside][order]
        if len(code):
            start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            yield pa.record_batch([pa.array(code[start]), pa.array(np.add.reduceat(n[order], start))], names=["pair", "n"])


def _runs(flat: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every fragment: a maximal run of symbols whose pairs are all in ``table``."""
    code, inside = _pairs(flat, off)
    hit = inside & _known(code, table)
    first = np.flatnonzero(hit & ~np.r_[False, hit[:-1]]) if len(hit) else np.zeros(0, np.int64)
    last = np.flatnonzero(hit & ~np.r_[hit[1:], False]) if len(hit) else np.zeros(0, np.int64)
    return first, last + 2


def _fragments(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = _lists(batch.column("symbols"))
            start, end = _runs(flat, off, table)
            n = batch.column("n").to_numpy()[np.searchsorted(off, start, side="right") - 1]
            size = end - start
            bounds = np.r_[0, np.cumsum(size)]
            data = flat[np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)].astype("<i4")
            parts = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(data)])
            yield pa.record_batch([parts, pa.array(n)], names=["fragment", "n"])
    return run


class Learner:
    """Merges over fragments, one by one, with counts and an index that change only where a merged pair stood."""

    def __init__(self, names: dict[int, bytes]) -> None:
        self.parts: list[list[int]] = []
        self.n: list[int] = []
        self.names = names
        self.index: dict[tuple[int, int], list[int]] = defaultdict(list)
        self.count: dict[tuple[int, int], int] = defaultdict(int)
        self.heap: list = []

    def add(self, part: list[int], n: int) -> None:
        w = len(self.parts)
        self.parts.append(part)
        self.n.append(n)
        for pair in zip(part, part[1:]):
            self.count[pair] += n
            held = self.index[pair]
            if not held or held[-1] != w:
                held.append(w)

    def text(self, symbol: int) -> bytes:
        return chr(symbol).encode("utf-8", "surrogatepass") if symbol < FIRST else self.names[symbol]

    def show(self, pair: tuple[int, int]) -> None:
        heapq.heappush(self.heap, (-self.count[pair], self.text(pair[0]) + SEP.encode() + self.text(pair[1]), pair))

    def merges(self, first: int, most: int, floor: int) -> Iterator[tuple[int, int, int, int]]:
        """(left, right, symbol, count) of the next merges: at most ``most`` new symbols, numbered from ``first`` on, no count below
        ``floor``, and nothing after a merge whose text is known."""
        for pair in self.count:
            self.show(pair)
        made, known = 0, {t: x for x, t in self.names.items()}
        while self.heap and made < most:
            c, _, pair = heapq.heappop(self.heap)
            if self.count.get(pair, 0) != -c:
                continue                                   # shown again since with another count
            if -c < floor:
                return
            text = self.text(pair[0]) + self.text(pair[1])
            to = known.get(text)
            yield *pair, FIRST + first + made if to is None else to, -c
            if to is not None:
                return
            to = FIRST + first + made
            self.names[to], known[text], made = text, to, made + 1
            self.merge(pair, to)

    def merge(self, pair: tuple[int, int], to: int) -> None:
        changed: dict[tuple[int, int], int] = defaultdict(int)
        for w in self.index.pop(pair):
            s, m = self.parts[w], self.n[w]
            out = merged(s, pair, to)
            if len(out) == len(s):
                continue
            before = set(zip(s, s[1:]))
            for p in zip(s, s[1:]):
                changed[p] -= m
            for p in zip(out, out[1:]):
                changed[p] += m
                if p not in before:
                    before.add(p)
                    self.index[p].append(w)
            self.parts[w] = out
        for p, d in changed.items():
            if d:
                self.count[p] += d
                if self.count[p]:
                    self.show(p)
                else:
                    del self.count[p]


def merged(s: list[int], pair: tuple[int, int], to: int) -> list[int]:
    """``s`` with every occurrence of the pair, from left to right, as the symbol ``to``."""
    a, b = pair
    out, i, n = [], 0, len(s)
    while i < n:
        if s[i] == a and i + 1 < n and s[i + 1] == b:
            out.append(to)
            i += 2
        else:
            out.append(s[i])
            i += 1
    return out


def _learn(first: int, most: int, floor: int, names: dict[int, bytes]):
    """One task over all fragments of a stage."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(dict(names))
        for batch in batches:
            for part, n in zip(batch.column("fragment").to_pylist(), batch.column("n").to_pylist()):
                learner.add(np.frombuffer(part, "<i4").tolist(), n)
        made = list(learner.merges(first, most, floor))
        if made:
            left, right, to, count = zip(*made)
            yield pa.record_batch([pa.array(range(len(made)), pa.int32()), *[pa.array(x, pa.int32()) for x in (left, right, to)],
                                   pa.array(count, pa.int64())], names=["place", "a", "b", "to", "count"])
    return run


def _apply(table: np.ndarray, rank: dict[tuple[int, int], tuple[int, int]]):
    """The words after a stage's merges (pair to rank and symbol); each distinct fragment of a task is worked on once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, list[int]] = {}
        for batch in batches:
            flat, off = _lists(batch.column("symbols"))
            start, end = _runs(flat, off, table)
            data, out, sizes, at = flat.astype("<i4"), [], np.diff(off).copy(), 0
            for a, b, w in zip(start.tolist(), end.tolist(), (np.searchsorted(off, start, side="right") - 1).tolist()):
                key = data[a:b].tobytes()
                now = kept.get(key)
                if now is None:
                    now = by_rank(flat[a:b].tolist(), rank)
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[key] = now
                out += [flat[at:a], now]
                sizes[w] -= b - a - len(now)
                at = b
            out.append(flat[at:])
            symbols = pa.array(np.concatenate([np.asarray(x, np.int64) for x in out]).astype(np.int32))
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), symbols), batch.column("n")], names=["symbols", "n"])
    return run


def by_rank(s: list[int], rank: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """All merges (pair to rank and symbol) in order of rank, by a heap over a linked list (n log n for n symbols)."""
    n = len(s)
    right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(rank[p][0], i, rank[p][1]) for i, p in enumerate(zip(s, s[1:])) if p in rank]
    heapq.heapify(heap)
    while heap:
        r, i, to = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or rank.get((s[i], s[j])) != (r, to):
            continue
        s[i], alive[j], right[i] = to, False, right[j]
        if right[i] < n:
            left[right[i]] = i
        for k in (left[i], i):
            if 0 <= k and right[k] < n and (hit := rank.get((s[k], s[right[k]]))):
                heapq.heappush(heap, (hit[0], k, hit[1]))
    return [x for x, ok in zip(s, alive) if ok]


STATE = "symbols array<int>, n long"


def learn_merges(words: DataFrame, merges: int, pairs: int = PAIRS, fragments: int = FRAGMENTS) -> list[tuple[int, str, str, int]]:
    """The merges over ``words`` (word, n) until they have made ``merges`` new symbols: (round, left, right, count) in order;
    fewer if no pair is left.

    The result is as long as the vocabulary asked for, whatever the corpus (merges that give a known text come on top).
    """
    spark = words.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = fresh_dir(spark, f"subword-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)
    state = stored(words.select(F.transform(F.split("word", ""), F.ascii).alias("symbols"), F.col("n").cast("long").alias("n")), "symbols")
    names: dict[int, bytes] = {}
    out: list[tuple[int, str, str, int]] = []
    while len(names) < merges:
        counts = stored(state.mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
        while True:
            top = counts.groupBy("n").agg(F.count("*").alias("pairs")).orderBy(F.col("n").desc()).limit(pairs).collect()
            if not top:
                return out
            floor, held = top[0]["n"], top[0]["pairs"]
            for r in top[1:]:
                if held + r["pairs"] > pairs:
                    break
                floor, held = r["n"], held + r["pairs"]
            if held > TIED:
                raise ValueError(f"{held} pairs share the highest count {floor}: too many to send to every task")
            table = np.array(sorted(r["pair"] for r in counts.where(F.col("n") >= floor).select("pair").collect()), np.int64)
            parts = stored(state.mapInArrow(_fragments(table), "fragment binary, n long").groupBy("fragment").agg(F.sum("n").alias("n")), "fragments")
            found = parts.count()
            if found <= fragments or pairs == 1:
                break
            pairs = max(1, pairs // 2)                     # a higher floor: fewer pairs, fewer and shorter fragments
        first = len(names)
        made = parts.repartition(1).mapInArrow(_learn(first, merges - first, floor, names), "place int, a int, b int, to int, count long") \
            .orderBy("place").collect()                    # at most as many as the vocabulary has entries, and one
        rank = {}
        for r in made:
            a, b = (chr(x).encode("utf-8", "surrogatepass") if x < FIRST else names[x] for x in (r["a"], r["b"]))
            names[r["to"]] = a + b
            out.append((len(out) + 1, a.decode("utf-8", "surrogatepass"), b.decode("utf-8", "surrogatepass"), r["count"]))
            rank[r["a"], r["b"]] = (r["place"], r["to"])
        if len(names) < merges:
            state = stored(state.mapInArrow(_apply(table, rank), STATE), "symbols")
        if found < fragments // 4:
            pairs *= 2
    return out


def vocabulary_table(spark: SparkSession, chars: list[str], merges: list[tuple[int, str, str, int]]) -> DataFrame:
    """(place, id, kind, token, left, right, count): special entries, characters, merges in order.  A merge that gives a known
    text is a row with that text's id, so that ids have no gaps."""
    rows = [(t, "special", None, None, None) for t in SPECIAL] + [(c, "character", None, None, None) for c in chars]
    rows += [(a + b, "merge", a, b, c) for _, a, b, c in merges]
    ids: dict[str, int] = {}
    for i, (t, kind, *_) in enumerate(rows):
        ids.setdefault(t if kind != "special" else (t,), len(ids))
    return spark.createDataFrame([(i, ids[t if kind != "special" else (t,)], kind, t, *x) for i, (t, kind, *x) in enumerate(rows)],
                                 "place int, id int, kind string, token string, left string, right string, count long")


def learn_vocabulary(texts: DataFrame, size: int = 25_000, text_col: str = "text") -> tuple[list[str], list[tuple[int, str, str, int]]]:
    """(characters, merges) of a vocabulary with ``size`` entries, the special ones among them."""
    path = fresh_dir(texts.sparkSession, "subword-words")
    word_table(texts, text_col).write.parquet(path)
    words = texts.sparkSession.read.parquet(path)
    chars = alphabet(words)
    return chars, learn_merges(words, max(0, size - len(SPECIAL) - len(chars)))


def stored_vocabulary(spark: SparkSession, sources: list[str], texts, size: int = 25_000) -> DataFrame:
    """``vocabulary_table`` of the vocabulary that this application learned from the files ``sources``, or a new one of ``texts()``."""
    path = fitted_path(spark, "subword-vocabulary", sources, size=size)
    have = read_or_none(spark, path)
    if have is None:
        vocabulary_table(spark, *learn_vocabulary(texts(), size)).coalesce(1).write.mode("overwrite").parquet(path)
        have = spark.read.parquet(path)
    return have


def load_vocabulary(table: DataFrame) -> tuple[list[str], list[tuple[str, str]]]:
    """(characters, merges) of a vocabulary table, which has as many rows as the vocabulary was asked to have."""
    rows = table.where("kind <> 'special'").orderBy("place").collect()
    return [r["token"] for r in rows if r["kind"] == "character"], [(r["left"], r["right"]) for r in rows if r["kind"] == "merge"]


# --- encoding -----------------------------------------------------------------


class Encoder:
    """Ids of words under a vocabulary: characters, then merges by rank; a character that it lacks is ``<unk>``."""

    #: Words whose ids are kept, and the longest of them.
    KEPT, LONGEST = 200_000, 64

    def __init__(self, chars: list[str], merges: list[tuple[str, str]]) -> None:
        self.id = {c: len(SPECIAL) + i for i, c in enumerate(chars)}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        token = dict(self.id)
        for i, (a, b) in enumerate(merges):
            self.rank[token[a], token[b]] = (i, token.setdefault(a + b, len(SPECIAL) + len(token)))
        self.kept: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        ids = self.kept.get(word)
        if ids is None:
            ids = by_rank([self.id.get(c, UNK) for c in word], self.rank)
            if len(word) <= self.LONGEST:
                if len(self.kept) >= self.KEPT:
                    self.kept.clear()
                self.kept[word] = ids
        return ids

    def text(self, text: str | None, most: int) -> list[int]:
        """The first ``most`` ids of a text's words (null: none)."""
        out: list[int] = []
        for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text or ""):
            out += self.word(m.group())
            if len(out) >= most:
                break
        return out[:most]


def encode_pad(docs: DataFrame, columns: dict[str, tuple[str, int]], chars: list[str], merges: list[tuple[str, str]]) -> DataFrame:
    """``docs`` with, for every (new column: (text column, length)) of ``columns``, a struct (input_ids, attention_mask).

    Ids are ``<s>``, the text's ids cut to fit, ``</s>``, then padding up to the
    length.  The vocabulary (as large as was asked for, checked to be below 2^20
    entries) goes to every task; each distinct word is encoded once and kept.
    """
    if len(merges) >= 1 << 20:
        raise ValueError("a vocabulary of 2^20 merges or more is too large to send to every task")
    table = docs.sparkSession.sparkContext.broadcast((chars, merges))
    made: dict[str, Encoder] = {}

    def encoded(length: int):
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            if "encoder" not in made:
                made["encoder"] = Encoder(*table.value)
            e = made["encoder"]
            for texts in batches:
                ids = [[BOS, *e.text(t.as_py(), length - 2), EOS] for t in texts]
                real = np.array([len(x) for x in ids], np.int64)
                flat = np.full((len(ids), length), PAD, np.int32)
                for row, x in zip(flat, ids):
                    row[:len(x)] = x
                mask = (np.arange(length)[None, :] < real[:, None]).astype(np.int32)
                off = pa.array(np.arange(len(ids) + 1) * length, pa.int32())
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(off, pa.array(x.ravel())) for x in (flat, mask)], ["input_ids", "attention_mask"])
        return F.arrow_udf(run, "input_ids array<int>, attention_mask array<int>")
    return docs.withColumns({name: encoded(length)(F.col(text)) for name, (text, length) in columns.items()})
