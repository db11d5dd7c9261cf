"""Collocations: phrases of two to four words that occur more often than their parts suggest.

Vertical partitioning of a truncated suffix tree over words.  The suffixes of all pieces, cut after four words, are
dealt out by word prefixes: first the counts of all one-word prefixes are taken; a prefix with more occurrences than
the memory budget of a group is lengthened by a word (one more pass over the texts counts the longer ones), until each
is light or four words long.  Light prefixes are packed into groups within the budget.  A last pass sends every suffix,
equal ones of a window counted together, to the group of its prefix; each group sorts its suffixes by itself and
reads the count of every node, a phrase, from the totals of the leaves below it.  Counts above the light prefixes are
those of the prefix passes, so each phrase has its count from one place.

Words are told apart by their bytes everywhere; a hash only says which group a prefix goes to.  The driver holds the
load of each cell of prefixes (2^22 at most, whatever the corpus) and the heavy prefixes (at most one for each budget
of words).  A task holds one window of texts or one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.llm.common import read, saved
from corpuslab.llm.textnp import flat, mixed, slices, tidy

#: Longest phrase, and the depth of the tree.
WORDS = 4
#: Suffixes of a group at least (more only beyond 2^20 groups).
BUDGET = 1 << 20
#: Bytes of text whose equal suffixes are counted together before they are sent.
WINDOW_BYTES = 4 << 20
CELLS = 1 << 22
SALTS = 64

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class Window:
    """The words of a window of texts: ``words`` (distinct ones), ``langs``, and per occurrence the ids of the word and of
    its language (``w``, ``lang``) and the number of words up to the end of its piece (``left``)."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        buf, off = flat(batch.column("text"))
        kind = _KIND[buf]
        inside = kind == 0
        first, last = inside.copy(), inside.copy()
        if len(buf):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = off[(off > 0) & (off < len(buf))]
            first[edge] = inside[edge]
            last[edge - 1] = inside[edge - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        low = buf + np.where((buf >= 65) & (buf <= 90), 32, 0).astype(np.uint8)
        bounds = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=bounds[1:])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(low[inside])])
        coded = words.dictionary_encode()
        self.words = coded.dictionary
        self.w = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.searchsorted(off, start, side="right") - 1
        langs = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
        self.langs = langs.dictionary.cast(pa.large_binary())
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        piece = np.cumsum(kind == 2, dtype=np.int64)[start] if len(buf) else np.zeros(0, np.int64)
        cut = np.flatnonzero((doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])) + 1
        ends = np.r_[cut, len(start)]
        self.left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(len(start)) if len(start) else np.zeros(0, np.int64)
        self.hash = hashes(self.words), hashes(self.langs)

    def at(self, pos: np.ndarray, k: int) -> np.ndarray:
        """Ids of the words ``k`` after the positions, -1 beyond the piece."""
        have = self.left[pos] > k
        return np.where(have, self.w[np.where(have, pos + k, 0)], -1)

    def keys(self, pos: np.ndarray, k: int) -> np.ndarray:
        """Hash of language and the first ``k`` words, which the pieces have from ``pos`` on."""
        h = self.hash[1][self.lang[pos]]
        for j in range(k):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + self.hash[0][self.w[pos + j]])
        return h


def hashes(words: pa.Array) -> np.ndarray:
    values = np.array(words.to_pylist(), dtype=object)
    return pd.util.hash_array(values, categorize=False) if len(values) else np.zeros(0, np.uint64)


def _counted(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, start of each run of equal ones), sorted by the columns, whose ids go from -1 to sizes - 1."""
    keys, key, room = [], None, 1
    for c, size in zip(columns, sizes):
        if key is None or room * (size + 1) >= 1 << 62:
            keys.append(c + 1)
            room = size + 1
        else:
            keys[-1] = keys[-1] * (size + 1) + (c + 1)
            room *= size + 1
        key = keys[-1]
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _joined(parts: list[pa.Array]) -> pa.Array:
    """Phrases from the columns of their words."""
    return pc.binary_join_element_wise(*[p.cast(pa.large_binary()) for p in parts], pa.scalar(b" ", pa.large_binary())).cast(pa.string())


def _heavy_positions(win: Window, heavy: list[set]) -> np.ndarray:
    """Positions whose first len(heavy) words are a heavy prefix and have a word after it in their piece.  ``heavy``: of each
    length, (language, words) as bytes."""
    pos = np.flatnonzero(win.left > len(heavy))
    for k, known in enumerate(heavy):
        pos = pos[_is_heavy(win, pos, k + 1, known)]
    return pos


def _is_heavy(win: Window, pos: np.ndarray, k: int, known: set) -> np.ndarray:
    """Whether the first ``k`` words from each position are in ``known``: looked up by their hash, then compared in full."""
    if not known or not len(pos):
        return np.zeros(len(pos), bool)
    key = win.keys(pos, k)
    maybe = np.flatnonzero(np.isin(key, np.fromiter((key_of(x) for x in known), np.uint64, len(known))))
    out = np.zeros(len(pos), bool)
    if len(maybe):
        p = pos[maybe]
        columns = [win.lang[p], *[win.w[p + j] for j in range(k)]]
        order, starts = _counted(columns, [len(win.langs), *[len(win.words)] * k])
        run = np.zeros(len(order), np.int64)
        run[starts[1:]] = 1
        run = np.cumsum(run)
        first = order[starts]
        texts = list(zip(*[win.langs.take(pa.array(columns[0][first])).to_pylist(),
                           *[win.words.take(pa.array(c[first])).to_pylist() for c in columns[1:]]]))
        out[maybe[order]] = np.array([t in known for t in texts])[run]
    return out


def key_of(prefix: tuple[bytes, ...]) -> np.uint64:
    h = hashes(pa.array(prefix, pa.large_binary()))
    out = h[:1]
    for x in h[1:]:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + x)
    return out[0]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[Window]:
    for batch in batches:
        for part in slices(batch, "text", WINDOW_BYTES):
            win = Window(part)
            if len(win.w):
                yield win


COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("key", pa.int64()), ("n", pa.int64())])


def _count(heavy: list[set]) -> Callable:
    """Of every window: the prefixes one word longer than ``heavy``'s longest that continue a heavy one, and their counts."""
    k = len(heavy) + 1

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for win in _windows(batches):
            pos = _heavy_positions(win, heavy)
            if not len(pos):
                continue
            columns = [win.lang[pos], *[win.w[pos + j] for j in range(k)]]
            order, starts = _counted(columns, [len(win.langs), *[len(win.words)] * k])
            first = pos[order[starts]]
            n = np.diff(np.r_[starts, len(order)])
            yield pa.RecordBatch.from_arrays(
                [win.langs.take(pa.array(win.lang[first])).cast(pa.string()),
                 _joined([win.words.take(pa.array(win.w[first + j])) for j in range(k)]),
                 pa.array(win.keys(first, k).view(np.int64)), pa.array(n.astype(np.int64))], schema=COUNTED)
    return run


PACKED = "grp int, size int, blob binary"


def _pack(win: Window, pos: np.ndarray, length: np.ndarray, n: np.ndarray) -> bytes:
    """Distinct suffixes (at ``pos``), the length of the prefix each is dealt by and their counts, with the words they use."""
    columns = [win.at(pos, j) for j in range(WORDS)]
    used, ids = np.unique(np.concatenate(columns), return_inverse=True)
    skip = int(len(used) and used[0] == -1)
    ids = (ids - skip).astype(np.int32)
    words, langs = win.words.take(pa.array(used[skip:])), win.langs
    off, data = [np.r_[0, np.cumsum(pc.binary_length(a).to_numpy(zero_copy_only=False))].astype(np.int64) for a in (words, langs)], \
        [b"".join(a.to_pylist()) for a in (words, langs)]
    head = np.array([len(pos), len(words), len(langs)], np.int64)
    return b"".join([head.tobytes(), off[0].tobytes(), off[1].tobytes(), n.astype(np.int64).tobytes(), win.lang[pos].astype(np.int32).tobytes(),
                     length.astype(np.int32).tobytes(), ids.tobytes(), *data])


def _unpack(raw: bytes) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, languages, counts, language ids, prefix lengths, word ids of each depth)."""
    rows, n_words, n_langs = (int(x) for x in np.frombuffer(raw, np.int64, 3))
    at = 24

    def take(count: int, kind: type) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out
    woff, loff = take(n_words + 1, np.int64), take(n_langs + 1, np.int64)
    n, lang, length, ids = take(rows, np.int64), take(rows, np.int32), take(rows, np.int32), take(rows * WORDS, np.int32)
    made = []
    for off in (woff, loff):
        made.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.copy()), pa.py_buffer(raw[at:at + int(off[-1])])]))
        at += int(off[-1])
    return made[0], made[1], n, lang, length, ids.reshape(WORDS, rows)


def _deal(heavy: list[set], bits: int, group_of: np.ndarray) -> Callable:
    """Every suffix that goes on after a light prefix, to the group of that prefix; equal ones of a window are one with a count."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for win in _windows(batches):
            pos = np.flatnonzero(win.left > 1)
            found, length, key = [], [], []
            for k in range(1, WORDS):
                pos = pos[win.left[pos] > k]
                known = _is_heavy(win, pos, k, heavy[k - 1]) if k <= len(heavy) else np.zeros(len(pos), bool)
                light = pos[~known]
                found.append(light)
                length.append(np.full(len(light), k))
                key.append(win.keys(light, k))
                pos = pos[known]
            pos, length, key = np.concatenate(found), np.concatenate(length), np.concatenate(key)
            if not len(pos):
                continue
            grp = group_of[(key >> np.uint64(64 - bits)).astype(np.int64)] if bits else np.zeros(len(key), np.int64)
            order, starts = _counted([grp, win.lang[pos], *[win.at(pos, j) for j in range(WORDS)]],
                                     [int(group_of[-1]) + 1, len(win.langs), *[len(win.words)] * WORDS])
            n = np.diff(np.r_[starts, len(order)])
            first = order[starts]
            pos, length, grp = pos[first], length[first], grp[first]
            cuts = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
            out: list[tuple] = []
            for a, b in zip(cuts, np.r_[cuts[1:], len(grp)]):
                raw = _pack(win, pos[a:b], length[a:b], n[a:b])
                out.append((int(grp[a]), len(raw), pa.compress(raw, codec="zstd", asbytes=True)))
                if len(out) == 64 or b == len(grp):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], ["grp", "size", "blob"])
                    out = []
    return run


def _subtree(least: int) -> Callable:
    """The truncated suffix tree of one group: leaves sorted by words, the nodes of a depth are runs of leaves with that many
    words in common, their counts the totals of the run.  Nodes at or above the dealt prefix are counted elsewhere."""
    def run(table: pa.Table) -> pa.Table:
        parts = []
        for size, blob in zip(table.column("size").to_pylist(), table.column("blob")):
            parts.append(_unpack(pa.decompress(blob.as_py(), size, codec="zstd", asbytes=True)))
        words = pa.chunked_array([p[0] for p in parts]).combine_chunks().dictionary_encode()
        langs = pa.chunked_array([p[1] for p in parts]).combine_chunks().dictionary_encode()
        wmap, lmap = words.indices.to_numpy(zero_copy_only=False), langs.indices.to_numpy(zero_copy_only=False)
        ids, lang, wat, lat = [], [], 0, 0
        for p in parts:
            own = np.r_[wmap[wat:wat + len(p[0])], -1].astype(np.int64)  # -1 reads the last
            ids.append(own[p[5]])
            lang.append(lmap[lat:lat + len(p[1])][p[3]].astype(np.int64))
            wat, lat = wat + len(p[0]), lat + len(p[1])
        n, length = np.concatenate([p[2] for p in parts]), np.concatenate([p[4] for p in parts])
        parts.clear()
        ids, lang = np.concatenate(ids, axis=1), np.concatenate(lang)
        size = len(words.dictionary)
        order, _ = _counted([lang, *ids], [len(langs.dictionary), *[size] * WORDS])
        ids, lang, n, length = ids[:, order], lang[order], n[order], length[order]
        new = np.r_[True, lang[1:] != lang[:-1]]
        made = []
        for d in range(1, WORDS + 1):
            new[1:] |= ids[d - 1][1:] != ids[d - 1][:-1]
            starts = np.flatnonzero(new)
            total = np.add.reduceat(n, starts)
            keep = (total >= least) & (ids[d - 1][starts] >= 0) & (length[starts] < d)
            at = starts[keep]
            made.append(pa.table([langs.dictionary.take(pa.array(lang[at])).cast(pa.string()),
                                  _joined([words.dictionary.take(pa.array(ids[j][at])) for j in range(d)]),
                                  pa.array(np.full(len(at), d, np.int32)), pa.array(total[keep])], ["lang", "phrase", "k", "f"]))
        return pa.concat_tables(made)
    return run


def phrase_counts(docs: DataFrame, least: int = 30, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of every phrase of one to four words with ``least`` occurrences or more in a language, and
    (lang, n) with all word occurrences.  Texts are lower-cased in A-Z; a null lang is ``und``."""
    texts = docs.select("text", "lang")
    tables, heavy, loads = [], [], []
    sizes = None
    bits = 0
    for k in range(1, WORDS + 1):
        rows = texts.mapInArrow(_count(list(heavy)), "lang string, phrase string, key long, n long")
        t = saved(rows.groupBy("lang", "phrase").agg(F.first("key").alias("key"), F.sum("n").alias("f")), f"prefixes-{k}")
        tables.append(t.where(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("k"), "f"))
        if sizes is None:
            sizes = t.groupBy("lang").agg(F.sum("f").alias("n"))
            total = int(t.agg(F.sum("f")).first()[0] or 0)
            budget = max(budget, total >> 20)
            bits = max(0, min(CELLS, 4 * total // budget).bit_length())
        if k == WORDS:
            break
        light = t.where(F.col("f") <= budget)
        cell = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
        loads += [tuple(r) for r in light.groupBy(cell.alias("cell")).agg(F.sum("f")).collect()]
        known = {tuple(x.encode() for x in (r["lang"], *r["phrase"].split(" ")))
                 for r in t.where(F.col("f") > budget).select("lang", "phrase").collect()}
        if not known:
            break
        heavy.append(known)
    load = np.zeros(1 << bits, np.int64)
    for c, f in loads:
        load[c] += f
    group_of, grp, room = np.zeros(len(load), np.int64), 0, 0
    for c, f in enumerate(load.tolist()):
        if room and room + f > budget:
            grp, room = grp + 1, 0
        room += f
        group_of[c] = grp
    dealt = texts.mapInArrow(_deal(heavy, bits, group_of), PACKED)
    nodes = dealt.groupBy("grp").applyInArrow(_subtree(least), "lang string, phrase string, k int, f long")
    for t in tables:
        nodes = nodes.unionByName(t)
    return saved(nodes, "phrases"), sizes


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """The ``top`` phrases of two to four words of every language: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the occurrences of the phrase and of its two parts at the cut with the lowest score
    floor(2000000 a / (l + r)), the earliest such cut; n is the language's number of words.  Phrases whose words stand
    inside a longer one with at least four fifths of their occurrences are left out.  Texts may be null, empty or very
    long; without a phrase that often there are no rows.  Other columns of ``docs`` are not read.
    """
    f, sizes = phrase_counts(docs, least, budget)
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cand = f.where("k >= 2")
    cuts = (cand.select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"))
            .withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
            .select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("lp"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rp")))
    left = f.select("lang", F.col("phrase").alias("lp"), F.col("f").alias("l"))
    right = f.select("lang", F.col("phrase").alias("rp"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = (cuts.join(left, ["lang", "lp"]).join(right, ["lang", "rp"])
            .withColumn("score", F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("b"))
    inside = F.transform(F.filter(
        F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1),
                              lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda a: F.struct(a.alias("a"), n.alias("n"))))),
        lambda s: s["n"] >= 2), lambda s: F.array_join(F.slice(F.col("w"), s["a"], s["n"]), " "))
    longer = (cand.where("k >= 3").select("lang", "k", "f", words.alias("w"))
              .select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("longest")))
    kept = (best.join(longer, ["lang", "phrase"], "left")
            .where(F.col("longest").isNull() | (wide("longest") * 100 < F.col("b.a").cast("decimal(38,0)") * 80))
            .select("lang", "phrase", "b.a", "b.l", "b.r", "b.score"))
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    few = (kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
           .withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*by))).where(F.col("rank") <= top))
    few = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    return few.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GRAMS = "\n  UNION ALL ".join(
    f"SELECT lang, {k} AS k, list_slice(w, i, i + {k - 1}) AS p FROM pieces, unnest(range(1, len(w) - {k - 2})) AS t(i)" for k in range(1, 5))
ORACLE = f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
grams AS ({_GRAMS}),
f AS (SELECT lang, k, p, array_to_string(p, ' ') AS phrase, count(*) AS f FROM grams GROUP BY lang, k, p HAVING count(*) >= 30),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, i, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.f) // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM f WHERE k > 1) c
  JOIN f l ON l.lang = c.lang AND l.p = list_slice(c.p, 1, c.i)
  JOIN f r ON r.lang = c.lang AND r.p = list_slice(c.p, c.i + 1, c.k)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inner_parts AS (
  SELECT lang, f, unnest(CASE k WHEN 3 THEN [p[1:2], p[2:3]] ELSE [p[1:2], p[2:3], p[3:4], p[1:3], p[2:4]] END) AS q FROM f WHERE k > 2),
longer AS (SELECT lang, array_to_string(q, ' ') AS phrase, max(f) AS longest FROM inner_parts GROUP BY lang, q)
SELECT b.lang, CAST(row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS BIGINT) AS rank,
  b.phrase, b.a, b.l, b.r, s.n, b.score
FROM best b JOIN sizes s ON s.lang = b.lang LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
WHERE g.longest IS NULL OR 100::HUGEINT * g.longest < 80::HUGEINT * b.a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) <= 2000
"""
