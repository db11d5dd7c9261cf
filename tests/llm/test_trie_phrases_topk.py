"""Prefix trie, phrase mining and exact top-k against brute force: nulls, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpuslab.llm import impacts, phrases, trie


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11 -----------------------------------------------------------------------


def brute_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, t in full.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k],
                   sha(",".join(map(str, sorted(c for c in m if full[c] == k))))) for k, m in members.items())


SCHEMA = "conv_id long, turn long, role string, text string, depth long, name string, level int, size int"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1, 2) for r in rows], SCHEMA)


def got_trie(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens,
                   r.ends_sha256) for r in df.collect())


def test_trie(spark):
    r = random.Random(2)
    rows = []
    for c in [*range(-7, 40), 1030, 1033, 5001, 10**12]:
        for t in range(r.choice([1, 2, 3, 8, 9, 12, 21])):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "bot", None]), r.choice(["a", "é☃", "", None, "long " * 30])))
    rows += [(50, t, "user", "same") for t in range(40)] + [(51, t, "user", "same") for t in range(37)]
    rows += [(3, 0, "user", "a")] * 3 + [(None, 1, "user", "lost")]
    assert got_trie(trie.trie(talk(spark, rows).repartition(5))) == brute_trie(rows)


def test_trie_small(spark):
    assert trie.trie(talk(spark, [])).count() == 0
    for rows in ([(1, None, None, None)], [(4, 1, "u", "x"), (5, 1, "u", "x")], [(7, 0, "u", "x")] * 2):
        assert got_trie(trie.trie(talk(spark, rows))) == brute_trie(rows)
    # a conversation may lose all turns: its base is absent and it is shorter than h
    c = next(x for x in range(1, 100) if x % 5 and (zlib.crc32(str(x).encode())) % 9 >= 3)
    rows = [(c, 0, "u", "x"), (c, 1, "u", "y")]
    want = brute_trie(rows)
    assert got_trie(trie.trie(talk(spark, rows))) == want and want[0][1:5] == (0, -1, 1, 0) and len(want) == 1


# --- 12 -----------------------------------------------------------------------


def brute_phrases(rows, least, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    out = defaultdict(list)
    for (lang, *p), a in f.items():
        if len(p) < 2:
            continue
        score, cut = min((2000000 * a // (f[lang, *p[:k]] + f[lang, *p[k:]]), k) for k in range(1, len(p)))
        if any(100 * c >= 80 * a for q, c in f.items() if q[0] == lang and len(q) - 1 > len(p)
               and any(list(q[i:i + len(p)]) == p for i in range(1, len(q) - len(p) + 1))):
            continue
        phrase = " ".join(p)
        out[lang].append((-score, -a, phrase.encode(), phrase, a, f[lang, *p[:cut]], f[lang, *p[cut:]], n[lang], score))
    return sorted((lang, i + 1, *x[3:]) for lang, v in out.items() for i, x in enumerate(sorted(v)[:top]))


def prose(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "a\x01", "é", "☃", "new", "york", "city", "state", " x", "z" * 400, "A.I"]
    out = []
    for _ in range(n):
        t = []
        for _ in range(r.randint(0, 60)):
            t += ["New", "York", r.choice(["city", "City", "state"])] if r.random() < 0.2 else [r.choice(words)]
        out.append(("".join(w + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r"]) for w in t), r.choice(["en", "en", "fr", None, "und"])))
    return out


@pytest.mark.parametrize("budget", [phrases.BUDGET, 900, 60, 1])
def test_phrases(spark, budget):
    rows = prose(1, 150) + [(None, "en"), ("", "de"), (" , . ", None), ("the " * 3000, "en")]
    rows += rows[:20]
    docs = spark.createDataFrame([(i, *x, "p", 5, 2.0) for i, x in enumerate(rows)], "doc_id long, text string, lang string, phrase string, k int, score double")
    for top in (2000, 7):
        got = phrases.collocations(docs.repartition(3), least=5, top=top, budget=budget)
        assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 5, top)


def test_no_phrases(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("once only", "en")], "text string, lang string")).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts as large as the arithmetic must bear, put in place of the mined ones."""
    big = 2 ** 62
    f = spark.createDataFrame([("en", "a", 1, big + 1), ("en", "b", 1, big), ("en", "a b", 2, big - 1), ("en", "a b c", 3, big // 5 * 4 - 1),
                               ("en", "c", 1, big), ("en", "b c", 2, big // 2)], "lang string, phrase string, k int, f long")
    sizes = spark.createDataFrame([("en", 3 * big // 2)], "lang string, n long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a: (f, sizes))
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in phrases.collocations(None).collect()}
    assert got["a b"] == (big - 1, big + 1, big, 2000000 * (big - 1) // (2 * big + 1))
    assert "b c" not in got                                # 100 f('a b c') >= 80 f('b c')


# --- 13 -----------------------------------------------------------------------


def whole(x):
    return [int(np.floor(256.0 * v)) for v in x]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) and np.isfinite(256.0 * x) for x in v)


def brute_topk(rows, k, every):
    rows = [(i, key, whole(v)) for i, (key, v) in enumerate(rows) if usable(v)]
    out = []
    for i, key, q in rows:
        if key is None or key % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v)), c is None, c or 0) for j, c, v in rows if j != i)[:k]
        out += [(key, n + 1, None if none else c, max(-2**63, min(2**63 - 1, -s))) for n, (s, none, c) in enumerate(found)]
    return Counter(out)


def vectors(spark, rows):
    return spark.createDataFrame([(key, v, 1, 2, 0.5) for key, v in rows], "vec_id long, embedding array<double>, label int, rank int, score double")


def test_topk(spark, monkeypatch):
    r = np.random.default_rng(4)
    centre = r.normal(size=(5, 8)) / 3
    rows = [(i, (centre[i % 5] + r.normal(size=8) / (4 if i % 3 else 40)).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[7][1]) for i in range(60)]                                     # ties
    rows += [(50, rows[3][1]), (50, rows[3][1]), (None, rows[50][1]), (3000, None), (3050, []), (3100, [0.0] * 8), (3150, [None] * 8),
             (3200, [float("nan")] * 8), (3250, [float("inf")] * 8), (3300, [1.0, 2.0]), (-50, (-np.array(rows[9][1])).tolist()), (3350, [1.0] * 20)]
    for block in (impacts.BLOCK, 37):
        monkeypatch.setattr(impacts, "BLOCK", block)
        got = impacts.search(vectors(spark, rows).repartition(3), every=50)
        assert Counter(tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_topk(rows, 5, 50)


def test_topk_of_large_numbers_and_few_rows(spark):
    rows = [(i * 50, [float(3 ** (i % 4)) * 1e15, 1.0, -2.0 ** (i % 50)]) for i in range(60)] + [(7, [1e308] * 3), (50000, [3e9, 1.0, 1.0])]
    got = impacts.search(vectors(spark, rows))
    assert Counter(tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_topk(rows, 5, 50)
    for rows in ([], [(50, [1.0])], [(50, [1.0]), (51, [2.0])], [(1, [1.0]), (2, [1.0])]):
        got = impacts.search(vectors(spark, rows))
        assert Counter(tuple(x) for x in got.collect()) == brute_topk(rows, 5, 50)


def test_block_stops_only_on_proof():
    r = np.random.default_rng(1)
    v = np.floor(40 * r.normal(size=(3000, 16)))
    block = impacts.Block(np.arange(3000), list(range(3000)), v)
    q = np.floor(40 * r.normal(size=(40, 16)))
    score = v @ q.T
    beat = np.sort(score, 0)[-9]
    possible = block._possible(q, np.full(40, -1), beat, 5)
    for j in range(40):
        assert set(np.flatnonzero(score[:, j] >= np.sort(score[:, j])[-5])) <= set(possible[j].tolist())
    assert np.mean([len(p) for p in possible]) < 100          # most rows are never scored
