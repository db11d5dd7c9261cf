"""The subword learner and encoder against plain-Python versions."""
import random
from collections import Counter

from pyspark.sql import functions as F

from corpuslab.operators import subword as sw


def plain_merges(words, rounds):
    """One merge at a time, all pairs counted anew, until ``rounds`` texts are new."""
    words = {w: (list(w), n) for w, n in words.items()}
    out = []
    while len({a + b for _, a, b, _ in out}) < rounds:
        pairs = Counter()
        for s, n in words.values():
            for p in zip(s, s[1:]):
                pairs[p] += n
        if not pairs:
            break
        (a, b), c = min(pairs.items(), key=lambda x: (-x[1], (x[0][0] + sw.SEP + x[0][1]).encode()))
        out.append((len(out) + 1, a, b, c))
        for w, (s, n) in words.items():
            t, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == (a, b):
                    t.append(a + b)
                    i += 2
                else:
                    t.append(s[i])
                    i += 1
            words[w] = (t, n)
    return out


def plain_encode(word, chars, merges):
    entries = list(dict.fromkeys([*chars, *[a + b for a, b in merges]]))
    s = [(c, 5 + chars.index(c) if c in chars else 3) for c in word]
    for a, b in merges:
        t, k = [], 0
        while k < len(s):
            if k + 1 < len(s) and s[k][0] == a and s[k + 1][0] == b and 3 not in (s[k][1], s[k + 1][1]):
                t.append((a + b, 5 + entries.index(a + b)))
                k += 2
            else:
                t.append(s[k])
                k += 1
        s = t
    return [x for _, x in s]


def prose(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aabbcdeé☃𝄞") for _ in range(r.randint(1, 9))) for _ in range(150)] + ["aaaa", "aaaaaaa", "abab", "aab", "aaab", "baab", "cabaab"]
    return [" ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=r.randint(0, 30))) for _ in range(n)] + [None, "", " \t\n "]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_merges_equal_one_by_one(spark):
    for seed, rounds, pairs, fragments in ((1, 500, 8192, 400_000), (2, 120, 16, 400_000), (3, 60, 64, 20)):
        texts = prose(seed, 200)
        counts = Counter(w for t in texts for w in (t or "").split())
        words = sw.word_table(frame(spark, texts))
        assert {r["word"]: r["n"] for r in words.collect()} == counts
        got = sw.learn_merges(words, rounds, pairs, fragments)
        assert got == plain_merges(counts, rounds)


def test_no_words(spark):
    assert sw.learn_merges(sw.word_table(frame(spark, [None, "", "  "])), 10) == []
    assert sw.learn_merges(sw.word_table(frame(spark, ["a b c"])), 10) == []


def test_vocabulary_has_its_size(spark):
    texts = frame(spark, prose(3, 300))
    chars, merges = sw.learn_vocabulary(texts, 100)
    t = sw.vocabulary_table(spark, chars, merges)
    assert sw.load_vocabulary(t) == (chars, [(a, b) for _, a, b, _ in merges])
    assert t.count() == 100 and [r["id"] for r in t.orderBy("id").collect()] == list(range(100))
    assert chars == sorted({c for r in texts.collect() for c in (r["text"] or "") if not c.isspace()})


def test_encoding_equals_the_plain_version(spark):
    texts = prose(4, 120)
    chars, merges = sw.learn_vocabulary(frame(spark, texts), 400)
    pairs = [(a, b) for _, a, b, _ in merges]
    more = texts + ["zzz aaaaqaaaa ☃", "x" * 300 + " " + "ab" * 5000]
    got = sw.encode_pad(frame(spark, more), {"x": ("text", 64), "y": ("text", 16)}, chars, pairs).orderBy("id").collect()
    for t, r in zip(more, got):
        ids = [i for w in (t or "")[:2000].split() for i in plain_encode(w, chars, pairs)]
        for column, length in (("x", 64), ("y", 16)):
            want = [0, *ids[:length - 2], 2]
            assert r[column]["input_ids"] == want + [1] * (length - len(want))
            assert r[column]["attention_mask"] == [1] * len(want) + [0] * (length - len(want))
    assert sw.encode_pad(frame(spark, texts).where("id < 0"), {"x": ("text", 8)}, chars, pairs).count() == 0


def test_code_points(spark):
    s = spark.createDataFrame([("aé☃𝄞",)], "word string").select(F.transform(F.split("word", ""), F.ascii).alias("s")).first()["s"]
    assert s == [ord(c) for c in "aé☃𝄞"]
