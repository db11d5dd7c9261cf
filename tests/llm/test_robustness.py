"""Words made to collide under polynomial hashes, columns with the operators' own names, permutations and their inverses."""



import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpuslab.llm import jaccard, ledger, mixing, quality, toxicity
from corpuslab.llm.textnp import flat, shingles, word_hashes, words


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


TWINS = thue_morse(1024), thue_morse(1024, True)


def test_word_hashes_tell_words_apart():
    texts = [f"{TWINS[0]} {TWINS[1]} {TWINS[0]}", "", None, "a b  a\tÄ\nA " + TWINS[1]]
    buf, off = flat(pa.array(texts))
    start, end, _ = words(buf, off)
    h = word_hashes(buf, start, end)
    w = [bytes(buf[a:b]) for a, b in zip(start, end)]
    assert all((w[i] == w[j]) == (h[i] == h[j]) for i in range(len(w)) for j in range(len(w)))
    s = shingles(h[:3], 2)
    assert len(set(s.tolist())) == 2 and len(shingles(h[:1], 2)) == 0


def test_twins_are_not_linked(spark):
    docs = spark.createDataFrame([(1, TWINS[0]), (2, TWINS[1]), (3, "plain prose of some words"), (4, TWINS[0])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.linked(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}


def test_twins_are_no_repeated_words():
    text = " ".join(f"w{i}" for i in range(8)) + f" {TWINS[0]} " + " ".join(f"w{i}" for i in range(7)) + f" {TWINS[1]} tail"
    buf, off = flat(pa.array([text]))
    start, end, doc = words(buf, off)
    w = text.split()
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    want = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
    assert int(quality._repeated(word_hashes(buf, start, end), doc).sum()) == len(want) == 0


NAMES = ["score", "keep_of", "keep_id", "keep_node", "node", "findings", "blob", "carrier", "sid", "mix_parts", "size", "start", "rest_of_row", "component", "y", "key"]


def test_stages_keep_columns_of_any_name(spark):
    texts = [f"word{i} and some more words of document {i} password=secret{i}99" for i in range(8)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit(777) + F.col("doc_id").cast("int") for n in NAMES})
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    for out in (toxicity.clean(docs, labels), jaccard.representatives(docs), ledger.redacted(docs), mixing.mixed_documents(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == 777 + r["doc_id"] for r in rows for n in NAMES)


def test_permutations_and_their_inverses():
    for n in (1, 2, 3, 7, 64, 1000, 1025):
        j, size, key = np.arange(n), np.full(n, n), np.full(n, 12345)
        image = mixing.permuted(j, size, key)
        assert sorted(image.tolist()) == list(range(n))
        assert (mixing.permuted(image, size, key, back=True) == j).all()
    big = 1 << 40
    x = mixing.permuted(np.array([big - 1]), np.array([big]), np.array([9]), back=True)
    assert mixing.permuted(x, np.array([big]), np.array([9]))[0] == big - 1


def test_the_short_block_is_accounted_for():
    """The slots of a source are those whose words come nearest the target, found by walking all blocks."""
    for sizes, goal in (([1000], [700.0]), ([33, 500], [99.0, 350.0]), ([65], [40.0])):
        need, _ = mixing.plan(sizes, goal, block=32, seed=4)
        for sid, (n, t, got) in enumerate(zip(sizes, goal, need)):
            blocks = -(-n // 32)

            def words_of(slots):
                each = [mixing.permuted(*(np.array([x]) for x in (s % blocks, blocks, mixing._key(sid, s // blocks, 4))))[0] for s in range(slots)]
                return sum(32 if b < blocks - 1 else n - 32 * (blocks - 1) for b in each)
            best = min(abs(words_of(s) - t) for s in range(3 * blocks + 1))
            assert abs(words_of(got) - t) <= best + 1e-9


