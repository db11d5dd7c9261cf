"""Work that is done once: one parse for all tags of a document, no trace of pairs whose paths cannot repeat a word, no digest of padding."""
import hashlib

import numpy as np
from pyspark.sql import functions as F

from corpuslab.functions import rouge as rg
from corpuslab.operators import vocab as vc
from corpuslab.sources import archives as ar

XML = ('<d xmlns:p="urn:p"><p:identifier>ID:1</p:identifier><spatial/><subject>a</subject><subject>b&amp;c</subject><subject/><issued>2001-02-03</issued>'
       '<inhoudsindicatie><para> one </para><para/> two<x>three</x></inhoudsindicatie><conclusie>end</conclusie></d>')


def test_tags_of_a_document_are_read_by_few_parses(spark):
    docs = spark.createDataFrame([("2001", "02", XML), ("2001", "02", "<d/>"), ("2001", "02", None)], "year string, month string, xml string")
    out = ar.parse_cases(docs)
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    assert 3 < out._jdf.queryExecution().optimizedPlan().toString().lower().count("xpath") <= 4 + len(ar.MULTI_TAGS) + 3
    a, b, c = out.collect()
    assert (a["identifier"], a["seat_location"], a["creator"], a["jurisdiction"], a["case_number"]) == ("ID:1", "", None, "a|b&c", None)
    assert (a["summary"], a["description"], a["missing_parts"], str(a["issue_date"])) == ("one two three", "end", "none", "2001-02-03 00:00:00")
    for r in (b, c):
        assert r["identifier"] is None and r["jurisdiction"] is None and r["summary"] is None and r["missing_parts"] == "summary|description"


def test_pairs_without_repeated_words_are_not_traced(monkeypatch):
    sents = ["a b c d e.", "b a c e.", "x y.", "c b a a.", "e d c b a."] + [" ".join(f"w{(i * 7 + j) % 130}" for j in range(100)) + "." for i in range(6)]
    with monkeypatch.context() as m:
        m.setattr(rg, "_path_words", None)                 # "c b a a." is the only one with a repeated word, and has no second one to meet
        fast = [rg.redundancy_pairs(sents), rg.redundancy_pairs(sents, ordered_unequal=True)]
    f = lambda x, y: rg.rouge_l_text(x, y)
    pairs = [f(sents[i], sents[j]) for i in range(len(sents)) for j in range(i + 1, len(sents))]
    ordered = [f(x, y) for x in sents for y in sents if x != y]
    assert np.allclose(fast, [np.mean(pairs), np.mean(ordered)], atol=1e-4)


def test_masks_equal_plain_ones_and_padding_has_no_digest(spark):
    ids = [3, 5, 1, 0, 9, 4, 7, 0, 0] * 40
    for prob in (0.0, 0.15, 0.6, 1.0):
        got = spark.createDataFrame([(7, ids)], "doc long, ids array<bigint>").select(vc.mask_ids(F.col("ids"), F.col("doc"), 50, prob=prob).alias("m")).first()["m"]
        for i, t in enumerate(ids):
            h = hashlib.md5(f"7:{i}:42".encode()).hexdigest()
            taken = t != 0 and (int(h[:13], 16) + 0.5) / 16 ** 13 < prob
            kind = int(h[13:20], 16)
            put = 2 if kind < 16 ** 7 * 8 // 10 else 3 + int(h[20:], 16) % 50 if kind < 16 ** 7 * 9 // 10 else t
            assert (got["masked"][i], got["labels"][i]) == ((put, t) if taken else (t, -100))
    one = str(vc.mask_ids(F.col("ids"), F.col("doc"), 50)._jc.toString())
    assert one.lower().count("conv(") <= 1
