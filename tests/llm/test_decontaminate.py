import hashlib

import numpy as np
import pytest
from brute import contamination

from quillstone.llm import decontaminate as D


def check(docs, tests, **more):
    items = [(r.item_id, r.text) for r in tests.collect()]
    got = D.decontaminate(docs, tests, **more).collect()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = sorted((repr(i), *contamination(t, [x for x in items if x[0] is not None])) for i, t in texts)
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    return got


def test_real_documents(spark, documents, benchmark):
    got = check(documents, benchmark)
    assert sum(r.contaminated for r in got) == 3
    assert all(r.n_near >= r.n_items for r in got)


def test_phrases_across_documents_short_items_and_ties(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f"), (3, "x A B c D e f y a b"), (3, "x A B c D e f y a b"), (4, None), (None, "q r"), (5, "the the the")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "b c d"), (2, "F Y!"), (3, "f y"), (4, "..."), (5, None), (6, "the the"), (7, "q")], "item_id long, text string")
    got = {r.doc_id: r for r in check(docs, tests)}
    assert got[3].n_items == 3 and got[1].n_hit == 0 and got[5].n_hit == 3


def test_odd_rows(spark, odd, benchmark):
    check(odd, benchmark)
    assert D.decontaminate(odd.limit(0), benchmark).count() == 0
    assert all(not r.contaminated for r in D.decontaminate(odd, benchmark.limit(0)).collect())


def test_items_without_an_id_and_repeated_items(spark):
    """A null id marks words but is not named; an id that two texts share is named once."""
    docs = spark.createDataFrame([(1, "a b c x d e"), (2, "d e z"), (3, "x y")], "doc_id long, text string")
    tests = spark.createDataFrame([(None, "a b c"), (7, "d e"), (7, "z"), (7, "d e"), (None, None)], "item_id long, text string")
    got = {r.doc_id: r for r in D.decontaminate(docs, tests).collect()}
    assert [(got[i].n_hit, got[i].n_items, got[i].contaminated) for i in (1, 2, 3)] == [(5, 1, True), (3, 1, True), (0, 0, False)]
    assert got[1].items_sha256 == got[2].items_sha256 == hashlib.sha256(b"7").hexdigest()


def test_blocks_of_tests_give_the_same(spark, documents, benchmark):
    index = D.build_index(documents)
    assert sum(len(r.text or "") for r in benchmark.collect()) > 2 * D.PASS_BLOCKS * 800
    one = D.search(index, benchmark).select("doc_id", "n_words", "hits", "items").collect()
    many = D.search(index, benchmark, block_bytes=800).select("doc_id", "n_words", "hits", "items").collect()
    flat = lambda rows: sorted((r.doc_id, r.n_words, tuple(sorted(r.hits)), tuple(sorted(r.items))) for r in rows)
    assert flat(one) == flat(many)


@pytest.mark.parametrize("slop,found", [(0, 0), (1, 1), (2, 1)])
def test_proximity(slop, found):
    text = "k l m zz n o"
    raw = np.frombuffer(text.encode(), np.uint8)
    hashes, by = D.words(raw, np.array([0, len(raw)]))
    place = np.arange(len(hashes), dtype=np.int64) + D.GAP
    order = np.argsort(hashes, kind="stable")
    terms, starts = np.unique(hashes[order], return_index=True)
    phrase, _ = D.intersect(D.phrases(["l m n o"], ["i"]), terms, starts, place[order], slop)
    assert bool(len(phrase)) == bool(found)
