"""Ranked lexical search against brute force."""

import math
import re
from collections import Counter

import pytest

from panelwright.llm import lexical

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(AZ)))


def brute(docs, items, top):
    """item_id -> its (score, doc_id) in order, for every item."""
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            score = sum(q * w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in terms(text).items() if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:top])]
    return Counter(out)


def run(docs, items, top=10):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(docs, items, top).collect())


def test_odd_rows(spark):
    docs = [(1, "Red fox, red FOX; the end"), (2, "the the the"), (2, "red fox"), (2, "red fox"), (None, "red fox"), (3, None), (4, ""), (5, "?! .,"), (6, "ÉCOLE école Été2 x_y"), (7, "the fox " * 400_000 + "tail"), (8, "THE\x00fox\x7fred")]
    docs += [(100 + i, "the common words of everyone") for i in range(60)]
    items = [(1, "red fox fox"), (1, "the"), (2, None), (3, "no such thing"), (None, "école ÉCOLE Été2 y"), (5, "THE end of everyone, common or red"), (6, "the tail")]
    a = spark.createDataFrame([(d, t, "clash", 1, 2) for d, t in docs], "doc_id long, text string, term string, bundle int, block long").repartition(4)
    b = spark.createDataFrame([(d, t, "clash") for d, t in items], "item_id long, text string, owner string")
    assert run(a, b, 3) == brute(docs, items, 3)
    assert run(a.limit(0), b) == run(a, b.limit(0)) == Counter()


@pytest.mark.parametrize("bundle, block", [(128, 1024), (7, 16)])
def test_table_in_few_and_in_many_blocks(spark, monkeypatch, bundle, block):
    """Blocks so small that bounds come from other blocks, and several bundles."""
    monkeypatch.setattr(lexical, "BUNDLE", bundle)
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert run(docs, items, 5) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 5)


def test_a_saturated_filter_and_the_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SMALL", 0)
    monkeypatch.setattr(lexical, "_term_filter", lambda terms: b"\xff" * (1 << (lexical.FILTER - 3)))
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").filter("item_id < 8")
    assert run(docs, items) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
