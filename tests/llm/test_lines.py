"""Line deduplication against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from panelwright.llm import linededup

SF = "/root/testdata/sf0.001"
TRIM = " \t\n\x0b\x0c\r"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_lines int, keep string, places int, salt int, h1 string"
ODD = [
    (5, "A shared line here\nown line of five\n\na shared line here  "), (3, "\t A SHARED LINE HERE\r\nshort\nshort"), (9, None), (9, ""), (None, "a shared line here\nonly the null one"), (None, "only the null one"),
    (7, "short\nÉCOLE DU NORD\nécole du nord\nÉcole du nord"), (8, "ÉCOLE DU NORD\nÉcole du nord\n123456789\n1234567890"), (4, "1234567890\n123456789"), (6, "twice the same row\nx"), (6, "twice the same row\nx"), (6, "twice the same row\nanother text of it"),
    (2, "\n".join(f"line number {i % 7000} of many" for i in range(40_000))), (1, "\n".join(f"LINE number {i} of many " for i in range(0, 7000, 3))), (10, "x" * 3_000_000 + "\na shared line here"), (11, "\n\n\n"), (12, "a shared line here"),
]


def brute(rows):
    last = float("inf")
    first = defaultdict(lambda: last)
    key = lambda line: line.strip(TRIM).translate(AZ)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first[key(line)], last if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (last if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def run(docs):
    rows = linededup.deduplicated(docs, linededup.keep_bitmaps(docs)).collect()
    return Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows)


@pytest.mark.parametrize("cut", ["true", "false"])
def test_against_brute_force(spark, cut):
    """With ranges that cut through a key that every document has, and with few ranges."""
    hot = [(1000 + i, f"THE line of every document\nline {i % 50} of some fifty") for i in range(400)] + [(2000, "the line of every document")] * 50
    rows = ODD + hot
    docs = spark.createDataFrame([(d, t, 0, "clash", 1, 2, "clash") for d, t in rows], SCHEMA).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", cut)
    try:
        assert run(docs) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_bitmaps_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "ten letters\nb"), (2, "a\nten letters\nc"), (2, "a\nten letters\nc")], "doc_id long, text string")
    got = {r.doc: (r.n_lines, r.n_dropped, zlib.decompress(r.keep)) for r in linededup.keep_bitmaps(docs).collect()}
    assert got == {1: (2, 0, bytes([0b11000000])), 2: (3, 1, bytes([0b10100000]))}
    assert linededup.keep_bitmaps(docs.limit(0)).count() == 0 and run(docs.limit(0)) == Counter()
