"""Collocations against brute force, in one batch of first words and in many."""

import random
import re
from collections import Counter

import pytest

from panelwright.llm import phrases

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            counts.update((lang or "und", *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    found = {p: c for p, c in counts.items() if len(p) > 2 and c >= least}
    inside = {(p[0], *q) for p, c in found.items() for q in (p[1:-1], p[2:]) if counts[(p[0], *q)] == c}
    out = []
    for p, a in found.items():
        if p in inside:
            continue
        lang, *w = p
        score, _, l, r = min(((1000 * a * totals[lang]) // (counts[(lang, *w[:k])] * counts[(lang, *w[k:])]), k, counts[(lang, *w[:k])], counts[(lang, *w[k:])]) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r, totals[lang]))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, l, r, n in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, l, r, n, -score))
    return Counter(ranked)


def run(docs, **options):
    return Counter(map(tuple, phrases.collocations(docs, **options).collect()))


def made(n, seed=5):
    """Texts with words of very unequal frequency, some phrases that always come whole, and repeats."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    fixed = ["North Sea oil", "to be or not to be", "écolé Du nord", "a a a a a a", "x y"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(common[: 1 + rng.randrange(12)]) if rng.random() < 0.9 else f"rare{rng.randrange(60)}" for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "en", "en", "de", None]), "".join(p + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", ";\x0b", "-"]) for p in parts)))
    return rows


ODD = [("en", None), ("en", ""), (None, " . , ;"), ("fr", "only here"), ("en", "long tail of words " * 40_000), ("de", "no gap" * 100_000 + " end of it"), ("en", "x y\x00z"), ("en", "twice the same row"), ("en", "twice the same row")]


@pytest.mark.parametrize("options", [{"top": 2000}, {"top": 5, "batch": 0.05, "growth": 3}])
def test_against_brute_force(spark, options):
    rows = made(150) + ODD
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "lang string, text string, phrase string, n long, h long").repartition(4)
    assert run(docs, least=5, **options) == brute(rows, 5, options["top"])


def test_bounds_cut_the_search(spark, monkeypatch):
    """A settled language needs no further first words."""
    rows = [("en", f"p{i} q{i}. common {'words and more'.split()[i % 3]} p{i} q{i}") for i in range(40) for _ in range(2 + i // 10)]
    grown = []
    monkeypatch.setattr(phrases, "_grow", lambda *x, f=phrases._grow: grown.append(sorted(r.c for r in x[3].collect())) or f(*x))
    assert run(spark.createDataFrame(rows, "lang string, text string"), least=4, top=10, batch=0.01, growth=3) == brute(rows, 4, 10)
    # The twenty rarest first words tie; the pairs found among them settle the language.
    assert grown == [[4] * 20]


def test_blocks_and_merges_do_not_matter(spark, monkeypatch):
    import numpy as np

    texts = [t or "" for _, t in made(60) + ODD[:5]]
    whole = phrases.words_of(texts, np.zeros(len(texts), np.uint64))
    monkeypatch.setattr(phrases, "BLOCK", 40)
    cut = phrases.words_of(texts, np.zeros(len(texts), np.uint64))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert ((np.diff(whole[2]) == 0) == (np.diff(cut[2]) == 0)).all()
    held = phrases._Held(["h", "c", "l0", "l1"], ("l0",), ("l1",))
    for part in ([3, 1, 3], [1, 2]):
        h = np.array(part, dtype=np.uint64)
        held.add(h=h, c=np.ones(len(h), dtype=np.int64), l0=np.arange(len(h)), l1=np.arange(len(h)))
    (rows,) = held.out(last=True)
    assert rows.to_pydict() == {"h": [1, 2, 3], "c": [2, 1, 2], "l0": [0, 1, 0], "l1": [1, 1, 2]}


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", "a b")], "lang string, text string")).collect() == []
