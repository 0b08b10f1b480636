"""The language model against a plain dictionary version, and the whole pipeline against a brute-force one."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import kneser_ney, words
from tests.llm.test_free import brute_classes, encoded
from tests.llm.test_native import ODD, SCHEMA, SF, brute_quality, brute_targets

W = re.compile(r"[^\x20\x09-\x0D]+")


def tokens_of(text):
    return W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def plain_model(texts):
    c, pairs = Counter(), Counter()
    for t in texts:
        k = tokens_of(t)
        c.update(k)
        pairs.update(zip(["<s>", *k], k))
    d = lambda xs: kneser_ney.discounts(*(sum(x == k for x in xs) for k in (1, 2, 3, 4)))
    d2 = d(pairs.values())
    left, ctx = Counter(w for _, w in pairs), defaultdict(Counter)
    for (v, w), n in pairs.items():
        ctx[v][w] = n
    d1 = d(left.values())
    cut = lambda n, ds: ds[min(n, 3) - 1] if n else 0.0
    seen = sum(left.values())
    spread = sum(cut(n, d1) for n in left.values()) / seen

    def p(v, w):
        low = (left[w] - cut(left[w], d1)) / seen + spread / (len(c) + 1)
        if v not in ctx:
            return low
        total = sum(ctx[v].values())
        n = ctx[v][w]
        return (n - cut(n, d2)) / total + sum(cut(x, d2) for x in ctx[v].values()) / total * low

    return c, p


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.createDataFrame([(*r, 0, "clash", 3, "clash", 9) for r in ODD], SCHEMA)
    return own.unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)


def test_scores(spark, docs):
    rows = docs.collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c, p = plain_model([r.text for r in rows if not out(r.doc_id)])
    n, v = sum(c.values()), len(c)
    assert abs(sum(p("the", w) for w in [*c, "\x00never"]) - 1) < 1e-9
    want = defaultdict(list)
    for r in rows:
        k = tokens_of(r.text)
        want[(r.doc_id, out(r.doc_id), len(k), sum(c[t] > 0 for t in k), n)].append((sum(math.log10((c[t] + 1) / (n + v + 1)) for t in k), sum(math.log10(p(a, b)) for a, b in zip(["<s>", *k], k))))
    got = defaultdict(list)
    for r in kneser_ney.score_documents(docs).collect():
        got[(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens)].append((r.base_score, r.score))
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(sorted(got[k]), sorted(want[k]), rtol=1e-9, atol=1e-9)
    far = [x for k, x in want.items() if k[1]]
    assert sum(s for x in far for _, s in x) > sum(b for x in far for b, _ in x)
    assert kneser_ney.score_documents(docs.limit(0)).count() == 0
    assert kneser_ney.score_documents(docs.filter("doc_id = 4")).count() == 2


def test_word_hashes():
    x = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (words.unmix(words.mix(x)) == x).all()
    h, r = words.word_hashes(["a b", "", " \tA  a\n", "ba ab é", ""], lower=True)
    assert r.tolist() == [0, 0, 2, 2, 3, 3, 3] and h[0] == h[2] == h[3] and len(set(h.tolist())) == 5
    assert len(words.word_hashes([])[0]) == len(words.word_hashes(["", " "])[0]) == 0


def test_pipeline_stages(spark, docs):
    docs = docs.withColumn("doc_id", F.when(F.col("words") == "clash", F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id")))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "mix_sources", "pack_sequences"]
    first = corpus_pipeline.quality_rules(spark, docs, SF)
    assert first.columns == docs.columns
    rows = [r for r in docs.collect() if brute_quality(r.text)[-1]]
    assert Counter(map(tuple, first.collect())) == Counter(map(tuple, rows))
    second = corpus_pipeline.near_dedup(spark, first, SF).cache()
    kept = Counter(r.doc_id for r in second.collect())
    assert second.columns == docs.columns and kept == Counter({k for _, k in brute_classes(rows)})
    third = corpus_pipeline.mix_sources(spark, second, SF).cache()
    assert third.columns == docs.columns
    sizes = Counter()
    for r in second.collect():
        sizes[r.source] += len(W.findall(r.text or ""))
    got = Counter()
    for r in third.collect():
        got[r.source] += len(W.findall(r.text or ""))
    assert all(abs(got[s] - t) <= 1 for s, t in brute_targets(sizes).items())
    last = corpus_pipeline.pack_sequences(spark, third, SF)
    mixed = third.collect()
    assert Counter((r.doc_id, len(i)) for r, i in zip(mixed, encoded("byte_bpe_50k.json", mixed, 0)) if len(i) <= 2048) - Counter((r.doc_id, r.length) for r in last.filter("start = 0").collect()) == Counter()
    assert corpus_pipeline.run(spark, SF).count() > 0


def plain_trigrams(texts):
    triples, c = Counter(), Counter()
    for t in texts:
        k = tokens_of(t)
        c.update(k)
        triples.update(zip(["<s>", "<s>", *k], ["<s>", *k], k))
    pairs = Counter((v, w) for _, v, w in triples)
    levels = [(triples, lambda x: x[:2]), (pairs, lambda x: x[:1]), (Counter(w for _, w in pairs), None)]
    d = [kneser_ney.discounts(*(sum(x == k for x in n.values()) for k in (1, 2, 3, 4))) for n, _ in levels]
    cut = lambda n, ds: ds[min(n, 3) - 1] if n else 0.0
    total, mass = [Counter(), Counter()], [Counter(), Counter()]
    for i in (0, 1):
        for x, n in levels[i][0].items():
            total[i][levels[i][1](x)] += n
            mass[i][levels[i][1](x)] += cut(n, d[i])
    left = levels[2][0]
    seen = sum(left.values())
    spread = sum(cut(n, d[2]) for n in left.values()) / seen

    def p(u, v, w):
        out = (left[w] - cut(left[w], d[2])) / seen + spread / (len(c) + 1)
        for i, x in ((1, (v, w)), (0, (u, v, w))):
            k, n = levels[i][1](x), levels[i][0][x]
            if total[i][k]:
                out = (n - cut(n, d[i])) / total[i][k] + mass[i][k] / total[i][k] * out
        return out

    return c, p


def test_trigram_scores(spark, docs):
    rows = docs.collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c, p = plain_trigrams([r.text for r in rows if not out(r.doc_id)])
    for u, v in (("<s>", "<s>"), ("<s>", "the"), ("of", "the"), ("never", "seen")):
        assert abs(sum(p(u, v, w) for w in [*c, "\x00never"]) - 1) < 1e-9
    want, got = defaultdict(list), defaultdict(list)
    for r in rows:
        k = tokens_of(r.text)
        want[r.doc_id, len(k)].append(sum(math.log10(p(*x)) for x in zip(["<s>", "<s>", *k], ["<s>", *k], k)))
    for r in kneser_ney.score_documents(docs, order=3).collect():
        got[r.doc_id, r.n_tokens].append(r.score)
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(sorted(got[k]), sorted(want[k]), rtol=1e-9, atol=1e-9)
    assert kneser_ney.score_documents(docs.filter("doc_id = 4"), order=3).count() == 2
    with pytest.raises(ValueError):
        kneser_ney.score_documents(docs, order=4)


def test_scores_do_not_depend_on_the_number_of_segments(spark, docs, monkeypatch):
    def scores():
        return sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 7), round(r.score, 7)) for r in kneser_ney.score_documents(docs, order=3).collect())

    few = scores()
    monkeypatch.setattr(kneser_ney, "WORD_CHARS", 20_000)
    monkeypatch.setattr(kneser_ney, "PAIR_CHARS", 3_000)
    monkeypatch.setattr(kneser_ney, "SLICE", 5_000)
    monkeypatch.setattr(kneser_ney, "RUN", 2_000)
    monkeypatch.setattr(kneser_ney, "MAPPED", 50)
    assert scores() == few


def test_triples_of_any_segment_place_and_word():
    """Segment, place and word together take up to 94 bits."""
    r = np.random.default_rng(1)
    segments, local, word = (r.choice(np.concatenate([r.integers(0, top, 30), [0, top - 1]]), 20_000) for top in (1 << 30, 1 << 32, (1 << 32) - 1))
    segs, keys, back, n = kneser_ney.distinct_triples((segments << 32) | local, word, return_inverse=True, return_counts=True)
    triples = list(zip(segments.tolist(), local.tolist(), word.tolist()))
    found = list(zip(segs.tolist(), (keys >> np.uint64(32)).tolist(), (keys & np.uint64(0xFFFFFFFF)).tolist()))
    assert found == sorted(set(triples)) and dict(zip(found, n.tolist())) == Counter(triples)
    assert [found[k] for k in back] == triples
