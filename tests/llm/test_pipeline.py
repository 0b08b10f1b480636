"""The rows of the whole pipeline against a brute-force version of its four stages."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import quality
from tests.llm.test_free import brute_classes, crc, encoded
from tests.llm.test_native import W, brute_quality, brute_targets

SF = "/root/testdata/sf0.001"


def brute_mix(rows, key):
    """(row, text) of every copy that the mix takes: sources in order of a hash, cut where their budgets end."""
    sources = defaultdict(list)
    for r in rows:
        sources[r.source].append((key[r.doc_id, r.text], len(W.findall(r.text or "")), r))
    targets = brute_targets({s: sum(n for _, n, _ in x) for s, x in sources.items()})
    out = []
    for s, x in sources.items():
        total, before = sum(n for _, n, _ in x), 0
        budget = int(targets[s] + 0.5)
        epochs, rest = divmod(budget, total)
        for _, n, r in sorted(x, key=lambda y: y[0]):
            taken = epochs * n + max(0, min(n, rest - before))
            before += n
            if n:
                out += [(r, r.text)] * (taken // n)
                if taken % n:
                    out.append((r, "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r.text)[: taken % n])))
    return out


def test_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [r for r in docs.collect() if brute_quality(r.text)[-1]]
    first = {i for _, i in brute_classes(kept)}
    single = [r for r in kept if r.doc_id in first]
    assert len(single) < len(kept) < docs.count()
    # The order within a source is a stated hash; everything else is worked out here.
    hashes = docs.select("doc_id", "text", F.xxhash64(F.lit(7), "doc_id", "text").alias("h")).collect()
    mixed = brute_mix(single, {(r.doc_id, r.text): r.h & (1 << 64) - 1 for r in hashes})
    want = Counter()
    for (r, _), ids in zip(mixed, encoded("byte_bpe_50k.json", [type("Row", (), {"text": t}) for _, t in mixed], 0)):
        at = 0
        for k in range(-(-len(ids) // 2048)):
            n = (len(ids) % 2048 or 2048) if k == 0 else 2048
            want[r.doc_id, k, at, n, crc(ids[at : at + n])] += 1
            at += n
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 2048
    # Best fit wastes little on so many short pieces.
    assert len(places) <= 1.05 * sum(r.length for r in got) / 2048 + 1


def test_rules_go_by_rejection_per_cost(spark):
    """A cheap rule that rejects all comes before a dear one that rejects nothing, whatever the order given."""
    docs = quality.with_words(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    cheap = quality.Rule("cheap", lambda: F.size("words") >= 0)
    dear = quality.Rule("dear", lambda: 100 * quality.repeated_words(F.col("words")) < 0)
    for rules in ([cheap, dear], [dear, cheap]):
        assert [r.name for r in quality.plan(docs.drop("words"), rules)] == ["cheap", "dear"]
        assert {r.rejected_by for r in quality.cascade(docs, quality.plan(docs.drop("words"), rules)).collect()} == {"cheap"}
