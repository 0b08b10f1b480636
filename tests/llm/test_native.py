"""The native operators against brute force on small tables, with nulls, empty texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from panelwright.llm import chat, mixing, quality, queries, sharding

SF = "/root/testdata/sf0.001"
W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, size int, row string, slot int"
ODD = [
    (1, "a b c a b c a b c", "en", "s1"), (2, None, None, None), (3, "", "en", "s2"), (3, "", "en", "s2"), (None, "x  y\tz\n\nx y z\nx y z", "en", None),
    (4, "one two three four " * 3000, "en", "s1"), (5, "é|ü # $ <|im_end|> \\ ok", "fr", "s3"), (5, "é|ü # $ <|im_end|> \\ ok", "fr", "s3"), (6, "LOUD WORDS " * 60, "en", "s2"),
    (7, " ".join(f"w{i}" for i in range(80)), "de", "s2"), (8, "\n".join(["same line here"] * 30), "de", "s3"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "clash", 3, "clash", 9) for r in ODD], SCHEMA)


def brute_quality(text):
    t = text or ""
    w = W.findall(t)
    lines = [x for x in t.split("\n") if W.search(x)]
    g = Counter(zip(w, w[1:], w[2:]))
    marked = {k + j for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    n_sym, caps = len(re.findall(r"[#*$%&|<>]", t)), len(re.findall("[A-ZÀ-ÖØ-Þ]", t))
    chars = sum(map(len, w))
    dup = len(lines) - len(set(lines))
    bad = failed or 10 * n_sym > len(w) or chars < 2 * len(w) or chars > 15 * len(w) or dup > 0.4 * len(lines) or caps > 0.3 * len(t)
    return len(w), chars, n_sym, dup, len(marked), failed, not bad


def test_quality_measures(spark, odd):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    want = Counter((r.doc_id, *brute_quality(r.text)) for r in docs.collect())
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.measure(docs).collect())
    assert got == want


def test_quality_filter_keeps_rows_as_they_are(spark, odd):
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r in odd.collect() if brute_quality(r.text)[-1])
    assert quality.filter_documents(odd.limit(0)).count() == 0


def test_cascade_order_is_by_rejection_per_cost_and_never_changes_verdicts(spark):
    docs = quality.with_words(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    rules = quality.default_rules()
    a = {(r.doc_id, r.text): r.kept for r in quality.cascade(docs, rules).collect()}
    b = {(r.doc_id, r.text): r.kept for r in quality.cascade(docs, rules[::-1]).collect()}
    assert a == b
    assert sorted(r.name for r in quality.plan(docs.drop("words"), rules)) == sorted(r.name for r in rules)


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        level = (total - sum(out.values())) / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * level >= most * sizes[s]]
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_mix(spark, odd, which):
    docs = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(W.findall(r.text or ""))
    want = brute_targets(sizes)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len(W.findall(r.text or ""))) for r in rows)
    by_target = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by_target[(r.source_size, round(r.target, 4))] += r.taken
    goals = Counter()
    for s, t in want.items():
        goals[(sizes[s], round(t, 4))] += t
    assert set(by_target) == set(goals)
    assert all(abs(by_target[k] - goals[k]) <= len(sizes) for k in goals)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    assert sum(len(W.findall(r.text or "")) for r in whole.collect()) == sum(r.taken for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_shards(spark, odd):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    got = sharding.assign(docs).collect()
    enc = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(b) + 1, zlib.crc32(b)) for i, b in enc)
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 16) for r in got) and any(r.grown_shard == 16 for r in got)
    grown = {r.doc_id: r.shard for r in sharding.assign(docs, 17).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    weighted = Counter(r.shard for r in spark.range(20000).select(sharding.shard_of(F.col("id"), {0: 1.0, 1: 3.0}).alias("shard")).collect())
    assert 2.7 < weighted[1] / weighted[0] < 3.3
    assert sharding.assign(docs.limit(0)).count() == 0


def brute_chat(rows):
    convs = {}
    for r in sorted(rows, key=lambda r: (r.turn is not None, r.turn, r.role is not None, r.role or "", r.text is not None, r.text or "")):
        convs.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    out = {}
    for k, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        full = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[k] = (len(turns), hashlib.sha256(full.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", odd), (-1, 1, "assistant", odd), (None, 1, "user", "\\|<\\|\\\\"), (None, 2, "assistant", None), (9, 1, "assistant", "\n<|\\"), (9, 1, "assistant", "\n<|\\"), (9, None, None, ""), (8, 1, "a\nb <|im_start|>", "é😀<|"), (8, 2, "assistant", "x" * 100_000)]
    extra = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, score int")
    both = extra.select("conv_id", "turn", "role", "text").unionByName(spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chat.write_conversations(chat.linear_tree(both))).collect()}
    assert got == brute_chat(both.collect())
    narrow = chat.write_conversations(chat.linear_tree(both), skeleton=chat.linear_tree(both, texts=False))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(narrow).collect()} == got
    formatted = {r.conv_id: r.formatted for r in chat.format_paths(chat.linear_tree(both)).collect()}
    assert all(f.count("<|im_start|>") == got[k][0] for k, f in formatted.items())
    assert chat.digests(chat.format_paths(chat.linear_tree(extra.limit(0)))).count() == 0


def test_chat_picks_the_best_path(spark):
    nodes = [("t", 1, None, 1.0), ("t", 2, 1, 0.5), ("t", 3, 1, 2.0), ("t", 4, 2, 5.0), ("t", 5, 3, 1.0), ("t", 6, 5, 1.0), ("u", 1, 99, 0.0), ("v", 1, 2, 0.0), ("v", 2, 1, 0.0), (None, 7, None, None), (None, 8, 7, 3.0), (None, 9, 7, 3.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    got = sorted((r.tree or "", r.depth, r.node) for r in chat.chosen_paths(df).collect())
    assert got == [("", 0, 7), ("", 1, 8), ("t", 0, 1), ("t", 1, 2), ("t", 2, 4), ("u", 0, 1)]
    every = {(r.tree or "", r.path): [] for r in chat.chosen_paths(df, None).collect()}
    for r in chat.chosen_paths(df, None).orderBy("depth").collect():
        every[r.tree or "", r.path].append(r.node)
    assert every == {("", 1): [7, 8], ("", 2): [7, 9], ("t", 1): [1, 2, 4], ("t", 2): [1, 3, 5, 6], ("u", 1): [1]}
    texts = df.withColumn("role", F.lit("user")).withColumn("text", F.col("node").cast("string"))
    shown = {(r.conv_id, r.path): r.formatted for r in chat.format_paths(texts, 2).collect()}
    assert shown["t", 2] == "".join(f"<|im_start|>user\n{n}<|im_end|>\n" for n in (1, 3, 5, 6)) and len(shown) == 5
    long = spark.createDataFrame([("c", i, i - 1 if i else None, 1.0) for i in range(300)], "tree string, node long, parent long, score double")
    assert chat.chosen_paths(long).count() == 300


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    cols = sorted(c[0] for c in want.description)
    order = [c[0] for c in want.description]
    rows = Counter(tuple(r[order.index(c)] for c in cols) for r in want.fetchall())
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == rows


def test_rows_of_two_sources_with_one_id_and_text(spark):
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "a", body), (1, "b", body), (2, "b", body + "\n\nlast line"), (3, None, body), (4, "c", body + "  x\n y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[(r.mix_source, r.doc_id)] += r.taken
    got = Counter()
    for r in mixing.mixed_documents(df).collect():
        got[("0" + r.source if r.source else "1", r.doc_id)] += len(r.text.split())
        assert any(t.startswith(r.text) for i, s, t in rows if (i, s) == (r.doc_id, r.source))
    assert got == Counter({k: n for k, n in taken.items() if n})


def test_rendezvous_choice_recomputed(spark):
    """The winning shard by the scores' definition, in Python, from Spark's own hash."""
    import math

    weights = {0: 1.0, 1: 2.0, 2: 0.5, 3: 1.0}
    df = spark.range(400).select(F.col("id").alias("k"), *[F.xxhash64(F.lit(11), F.lit(s), F.col("id")).alias(f"h{s}") for s in weights], sharding.shard_of(F.col("id"), weights).alias("got"))
    counts = Counter()
    for r in df.collect():
        scores = {}
        for s, w in weights.items():
            u = (((r[f"h{s}"] % (1 << 64)) >> 11) + 0.5) / (1 << 53)
            scores[s] = -w / math.log(u)
        assert r.got == max(scores, key=scores.get)
        counts[r.got] += 1
    assert counts[1] > counts[0] > counts[2]
