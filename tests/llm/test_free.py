"""Packing, near-duplicates, the archive, token files and neighbours against brute force, on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import neardup, neighbours, packing, tokenfile, tokens, warc
from tests.llm.test_native import ODD, SCHEMA, SF


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.createDataFrame([(*r, 0, "clash", 3, "clash", 9) for r in ODD], SCHEMA)
    return own.unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)


def encoded(name, rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary(name))
    return [[*e.ids, end] for e in t.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_tokenizer(name):
    import random

    rng, alphabet = random.Random(5), "ab Z'é\n\t.,!|<>12  ß́İ's\x85　漢"
    texts = ["", " ", "\n", "a  b", "a \n b", "we'll 's", "<|endoftext|>x<|startoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "İSTANBUL straße ª"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    from tokenizers import Tokenizer

    e, plain = tokens.Encoder(tokens.vocabulary(name)), Tokenizer.from_file(tokens.vocabulary(name))
    for t, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == want.ids, repr(t)


def test_packing(spark, docs):
    rows = docs.collect()
    want = Counter()
    for r, ids in zip(rows, encoded("byte_bpe_50k.json", rows, 0)):
        at = 0
        for k in range(-(-len(ids) // 2048)):
            n = len(ids) % 2048 or 2048 if k == 0 else 2048
            want[(r.doc_id, k, at, n, crc(ids[at : at + n]))] += 1
            at += n
    packed = packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"), with_ids=True)
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(seqs) <= 1.02 * sum(r.length for r in got) / 2048 + 1
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert sum(map(len, whole.values())) == sum(r.length for r in got)
    assert packing.pack(docs.limit(0), tokens.vocabulary("byte_bpe_50k.json")).count() == 0


def test_plan_is_valid_and_reduction_never_costs_a_sequence():
    from itertools import combinations_with_replacement

    def optimum(items, cap):
        items, best = sorted(items, reverse=True), [len(items)]

        def go(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for r in {r for r in rooms if r >= items[i]}:
                k = rooms.index(r)
                go(i + 1, [*rooms[:k], r - items[i], *rooms[k + 1 :]])
            go(i + 1, [*rooms, cap - items[i]])

        go(0, [])
        return best[0]

    for items in combinations_with_replacement([2, 3, 4, 5, 7, 8, 10], 6):
        counts = Counter(items)
        fixed, rest = packing.reduce_by_dominance(dict(counts), 10)
        assert sum(t for _, t in fixed) + optimum(list(Counter(rest).elements()), 10) == optimum(items, 10)
        slots = packing.plan(dict(counts), 10)
        assert Counter(s for s, _, n, *_ in slots for _ in range(n)) == counts
    rng = np.random.default_rng(1)
    big = Counter(rng.integers(1, 2049, 200_000).tolist())
    slots = packing.plan(dict(big), 2048)
    assert len(slots) < 30_000
    assert max(q + n for _, _, n, q, _ in slots) <= 1.01 * sum(s * n for s, n in big.items()) / 2048


def brute_similarity(x, y):
    """Probability Jaccard of two counters of shingles with weights 1 + ln(count), by its definition."""
    x, y = ({k: 1 + math.log(n) for k, n in c.items()} for c in (x, y))
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def brute_classes(rows, threshold=0.8):
    sets, parent = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        t = r.text or ""
        w = t.encode().split()
        sets[t] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
        parent[t] = t
    inverted = defaultdict(set)
    for t in sets:
        for s in sets[t]:
            inverted[s].add(t)
    pairs = {(a, b) for group in inverted.values() for a in group for b in group if a < b}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        if max(x.values()) == max(y.values()) == 1:
            linked = len(x.keys() & y.keys()) >= threshold * len(x.keys() | y.keys())
        else:
            linked = 3 * len(x.keys() & y.keys()) > len(x.keys() | y.keys()) and brute_similarity(x, y) >= threshold
        if linked:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for r in rows:
        k = find(r.text or "")
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    return Counter((r.doc_id, least.get(find(r.text or ""))) for r in rows)


def test_near_duplicates(spark, docs):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    extra = []
    for i in range(60):  # many copies of one text, each far from most others
        w = list(base)
        for p in rng.integers(0, 300, 7):
            w[p] = f"x{i}"
        extra.append((100_000 + i, " ".join(w)))
    for i in range(40):  # half of a text repeated, and the copies of that changed in place
        half = [f"r{i % 4}_{k}" for k in range(100)]
        w = half * 20 + [f"s{i % 4}_{k}" for k in range(100)] + [f"t{i}_{k}" for k in range(i // 4)]
        extra.append((300_000 + i, " ".join(w)))
    extra += [(200_000, "one two three four"), (200_001, "one  two\nthree four"), (200_002, None), (200_003, " \n"), (None, "only nulls here"), (200_004, " ".join(base))]
    more = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    rows = more.collect()
    got = neardup.near_duplicates(more)
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == brute_classes(rows)
    kept = neardup.deduplicate(more)
    assert kept.columns == more.columns
    ids = {}
    for r in neardup.classes(more).collect():
        k = bytes(r.root)
        ids[k] = min(ids.get(k, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(ids.values())
    assert neardup.near_duplicates(docs.limit(0)).count() == 0 and neardup.deduplicate(docs.limit(0)).count() == 0


def test_signatures_estimate_probability_jaccard():
    a, b = " ".join(f"w{i}" for i in range(404)), " ".join(f"w{i}" for i in range(100, 504))
    c = " ".join([a] * 5 + [f"x{i}" for i in range(60)])
    s = neardup.signatures([a, b, a, "", c], 4096)
    assert (s[0] == s[2]).all() and not s[3].any()
    assert abs(neardup.estimate(s[0], s[1]) - neardup.jaccard(a, b)) < 0.03
    assert abs(neardup.estimate(s[1], s[4]) - neardup.jaccard(b, c)) < 0.03
    x, y = ({k: 1 + k % 3 for k in range(60)}, {k: 1 + k % 4 for k in range(20, 90)})
    want = brute_similarity(x, y)
    got = neardup.similarity(*((np.array(list(c)), 1 + np.log(np.array(list(c.values())))) for c in (x, y)))
    assert abs(want - got) < 1e-12


def test_long_texts_are_hashed_in_blocks():
    from panelwright.llm import words

    rng = np.random.default_rng(8)
    long = " ".join(f"w{i}" for i in rng.integers(0, 9999, 150_000)) + " " + "z" * (3 * words.BLOCK) + "\t end"
    h, rows = words.word_hashes(["a b", long, "", "end a"])
    parts = long.split()
    assert rows.tolist() == [0, 0] + [1] * len(parts) + [3, 3]
    unique = {w: words.word_hashes([w])[0][0] for w in set(parts)}
    assert h[2:-2].tolist() == [unique[w] for w in parts] and h[0] == h[-1] and h[-2] == unique["end"]
    assert (neardup.signatures([long])[0] == neardup.signatures(["x", long])[1]).all()


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in neardup.components(chain).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 203


def test_archive(spark):
    rows = [(3, "http://x/é\r\nA: b", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (7, "u", ""), (9, "v", "z" * 200_000), (None, "w", "q"), (4, "w", "q"), (None, "n", "lone"), (5, "a", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    both = pages.unionByName(spark.read.parquet(f"{SF}/pages.parquet"), allowMissingColumns=True)
    rows = both.collect()
    least = {}
    for r in rows:
        if r.page_id is not None:
            least[r.html or ""] = min(least.get(r.html or "", r.page_id), r.page_id)
    want = Counter()
    for r in rows:
        b = (r.html or "").encode()
        first = least.get(r.html or "")
        own = r.page_id == first
        want[(r.page_id, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else first)] += 1
    records = warc.archive(both)
    assert Counter(map(tuple, warc.digests(records).collect())) == want
    assert records.filter("not payload_ok or payload is null").count() == 0
    for damaged in (records.withColumn("payload_ok", F.lit(False)), records.withColumn("payload", F.lit(b"other")), records.withColumn("payload_ok", F.lit(None).cast("boolean"))):
        with pytest.raises(Exception, match="payload lost or damaged"):
            warc.digests(damaged).collect()
    for r in warc.warc_bytes(records).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n") and len(rest) - 4 == int(fields[b"Content-Length"])
    assert warc.digests(warc.archive(pages.limit(0))).count() == 0


def test_token_files(spark, docs):
    rows = docs.collect()
    got = tokenfile.encode_documents(docs, tokens.vocabulary("word_bpe_49k.json")).orderBy("start").collect()
    want = Counter((r.doc_id, len(ids), crc(ids)) for r, ids in zip(rows, encoded("word_bpe_49k.json", rows, 2)))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    assert tokenfile.encode_documents(docs.limit(0), tokens.vocabulary("word_bpe_49k.json")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    x = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 24)) * 0.7).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5050, [0.0] * 24, 0), (5100, [float("nan")] * 24, 0), (5150, [None] + [1.0] * 23, 0), (None, [1.0] * 24, 0), (5200, [], 0), (50, x[50].tolist(), 0), (5250, [float("inf")] + [1.0] * 23, 0), (6000, [1.0, 2.0], 0), (6001, [2.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")
    got = defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    y = x.astype(float)
    n = np.sqrt((y * y).sum(1))
    hits = 0
    assert sorted(got) == [*range(0, 3000, 50), 6000] and [f[:2] for f in got.pop(6000)] == [(1, 6001)]
    twice = got.pop(50)  # two rows of one id and vector, each the other's nearest
    assert sorted(f[:2] for f in twice)[:2] == [(1, 50), (1, 50)] and len(twice) == 10
    for q, found in got.items():
        s = (y * y[q]).sum(1) / (n * n[q])
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -s))[:5]
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(s[i] - v) < 1e-12 for _, i, v in found)
        assert [(-v, i) for _, i, v in found] == sorted((-v, i) for _, i, v in found)
        hits += len(set(best) & {i for _, i, _ in found})
    assert hits >= 0.9 * 5 * len(got)
    assert [i for _, i, _ in got[150]] == [100, 101, 102, 103, 104] and [i for _, i, _ in got[100]] == [101, 102, 103, 104, 105]
    assert neighbours.nearest(df.filter("vec_id < 3")).count() == 2
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_neighbours_with_more_axes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    y = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    s = y[::50] @ y.T
    s[np.arange(len(s)), np.arange(0, 4000, 50)] = -9
    best = {50 * q: set(r[:5]) for q, r in enumerate(np.argsort(-s, axis=1).tolist())}
    for options in ({}, {"block": 10}, {"axes": 2, "probes": 2500}):
        found = defaultdict(set)
        for r in neighbours.nearest(df, **options).collect():
            found[r.query_id].add(r.vec_id)
        assert sum(len(best[q] & found[q]) for q in best) >= 0.9 * 5 * len(best), options
    with pytest.raises(ValueError):
        neighbours.nearest(df, axes=2)
    # Queries whose buckets hold too few are compared with all rows.
    few = defaultdict(list)
    for r in neighbours.nearest(df.filter("vec_id < 400"), tables=1, probes=1, axes=2).orderBy("query_id", "rank").collect():
        few[r.query_id].append(r.vec_id)
    assert len(few) == 8 and all(len(f) == 5 for f in few.values())
    exact = sum(set(few[q]) == {i for i in np.lexsort((np.arange(400), -s[q // 50][:400]))[:5]} for q in few)
    assert exact >= 7


def test_copies_of_one_text_all_linked(spark):
    rng = np.random.default_rng(6)
    base = [f"v{i}" for i in rng.integers(0, 5000, 300)]
    rows = []
    for i in range(600):
        w = list(base)
        w[int(rng.integers(0, 300))] = f"y{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, "one and the same text of more than five words") for i in range(600, 900)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_copies) for r in got) == Counter([(i, 0, 1) for i in range(600)] + [(i, 600, 300) for i in range(600, 900)])


def test_token_files_are_laid_out_for_selective_reads(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    df = spark.createDataFrame([(i, f"word{i % 97} " * (i % 50)) for i in range(9000)], "doc_id long, text string").repartition(1)
    tokenfile.write_tokens(df, path, tokens.vocabulary("word_bpe_49k.json"))
    files = sorted((tmp_path / "tokens").glob("*.parquet"))
    kinds, pages = set(), 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = next(c for n, c in columns.items() if n.startswith("ids"))
            kinds |= set(ids.encodings)
            assert all(c.has_offset_index for c in columns.values()) and columns["doc_id"].has_column_index
            assert columns["doc_id"].statistics.min <= columns["doc_id"].statistics.max
            pages += 1
    assert pages and {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & kinds
    few = spark.read.parquet(path).filter("doc_id between 100 and 109").select("doc_id", "n_tokens")
    plan = few._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and "GreaterThanOrEqual(doc_id,100)" in plan
    assert few.count() == 10
    index = {r.doc_id: r.start for r in tokenfile.read_index(spark, path).collect()}
    assert len(index) == 9000 and index[0] == 0 and index[5] < index[6]


def test_a_text_of_twenty_megabytes(spark):
    body = " ".join(f"w{i * 7919 % 1_000_003}" for i in range(2_500_000))
    assert len(body) > 18_000_000
    df = spark.createDataFrame([(1, body), (2, body + " tail"), (3, "short text of some words here")], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    from panelwright.llm import kneser_ney

    rows = {r.doc_id: r for r in kneser_ney.score_documents(df, order=3).collect()}
    assert rows[1].n_tokens == 2_500_001 and rows[2].n_tokens == 2_500_002
