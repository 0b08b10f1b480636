"""The registered queries of this subpackage and, where SQL can say them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, kneser_ney, lexical, linededup, mixing, neardup, neighbours, packing, phrases, quality, sharding, tokenfile, warc
from .common import read
from .tokens import vocabulary


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place; null texts are the end id alone. See ``packing.pack``. An empty table gives an empty result."""
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class; null and empty texts are one text. See ``neardup.classes``. An empty table gives an empty result."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back; null html is an empty payload. Ties, repeats and long payloads: see ``warc.write_archive``. An empty table gives an empty result."""
    return warc.digests(warc.archive(read(spark, sf_dir, "pages")))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what the mix takes of it. Null sources are one source, null texts have size 0; ties and repeats: see ``mixing.mix``. An empty table gives an empty result."""
    return mixing.mix(read(spark, sf_dir, "documents")).drop("mix_key", "mix_source")


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the trigram model of the training part; null texts are an end token alone. See ``kneser_ney.score_documents``. An empty table gives an empty result."""
    return kneser_ney.score_documents(read(spark, sf_dir, "documents"), order=3)


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; null texts have no words and fail. See ``quality.measure``. An empty table gives an empty result."""
    return quality.measure(read(spark, sf_dir, "documents")).drop("rejected_by")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document from the token files as read back; null texts are the end id alone. See ``tokenfile.write_tokens``. An empty table gives an empty result."""
    return tokenfile.encode_documents(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one made of control strings, read back from the formatted text; null texts are empty. See ``chat.linear_tree``. An empty table gives that one alone."""
    conversations = read(spark, sf_dir, "conversations")
    odd = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = conversations.select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digests(chat.write_conversations(chat.linear_tree(turns), skeleton=chat.linear_tree(turns, texts=False)))


def op9_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard of 16, by law ``key``. See ``sharding.assign``. An empty table gives an empty result."""
    return sharding.assign(read(spark, sf_dir, "documents"))


def op10_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest of each 50th vector among all others; unusable vectors take no part. See ``neighbours.nearest``. An empty table gives an empty result."""
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op11_pipelined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of each item; null texts hold no term. See ``lexical.search``. An empty table gives an empty result."""
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), top=10)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that a smaller doc_id holds; null and empty texts are one empty line. See ``linededup.keep_bitmaps``. An empty table gives an empty result."""
    docs = read(spark, sf_dir, "documents")
    kept = linededup.deduplicated(docs, linededup.keep_bitmaps(docs, least=10))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 2000 phrases of each language; null texts are empty, a null language is ``und``. See ``phrases.collocations``. An empty table gives an empty result."""
    return phrases.collocations(read(spark, sf_dir, "documents"), least=100, top=2000)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_minhash_near_duplicates, op3_warc_archive, op4_mix_sources, op5_kneser_ney, op6_quality_cascade, op7_token_files, op8_chat_trees, op9_rendezvous_shards, op10_cross_polytope_neighbours, op11_pipelined_search, op12_line_dedup, op13_collocations)}

ORACLES: dict[str, str] = {
    "op6_quality_cascade": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS p, words FROM w WHERE len(words) >= 3),
h AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, words[p], words[p + 1], words[p + 2]) AS c FROM g),
r AS (SELECT rid, count(DISTINCT p + k) AS n FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY rid),
m AS (SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_dup_lines > 0.4 * n_lines
            OR len(regexp_extract_all(text, '[A-Z\x{c0}-\x{d6}\x{d8}-\x{de}]')) > 0.3 * length(text)) AS kept
FROM b""".replace("\\\\", "\\"),
    "op8_chat_trees": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role) + 1 + length(text) + (length(text) - length(replace(text, chr(92), ''))) + (length(text) - length(replace(text, '<|', ''))) // 2 + 11) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op11_pipelined_search": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
b AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT rid, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
s AS (SELECT rid, sum(tf) AS n FROM t GROUP BY rid),
g AS (SELECT count(*) AS n_docs, sum(n) AS total FROM s),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM t, g GROUP BY term, n_docs),
m AS (SELECT rid, CAST(100 - 75 + (75 * n * n_docs) // total AS BIGINT) AS m FROM s, g),
c AS (SELECT item_id, rid, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM b JOIN t USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op12_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT rid, k.doc_id, line, p, coalesce(k.doc_id > first_id, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid""",
    "op13_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d),
s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS HUGEINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS m, phrase, string_split(phrase, ' ') AS words, f AS a FROM f WHERE k > 1 AND f >= 100),
x AS (SELECT *, unnest(range(1, m)) AS j FROM c),
y AS (SELECT x.lang, x.phrase, m, a, words, j, p.f AS l, q.f AS r, n.n, CAST(1000 AS HUGEINT) * a * n.n // (CAST(p.f AS HUGEINT) * q.f) AS score
      FROM x JOIN f p ON p.lang = x.lang AND p.phrase = array_to_string(words[1:j], ' ') JOIN f q ON q.lang = x.lang AND q.phrase = array_to_string(words[j + 1:m], ' ') JOIN n ON n.lang = x.lang),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
e AS (SELECT DISTINCT lang, unnest([array_to_string(words[1:m - 1], ' '), array_to_string(words[2:m], ' ')]) AS phrase, a FROM c WHERE m > 2),
t AS (SELECT * FROM z WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.lang = z.lang AND e.phrase = z.phrase AND e.a = z.a)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 2000""",
}
