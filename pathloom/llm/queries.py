"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, html_blocks, licenses, ordinal, pii, preferences, sentencepieces, toxicity, whitening
from .fmindex import contamination
from .jaccard import jaccard_classes
from .packing import pack_documents
from .permutation import nearest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The vocabulary that packing encodes with, where the tokenizers' package put it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces() -> str:
    """The model of the SentencePiece operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_ordinal_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 (poor), 1 (good but toxic), 2 (good and clean) from the two labels."""
    docs = table(spark, sf_dir, "documents")
    ratings = table(spark, sf_dir, "labels").select("doc_id", F.expr("case when quality = 0 then 0 when toxic = 1 then 1 when quality = 1 then 2 end").alias("grade"))
    return ordinal.graded(docs, ordinal.fit(docs, ratings, 3))


@query("op2_permutation_index")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


@query("op3_licence_rules", licenses.oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(table(spark, sf_dir, "documents"))


@query("op4_pii_boosting")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.fit(docs))


@query("op5_preferences", """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
n AS (SELECT conv_id, count(*) AS n, (conv_id - (conv_id % 2 + 2) % 2) // 2 AS pair, CASE WHEN conv_id % 2 = 0 THEN conv_id + 1 ELSE conv_id - 1 END AS other FROM t GROUP BY conv_id),
c AS (SELECT a.*, (pair % (a.n + 1) + a.n + 1) % (a.n + 1) AS m, b.conv_id AS rejected_id FROM n a LEFT JOIN (SELECT conv_id FROM n) b ON b.conv_id = a.other),
x AS (SELECT conv_id, i, role, text FROM o),
y AS (SELECT c.conv_id, i, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.i <= c.m UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN o ON o.conv_id = c.other AND o.i > c.m),
d AS (SELECT conv_id, min(i) AS first FROM x FULL JOIN y USING (conv_id, i) WHERE x.role IS DISTINCT FROM y.role OR x.text IS DISTINCT FROM y.text GROUP BY conv_id),
k AS (SELECT c.conv_id, rejected_id, coalesce(first - 1, n) AS n_common FROM c LEFT JOIN d ON d.conv_id = c.conv_id),
s AS (SELECT k.conv_id, 'chosen' AS side, i, i > n_common AS rest, role = 'assistant' AS learnt, length(text) + 8 AS size, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s FROM k JOIN x ON x.conv_id = k.conv_id
  UNION ALL SELECT k.conv_id, 'rejected', i, i > n_common, role = 'assistant', length(text) + 8, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) FROM k JOIN y ON y.conv_id = k.conv_id),
g AS (SELECT conv_id, string_agg(s, '' ORDER BY i) FILTER (NOT rest AND side = 'chosen') AS prompt, string_agg(s, '' ORDER BY i) FILTER (rest AND side = 'chosen') AS chosen, string_agg(s, '' ORDER BY i) FILTER (rest AND side = 'rejected') AS rejected,
  sum(size) FILTER (rest AND learnt AND side = 'chosen') AS chosen_learnt, sum(size) FILTER (rest AND learnt AND side = 'rejected') AS rejected_learnt FROM s GROUP BY conv_id)
SELECT k.conv_id AS pair_id, k.conv_id AS chosen_id, rejected_id, CAST(n_common AS BIGINT) AS n_common, sha256(coalesce(prompt, '')) AS prompt_sha256, sha256(coalesce(chosen, '')) AS chosen_sha256, sha256(coalesce(rejected, '')) AS rejected_sha256,
  CAST(coalesce(chosen_learnt, 0) AS BIGINT) AS chosen_learnt, CAST(coalesce(rejected_learnt, 0) AS BIGINT) AS rejected_learnt
FROM k LEFT JOIN g ON g.conv_id = k.conv_id""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation with all its turns beside one that branches off it."""
    rows = preferences.formatted(preferences.branched(table(spark, sf_dir, "conversations")))
    learnt = lambda c: F.expr(f"cast(aggregate({c}, 0, (a, x) -> a + x.e - x.s) as bigint)")
    digest = lambda c: F.sha2(c, 256)
    return rows.select("pair_id", "chosen_id", "rejected_id", "n_common", digest("prompt").alias("prompt_sha256"), digest("chosen_text").alias("chosen_sha256"), digest("rejected_text").alias("rejected_sha256"), learnt("chosen_mask").alias("chosen_learnt"), learnt("rejected_mask").alias("rejected_learnt"))


@query("op6_fm_index", """
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bench AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM bench WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM grams),
spots AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM words, sizes WHERE len(w) >= n),
found AS (SELECT doc_id, item_id, i, n FROM spots JOIN grams USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_factorization_machine")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op8_block_labeller")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_blocks.main_texts(pages, html_blocks.fit(pages))


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation as a long (null beyond 64 bits) and, beside it, as it is."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = whitening.whitened(vectors, whitening.fit(vectors)).withColumnRenamed("deviation", "deviation_exact")
    return rows.withColumn("deviation", F.col("deviation_exact").try_cast("bigint"))


@query("op12_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang),
used AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN kept ON kept.lang = t.lang AND kept.term = t.term GROUP BY ALL),
own AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM used GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(own.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN own ON own.lang = g.lang AND own.source = g.source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(used.n, 0) AS n, 1 + 1000000000 * (coalesce(used.n, 0) + 5) // (g.total + 5 * v) AS p, 1 + 1000000000 * (kept.n + 5) // (langs.total + 5 * v) AS q
  FROM groups g JOIN kept ON kept.lang = g.lang JOIN langs ON langs.lang = g.lang LEFT JOIN used ON used.lang = g.lang AND used.source = g.source AND used.term = kept.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_sentencepieces")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentencepieces.encoded(table(spark, sf_dir, "documents"), pieces())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
