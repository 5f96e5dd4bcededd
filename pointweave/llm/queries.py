"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointweave.llm.collocations import collocations
from pointweave.llm.embeddings import similar_vectors
from pointweave.llm.fingerprints import edit_report
from pointweave.llm.licenses import license_report
from pointweave.llm.minhash import near_duplicates
from pointweave.llm.mixing import hash_threshold_mix
from pointweave.llm.pieces import encode_texts
from pointweave.llm.quality_model import classify
from pointweave.llm.quality_rules import quality_rules
from pointweave.llm.repeats import repeat_report
from pointweave.llm.search import ranked_search
from pointweave.llm.secrets import secret_report
from pointweave.llm.sharding import TABLE_SIZE, assign_shards, lookup_table
from pointweave.llm.shared import read


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return hash_threshold_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def public_tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies; every node has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(read(spark, sf_dir, "documents"))


SHARDS = [f"shard-{k:03d}" for k in range(256)]


def op7_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return assign_shards(docs, "doc_id", SHARDS)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, read(spark, sf_dir, "labels")).drop("text")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("lang", "text"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1] AS weight FROM s),
b AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0) AS left_words,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight
  FROM w WINDOW o AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size * left_weight < left_words * weight AS capped FROM b),
l AS (SELECT arg_max(left_words, left_weight) AS words, max(left_weight) AS weight FROM c WHERE NOT capped),
t AS (
  SELECT source, source_size, CAST(CASE WHEN capped THEN 3 * source_size ELSE c.weight * l.words END AS BIGINT) AS numer,
         CAST(CASE WHEN capped THEN 1 ELSE l.weight END AS BIGINT) AS denom FROM c, l),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN numer // (denom * source_size) ELSE 0 END AS base FROM t),
q AS (SELECT *, CAST(numer - base * denom * source_size AS DOUBLE) / denom AS budget FROM r),
x AS (
  SELECT d.*, q.source_size, CAST(numer AS DOUBLE) / denom AS target, base, budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (base + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""

#: The filled table is a constant of the statement; a test compares its filling with a plain one.
OP7_SQL = f"""
WITH t AS (SELECT string_split('{",".join(SHARDS[k] for k in lookup_table(SHARDS))}', ',') AS shards),
d AS (SELECT doc_id, source, n_chars, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) % {TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, source, n_chars, slot, shards[slot + 1] AS shard FROM d, t
"""

OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
t AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, unnest(range(1, len(w) + 1)) AS i, w FROM p),
o AS (SELECT lang, unnest(range(1, 6)) AS size, i, w FROM g),
f AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f FROM o WHERE i + size - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, t.n, (1000 * k.a * t.n) // (l.f * r.f) AS score
  FROM k JOIN t ON t.lang = k.lang JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1 : k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.size > len(string_split(b.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 100 * b.a)),
y AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM x)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM y WHERE rank <= 2000
"""

_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP13_SQL = f"""
WITH q AS (SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark),
w AS (SELECT doc_id, {_TERMS} AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
f AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY ALL),
e AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM f GROUP BY term), c),
m AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // words AS m FROM d, c),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN e USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_embeddings": op2_embeddings,
    "op3_quality_rules": op3_quality_rules,
    "op4_mix_sources": op4_mix_sources,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_shard_documents": op7_shard_documents,
    "op8_secrets": op8_secrets,
    "op9_licenses": op9_licenses,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_collocations": op11_collocations,
    "op12_fingerprints": op12_fingerprints,
    "op13_search": op13_search,
}
ORACLE_SQL = {"op4_mix_sources": OP4_SQL, "op7_shard_documents": OP7_SQL, "op11_collocations": OP11_SQL, "op13_search": OP13_SQL}
