"""The operators over their whole tables, and their equivalents in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graysift.llm import quality
from graysift.llm.byte_bpe import decode_documents, encode_documents
from graysift.llm.conversations import damaged, repair_conversations
from graysift.llm.embedding_dedup import embedding_dedup
from graysift.llm.exact_dedup import exact_dedup
from graysift.llm.mixing import mix
from graysift.llm.ngram_join import near_duplicates
from graysift.llm.packing import pack_documents
from graysift.llm.repeats import repeated_passages
from graysift.llm.resampling import resample
from graysift.llm.token_counts import token_counts
from graysift.llm.token_files import token_file_index
from graysift.llm.url_filter import url_rules as rules_of_urls, url_verdicts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), memory=1_000_000)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_index(table(spark, sf_dir, "documents"), memory=1_000_000)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"), threshold=0.9)


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x),
m AS (SELECT x, min(y) AS component_id FROM c GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON vec_id = m.x LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON vec_id = k.x
"""
WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 2) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM w),
s AS (SELECT doc_id, unnest(g) AS g FROM d),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN d x ON x.doc_id = a JOIN d y ON y.doc_id = b WHERE 100 * n >= 90 * (len(x.g) + len(y.g) - n)),
l AS (SELECT a AS x, b AS y FROM k UNION ALL SELECT b, a FROM k),
c AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x),
m AS (SELECT x, min(y) AS component_id FROM c GROUP BY x)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, coalesce(n, 0)::BIGINT AS n_links
FROM d JOIN m ON doc_id = m.x LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) q ON doc_id = q.x
"""


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), min_words=50)


OP6_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
r AS (SELECT doc_id, i FROM v WHERE h IN (SELECT h FROM v GROUP BY h HAVING count(DISTINCT doc_id) > 1)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM r))
SELECT doc_id, (min(i) - 1)::BIGINT AS start_word, (max(i) - min(i) + 50)::BIGINT AS n_words FROM n GROUP BY doc_id, part
"""


def op7_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.ratings_from_labels(table(spark, sf_dir, "labels")), grades=3)
    return quality.grade(docs, model).drop("text")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict", "block_score", "verdict_by")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8's rules alone say of each url."""
    return rules_of_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


URL_RULES_SQL = """
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, url, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), '') AS path FROM u),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/', 'org/'), ('block', 'example.org', '/es/', 'example.org/es/'), ('block', 'example.org', '/en/1', 'example.org/en/1'),
                            ('allow', 'com', '/fr/', 'com/fr/'), ('block', 'com', '/de/', 'com/de/')) v(verdict, domain, start, rule)),
f AS (SELECT page_id, rule, verdict FROM h JOIN r ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT page_id, url, host, path, rule, verdict AS rule_verdict FROM h LEFT JOIN f USING (page_id)
"""


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS mark
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    (sum(source_size::DOUBLE) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER o, 0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0::DOUBLE)) AS level
  FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, coalesce(
    arg_min(CASE WHEN level <= cap / w THEN level END, CASE WHEN level <= cap / w THEN cap / w END) OVER () * w, cap)) AS target
  FROM l),
c AS (
  SELECT doc_id, size, source_size, target, mark,
         sum(size) OVER (PARTITION BY d.source ORDER BY mark, doc_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY (pass::DOUBLE * source_size + place) / target, mark, doc_id, pass ROWS UNBOUNDED PRECEDING) AS upto
  FROM c, (VALUES (0), (1), (2)) v(pass) WHERE size > 0),
k AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM p WHERE upto <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(k.taken, 0)::BIGINT AS taken FROM c LEFT JOIN k USING (doc_id)
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode_documents(encode_documents(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_files": op3_token_files,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_quality_grades": op7_quality_grades,
    "op8_url_filter": op8_url_filter,
    "url_rules": url_rules,
    "op9_mix_sources": op9_mix_sources,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_byte_bpe": op13_byte_bpe,
}
SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op4_embedding_dedup": OP4_SQL,
    "op5_ngram_join": OP5_SQL,
    "op6_repeated_passages": OP6_SQL,
    "url_rules": URL_RULES_SQL,
    "op9_mix_sources": OP9_SQL,
}
