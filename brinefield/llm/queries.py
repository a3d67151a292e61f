"""The registered queries of this package and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brinefield.llm import byte_bpe, exact_dedup, jaccard_join, language_id, license_scan, line_dedup, line_quality, mixing, ranked_search, rans, substring_dedup, toxicity, whitening
from brinefield.llm.common import benchmark, documents, embeddings, labels, vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


@query("op4_cuckoo_dedup", sql="""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


@query("op8_source_mixing", sql="""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(cap) OVER b, 0) AS used,
             sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS rest, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS pos
      FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - used) / rest, pos) AS level FROM o WHERE (total - used) / rest * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM o CROSS JOIN l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM t),
u AS (SELECT d.*, r.source_size, r.target, r.rate,
             ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '-') || '|' || h), 1, 8))::BIGINT / 4294967296.0 AS u
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, size, source_size, round(target, 6) AS target, round(rate, 9) AS rate,
       (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.withColumn("target", F.round("target", 6)).withColumn("rate", F.round("rate", 9))


@query("op7_line_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(documents(spark, sf_dir))


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"))


@query("op1_rans_tokens")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = rans.write(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return rans.checksums(rans.read(spark, store))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.verdicts(documents(spark, sf_dir), labels(spark, sf_dir))


@query("op3_line_dedup", sql=r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
t AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM t WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT t.*, r.key IS NOT NULL AND t.doc_id <> r.keeper AS gone FROM t LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(documents(spark, sf_dir))


@query("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copies(documents(spark, sf_dir))


@query("op11_substring_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    return substring_dedup.drop_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_ranked_search", sql=r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM d CROSS JOIN c),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f CROSS JOIN c GROUP BY term),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS part FROM f JOIN m USING (doc_id) JOIN w USING (term)),
s AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.best_documents(benchmark(spark, sf_dir), documents(spark, sf_dir)).select("item_id", "rank", "doc_id", "score")


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir))
