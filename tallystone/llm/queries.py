"""The registered queries of this subpackage: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .alignment import alignment
from .archives import archived_pages
from .common import crc_mod, read_table
from .decontaminate import report
from .infilling import infilling_report
from .line_dedup import remove_repeated_chunks
from .mixing import plan_mix
from .near_dedup import near_duplicates
from .quality_model import quality
from .quality_rules import BASE, V2, apply_policy, ledger, passes
from .secret_scan import secret_report
from .token_counts import token_counts
from .token_files import token_files
from .toxicity import toxicity


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) == 2, threshold=0.3)


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(read_table(spark, sf_dir, "pages"), least_bytes=0).drop("url")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_chunks(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed_lines", "n_removed_chunks")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) == 0, threshold=0.3)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), size=10)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(ledger(read_table(spark, sf_dir, "documents")), V2)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_triples", "n_double_marks", "fail_bits", (~passes(BASE)).alias("base_failed"), "kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), most_tokens=4096)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling_report(read_table(spark, sf_dir, "documents"), seed=42)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_arc_to_warc": op2_arc_to_warc,
        "op3_line_dedup": op3_line_dedup,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_token_files": op8_token_files,
        "op9_source_mix": op9_source_mix,
        "op10_token_counts": op10_token_counts,
        "op11_token_alignment": op11_token_alignment,
        "op12_secret_scan": op12_secret_scan,
        "op13_fill_in_middle": op13_fill_in_middle,
        "pipeline": corpus_pipeline.run,
    }


OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
win AS (SELECT rid, i, list_slice(words, i, i + 4) AS k FROM w, LATERAL (SELECT unnest(range(1, len(words) - 3)) AS i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least(5, i - coalesce(p, i - 5)))::BIGINT AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM rep) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
    len(regexp_extract_all(text, '[A-ZÀ-ÖØ-Þ]{3}'))::BIGINT AS n_capital_triples, len(regexp_extract_all(text, '!!'))::BIGINT AS n_double_marks
  FROM t JOIN w USING (rid) JOIN lines USING (rid) LEFT JOIN cov USING (rid)),
b AS (
  SELECT *, ((n_words < 10)::INT + (100 * n_repeat_words > 20 * n_words)::INT * 2 + (10 * n_symbols > 3 * n_words)::INT * 4 + (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::INT * 8
    + (word_chars < 2 * n_words)::INT * 16 + (word_chars > 15 * n_words)::INT * 32 + (300 * n_capital_triples > 20 * word_chars)::INT * 64 + (10 * n_double_marks > n_words)::INT * 128)::BIGINT AS fail_bits FROM m)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 2 AS stop, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
v AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM w),
r AS (SELECT *, stop::DOUBLE / weight AS ratio FROM v),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 150 / 100 - (sum(stop) OVER o - stop)::DOUBLE) / (sum(weight) OVER () - sum(weight) OVER o + weight)::DOUBLE AS level FROM r WINDOW o AS (ORDER BY ratio, place)),
f AS (SELECT arg_min(level, (ratio, place)) AS level FROM l WHERE stop::DOUBLE > weight * level),
t AS (SELECT source, source_size, least(stop::DOUBLE, coalesce(weight * (SELECT level FROM f), stop::DOUBLE)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, e.source_size, e.target, e.epochs, floor(e.target)::BIGINT - e.epochs * e.source_size AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
"""


OP2_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(8), lambda g: list_reduce(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * g + 1)::INT, 5))::BIGINT >> s) & 31) + 1)::INT, 1)), lambda a, b: a || b)), '') AS digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = rf"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS pos, w FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, pos, pos + k - 1), ' ') AS win FROM i),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT rid, k, w, unnest(range(1, greatest(1, len(w) - k + 2))) AS pos FROM d, (SELECT DISTINCT k FROM v)),
h AS (SELECT rid, pos, p.k, item FROM (SELECT rid, k, pos, array_to_string(list_slice(w, pos, pos + k - 1), ' ') AS win FROM p) p JOIN v ON p.k = v.k AND p.win = v.win),
n AS (SELECT rid, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(pos, pos + k)) AS q FROM h) GROUP BY 1),
m AS (SELECT rid, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""

OP6_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
c AS MATERIALIZED (SELECT md5(array_to_string(s, chr(10))) AS cls, min(doc_id) AS id, any_value(s) AS s, any_value(len(s)) AS n FROM s WHERE len(s) > 0 GROUP BY 1),
x AS (SELECT id, n, hash(unnest(s)) AS g FROM c),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.id, b.id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT id, id AS root FROM c UNION SELECT t.b, r.root FROM r JOIN t ON t.a = r.id),
k AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(k.root, s.doc_id) AS component_id, s.doc_id = coalesce(k.root, s.doc_id) AS kept FROM s LEFT JOIN c ON len(s.s) > 0 AND md5(array_to_string(s.s, chr(10))) = cls LEFT JOIN k USING (id)
"""


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM d),
v AS (SELECT *, len(w)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM v),
c AS (SELECT *, coalesce(array_to_string(list_slice(w, 1, a), ''), '') AS pre, coalesce(array_to_string(list_slice(w, a + 1, b), ''), '') AS mid, coalesce(array_to_string(list_slice(w, b + 1, n), ''), '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express."""
    return {"op2_arc_to_warc": OP2_SQL, "op5_benchmark_decontamination": OP5_SQL, "op6_minhash_near_dedup": OP6_SQL, "op7_quality_rules": OP7_SQL, "op9_source_mix": OP9_SQL, "op13_fill_in_middle": OP13_SQL}
