"""One query for each numbered operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeloom.llm import fim, html_extract, lexical, line_dedup, near_dup, packing, pii, piece_codec, quality_gam, quality_rules, token_records, topk, url_filter
from spikeloom.llm.common import Shelf, bounded_batches, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, blocked_domains=url_filter.named_domains(pages))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_exact(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return piece_codec.encode_decode(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_dup.link(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=0, words=True)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"), measures=quality_rules.BASE)
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return token_records.output(table(spark, sf_dir, "documents"), Shelf(spark).place("records"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    turned = fim.transform(table(spark, sf_dir, "documents"), seed=7, rate=100, spm_rate=50)
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    restored = fim.restored(F.col("output"), F.col("form"))
    return turned.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


OP3_SQL = r"""
WITH p AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), j AS (
    SELECT *, starts_with(path, '/') AS root, starts_with(path, '/en/') AS en, starts_with(path, '/de/') AS de, starts_with(path, '/fr/') AS fr,
           '.' || host AS h FROM u
), r AS (
    SELECT page_id, host, path,
           CASE WHEN ends_with(h, '.example.net') AND en THEN 'example.net/en/' WHEN ends_with(h, '.example.com') AND de THEN 'example.com/de/'
                WHEN ends_with(h, '.org') AND fr THEN 'org/fr/' WHEN ends_with(h, '.net') AND root THEN 'net/' END AS rule FROM j
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') OR rule IS NULL AND EXISTS (
           SELECT 1 FROM (SELECT DISTINCT host AS domain FROM u WHERE regexp_matches(host, '(^|[.-])(WORDS)([.-]|$)')) l
           WHERE r.host = domain OR ends_with(r.host, '.' || domain)
       ) THEN 'block' ELSE 'allow' END AS verdict FROM r
""".replace("WORDS", "|".join(url_filter.BLOCKED_WORDS))

OP4_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP10_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), grams AS (
    SELECT r, p, list_slice(w, p, p + 4) AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS p FROM d WHERE len(w) > 5)
), twice AS (
    SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), covered AS (
    SELECT r, count(DISTINCT p + i) AS n FROM twice, (SELECT unnest(generate_series(0, 4)) AS i) GROUP BY r
), tops AS (
    SELECT r, max(n) AS n FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r, x) GROUP BY r
), lines AS (
    SELECT r, count(*) AS n, count(DISTINCT line) AS n_distinct, count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_open
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(lines.n, 0) AS n_lines, coalesce(lines.n - lines.n_distinct, 0) AS n_dup_lines,
           coalesce(covered.n, 0) AS n_repeat_words, coalesce(tops.n, 0) AS n_top_word, coalesce(lines.n_open, 0) AS n_open_lines,
           length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
           length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS n_small
    FROM d LEFT JOIN covered USING (r) LEFT JOIN lines USING (r) LEFT JOIN tops USING (r)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 8 * word_chars OR n_capitals > n_small
            OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR 100 * n_top_word > 30 * n_words OR 100 * n_open_lines > 30 * n_lines) AS kept
FROM b
"""


OP12_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id::VARCHAR) AS h,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
    FROM documents
), c AS (
    SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::UBIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::UBIGINT % (len(u) + 1) AS b,
           text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 100 AS plain,
           ('0x' || h[25:32])::UBIGINT % 100 < 50 AS spm
    FROM d
), p AS (
    SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
           array_to_string(u[greatest(a, b) + 1:], '') AS suffix
    FROM c
)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

OP13_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents WHERE text IS NOT NULL
), q AS (
    SELECT row_number() OVER () AS i, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL
), qs AS (SELECT i, item_id, term, count(*) AS times FROM q GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM s) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY term),
x AS (
    SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
    FROM p JOIN w USING (term) JOIN qs USING (term), s GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op4_topk": OP4_SQL, "op10_quality_rules": OP10_SQL, "op12_fill_in_middle": OP12_SQL, "op13_lexical_search": OP13_SQL}
