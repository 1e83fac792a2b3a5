"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.best_fit import best_fit
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.fim import fill_in_middle, restored
from tidemark.llm.html_text import extract_text
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.lm_score import lm_scores
from tidemark.llm.nbsvm import quality_scores
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.resampling import resample
from tidemark.llm.shared import table
from tidemark.llm.simhash_dedup import hex_digits, near_duplicates
from tidemark.llm.token_counts import token_counts
from tidemark.llm.url_filter import farm_hosts, judge_urls

#: The rules that the query's contract fixes.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES, farm_hosts(pages))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected", "host_strict")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"), seed=42, rate=50, spm_share=80)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored("output", "form")).alias("restored_sha256"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), max_n=1, buckets=10_000, seed=2024, percent=10, min_words=20)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_url_filter, op2_quality_rules, op3_quality_classifier, op4_lm_score, op5_simhash_dedup, op6_html_text, op7_decontaminate, op8_packing, op9_line_dedup, op10_token_counts, op11_fill_in_middle, op12_best_fit, op13_resampling]
    return {f.__name__: f for f in [*ops, pipeline]}


OP1_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), rules(action, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), counts AS (SELECT host, count(*) AS n FROM parts WHERE host <> '' GROUP BY host
), farms AS (SELECT host FROM counts WHERE n >= 1.5 * (SELECT sum(n)::DOUBLE / count(*) FROM counts)
), fitting AS (
  SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM (SELECT DISTINCT page_id, host, path FROM parts) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
)
SELECT parts.page_id, parts.host, parts.path, rule,
       coalesce(action, CASE WHEN parts.host IN (SELECT host FROM farms) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fitting ON parts.page_id IS NOT DISTINCT FROM fitting.page_id AND parts.host = fitting.host AND parts.path = fitting.path
"""

OP2_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)
), triples AS (
  SELECT r, i, w, lead(w) OVER d AS w2, lead(w, 2) OVER d AS w3 FROM words WINDOW d AS (PARTITION BY r ORDER BY i)
), twice AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM triples WHERE w3 IS NOT NULL
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r
), sums AS (
  SELECT r, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM words GROUP BY r
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), measured AS (
  SELECT docs.r, doc_id, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs LEFT JOIN sums USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
), ruled AS (
  SELECT *, n_symbols * 100 > word_chars * 10 AS symbols_failed, base_failed OR n_symbols * 100 > word_chars * 10 OR n_dup_lines * 100 > n_lines * 30 AS rule_failed FROM based
), hosts AS (
  SELECT source, count(*) AS n, sum(rule_failed::INT) AS failed FROM ruled GROUP BY source
), prior AS (
  SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS k
  FROM (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM hosts)
), verdicts AS (
  SELECT source, (failed + m * k) / (n + k) > 0.6 AS host_rejected, (failed + m * k) / (n + k) > m + 0.5 * sqrt(m * (1 - m) / (k + 1)) AS host_strict FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AND NOT (host_strict AND symbols_failed) AS kept, host_rejected, host_strict
FROM ruled JOIN verdicts ON ruled.source IS NOT DISTINCT FROM verdicts.source
"""

OP4_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
pairs AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS p FROM words),
uni AS (SELECT w, count(*) AS c FROM words GROUP BY w), uni_d AS (SELECT r, w, count(*) AS c FROM words GROUP BY r, w),
bi AS (SELECT p, w, count(*) AS c FROM pairs WHERE p IS NOT NULL GROUP BY p, w), bi_d AS (SELECT r, p, w, count(*) AS c FROM pairs WHERE p IS NOT NULL GROUP BY r, p, w),
total AS (SELECT count(*) AS n FROM words),
scored AS (
  SELECT x.r, CASE WHEN bi.c - bi_d.c > 0 THEN ln((bi.c - bi_d.c) / (u2.c - d2.c))
              ELSE ln((u1.c - d1.c + 1) / (n - len(ws) + 1)) + CASE WHEN x.p IS NULL THEN 0 ELSE ln(0.4) END END AS s
  FROM pairs x JOIN docs ON docs.r = x.r CROSS JOIN total
  JOIN uni u1 ON u1.w = x.w JOIN uni_d d1 ON d1.r = x.r AND d1.w = x.w
  LEFT JOIN uni u2 ON u2.w = x.p LEFT JOIN uni_d d2 ON d2.r = x.r AND d2.w = x.p
  LEFT JOIN bi ON bi.p = x.p AND bi.w = x.w LEFT JOIN bi_d ON bi_d.r = x.r AND bi_d.p = x.p AND bi_d.w = x.w
)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(m, 0), 6) AS log_score
FROM docs LEFT JOIN (SELECT r, avg(s) AS m FROM scored GROUP BY r) USING (r)
"""

OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
ds AS (SELECT r, doc_id, len(w) - 4 AS n, unnest(range(len(w) - 4)) AS pos, w FROM d WHERE len(w) >= 5),
dsh AS (SELECT r, doc_id, n, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS h FROM ds),
bs AS (SELECT item_id, len(w) AS len, unnest(range(len(w) - 4)) AS q, w FROM b WHERE len(w) >= 5),
bsh AS (SELECT item_id, len, q, array_to_string(w[q + 1:q + 5], ' ') AS h FROM bs),
hits AS (SELECT r, doc_id, n, pos, item_id, len, q FROM dsh JOIN bsh USING (h)),
enough AS (SELECT doc_id, item_id, len FROM hits GROUP BY ALL HAVING count(DISTINCT q) >= 0.8 * (len - 4)),
laid AS (SELECT DISTINCT doc_id, len, pos - q AS start FROM hits JOIN enough USING (doc_id, item_id, len)),
win AS (SELECT dsh.r, doc_id, start, len, h, count(*) AS c FROM laid JOIN dsh USING (doc_id) WHERE pos >= start AND pos < start + len - 4 GROUP BY ALL),
size AS (SELECT r, doc_id, start, len, sum(c) AS m FROM win GROUP BY ALL),
item AS (SELECT item_id, len, h, count(*) AS c FROM bsh GROUP BY ALL),
shared AS (SELECT r, doc_id, start, win.len, item_id, sum(least(win.c, item.c)) AS s FROM win JOIN item ON win.h = item.h AND win.len = item.len GROUP BY ALL),
sim AS (SELECT doc_id, item_id, greatest(start, 0) AS start, s / (m + len - 4 - s) AS sim FROM shared JOIN size USING (r, doc_id, start, len)),
best AS (SELECT doc_id, item_id, max(sim) AS sim FROM sim WHERE sim >= 0.8 GROUP BY ALL)
SELECT doc_id, item_id, min(start)::BIGINT AS position, round(sim, 6) AS similarity FROM best JOIN sim USING (doc_id, item_id, sim) GROUP BY doc_id, item_id, sim
"""

#: All pairs of positions of equal lines; a run is a maximal stretch along one shift.
OP9_SQL = r"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, text FROM documents),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs WHERE text IS NOT NULL),
counted AS (SELECT r, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM raw),
lines AS (SELECT r, pos, line, nw, row_number() OVER (PARTITION BY r ORDER BY pos) AS idx FROM counted WHERE nw > 0),
pairs AS (SELECT p.r, a.r AS ar, p.idx - a.idx AS shift, p.pos, p.idx, p.nw FROM lines p JOIN lines a ON p.line = a.line AND (a.r < p.r OR a.r = p.r AND a.idx < p.idx)),
runs AS (SELECT *, idx - row_number() OVER (PARTITION BY r, ar, shift ORDER BY idx) AS run FROM pairs),
gone AS (SELECT DISTINCT r, pos FROM (SELECT *, sum(nw) OVER (PARTITION BY r, ar, shift, run) AS words FROM runs) WHERE words >= 50),
kept AS (SELECT r, count(*) AS n_lines, count(gone.pos) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (gone.pos IS NULL) AS text FROM raw LEFT JOIN gone USING (r, pos) GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_removed, 0)::INT AS n_removed, CASE WHEN docs.text IS NOT NULL THEN coalesce(kept.text, '') END AS text FROM docs LEFT JOIN kept USING (r)
"""

OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS k1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS k2,
         ('0x' || h[17:24])::BIGINT % 100 AS d3, ('0x' || h[25:32])::BIGINT % 100 AS d4 FROM docs
), parts AS (
  SELECT doc_id, text, n, array_to_string(units[1:least(k1, k2)], '') AS prefix, array_to_string(units[least(k1, k2) + 1:greatest(k1, k2)], '') AS middle,
         array_to_string(units[greatest(k1, k2) + 1:n], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d3 >= 50 THEN 'plain' WHEN d4 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256 FROM parts
"""

#: CRC-32 by bytes, its table from the polynomial.
OP13_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(range(8)::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS t FROM range(256) AS r(i)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), tokens AS (SELECT r, w, count(*) AS c FROM (SELECT r, unnest(ws) AS w FROM docs) GROUP BY r, w
), target AS (
  SELECT w, count(*) AS c FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w
), vocabulary AS (
  SELECT w, [('0x' || hex(w)[2 * k - 1:2 * k])::BIGINT for k in range(1, strlen(w) + 1)] AS bytes FROM (SELECT w FROM tokens UNION SELECT w FROM target)
), bucketed AS (
  SELECT w, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM vocabulary, crc
), s AS (SELECT bucket, sum(c)::BIGINT AS n FROM tokens JOIN bucketed USING (w) GROUP BY bucket
), t AS (SELECT bucket, sum(c)::BIGINT AS n FROM target JOIN bucketed USING (w) GROUP BY bucket
), totals AS (SELECT (SELECT coalesce(sum(n), 0)::DOUBLE FROM s) AS s_all, (SELECT coalesce(sum(n), 0)::DOUBLE FROM t) AS t_all
), gains AS (
  SELECT w, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s.n, 0)::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM bucketed LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals
), weighed AS (
  SELECT docs.r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN (SELECT r, sum(gain * c)::BIGINT AS weight FROM tokens JOIN gains USING (w) GROUP BY r) AS x ON docs.r = x.r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM weighed
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM weighed WHERE n_features >= 20) // 100 THEN place END AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op2_quality_rules": OP2_SQL, "op4_lm_score": OP4_SQL, "op7_decontaminate": OP7_SQL, "op9_line_dedup": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op13_resampling": OP13_SQL}
