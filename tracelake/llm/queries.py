"""The catalogue of this subpackage: queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontaminate, lexical_search, lm_scoring, near_dedup, piece_bpe, prefix_trie, quality_rules, rule_classifier, substring_dedup, token_counts, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_matches(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_classifier.learn(docs, _table(spark, sf_dir, "labels"))
    return rule_classifier.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, _vocabulary("byte_bpe_50k.tiktoken"), ("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, _vocabulary("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).drop("text")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.encode(docs, _vocabulary("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered(_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.grafted(turns))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_decontaminate, op3_warc_index, op4_lm_scoring, op5_quality_classifier,
        op6_bpe, op7_minhash_dedup, op8_token_counts, op9_quality_rules, op10_url_filter,
        op11_sentencepiece, op12_lexical_search, op13_prefix_trie,
    )
}

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_SPACE_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+49], ' ')) AS k FROM d, unnest(range(1, len(w) - 48)) AS u(i) WHERE len(w) >= 50),
least AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (SELECT DISTINCT win.doc_id, win.i + o AS i FROM win JOIN least USING (k), unnest(range(0, 50)) AS u(o) WHERE first < win.doc_id),
gone_l AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, w, list_filter(range(1, len(w) + 1), lambda i: g IS NULL OR NOT list_contains(g, i)) AS ks FROM d LEFT JOIN gone_l USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(ks))::BIGINT AS n_removed,
       sha256(array_to_string(list_transform(ks, lambda i: w[i]), ' ')) AS kept_sha256 FROM kept""",
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_ITEM_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i+9], ' ') AS k FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM p),
win AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS k FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, win.n, item_id FROM win JOIN p ON p.k = win.k AND p.n = win.n),
words AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM hits, unnest(range(0, n)) AS u(o) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_warc_index": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND payload_bytes >= 100""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_SPACE_WORDS} AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS k FROM d, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM win JOIN twice USING (doc_id, k), unnest(range(0, 3)) AS u(o) GROUP BY doc_id),
s AS (SELECT d.doc_id, t, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * word_chars < 5 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > 4 * len(l)
            OR 3 * length(regexp_replace(t, '[^0-9]', '', 'g')) > length(t)
            OR 10 * len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) > 9 * len(l)) AS kept
FROM v""",
    "op4_lm_scoring": f"""
WITH d AS (SELECT doc_id, {_SPACE_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
total AS (SELECT count(*) AS n FROM p),
n1 AS (SELECT c, count(*) AS k FROM p GROUP BY c),
n2 AS (SELECT b, c, count(*) AS k FROM p WHERE b IS NOT NULL GROUP BY b, c),
n3 AS (SELECT a, b, c, count(*) AS k FROM p WHERE a IS NOT NULL GROUP BY a, b, c),
s2 AS (SELECT n2.b, n2.c, n2.k, CASE WHEN n2.k >= 2 THEN ln(n2.k / h.k) ELSE ln(0.4) + ln(o.k / n) END AS score
       FROM n2 JOIN n1 AS h ON h.c = n2.b JOIN n1 AS o ON o.c = n2.c, total),
s3 AS (SELECT n3.a, n3.b, n3.c, CASE WHEN n3.k >= 2 THEN ln(n3.k / h.k) ELSE ln(0.4) + o.score END AS score
       FROM n3 JOIN s2 AS h ON h.b = n3.a AND h.c = n3.b JOIN s2 AS o ON o.b = n3.b AND o.c = n3.c),
x AS (SELECT p.doc_id, coalesce(s3.score, s2.score, ln(n1.k / n)) AS score FROM p LEFT JOIN s3 ON s3.a = p.a AND s3.b = p.b AND s3.c = p.c
      LEFT JOIN s2 ON s2.b = p.b AND s2.c = p.c JOIN n1 ON n1.c = p.c, total),
g AS (SELECT doc_id, count(*) AS n_words, sum(score) AS log_score FROM x GROUP BY doc_id)
SELECT DISTINCT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(log_score, 0.0), 4) AS log_score, round(log_score / n_words, 6) AS mean_log_score
FROM d LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM d.doc_id""",
    "op7_minhash_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+1], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s AS x JOIN s AS y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op12_lexical_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark),
g AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
q AS (SELECT i, t, count(*) AS times FROM (SELECT i, unnest(w) AS t FROM b) GROUP BY i, t),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
f AS (SELECT t, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, g GROUP BY t),
m AS (SELECT r, doc_id, 100 - 75 + (75 * len(w) * n) // l AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT i, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN p USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY i, r),
k AS (SELECT i, r, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k JOIN b USING (i) WHERE rank <= 10""",
    "op13_prefix_trie": """
WITH t AS (SELECT conv_id, turn, octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(x)) AS place, sha256(x) AS x, size FROM t),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base FROM o),
tab AS (SELECT list_transform(range(0, 256), lambda n: list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS k),
h AS (SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
      lambda a, z: xor(a >> 8, k[(xor(a, z) & 255) + 1])), 4294967295::BIGINT) % 9 AS h FROM c, tab),
g AS (SELECT conv_id, base, h, least(h, (SELECT count(*) FROM o WHERE o.conv_id = base)) AS graft FROM h),
r AS (SELECT g.conv_id, o.place, x, size FROM g JOIN o ON o.conv_id = base AND o.place <= h
      UNION ALL SELECT g.conv_id, o.place - h + graft, x, size FROM g JOIN o ON o.conv_id = g.conv_id AND o.place > h
      UNION ALL SELECT conv_id, 0, '', 0 FROM g),
p AS (SELECT conv_id, place::BIGINT AS depth, size, max(place) OVER (PARTITION BY conv_id) = place AS ends, sha256(string_agg(x, ',') OVER (PARTITION BY conv_id ORDER BY place)) AS key FROM r),
n AS (SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(size) AS size, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY key),
up AS (SELECT DISTINCT d.key, a.key AS above FROM p AS d JOIN p AS a ON a.conv_id = d.conv_id AND a.depth = d.depth - 1),
kids AS (SELECT above AS key, count(*) AS n FROM up GROUP BY above),
pairs AS (SELECT DISTINCT a.key, d.key AS below FROM p AS a JOIN p AS d ON d.conv_id = a.conv_id AND d.depth >= a.depth),
sub AS (SELECT pairs.key, count(*) FILTER (kids.key IS NULL) AS leaves, sum((n.n - 1) * n.size)::BIGINT AS saved FROM pairs JOIN n ON n.key = below LEFT JOIN kids ON kids.key = below GROUP BY pairs.key)
SELECT n.conv_id, n.depth, above.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, sub.leaves AS n_leaves, sub.saved AS saved_tokens, n.ends_sha256
FROM n JOIN sub ON sub.key = n.key LEFT JOIN kids ON kids.key = n.key LEFT JOIN up ON up.key = n.key LEFT JOIN n AS above ON above.key = up.above""",
}
