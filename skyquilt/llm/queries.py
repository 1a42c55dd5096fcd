"""The queries of the training-data operators, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.ship import ship

from . import divergence, fingerprint, html, linededup, mixing, neardup, packing, quality, quotes, sharding, substring, urlfilter, vectorcodes

#: Shards of the sharding query.
SHARDS = 24


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "removed_words", "text")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.by_position(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"), cleaned=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), sharding.uniform_tree(SHARDS), sharding.uniform_tree(SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no block list, so a list by rule stands in: the keys whose MD5 begins with 0, about one in 16."""
    pages = table(spark, sf_dir, "pages")
    listed = urlfilter.keys_of(pages).where(F.md5("key").startswith("0"))
    return urlfilter.judge(pages, listed)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return cleaned.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quotes": op1_quotes,
    "op2_neardup": op2_neardup,
    "op3_html": op3_html,
    "op4_linededup": op4_linededup,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_fingerprint": op7_fingerprint,
    "op8_sharding": op8_sharding,
    "op9_packing": op9_packing,
    "op10_urlfilter": op10_urlfilter,
    "op11_divergence": op11_divergence,
    "op12_substrings": op12_substrings,
    "op13_vectorcodes": op13_vectorcodes,
}



def vectorcodes_sql() -> str:
    """Rounds of assigning and averaging over the parts' components, one row each."""
    near = """n{r} AS MATERIALIZED (
  SELECT vec_id, p, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d FROM (
    SELECT vec_id, x.p, e, CAST(sum((x.v - y.v) * (x.v - y.v)) AS BIGINT) AS d FROM parts x JOIN b{r} y ON x.p = y.p AND x.i = y.i GROUP BY vec_id, x.p, e) GROUP BY vec_id, p
)"""
    mean = """m{s} AS (
  SELECT p, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS c FROM n{r} JOIN parts USING (vec_id, p) GROUP BY p, e, i
), b{s} AS MATERIALIZED (
  SELECT p, e, i, coalesce((s - ((s % c) + c) % c) // c, b.v) AS v FROM b{r} b LEFT JOIN m{s} USING (p, e, i)
)"""
    rounds = ", ".join(near.format(r=r) + (", " + mean.format(r=r, s=r + 1) if r < vectorcodes.ROUNDS else "") for r in range(vectorcodes.ROUNDS + 1))
    last = vectorcodes.ROUNDS
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding AS x, len(embedding) // 4 AS d FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, (i - 1) // d AS p, (i - 1) % d AS i, CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM (SELECT vec_id, d, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM kept)
), b0 AS MATERIALIZED (
  SELECT p, CAST(n AS BIGINT) AS e, i, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM kept) USING (vec_id) WHERE n < 256
), {rounds}, coded AS (
  SELECT vec_id, string_agg(lower(right('0' || hex(e), 2)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{last} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM b{last}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), books
"""


#: In SQL: what the line rules of the quality operator look for.
_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in quality.PHRASES)
_BARS = ", ".join(f"'{c}'" for c in quality.SEPARATORS)
_CLOSERS = quality.CLOSERS.replace("'", "''")

ORACLES: dict[str, str] = {
    "op2_neardup": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] || chr(32) || w[i + 3])) AS s FROM worded WHERE len(w) >= 4
    UNION ALL SELECT doc_id, array_to_string(w, chr(32)) FROM worded WHERE len(w) BETWEEN 1 AND 3)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), linked AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, linked.b FROM reach JOIN linked ON linked.a = reach.r
), lowest AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN lowest USING (doc_id) LEFT JOIN sizes USING (doc_id)
""",
    "op6_quality": rf"""
WITH worded AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), each AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM worded
), windows AS (
  SELECT *, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), counted AS (
  SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS again FROM windows
), covered AS (
  SELECT doc_id, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside FROM counted
), repeats AS (
  SELECT doc_id, CAST(sum(inside) AS BIGINT) AS n_repeat_words FROM covered GROUP BY 1
), lines AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM worded)
), facts AS (
  SELECT doc_id, line, len(w) AS n, len(list_filter(w, lambda x: x IN ({_BARS}))) AS bars, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
    length(line) - length(replace(line, '!', '')) AS shouts, right(rtrim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '{_CLOSERS}'), 1) AS last FROM lines WHERE len(w) > 0
), failing AS (
  SELECT *, (bars >= 3 AND 5 * bars >= n) OR (n <= 40 AND ({_PHRASES})) OR 2 * symbols > n OR (shouts > 2 AND 2 * shouts > n) OR last = '' OR NOT contains('{quality.ENDS}', last) AS fails FROM facts
), by_line AS (
  SELECT doc_id, CAST(coalesce(sum(CASE WHEN fails THEN n END), 0) AS BIGINT) AS lost_words, count(*) - count(DISTINCT line) AS n_dup_lines FROM failing GROUP BY 1
), base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_words, 0) AS lost_words
  FROM worded d LEFT JOIN repeats USING (doc_id) LEFT JOIN by_line USING (doc_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT *, NOT base_failed AND 2 * lost_words <= n_words AS kept FROM failed
""",
    "op5_mixing": r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source
), turned AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM per
), weighed AS (
  SELECT *, CAST(CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS w, 3 * source_size AS cap FROM turned
), rated AS (
  SELECT *, CAST(cap AS DOUBLE) / CAST(w AS DOUBLE) AS ratio FROM weighed
), summed AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS cap_before, coalesce(sum(w) OVER before, 0) AS w_before, sum(source_size) OVER () AS everything, sum(w) OVER () AS weights
  FROM rated WINDOW before AS (ORDER BY ratio, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, CAST(everything - cap_before AS DOUBLE) / CAST(weights - w_before AS DOUBLE) AS lvl FROM summed
), final AS (
  SELECT *, max(CASE WHEN ratio > lvl THEN lvl END) OVER () AS final_lvl FROM leveled
), goal AS (
  SELECT source, source_size, CASE WHEN ratio <= lvl THEN CAST(cap AS DOUBLE) ELSE w * final_lvl END AS target,
    CAST(CASE turn % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS a, CAST(CASE turn % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 1.5 END AS DOUBLE) AS b
  FROM final
), placed AS (
  SELECT doc_id, size, source_size, target, a, b, CAST(round(target) AS BIGINT) AS words,
    CAST(sum(size) OVER (PARTITION BY base.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS first_at
  FROM base JOIN goal ON base.source IS NOT DISTINCT FROM goal.source
), counted AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS passes FROM placed
), mixed AS (
  SELECT *, CAST(passes * size + greatest(0, least(size, words - passes * source_size - first_at)) AS BIGINT) AS taken FROM counted
)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE WHEN b - a = 0 THEN CAST(first_at AS DOUBLE) / CAST(words AS DOUBLE)
    ELSE (sqrt(a * a + 2 * (b - a) * (CAST(first_at AS DOUBLE) / CAST(words AS DOUBLE))) - a) / (b - a) END END AS position
FROM mixed
""",
    # CRC-32 from its rule, then the draws of each level of the tree
    "op8_sharding": r"""
WITH RECURSIVE step AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM step WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS by_byte FROM step WHERE k = 8
), base AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, octet_length(encode(coalesce(text, ''))) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), summed AS (
  SELECT doc_id, k, CAST(size AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: CAST(('0x' || h[i:i + 1]) AS BIGINT))), lambda c, b: xor(c >> 8, by_byte[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM base, crc
), leaves AS (
  SELECT CAST(s AS INTEGER) AS shard, s // 8 AS r, s // 4 AS q FROM range(25) t(s)
), drawn AS (
  SELECT k, n, node, p, -ln((CAST(('0x' || md5(k || '|' || path)[1:13]) AS BIGINT) + 5e-1) / 4503599627370496e0) / w AS d FROM (SELECT DISTINCT k FROM base), (
    SELECT n, '/r' || CAST(r AS VARCHAR) AS path, CAST(count(*) AS DOUBLE) AS w, 'r' || CAST(r AS VARCHAR) AS node, '' AS p FROM leaves, (VALUES (24), (25)) v(n) WHERE shard < n GROUP BY n, r
    UNION ALL SELECT n, '/r' || CAST(r AS VARCHAR) || '/k' || CAST(q AS VARCHAR), CAST(count(*) AS DOUBLE), 'k' || CAST(q AS VARCHAR), 'r' || CAST(r AS VARCHAR) FROM leaves, (VALUES (24), (25)) v(n) WHERE shard < n GROUP BY n, r, q
    UNION ALL SELECT n, '/r' || CAST(r AS VARCHAR) || '/k' || CAST(q AS VARCHAR) || '/s' || CAST(shard AS VARCHAR), 1e0, CAST(shard AS VARCHAR), 'k' || CAST(q AS VARCHAR) FROM leaves, (VALUES (24), (25)) v(n) WHERE shard < n)
), won AS (
  SELECT k, n, p, arg_min(node, d) AS node FROM drawn GROUP BY k, n, p
), placed AS (
  SELECT a.k, a.n, CAST(c.node AS INTEGER) AS shard FROM won a JOIN won b ON b.k = a.k AND b.n = a.n AND b.p = a.node JOIN won c ON c.k = a.k AND c.n = a.n AND c.p = b.node WHERE a.p = ''
)
SELECT doc_id, size, text_crc32, 'key' AS law, x.shard, row_number() OVER (PARTITION BY x.shard ORDER BY md5(k), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, y.shard AS grown_shard
FROM summed JOIN placed x USING (k) JOIN placed y USING (k) WHERE x.n = 24 AND y.n = 25
""",
    "op10_urlfilter": r"""
WITH parted AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), judged AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parted
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM judged
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN starts_with(md5(host || path), '0') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
""",
    "op11_divergence": r"""
WITH base AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), groups AS MATERIALIZED (
  SELECT DISTINCT lang, source FROM base
), each AS (
  SELECT d, lang, source, unnest(w) AS term FROM base
), counted AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs FROM each GROUP BY 1, 2, 3
), kept AS MATERIALIZED (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM counted GROUP BY 1, 2 HAVING sum(docs) >= 3
), langs AS (
  SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY 1
), filled AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n, k.n AS lang_n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sizes AS (
  SELECT lang, source, sum(n) AS total FROM filled GROUP BY 1, 2
), shares AS MATERIALIZED (
  SELECT lang, source, term, f.n, 1 + 1000000000 * (f.n + 1) // (s.total + v) AS p, 1 + 1000000000 * (f.lang_n + 1) // (l.total + v) AS q FROM filled f JOIN sizes s USING (lang, source) JOIN langs l USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM parts
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
""",
    "op12_substrings": r"""
WITH base AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), each AS MATERIALIZED (
  SELECT d, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM base
), windows AS (
  SELECT d, i, w, count(*) OVER (o ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS c, string_agg(w, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS s FROM each WINDOW o AS (PARTITION BY d ORDER BY i)
), judged AS MATERIALIZED (
  SELECT d, i, w, CASE WHEN c = 35 AND count(*) OVER (PARTITION BY c, s) > 1 THEN 1 ELSE 0 END AS again FROM (SELECT d, i, w, c, md5(s) AS s FROM windows)
), covered AS (
  SELECT d, i, w, max(again) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM judged
), per AS (
  SELECT d, sum(gone) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM covered GROUP BY d
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM base LEFT JOIN per USING (d)
""",
    "op13_vectorcodes": vectorcodes_sql(),
}
