"""Registered queries of the corpus operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, cotraining, exact_dedup, filter_audit, html, media, mixing, pii, secrets, simhash, spm, toxicity, url_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _joined(spans):
    """kind:start:end of spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans, kind):
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *[_count("spans", k) for k in pii.KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *[_count("spans", k) for k in secrets.BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.to_json("evidence").alias("evidence"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_model() -> str:
    """Place of the public 32k model; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spm.encode(table(spark, sf_dir, "documents"), tokenizer_model(), decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.read_media(media.encode_media(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("phash")).alias("feature"),
    )


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"))


OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM totals),
sums AS (
  SELECT source, source_size, weight,
    1.5e0 * sum(source_size) OVER () - 2e0 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
    row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
  FROM weighed),
first_open AS (SELECT rest, weights, place FROM sums WHERE 2e0 * source_size * weights > rest * weight ORDER BY place LIMIT 1),
targets AS (
  SELECT s.source, s.source_size,
    CAST(CASE WHEN f.place IS NULL OR s.place < f.place THEN 2e0 * s.source_size ELSE least(f.rest * s.weight / f.weights, 2e0 * s.source_size) END AS DOUBLE) AS target
  FROM sums s LEFT JOIN first_open f ON true),
rates AS (
  SELECT source, source_size, target, rate, CAST(floor((rate - floor(rate)) * 64) AS BIGINT) AS full_units,
    (rate - floor(rate)) * 64 - floor((rate - floor(rate)) * 64) AS part
  FROM (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate FROM targets) t),
drawn AS (
  SELECT doc_id, source, size, CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 67108864e0 AS draw
  FROM docs),
units AS (
  SELECT r.source, CAST(floor(d.draw) AS BIGINT) AS unit, sum(d.size) AS whole,
    sum(CASE WHEN d.draw - floor(d.draw) < r.part THEN d.size ELSE 0 END) AS below
  FROM drawn d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source GROUP BY r.source, CAST(floor(d.draw) AS BIGINT)),
turns AS (
  SELECT r.source, t.turn, abs(CAST(sum(CASE WHEN (u.unit + t.turn) % 64 < r.full_units THEN u.whole WHEN (u.unit + t.turn) % 64 = r.full_units THEN u.below ELSE 0 END) AS DOUBLE)
      - (max(r.target) - floor(max(r.rate)) * max(r.source_size))) AS missed
  FROM rates r JOIN units u ON r.source IS NOT DISTINCT FROM u.source CROSS JOIN (SELECT CAST(unnest(range(64)) AS BIGINT) AS turn) t
  GROUP BY r.source, t.turn),
chosen AS (SELECT source, turn FROM (SELECT source, turn, row_number() OVER (PARTITION BY source ORDER BY missed, turn) AS place FROM turns) t WHERE place = 1),
plan AS (
  SELECT d.doc_id, d.size, r.source_size, r.target,
    floor(r.rate) + CASE WHEN (CAST(floor(d.draw) AS BIGINT) + c.turn) % 64 < r.full_units
      OR ((CAST(floor(d.draw) AS BIGINT) + c.turn) % 64 = r.full_units AND d.draw - floor(d.draw) < r.part) THEN 1 ELSE 0 END AS copies
  FROM drawn d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(size * copies AS BIGINT) AS taken
FROM plan"""

OP5_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
ranked AS (
  SELECT doc_id, sha256(body) AS text_sha256,
    max(doc_id) OVER (PARTITION BY body) AS keep_id,
    count(*) OVER (PARTITION BY body) AS group_size,
    row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) AS place
  FROM docs)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked"""

# The orders are followed one by one here; no transform and no closed form.
OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
failing AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS fails
  FROM docs),
known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
held AS (
  SELECT f.part, f.fails, count(*) AS n, count(*) FILTER (k.good) AS good, count(*) FILTER (k.toxic) AS toxic
  FROM failing f LEFT JOIN known k ON f.doc_id = k.doc_id GROUP BY f.part, f.fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
told AS (
  SELECT h.part, s.filter_order, s.step, s.letter, h.n, h.good, h.toxic, length(h.fails) AS failures,
    contains(h.fails, s.letter) AS here, length(translate(s.before, h.fails, '')) < length(s.before) AS earlier
  FROM held h, steps s),
summed AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS removed,
    coalesce(sum(n) FILTER (here AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (here AND failures = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (here AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT earlier), 0) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM summed"""


def _op12_sql(rounds: int = 3) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
apart{r} AS (
  SELECT v.row, c.cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
  FROM kept v, centroids{r} c),
placed{r} AS MATERIALIZED (
  SELECT row, cluster, distance FROM (SELECT row, cluster, distance, row_number() OVER (PARTITION BY row ORDER BY distance, cluster) AS place FROM apart{r}) t WHERE place = 1)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT p.cluster, i.i, CAST(sum(v.q[i.i]) AS BIGINT) AS s, count(*) AS n
  FROM placed{r} p JOIN kept v ON p.row = v.row CROSS JOIN (SELECT unnest(range(1, 65)) AS i) i GROUP BY p.cluster, i.i),
moved{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM sums{r} GROUP BY cluster),
centroids{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM centroids{r} c LEFT JOIN moved{r} m ON c.cluster = m.cluster)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
centroids0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY digest, q) - 1 AS INTEGER) AS cluster, q FROM (SELECT sha256('1:' || vec_id) AS digest, q FROM kept ORDER BY digest, q LIMIT 16) t),{",".join(steps)}
SELECT v.vec_id, p.cluster, CAST(p.distance AS BIGINT) AS distance, CAST(sum(p.distance) OVER (PARTITION BY p.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(p.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM placed{rounds} p JOIN kept v ON p.row = v.row JOIN centroids{rounds} c ON p.cluster = c.cluster"""


OP12_SQL = _op12_sql()

OP13_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '://[^?#]*((?s:.*))', 1) AS rest
  FROM pages),
rules AS (SELECT unnest(['net', 'example.net', 'example.com', 'org']) AS rule_host, unnest(['/', '/en/', '/de/', '/fr/']) AS rule_path, unnest(['block', 'allow', 'block', 'allow']) AS says),
judged AS (
  SELECT p.page_id, p.host, p.path, '//' || p.host || p.path || p.rest AS address,
    (SELECT max_by(struct_pack(rule := r.rule_host || r.rule_path, says := r.says), length(r.rule_host || r.rule_path)) FROM rules r
     WHERE ends_with('.' || p.host, '.' || r.rule_host) AND starts_with(p.path, r.rule_path)) AS found
  FROM parts p)
SELECT page_id, host, path, found.rule AS rule,
  CASE WHEN found IS NOT NULL THEN found.says
    WHEN regexp_matches(address, '[^A-Za-z0-9](ads-track|free-bets|casino-win|adult-x|cheap-pills|spam-farm|casino|viagra|porn|xxx)([^A-Za-z0-9]|$)')
      OR regexp_matches(address, '^//([^/?#]*\.)?(ads|adserver|doubleclick)\.') OR contains(address, '/affiliate/')
      OR regexp_matches(address, '(?s)/banner.*/click([^A-Za-z0-9]|$)') OR regexp_matches(address, '(?s)/track.*pixel([^A-Za-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_pii, op3_mixing, op4_toxicity, op5_exact_dedup, op6_quality, op7_sentencepiece, op8_media, op9_html, op10_secrets, op11_filter_audit, op12_centroids, op13_url_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op11_filter_audit": OP11_SQL, "op12_centroids": OP12_SQL, "op13_url_rules": OP13_SQL}
