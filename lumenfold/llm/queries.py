"""The queries of this subpackage over the standard tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    hard_negatives,
    importance,
    language_id,
    license_scan,
    line_dedup,
    media,
    near_dedup,
    packing,
    quality,
    sanitise,
    toxicity,
    warc,
)
from .common import Scratch, table

#: The vocabulary file that op6 and the pipeline tokenise with; a parameter, as its place depends on the machine.
VOCABULARY: str | None = None


def vocabulary() -> str:
    if VOCABULARY:
        return VOCABULARY
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines: doc_id, n_lines, n_removed, n_removed_near, text."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.col("__removed_near").alias("n_removed_near"), "text"
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.learn(docs, labels.where(_fold(3) != 1))
    return toxicity.score(docs, model).select(
        "doc_id", (_fold(3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    warc.write(warc.revisits(table(spark, sf_dir, "pages")), folder)
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("bigint")
    return warc.scan(spark, folder).select(
        page("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").alias("refers_to")
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, vocabulary(), with_ids=False)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(_fold(3) != 1))
    named = language_id.predict(docs.select("doc_id", "text"), model, "lang_pred", "score")
    return named.select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.learn(docs, labels.where(_fold(5) != 0))
    return quality.score(docs, model).select(
        "doc_id", (_fold(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    both = F.array_sort(F.array_distinct(F.concat(base, F.transform("detections", lambda d: d["label"]))))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"), F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.col("licence_score").alias("score"),
    )


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "media")
    pages, stored = media.store(table(spark, sf_dir, "documents"), scratch)
    resolved = media.resolve(media.sequences(pages), scratch.save(media.describe(stored), "described"))
    return resolved.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption"
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of the five positives of every hundredth vector; every seventh label is moved on first."""
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = hard_negatives.whole_rows(table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document by kind, and the words that disclose it; only Spark's own expressions."""
    found = sanitise.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    named = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.transform("pii_base", named)
    terms = F.transform("pii_terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(kind) for kind, _, _ in sanitise.KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"),
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's features, weight, score and, of the quarter drawn towards the benchmark's texts, rank."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_minhash_near_dedup, op3_toxicity, op4_decontamination, op5_warc,
        op6_best_fit_packing, op7_language_id, op8_quality, op9_license_scan, op10_media_columns,
        op11_hard_negatives, op12_pii, op13_importance_resampling,
    )
}

_DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)
), m AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)
"""

_WARC = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id IS DISTINCT FROM m AND m IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id IS DISTINCT FROM m THEN m END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages)
"""

_NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (
  SELECT p.a, p.b, p.score AS ps, s.b AS nb, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS nth
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY nth <= 10
)
SELECT a AS anchor_id, b AS positive_id, CAST(nth AS INTEGER) AS rank, nb AS negative_id, ps AS positive_score, ns AS negative_score FROM n
"""

_PII = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
k AS (
  SELECT * FROM (VALUES (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
    (3, 'card', '[0-9]([\x20-]?[0-9])+'), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')) t(o, kind, re)
), m AS (
  SELECT r, o, kind, unnest(range(1, len(vs) + 1)) AS i, unnest(vs) AS v, unnest(ps[:len(vs)]) AS p, unnest(ps[2:]) AS q
  FROM (SELECT r, o, kind, regexp_extract_all(text, re) AS vs, string_split_regex(text, re) AS ps FROM d, k WHERE regexp_matches(text, re))
), s AS (
  SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS dg, e - length(v) AS b
  FROM (SELECT *, CAST(sum(length(p) + length(v)) OVER (PARTITION BY r, o ORDER BY i) AS BIGINT) AS e FROM m)
), base AS (
  SELECT r, o, kind, b, e,
    kind || ':' || CASE kind WHEN 'email' THEN translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') WHEN 'ip' THEN v ELSE dg END AS entity,
    CASE WHEN length(p) <= 80 THEN p ELSE regexp_replace("right"(p, 80), '^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', '') END AS before,
    CASE WHEN length(q) <= 80 THEN q ELSE regexp_replace("left"(q, 80), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$', '') END AS after
  FROM s
  WHERE kind = 'email' OR (kind = 'phone' AND length(dg) BETWEEN 8 AND 15)
    OR (kind = 'ip' AND regexp_matches(v, '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'))
    OR (kind = 'card' AND length(dg) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, CAST(length(dg) AS BIGINT) + 1),
      lambda j: list_sum(list_transform(string_split(CAST(CAST(reverse(dg)[j] AS INTEGER) * (2 - j % 2) AS VARCHAR), ''), lambda c: CAST(c AS INTEGER))))) % 10 = 0)
), c AS (
  SELECT r, entity, b - length(before) AS begins, before AS x FROM base UNION ALL SELECT r, entity, e, after FROM base
), cw AS (
  SELECT r, entity, begins, n, unnest(range(1, len(vs) + 1)) AS i, unnest(vs) AS v, unnest(ps[:len(vs)]) AS p
  FROM (SELECT *, row_number() OVER () AS n, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS vs,
    string_split_regex(x, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ps FROM c)
), w AS (
  SELECT r, entity, translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, e - length(v) AS b, e
  FROM (SELECT *, begins + CAST(sum(length(p) + length(v)) OVER (PARTITION BY n ORDER BY i) AS BIGINT) AS e FROM cw)
), t AS (SELECT DISTINCT r, entity, term, b, e FROM w WHERE length(term) BETWEEN 3 AND 64),
counts AS (
  SELECT term, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
  ) GROUP BY term
), total AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM counts),
near AS (SELECT entity, count(*) AS n FROM t GROUP BY entity),
pairs AS (SELECT entity, term, count(*) AS n FROM t GROUP BY entity, term HAVING count(*) >= 2),
tells AS (
  SELECT entity, term FROM pairs JOIN near USING (entity) JOIN counts USING (term), total
  WHERE log2(pairs.n * total.n / (counts.n * near.n)) * 1.1 >= log2(total.n / near.n)
), more AS (
  SELECT DISTINCT r, b, e FROM t JOIN tells USING (entity, term)
  WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = t.r AND base.b < t.e AND t.b < base.e)
), told AS (
  SELECT r, o, b, kind || ':' || b || ':' || e AS x FROM base UNION ALL SELECT r, 5, b, 'term:' || b || ':' || e FROM more
), g AS (
  SELECT r, count(*) FILTER (o = 1) AS n_email, count(*) FILTER (o = 2) AS n_ip, count(*) FILTER (o = 3) AS n_card, count(*) FILTER (o = 4) AS n_phone,
    sha256(coalesce(string_agg(x, ',' ORDER BY o, b) FILTER (o < 5), '')) AS base_sha256, string_agg(x, ',' ORDER BY o, b) AS spans
  FROM told GROUP BY r
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""

_IMPORTANCE = r"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY byte) AS tab FROM bits WHERE k = 8),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), f AS (
  SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM d
), bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM b),
code AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(strlen(g) AS BIGINT) + 1), lambda i: CAST('0x' || hex(encode(g))[2 * i - 1 : 2 * i] AS BIGINT))),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT g FROM f UNION SELECT g FROM bf), tab
), fb AS (SELECT r, bucket FROM f JOIN code USING (g)),
s AS (SELECT bucket, count(*) AS n FROM fb GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN code USING (g) GROUP BY bucket),
al AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s_all, (SELECT coalesce(sum(n), 0) FROM t) AS t_all),
gain AS (
  SELECT s.bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s.n + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM al, s LEFT JOIN t USING (bucket)
), w AS (SELECT r, count(*) AS n, sum(gain) AS total FROM fb JOIN gain USING (bucket) GROUP BY r),
sc AS (
  SELECT d.r, doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN CAST((total - ((total % n) + n) % n) // n AS BIGINT) ELSE 0 END AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS g
  FROM d LEFT JOIN w USING (r)
), o AS (SELECT r, row_number() OVER (ORDER BY weight + g DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n_all FROM sc WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, CAST(weight + g AS BIGINT) AS score, CASE WHEN rank <= 25 * n_all // 100 THEN rank END AS rank
FROM sc LEFT JOIN o USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": _DECONTAMINATION, "op5_warc": _WARC, "op11_hard_negatives": _NEGATIVES, "op12_pii": _PII, "op13_importance_resampling": _IMPORTANCE,
}
