"""The registered queries of the training-data operators: thin calls over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import bytebpe, common, filteraudit, langid, mainhtml, merkle, mpegts, packing, passages, rpforest, seekable, simhash, suffixdedup, toxicity


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digests(common.documents(spark, sf_dir)).drop("spans")


def op2_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rpforest.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "ranked")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = langid.learn(docs.filter(~langid.held_out()))
    got = langid.predict(docs, model)
    return got.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "margin")


def op4_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.read(mpegts.stored(common.documents(spark, sf_dir)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.classes(common.documents(spark, sf_dir))


def op7_seekable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seekable.read(spark, seekable.write(common.documents(spark, sf_dir)))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(common.documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(common.documents(spark, sf_dir))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs.filter(~toxicity.held_out()), labels.filter(~toxicity.held_out()))
    got = toxicity.score(docs, model)
    return got.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filteraudit.audit(filteraudit.counters(filteraudit.failures(common.documents(spark, sf_dir)), labels))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = {"text": F.translate("text", upper, upper.lower())}
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(common.documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], tampered, picked)


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_rp_forest, op3_language_id, op4_transport_streams, op5_packing, op6_passages, op7_seekable_tokens, op8_byte_bpe, op9_simhash, op10_toxicity, op11_filter_audit, op12_main_text, op13_merkle_manifest)}


#: Every 100-byte window, in hexadecimal; the later ones of equal windows, joined to spans; what is left between spans.
_SUFFIX_SQL = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  c AS (SELECT doc_id, o, substr(h, 2 * o + 1, 598) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 200)) AS o FROM b)),
  w AS MATERIALIZED (SELECT doc_id, o + j AS i, md5(substr(part, 2 * j + 1, 200)) AS k FROM (SELECT doc_id, o, part, unnest(range(0, least(200, greatest(length(part) // 2 - 99, 0)))) AS j FROM c)),
  m AS (SELECT k, min(doc_id * 10000000 + i) AS first FROM w GROUP BY k HAVING count(*) > 1),
  f AS (SELECT doc_id, i FROM w JOIN m ON m.k = w.k WHERE doc_id * 10000000 + i <> first),
  g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS s FROM f),
  p AS (SELECT doc_id, i, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g),
  spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM p GROUP BY doc_id, n),
  q AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM spans
        UNION ALL SELECT b.doc_id, coalesce(max(s.z), 0), any_value(length(h) // 2) FROM b LEFT JOIN spans s ON s.doc_id = b.doc_id GROUP BY b.doc_id),
  kept AS (SELECT q.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS t FROM q JOIN b ON b.doc_id = q.doc_id GROUP BY q.doc_id),
  n AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
  SELECT b.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(t)) AS kept_sha256
  FROM b JOIN kept ON kept.doc_id = b.doc_id LEFT JOIN n ON n.doc_id = b.doc_id"""

#: The mask of each document's failures, counted by part; every order as a string of letters, every step's earlier letters.
_AUDIT_SQL = r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
  f AS (SELECT doc_id, part, (len(w) < 50) AS a, (100 * len(list_distinct(w)) < 65 * len(w)) AS b,
          (100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * length(x)) AS c, regexp_matches(x, '[#$%&*|]') AS d,
          coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS e FROM t),
  m AS (SELECT part, a, b, c, d, e, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
        FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY ALL),
  s(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
  o AS (SELECT concat(s1.x, s2.x, s3.x, s4.x, s5.x) AS filter_order FROM s s1 JOIN s s2 ON s2.x <> s1.x JOIN s s3 ON s3.x NOT IN (s1.x, s2.x) JOIN s s4 ON s4.x NOT IN (s1.x, s2.x, s3.x) JOIN s s5 ON s5.x NOT IN (s1.x, s2.x, s3.x, s4.x)),
  k AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
  r AS (SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS own, len(fails) AS size, len(translate(fails, before, '')) < len(fails) AS gone FROM m, k),
  v AS (SELECT part, x, sum(n) AS shapley FROM r WHERE own AND NOT gone GROUP BY part, x)
  SELECT r.part, filter_order, step, CAST(sum(if(gone OR own, 0, n)) AS BIGINT) AS kept, CAST(sum(if(own AND NOT gone, n, 0)) AS BIGINT) AS removed, CAST(sum(if(own AND gone, n, 0)) AS BIGINT) AS redundant,
    CAST(sum(if(own AND size = 1, n, 0)) AS BIGINT) AS unique_fails, CAST(sum(if(own AND NOT gone, good, 0)) AS BIGINT) AS good_lost, CAST(sum(if(own AND NOT gone, toxic, 0)) AS BIGINT) AS toxic_lost,
    CAST(any_value(coalesce(shapley, 0)) AS BIGINT) AS shapley
  FROM r LEFT JOIN v ON v.part = r.part AND v.x = r.x GROUP BY r.part, filter_order, step"""


def _merkle_sql(levels: int = 7) -> str:
    """Each level of both trees as a table of the rows' runs, siblings and folded digests, 16^7 leaves at most."""
    told = ", ".join(f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', {c}), '-')" for c in ("doc_id", "source", "lang", "n_chars"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: xor(d >> 1, 3988292384 * (d & 1))))"
    steps = [f"""d AS (SELECT doc_id, source, {crc} AS crc, text, sha256(concat({told}, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
    sha256(concat({told}, coalesce(concat(strlen(text), ':', translate(text, '{upper}', '{upper.lower()}')), '-'))) AS other FROM documents)""",
        "a0 AS MATERIALIZED (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS h FROM d)"]
    for tree in "ab":
        if tree == "b":
            steps.append(f"b0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, h, g AS source FROM a{levels})")
        for k in range(levels):
            t = f"{tree}{k}"
            steps.append(f"{t}n AS (SELECT g, p, h, count(*) OVER (PARTITION BY g) AS n FROM {t})")
            steps.append(f"{tree}{k + 1} AS MATERIALIZED (SELECT g, p // 16 AS p, if(max(n) = 1, max(h), sha256(string_agg(h, '' ORDER BY p))) AS h FROM {t}n GROUP BY g, p // 16)")
            frame = "PARTITION BY g, p // 16 ORDER BY p ROWS BETWEEN"
            steps.append(f"{t}s AS MATERIALIZED (SELECT g, p, n, coalesce(string_agg(h, '') OVER ({frame} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({frame} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t}n)")
    steps.append("f0 AS (SELECT doc_id, source, leaf, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, '' AS path, if(crc IS NOT NULL AND xor(crc, 4294967295) % 5 = 0, other, leaf) AS v FROM d)")
    fold = "f.path || s.l || s.r AS path, if(s.n = 1, f.v, sha256(concat(s.l, f.v, s.r))) AS v"
    for k in range(levels):
        steps.append(f"f{k + 1} AS MATERIALIZED (SELECT doc_id, source, leaf, f.p // 16 AS p, {fold} FROM f{k} f JOIN a{k}s s ON s.g IS NOT DISTINCT FROM f.source AND s.p = f.p)")
    steps.append(f"e0 AS (SELECT doc_id, leaf, b.h AS subroot, b.p, path, v FROM f{levels} f JOIN b0 b ON b.source IS NOT DISTINCT FROM f.source)")
    for k in range(levels):
        steps.append(f"e{k + 1} AS MATERIALIZED (SELECT doc_id, leaf, subroot, f.p // 16 AS p, {fold} FROM e{k} f JOIN b{k}s s ON s.p = f.p)")
    joined = ",\n  ".join(steps)
    return f"WITH {joined}\n  SELECT doc_id, leaf, subroot, b.h AS root, sha256(path) AS proof_sha256, v AS folded_root, v = b.h AS verified FROM e{levels}, b{levels} b"


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against plain versions."""
    return {"op1_suffix_dedup": _SUFFIX_SQL, "op11_filter_audit": _AUDIT_SQL, "op13_merkle_manifest": _merkle_sql()}
