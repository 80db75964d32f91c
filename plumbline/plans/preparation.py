"""Queries over dataset records: splits, duplicates, conflicts and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, splits
from ..sources import adapters
from .evaluation import DIGITS, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}
ORDER = ("train", "validation", "test")


def _add(query, sql: str | None = None):
    QUERIES[query.__name__] = query
    if sql:
        SQL[query.__name__] = sql


def _labels(spark, sf_dir) -> DataFrame:
    return adapters.table(spark, sf_dir, "labels").select("doc_id", "quality")


RANKED = """k AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('1234:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)"""


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-03."""
    return splits.stratified(_labels(spark, sf_dir), "quality", "doc_id")


_add(stratified_split, f"""WITH {RANKED} SELECT doc_id, quality, CASE WHEN n < 2 OR r <= greatest(least(round_even(n * 0.4::DOUBLE, 0)::BIGINT, n - 1), 1) THEN 'validation' ELSE 'test' END AS split FROM k""")


def half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-04."""
    return splits.halves(_labels(spark, sf_dir), "quality", "doc_id")


_add(half_split, f"WITH {RANKED} SELECT doc_id, quality, CASE WHEN n < 2 OR r <= greatest(least(n // 2, n - 1), 1) THEN 'validation' ELSE 'test' END AS split FROM k")


def bucket_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-07."""
    docs = adapters.table(spark, sf_dir, "documents").select("doc_id")
    return docs.withColumn("split", splits.bucket(F.sha2(F.col("doc_id").cast("string"), 256), 0.1, 0.2))


SHARE = "(('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
BUCKET = f"CASE WHEN {SHARE} < 0.1::DOUBLE THEN 'test' WHEN {SHARE} < {0.1 + 0.2!r}::DOUBLE THEN 'validation' ELSE 'train' END"
_add(bucket_split, f"SELECT doc_id, {BUCKET} AS split FROM documents")


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-05: a sampling operator."""
    return splits.hash_sample(adapters.table(spark, sf_dir, "documents").select("doc_id", "lang"), 50, "doc_id", 7, "pool")


_add(hash_sample, "SELECT doc_id, lang FROM documents ORDER BY sha256('7:pool:' || doc_id), doc_id LIMIT 50")


def per_class_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-06, T-05, S-02's class cap."""
    return splits.per_class(_labels(spark, sf_dir), "quality", ["doc_id"], 60, 2)


_add(per_class_cap, """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS k FROM labels)
  SELECT doc_id, quality FROM r WHERE k <= 30 ORDER BY doc_id LIMIT 60""")


def group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-09: five whole sources."""
    return splits.group_limit(adapters.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5, 3)


_add(group_limit, "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY sha256('3:' || source), source LIMIT 5)")


def _records(spark, sf_dir) -> DataFrame:
    """Documents as records: split by a hash bucket, label by a hash of the id, group and content by the text."""
    docs = adapters.table(spark, sf_dir, "documents")
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.format_string("%s/doc_%d.txt", "source", "doc_id").alias("path"), splits.bucket(h, 0.1, 0.2).alias("split"),
        (F.conv(F.substring(h, 1, 1), 16, 10).cast("int") % 2).alias("label"),
        F.sha2(F.lower(F.trim(text)), 256).alias("group_id"), audit.content_hash(text).alias("hash"),
    )


REC = f"""rec AS (SELECT source || '/doc_' || doc_id || '.txt' AS path, {BUCKET} AS split, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 1))::INT % 2 AS label,
  sha256(lower(trim(coalesce(text, '')))) AS group_id, sha256(coalesce(text, '')) AS hash FROM documents),
  gr AS (SELECT hash, count(*) AS members, list_sort(list(DISTINCT label)) AS labels, list_sort(list(DISTINCT split)) AS splits, min(group_id) = max(group_id) AS same_group FROM rec GROUP BY 1)"""
LISTS = "array_to_string(labels, ',') AS labels, array_to_string(splits, ',') AS splits"


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("labels", "splits")})


def content_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-01, C-04, C-10, A-32: the group id is the second hash."""
    return _flat(audit.conflicts(_records(spark, sf_dir).withColumn("second", F.col("group_id")), "hash", "second"))


_add(content_conflicts, f"""WITH {REC}, g2 AS (SELECT group_id AS content, count(*) AS members, list_sort(list(DISTINCT label)) AS labels, list_sort(list(DISTINCT split)) AS splits, true AS same_group,
    count(DISTINCT hash) AS hashes FROM rec GROUP BY 1)
  SELECT hash AS content, members, {LISTS}, same_group, 'hash' AS reason FROM gr WHERE len(labels) > 1
  UNION ALL SELECT content, members, {LISTS}, same_group, 'second' FROM g2 WHERE len(labels) > 1 AND hashes > 1""")


def cross_split_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-05."""
    return _flat(audit.cross_split(_records(spark, sf_dir)))


_add(cross_split_duplicates, f"WITH {REC} SELECT hash, members, {LISTS}, same_group FROM gr WHERE len(splits) > 1")


def quarantine_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-09, U-04."""
    return audit.quarantine(_records(spark, sf_dir))


Q_SQL = f"{REC}, qu AS (SELECT path, split, label, group_id, hash, 'label_conflict' AS reason, members - 1 AS shared_with FROM rec JOIN gr USING (hash) WHERE len(labels) > 1)"
_add(quarantine_manifest, f"WITH {Q_SQL} SELECT * FROM qu")


def quarantine_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-08, J-04: what is left, per split."""
    records = _records(spark, sf_dir)
    left = audit.keep(records, audit.quarantine(records))
    return left.groupBy("split").agg(F.count(F.lit(1)).alias("kept"), F.sum("label").alias("positives"))


_add(quarantine_filter, f"WITH {Q_SQL} SELECT split, count(*) AS kept, sum(label)::BIGINT AS positives FROM rec WHERE path NOT IN (SELECT path FROM qu) GROUP BY 1")


def group_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-08: rows are counted, not groups."""
    return splits.collisions(_records(spark, sf_dir), "group_id", "split", ORDER)


PLACE = "CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END"
COLL = f"""{REC}, o AS (SELECT group_id, arg_min(split, {PLACE}) AS owner, count(DISTINCT split) AS splits FROM rec GROUP BY 1),
  col AS (SELECT group_id, owner, splits, (SELECT count(*) FROM rec r WHERE r.group_id = o.group_id AND r.split <> o.owner) AS rows_elsewhere FROM o WHERE splits > 1)"""
_add(group_collisions, f"WITH {COLL} SELECT * FROM col")


def split_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-07, C-08."""
    out = splits.leakage(_records(spark, sf_dir), "group_id", "split", ORDER)
    return out.withColumn("examples", F.array_join("examples", ","))


_add(split_isolation, f"""WITH {COLL} SELECT count(*) AS groups, coalesce(sum(rows_elsewhere), 0)::BIGINT AS rows_elsewhere,
  array_to_string(list_sort(list(group_id))[:5], ',') AS examples FROM col""")


def mixture_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-14: English documents as the base, each other language as a pool."""
    docs = adapters.table(spark, sf_dir, "documents")
    sizes = docs.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("available"))
    base = sizes.where("lang = 'en'").select(F.col("available").alias("base"))
    out = sizes.where("lang <> 'en'").join(F.broadcast(base))
    out = out.withColumn("taken", splits.mixture_size(F.col("base"), 0.25, F.col("available")))
    return out.withColumn("fraction", F.try_divide(F.col("taken").cast("double"), (F.col("taken") + F.col("base")).cast("double")))


_add(mixture_plan, """WITH s AS (SELECT lang, count(*) AS available FROM documents WHERE lang IS NOT NULL GROUP BY 1), b AS (SELECT available AS base FROM s WHERE lang = 'en'),
  t AS (SELECT s.*, base, least(round_even(base * 0.25::DOUBLE / 0.75::DOUBLE, 0)::BIGINT, available) AS taken FROM s CROSS JOIN b WHERE lang <> 'en')
  SELECT *, taken::DOUBLE / (taken + base) AS fraction FROM t""")


def _vectors(spark, sf_dir) -> DataFrame:
    """Embeddings as records: 64 sign bits as fingerprint, the vector as content, a split by id.

    Four vectors of five keep their first 12 signs only, as near copies and equal fingerprints are rare here."""
    rows = adapters.table(spark, sf_dir, "embeddings")
    split = F.when(F.col("vec_id") % 5 == 0, "test").when(F.col("vec_id") % 5 == 1, "validation").otherwise("train")
    few = F.transform("embedding", lambda v, k: F.when(k < 12, v).otherwise(F.lit(1.0)))
    seen = F.when(F.col("vec_id") % 5 < 4, few).otherwise(F.col("embedding"))
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("content"), audit.sign_bits(seen, 64).alias("h"), split.alias("split"), "label")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-03, C-06, J-05: fingerprints within two bits, by three bands."""
    return audit.near_report(_vectors(spark, sf_dir), 2)


def near_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-06: the content and the class of every vector."""
    return audit.near_members(_vectors(spark, sf_dir))


VECTORS_SQL = """e AS (SELECT vec_id AS id, embedding AS content, label, CASE vec_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split,
    string_agg(CASE WHEN (vec_id % 5 < 4 AND i > 12) OR v > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS h
    FROM (SELECT vec_id, embedding, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2, 3),
  k AS (SELECT h, content, min(id) AS id, bool_or(split = 'train') AS t, bool_or(split <> 'train') AS o, min(label) AS lo, max(label) AS hi FROM e GROUP BY 1, 2),
  c AS (SELECT h, min(id) AS id, bool_or(t) AS t, bool_or(o) AS o, min(lo) AS lo, max(hi) AS hi FROM k GROUP BY 1)"""
_add(near_duplicates, f"""WITH {VECTORS_SQL}, p AS (
    SELECT a.id AS i, b.id AS j, hamming(a.h, b.h) AS distance, (a.t AND b.o) OR (a.o AND b.t) AS cross_split, NOT (a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo) AS labels_differ
    FROM c a JOIN c b ON a.h < b.h WHERE hamming(a.h, b.h) <= 2
    UNION ALL SELECT f.id, k.id, 0, (f.t AND k.o) OR (f.o AND k.t), NOT (f.lo = f.hi AND k.lo = k.hi AND f.lo = k.lo) FROM k JOIN c USING (h) JOIN k f ON f.id = c.id WHERE k.id <> c.id)
  SELECT least(i, j) AS id1, greatest(i, j) AS id2, distance::INT AS distance, cross_split, labels_differ FROM p""")
_add(near_duplicate_members, f"WITH {VECTORS_SQL} SELECT e.id, k.id AS content_id, c.id AS class_id FROM e JOIN k ON e.h = k.h AND e.content = k.content JOIN c ON e.h = c.h")


def _pages(spark, sf_dir) -> DataFrame:
    pages = adapters.table(spark, sf_dir, "pages")
    size = F.length(F.coalesce("html", F.lit("")))
    width, height = 100 + F.col("page_id") % 7 * 200, 100 + F.col("page_id") % 5 * 300
    every = audit.container_attributes(width.cast("int"), height.cast("int"), size)
    return pages.select("page_id", "url", (F.col("page_id") % 2).cast("int").alias("label"), F.regexp_extract("url", "^(https?)", 1).alias("scheme"), *[c.alias(n) for n, c in every.items()])


ATTRIBUTES = ("scheme", "resolution", "megapixels", "aspect_ratio", "bytes_per_pixel")


def attribute_confounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-28, C-11, C-12."""
    return rounded(audit.confounds(_pages(spark, sf_dir), ATTRIBUTES), "separation")


def _edges(x: str, edges) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {e!r}::DOUBLE THEN '<={e:g}'" for e in edges) + f" ELSE '>{edges[-1]:g}' END"


_add(attribute_confounds, f"""WITH p AS (SELECT page_id % 2 AS label, regexp_extract(url, '^(https?)', 1) AS scheme, length(coalesce(html, '')) AS z, 100 + page_id % 7 * 200 AS w, 100 + page_id % 5 * 300 AS h FROM pages),
  a AS (SELECT label, scheme, w || 'x' || h AS resolution, {_edges('w * h / 1e6::DOUBLE', audit.MEGAPIXEL_EDGES)} AS megapixels, {_edges('w::DOUBLE / h', audit.ASPECT_EDGES)} AS aspect_ratio,
    {_edges('z::DOUBLE / (w * h)', audit.BYTES_PER_PIXEL_EDGES)} AS bytes_per_pixel FROM p),
  l AS (""" + " UNION ALL ".join(f"SELECT label, '{a}' AS attribute, {a} AS value FROM a" for a in ATTRIBUTES) + f"""),
  v AS (SELECT attribute, value, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM l GROUP BY 1, 2)
  SELECT attribute, count(*) AS "values", round(sum(greatest(p, n))::DOUBLE / sum(p + n), {DIGITS}) AS separation, sum(greatest(p, n))::DOUBLE / sum(p + n) >= 0.8::DOUBLE AS flagged FROM v GROUP BY 1""")


def token_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-29, U-02: tokens of part names, with the size, whose parity is the label."""
    parts = adapters.table(spark, sf_dir, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_s"), F.col("p_size"), F.lit(".jpg")).alias("path"), (F.col("p_size") % 2).alias("label"))
    return audit.exclusive_tokens(parts, "path", "label")


_add(token_leakage, r"""WITH t AS (SELECT DISTINCT p_size % 2 AS label, unnest(string_split(replace(regexp_replace(lower(replace(p_name, ' ', '-') || '_s' || p_size || '.jpg'), '\.[^.]*$', ''), '-', '_'), '_')) AS token FROM part),
  o AS (SELECT token, min(label) AS label FROM t WHERE token <> '' AND NOT regexp_full_match(token, '\d+') GROUP BY 1 HAVING min(label) = max(label)),
  s AS (SELECT label, count(*) AS count, array_to_string(list_sort(list(token))[:10], ',') AS tokens FROM o GROUP BY 1)
  SELECT *, (SELECT count(*) FROM s) > 1 AS flagged FROM s""")


def format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-31."""
    return audit.format_counts(_pages(spark, sf_dir), "label", F.col("scheme"))


_add(format_counts, "SELECT (page_id % 2)::INT AS label, regexp_extract(url, '^(https?)', 1) AS extension, count(*) AS count FROM pages GROUP BY 1, 2")


def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-30, C-16."""
    rows = adapters.scored_documents(spark, sf_dir).select("lang", "binary_label", "source")
    return rounded(splits.balance(rows, ["lang"], "binary_label", "source"), "imbalance")


_add(class_balance, f"""WITH {adapters.DOCS_SQL}, b AS (SELECT lang, count(*) FILTER (binary_label = 1) AS positives, count(*) FILTER (binary_label = 0) AS negatives, count(DISTINCT source) AS groups FROM sd GROUP BY 1)
  SELECT *, round(greatest(positives, negatives)::DOUBLE / nullif(least(positives, negatives), 0), {DIGITS}) AS imbalance FROM b""")


def shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-05: rows per label with class names; labels without one are named by number."""
    names = spark.createDataFrame([(0, "rejected")], "quality int, class_name string")
    counts = adapters.table(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("count"))
    out = counts.join(F.broadcast(names), "quality", "left")
    return out.withColumn("class_name", F.coalesce("class_name", F.format_string("unknown(%d)", "quality")))


_add(shard_stats, "SELECT quality, count(*) AS count, CASE quality WHEN 0 THEN 'rejected' ELSE 'unknown(' || quality || ')' END AS class_name FROM labels GROUP BY 1")


def pair_consistency_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-06, R-19: all pairs of turns of a conversation, from sums instead of pairs."""
    turns = adapters.table(spark, sf_dir, "conversations").select("conv_id", (F.length(F.coalesce("text", F.lit(""))) % 97 / 97.0).alias("p"))
    kl = audit.pair_loss(turns, "conv_id", "p", "kl").select("conv_id", F.col("loss").alias("kl"))
    return rounded(audit.pair_loss(turns, "conv_id", "p").join(kl, "conv_id"), "loss", "kl")


_add(pair_consistency_loss, f"""WITH t AS (SELECT conv_id, turn, row_number() OVER () AS i, length(coalesce(text, '')) % 97 / 97.0::DOUBLE AS p FROM conversations),
  q AS (SELECT *, least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS c FROM t), n AS (SELECT conv_id, count(*) AS count FROM q GROUP BY 1)
  SELECT a.conv_id, n.count, round(avg((a.p - b.p) * (a.p - b.p)), {DIGITS}) AS loss, round(avg(0.5::DOUBLE * (a.c - b.c) * (ln(a.c / (1 - a.c)) - ln(b.c / (1 - b.c)))), {DIGITS}) AS kl
  FROM q a JOIN q b ON a.conv_id = b.conv_id AND a.i < b.i JOIN n ON n.conv_id = a.conv_id GROUP BY 1, 2""")


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-03, Z-03: documents that have no label yet."""
    docs, done = adapters.table(spark, sf_dir, "documents"), adapters.table(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang").join(done.select("doc_id"), "doc_id", "left_anti")


_add(resume_antijoin, "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")


def mask_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-02, J-12: the first of three candidates that exists."""
    docs = adapters.table(spark, sf_dir, "documents").select("doc_id")
    candidates = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("doc_id") * m).alias("page_id")) for k, m in enumerate((3, 2, 1))])
    pages = adapters.table(spark, sf_dir, "pages").select("page_id", F.lit(True).alias("found"))
    tries = docs.select("doc_id", F.inline(candidates)).join(pages, "page_id", "left")
    return tries.groupBy("doc_id").agg(F.min_by("page_id", F.when(F.col("found"), F.col("k"))).alias("mask"))


_add(mask_lookup, """WITH c AS (SELECT doc_id, k, doc_id * m AS page_id FROM documents CROSS JOIN (VALUES (0, 3), (1, 2), (2, 1)) v(k, m))
  SELECT doc_id, arg_min(p.page_id, k) FILTER (p.page_id IS NOT NULL) AS mask FROM c LEFT JOIN pages p USING (page_id) GROUP BY 1""")
