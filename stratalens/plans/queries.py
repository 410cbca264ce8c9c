"""Registered queries over the analogues, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, digests, errors, refs, sizes
from ..operators import apply, inspect, plan, sidecar
from . import analogue as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, and its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Common tables of the SQL, each building on those before.
LAYERS = "WITH layers AS (SELECT source AS image, doc_id AS layer_idx, 'sha256:' || sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS size, lang AS media_type FROM documents)"
SIDES = f"""{LAYERS},
pairs AS (SELECT 'src' || i || '-src' || (i + 1) AS pair, 'src' || i AS baseline_image, 'src' || (i + 1) AS target_image FROM range(19) t(i)),
target AS (SELECT pair, layer_idx, digest, size, media_type FROM layers JOIN pairs ON image = target_image),
baseline AS (SELECT pair, layer_idx, digest, size, media_type FROM layers JOIN pairs ON image = baseline_image)"""
PLANNED = f"""{SIDES},
planned AS (SELECT t.*, CASE WHEN b.digest IS NULL THEN 'shipped' ELSE 'required' END AS part FROM target t LEFT JOIN (SELECT DISTINCT pair, digest FROM baseline) b USING (pair, digest)),
shipped AS (SELECT pair, layer_idx, digest, size, media_type FROM planned WHERE part = 'shipped')"""
PRINTS = """fingerprints AS (SELECT 'sha256:' || sha256(text) AS layer_digest, 'sha256:' || sha256(line) AS file_digest, CAST(max(strlen(line)) AS BIGINT) AS size
  FROM (SELECT DISTINCT text, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY ALL)"""
SCORES = f"""{PLANNED}, {PRINTS},
scores AS (SELECT t.pair, t.digest AS target_digest, c.digest AS candidate_digest, CAST(sum(f.size) AS BIGINT) AS score
  FROM (SELECT DISTINCT pair, digest FROM shipped) t JOIN fingerprints f ON f.layer_digest = t.digest
  JOIN fingerprints g ON g.file_digest = f.file_digest JOIN (SELECT DISTINCT pair, digest FROM baseline) c ON c.pair = t.pair AND c.digest = g.layer_digest
  GROUP BY ALL)"""
RANKED = """met AS (SELECT t.pair, t.target_digest, c.candidate_digest, t.target_size, c.candidate_size, {score} AS score, abs(t.target_size - c.candidate_size) AS distance
  FROM (SELECT DISTINCT pair, digest AS target_digest, size AS target_size FROM shipped) t
  JOIN (SELECT pair, digest AS candidate_digest, max(size) AS candidate_size FROM baseline GROUP BY ALL) c USING (pair) {join}),
top AS (SELECT *, row_number() OVER (PARTITION BY pair, target_digest ORDER BY score DESC, distance, candidate_digest) AS rank FROM met QUALIFY rank <= 3)"""
TOP = f"{SCORES}, " + RANKED.format(score="coalesce(s.score, 0)", join="LEFT JOIN scores s USING (pair, target_digest, candidate_digest)")
TOP_SIZE = f"{PLANNED}, " + RANKED.format(score="CAST(0 AS BIGINT)", join="")
ENCODED = f"""{TOP},
refs AS (SELECT digest, count(*) AS ship_refs FROM shipped GROUP BY digest),
best AS (SELECT pair, target_digest AS digest, arg_min(candidate_digest, (greatest(target_size - score, 1), rank)) AS ref, min(greatest(target_size - score, 1)) AS cost
  FROM top WHERE score > 0 AND greatest(target_size - score, 1) < target_size GROUP BY ALL),
encoded AS (SELECT s.pair, s.layer_idx, s.digest, s.size, s.media_type,
    CASE WHEN b.cost IS NOT NULL AND r.ship_refs = 1 THEN 'patch' ELSE 'full' END AS encoding,
    CASE WHEN b.cost IS NOT NULL AND r.ship_refs = 1 THEN 'zstd-patch' END AS codec,
    CASE WHEN b.cost IS NOT NULL AND r.ship_refs = 1 THEN b.ref END AS patch_from_digest,
    CASE WHEN b.cost IS NOT NULL AND r.ship_refs = 1 THEN b.cost ELSE s.size END AS archive_size
  FROM shipped s JOIN refs r USING (digest) LEFT JOIN best b USING (pair, digest)),
blobs AS (SELECT DISTINCT ON (digest) digest, size, media_type, encoding, codec, patch_from_digest, archive_size FROM encoded ORDER BY digest, pair, layer_idx)"""
ROWS = f"""{ENCODED},
rows AS (SELECT t.pair AS image, t.layer_idx, t.digest, t.size AS target_size, coalesce(b.archive_size, 0) AS archive_size,
    CASE WHEN b.digest IS NULL THEN 'baseline_only' WHEN b.encoding = 'patch' THEN 'patch' ELSE 'full' END AS kind,
    CASE WHEN b.encoding = 'patch' THEN b.patch_from_digest END AS patch_from,
    CASE WHEN b.digest IS NULL THEN t.size ELSE t.size - b.archive_size END AS saved_bytes
  FROM target t LEFT JOIN blobs b USING (digest)),
layer_rows AS (SELECT image, layer_idx, digest, kind, target_size, archive_size, patch_from, saved_bytes,
    CASE WHEN target_size = 0 THEN 0.0 ELSE CAST(saved_bytes AS DOUBLE) / CAST(target_size AS DOUBLE) END AS saved_ratio,
    CASE WHEN kind = 'baseline_only' OR target_size = 0 THEN 0.0 ELSE CAST(archive_size AS DOUBLE) / CAST(target_size AS DOUBLE) END AS ratio
  FROM rows)"""
MONTHS = "WITH lines AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS image, l_orderkey AS layer_idx, CAST(l_partkey AS VARCHAR) AS digest, CAST(floor(l_extendedprice * l_quantity * 256) AS BIGINT) AS size FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
LOG = "CASE WHEN size <= 134217728 THEN 27 WHEN size <= 1073741824 THEN 30 ELSE 31 END"
RSS = f"CAST(CASE {LOG} WHEN 27 THEN 268435456 WHEN 30 THEN 2147483648 ELSE 4294967296 END AS BIGINT)"
#: A memory budget that some layers exceed, in bytes: 2 GiB.
BUDGET = 2 * sizes.GIB


@query(f"{LAYERS} SELECT * FROM layers")
def image_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.layers(spark, sf_dir)


@query(f"{PLANNED} SELECT pair, layer_idx, digest, size, part FROM planned")
def plan_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.planned(spark, sf_dir).select("pair", "layer_idx", "digest", "size", "part")


@query(f"{MONTHS} SELECT t.image, t.layer_idx, t.digest, t.size, CASE WHEN b.digest IS NULL THEN 'shipped' ELSE 'required' END AS part FROM lines t LEFT JOIN (SELECT DISTINCT image + 1 AS image, digest FROM lines) b USING (image, digest)")
def plan_partition_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.month_layers(spark, sf_dir).withColumnRenamed("image", "pair")
    return plan.compute_plan(m, m.select((F.col("pair") + 1).alias("pair"), "digest")).select(F.col("pair").alias("image"), "layer_idx", "digest", "size", "part")


@query(f"WITH {PRINTS} SELECT * FROM fingerprints")
def layer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fingerprints(spark, sf_dir)


@query(f"{SCORES} SELECT * FROM scores")
def similarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = A.written(A.layers(spark, sf_dir), "layers")
    prints = A.named(A.written(A.shared_fingerprints(spark, sf_dir), "fingerprints"), "layer_digest", "file_digest")
    return plan.similarity_scores(A.shipped(spark, sf_dir, every), A.side(spark, sf_dir, "baseline", every), prints)


@query(f"{TOP} SELECT pair, target_digest, candidate_digest, score, distance, rank FROM top")
def pick_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_candidates(spark, sf_dir).select("pair", "target_digest", "candidate_digest", "score", "distance", "rank")


@query(f"{TOP_SIZE} SELECT pair, target_digest, candidate_digest, score, distance, rank FROM top")
def pick_top_k_size_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_candidates(spark, sf_dir, scored=False).select("pair", "target_digest", "candidate_digest", "score", "distance", "rank")


@query(f"{PLANNED} SELECT digest, count(*) AS ship_refs FROM shipped GROUP BY digest")
def ship_ref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.ship_refs(A.shipped(spark, sf_dir))


@query("SELECT CAST(l_partkey AS VARCHAR) AS digest, count(*) AS ship_refs FROM lineitem GROUP BY l_partkey")
def ship_ref_counts_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.ship_refs(A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("digest")))


@query(f"{PLANNED} SELECT DISTINCT ON (digest) digest, pair, layer_idx, size, media_type FROM shipped ORDER BY digest, pair, layer_idx")
def blob_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.blob_pool(A.shipped(spark, sf_dir)).orderBy("digest")


@query(f"{SIDES} SELECT digest, max(size) AS size FROM baseline GROUP BY digest")
def baseline_digest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.side(spark, sf_dir, "baseline").groupBy("digest").agg(F.max("size").alias("size"))


@query(f"{ENCODED} SELECT pair, layer_idx, digest, size, encoding, patch_from_digest, archive_size AS est_archive_size FROM encoded")
def best_encoding_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.encodings(spark, sf_dir).select("pair", "layer_idx", "digest", "size", "encoding", "patch_from_digest", F.col("archive_size").alias("est_archive_size"))


def contents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by digest, packed before copies meet."""
    docs = A.table(spark, sf_dir, "documents").select(digests.digest(F.col("text")).alias("digest"), F.col("text").cast("binary").alias("content"))
    return codec.packed(docs).dropDuplicates(["digest"])


@query()
def best_encoding_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real patch sizes: every shipped layer against its candidates, by the codec."""
    every = A.written(A.layers(spark, sf_dir), "layers")
    ship = A.written(A.shipped(spark, sf_dir, every), "shipped")
    bytes_of = contents_of(spark, sf_dir)
    refs = plan.ship_refs(ship)
    once = refs.where("ship_refs = 1").select(F.col("digest").alias("target_digest"))  # others are full whatever a trial gives
    tops = A.top_candidates(spark, sf_dir, every=every, ship=ship).select("pair", "target_digest", "candidate_digest", "target_size", "rank")
    trials = codec.trial_sizes(A.written(tops.join(once, "target_digest", "left_semi"), "tops"), bytes_of)
    best = plan.choose_best(ship, refs, trials)
    return best.select("pair", "layer_idx", "digest", "size", "encoding", "patch_from_digest", "archive_size")


@query()
def patch_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target with its first candidate: encoded, decoded, and compared by digest."""
    bytes_of = contents_of(spark, sf_dir)
    tops = A.top_candidates(spark, sf_dir).where("rank = 1").select("pair", "target_digest", "candidate_digest", "target_size", "rank")
    tops = A.written(tops, "tops")
    packed = codec.encode_patches(tops, bytes_of)
    rebuilt = codec.decode_patches(packed, bytes_of)
    return rebuilt.select("pair", "target_digest", "candidate_digest", "patch_size", digests.verified(F.col("content"), F.col("target_digest")).alias("verified"))


@query(f"{MONTHS} SELECT image, layer_idx, digest, size, CAST({LOG} AS INTEGER) AS window_log, {RSS} AS est_rss FROM lines")
def window_log_rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = sizes.window_log(F.col("size"))
    return A.month_layers(spark, sf_dir).select("*", log.cast("int").alias("window_log"), sizes.window_rss(log).alias("est_rss"))


@query(f"{MONTHS}, est AS (SELECT *, {RSS} AS est_rss FROM lines) SELECT image AS pair, layer_idx, digest, est_rss FROM est WHERE est_rss > {BUDGET} ORDER BY est_rss DESC, image, layer_idx, digest LIMIT 1")
def budget_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.over_budget(A.month_layers(spark, sf_dir).withColumnRenamed("image", "pair"), BUDGET)


@query(f"{MONTHS} SELECT image, max({RSS}) AS est_rss FROM lines GROUP BY image")
def image_rss_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.image_rss(A.month_layers(spark, sf_dir))


@query(f"{MONTHS}, est AS (SELECT image, max({RSS}) AS est_rss FROM lines GROUP BY image) SELECT image, est_rss FROM est WHERE est_rss > {BUDGET} ORDER BY image LIMIT 1")
def image_budget_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.images_over_budget(plan.image_rss(A.month_layers(spark, sf_dir)), BUDGET)


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = A.written(A.layers(spark, sf_dir), "layers")
    return inspect.layer_rows(A.target_layers(spark, sf_dir, every), A.model_blobs(spark, sf_dir, every))


@query(f"{ROWS} SELECT * FROM layer_rows")
def inspect_layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sf_dir)


@query(f"""{ENCODED} SELECT *, CASE WHEN patch_count > 0 AND patch_original > 0 THEN CAST(patch_archive AS DOUBLE) / CAST(patch_original AS DOUBLE) END AS patch_ratio,
  CASE WHEN patch_count > 0 THEN patch_original - patch_archive END AS patch_savings, patch_count > 0 AS requires_zstd
FROM (SELECT count(*) AS blobs, count(*) FILTER (encoding = 'full') AS full_count, count(*) FILTER (encoding = 'patch') AS patch_count,
  CAST(coalesce(sum(archive_size), 0) AS BIGINT) AS total_archive, CAST(coalesce(sum(archive_size) FILTER (encoding = 'patch'), 0) AS BIGINT) AS patch_archive,
  CAST(coalesce(sum(size) FILTER (encoding = 'patch'), 0) AS BIGINT) AS patch_original FROM blobs)""")
def inspect_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.totals(A.model_blobs(spark, sf_dir))


@query(f"""{MONTHS}, buckets(bucket_idx, bucket, low, high) AS (VALUES (0, '<1MiB', -1, 1048576), (1, '1-10MiB', 1048576, 10485760), (2, '10-100MiB', 10485760, 104857600), (3, '100MiB-1GiB', 104857600, 1073741824), (4, '>=1GiB', 1073741824, 9223372036854775807))
SELECT image, CAST(bucket_idx AS INTEGER) AS bucket_idx, bucket, count(size) FILTER (size >= low AND size < high) AS layers FROM lines, buckets GROUP BY image, bucket_idx, bucket""")
def inspect_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.histogram(A.month_layers(spark, sf_dir).withColumnRenamed("size", "target_size"))


@query(f"{ROWS} SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY saved_bytes DESC, digest, layer_idx) AS INTEGER) AS rank, digest, saved_bytes, saved_ratio FROM layer_rows WHERE saved_bytes > 0 QUALIFY rank <= 10")
def inspect_top_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.top_savings(rows_of(spark, sf_dir))


@query(f"""{ROWS}, grown AS (SELECT * REPLACE (CASE WHEN kind = 'patch' AND digest < 'sha256:8' THEN target_size + 1 ELSE archive_size END AS archive_size) FROM layer_rows)
SELECT image, layer_idx, 'patch_oversized' AS waste, digest, archive_size, target_size FROM grown WHERE kind = 'patch' AND archive_size >= target_size""")
def inspect_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of the lower half of the digests are given a byte too many, since the model makes no wasteful ones."""
    grown = F.when((F.col("kind") == "patch") & (F.col("digest") < "sha256:8"), F.col("target_size") + 1).otherwise(F.col("archive_size"))
    return inspect.waste(rows_of(spark, sf_dir).withColumn("archive_size", grown))


@query(f"""{ROWS} SELECT image, count(*) AS layer_count, count(*) FILTER (kind <> 'baseline_only') AS archive_layer_count, least(count(*) FILTER (saved_bytes > 0), 10) AS top_count,
  CAST(coalesce(max(saved_bytes) FILTER (saved_bytes > 0), 0) AS BIGINT) AS most_saved FROM layer_rows GROUP BY image""")
def inspect_image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inspect.image_details(rows_of(spark, sf_dir))
    top = F.coalesce(F.size("top_savings"), F.lit(0))
    return d.select("image", "layer_count", "archive_layer_count", F.greatest(top, F.lit(0)).cast("long").alias("top_count"), F.coalesce(F.expr("top_savings[0].saved_bytes"), F.lit(0)).cast("long").alias("most_saved"))


@query()
def inspect_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.envelope(inspect.image_details(rows_of(spark, sf_dir)))


@query()
def inspect_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.rendered(rows_of(spark, sf_dir))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, size, CASE WHEN size < 1024 THEN printf('%d B', size) WHEN size < 1048576 THEN printf('%.1f KiB', size / 1024.0::DOUBLE)
  WHEN size < 1073741824 THEN printf('%.1f MiB', size / 1048576.0::DOUBLE) ELSE printf('%.1f GiB', size / 1073741824.0::DOUBLE) END AS human
FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice * l_quantity * 256) AS BIGINT) AS size FROM lineitem)""")
def inspect_human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.floor(F.col("l_extendedprice") * F.col("l_quantity") * 256).cast("long")
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", size.alias("size")).withColumn("human", sizes.human(F.col("size")))


FAULTY = f"""{ENCODED},
faulty AS (SELECT digest, size, encoding, CASE WHEN digest < 'sha256:1' AND encoding = 'full' THEN 'zstd-patch' WHEN digest >= 'sha256:f' THEN NULL ELSE codec END AS codec,
  CASE WHEN digest >= 'sha256:e' AND digest < 'sha256:f' THEN NULL ELSE patch_from_digest END AS patch_from_digest,
  CASE WHEN digest >= 'sha256:2' AND digest < 'sha256:3' THEN archive_size + 7 WHEN digest >= 'sha256:3' AND digest < 'sha256:4' THEN 0 ELSE archive_size END AS archive_size,
  CASE WHEN digest >= 'sha256:4' AND digest < 'sha256:5' THEN 'gzip' ELSE encoding END AS enc FROM blobs),
broken AS (SELECT digest AS subject, unnest([x FOR x IN [
    CASE WHEN enc = 'full' AND (coalesce(codec, '') <> '' OR coalesce(patch_from_digest, '') <> '') THEN 'full_sets_codec' END,
    CASE WHEN enc = 'full' AND archive_size <> size THEN 'full_size' END,
    CASE WHEN enc = 'patch' AND coalesce(codec, '') = '' THEN 'patch_codec' END,
    CASE WHEN enc = 'patch' AND coalesce(patch_from_digest, '') = '' THEN 'patch_from' END,
    CASE WHEN enc = 'patch' AND (archive_size <= 0 OR archive_size >= size) THEN 'patch_size' END,
    CASE WHEN enc NOT IN ('full', 'patch') THEN 'encoding' END] IF x IS NOT NULL]) AS rule FROM faulty)"""


@query(f"{FAULTY} SELECT subject, rule FROM broken")
def sidecar_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model archive with faults put into blobs by their digests' first digit."""
    d = F.col("digest")
    within = lambda a, b: (d >= f"sha256:{a}") & (d < f"sha256:{b}")
    b = A.model_blobs(spark, sf_dir)
    faulty = b.select(
        "digest", "size", F.when(within("4", "5"), "gzip").otherwise(F.col("encoding")).alias("encoding"),
        F.when((d < "sha256:1") & (F.col("encoding") == "full"), "zstd-patch").when(d >= "sha256:f", None).otherwise(F.col("codec")).alias("codec"),
        F.when(within("e", "f"), None).otherwise(F.col("patch_from_digest")).alias("patch_from_digest"),
        F.when(within("2", "3"), F.col("archive_size") + 7).when(within("3", "4"), 0).otherwise(F.col("archive_size")).alias("archive_size"),
    )
    return sidecar.blob_violations(faulty)


@query(f"""{SIDES},
images AS (SELECT pair || CASE WHEN pair LIKE 'src1%' THEN ' x' ELSE '' END AS name, CASE WHEN pair LIKE 'src2%' THEN NULL ELSE 'sha256:' || sha256(pair) END AS target_manifest_digest, CASE WHEN pair LIKE 'src3%' THEN '' ELSE baseline_image END AS baseline_manifest_digest FROM pairs),
twice AS (SELECT * FROM images UNION ALL SELECT * FROM images WHERE name LIKE 'src4%'), held AS (SELECT target_manifest_digest AS digest FROM images WHERE name NOT LIKE 'src5%')
SELECT name AS subject, 'name_pattern' AS rule FROM twice WHERE NOT regexp_matches(name, '^[a-zA-Z0-9][a-zA-Z0-9_.-]*$')
UNION ALL SELECT name, 'target_digest_required' FROM twice WHERE coalesce(target_manifest_digest, '') = ''
UNION ALL SELECT name, 'baseline_digest_required' FROM twice WHERE coalesce(baseline_manifest_digest, '') = ''
UNION ALL SELECT name, 'name_unique' FROM twice GROUP BY name HAVING count(*) > 1
UNION ALL SELECT name, 'target_in_blobs' FROM twice WHERE coalesce(target_manifest_digest, '') <> '' AND target_manifest_digest NOT IN (SELECT digest FROM held WHERE digest IS NOT NULL)""")
def sidecar_image_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the pairs with faults put in by name."""
    p = F.col("pair")
    images = A.pairs(spark).select(
        F.concat(p, F.when(p.like("src1%"), " x").otherwise("")).alias("name"),
        F.when(p.like("src2%"), None).otherwise(digests.digest(p)).alias("target_manifest_digest"),
        F.when(p.like("src3%"), "").otherwise(F.col("baseline_image")).alias("baseline_manifest_digest"),
    )
    held = images.where(~F.col("name").like("src5%")).select(F.col("target_manifest_digest").alias("digest"))
    return sidecar.image_violations(images.unionByName(images.where(F.col("name").like("src4%"))), held)


@query("SELECT event_id, [x FOR x IN list_sort(['extra_' || event_type] || CASE WHEN event_type = 'click' THEN ['also'] ELSE [] END)] AS unknown FROM events")
def sidecar_unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made of events: known fields, one named after the event's type, and another on clicks."""
    e = A.table(spark, sf_dir, "events")
    fields = F.map_concat(
        F.create_map(F.lit("version"), F.lit("v1"), F.lit("tool"), F.lit("t"), F.concat(F.lit("extra_"), "event_type"), F.col("props")),
        F.when(F.col("event_type") == "click", F.create_map(F.lit("also"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    return e.select("event_id", sidecar.unknown_fields(F.to_json(fields)).alias("unknown"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'legacy' WHEN 'click' THEN 'unknown_version' WHEN 'error' THEN 'invalid' ELSE 'ok' END AS route FROM events")
def sidecar_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made of events: broken, of another feature, or of another version, by type."""
    t = F.col("event_type")
    doc = F.to_json(F.struct(F.when(t == "click", "v2").otherwise("v1").alias("version"), F.when(t == "view", "single").otherwise("bundle").alias("feature"), F.col("props").alias("tool")))
    doc = F.when(t == "error", F.concat(F.lit("not json "), doc)).otherwise(doc)
    return A.table(spark, sf_dir, "events").select("event_id", sidecar.route(doc).alias("route"))


@query(f"{ENCODED} SELECT pair, count(*) AS shipped_blobs, CAST(sum(b.archive_size) AS BIGINT) AS archive_size FROM shipped s JOIN blobs b USING (digest) GROUP BY pair")
def dry_run_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.export_dry_run(A.shipped(spark, sf_dir), A.model_blobs(spark, sf_dir))


@query(f"""{ROWS} SELECT image, count(*) AS layer_count, count(*) FILTER (kind <> 'baseline_only') AS archive_layers, count(*) FILTER (kind = 'patch') AS patch_layers, count(*) FILTER (kind = 'baseline_only') AS baseline_layers,
  image NOT LIKE 'src1%' AS would_import, CASE WHEN image LIKE 'src1%' THEN 'no baseline provided' END AS skip_reason FROM layer_rows GROUP BY image""")
def dry_run_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines are given for all pairs but those named src1..."""
    provided = A.pairs(spark).where(~F.col("pair").like("src1%")).select(F.col("pair").alias("image"))
    return apply.import_dry_run(A.target_layers(spark, sf_dir), A.model_blobs(spark, sf_dir), provided)


NEEDS = f"""{ROWS},
needs AS (SELECT DISTINCT image, 'reuse' AS need, digest FROM layer_rows WHERE kind = 'baseline_only'
  UNION SELECT DISTINCT image, 'patch_source', patch_from FROM layer_rows WHERE kind = 'patch' AND coalesce(patch_from, '') <> '')"""


@query(f"{NEEDS} SELECT * FROM needs")
def preflight_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.required(A.target_layers(spark, sf_dir), A.model_blobs(spark, sf_dir))


STATUS = f"""{NEEDS},
lack AS (SELECT n.* FROM needs n LEFT JOIN (SELECT DISTINCT pair AS image, digest FROM baseline WHERE media_type <> 'de') h USING (image, digest) WHERE h.digest IS NULL),
by_image AS (SELECT image, coalesce(list(digest ORDER BY digest) FILTER (need = 'patch_source'), []) AS p, coalesce(list(digest ORDER BY digest) FILTER (need = 'reuse'), []) AS r FROM lack GROUP BY image),
status AS (SELECT pair AS image, CASE WHEN pair LIKE 'src1%' THEN 'error' WHEN len(p) > 0 THEN 'missing_patch_source' WHEN len(r) > 0 THEN 'missing_reuse_layer' ELSE 'ok' END AS status,
  CASE WHEN pair LIKE 'src1%' THEN [] ELSE coalesce(p, []) END AS missing_patch_sources, CASE WHEN pair LIKE 'src1%' THEN [] ELSE coalesce(r, []) END AS missing_reuse_layers
  FROM pairs LEFT JOIN by_image ON image = pair)"""


def status_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preflight against baselines that have lost their layers of type de; pairs named src1... have none."""
    every = A.written(A.layers(spark, sf_dir), "layers")
    needs = apply.required(A.target_layers(spark, sf_dir, every), A.model_blobs(spark, sf_dir, every))
    have = A.side(spark, sf_dir, "baseline", every).where("media_type <> 'de'").select(F.col("pair").alias("image"), "digest")
    images = A.pairs(spark).select(F.col("pair").alias("image"))
    return apply.preflight(images, needs, have, images.where(~F.col("image").like("src1%")))


@query(f"{STATUS} SELECT image, status, array_to_string(missing_patch_sources, ',') AS missing_patch_sources, array_to_string(missing_reuse_layers, ',') AS missing_reuse_layers FROM status")
def preflight_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = status_of(spark, sf_dir)
    return s.select("image", "status", F.array_join("missing_patch_sources", ",").alias("missing_patch_sources"), F.array_join("missing_reuse_layers", ",").alias("missing_reuse_layers"))


@query(f"""{ENCODED},
expected AS (SELECT pair AS image, digest, size FROM target),
actual AS (SELECT pair AS image, digest, CASE WHEN digest < 'sha256:08' THEN size + 1 ELSE size END AS size FROM target WHERE NOT (pair LIKE 'src2-%' AND media_type = 'fr')
  UNION ALL SELECT 'src4-src5', 'sha256:unexpected', 1),
e AS (SELECT DISTINCT image, digest FROM expected), a AS (SELECT DISTINCT image, digest FROM actual),
m AS (SELECT image, count(*) AS missing FROM e ANTI JOIN a USING (image, digest) GROUP BY image), u AS (SELECT image, count(*) AS unexpected FROM a ANTI JOIN e USING (image, digest) GROUP BY image),
w AS (SELECT image, count(*) AS size_mismatches FROM (SELECT DISTINCT x.image, x.digest, CASE WHEN b.size > 0 THEN b.size ELSE x.size END AS want FROM expected x LEFT JOIN blobs b USING (digest)) JOIN (SELECT image, digest, max(size) AS got FROM actual GROUP BY ALL) USING (image, digest) WHERE want <> got GROUP BY image)
SELECT pair AS image, coalesce(missing, 0) AS missing, coalesce(unexpected, 0) AS unexpected, coalesce(size_mismatches, 0) AS size_mismatches,
  CASE WHEN coalesce(missing, 0) + coalesce(unexpected, 0) > 0 THEN 'layer set mismatch' WHEN coalesce(size_mismatches, 0) > 0 THEN 'layer size mismatch' END AS reason
FROM pairs LEFT JOIN m ON m.image = pair LEFT JOIN u ON u.image = pair LEFT JOIN w ON w.image = pair""")
def invariant_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuilt images with faults: one lost its fr layers, one has a layer too many, some sizes are off by one."""
    every = A.written(A.layers(spark, sf_dir), "layers")
    expected = A.target_layers(spark, sf_dir, every)
    size = F.when(F.col("digest") < "sha256:08", F.col("size") + 1).otherwise(F.col("size"))
    actual = expected.where(~(F.col("image").like("src2-%") & (F.col("media_type") == "fr"))).select("image", "digest", size.alias("size"))
    actual = actual.unionByName(spark.range(1).select(F.lit("src4-src5").alias("image"), F.lit("sha256:unexpected").alias("digest"), F.lit(1).cast("long").alias("size")))
    images = A.pairs(spark).select(F.col("pair").alias("image"))
    return apply.invariant(images, expected, actual, A.model_blobs(spark, sf_dir, every))


@query(f"""{SIDES},
given AS (SELECT CASE WHEN pair LIKE 'src2%' THEN 'other-' || pair ELSE pair END AS name, CASE WHEN pair LIKE 'src3%' THEN 'sha256:other' ELSE 'sha256:' || sha256(baseline_image) END AS got FROM pairs WHERE pair NOT LIKE 'src1%')
SELECT coalesce(pair, name) AS name, CASE WHEN pair IS NULL THEN 'unknown_name' WHEN name IS NULL THEN 'missing' WHEN got <> 'sha256:' || sha256(baseline_image) THEN 'mismatch' ELSE 'ok' END AS status FROM pairs FULL JOIN given ON pair = name""")
def baseline_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given baselines with some missing, misnamed or of another digest."""
    p = A.pairs(spark)
    images = p.select(F.col("pair").alias("image"), digests.digest(F.col("baseline_image")).alias("expected_digest"))
    name = F.when(F.col("pair").like("src2%"), F.concat(F.lit("other-"), "pair")).otherwise(F.col("pair"))
    got = F.when(F.col("pair").like("src3%"), "sha256:other").otherwise(digests.digest(F.col("baseline_image")))
    return apply.resolve_baselines(images, p.where(~F.col("pair").like("src1%")).select(name.alias("name"), got.alias("actual_digest")))


@query(f"""{STATUS},
results AS (SELECT image, CAST(split_part(substr(image, 4), '-', 1) AS INTEGER) AS position, CASE WHEN status <> 'ok' THEN 'skipped_preflight' WHEN image LIKE 'src4%' THEN 'failed_invariant' ELSE 'ok' END AS status FROM status)
SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS successful, count(*) FILTER (status LIKE 'failed%') AS failed, count(*) FILTER (status = 'skipped_preflight') AS skipped,
  arg_min(image, position) FILTER (status <> 'ok') AS first_failed, count(*) > 0 AND count(*) FILTER (status = 'ok') = 0 AS run_failed FROM results""")
def apply_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in the order of their sources; what preflight refuses is skipped, one fails its check."""
    s = status_of(spark, sf_dir)
    position = F.split_part(F.substring("image", 4, 20), F.lit("-"), F.lit(1)).cast("int")
    status = F.when(F.col("status") != "ok", "skipped_preflight").when(F.col("image").like("src4%"), "failed_invariant").otherwise("ok")
    return apply.apply_report(s.select("image", position.alias("position"), status.alias("status")))


REF_FORMS = ["docker://example.org/", "oci:/srv/", "dir:/srv/images/", "docker-archive:/tmp/a/", "oci-archive:", "docker-daemon:", "sif:", "ftp:", "", "oci:"]
REF_SQL = "WITH r AS (SELECT s_suppkey, ([" + ", ".join(f"'{x}'" for x in REF_FORMS) + "])[CAST(s_suppkey % 10 AS INTEGER) + 1] AS form, s_name FROM supplier), refs AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 9 THEN form ELSE form || s_name END AS ref FROM r)"


def supplier_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of ten forms, good and bad, in turn over the suppliers."""
    form = F.element_at(F.array(*[F.lit(x) for x in REF_FORMS]), (F.col("s_suppkey") % 10 + 1).cast("int"))
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 10 == 9, form).otherwise(F.concat(form, "s_name")).alias("ref"))


SPLIT_SQL = "CASE WHEN instr(ref, ':') > 1 THEN split_part(ref, ':', 1) ELSE '' END AS transport, CASE WHEN instr(ref, ':') > 1 THEN substr(ref, instr(ref, ':') + 1) ELSE '' END AS path"


@query(f"""{REF_SQL}, p AS (SELECT s_suppkey, ref, {SPLIT_SQL} FROM refs)
SELECT s_suppkey, ref, transport, path, CASE WHEN transport = '' THEN 'missing_transport' WHEN transport IN ('docker-daemon', 'containers-storage', 'ostree', 'sif', 'tarball') THEN 'reserved_transport'
  WHEN transport NOT IN ('docker-archive', 'oci-archive', 'docker', 'oci', 'dir') THEN 'unsupported_transport' WHEN path = '' THEN 'empty_path' ELSE 'ok' END AS status FROM p""")
def transport_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.col("ref")
    return supplier_refs(spark, sf_dir).select("s_suppkey", "ref", refs.transport(ref).alias("transport"), refs.path(ref).alias("path"), refs.ref_status(ref).alias("status"))


@query("""SELECT page_id, ref, CASE WHEN ref LIKE 'docker://%' THEN substr(ref, 10) WHEN regexp_extract(rtrim(substr(ref, 5), '/'), '[^/]*$') = '' THEN '/' ELSE regexp_extract(rtrim(substr(ref, 5), '/'), '[^/]*$') END AS hint
FROM (SELECT page_id, CASE WHEN url LIKE 'https:%' THEN 'docker:' || substr(url, 7) ELSE 'dir:' || substr(url, 6) END AS ref FROM pages)""")
def source_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages read as registry references (https) or folders (http)."""
    ref = F.when(F.col("url").startswith("https:"), F.concat(F.lit("docker:"), F.substring("url", 7, 10**6))).otherwise(F.concat(F.lit("dir:"), F.substring("url", 6, 10**6)))
    return A.table(spark, sf_dir, "pages").select("page_id", ref.alias("ref")).withColumn("hint", refs.source_hint(F.col("ref")))


@query(f"""SELECT s_suppkey, c_transport, c_type, allow, allow OR c_type = '' OR CASE c_transport WHEN 'docker-archive' THEN c_type = '{refs.DOCKER_V2}' WHEN 'oci' THEN c_type = '{refs.OCI_V1}' WHEN 'oci-archive' THEN c_type = '{refs.OCI_V1}' ELSE true END AS compatible
FROM (SELECT s_suppkey, (['docker-archive', 'oci-archive', 'oci', 'dir', 'docker'])[CAST(s_suppkey % 5 AS INTEGER) + 1] AS c_transport, (['{refs.DOCKER_V2}', '{refs.OCI_V1}', ''])[CAST(s_nationkey % 3 AS INTEGER) + 1] AS c_type, s_acctbal < 0 AS allow FROM supplier)""")
def output_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations and media types in turn over the suppliers; conversion allowed to those in debt."""
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(by) % len(values) + 1).cast("int"))
    s = A.table(spark, sf_dir, "supplier").select(
        "s_suppkey", pick(["docker-archive", "oci-archive", "oci", "dir", "docker"], "s_suppkey").alias("c_transport"), pick([refs.DOCKER_V2, refs.OCI_V1, ""], "s_nationkey").alias("c_type"), (F.col("s_acctbal") < 0).alias("allow")
    )
    return s.withColumn("compatible", refs.output_compat(F.col("c_transport"), F.col("c_type"), F.col("allow")))


MESSAGES = ["Unauthorized: manifest not found", "manifest unknown", "unsupported media type x", "503 Service Unavailable", "dial tcp: connection refused", "unknown flag: --x", "unexpected EOF", "something else"]


def _has(column: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


@query(f"""WITH m AS (SELECT event_id, ([{", ".join(f"'{x}'" for x in MESSAGES)}])[CAST(event_id % 8 AS INTEGER) + 1] AS message, event_id % 8 = 4 AS network FROM events), l AS (SELECT *, lower(message) AS low FROM m)
SELECT event_id, message, CASE WHEN {_has('low', errors.AUTH)} THEN 'auth' WHEN {_has('low', errors.MISSING)} THEN 'missing' WHEN {_has('low', errors.INVALID)} THEN 'invalid' WHEN network THEN 'network' ELSE 'other' END AS class,
  {_has('low', errors.RETRYABLE)} OR network AS retryable, CASE WHEN network THEN 'environment' WHEN {_has('message', errors.USAGE)} THEN 'user' ELSE 'internal' END AS category,
  CAST(CASE WHEN network THEN 3 WHEN {_has('message', errors.USAGE)} THEN 2 ELSE 1 END AS INTEGER) AS exit_code FROM l""")
def error_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of eight kinds in turn over the events; one kind comes from the network."""
    m = A.table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in MESSAGES]), (F.col("event_id") % 8 + 1).cast("int")).alias("message"), (F.col("event_id") % 8 == 4).alias("network"))
    cat = errors.category(F.lit(None).cast("string"), F.col("message"), F.col("network"), F.lit(False))
    return m.select("event_id", "message", errors.registry_class(F.col("message"), F.col("network")).alias("class"), errors.retryable(F.col("message"), F.col("network")).alias("retryable"), cat.alias("category"), errors.exit_code(cat).alias("exit_code"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS expected, lang <> 'es' AS verified FROM documents")
def digest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of language es have a letter too many and must not pass."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", digests.digest(F.col("text")).alias("expected"), F.when(F.col("lang") == "es", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return d.select("doc_id", "expected", digests.verified(F.col("content"), F.col("expected")).alias("verified"))


@query(f"""{REF_SQL}, p AS (SELECT s_suppkey, ref, {SPLIT_SQL} FROM refs), q AS (SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'twice' WHEN s_suppkey % 7 = 1 THEN '-' || s_suppkey ELSE 'n' || s_suppkey END AS name,
  transport IN ('docker-archive', 'oci-archive', 'docker', 'oci', 'dir') AND path <> '' AS good FROM p)
SELECT name AS subject, 'name_pattern' AS rule FROM q WHERE name LIKE '-%' UNION ALL SELECT name, 'target_ref' FROM q WHERE NOT good UNION ALL SELECT name, 'name_unique' FROM q GROUP BY name HAVING count(*) > 1""")
def pair_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs made of suppliers, some named alike or badly, with references of all forms."""
    k = F.col("s_suppkey")
    name = F.when(k % 7 == 0, "twice").when(k % 7 == 1, F.concat(F.lit("-"), k)).otherwise(F.concat(F.lit("n"), k))
    return sidecar.pair_violations(supplier_refs(spark, sf_dir).select(name.alias("name"), F.lit("dir:/base").alias("baseline_ref"), F.col("ref").alias("target_ref")))


@query(f"{ENCODED} SELECT digest, size, media_type, encoding, codec, patch_from_digest, archive_size FROM blobs")
def sidecar_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model archive's sidecar as one document, parsed again."""
    images = A.pairs(spark).select(
        F.split_part(F.substring("pair", 4, 20), F.lit("-"), F.lit(1)).cast("int").alias("position"), F.col("pair").alias("name"),
        digests.digest(F.col("baseline_image")).alias("baseline_manifest_digest"), F.lit(refs.OCI_V1).alias("baseline_media_type"), F.lit(None).cast("string").alias("source_hint"),
        digests.digest(F.col("target_image")).alias("target_manifest_digest"), F.lit(1).cast("long").alias("target_manifest_size"), F.lit(refs.OCI_V1).alias("target_media_type"),
    )
    doc = sidecar.assemble(images, A.model_blobs(spark, sf_dir), "linux/amd64", "stratalens", "1", "2024-01-01T00:00:00Z")
    return sidecar.flatten_blobs(doc.select(sidecar.parse(F.col("json")).alias("sidecar"))).select("digest", "size", "media_type", "encoding", "codec", "patch_from_digest", "archive_size")
