"""An archive's sidecar: parsing, validation, unknown fields, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refs

BLOB = "struct<size:bigint,media_type:string,encoding:string,codec:string,patch_from_digest:string,archive_size:bigint>"
SIDECAR = (
    "version string, feature string, tool string, tool_version string, created_at timestamp, platform string, "
    f"blobs map<string,{BLOB}>, images array<struct<name:string,"
    "baseline:struct<manifest_digest:string,media_type:string,source_hint:string>,"
    "target:struct<manifest_digest:string,manifest_size:bigint,media_type:string>>>"
)
#: Fields that a sidecar has at its top.
FIELDS = ["version", "feature", "tool", "tool_version", "created_at", "platform", "blobs", "images"]


def parse(json: Column) -> Column:
    """The sidecar struct; null where the text is no JSON object of that form. Unknown fields are ignored."""
    return F.from_json(json, SIDECAR, {"mode": "PERMISSIVE"})


def route(json: Column) -> Column:
    """invalid, legacy (another feature), unknown_version or ok, tested in this order."""
    feature, version = F.get_json_object(json, "$.feature"), F.get_json_object(json, "$.version")
    is_object = F.json_object_keys(json).isNotNull()
    return F.when(~F.coalesce(is_object, F.lit(False)), "invalid").when(F.coalesce(feature, F.lit("")) != "bundle", "legacy").when(F.coalesce(version, F.lit("")) != "v1", "unknown_version").otherwise("ok")


def unknown_fields(json: Column) -> Column:
    """Names at the top that a sidecar does not have, sorted; all of them."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in FIELDS])))


def flatten_blobs(sidecars: DataFrame, column: str = "sidecar") -> DataFrame:
    return sidecars.select(F.explode(f"{column}.blobs").alias("digest", "b")).select("digest", "b.*")


def flatten_images(sidecars: DataFrame, column: str = "sidecar") -> DataFrame:
    img = F.posexplode(f"{column}.images").alias("position", "i")
    return sidecars.select(img).select(
        "position", F.col("i.name").alias("name"),
        F.col("i.baseline.manifest_digest").alias("baseline_manifest_digest"), F.col("i.baseline.media_type").alias("baseline_media_type"), F.col("i.baseline.source_hint").alias("source_hint"),
        F.col("i.target.manifest_digest").alias("target_manifest_digest"), F.col("i.target.manifest_size").alias("target_manifest_size"), F.col("i.target.media_type").alias("target_media_type"),
    )


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def blob_violations(blobs: DataFrame) -> DataFrame:
    """(subject, rule) of every rule a blob breaks, not only the first."""
    full, patch = F.col("encoding") == "full", F.col("encoding") == "patch"
    rules = {
        "full_sets_codec": full & ~(_empty("codec") & _empty("patch_from_digest")),
        "full_size": full & (F.col("archive_size") != F.col("size")),
        "patch_codec": patch & _empty("codec"),
        "patch_from": patch & _empty("patch_from_digest"),
        "patch_size": patch & ((F.col("archive_size") <= 0) | (F.col("archive_size") >= F.col("size"))),
        "encoding": ~(full | patch) | F.col("encoding").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return blobs.select(F.col("digest").alias("subject"), F.explode(broken).alias("rule"))


def image_violations(images: DataFrame, blobs: DataFrame) -> DataFrame:
    """(subject, rule) over images: names, uniqueness, digests, and targets that the blobs lack."""
    rules = {"name_pattern": ~refs.valid_name(F.col("name")), "target_digest_required": _empty("target_manifest_digest"), "baseline_digest_required": _empty("baseline_manifest_digest")}
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    own = images.select(F.col("name").alias("subject"), F.explode(broken).alias("rule"))
    twice = images.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select(F.col("name").alias("subject"), F.lit("name_unique").alias("rule"))
    lost = images.where(~_empty("target_manifest_digest")).join(blobs.select(F.col("digest").alias("target_manifest_digest")), "target_manifest_digest", "left_anti")
    return own.unionByName(twice).unionByName(lost.select(F.col("name").alias("subject"), F.lit("target_in_blobs").alias("rule")))


def head_violations(sidecars: DataFrame, column: str = "sidecar") -> DataFrame:
    """(subject, rule) of what the sidecar itself lacks."""
    s = F.col(column)
    rules = {"platform_required": F.coalesce(s["platform"], F.lit("")) == "", "blobs_required": s["blobs"].isNull(), "images_required": F.coalesce(F.size(s["images"]), F.lit(0)) <= 0}
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return sidecars.select(F.lit("sidecar").alias("subject"), F.explode(broken).alias("rule"))


def violations(sidecars: DataFrame, column: str = "sidecar") -> DataFrame:
    blobs, images = flatten_blobs(sidecars, column), flatten_images(sidecars, column)
    return head_violations(sidecars, column).unionByName(image_violations(images, blobs)).unionByName(blob_violations(blobs))


def pair_violations(pairs: DataFrame) -> DataFrame:
    """(subject, rule) over pairs (name, baseline_ref, target_ref): names and references."""
    rules = {
        "name_pattern": ~refs.valid_name(F.col("name")),
        "baseline_ref": refs.ref_status(F.col("baseline_ref")) != "ok",
        "target_ref": refs.ref_status(F.col("target_ref")) != "ok",
    }
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    twice = pairs.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select(F.col("name").alias("subject"), F.lit("name_unique").alias("rule"))
    return pairs.select(F.col("name").alias("subject"), F.explode(broken).alias("rule")).unionByName(twice)


def seed_blobs(images: DataFrame, layers: DataFrame) -> DataFrame:
    """Manifests and configs, which always ship in full, beside the encoded layers; one row per digest."""
    whole = images.select(F.explode(F.array(
        F.struct(F.col("target_manifest_digest").alias("digest"), F.col("target_manifest_size").alias("size"), F.col("target_media_type").alias("media_type")),
        F.struct(F.col("config_digest").alias("digest"), F.col("config_size").alias("size"), F.col("config_media_type").alias("media_type")),
    )).alias("b")).select("b.*")
    whole = whole.select("digest", "size", "media_type", F.lit("full").alias("encoding"), F.lit(None).cast("string").alias("codec"), F.lit(None).cast("string").alias("patch_from_digest"), F.col("size").alias("archive_size"))
    both = whole.withColumn("_o", F.lit(0)).unionByName(layers.select("digest", "size", "media_type", "encoding", "codec", "patch_from_digest", "archive_size").withColumn("_o", F.lit(1)))
    first = both.groupBy("digest").agg(F.min(F.struct("_o", "size", "media_type", "encoding", "codec", "patch_from_digest", "archive_size")).alias("e"))
    return first.select("digest", "e.size", "e.media_type", "e.encoding", "e.codec", "e.patch_from_digest", "e.archive_size")


def assemble(images: DataFrame, blobs: DataFrame, platform: str, tool: str, tool_version: str, created_at: str) -> DataFrame:
    """One row ``json``: the sidecar document, blobs by digest, images by position, nulls left out.

    One document is what the format asks for: metadata of the blobs of one archive.
    """
    b = F.struct("digest", F.struct("size", "media_type", "encoding", "codec", "patch_from_digest", "archive_size").alias("e"))
    packed = blobs.agg(F.map_from_entries(F.sort_array(F.collect_list(b))).alias("blobs"))
    i = F.struct(
        "position", F.col("name"),
        F.struct(F.col("baseline_manifest_digest").alias("manifest_digest"), F.col("baseline_media_type").alias("media_type"), F.col("source_hint")).alias("baseline"),
        F.struct(F.col("target_manifest_digest").alias("manifest_digest"), F.col("target_manifest_size").alias("manifest_size"), F.col("target_media_type").alias("media_type")).alias("target"),
    )
    listed = images.agg(F.transform(F.sort_array(F.collect_list(i)), lambda x: F.struct(x["name"].alias("name"), x["baseline"].alias("baseline"), x["target"].alias("target"))).alias("images"))
    head = [F.lit("v1").alias("version"), F.lit("bundle").alias("feature"), F.lit(tool).alias("tool"), F.lit(tool_version).alias("tool_version"), F.lit(created_at).alias("created_at"), F.lit(platform).alias("platform")]
    return packed.crossJoin(listed).select(F.to_json(F.struct(*head, "blobs", "images")).alias("json"))  # one row on each side
