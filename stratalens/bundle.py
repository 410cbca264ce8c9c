"""The producer and the consumer from end to end: images to an archive, and back.

Plans, joins and rankings are DataFrames; bytes stay in the executors until the
archive or image is written, which is one sequential file or folder.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tarfile
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions import codec, digests, refs
from .functions.errors import ContentError, EnvironmentFault, StratalensError, UserError
from .operators import apply, inspect, plan, sidecar
from .sources import archives, images, tarfiles
from .storage import written

IMAGES = (
    "position int, name string, baseline_manifest_digest string, baseline_media_type string, source_hint string, target_manifest_digest string, target_manifest_size long, target_media_type string, "
    "config_digest string, config_size long, config_media_type string"
)


@dataclass(frozen=True)
class Pair:
    """A named target with its baseline."""

    name: str
    baseline: str
    target: str


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def read_pairs(path: str) -> list[Pair]:
    """Pairs of a JSON file {pairs: [{name, baseline, target}]}; relative paths are below the file's folder."""
    with open(path, encoding="utf-8") as f:
        rows = json.load(f).get("pairs") or []

    def below(ref: str) -> str:
        transport, place = images.split_ref(ref)
        return ref if transport == "docker" or os.path.isabs(place) else f"{transport}:{os.path.join(os.path.dirname(os.path.abspath(path)), place)}"

    return [Pair(r["name"], below(r["baseline"]), below(r["target"])) for r in rows]


def check_pairs(spark: SparkSession, pairs: list[Pair]) -> None:
    if not pairs:
        raise UserError("name at least one pair")
    df = spark.createDataFrame([(p.name, p.baseline, p.target) for p in pairs], "name string, baseline_ref string, target_ref string")
    if bad := sidecar.pair_violations(df).collect():
        raise UserError("; ".join(sorted(f"{r.subject}: {r.rule}" for r in bad)))


def _load(spark: SparkSession, which: list[str], platform: str, digests_: list[str] | None = None, content: bool = True) -> DataFrame:
    archives.register(spark)
    reader = spark.read.format("layers").option("platform", platform).option("content", str(content).lower())
    if digests_ is not None:
        reader = reader.option("digests", ",".join(digests_))
    return reader.load("\n".join(sorted(set(which))))


def _encode(spark: SparkSession, pairs: list[Pair], settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, bytes]]:
    """Shipped layers with their encoding, contents by digest, images, and the small blobs (manifests, configs).

    The plan reads manifests alone; layers are read for fingerprints, trials and the
    archive. Encodings are written once, so that no trial runs twice. A layer whose
    window needs more than the memory budget is an error before any is read.
    """
    check_pairs(spark, pairs)
    mode = codec.resolve_mode(settings.intra_layer)
    rows, small = [], {}
    for i, p in enumerate(pairs):
        base, target = images.open_image(p.baseline, settings.platform), images.open_image(p.target, settings.platform)
        config = target.folder.need(target.blob(target.manifest["config"]["digest"]))
        small[_digest(target.raw)] = target.raw
        small[target.manifest["config"]["digest"]] = config
        rows.append((i, p.name, _digest(base.raw), base.manifest["mediaType"], p.baseline, _digest(target.raw), len(target.raw), target.manifest["mediaType"], target.manifest["config"]["digest"], len(config), target.manifest["config"].get("mediaType")))
    listed = spark.createDataFrame(rows, IMAGES).withColumn("source_hint", refs.source_hint(F.col("source_hint")))
    sources = [r for p in pairs for r in (p.baseline, p.target)]
    every = _load(spark, sources, settings.platform, content=False)
    named = spark.createDataFrame([(p.name, p.baseline, p.target) for p in pairs], "pair string, baseline string, target string")
    side = lambda which: every.drop("content").join(named.select("pair", F.col(which).alias("image")), "image").select("pair", "layer_idx", "digest", "size", "media_type")
    target, base = side("target"), side("baseline")
    shipped = plan.compute_plan(target, base).where("part = 'shipped'").drop("part")
    if over := plan.over_budget(shipped, settings.budget_bytes(), settings.window_log).first():
        raise UserError(f"layer {over.digest} of {over.pair} needs {over.est_rss} bytes, the memory budget is {settings.budget_bytes()}")
    uses = plan.ship_refs(shipped)
    contents = _load(spark, sources, settings.platform).select("digest", "content").dropDuplicates(["digest"])  # equal digests, equal bytes
    if mode == "off":
        trials = spark.createDataFrame([], "pair string, target_digest string, candidate_digest string, rank int, cost long, ceiling long")
    else:
        single = shipped.join(uses.where("ship_refs = 1").select("digest"), "digest", "left_semi")
        files = tarfiles.fingerprint(contents).where("file_digest is not null").select("layer_digest", "file_digest", "size")
        tops = plan.pick_top_k(single, base, plan.similarity_scores(single, base, files), settings.candidates)
        trials = codec.trial_sizes(tops.select("pair", "target_digest", "candidate_digest", "target_size", "rank"), contents, settings.level, settings.window_log)
    return written(plan.choose_best(shipped, uses, trials), "encodings"), contents, listed, small


def _pool(chosen: DataFrame) -> DataFrame:
    """One encoding per digest: of several, the first by (pair, layer_idx)."""
    names = [c for c in chosen.columns if c not in ("pair", "layer_idx", "digest")]
    first = F.min(F.struct("pair", "layer_idx", *names)).alias("e")
    return chosen.groupBy("digest").agg(first).select(*(F.col("digest") if c == "digest" else F.col(f"e.{c}") for c in chosen.columns))


def dry_run(spark: SparkSession, pairs: list[Pair], settings: Settings | None = None) -> DataFrame:
    """Per pair: shipped layers and archive bytes, from the same choices as :func:`diff`."""
    chosen, _, _, _ = _encode(spark, pairs, settings or Settings())
    return plan.export_dry_run(chosen, _pool(chosen))


def diff(spark: SparkSession, pairs: list[Pair], output: str, settings: Settings | None = None, created_at: str = "1970-01-01T00:00:00Z") -> str:
    """Write the archive that, with the baselines, holds all targets; returns its path."""
    settings = settings or Settings()
    chosen, contents, listed, small = _encode(spark, pairs, settings)
    chosen = _pool(chosen)
    blobs = sidecar.seed_blobs(listed, chosen)
    doc = sidecar.assemble(listed, blobs, settings.platform, "stratalens", "1", created_at).first().json
    patches = chosen.where("encoding = 'patch'").select("pair", F.col("digest").alias("target_digest"), F.col("patch_from_digest").alias("candidate_digest"))
    packed = written(codec.encode_patches(patches, contents, settings.level, settings.window_log).select(F.col("target_digest").alias("digest"), F.col("patch").alias("content")), "patches")
    if odd := packed.join(chosen.select("digest", "archive_size"), "digest").where(F.octet_length("content") != F.col("archive_size")).select("digest").first():
        raise ContentError(f"the patch of {odd.digest} has another size than its trial")
    whole = contents.join(chosen.where("encoding = 'full'").select("digest"), "digest", "left_semi")
    own = spark.createDataFrame(list(small.items()), "digest string, content binary")
    archives.write_archive(output, doc, whole.unionByName(packed).unionByName(own))
    return output


@dataclass
class Archive:
    """An archive's sidecar as frames, and its manifests."""

    path: str
    head: dict
    blobs: DataFrame
    images: DataFrame
    layers: DataFrame
    manifests: dict[str, bytes]


def open_archive(spark: SparkSession, path: str) -> Archive:
    """Read and check the sidecar and the manifests of an archive, and nothing else of it."""
    raw = dict(archives.read_members(path, {archives.SIDECAR_NAME}))[archives.SIDECAR_NAME].decode()
    one = spark.createDataFrame([(raw,)], "json string")
    how = one.select(sidecar.route(F.col("json")).alias("r")).first().r
    if how != "ok":
        raise ContentError({"invalid": "the sidecar is no JSON", "legacy": "an archive of the older single-image kind", "unknown_version": "an archive of another version"}[how])
    parsed = one.select(sidecar.parse(F.col("json")).alias("sidecar"))
    if bad := sidecar.violations(parsed).collect():
        raise ContentError("; ".join(sorted(f"{r.subject}: {r.rule}" for r in bad)))
    listed = sidecar.flatten_images(parsed)
    names = {r.name: r for r in listed.collect()}
    files = dict(archives.read_members(path, {images.blob_path(r.target_manifest_digest) for r in names.values()}))
    manifests, rows = {}, []
    for name, r in names.items():
        manifests[name] = files[images.blob_path(r.target_manifest_digest)]
        m = images.parse_manifest(manifests[name], r.target_media_type or "")
        rows += [(name, i, x["digest"], int(x["size"])) for i, x in enumerate(m["layers"])]
    return Archive(path, json.loads(raw), sidecar.flatten_blobs(parsed), listed, spark.createDataFrame(rows, "image string, layer_idx int, digest string, size long"), manifests)


def inspect_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Totals (one row) and details (one row an image)."""
    a = open_archive(spark, path)
    return inspect.totals(a.blobs), inspect.image_details(inspect.layer_rows(a.layers, a.blobs))


def _resolve(spark: SparkSession, a: Archive, baselines: dict[str, str], strict: bool) -> tuple[dict[str, str], dict[str, images.Image]]:
    """References and opened images by name; mismatches, unknown names and, if strict, missing ones are errors."""
    only = a.images.first().name if a.images.count() == 1 else None
    given = {only if k == "default" and only else k: v for k, v in baselines.items()}
    opened = {k: images.open_image(v) for k, v in given.items()}
    want = a.images.select(F.col("name").alias("image"), F.col("baseline_manifest_digest").alias("expected_digest"))
    got = spark.createDataFrame([(k, _digest(v.raw)) for k, v in opened.items()], "name string, actual_digest string")
    found = apply.resolve_baselines(want, got).where(apply.is_fatal(F.col("status"), strict)).collect()
    if found:
        raise ContentError("; ".join(sorted(f"{r.name}: {r.status}" for r in found)))
    return given, opened


def preflight(spark: SparkSession, a: Archive, opened: dict[str, images.Image]) -> DataFrame:
    """Whether each image's baseline holds what the archive leaves out."""
    have = [(k, d) for k, v in opened.items() for d in [*(x["digest"] for x in v.manifest["layers"]), v.manifest["config"]["digest"]]]
    names = a.images.select(F.col("name").alias("image"))
    return apply.preflight(names, apply.required(a.layers, a.blobs), spark.createDataFrame(have, "image string, digest string"), names.where(F.col("image").isin(list(opened))))


def rebuild(layers: DataFrame, blobs: DataFrame, stored: DataFrame, baseline: DataFrame) -> DataFrame:
    """(digest, content) of every distinct layer: from the archive, by its patch, or from the baseline; each verified.

    ``stored`` and ``baseline`` have (digest, content). A layer whose bytes do not fit
    its digest has null content.
    """
    wanted = layers.select("digest").distinct().join(blobs.select("digest", "encoding", "patch_from_digest"), "digest", "left")
    full = wanted.where("encoding = 'full'").select("digest").join(stored, "digest")
    reused = wanted.where("encoding is null").select("digest").join(baseline, "digest")
    patches = wanted.where("encoding = 'patch'").join(stored.withColumnRenamed("content", "patch"), "digest")
    patches = patches.select(F.lit("").alias("pair"), F.col("digest").alias("target_digest"), F.col("patch_from_digest").alias("candidate_digest"), "patch", F.octet_length("patch").cast("long").alias("patch_size"))
    decoded = codec.decode_patches(patches, baseline).select(F.col("target_digest").alias("digest"), "content")
    every = full.unionByName(reused).unionByName(decoded)
    return every.withColumn("content", F.when(digests.verified(F.col("content"), F.col("digest")), F.col("content")))


def _write_image(ref: str, manifest: bytes, config: bytes, layers: DataFrame, order: list[str]) -> None:
    """An image as an OCI folder, OCI archive or plain folder; layers stream through the driver one at a time."""
    transport, place = images.split_ref(ref)
    m = json.loads(manifest)
    media = m.get("mediaType") or refs.OCI_V1
    if transport == "docker-archive" or transport in ("oci", "oci-archive") and media != refs.OCI_V1:
        raise ContentError(f"a manifest of type {media} cannot be written to {transport} without conversion")
    if transport == "docker":
        raise EnvironmentFault("registries cannot be reached from here")
    path, _, tag = place.partition(":")
    top = f"{path}.folder" if transport == "oci-archive" else path
    if transport == "oci-archive" and os.path.isdir(top):
        raise ContentError(f"{top} is in the way")
    name = (lambda d: d.partition(":")[2]) if transport == "dir" else images.blob_path

    def put(rel: str, data: bytes) -> None:
        full = os.path.join(top, rel)
        os.makedirs(os.path.dirname(full) or ".", exist_ok=True)
        with open(full + ".part", "wb") as f:
            f.write(data)
        os.replace(full + ".part", full)

    try:
        _put_image(put, name, m, manifest, config, layers, order, transport, media, tag)
        if transport == "oci-archive":
            _pack_folder(top, path)
    finally:
        if transport == "oci-archive":
            shutil.rmtree(top, ignore_errors=True)


def _put_image(put, name, m: dict, manifest: bytes, config: bytes, layers: DataFrame, order: list[str], transport: str, media: str, tag: str) -> None:
    """Layers, config, manifest and index of an image, by ``put``."""
    left = set(order)
    for row in layers.toLocalIterator():
        if row.digest in left and row.content is not None:
            put(name(row.digest), bytes(row.content))
            left.discard(row.digest)
    if left:
        raise ContentError(f"layers do not fit their digests: {', '.join(sorted(left))}")
    put(name(m["config"]["digest"]), config)
    if transport == "dir":
        put("manifest.json", manifest)
        put("version", b"Directory Transport Version: 1.1\n")
        return
    put(name(_digest(manifest)), manifest)
    put("oci-layout", b'{"imageLayoutVersion":"1.0.0"}')
    entry = {"mediaType": media, "digest": _digest(manifest), "size": len(manifest), "annotations": {"org.opencontainers.image.ref.name": tag or "latest"}}
    put("index.json", json.dumps({"schemaVersion": 2, "manifests": [entry]}).encode())


def _pack_folder(top: str, path: str) -> None:
    """All files of a folder as a tar, in order of their names, file by file."""
    with tarfile.open(f"{path}.part", "w", format=tarfile.PAX_FORMAT) as tar:
        for rel in sorted(os.path.relpath(os.path.join(d, f), top) for d, _, fs in os.walk(top) for f in fs):
            info = tarfile.TarInfo(rel)
            info.size, info.mode = os.path.getsize(os.path.join(top, rel)), 0o644
            with open(os.path.join(top, rel), "rb") as f:
                tar.addfile(info, f)
    os.replace(f"{path}.part", path)


def _cause(e: Exception) -> str:
    """What went wrong, in a line: of an error in a Python worker, the worker's own last line."""
    lines = [x.strip() for x in str(e).splitlines()]
    named = [x for x in lines if re.match(r"[\w.]*(Error|Fault|Exception): ", x)]
    return (named or lines or [type(e).__name__])[-1] if isinstance(e, PySparkException) else str(e)


def unbundle(spark: SparkSession, path: str, baselines: dict[str, str], outputs: dict[str, str], strict: bool = True, settings: Settings | None = None) -> DataFrame:
    """Rebuild all images of an archive; returns (image, position, status, error).

    Strict: any missing baseline, or any image that preflight refuses, is an error
    before anything is written. Otherwise such images are skipped. Every layer is
    verified before it is written, and every image read back and compared after,
    its manifest's digest too. An image whose blobs are missing or damaged, in the
    archive or the baseline, is reported as failed and the others go on. An image
    whose window needs more than the memory budget is an error before any is written.
    If no image succeeds the report still comes; ``apply.apply_report`` sums it up.
    """
    a = open_archive(spark, path)
    given, opened = _resolve(spark, a, baselines, strict)
    checked = {r.image: r for r in preflight(spark, a, opened).collect()}
    if strict and (bad := [r for r in checked.values() if r.status != "ok"]):
        raise ContentError("; ".join(f"{r.image}: {r.status}" for r in bad))
    settings = settings or Settings()
    if over := plan.images_over_budget(plan.image_rss(a.layers.join(a.blobs.select("digest"), "digest", "left_semi"), a.blobs, settings.window_log), settings.budget_bytes()).first():
        raise UserError(f"image {over.image} needs {over.est_rss} bytes, the memory budget is {settings.budget_bytes()}")
    archives.register(spark)
    only = next(iter(a.manifests)) if len(a.manifests) == 1 else None
    places = {only if k == "default" and only else k: v for k, v in outputs.items()}
    rows = []
    for r in sorted(a.images.collect(), key=lambda r: r.position):
        name, status, why = r.name, "failed_compose", None
        if checked[name].status != "ok":
            rows.append((name, r.position, "skipped_preflight", checked[name].status))
            continue
        if name not in places:
            rows.append((name, r.position, "failed_compose", "no output named"))
            continue
        try:
            own = a.layers.where(F.col("image") == name)
            order = [x.digest for x in own.orderBy("layer_idx").collect()]
            needs = [x.digest for x in apply.required(own, a.blobs).collect()]
            held = a.blobs.join(own.select("digest"), "digest", "left_semi").select("digest").collect()
            reader = spark.read.format("delta_archive").option("digests", ",".join(x.digest for x in held))
            none = spark.createDataFrame([], "digest string, content binary")
            stored = reader.load(path).select("digest", "content") if held else none
            base = _load(spark, [given[name]], "", needs).select("digest", "content") if needs else none
            m = json.loads(a.manifests[name])
            config = dict(archives.read_members(path, {images.blob_path(m["config"]["digest"])}))[images.blob_path(m["config"]["digest"])]
            _write_image(places[name], a.manifests[name], config, rebuild(own, a.blobs, stored, base), order)
            status = "failed_invariant"
            back = _load(spark, [places[name]], "", content=False).select(F.lit(name).alias("image"), "digest", "size")
            made = images.open_image(places[name])
            types = (name, r.target_manifest_digest, m.get("mediaType") or refs.OCI_V1, _digest(made.raw), made.manifest["mediaType"])
            kept = spark.createDataFrame([types], "image string, expected_digest string, expected_type string, actual_digest string, actual_type string")
            why = apply.invariant(own.select("image").distinct(), own, back, a.blobs, kept).first().reason
            status = status if why else "ok"
        except (StratalensError, OSError, PySparkException) as e:
            why = _cause(e)
        rows.append((name, r.position, status, why))
    return spark.createDataFrame(rows, "image string, position int, status string, error string")
