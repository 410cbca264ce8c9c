"""Delta archives: a tar with the sidecar first and blobs by ascending digest."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..functions.errors import ContentError, EnvironmentFault
from .images import blob_path
from .tarfiles import members, pack, safe_name

#: Fixed value: the name of the sidecar in an archive.
SIDECAR_NAME = "sidecar.json"


def read_members(path: str, names: set[str] | None = None) -> Iterator[tuple[str, bytes]]:
    """Name and content of an archive's files, or of those named; it is passed once and no further than needed."""
    if not os.path.exists(path):
        raise EnvironmentFault(f"{path} does not exist")
    left = None if names is None else set(names)
    with open(path, "rb") as raw:
        for info, f in members(io.BufferedReader(raw)):
            name = safe_name(info.name)
            if f is None or left is not None and name not in left:
                continue
            yield name, f.read()
            if left is not None:
                left.discard(name)
                if not left:
                    return
    if left:
        raise ContentError(f"{path} lacks {', '.join(sorted(left))}")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.digests = {d for d in options.get("digests", "").split(",") if d} or None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("digest",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.digests = values if self.digests is None else self.digests & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.path.split("\n") if p]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        wanted = None if self.digests is None else {blob_path(d) if d else SIDECAR_NAME for d in self.digests}
        if wanted is not None and not wanted:
            return
        for name, data in read_members(partition.value, wanted):
            parts = name.split("/")
            digest = f"{parts[1]}:{parts[2]}" if len(parts) == 3 and parts[0] == "blobs" else ""
            yield partition.value, name, digest, data


class ArchiveSource(DataSource):
    """Files of delta archives: (archive, name, digest, content); the sidecar has an empty digest."""

    @classmethod
    def name(cls) -> str:
        return "delta_archive"

    def schema(self) -> str:
        return "archive string, name string, digest string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats ``layers`` and ``delta_archive`` known to a session, which hands them its filters."""
    from .images import LayerSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LayerSource)
    spark.dataSource.register(ArchiveSource)


def write_archive(path: str, sidecar_json: str, blobs: DataFrame) -> None:
    """Write one archive file on the driver, blob by blob in ascending order of digest.

    ``blobs`` has (digest, content). An archive is one sequential file; blobs stream
    through the driver one partition at a time and are not held together.
    """
    ordered = blobs.select("digest", "content").dropDuplicates(["digest"]).repartitionByRange("digest").sortWithinPartitions("digest")
    import tarfile

    part = f"{path}.part"
    with tarfile.open(part, "w", format=tarfile.PAX_FORMAT) as tar:
        def add(name: str, data: bytes) -> None:
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(data), 0o644
            tar.addfile(info, io.BytesIO(data))

        add(SIDECAR_NAME, sidecar_json.encode())
        for row in ordered.toLocalIterator():
            add(blob_path(row.digest), bytes(row.content))
    os.replace(part, path)


def extract(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar and blobs of an archive, the sidecar's bytes beside its parsed form.

    (name, digest, content, sidecar): ``sidecar`` is null for blobs.
    """
    from ..operators import sidecar

    register(spark)
    files = spark.read.format("delta_archive").load(path)
    return files.withColumn("sidecar", F.when(F.col("digest") == "", sidecar.parse(F.col("content").cast("string"))))


def oci_image(layers: list[bytes], tag: str = "latest", media_type: str = "application/vnd.oci.image.layer.v1.tar") -> dict[str, bytes]:
    """Files of an OCI layout with one image of these layers; :func:`tarfiles.pack` makes it an oci-archive."""
    import hashlib
    import json

    from ..functions.refs import OCI_V1

    files = {"oci-layout": b'{"imageLayoutVersion":"1.0.0"}'}

    def put(data: bytes) -> str:
        digest = "sha256:" + hashlib.sha256(data).hexdigest()
        files[blob_path(digest)] = data
        return digest

    config = json.dumps({"architecture": "amd64", "os": "linux", "rootfs": {"type": "layers", "diff_ids": []}}).encode()
    manifest = {
        "schemaVersion": 2, "mediaType": OCI_V1, "config": {"mediaType": "application/vnd.oci.image.config.v1+json", "digest": put(config), "size": len(config)},
        "layers": [{"mediaType": media_type, "digest": put(x), "size": len(x)} for x in layers],
    }
    raw = json.dumps(manifest).encode()
    entry = {"mediaType": OCI_V1, "digest": put(raw), "size": len(raw), "annotations": {"org.opencontainers.image.ref.name": tag}}
    files["index.json"] = json.dumps({"schemaVersion": 2, "manifests": [entry]}).encode()
    return files


__all__ = ["ArchiveSource", "extract", "oci_image", "pack", "read_members", "register", "write_archive"]
