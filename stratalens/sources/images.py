"""Images on disk as a Spark data source: ``spark.read.format("layers")``.

Options: ``path``, a reference ``transport:path`` or several, one a line; ``platform``,
os/arch[/variant], to pick from a list; ``content``, "true" for the blobs themselves;
``digests``, comma-separated, to read those alone.
Filters on ``digest`` by equality or membership are taken over, so that only those
blobs are read.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..functions.errors import ContentError, EnvironmentFault, UserError
from ..functions.refs import DOCKER_V2, OCI_V1, RESERVED, SUPPORTED
from .tarfiles import members, safe_name

# Media types of lists of manifests.
LISTS = {"application/vnd.docker.distribution.manifest.list.v2+json", "application/vnd.oci.image.index.v1+json"}
SCHEMA = "image string, layer_idx int, digest string, size bigint, media_type string, manifest_digest string, config_digest string, content binary"


def split_ref(raw: str) -> tuple[str, str]:
    """Transport and path of a reference that can be read; else an error that says why."""
    transport, colon, path = raw.partition(":")
    if not colon or not transport:
        raise UserError(f"{raw!r} has no transport; write transport:path")
    if transport in RESERVED:
        raise UserError(f"transport {transport!r} is reserved")
    if transport not in SUPPORTED:
        raise UserError(f"transport {transport!r} is not supported; use one of {', '.join(SUPPORTED)}")
    if not path:
        raise UserError(f"{raw!r} has an empty path")
    return transport, path


class Folder:
    """Files below a folder, or members of an archive, by name."""

    def __init__(self, path: str, archive: bool) -> None:
        self.path, self.archive = path, archive

    def read(self, names: set[str]) -> dict[str, bytes]:
        """Content of those of ``names`` that exist; an archive is passed once and only they are kept."""
        if not os.path.exists(self.path):
            raise EnvironmentFault(f"{self.path} does not exist")
        if self.archive:
            with open(self.path, "rb") as raw:
                return {name: f.read() for info, f in members(io.BufferedReader(raw)) if f is not None and (name := safe_name(info.name)) in names}
        found = {}
        for name in names:
            full = os.path.join(self.path, safe_name(name))
            if os.path.isfile(full):
                with open(full, "rb") as f:
                    found[name] = f.read()
        return found

    def need(self, name: str) -> bytes:
        found = self.read({name})
        if name not in found:
            raise ContentError(f"{self.path} has no {name}")
        return found[name]


def blob_path(digest: str) -> str:
    algorithm, _, value = digest.partition(":")
    return f"blobs/{algorithm}/{value}"


def parse_manifest(raw: bytes, media_type: str = "") -> dict:
    """A single image's manifest; lists and other types are errors."""
    try:
        m = json.loads(raw)
    except ValueError as e:
        raise ContentError(f"manifest is no JSON: {e}") from e
    kind = media_type or m.get("mediaType") or (OCI_V1 if "layers" in m else "")
    if kind in LISTS or "manifests" in m:
        raise ContentError("a list of manifests; name a platform")
    if kind not in (DOCKER_V2, OCI_V1):
        raise ContentError(f"unsupported manifest type {kind!r}")
    return m | {"mediaType": kind}


def select_platform(index: dict, platform: str) -> dict:
    """The entry of a list for os/arch[/variant]. One entry needs no choice; an empty platform for several is an error."""
    entries = index.get("manifests", [])
    if len(entries) == 1 and not platform:
        return entries[0]
    if not platform:
        raise UserError("the image is a list of manifests; name a platform")
    want = platform.split("/")
    if len(want) not in (2, 3):
        raise UserError(f"platform {platform!r} is not os/arch[/variant]")
    for e in entries:
        p = e.get("platform") or {}
        if [p.get("os"), p.get("architecture")] == want[:2] and (len(want) == 2 or p.get("variant") == want[2]):
            return e
    raise UserError(f"no manifest for platform {platform!r}")


@dataclass
class Image:
    """A manifest with where its blobs lie."""

    raw: bytes
    manifest: dict
    folder: Folder
    place: dict[str, str] = field(default_factory=dict)

    def blob(self, digest: str) -> str:
        return self.place.get(digest) or blob_path(digest)


def open_image(ref: str, platform: str = "") -> Image:
    """The image a local reference names."""
    import hashlib

    transport, path = split_ref(ref)
    if transport == "docker":
        raise EnvironmentFault(f"{ref}: registries cannot be reached from here; copy the image to a folder or archive first")
    if transport == "dir":
        folder = Folder(path, archive=False)
        raw = folder.need("manifest.json")
        m = parse_manifest(raw)
        digests = [m["config"]["digest"], *(x["digest"] for x in m["layers"])]
        return Image(raw, m, folder, {d: d.partition(":")[2] for d in digests})
    if transport == "docker-archive":
        file, _, _ = path.partition(":")
        folder = Folder(file, archive=True)
        entry = json.loads(folder.need("manifest.json"))[0]
        names = {safe_name(n) for n in [entry["Config"], *entry["Layers"]]}
        data = folder.read(names)
        of = lambda n: {"digest": "sha256:" + hashlib.sha256(data[safe_name(n)]).hexdigest(), "size": len(data[safe_name(n)])}
        m = {
            "schemaVersion": 2, "mediaType": DOCKER_V2, "config": of(entry["Config"]) | {"mediaType": "application/vnd.docker.container.image.v1+json"},
            "layers": [of(n) | {"mediaType": "application/vnd.docker.image.rootfs.diff.tar"} for n in entry["Layers"]],
        }
        place = {of(n)["digest"]: safe_name(n) for n in [entry["Config"], *entry["Layers"]]}
        return Image(json.dumps(m).encode(), m, folder, place)
    file, _, tag = path.partition(":")
    folder = Folder(file, archive=transport == "oci-archive")
    index = json.loads(folder.need("index.json"))
    entries = index.get("manifests", [])
    if tag:
        entries = [e for e in entries if (e.get("annotations") or {}).get("org.opencontainers.image.ref.name") == tag]
    if not entries:
        raise ContentError(f"{ref}: no such image in the index")
    entry = entries[0] if len(entries) == 1 else select_platform({"manifests": entries}, platform)
    raw = folder.need(blob_path(entry["digest"]))
    while entry.get("mediaType") in LISTS or "manifests" in json.loads(raw):
        entry = select_platform(json.loads(raw), platform)
        raw = folder.need(blob_path(entry["digest"]))
    return Image(raw, parse_manifest(raw, entry.get("mediaType", "")), folder)


class Part(InputPartition):
    def __init__(self, ref: str) -> None:
        self.ref = ref


class LayerReader(DataSourceReader):
    """One partition per image; blobs are read only if asked for, and only those that filters name."""

    def __init__(self, options: dict[str, str]) -> None:
        self.refs = [r for r in options.get("path", "").split("\n") if r]
        if not self.refs:
            raise UserError("name a reference: load('transport:path')")
        self.platform = options.get("platform", "")
        self.content = options.get("content", "false").lower() == "true"
        self.digests = {d for d in options.get("digests", "").split(",") if d} or None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("digest",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.digests = values if self.digests is None else self.digests & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        for r in self.refs:
            split_ref(r)
        return [Part(r) for r in self.refs]

    def read(self, partition: Part) -> Iterator[tuple]:
        import hashlib

        image = open_image(partition.ref, self.platform)
        own, config = "sha256:" + hashlib.sha256(image.raw).hexdigest(), image.manifest["config"]["digest"]
        wanted = [(i, x) for i, x in enumerate(image.manifest["layers"]) if self.digests is None or x["digest"] in self.digests]
        data = image.folder.read({image.blob(x["digest"]) for _, x in wanted}) if self.content else {}
        for i, x in wanted:
            content = data.get(image.blob(x["digest"])) if self.content else None
            if self.content and content is None:
                raise ContentError(f"{partition.ref} lacks blob {x['digest']}")
            yield partition.ref, i, x["digest"], x["size"], x.get("mediaType"), own, config, content


class LayerSource(DataSource):
    """Layers of images: ``spark.dataSource.register(LayerSource)``, then ``format("layers")``."""

    @classmethod
    def name(cls) -> str:
        return "layers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return LayerReader(self.options)
