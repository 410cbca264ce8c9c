"""Image references ``transport:path`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Transports that can be read, and those that are reserved.
SUPPORTED = ["docker-archive", "oci-archive", "docker", "oci", "dir"]
RESERVED = ["docker-daemon", "containers-storage", "ostree", "sif", "tarball"]
#: Transports whose hint is the last part of the path.
FILE_TRANSPORTS = ["docker-archive", "oci-archive", "oci", "dir"]
# Media types of manifests.
DOCKER_V2 = "application/vnd.docker.distribution.manifest.v2+json"
OCI_V1 = "application/vnd.oci.image.manifest.v1+json"
#: Fixed value: names of images and pairs.
NAME_PATTERN = "^[a-zA-Z0-9][a-zA-Z0-9_.-]*$"


def transport(ref: Column) -> Column:
    """What stands before the first colon; empty if there is none."""
    at = F.instr(ref, ":")
    return F.when(at > 1, F.substring(ref, F.lit(1), at - 1)).otherwise(F.lit(""))


def path(ref: Column) -> Column:
    """What stands after the first colon."""
    at = F.instr(ref, ":")
    return F.when(at > 1, F.substring(ref, at + 1, F.length(ref))).otherwise(F.lit(""))


def ref_status(ref: Column) -> Column:
    """ok, or why a reference is refused, in the order of the checks. Null is a missing transport."""
    t, p = transport(ref), path(ref)
    return (
        F.when(ref.isNull() | (t == ""), "missing_transport")
        .when(t.isin(RESERVED), "reserved_transport")
        .when(~t.isin(SUPPORTED), "unsupported_transport")
        .when(p == "", "empty_path")
        .otherwise("ok")
    )


def basename(p: Column) -> Column:
    """Last element of a slash-separated path; "." if it is empty, "/" if it is only slashes."""
    trimmed = F.regexp_replace(p, "/+$", "")
    return F.when(p == "", ".").when(trimmed == "", "/").otherwise(F.regexp_extract(trimmed, "[^/]*$", 0))


def source_hint(ref: Column) -> Column:
    """Where a blob came from: the file name, host/repo:tag of a registry, or the reference itself."""
    return F.when(transport(ref).isin(FILE_TRANSPORTS), basename(path(ref))).when(ref.startswith("docker://"), F.substring(ref, F.lit(10), F.length(ref))).otherwise(ref)


def output_compat(dest_transport: Column, media_type: Column, allow_convert: Column) -> Column:
    """Whether a manifest of this media type can be written there without conversion."""
    strict = F.when(dest_transport == "docker-archive", media_type == DOCKER_V2).when(dest_transport.isin("oci-archive", "oci"), media_type == OCI_V1).otherwise(F.lit(True))
    return F.coalesce(allow_convert, F.lit(False)) | (F.coalesce(media_type, F.lit("")) == "") | F.coalesce(strict, F.lit(True))


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME_PATTERN), F.lit(False))
