"""Error classes, their columns and their exit codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exit codes by category.
EXIT_CODES = {"internal": 1, "user": 2, "environment": 3, "content": 4}
# Phrases of registry messages, by class in the order they are tried.
AUTH = ["unauthorized", "authentication required", "denied"]
MISSING = ["manifest unknown", "name unknown", "not found"]
INVALID = ["schema version", "unsupported media type", "invalid manifest"]
RETRYABLE = ["too many requests", "service unavailable", "bad gateway", "gateway timeout", "internal server error", "eof", "connection reset", "connection refused"]
#: Phrases of messages about wrong command lines.
USAGE = ["unknown command", "unknown flag", "unknown shorthand", "required flag", "flag needs an argument", "bad flag syntax", "arg(s)"]


class StratalensError(Exception):
    """An error with a category."""

    category = "internal"

    @property
    def exit_code(self) -> int:
        return EXIT_CODES[self.category]


class UserError(StratalensError):
    category = "user"


class EnvironmentFault(StratalensError):
    category = "environment"


class ContentError(StratalensError):
    category = "content"


def contains_any(col: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | col.contains(n)
    return F.coalesce(out, F.lit(False))


def registry_class(message: Column, network: Column) -> Column:
    """auth, missing, invalid, network or other; ``network`` says that the transport failed."""
    low = F.lower(message)
    return F.when(contains_any(low, AUTH), "auth").when(contains_any(low, MISSING), "missing").when(contains_any(low, INVALID), "invalid").when(network, "network").otherwise("other")


def retryable(message: Column, network: Column) -> Column:
    """Whether another try may help."""
    return contains_any(F.lower(message), RETRYABLE) | F.coalesce(network, F.lit(False))


def category(kind: Column, message: Column, network: Column, filesystem: Column) -> Column:
    """Category of an error: a typed one keeps its own (``kind``), then network, file system, usage, internal."""
    return (
        F.when(kind.isNotNull(), kind).when(F.coalesce(network, F.lit(False)), "environment").when(F.coalesce(filesystem, F.lit(False)), "environment").when(contains_any(message, USAGE), "user").otherwise("internal")
    )


def exit_code(cat: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXIT_CODES.items() for x in kv])
    return F.coalesce(F.element_at(table, cat), F.lit(1)).cast("int")
