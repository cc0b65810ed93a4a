"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words_of(name: Column) -> Column:
    """Lower-case segments of an identifier or text: HTTPServer_get gives http, server, get."""
    cut = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(cut), "[^a-z0-9]+"), lambda x: x != "")


def node_id(kind: Column, path: Column, name: Column, line: Column) -> Column:
    """The stable id: kind, and 32 hex digits of the SHA-256 of path:kind:name:line."""
    whole = F.concat_ws(":", path, kind, name, line.cast("string"))
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(whole, 256), 1, 32))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.octet_length(text) / 4)


def redact(text: Column) -> Column:
    """Values of secret flags and assignments, bearer headers and JSON web tokens (20 characters or more) blotted out, up to a space or quote."""
    out = F.regexp_replace(text, r"""(?i)(--(?:password|token|secret|api-?key)[= ]+)[^\s"']+""", "$1<REDACTED>")
    out = F.regexp_replace(out, r"""(?i)((?:password|passwd|token|secret|api_?key)=)[^\s"']+""", "$1<REDACTED>")
    out = F.regexp_replace(out, r"""(?i)(bearer )[^\s"']+""", "$1<REDACTED>")
    return F.regexp_replace(out, r"eyJ[A-Za-z0-9_.-]{17,}", "<REDACTED_JWT>")
