"""Keys and paths built from columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.schema import OPINION_FIELDS

# Fixed value: how a template names a field.
VARIABLE = re.compile(r"\$([a-zA-Z0-9]+)")


def collection_key(pattern: str) -> Column:
    """Key template to expression: ``$PRODUCT:$VERSION`` gives ``firefox:4.0``.

    Variables name opinion fields in upper case, a null field is empty; there is no escape.
    Text around the variables is kept; a pattern without variables is refused, since it would
    give every record the same key.
    """
    parts: list[Column] = []
    end = 0
    for match in VARIABLE.finditer(pattern):
        if match.start() > end:
            parts.append(F.lit(pattern[end : match.start()]))
        field = match.group(1)
        if field != field.upper() or field.lower() not in OPINION_FIELDS:
            raise ValueError(f"unknown field ${field} in pattern {pattern!r}")
        parts.append(F.coalesce(F.col(field.lower()), F.lit("")))
        end = match.end()
    if not parts:
        raise ValueError(f"pattern without variables: {pattern!r}")
    if end < len(pattern):
        parts.append(F.lit(pattern[end:]))
    return F.concat(*parts)


def _monotone(part: Column, scheme: str) -> Column:
    if scheme not in ("simple", "reverse_parts"):
        raise ValueError(f"unknown key scheme: {scheme}")
    text = part.cast("string")
    return F.reverse(text) if scheme == "reverse_parts" else text


def document_row_key(ns: Column, ck: Column, doc_id: Column, scheme: str = "simple") -> Column:
    """``ns/ck/id``; ``reverse_parts`` spells the id backwards against hot spots."""
    return F.concat_ws("/", ns, ck, _monotone(doc_id, scheme))


def cluster_row_key(
    ns: Column, ck: Column, rebuild_ms: Column, label: Column, scheme: str = "simple"
) -> Column:
    """``DEFAULT/ns/ck/ts/label``, the timestamp backwards with ``reverse_parts``."""
    return F.concat_ws("/", F.lit("DEFAULT"), ns, ck, _monotone(rebuild_ms, scheme), label)


def collection_row_key(ns: Column, ck: Column) -> Column:
    return F.concat_ws("/", ns, ck)


def document_prefix(ns: Column, ck: Column) -> Column:
    """What all document keys of one collection start with."""
    return F.concat(ns, F.lit("/"), ck, F.lit("/"))


def cluster_prefix(ns: Column, ck: Column, rebuild_ms: Column, scheme: str = "simple") -> Column:
    """What all cluster keys of one rebuild start with."""
    return cluster_row_key(ns, ck, rebuild_ms, F.lit(""), scheme)


def _short_hash(part: Column) -> Column:
    return F.substring(F.md5(part), 1, 8)


def run_slug(ns: Column, ck: Column) -> Column:
    """Fixed-length folder name of a collection."""
    return F.concat_ws("_", _short_hash(ns), _short_hash(ck))


def run_id(ns: Column, ck: Column) -> Column:
    """Name of a collection in stored folders: no two collections share it."""
    return F.sha2(F.concat(F.length(ns).cast("string"), F.lit("/"), ns, F.lit("/"), ck), 256)


def run_path(root: str, timestamp_ms: Column, ns: Column, ck: Column, step: str) -> Column:
    """``root/ts/hash(ns)_hash(ck)/step``"""
    return F.concat_ws(
        "/", F.lit(root), timestamp_ms.cast("string"), run_slug(ns, ck), F.lit(step)
    )
