"""URI references as Column expressions: resolving against a base, and the base of a URI.

Paths are taken apart and folded in generated code; no Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
#: scheme://authority, and what follows it.
_ROOT = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)(.*)$"


def _folded(path: Column) -> Column:
    """A path that begins with / without its dot segments."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)
    last = F.element_at(parts, -1)

    def step(kept: Column, part: Column) -> Column:
        shorter = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == ".", kept).when(part == "..", shorter).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(closed, "/"))


def _split(rest: Column) -> tuple[Column, Column]:
    """(path, query and fragment) of what follows the authority."""
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    return path, F.substr(rest, F.length(path) + 1)


def _absolute(root: Column, rest: Column) -> Column:
    path, tail = _split(rest)
    return F.concat(F.lower(root), _folded(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))), tail)


def resolve_uri(reference: Column, base: Column) -> Column:
    """A reference seen from a base.

    Absolute references stand for themselves; against a base that is no URL, the two are joined by a slash, and an empty
    base leaves the reference as it is.
    """
    root, rest = F.regexp_extract(base, _ROOT, 1), F.regexp_extract(base, _ROOT, 2)
    base_path, base_tail = _split(rest)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, "[^/]*$", ""))
    ref_path, ref_tail = _split(reference)
    query = F.regexp_extract(base_tail, r"^(\?[^#]*)", 1)
    relative = (
        F.when(reference == "", F.concat(base_path, query))
        .when(reference.startswith("#"), F.concat(base_path, query, reference))
        .when(reference.startswith("?"), F.concat(base_path, reference))
        .when(reference.startswith("/"), reference)
        .otherwise(F.concat(folder, ref_path, ref_tail))
    )
    own_root, own_rest = F.regexp_extract(reference, _ROOT, 1), F.regexp_extract(reference, _ROOT, 2)
    loose = F.when(F.coalesce(base, F.lit("")) == "", reference).when(base.endswith("/"), F.concat(base, reference)).otherwise(F.concat(base, F.lit("/"), reference))
    return (
        F.when(own_root != "", _absolute(own_root, own_rest))
        .when(reference.rlike(_SCHEME), reference)
        .when(F.coalesce(root, F.lit("")) == "", loose)
        .when(reference.startswith("//"), _absolute(F.concat(F.regexp_extract(root, _SCHEME, 0), F.regexp_extract(reference, r"^(//[^/?#]*)", 1)), F.regexp_extract(reference, r"^//[^/?#]*(.*)$", 1)))
        .otherwise(_absolute(root, relative))
    )


def base_uri(uri: Column) -> Column:
    """The folder of a URI: of a URL without query and fragment, else up to the last slash or backslash (empty without one)."""
    root, rest = F.regexp_extract(uri, _ROOT, 1), F.regexp_extract(uri, _ROOT, 2)
    path, _ = _split(rest)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return F.when(root != "", _absolute(root, folder)).otherwise(F.regexp_extract(uri, r"^(.*[/\\])", 1))
