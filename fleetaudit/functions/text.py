"""Text expressions: names, paths, versions, statement slices."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c) -> Column:
    """Key form of a name: names compare without regard to case."""
    return F.lower(_col(c))


def quote_name(c) -> Column:
    return F.concat(F.lit("["), F.replace(_col(c), F.lit("]"), F.lit("]]")), F.lit("]"))


def dotted_part(c, n: int) -> Column:
    """n-th dot-separated part from the left, null when absent."""
    return F.nullif(F.split_part(_col(c), F.lit("."), F.lit(n)), F.lit(""))


def resource_part(c, n: int) -> Column:
    """n-th part of a ``db:file:page`` resource as a long."""
    return F.split_part(_col(c), F.lit(":"), F.lit(n)).try_cast("long")


def parent_location(path, device=None) -> Column:
    """Folder of a path, separator kept: backslash wins over slash.

    A path that starts with ``{`` is a device identifier and gives ``{device}``. A path
    that ends with its separator, or has none, gives null.
    """
    p = _col(path)
    label = F.coalesce(_col(device), F.lit("UNKNOWN")) if device is not None else F.lit("UNKNOWN")
    back = F.regexp_extract(p, r"(?s)^(.*\\)[^\\]+$", 1)
    slash = F.regexp_extract(p, r"(?s)^(.*/)[^/]+$", 1)
    return (F.when(p.startswith("{"), F.concat(F.lit("{"), label, F.lit("}")))
            .when(back != "", back)
            .when(slash != "", slash))


def statement_slice(text, start, end) -> Column:
    """Part of a batch text between two byte offsets, two bytes a character; end -1 is the end."""
    t, s, e = _col(text), _col(start), _col(end)
    stop = F.when(e == -1, F.length(t) * 2).otherwise(e)
    return F.substr(t, F.floor(s / 2).cast("int") + 1, F.floor((stop - s) / 2).cast("int") + 1)
