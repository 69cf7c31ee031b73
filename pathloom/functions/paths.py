"""Columns of paths and names: pure expressions, so they stay inside one generated stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x: Column | str) -> Column:
    """A-Z to a-z, nothing else: full lower-casing would change other letters too."""
    return F.translate(col(x), UPPER, LOWER)


def fold_text(text: str) -> str:
    """``fold`` of a text on the driver."""
    return text.translate(str.maketrans(UPPER, LOWER))


def name_of(path: Column | str) -> Column:
    """The last component; an empty one shows as ``/``."""
    last = F.element_at(F.split(col(path), "/"), -1)
    return F.when(last == "", F.lit("/")).otherwise(last)


def parent_of(path: Column | str, root: Column | str) -> Column:
    """The folder's path, ``/`` for entries just below it, empty for the root itself."""
    path = col(path)
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(path == col(root), F.lit("")).when(up == "", F.lit("/")).otherwise(up)


def full_path(parent: Column | str, name: Column | str) -> Column:
    parent, name = col(parent), col(name)
    return F.when(parent == "", name).when(parent == "/", F.concat(F.lit("/"), name)).otherwise(F.concat_ws("/", parent, name))


def ext_of(name: Column | str, is_folder: Column | str) -> Column:
    """Text behind the last dot; empty if there is no dot, or it is the first or last
    character; null for folders."""
    return F.when(~col(is_folder), F.regexp_extract(col(name), r"(?s)^.+[.]([^.]+)\z", 1))


def _parts(root: Column) -> Column:
    return F.when(root == "/", F.lit(1)).otherwise(F.size(F.split(root, "/")))


def depth_of(path: Column | str, root: Column | str) -> Column:
    """Number of parents; 0 for the root."""
    path, root = col(path), col(root)
    return F.when(path == root, F.lit(0)).otherwise(F.size(F.split(path, "/")) - _parts(root))


def ancestors(path: Column | str, root: Column | str) -> Column:
    """Paths of all parents, root first; empty for the root."""
    path, root = col(path), col(root)
    seg = F.split(path, "/")
    first, last = _parts(root), F.size(seg) - 1
    up = F.transform(F.sequence(first, last), lambda i: F.array_join(F.slice(seg, F.lit(1), i), "/"))
    shown = F.transform(up, lambda p: F.when(p == "", F.lit("/")).otherwise(p))
    return F.when((path == root) | (last < first), F.array().cast("array<string>")).otherwise(shown)


def is_descendant(path: Column | str, of: Column | str) -> Column:
    path, of = col(path), col(of)
    below = F.when(of == "/", F.lit("/")).otherwise(F.concat(of, F.lit("/")))
    return F.startswith(path, below) & (path != of)


def is_sibling(parent_a: Column | str, parent_b: Column | str) -> Column:
    """Two roots (empty parents) are no siblings."""
    return (col(parent_a) == col(parent_b)) & (col(parent_a) != "")


def has_upper(x: Column | str) -> Column:
    return F.rlike(col(x), F.lit(r"\p{Lu}"))


def is_ascii_icase(x: Column | str) -> Column:
    """ASCII in itself and under both case mappings."""
    x = col(x)
    plain = lambda v: F.rlike(v, F.lit(r"^[\x00-\x7F]*$"))
    return plain(x) & plain(F.lower(x)) & plain(F.upper(x))


def is_blank(x: Column | str) -> Column:
    return F.rlike(col(x), F.lit(r"^\s*$"))


def has_wildcards(x: Column | str) -> Column:
    return F.rlike(col(x), F.lit("[*?]"))


def glob_to_regex(x: Column | str) -> Column:
    """``*`` and ``?`` to an anchored regular expression, all else literal."""
    escaped = F.regexp_replace(col(x), r"([.^$+()\[\]{}\\|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def format_size(size: Column | str, iec: bool = False) -> Column:
    """Bytes as text with one decimal: units of 1000, or of 1024 with ``iec``.  The quotient
    is rounded as the binary number it is, halves to even, as C does."""
    size, base = col(size), 1024 if iec else 1000
    names = ["KiB", "MiB", "GiB", "TiB", "PiB"] if iec else ["kB", "MB", "GB", "TB", "PB"]
    out = F.when(size < base, F.concat(size.cast("string"), F.when(size == 1, F.lit(" byte")).otherwise(F.lit(" bytes"))))
    for i, unit in enumerate(names, 1):
        q = size / F.lit(float(base) ** i)
        tenths = F.floor(q * 10)
        # the sign of what separates q from the middle of two tenths; no term is rounded
        apart = (2 * tenths + 1).cast("double") - q * 16 - q * 4
        tenths = tenths + F.when((apart < 0) | (apart == 0) & (tenths % 2 == 1), 1).otherwise(0)
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = out.when(size < base ** (i + 1), text) if i < len(names) else out.otherwise(text)
    return out


def to_uri(path: Column | str) -> Column:
    """``file://`` with each component percent-encoded."""
    parts = F.transform(F.split(col(path), "/"), lambda p: F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")))
    return F.concat(F.lit("file://"), F.array_join(parts, "/"))
