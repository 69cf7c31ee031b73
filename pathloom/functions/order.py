"""Natural order as keys: strings and arrays of strings that Spark's own sort puts right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col

_LAST = "\U0010ffff"


def natural_key(x: Column | str) -> Column:
    """Digit runs compare as numbers, runs with leading zeros as fractions before them,
    ``/`` lowest, all else by code points."""
    tokens = F.regexp_extract_all(col(x), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def key(t: Column) -> Column:
        return (
            F.when(F.rlike(t, F.lit("^[1-9]")), F.concat(F.lit("1"), F.lpad(F.length(t).cast("string"), 5, "0"), t))
            .when(F.rlike(t, F.lit("^0+$")), F.concat(t, F.lit(_LAST)))
            .when(F.rlike(t, F.lit("^0")), t)
            .otherwise(F.translate(t, "/", "\x01"))
        )

    return F.array_join(F.transform(tokens, key), "")


def path_key(path: Column | str) -> Column:
    """Component by component in natural order, a shorter list of equal ones first."""
    return F.transform(F.filter(F.split(col(path), "/"), lambda p: p != ""), natural_key)


#: Sort chains: each property and what breaks its ties.
CHAINS = {"name": ["name", "path"], "path": ["path", "name"], "full_path": ["full_path"], "size": ["size", "name", "path"], "mtime": ["mtime", "name", "path"], "ext": ["ext", "name", "path"]}


def _one(prop: str) -> Column:
    if prop == "name":
        return natural_key("name")
    if prop == "path":
        return path_key("parent_path")
    if prop == "full_path":
        return path_key("path")
    if prop == "ext":  # folders stay in the order of the rest of the chain
        return F.coalesce(F.col("ext"), F.lit(""))
    if prop == "type":
        from .types import file_type

        return F.when(F.col("is_folder"), F.lit("")).otherwise(file_type("name", "is_folder"))
    return F.col(prop)


def resort(chain: list[str], prop: str) -> list[str]:
    """``prop`` first, the earlier order as tie-breaker, each property once."""
    return [prop, *(p for p in chain if p != prop)]


def chain_of(prop: str, prev: list[str] | None = None) -> list[str]:
    """The chain of a property; an unknown property falls back to name; type keeps the
    earlier chain behind it."""
    if prop == "type":
        return resort(prev or CHAINS["name"], "type")
    chain = CHAINS.get(prop, CHAINS["name"])
    return chain if not prev else [*chain, *(p for p in prev if p not in chain)]


def sort_keys(prop: str, desc: bool = False, prev: list[str] | None = None) -> list[Column]:
    """Folders first, then the chain; descending turns the whole list round.  The path
    breaks what ties remain, so the order is total."""
    keys = [~F.col("is_folder"), *(_one(p) for p in chain_of(prop, prev)), F.col("path"), F.col("root")]
    return [k.desc() if desc else k.asc() for k in keys]
