"""Include and exclude rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..sources.scratch import settled
from .predicates import _glob, any_of, compiles, two_valued


RULE = "pattern string, active boolean, type string, scope string, target string"
#: Rules that become one expression; a longer table is joined instead.
INLINE_RULES = 200


def default_excludes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, True, "fixed", "full_path", "folders") for p in ("/.snapshots", "/proc", "/sys")], RULE)


def exclude_match(rule, path: Column | str = "path", name: Column | str = "name", is_folder: Column | str = "is_folder") -> Column:
    """One rule: target first, then equality, glob or unanchored regex on path or name, all
    with case; a regex that does not compile never matches."""
    path, name, is_folder = P.col(path), P.col(name), P.col(is_folder)
    what = path if rule["scope"] == "full_path" else name
    if rule["type"] == "fixed":
        hit = what == rule["pattern"]
    elif rule["type"] == "wildcard":
        hit = F.rlike(what, F.lit("(?d)" + _glob(rule["pattern"])))
    else:
        pattern = "(?d)" + rule["pattern"]
        hit = F.rlike(what, F.lit(pattern)) if compiles(pattern) else F.lit(False)
    return {"files": ~is_folder & hit, "folders": is_folder & hit}.get(rule["target"], hit)


def excluded(rules: list, exclude_hidden: bool, name: Column | str = "name", path: Column | str = "path", is_folder: Column | str = "is_folder") -> Column:
    """Hidden, or hit by an active rule."""
    hidden = [F.startswith(P.col(name), F.lit("."))] if exclude_hidden else []
    return two_valued(any_of(*hidden, *(exclude_match(r, path, name, is_folder) for r in rules if r["active"])))


def excluded_paths(entries: DataFrame, excludes: DataFrame, exclude_hidden: bool) -> DataFrame:
    """(root, path, is_folder) of entries that a rule hits by itself; roots are never tested."""
    tested = entries.where("path <> root")
    rules = excludes.where("active").limit(INLINE_RULES + 1).collect()
    if len(rules) <= INLINE_RULES:
        return tested.where(excluded(rules, exclude_hidden)).select("root", "path", "is_folder")
    return excluded_by_join(tested, excludes, exclude_hidden)


def excluded_by_join(entries: DataFrame, excludes: DataFrame, exclude_hidden: bool) -> DataFrame:
    """The same for long rule tables: fixed rules by equality joins, patterns by one
    theta-join.  Regexes are tried one by one on the driver; those that do not compile
    never match, as in ``exclude_match``."""
    e = entries.select("root", "path", "name", "is_folder")
    r = excludes.where("active")
    fits = "(target = 'both' or (target = 'files') = (not is_folder))"
    fixed = [e.join(r.where(f"type = 'fixed' and scope = '{s}'").select(F.col("pattern").alias(c), "target"), c).where(fits).select("root", "path", "is_folder") for s, c in (("full_path", "path"), ("basename", "name"))]
    broken = [x["pattern"] for x in r.where("type not in ('fixed', 'wildcard')").select("pattern").distinct().toLocalIterator() if not compiles("(?d)" + x["pattern"])]
    globs = r.where("type <> 'fixed'").where((F.col("type") == "wildcard") | ~F.col("pattern").isin(broken)).withColumn("rx", F.concat(F.lit("(?d)"), F.when(F.col("type") == "wildcard", P.glob_to_regex("pattern")).otherwise(F.col("pattern"))))
    theta = e.join(globs, F.expr(f"(case when scope = 'full_path' then path else name end) rlike rx and {fits}"), "left_semi").select("root", "path", "is_folder")
    parts = [*fixed, theta]
    if exclude_hidden:
        parts.append(e.where("startswith(name, '.')").select("root", "path", "is_folder"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def below(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """(root, path) of entries that are, or lie below, one of ``folders`` (root, path); one
    row for each of those above it.  The root itself, which every entry lies below, joins
    on the root alone, so that it is no hot key."""
    folders = folders.select("root", F.col("path").alias("at"))
    inner = F.filter(F.array_append(P.ancestors("path", "root"), F.col("path")), lambda p: p != F.col("root"))
    hit = entries.select("root", "path", F.explode(inner).alias("at")).join(folders, ["root", "at"], "left_semi").select("root", "path")
    whole = folders.where("at = root").select("root")
    return hit.unionByName(entries.select("root", "path").join(whole, "root", "left_semi"))


#: Listed folders that are sent to every task; a longer list is joined by ancestors.
MANY_FOLDERS = 100_000


def _levels(folders: DataFrame) -> tuple[DataFrame, list[int]] | None:
    """The listed (root, path) that lie in their root, written once, and the numbers of components that occur; None
    if the list is too long to send."""
    inside = (F.col("path") == F.col("root")) | P.is_descendant("path", F.col("root"))
    listed = settled(folders.select("root", "path").where(inside).distinct())
    if listed.count() > MANY_FOLDERS:
        return None
    return listed, [r[0] for r in listed.select(F.size(F.split("path", "/"))).distinct().collect()]


def _prefix(level: int) -> Column:
    """The first components of a path, as a path; the top folder has one, which is empty."""
    seg = F.split("path", "/")
    cut = F.array_join(F.slice(seg, 1, level), "/")
    return F.when(F.size(seg) >= level, F.when(cut == "", F.lit("/")).otherwise(cut))


def _at_level(listed: DataFrame, level: int) -> DataFrame:
    """The list's folders of so many components; ``/`` splits into two, but is one."""
    own = F.when(F.col("path") == "/", F.lit(1)).otherwise(F.size(F.split("path", "/")))
    return F.broadcast(listed.where(own == level).select(F.col("root").alias("__root"), F.col("path").alias("__at")))


def _tops(levels: list[int]) -> list[int]:
    return sorted({1, *levels})


def not_under(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """``entries`` that neither are one of ``folders`` (root, path) nor lie below one.  A list
    that was counted to be short goes to the entries, one lookup of a path's first components
    for each depth that the list has: no row per ancestor, no shuffle of the entries."""
    found = _levels(folders)
    if found is None:
        return entries.join(below(entries, folders), ["root", "path"], "left_anti")
    for level in _tops(found[1]):
        entries = entries.join(_at_level(found[0], level), (F.col("root") == F.col("__root")) & (_prefix(level) == F.col("__at")), "left_anti")
    return entries


def under(entries: DataFrame, folders: DataFrame) -> DataFrame:
    """(root, path) of entries that are one of ``folders`` or lie below one; an entry may
    appear once for each of them."""
    found = _levels(folders)
    if found is None:
        return below(entries, folders)
    out = entries.select("root", "path").where(F.lit(False))
    for level in _tops(found[1]):
        out = out.unionByName(entries.select("root", "path").join(_at_level(found[0], level), (F.col("root") == F.col("__root")) & (_prefix(level) == F.col("__at")), "left_semi"))
    return out


def apply_excludes(entries: DataFrame, excludes: DataFrame, exclude_hidden: bool = False) -> DataFrame:
    """Entries that no rule hits, neither themselves nor one of their folders (whether or not
    that has a row of its own); roots are never tested.

    Rules are asked of an entry and of each folder above it where it stands: one pass without
    a join.  Tables too long for one expression find their folders by joins.
    """
    rules = excludes.where("active").limit(INLINE_RULES + 1).collect()
    if len(rules) > INLINE_RULES:
        return not_under(entries, excluded_by_join(entries.where("path <> root"), excludes, exclude_hidden))
    folder_rules = [r for r in rules if r["target"] != "files"]
    tests = lambda p: excluded(folder_rules, exclude_hidden, P.name_of(p), p, F.lit(True))
    above = F.exists(P.ancestors("path", "root"), lambda p: (p != F.col("root")) & tests(p))
    return entries.where((F.col("path") == F.col("root")) | ~(excluded(rules, exclude_hidden) | above))


def add_rules(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def remove_rules(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.distinct(), a.columns, "left_anti").select(*a.columns)


def rules_equal(a: DataFrame, b: DataFrame) -> bool:
    b = b.select(*a.columns)
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)


def union_roots(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries below each active root, once for each root that holds them; a root given
    twice counts once.  ``entries`` has path and other columns, root is set here."""
    live = roots.where("active").select(F.col("path").alias("root")).distinct()
    cols = [c for c in entries.columns if c != "root"]
    up = entries.select(*cols, F.explode(F.array_append(P.ancestors("path", F.lit("/")), F.col("path"))).alias("root"))
    return up.join(live, "root").select("root", *cols)


def root_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The innermost root of each path: (path, root), null without any."""
    up = paths.select("path", F.posexplode(F.array_append(P.ancestors("path", F.lit("/")), F.col("path"))).alias("i", "root"))
    hit = up.join(roots.select(F.col("path").alias("root")).distinct(), "root")
    best = hit.groupBy("path").agg(F.max_by("root", "i").alias("root"))
    return paths.join(best, "path", "left")


def same_device(entries: DataFrame) -> DataFrame:
    """Entries on the device of their root; a foreign device takes its subtree along."""
    home = settled(entries.where("path = root").select("root", F.col("device").alias("home"), F.lit(True).alias("__known")).dropDuplicates(["root"]))
    home = F.broadcast(home) if home.count() <= MANY_FOLDERS else home  # a row for each root
    foreign = entries.join(home, "root").where("is_folder and not (device <=> home)").select("root", "path")
    alike = entries.join(home, "root", "left").where("__known is null or device <=> home or is_folder").select(*entries.columns)
    return not_under(alike, foreign)
