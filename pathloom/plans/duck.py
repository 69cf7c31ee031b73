"""DuckDB text of the canonical tables, for comparing results."""

from __future__ import annotations

from .fixtures import CHANGES, ORDERS, duck

NATURAL = "array_to_string(list_transform(regexp_extract_all({x}, '([0-9]+|[^0-9]+)'), lambda t: CASE WHEN regexp_matches(t, '^[1-9]') THEN '1' || lpad(CAST(length(t) AS VARCHAR), 5, '0') || t WHEN regexp_matches(t, '^0+$') THEN t || chr(1114111) WHEN regexp_matches(t, '^0') THEN t ELSE replace(t, '/', chr(1)) END), '')"


def natural(x: str) -> str:
    return NATURAL.replace("{x}", x)


def path_key(x: str) -> str:
    return f"list_transform(list_filter(string_split({x}, '/'), lambda p: p <> ''), lambda p: {natural('p')})"


def fold(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ANCESTORS = "list_transform(range(1, len(string_split({p}, '/'))), lambda i: CASE WHEN i = 1 THEN '/' ELSE array_to_string(list_slice(string_split({p}, '/'), 1, i), '/') END)"


def ancestors(p: str = "path") -> str:
    return f"CASE WHEN {p} = '/' THEN CAST([] AS VARCHAR[]) ELSE {ANCESTORS.replace('{p}', p)} END"


def entries(files: str = ORDERS) -> str:
    """WITH clauses that end in ``entries`` for a tree whose root is ``/``."""
    return f"""WITH files AS ({duck(files)}),
up AS (SELECT path, size, unnest({ancestors()}) AS folder FROM files),
folders AS (SELECT folder AS path, CAST(sum(size) AS BIGINT) AS size FROM up GROUP BY 1),
raw AS (SELECT path, size, mtime, false AS is_folder FROM files UNION ALL SELECT path, size, TIMESTAMP '1970-01-01 00:00:00', true FROM folders),
named AS (SELECT '/' AS root, path, is_folder, size, mtime,
  CASE WHEN path = '/' THEN '' WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent_path,
  CASE WHEN path = '/' THEN '/' ELSE string_split(path, '/')[-1] END AS name,
  CASE WHEN path = '/' THEN 0 ELSE len(string_split(path, '/')) - 1 END AS depth FROM raw),
kids AS (SELECT parent_path AS path, count(*) FILTER (NOT is_folder) AS nf, count(*) FILTER (is_folder) AS nd FROM named WHERE path <> '/' GROUP BY 1),
entries AS (SELECT n.root, n.path, n.is_folder, n.size, n.mtime, CASE WHEN is_folder THEN coalesce(nf, 0) END AS num_files, CASE WHEN is_folder THEN coalesce(nd, 0) END AS num_folders,
  n.parent_path, n.name, n.depth, CASE WHEN NOT is_folder THEN regexp_extract(name, '(?s)^.+[.]([^.]+)$', 1) END AS ext FROM named n LEFT JOIN kids k ON n.path = k.path)
"""


def folded() -> str:
    """WITH clauses that end in ``final``: the feed folded over nothing."""
    return f"""WITH changes AS ({duck(CHANGES)}),
acts AS (SELECT *, CASE WHEN kind IN ('CREATE', 'MOVED_TO') THEN 'upsert' WHEN kind IN ('ATTRIB', 'CLOSE_WRITE') THEN 'update' ELSE 'delete' END AS action FROM changes),
last AS (SELECT root, path, arg_max(action, seq) FILTER (action <> 'update') AS decided, arg_max(size, seq) FILTER (action <> 'delete') AS size, arg_max(mtime, seq) FILTER (action <> 'delete') AS mtime FROM acts GROUP BY 1, 2),
final AS (SELECT root, path, false AS is_folder, size, mtime FROM last WHERE decided = 'upsert')
"""
