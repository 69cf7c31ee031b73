"""The path functions as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_LAST = "element_at(split(path, '/'), -1)"
_UP = "regexp_replace(path, '/[^/]*$', '')"
_FIRST = "(CASE WHEN root = '/' THEN 1 ELSE size(split(root, '/')) END)"
_SIZE = "regexp_extract(lower(trim(x)), '^([0-9]+)([kmgt]?)b?$', {})"
_UNIT = f"(CASE {_SIZE.format(2)} WHEN 'k' THEN 1000L WHEN 'm' THEN 1000000L WHEN 'g' THEN 1000000000L WHEN 't' THEN 1000000000000L ELSE 1L END)"
_LO = f"try_multiply(try_cast({_SIZE.format(1)} AS BIGINT), {_UNIT})"
_HI = f"(CASE WHEN {_SIZE.format(2)} = '' THEN {_LO} ELSE try_add({_LO}, {_UNIT} div 1000L * 950L - 1L) END)"

# signature -> (type, body)
FUNCTIONS = {
    "path_fold(x STRING)": ("STRING", "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"),
    "path_name(path STRING)": ("STRING", f"CASE WHEN {_LAST} = '' THEN '/' ELSE {_LAST} END"),
    "path_parent(path STRING, root STRING)": ("STRING", f"CASE WHEN path = root THEN '' WHEN {_UP} = '' THEN '/' ELSE {_UP} END"),
    "path_join(parent STRING, name STRING)": ("STRING", "CASE WHEN parent = '' THEN name WHEN parent = '/' THEN concat('/', name) ELSE concat_ws('/', parent, name) END"),
    "path_ext(name STRING, is_folder BOOLEAN)": ("STRING", r"CASE WHEN NOT is_folder THEN regexp_extract(name, r'(?s)^.+[.]([^.]+)\z', 1) END"),
    "path_depth(path STRING, root STRING)": ("INT", f"CASE WHEN path = root THEN 0 ELSE size(split(path, '/')) - {_FIRST} END"),
    "path_ancestors(path STRING, root STRING)": ("ARRAY<STRING>", f"CASE WHEN path = root OR size(split(path, '/')) - 1 < {_FIRST} THEN cast(array() AS ARRAY<STRING>) ELSE transform(sequence({_FIRST}, size(split(path, '/')) - 1), i -> CASE WHEN i = 1 THEN '/' ELSE array_join(slice(split(path, '/'), 1, i), '/') END) END"),
    "path_is_descendant(path STRING, above STRING)": ("BOOLEAN", "startswith(path, CASE WHEN above = '/' THEN '/' ELSE concat(above, '/') END) AND path <> above"),
    "path_is_sibling(parent_a STRING, parent_b STRING)": ("BOOLEAN", "parent_a = parent_b AND parent_a <> ''"),
    "glob_to_regex(x STRING)": ("STRING", r"concat('^', replace(replace(regexp_replace(x, r'([.^$+()\[\]{}\\|])', r'\\$1'), '*', '.*'), '?', '.'), '$')"),
    "size_interval(x STRING)": ("STRUCT<lo: BIGINT, hi: BIGINT>", f"CASE WHEN {_HI} IS NOT NULL THEN named_struct('lo', {_LO}, 'hi', {_HI}) END"),
}

_TOKEN = "CASE WHEN rlike(t, '^[1-9]') THEN concat('1', lpad(cast(length(t) AS STRING), 5, '0'), t) WHEN rlike(t, '^0+$') THEN concat(t, chr_last()) WHEN rlike(t, '^0') THEN t ELSE translate(t, '/', chr(1)) END"
FUNCTIONS |= {
    "path_root(path STRING, roots ARRAY<STRING>)": ("STRING", "array_max(transform(filter(roots, r -> path = r OR startswith(path, CASE WHEN r = '/' THEN '/' ELSE concat(r, '/') END)), r -> named_struct('n', length(r), 'r', r))).r"),
    "natural_key(x STRING)": ("STRING", "array_join(transform(regexp_extract_all(x, '([0-9]+|[^0-9]+)', 1), t -> " + _TOKEN.replace("chr_last()", "decode(unhex('F48FBFBF'), 'UTF-8')") + "), '')"),
}
# signature -> (columns, query)
TABLE_FUNCTIONS = {
    "path_ancestor_rows(path STRING, root STRING)": ("place INT, folder STRING", "SELECT pos, col FROM posexplode(" + FUNCTIONS["path_ancestors(path STRING, root STRING)"][1] + ")"),
}


def register(spark: SparkSession) -> list[str]:
    """Puts the functions into the session; returns their names."""
    for signature, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    for signature, (columns, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE ({columns}) RETURN {body}")
    return [s.split("(")[0] for s in (*FUNCTIONS, *TABLE_FUNCTIONS)]
