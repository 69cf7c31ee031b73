"""License scans by sentence rules.

A text's sentences are normalised and looked up among known licence sentences; the
identifiers found, in order, are matched against rules, each an ordered sequence of
identifiers.  A rule matches where its sentences stand one behind the other among the known
sentences of the text.  Everything is one projection of built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed sentences of public licence notices, in normal form: lower case, signs but letters
# and digits taken for blanks, years and holders of copyright left out.
SENTENCES = {
    "mit-short": "released under the mit license",
    "mit-under": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache-short": "licensed under the apache license version 2 0",
    "apache-the": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-under": "licensed under the gnu general public license version 3",
    "gpl2-under": "licensed under the gnu general public license version 2",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "released under cc0 1 0",
}
# Rules: licence, ordered sentences.
RULES = [
    ("MIT", ["mit-short"]), ("MIT", ["mit-under"]), ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-short"]), ("Apache-2.0", ["apache-the", "apache-comply"]),
    ("GPL-3.0", ["gpl3-work"]), ("GPL-3.0", ["gpl3-under"]), ("GPL-3.0", ["gpl-redistribute", "gpl-hope"]),
    ("GPL-2.0", ["gpl2-under"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("ISC", ["isc-grant"]), ("MPL-2.0", ["mpl2"]), ("Unlicense", ["unlicense"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]), ("CC-BY-4.0", ["cc-by"]), ("CC-BY-SA-4.0", ["cc-by-sa"]), ("CC0-1.0", ["cc0"]),
]
# Fixed names of licences, in normal form, behind "licensed under the", "this project is
# released under the" and the like; what sends the reader to a file may follow.
LEAD = "^(?:this [a-z]+ is |it is )?(?:licensed|released|distributed|available|published|made available) under (?:the )?(?:terms of )?(?:the )?(.+?)(?: license)?(?: see .*)?$"
NAMES = {
    "mit": "MIT", "apache license version 2 0": "Apache-2.0", "apache license 2 0": "Apache-2.0", "apache 2 0": "Apache-2.0",
    "gnu general public license version 2": "GPL-2.0", "gnu general public license v2 0": "GPL-2.0", "gnu general public license version 3": "GPL-3.0", "gnu general public license v3 0": "GPL-3.0",
    "gnu lesser general public license version 2 1": "LGPL-2.1", "gnu lesser general public license v2 1": "LGPL-2.1", "gnu lesser general public license version 3": "LGPL-3.0", "gnu lesser general public license v3 0": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0", "gnu affero general public license v3 0": "AGPL-3.0",
    "bsd 2 clause": "BSD-2-Clause", "2 clause bsd": "BSD-2-Clause", "bsd 3 clause": "BSD-3-Clause", "3 clause bsd": "BSD-3-Clause",
    "isc": "ISC", "mozilla public license version 2 0": "MPL-2.0", "mozilla public license 2 0": "MPL-2.0", "unlicense": "Unlicense", "boost software license version 1 0": "BSL-1.0",
    "cc by 4 0": "CC-BY-4.0", "cc by sa 4 0": "CC-BY-SA-4.0", "cc by nc 4 0": "CC-BY-NC-4.0", "cc0 1 0": "CC0-1.0",
}
RULES += [(k, ["under-" + k]) for k in dict.fromkeys(NAMES.values())]
# Where a sentence ends: a full stop, semicolon, colon or mark with white space behind it, or
# a blank line; licence texts wrap lines inside sentences, so a single line end is none ...
ENDS = "[.;:!?](?=[ \\t\\r\\n]|$)|\\n[ \\t\\r]*\\n"
# ... but a line may also be a sentence by itself.  Both readings count.
LINES = "\\n+"
WORTH = "licen[sc]e|released|permi|redistribut|software|copyright| under "


def _normal(column: str) -> str:
    return f"trim(regexp_replace(lower({column}), '[^a-z0-9]+', ' '))"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _chain(rule: list[str]) -> str:
    return "".join(f"<{k}>" for k in rule)


def _alone(rule: list[str], count) -> str:
    """SQL: a rule matches somewhere that is not part of a match of a longer rule."""
    longer = [r for _, r in RULES if r != rule and _chain(rule) in _chain(r)]
    return " > ".join([count(rule), " + ".join(map(count, longer)) or "0"])


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, licences (distinct, sorted, comma-joined),
    sentences (identifiers in the text's order, comma-joined), n_sentences.

    Null and empty texts have none.  Whole texts are read; rows that repeat an id are rows
    like any other; other columns are not read.  Rows of a text that holds none of the
    words that every known sentence has one of are not split at all.  A rule counts where
    its sentences are not part of a longer rule's, as those of two-clause BSD are of three.
    """
    mapped = lambda pairs: "map(" + ", ".join(f"{_quoted(a)}, {_quoted(b)}" for a, b in pairs) + ")"
    table, names = mapped((s, k) for k, s in SENTENCES.items()), mapped((n, "under-" + k) for n, k in NAMES.items())
    known = lambda s: f"coalesce(element_at({table}, {s}), element_at({names}, regexp_extract({s}, {_quoted(LEAD)}, 1)))"
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    none = "cast(array() as array<struct<s:int,k:string>>)"

    def named(by: str) -> str:
        """SQL for the known sentences of a reading, and where the first letter of each stands."""
        parts = f"named_struct('p', split(t, {_quoted(by)}, -1), 'd', regexp_extract_all(t, {_quoted(by)}, 0))"
        hit = "concat(a.out, array(named_struct('s', a.at + length(regexp_extract(f.p[i], '^[^A-Za-z0-9]*', 0)), 'k', x)))"
        step = f"transform(transform(array({_normal('f.p[i]')}), s -> {known('s')}), x -> named_struct('at', a.at + length(f.p[i]) + coalesce(length(get(f.d, i)), 0), 'out', case when x is not null then {hit} else a.out end))[0]"
        return f"transform(array({parts}), f -> aggregate(sequence(0, size(f.p) - 1), named_struct('at', 0, 'out', {none}), (a, i) -> {step}, a -> a.out))[0]"

    worth = f"lower(t) rlike '{WORTH}'"
    rows = rows.select("doc_id", F.expr(f"case when {worth} then {named(ENDS)} else {none} end").alias("a"), F.expr(f"case when {worth} then {named(LINES)} else {none} end").alias("b"))
    # what both readings know stands at the same place and counts once
    rows = rows.select("doc_id", F.expr("transform(array_sort(array_distinct(concat(a, b))), x -> x.k)").alias("ids"))
    rows = rows.withColumn("chain", F.expr("array_join(transform(ids, k -> concat('<', k, '>')), '')"))
    count = lambda rule: f"(length(chain) - length(replace(chain, {_quoted(_chain(rule))}, ''))) / {len(_chain(rule))}"
    hits = ", ".join(f"case when {_alone(rule, count)} then {_quoted(name)} end" for name, rule in RULES)
    found = f"case when chain <> '' then array_join(array_sort(array_distinct(filter(array({hits}), x -> x is not null))), ',') else '' end"
    return rows.select("doc_id", F.expr(found).alias("licences"), F.expr("array_join(ids, ',')").alias("sentences"), F.size("ids").cast("bigint").alias("n_sentences"))


def oracle() -> str:
    """DuckDB SQL for the same rows over ``documents``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    mapped = lambda pairs: "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in pairs) + "}"
    table, names = mapped((s, k) for k, s in SENTENCES.items()), mapped((n, "under-" + k) for n, k in NAMES.items())
    count = lambda rule: f"(length(chain) - length(replace(chain, {q(_chain(rule))}, ''))) / {len(_chain(rule))}"
    hits = ", ".join(f"CASE WHEN {_alone(rule, count)} THEN {q(name)} END" for name, rule in RULES)
    # RE2 has no look-ahead: a mark is set in place of each sign that ends a sentence first
    ended, by = "regexp_replace(t || chr(10), '[.;:!?]([ \\t\\r\\n])', chr(1) || '\\1', 'g')", "chr(1) || '|\\n[ \\t\\r]*\\n'"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {ended} AS e FROM d WHERE regexp_matches(lower(t), '{WORTH}')),
s AS (SELECT doc_id, 0 AS reading, regexp_split_to_array(e, {by}) AS p, regexp_extract_all(e, {by}) AS x FROM w
  UNION ALL SELECT doc_id, 1, regexp_split_to_array(t, '\\n+'), regexp_extract_all(t, '\\n+') FROM w),
u AS (SELECT doc_id, reading, generate_subscripts(p, 1) AS i, unnest(p) AS p, unnest(list_append(x, '')) AS x FROM s),
a AS (SELECT *, sum(length(p) + length(x)) OVER (PARTITION BY doc_id, reading ORDER BY i) - length(p) - length(x) AS pos, trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')) AS n FROM u),
k AS (SELECT DISTINCT doc_id, pos + length(regexp_extract(p, '^[^A-Za-z0-9]*')) AS pos, coalesce({table}[n], {names}[regexp_extract(n, {q(LEAD)}, 1)]) AS k FROM a),
i AS (SELECT doc_id, list(k ORDER BY pos, k) AS ids FROM k WHERE k IS NOT NULL GROUP BY doc_id),
c AS (SELECT d.doc_id, coalesce(ids, []) AS ids, coalesce(array_to_string(list_transform(ids, lambda k: '<' || k || '>'), ''), '') AS chain FROM d LEFT JOIN i USING (doc_id))
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))), ','), '') AS licences,
  coalesce(array_to_string(ids, ','), '') AS sentences, CAST(len(ids) AS BIGINT) AS n_sentences FROM c"""
