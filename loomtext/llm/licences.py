"""Licence scan: Aho-Corasick for tags and notices, a shunting-yard parser for licence expressions.

One automaton finds notice phrases (leftmost, longest) in the whole text, in which white space is evened out and
case ignored, and the tag "SPDX-License-Identifier:".  The expression after a tag, to the end of its line, is
parsed with the precedence WITH > AND > OR and evaluated: AND binds a user to the stricter side, OR lets
the milder be chosen, and a known exception (WITH, between two identifiers) softens copyleft by one step.  All findings of a
document hold at once, as if joined by AND.

Cases: null and empty texts have no findings; documents without findings have no row; malformed expressions (a WITH beside a parenthesis
is one) and unknown identifiers count as "unknown", the strictest; texts and expressions of any length are read whole; a
repeated finding is listed once; a null id is reported as null; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = "spdx-license-identifier:"
LEVELS = ("permissive", "weak copyleft", "strong copyleft", "non-commercial", "proprietary", "unknown")
#: Up to this level a document may be used.
PERMITTED = 1
IDENTIFIERS = {
    0: "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC Zlib Unlicense CC0-1.0 CC-BY-3.0 CC-BY-4.0 0BSD BSL-1.0 PostgreSQL Python-2.0 WTFPL Artistic-2.0 MIT-0 PSF-2.0 X11",
    1: "LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 LGPL-2.1 LGPL-3.0 CC-BY-SA-3.0 CC-BY-SA-4.0 OFL-1.1",
    2: "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later GPL-2.0 GPL-3.0 AGPL-3.0 EUPL-1.2 OSL-3.0",
    3: "CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC-BY-ND-4.0 PolyForm-Noncommercial-1.0.0",
    4: "LicenseRef-All-Rights-Reserved LicenseRef-Proprietary",
}
LEVEL = {name.lower(): (name, level) for level, names in IDENTIFIERS.items() for name in names.split()}
EXCEPTIONS = {x.lower() for x in "Classpath-exception-2.0 GCC-exception-3.1 LLVM-exception Autoconf-exception-3.0 Bison-exception-2.2 Font-exception-2.0 Linux-syscall-note OpenSSL-exception".split()}
NOTICES = {
    "apache license, version 2.0": "Apache-2.0",
    "apache license version 2.0": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "apache-2.0 license": "Apache-2.0",
    "mit license": "MIT",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
    "isc license": "ISC",
    "bsd 2-clause": "BSD-2-Clause",
    "bsd 3-clause": "BSD-3-Clause",
    "redistribution and use in source and binary forms": "BSD-3-Clause",
    "boost software license": "BSL-1.0",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "mozilla public license, version 2.0": "MPL-2.0",
    "mozilla public license version 2.0": "MPL-2.0",
    "eclipse public license": "EPL-2.0",
    "creative commons zero": "CC0-1.0",
    **{f"{head}{kind}{sep}{v}.0": f"CC-{name}-{v}.0" for kind, name in (("by", "BY"), ("by-sa", "BY-SA"), ("by-nc", "BY-NC")) for v in (3, 4) for head in ("cc ", "cc-") for sep in (" ", "-") if name != "BY-NC" or v != 0},
    **{f"cc{a}by-nc-sa{b}4.0": "CC-BY-NC-SA-4.0" for a in " -" for b in " -"},
    **{f"cc{a}by-nc-nd{b}4.0": "CC-BY-NC-ND-4.0" for a in " -" for b in " -"},
    "creative commons attribution 4.0": "CC-BY-4.0",
    "creative commons attribution-sharealike 4.0": "CC-BY-SA-4.0",
    "creative commons attribution-noncommercial 4.0": "CC-BY-NC-4.0",
    **{f"gnu {kind}general public license{sep}{v}": f"{name}-{n}-only" for kind, name in (("", "GPL"), ("lesser ", "LGPL"), ("affero ", "AGPL")) for sep in (", version ", " version ", " v") for v, n in (("2", "2.0"), ("2.1", "2.1"), ("3", "3.0")) if (name, n) not in {("GPL", "2.1"), ("AGPL", "2.0"), ("AGPL", "2.1")}},
    "all rights reserved": "LicenseRef-All-Rights-Reserved",
}
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+\-:]+|\S")
_ORDER = {"OR": 1, "AND": 2, "WITH": 3}


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression's tokens in postfix order, or None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand, last = False, ""  # last: "id", "exception", "WITH" or another token
    for t in _TOKEN.findall(expression):
        if last == "WITH" and (t in "()" or t.upper() in _ORDER):
            return None
        if t == "(":
            if operand:
                return None
            stack.append(t)
        elif t == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif t.upper() in _ORDER:
            t = t.upper()
            if not operand or (t == "WITH" and last != "id"):
                return None
            while stack and _ORDER.get(stack[-1], 0) >= _ORDER[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = False
        elif operand or not re.fullmatch(r"[A-Za-z0-9.+\-:]+", t):
            return None
        else:
            out.append(t)
            operand, t = True, "exception" if last == "WITH" else "id"
        last = t
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def _evaluate(expression: str) -> tuple[tuple[str, ...], int]:
    tokens = postfix(expression)
    if tokens is None:
        return (), 5
    stack: list[int] = []
    names: list[tuple[str, str]] = []
    for t in tokens:
        if t == "WITH":
            stack.pop()
            known, a = names.pop()[1].lower() in EXCEPTIONS, stack.pop()
            stack.append((max(0, a - 1) if a in (1, 2) else a) if known else 5)
        elif t in _ORDER:
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if t == "AND" else min(a, b))
        else:
            name, level = LEVEL.get(t.lower().removesuffix("+"), (t, 5))
            names.append((name, t))
            stack.append(level)
    return tuple(sorted({n for n, _ in names})), stack[0]


_remembered = lru_cache(1 << 12)(_evaluate)


def evaluate(expression: str) -> tuple[tuple[str, ...], int]:
    """(identifiers named, level) of an expression.  A bounded number of short ones is remembered."""
    return _remembered(expression) if len(expression) < 200 else _evaluate(expression)


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, name in NOTICES.items():
        a.add_word(phrase, (len(phrase), name))
    a.add_word(TAG, (len(TAG), None))
    a.make_automaton()
    return a


def scan(text: str | None) -> tuple[list[str], list[str], int] | None:
    """(licences, tag expressions, level) of a text, or None if it has neither notice nor tag."""
    low = " ".join((text or "").lower().split())
    names, expressions, level, tagged = set(), set(), 0, False
    for end, (size, name) in _automaton().iter_long(low):
        if name is None:
            tagged = True
        elif not (low[end - size : end - size + 1].isalnum() if end >= size else False) and not low[end + 1 : end + 2].isalnum():
            names.add(name)
            level = max(level, LEVEL[name.lower()][1])
    if tagged:
        for line in re.findall(r"spdx-license-identifier:[^\S\n]*([^\n]*)", text or "", re.IGNORECASE):
            e = " ".join(re.sub(r"\*/|-->|[#;\"']", " ", line).split())
            expressions.add(e)
            found, strict = evaluate(e)
            names.update(found)
            level = max(level, strict)
    return (sorted(names), sorted(expressions), level) if names or expressions else None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, found = [], []
        for i, t in enumerate(b.column(1)):
            hit = scan(t.as_py())
            if hit:
                rows.append(i)
                found.append(hit)
        if rows:
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array([LEVELS[f[2]] for f in found]), pa.array([f[2] <= PERMITTED for f in found])], ["doc_id", "licences", "expressions", "category", "permitted"])


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, expressions, category, permitted) of each document with a licence notice or tag."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, "doc_id long, licences array<string>, expressions array<string>, category string, permitted boolean")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence findings over all documents, lists joined by commas."""
    found = licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumns({c: F.array_join(c, ", ") for c in ("licences", "expressions")})


def _oracle() -> str:
    """All notices, and tags that name one identifier; expressions with operators are beyond it and tested by brute force."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    longest = sorted(NOTICES, key=lambda p: (-len(p), p))  # the first alternative that fits is the longest
    pattern = "(" + "|".join(re.sub(r"([.+()])", r"\\\1", p) for p in longest) + ")"
    rows = lambda pairs: ", ".join(f"({quoted(a)}, {quoted(n)}, {level})" for a, n, level in pairs)
    notices = rows((p, n, LEVEL[n.lower()][1]) for p, n in NOTICES.items())
    known = rows((low, n, level) for low, (n, level) in LEVEL.items())
    return f"""
WITH l AS (SELECT doc_id, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS low FROM documents WHERE text IS NOT NULL),
 m AS (SELECT doc_id, string_split(regexp_replace(low, {quoted(pattern)}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM l),
 h AS (SELECT doc_id, p, unnest(range(2, len(p) + 1)) AS i FROM m),
 f AS (SELECT doc_id, string_split(p[i], chr(2))[1] AS phrase, right(replace(p[i - 1], chr(2), ''), 1) AS a, left(string_split(p[i], chr(2))[2] || coalesce(p[i + 1], ''), 1) AS z FROM h),
 n AS (SELECT doc_id, name, level, NULL AS e FROM f JOIN (VALUES {notices}) v(phrase, name, level) USING (phrase) WHERE NOT regexp_matches(a, '[\\pL\\pN]') AND NOT regexp_matches(z, '[\\pL\\pN]')),
 g AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)spdx-license-identifier:[ \\t]*([^\\n]*)', 1)) AS raw FROM l),
 t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(raw, '\\*/|-->|[#;"'']', ' ', 'g'), '\\s+', ' ', 'g')) AS e FROM g),
 k AS (SELECT doc_id, CASE WHEN regexp_full_match(e, '[A-Za-z0-9.+:-]+') AND upper(e) NOT IN ('AND', 'OR', 'WITH') THEN coalesce(name, e) END AS name, coalesce(level, 5) AS level, e FROM t LEFT JOIN (VALUES {known}) v(low, name, level) ON low = regexp_replace(lower(e), '\\+$', '')),
 u AS (SELECT * FROM n UNION ALL SELECT * FROM k)
SELECT doc_id, coalesce(string_agg(DISTINCT name, ', ' ORDER BY name), '') AS licences, coalesce(string_agg(DISTINCT e, ', ' ORDER BY e), '') AS expressions,
 [{", ".join(map(quoted, LEVELS))}][max(level) + 1] AS category, max(level) <= {PERMITTED} AS permitted
FROM u GROUP BY doc_id
"""


ORACLE = _oracle()
