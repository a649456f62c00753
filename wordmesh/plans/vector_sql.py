"""DuckDB SQL for word vectors, written from the features' definitions; it shares no code with :mod:`wordmesh.functions.features`."""

from __future__ import annotations

DIMS = 512
FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, {units}), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
UNITS = "list_transform(string_split({s}, ''), lambda c: unicode(c)::UHUGEINT)"
_ROLL = "list_reduce(list_prepend(0::UHUGEINT, u), lambda h, c: (xor(h, c) * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)"
NUMBER = "(regexp_full_match(label, '[0-9]+([eE][0-9]+)?') OR lower(label) IN ('infinity', 'nan'))"
GEO = """(CASE WHEN regexp_full_match(label, '[0-9]+([eE][0-9]+)?') THEN CAST(label AS DOUBLE) <= 180
WHEN regexp_full_match(label, '[0-9]+([eE][0-9]+)?[nsNS]') THEN CAST(left(label, length(label) - 1) AS DOUBLE) <= 90
WHEN regexp_full_match(label, '[0-9]+([eE][0-9]+)?[ewEW]') THEN CAST(left(label, length(label) - 1) AS DOUBLE) <= 180 ELSE false END)"""
_KINDS = {"Lu": 0, "Ll": 1, "Lt": 2, "Lm": 3, "Lo": 4, "Nd": 8, "Nl": 9, "No": 10, "Sm": 25, "Sc": 26, "Sk": 27, "So": 28}
_CATEGORY = "CASE " + " ".join(f"WHEN regexp_full_match(c, '\\p{{{k}}}') THEN {n}" for k, n in _KINDS.items()) + " END"


def _text(s: str) -> str:
    """A constant string's code units as a list."""
    return "[" + ", ".join(f"{ord(c)}::UHUGEINT" for c in s) + "]"


def _slices(n: int) -> str:
    return f"list_transform(range(1, greatest(1, len(u) - {n - 2})), lambda i: u[i:i + {n - 1}])"


def _positional(gap: int) -> str:
    return f"list_transform(range(1, greatest(1, len(u) - {gap - 1})), lambda i: [u[i], u[i + {gap}], ((i - 1) % 256)::UHUGEINT, ((i - 1) // 256)::UHUGEINT])"


def vectors(labels: str, p: str = "") -> str:
    """CTEs that end in {p}vec (label, idx, val): the unit vectors of the distinct ``label`` of a query; ``p`` keeps names apart."""
    keyed = [  # prefix, list of keys (lists of code units) of a label, weight
        *[("", _slices(n), 1.0) for n in (3, 4, 5)],
        ("bg:", _positional(1), 0.75),
        ("sg1:", _positional(2), 0.5),
        ("tri:start:", "[list_concat(u, [95::UHUGEINT, 95::UHUGEINT])[1:3]]", 0.65),
        ("tri:end:", "[list_concat([95::UHUGEINT, 95::UHUGEINT], u)[len(u):len(u) + 2]]", 0.65),
        ("first:", "[u[1:1]]", 0.75),
        ("last:", "[u[len(u):len(u)]]", 0.75),
        ("", f"[CASE WHEN len(u) <= 4 THEN list_append({_text('len:')}, (48 + len(u))::UHUGEINT) WHEN len(u) <= 8 THEN {_text('len:5-8')} WHEN len(u) <= 16 THEN {_text('len:9-16')} ELSE {_text('len:17+')} END]", 0.5),
        ("vc:", f"[list_transform(cs, lambda x: CASE WHEN x.kind > 4 THEN {ord('X')}::UHUGEINT WHEN x.low IN ('a', 'e', 'i', 'o', 'u', 'y') THEN {ord('V')}::UHUGEINT ELSE {ord('C')}::UHUGEINT END)]", 0.5),
        ("", f"[CASE WHEN len(list_filter(cs, lambda x: x.low <> x.c)) = 0 THEN {_text('case:lower')} ELSE {_text('case:mixed')} END]", 0.5),
        ("", f"CASE WHEN len(list_filter(cs, lambda x: x.up <> x.c)) = 0 THEN [{_text('case:upper')}] ELSE [] END", 0.5),
        ("", f"CASE WHEN cs[1].kind = 0 THEN [{_text('case:title')}] ELSE [] END", 0.5),
        ("uc:", "list_transform(cs, lambda x: [(48 + x.kind % 10)::UHUGEINT, (48 + x.kind // 10)::UHUGEINT])", 0.25),
        ("feat:number:", f"[CASE WHEN {NUMBER} THEN {_text('is')} ELSE {_text('not')} END]", 0.6),
        ("feat:geo:", f"[CASE WHEN {GEO} THEN {_text('is')} ELSE {_text('not')} END]", 0.6),
    ]
    parts = " UNION ALL ".join(f"SELECT label, {_text(prefix) if prefix else '[]::UHUGEINT[]'} AS prefix, unnest({keys}) AS k, {weight}::DOUBLE AS w FROM {p}lab" for prefix, keys, weight in keyed)
    hashed = f"CAST({FNV.format(units='k')} % {DIMS} AS INTEGER)"
    start = f"CASE WHEN len(prefix) > 0 THEN CAST({FNV.format(units='prefix')} % {DIMS} AS INTEGER) ELSE 0 END"
    return f"""{p}src AS (SELECT DISTINCT label FROM ({labels}) WHERE label IS NOT NULL),
{p}chars AS (SELECT c, {_CATEGORY} AS kind, lower(c) AS low, CASE WHEN c = 'ß' THEN c ELSE upper(c) END AS up FROM (SELECT DISTINCT unnest(string_split(label, '')) AS c FROM {p}src)),
{p}lab AS (SELECT label, {UNITS.format(s='label')} AS u, cs FROM (SELECT label, list({{'c': c, 'kind': kind, 'low': low, 'up': up}} ORDER BY i) AS cs
  FROM (SELECT label, unnest(string_split(label, '')) AS c, unnest(range(length(label))) AS i FROM {p}src) JOIN {p}chars USING (c) GROUP BY label)),
{p}keyed AS ({parts}),
{p}keys AS (SELECT prefix, k, ({start} + {hashed}) % {DIMS} AS idx FROM (SELECT DISTINCT prefix, k FROM {p}keyed)),
{p}raw AS (SELECT label, idx, w FROM {p}keyed JOIN {p}keys USING (prefix, k)
  UNION ALL SELECT label, unnest(range(least(len(u), {DIMS}))) AS idx, unnest(u[1:{DIMS}])::DOUBLE FROM {p}lab
  UNION ALL SELECT label, CAST({_ROLL} % {DIMS} AS INTEGER), 0.8 FROM {p}lab WHERE len(u) <= 3),
{p}sums AS (SELECT label, idx, sum(w) AS v FROM {p}raw GROUP BY label, idx),
{p}vec AS (SELECT label, CAST(idx AS INTEGER) AS idx, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS val FROM {p}sums)"""


def angles(p: str = "") -> str:
    """CTE {p}ang (label, nnz, total, weighted, angle) of {p}vec: the key of each label, by the ten metrics against the unit vector."""
    u = f"(1 / sqrt({DIMS}::DOUBLE))"
    ten = "least(s * {u}, 1), acos(least(s * {u}, 1)), s * {u}, 1, 1, sqrt(greatest(2 - 2 * s * {u}, 0)), away + ({d} - nnz) * {u}, s * {u}, nnz, nnz / {d}".format(u=u, d=f"{DIMS}::DOUBLE")
    return f"""{p}sum AS (SELECT label, count(*) AS nnz, list_sum(list(val ORDER BY idx)) AS s, list_sum(list(abs(val - {u}) ORDER BY idx)) AS away, sum(val * (idx + 1)) AS weighted FROM {p}vec GROUP BY label),
{p}ten AS (SELECT label, nnz, s, weighted, [{ten}]::DOUBLE[] AS m FROM {p}sum),
{p}ang AS (SELECT label, nnz, s AS total, weighted, round(list_sum(m) / (sqrt({DIMS}::DOUBLE) * sqrt(list_sum(list_transform(m, lambda x: x * x)))), 12) AS angle FROM {p}ten)"""
