"""DuckDB SQL for forests of random and best cuts, level by level."""

from __future__ import annotations

from .fits_sql import uniform


def forest(source: str, width: int, trees: int, depth: int, least: int, kind: str, seed: int = 1, tests: int = 10) -> str:
    """Predictions ``key``, ``prediction``, ``prediction_se`` of a forest on ``source``, a
    query of ``key``, ``x0`` to ``x{width-1}`` and ``target``.  Trees weigh one over the root
    of their leaf's variance."""
    pick = lambda f: "CASE " + " ".join(f"WHEN {f} = {j} THEN x{j}" for j in range(width)) + " END"
    parts = [
        f"r AS (SELECT *, row_number() OVER () rid FROM ({source}))",
        "m AS (SELECT avg(target) base FROM r)",
        f"n0 AS (SELECT r.*, target - base y, t, 0 node FROM r, m, range({trees}) u(t))",
    ]
    for k in range(depth):
        if kind == "random":
            parts.append(f"v{k} AS (SELECT n.*, d.f, {pick('d.f')} v FROM n{k} n JOIN (SELECT t, node, floor({uniform(seed, chr(39) + 'f' + chr(39), 't', 'node')} * {width})::INT f FROM n{k} GROUP BY 1, 2) d USING (t, node))")
        else:
            parts.append(f"v{k} AS (" + " UNION ALL ".join(f"SELECT *, {j} f, x{j} v FROM n{k}" for j in range(width)) + ")")
        parts += [
            f"c{k} AS (SELECT t, node, f, v cut, count(*) n, sum(y) s, sum(y * y) q FROM v{k} GROUP BY 1, 2, 3, 4)",
            f"l{k} AS (SELECT t, node, f, cut, sum(n) OVER o ln, sum(s) OVER o ls, sum(q) OVER o lq, sum(n) OVER w tn, sum(s) OVER w ts, sum(q) OVER w tq, lead(cut) OVER (PARTITION BY t, node, f ORDER BY cut) nx FROM c{k} WINDOW o AS (PARTITION BY t, node, f ORDER BY cut ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY t, node, f))",
            f"e{k} AS (SELECT *, lq - ls * ls / ln + (tq - lq) - (ts - ls) * (ts - ls) / (tn - ln) sse, min(cut) OVER (PARTITION BY t, node, f) a, max(cut) OVER (PARTITION BY t, node, f) b FROM l{k} WHERE ln >= {least} AND tn - ln >= {least})",
        ]
        near = ""
        if kind == "random":
            draws = ", ".join(["0.5::DOUBLE", *(uniform(seed, str(i), "t", "node") for i in range(tests))])
            parts.append(f"d{k} AS (SELECT t, node, unnest([{draws}]) u FROM (SELECT DISTINCT t, node FROM e{k}))")
            near = f" WHERE EXISTS (FROM d{k} d WHERE d.t = e{k}.t AND d.node = e{k}.node AND cut <= a + (b - a) * u AND nx > a + (b - a) * u)"
        parts += [
            f"b{k} AS (SELECT t, node, arg_min(f, sse) f, arg_min(cut, sse) cut FROM e{k}{near} GROUP BY 1, 2)",
            f"n{k + 1} AS (SELECT n.* EXCLUDE (node), CASE WHEN cut IS NULL THEN node WHEN {pick('b.f')} <= cut THEN 2 * node + 1 ELSE 2 * node + 2 END node FROM n{k} n LEFT JOIN b{k} b USING (t, node))",
        ]
    parts += [
        f"s AS (SELECT t, node, avg(y) m, greatest(sum(y * y) / count(*) - avg(y) * avg(y), 0) v FROM n{depth} GROUP BY 1, 2)",
        f"p AS (SELECT rid, key, m, v, 1 / sqrt(v + 1e-9::DOUBLE) w FROM n{depth} JOIN s USING (t, node))",
    ]
    return (
        f"WITH {', '.join(parts)} SELECT any_value(key) AS key, round(any_value(base) + sum(w * m) / sum(w), 3) + 0.0::DOUBLE AS prediction, "
        "round(sqrt(sum(w * w * v)) / sum(w), 3) + 0.0::DOUBLE AS prediction_se FROM p, m GROUP BY rid"
    )
