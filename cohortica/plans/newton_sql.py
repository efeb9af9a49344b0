"""Newton iterations in recursive SQL: the independent side of the fitted models.

``rows`` of a fit are ``(cut, y, x)``, for hazards also ``stop``; all cuts are fitted in one
recursion. The small systems are solved by elimination inside a list fold.
"""

from __future__ import annotations


def design_sql(source: str, numeric: list[str], levels: dict[str, list[str]], name: str = "xr", intercept: bool = False) -> str:
    """CTEs ``{name}``: ``source`` (cut, train, y, ...) with ``x``, standardised by its training rows.

    The first level of each category is left out; a constant column is 0.
    """
    columns = [f"CAST({c} AS DOUBLE)" for c in numeric]
    columns += [f"CAST({c} = '{v}' AS DOUBLE)" for c, vs in levels.items() for v in vs[1:]]
    one = "list_prepend(1.0::DOUBLE, {})" if intercept else "{}"
    x = "list_transform(raw, lambda v, i: CASE WHEN sd[i] > 1e-12 THEN (v - mu[i]) / sd[i] ELSE 0 END)"
    return f"""{name}_r AS (SELECT *, [{', '.join(columns)}] AS raw FROM {source}),
{name}_u AS (SELECT cut, unnest(raw) AS v, unnest(range(1, {len(columns) + 1})) AS i FROM {name}_r WHERE train),
{name}_s AS (SELECT cut, list(mu ORDER BY i) AS mu, list(sd ORDER BY i) AS sd FROM
  (SELECT cut, i, avg(v) AS mu, stddev_pop(v) AS sd FROM {name}_u GROUP BY cut, i) GROUP BY cut),
{name} AS (SELECT r.* EXCLUDE (raw), {one.format(x)} AS x FROM {name}_r r JOIN {name}_s USING (cut))"""


def one_hot_sql(source: str, numeric: list[str], levels: dict[str, list[str]], name: str = "xl") -> str:
    """CTE ``{name}``: ``x`` is 1, the numbers standardised by the sample deviation of training rows, and every level."""
    numbers = ", ".join(f"CAST({c} AS DOUBLE)" for c in numeric)
    flags = ", ".join(["1.0::DOUBLE", *[f"CAST({c} = '{v}' AS DOUBLE)" for c, vs in levels.items() for v in vs]])
    return f"""{name}_r AS (SELECT *, [{numbers}] AS raw, [{flags}] AS flags FROM {source}),
{name}_u AS (SELECT cut, unnest(raw) AS v, unnest(range(1, {len(numeric) + 1})) AS i FROM {name}_r WHERE train),
{name}_s AS (SELECT cut, list(mu ORDER BY i) AS mu, list(sd ORDER BY i) AS sd FROM
  (SELECT cut, i, avg(v) AS mu, stddev_samp(v) AS sd FROM {name}_u GROUP BY cut, i) GROUP BY cut),
{name} AS (SELECT r.* EXCLUDE (raw, flags), list_concat(flags, list_transform(raw, lambda v, i: CASE WHEN sd[i] > 1e-12 THEN (v - mu[i]) / sd[i] ELSE 0 END)) AS x
  FROM {name}_r r JOIN {name}_s USING (cut))"""


def width(numeric: list[str], levels: dict[str, list[str]]) -> int:
    return len(numeric) + sum(len(v) - 1 for v in levels.values())


#: Solution of the augmented system ``m``, rows in order, by Gauss-Jordan elimination.
SOLVE = """list_transform(list_reduce(list_prepend(m, list_transform(range(1, len(m) + 1), lambda k: [[k::DOUBLE]])),
  lambda q, k: list_transform(q, lambda w, i: CASE WHEN i = k[1][1] THEN list_transform(w, lambda v: v / w[k[1][1]::INT])
    ELSE list_transform(w, lambda v, j: v - q[k[1][1]::INT][j] * w[k[1][1]::INT] / q[k[1][1]::INT][k[1][1]::INT]) END)), lambda w: w[-1])"""

LOGIT = ("1 / (1 + exp(-eta)) AS p", "p - y", "p * (1 - p)")
CLOGLOG = ("exp(eta) AS h, h / (exp(h) - 1) AS sl", "CASE WHEN y = 1 THEN -sl ELSE h END",
           "CASE WHEN y = 1 THEN sl * (h / (1 - exp(-h)) - 1) ELSE h END")


def glm_sql(rows: str, d: int, family: tuple[str, str, str], ridge: str, iterations: int, name: str = "nw",
            tenure: bool = False) -> str:
    """Recursive CTE ``{name}(it, cut, b, t)`` and ``{name}_fit(cut, b, t)``: mean loss plus ``ridge / 2`` of the squares.

    ``x`` starts with 1, whose coefficient is free; ``w`` weighs a row. ``ridge`` may use ``c.n_rows``,
    the training rows of the cut. With ``tenure`` every ``stop`` after the first has an effect ``t[stop]``.
    """
    extra, first, slope = family
    effect = "+ n.t[r.stop]" if tenure else ""
    longest = f"(SELECT max(stop) FROM {rows} WHERE train)" if tenure else "0"
    square = f"CASE WHEN i > 1 THEN ({ridge})::DOUBLE ELSE 0 END"
    stops = f"""
  ts AS (SELECT cut, stop, sum(v) / any_value(n) + {ridge} AS w, sum(u) / any_value(n) + {ridge} * any_value(t[stop]) AS g FROM f JOIN c USING (cut) WHERE stop > 1 GROUP BY cut, stop),
  tx AS (SELECT cut, stop, i, sum(v * x[i]) / any_value(n) AS c FROM f JOIN c USING (cut), ix WHERE stop > 1 GROUP BY cut, stop, i),
  ta AS (SELECT p.cut, p.i, q.i AS j, sum(p.c * q.c / w) AS v FROM tx p JOIN tx q USING (cut, stop) JOIN ts USING (cut, stop) GROUP BY ALL),
  tg AS (SELECT cut, i, sum(c * g / w) AS v FROM tx JOIN ts USING (cut, stop) GROUP BY ALL),""" if tenure else ""
    less_a = "- coalesce((SELECT ta.v FROM ta WHERE ta.cut = h.cut AND ta.i = h.i AND ta.j = h.j), 0)" if tenure else ""
    less_g = "- coalesce((SELECT tg.v FROM tg WHERE tg.cut = gx.cut AND tg.i = gx.i), 0)" if tenure else ""
    tails = f"""
  tl AS (SELECT ts.cut, ts.stop, (any_value(g) - sum(c * s[i])) / any_value(w) AS v FROM ts JOIN tx USING (cut, stop) JOIN sv ON sv.cut = ts.cut GROUP BY ts.cut, ts.stop),
  tt AS (SELECT cut, list(coalesce(tl.v, 0) ORDER BY k.stop) AS t FROM (SELECT cut, unnest(range(1, {longest} + 1)) AS stop FROM sv) k LEFT JOIN tl USING (cut, stop) GROUP BY cut),""" if tenure else ""
    moved = "list_transform(o.t, lambda v, i: v - tt.t[i])" if tenure else "o.t"
    tail_join = "JOIN tt ON tt.cut = o.cut" if tenure else ""
    return f"""ix AS (SELECT unnest(range(1, {d + 2})) AS i), pr AS (SELECT p.i, q.i AS j FROM ix p, ix q WHERE p.i <= q.i),
{name}(it, cut, b, t) AS (
  SELECT 0, cut, list_transform(range({d + 1}), lambda i: 0.0::DOUBLE), list_transform(range({longest}), lambda i: 0.0::DOUBLE)
  FROM (SELECT DISTINCT cut FROM {rows})
  UNION ALL (
  WITH o AS (SELECT * FROM {name} WHERE it < {iterations}),
  e AS (SELECT r.*, n.b, n.t, list_dot_product(r.x, n.b) {effect} AS eta FROM o n JOIN {rows} r USING (cut) WHERE r.train),
  f AS (SELECT *, w * ({first}) AS u, w * ({slope}) AS v FROM (SELECT *, {extra} FROM e)),
  c AS (SELECT cut, sum(w)::DOUBLE AS n, count(*)::DOUBLE AS n_rows FROM f GROUP BY cut),
  a AS (SELECT cut, i, j, sum(v * x[i] * x[j]) AS v FROM f, pr GROUP BY cut, i, j),
  h AS (SELECT * FROM a UNION ALL SELECT cut, j, i, v FROM a WHERE i < j),
  gx AS (SELECT cut, i, sum(u * x[i]) AS v FROM f, ix GROUP BY cut, i),{stops}
  g AS (SELECT gx.cut, i, v / n + {square} * o.b[i] {less_g} AS v FROM gx JOIN c USING (cut) JOIN o ON o.cut = gx.cut),
  k AS (SELECT h.cut, i, list(h.v / n + CASE WHEN i = j THEN {square} ELSE 0 END {less_a} ORDER BY j) AS row FROM h JOIN c USING (cut) GROUP BY h.cut, i),
  mm AS (SELECT k.cut, list(list_append(k.row, g.v) ORDER BY k.i) AS m FROM k JOIN g ON g.cut = k.cut AND g.i = k.i GROUP BY k.cut),
  sv AS (SELECT cut, {SOLVE} AS s FROM mm),{tails}
  done AS (SELECT o.it + 1, o.cut, list_transform(o.b, lambda v, i: v - sv.s[i]), {moved} FROM o JOIN sv ON sv.cut = o.cut {tail_join})
  SELECT * FROM done)),
{name}_fit AS (SELECT cut, b, t FROM {name} WHERE it = {iterations})"""


def cox_sql(rows: str, d: int, ridge: float, iterations: int, name: str = "nw") -> str:
    """Recursive CTE ``{name}(it, cut, b)`` and ``{name}_fit(cut, b)``: Breslow likelihood of an event plus ``ridge / 2`` of the squares."""
    return f"""ix AS (SELECT unnest(range(1, {d + 1})) AS i), pr AS (SELECT p.i, q.i AS j FROM ix p, ix q WHERE p.i <= q.i),
{name}(it, cut, b) AS (
  SELECT 0, cut, list_transform(range({d}), lambda i: 0.0::DOUBLE) FROM (SELECT DISTINCT cut FROM {rows})
  UNION ALL (
  WITH o AS (SELECT * FROM {name} WHERE it < {iterations}),
  e AS (SELECT r.cut, r.stop, r.y, r.x, exp(list_dot_product(r.x, n.b)) AS w FROM o n JOIN {rows} r USING (cut) WHERE r.train),
  s AS (SELECT cut, stop, sum(w) AS s0, sum(y) AS dt FROM e GROUP BY cut, stop),
  n AS (SELECT cut, sum(dt)::DOUBLE AS ev FROM s GROUP BY cut),
  f AS (SELECT e.cut, e.stop, e.x, e.y, e.w * dt / s0 AS w FROM e JOIN s USING (cut, stop) WHERE dt > 0),
  a AS (SELECT cut, i, j, sum(w * x[i] * x[j]) AS v FROM f, pr GROUP BY cut, i, j),
  m AS (SELECT cut, stop, i, sum(w * x[i]) AS v, sum(y * x[i]) AS yx FROM f, ix GROUP BY cut, stop, i),
  z AS (SELECT p.cut, p.i, q.i AS j, sum(p.v * q.v / dt) AS v FROM m p JOIN m q USING (cut, stop) JOIN s USING (cut, stop) WHERE p.i <= q.i GROUP BY ALL),
  y AS (SELECT a.cut, a.i, a.j, a.v - z.v AS v FROM a JOIN z ON a.cut = z.cut AND a.i = z.i AND a.j = z.j),
  h AS (SELECT * FROM y UNION ALL SELECT cut, j, i, v FROM y WHERE i < j),
  g AS (SELECT m.cut, i, sum(v - yx) / any_value(ev) + {ridge} * any_value(o.b[i]) AS v FROM m JOIN n USING (cut) JOIN o ON o.cut = m.cut GROUP BY m.cut, i),
  k AS (SELECT h.cut, i, list(h.v / ev + CASE WHEN i = j THEN {ridge} ELSE 0 END ORDER BY j) AS row FROM h JOIN n USING (cut) GROUP BY h.cut, i),
  mm AS (SELECT k.cut, list(list_append(k.row, g.v) ORDER BY k.i) AS m FROM k JOIN g ON g.cut = k.cut AND g.i = k.i GROUP BY k.cut),
  sv AS (SELECT cut, {SOLVE} AS s FROM mm)
  SELECT o.it + 1, o.cut, list_transform(o.b, lambda v, i: v - sv.s[i]) FROM o JOIN sv ON sv.cut = o.cut)),
{name}_fit AS (SELECT cut, b FROM {name} WHERE it = {iterations})"""
