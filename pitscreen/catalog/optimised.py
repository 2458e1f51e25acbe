"""Optimised weights judged by value: the SQL solves the same problems by another way.

The SQL has no eigenvectors. The cleaned correlation needs only the projector on the signal
eigenvalues, which is the matrix sign of (correlation - ceiling), found by Newton's iteration
X <- (3X - X^3) / 2, kept symmetric, as rounding would grow otherwise. Weights are the direction of the least (u'Cu)/2 - 1'u over u >= 0 and, with
sector caps, over sum of a sector <= cap * sum of all; a primal-dual iteration on v = sd * u finds it.
"""

from __future__ import annotations

from pitscreen.catalog.study import METRICS_SQL
from pitscreen.catalog.views import VIEWS

VIEWS["est_returns"] = """
WITH s AS (SELECT formation_year, date, sum(inside::INTEGER) OVER (PARTITION BY formation_year ORDER BY date) AS session,
   sum(inside::INTEGER) OVER (PARTITION BY formation_year) AS sessions FROM est_sessions),
b AS (SELECT s.*, p.ticker, p.adj_close / lag(p.adj_close) OVER (PARTITION BY s.formation_year, p.ticker ORDER BY s.date) - 1 AS r
      FROM s JOIN prices p ON p.date = s.date)
SELECT formation_year, ticker, session::BIGINT AS session, sessions::BIGINT AS sessions,
  (min(session) OVER (PARTITION BY formation_year, ticker))::BIGINT AS first, r FROM b
"""

#: Steps of the sign iteration and of the primal-dual one.
SIGN_STEPS, STEPS = 45, 600


#: Projected gradient steps with the momentum that the least eigenvalue, the noise level, allows.
_FREE = """it AS (SELECT formation_year, book, 0 AS k, list_transform(b, lambda v: 0.0::DOUBLE) AS v, list_transform(b, lambda v: 0.0::DOUBLE) AS z FROM pb
  UNION ALL SELECT formation_year, book, k + 1, nv, list_transform(range(1, n + 1), lambda i: nv[i] + beta * (nv[i] - v[i]))
  FROM (SELECT it.*, pb.n, pb.beta, list_transform(range(1, pb.n + 1), lambda i: greatest(0.0, it.z[i] - (list_dot_product(pb.c[i], it.z) - pb.b[i]) / pb.big)) AS nv
        FROM it JOIN pb ON pb.formation_year = it.formation_year AND pb.book = it.book WHERE it.k < {steps}))"""
#: Primal-dual steps; ``y`` are the prices of the caps.
_CAPPED = """it AS (SELECT formation_year, book, 0 AS k, list_transform(b, lambda v: 0.0::DOUBLE) AS v, list_transform(g, lambda r: 0.0::DOUBLE) AS y FROM pb
  UNION ALL SELECT formation_year, book, k + 1, nv, list_transform(range(1, len(g) + 1), lambda l: greatest(0.0, y[l] + list_dot_product(g[l], list_transform(range(1, n + 1), lambda i: 2 * nv[i] - v[i]))))
  FROM (SELECT it.*, pb.g, pb.n, list_transform(range(1, pb.n + 1), lambda i: greatest(0.0, it.v[i] - pb.tau * (list_dot_product(pb.c[i], it.v) - pb.b[i] + list_dot_product(pb.gt[i], it.y)))) AS nv
        FROM it JOIN pb ON pb.formation_year = it.formation_year AND pb.book = it.book WHERE it.k < {steps}))"""


def solved(baskets: str, capped: bool = False, steps: int = STEPS) -> str:
    """SQL for (formation_year, book, ticker, w): minimum-variance weights of the baskets.

    ``baskets`` is SQL for (formation_year, book, ticker, sector); the sectors matter where caps hold.
    """
    iteration = (_CAPPED if capped else _FREE).format(steps=steps)
    product = "list_transform({0}, lambda left_row: list_transform({1}, lambda right_row: list_dot_product(left_row, right_row)))".format
    return f"""
WITH RECURSIVE n0 AS (SELECT b.formation_year, b.book, b.ticker, any_value(b.sector) AS sector, any_value(e.first) AS first, any_value(e.sessions) AS sessions
  FROM ({baskets}) b JOIN est_returns e ON e.formation_year = b.formation_year AND e.ticker = b.ticker GROUP BY 1, 2, 3),
n1 AS (SELECT *, row_number() OVER g AS i, count(*) OVER (PARTITION BY formation_year, book) AS n, max(first) OVER (PARTITION BY formation_year, book) AS start
  FROM n0 WINDOW g AS (PARTITION BY formation_year, book ORDER BY ticker)),
x AS (SELECT n1.formation_year, n1.book, n1.i, e.session, e.r FROM n1 JOIN est_returns e ON e.formation_year = n1.formation_year AND e.ticker = n1.ticker
  AND e.session > n1.start WHERE e.r IS NOT NULL AND n1.n >= 5),
m AS (SELECT formation_year, book, i, ticker, sector, n, sessions - start AS t, coalesce(s, 0.0) / (sessions - start) AS mean,
   sqrt((coalesce(ss, 0.0) - (sessions - start) * (coalesce(s, 0.0) / (sessions - start)) ** 2) / (sessions - start - 1)) AS sd
  FROM n1 LEFT JOIN (SELECT formation_year, book, i, sum(r) AS s, sum(r * r) AS ss FROM x GROUP BY 1, 2, 3) USING (formation_year, book, i) WHERE n >= 5),
c AS (SELECT a.formation_year, a.book, a.i, b.i AS j, CASE WHEN a.i = b.i THEN 1.0 ELSE (coalesce(s, 0.0) - a.t * a.mean * b.mean) / (a.t - 1) / (a.sd * b.sd) END AS c
  FROM m a JOIN m b ON b.formation_year = a.formation_year AND b.book = a.book LEFT JOIN (
   SELECT p.formation_year, p.book, p.i, q.i AS j, sum(p.r * q.r) AS s FROM x p JOIN x q ON q.formation_year = p.formation_year AND q.book = p.book AND q.session = p.session GROUP BY 1, 2, 3, 4) o
  ON o.formation_year = a.formation_year AND o.book = a.book AND o.i = a.i AND o.j = b.i),
lines AS (SELECT formation_year, book, i, list(c ORDER BY j) AS line FROM c GROUP BY 1, 2, 3),
mat AS (SELECT formation_year, book, list(line ORDER BY i) AS c FROM lines GROUP BY 1, 2),
vec AS (SELECT formation_year, book, list(ticker ORDER BY i) AS tickers, list(sd / avg_sd ORDER BY i) AS sd, list(sector ORDER BY i) AS sectors,
   any_value(n) AS n, any_value(t) AS t FROM (SELECT *, avg(sd) OVER (PARTITION BY formation_year, book) AS avg_sd FROM m) GROUP BY 1, 2),
z0 AS (SELECT formation_year, book, n, c, (1 + sqrt(n / t)) ** 2 AS top FROM mat JOIN vec USING (formation_year, book)),
z1 AS (SELECT *, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j: c[i][j] - CASE WHEN i = j THEN top ELSE 0.0 END)) AS a FROM z0),
sg AS (SELECT formation_year, book, n, 0 AS k, list_transform(a, lambda r: list_transform(r, lambda v: v / list_max(list_transform(a, lambda q: list_sum(list_transform(q, lambda w: abs(w))))))) AS x FROM z1
  UNION ALL SELECT formation_year, book, n, k + 1, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j: 0.75 * (x[i][j] + x[j][i]) - 0.25 * (x3[i][j] + x3[j][i])))
  FROM (SELECT *, {product("x", "x2")} AS x3 FROM (SELECT *, {product("x", "x")} AS x2 FROM sg WHERE k < {SIGN_STEPS}))),
pr AS (SELECT formation_year, book, n, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j:
   CASE WHEN i = j THEN 0.5 ELSE 0.0 END + 0.5 * x[i][j])) AS p FROM sg WHERE k = {SIGN_STEPS}),
pc AS (SELECT formation_year, book, n, p, c, {product("p", "c")} AS pc FROM pr JOIN mat USING (formation_year, book)),
mu AS (SELECT *, n - list_sum(list_transform(range(1, n + 1), lambda i: p[i][i])) AS noise, n - list_sum(list_transform(range(1, n + 1), lambda i: pc[i][i])) AS rest FROM pc),
cl AS (SELECT formation_year, book, CASE WHEN noise > 0.5 THEN rest / noise END AS least, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j:
   pc[i][j] + CASE WHEN noise > 0.5 THEN rest / noise * (CASE WHEN i = j THEN 1.0 ELSE 0.0 END - p[i][j]) ELSE 0.0 END)) AS c FROM mu),
g0 AS (SELECT *, list_sort(list_distinct(sectors)) AS labels FROM vec),
g1 AS (SELECT *, list_transform(labels, lambda l: list_transform(range(1, n + 1), lambda i:
   (CASE WHEN sectors[i] = l THEN 1.0 ELSE 0.0 END - greatest(0.2, 1.0 / len(labels) + 1e-6)) / sd[i])) AS g FROM g0),
lc AS (SELECT *, list_max(list_transform(c, lambda q: list_sum(list_transform(q, lambda w: abs(w))))) AS big FROM cl),
pb AS (SELECT formation_year, book, n, c, g, tickers, sd, list_transform(sd, lambda s: 1.0 / s) AS b,
   list_transform(range(1, n + 1), lambda i: list_transform(g, lambda r: r[i])) AS gt,
   1.0 / (0.5 * big + coalesce(list_sum(list_transform(g, lambda r: list_dot_product(r, r))), 0.0)) AS tau,
   big, (1 - sqrt(coalesce(least, 0.05) / big)) / (1 + sqrt(coalesce(least, 0.05) / big)) AS beta
  FROM g1 JOIN lc USING (formation_year, book)),
{iteration},
u AS (SELECT formation_year, book, unnest(tickers) AS ticker, unnest(list_transform(range(1, pb.n + 1), lambda i: v[i] / sd[i])) AS u FROM it JOIN pb USING (formation_year, book) WHERE k = {steps})
SELECT formation_year, book, ticker, u / sum(u) OVER (PARTITION BY formation_year, book) AS w FROM u
UNION ALL SELECT formation_year, book, ticker, 1.0::DOUBLE / n FROM n1 WHERE n < 5
"""


VIEWS["gmv_weights"] = solved("SELECT formation_year, 'score_GMV' AS book, ticker, NULL::VARCHAR AS sector FROM scored WHERE rank <= 10")
VIEWS["capped_weights"] = solved("""SELECT s.formation_year, 'score_GMVsec' AS book, s.ticker, coalesce(c.sector, 'Unknown') AS sector
  FROM scored s LEFT JOIN sectors c ON c.ticker = s.ticker WHERE rank <= 10""", capped=True, steps=6000)
VIEWS["universe_weights"] = solved("SELECT formation_year, 'universe_GMV' AS book, ticker, NULL::VARCHAR AS sector FROM eligible", steps=400)


def gain_views(name: str, members: str, growth: str) -> None:
    """Views ``<name>_weights`` and ``<name>_gain`` (book, gain): ratio of the optimised book less that of the equal one.

    ``members`` is SQL for (formation_year, book, ticker).
    """
    VIEWS[f"{name}_weights"] = solved(f"SELECT *, NULL::VARCHAR AS sector FROM ({members})")
    VIEWS[f"{name}_gain"] = f"""
WITH p AS (SELECT formation_year, book, ticker, w, 'o' AS kind FROM {name}_weights
  UNION ALL SELECT formation_year, book, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY formation_year, book), 'e' FROM ({members})),
v AS (SELECT p.kind, p.book, p.formation_year, g.date, sum(p.w * g.g) AS value FROM p JOIN {growth} g
  ON g.formation_year = p.formation_year AND g.ticker = p.ticker GROUP BY ALL),
d AS (SELECT *, value / coalesce(lag(value) OVER (PARTITION BY kind, book, formation_year ORDER BY date), 1.0) - 1 AS r FROM v),
m AS ({METRICS_SQL.format(by="kind, book", src="d")})
SELECT o.book, o.sharpe - e.sharpe AS gain FROM m o JOIN m e ON e.book = o.book AND o.kind = 'o' AND e.kind = 'e'"""


def placed(name: str) -> str:
    """SQL of the gain of the book ``score`` among those of all other books."""
    return f"""
SELECT 'GMV' AS construction, round(s.gain, 6) AS D_score, round(avg(CASE WHEN g.gain < s.gain THEN 1.0 ELSE 0.0 END), 6) AS percentile,
 count(*) AS n_draws, round(avg(g.gain), 6) AS random_mean, round(stddev_pop(g.gain), 6) AS random_std, round(stddev_samp(g.gain), 6) AS random_std_sample,
 round(avg(CASE WHEN g.gain >= s.gain THEN 1.0 ELSE 0.0 END), 6) AS p_value, avg(CASE WHEN g.gain >= s.gain THEN 1.0 ELSE 0.0 END) < 0.05 AS significant
FROM {name}_gain s JOIN {name}_gain g ON s.book = 'score' AND g.book <> 'score' GROUP BY s.gain"""


gain_views("study_pair", "SELECT formation_year, 'score' AS book, ticker FROM scored WHERE rank <= 10 "
           "UNION ALL SELECT formation_year, 'd' || draw, ticker FROM random_draws", "growth")
gain_views("grid_pair", "SELECT formation_year, 'score' AS book, ticker FROM eligible WHERE rank <= 10 "
           "UNION ALL SELECT formation_year, 'd' || draw, ticker FROM grid_draws", "grid_growth")
gain_views("swept", "SELECT formation_year, 'k' || k AS book, ticker FROM eligible, (SELECT unnest([8, 10]) AS k) WHERE rank <= k", "grid_growth")
