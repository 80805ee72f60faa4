"""SQL of the subspace iteration: the same start block, rounds, Gram matrices and small eigenproblem as the operator."""

from __future__ import annotations

from catalog.common import STOP_SQL, TOKENS_SQL
from textpulse.operators.embeddings import MIN_LSA_TOKENS
from textpulse.operators.lsa import CONCEPTS
from textpulse.operators.subspace import OVERSAMPLE, ROUNDS, STEPS

WIDTH = CONCEPTS + OVERSAMPLE

POSTINGS_SQL = f"""raw AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents),
tok AS (SELECT doc_id, term FROM raw WHERE length(term) > 2 AND term NOT IN {STOP_SQL}),
kept AS MATERIALIZED (SELECT doc_id FROM tok GROUP BY 1 HAVING count(*) > {MIN_LSA_TOKENS}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok JOIN kept USING (doc_id) GROUP BY 1, 2),
len AS (SELECT doc_id, sum(tf) AS n_terms FROM tf GROUP BY 1), freq AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
nd AS (SELECT count(*) AS nn FROM kept),
best AS MATERIALIZED (SELECT term, ln(nn / df) AS idf FROM freq, nd ORDER BY df DESC, term LIMIT 1000),
p AS MATERIALIZED (SELECT doc_id AS d, term AS t, tf / n_terms * idf AS w FROM tf JOIN best USING (term) JOIN len USING (doc_id))"""


def gram_sql(name: str, block: str, key: str) -> str:
    """One row, g: the Gram matrix of a block (key, c, x) as a list of rows."""
    return f"""{name} AS MATERIALIZED (SELECT list(r ORDER BY i) AS g FROM (SELECT i, list(s ORDER BY j) AS r FROM (
  SELECT a.c AS i, b.c AS j, sum(a.x * b.x) AS s FROM {block} a JOIN {block} b USING ({key}) GROUP BY 1, 2) GROUP BY i))"""


def orthonormal_sql(name: str, block: str, gram: str) -> str:
    """The block times the columns w with w' g w = 1, one more column in each step."""
    places = f"range(1, {WIDTH + 1})"
    return f"""w_{name} AS (SELECT 0 AS j, []::DOUBLE[][] AS w UNION ALL
  SELECT j + 1, list_append(w, list_transform(u, lambda x: CASE WHEN q > 1e-12 * g[j + 1][j + 1] THEN x / sqrt(q) ELSE 0.0 END)) FROM (
    SELECT *, list_sum(list_transform({places}, lambda m: u[m] * list_inner_product(g[m], u))) AS q FROM (
      SELECT j, w, g, list_transform({places}, lambda m: (CASE WHEN m = j + 1 THEN 1.0 ELSE 0.0 END)::DOUBLE
        - coalesce(list_sum(list_transform(w, lambda x: list_inner_product(x, g[j + 1]) * x[m])), 0)) AS u
      FROM w_{name}, {gram} WHERE j < {WIDTH}))),
f_{name} AS MATERIALIZED (SELECT a.i, b.c, w[b.c + 1][a.i + 1] AS f FROM (SELECT w FROM w_{name} WHERE j = {WIDTH}), range({WIDTH}) a(i), range({WIDTH}) b(c)),
{name} AS MATERIALIZED (SELECT t, f.c, sum(z.x * f.f) AS x FROM {block} z JOIN f_{name} f ON z.c = f.i GROUP BY 1, 2)"""


def eigen_sql() -> str:
    """One row, q: the eigenvectors of the matrix in gy, by orthogonal iteration; a step works out one vector."""
    unit = ", ".join("[" + ", ".join("1.0" if i == j else "0.0" for i in range(WIDTH)) + "]" for j in range(WIDTH))
    return f"""e AS (SELECT 0 AS n, [{unit}]::DOUBLE[][] AS q, []::DOUBLE[][] AS done UNION ALL
  SELECT n + 1, CASE WHEN n % {WIDTH} = {WIDTH - 1} THEN now ELSE q END, CASE WHEN n % {WIDTH} = {WIDTH - 1} THEN []::DOUBLE[][] ELSE now END FROM (
    SELECT n, q, list_append(done, list_transform(u, lambda x: CASE WHEN len2 > 0 THEN x / sqrt(len2) ELSE 0.0 END)) AS now FROM (
      SELECT *, list_inner_product(u, u) AS len2 FROM (
        SELECT n, q, done, list_transform(range(1, {WIDTH + 1}), lambda m: y[m] - coalesce(list_sum(list_transform(done, lambda x: list_inner_product(x, y) * x[m])), 0)) AS u FROM (
          SELECT n, q, done, list_transform(g, lambda r: list_inner_product(r, q[n % {WIDTH} + 1])) AS y FROM e, gy WHERE n < {WIDTH * STEPS}))))),
es AS MATERIALIZED (SELECT q, list_transform(q, lambda x: list_inner_product(x, list_transform(g, lambda r: list_inner_product(r, x)))) AS ls FROM e, gy WHERE n = {WIDTH * STEPS}),
sorted AS (SELECT j, ls[j + 1] AS l, row_number() OVER (ORDER BY ls[j + 1] DESC, j) - 1 AS c FROM es, range({WIDTH}) r(j)),
turn AS MATERIALIZED (SELECT c, i.i, q[j + 1][i.i + 1] AS f, l FROM es, sorted, range({WIDTH}) i(i) WHERE c < {CONCEPTS})"""


def factors_sql(postings: str = POSTINGS_SQL) -> str:
    """All steps from p (d, t, w) up to v (t, c, x), u (d, c, x) and s (c, s)."""
    parts = [postings]
    start = "('0x' || substr(md5(t || ':start' || c || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE - 0.5"
    parts.append(f"z0 AS MATERIALIZED (SELECT t, c, {start} AS x FROM (SELECT DISTINCT t FROM p), range({WIDTH}) r(c))")
    for r in range(ROUNDS + 1):
        parts += [gram_sql(f"g{r}", f"z{r}", "t"), orthonormal_sql(f"v{r}", f"z{r}", f"g{r}")]
        parts.append(f"y{r} AS MATERIALIZED (SELECT d, c, sum(w * x) AS x FROM p JOIN v{r} USING (t) GROUP BY 1, 2)")
        if r < ROUNDS:
            parts.append(f"z{r + 1} AS MATERIALIZED (SELECT t, c, sum(w * x) AS x FROM p JOIN y{r} USING (d) GROUP BY 1, 2)")
    last = ROUNDS
    parts += [gram_sql("gy", f"y{last}", "d"), eigen_sql()]
    parts.append("s AS (SELECT DISTINCT c, sqrt(l) AS s FROM turn)")
    parts.append(f"vq AS MATERIALIZED (SELECT t, turn.c, sum(b.x * f) AS x FROM v{last} b JOIN turn ON b.c = turn.i GROUP BY 1, 2)")
    parts.append("sign AS (SELECT c, CASE WHEN arg_max(x, abs(x)) >= 0 THEN 1 ELSE -1 END AS g FROM vq GROUP BY 1)")
    parts.append("v AS MATERIALIZED (SELECT t, c, x * g AS x FROM vq JOIN sign USING (c))")
    parts.append(f"u AS MATERIALIZED (SELECT d, turn.c, sum(b.x * f) * any_value(g) / sqrt(any_value(l)) AS x FROM y{last} b JOIN turn ON b.c = turn.i JOIN sign ON sign.c = turn.c GROUP BY 1, 2)")
    return "WITH RECURSIVE " + ",\n".join(parts)


def top_sql(factor: str, key: str, name: str) -> str:
    return f"""{factors_sql()}, ranked AS (SELECT c, {key}, round(x, 9) AS x, row_number() OVER (PARTITION BY c ORDER BY round(x, 9) DESC, {key}) AS rank FROM {factor})
    SELECT c::INTEGER AS concept, rank::INTEGER AS rank, {key} AS {name}, round(x, 6) AS weight FROM ranked WHERE rank <= 10"""


LIKE_SQL = f"""{factors_sql()}, us AS (SELECT d, list(x * s ORDER BY c) AS v FROM u JOIN s USING (c) GROUP BY 1),
unit AS (SELECT d, [x / nullif(sqrt(list_inner_product(v, v)), 0) for x in v] AS v FROM us),
scored AS (SELECT e.d, round(list_inner_product(e.v, q.v), 9) AS score FROM unit e, (SELECT v FROM unit WHERE d = 1) q)
SELECT d AS doc_id, round(score, 6) AS score FROM scored WHERE score IS NOT NULL ORDER BY scored.score DESC, d LIMIT 10"""
