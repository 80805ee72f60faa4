"""SQL of trees grown by one aggregate per level, and of rows routed through them."""

from __future__ import annotations

from catalog.common import COMMENTS_SQL, draw_sql
from catalog.texts import DIMS, WORDS_SQL, _sentiment_sql
from textpulse.operators.trees import GAIN_DIGITS, SAMPLE_ROWS

SEED = 1
LOG_SQL = 'CASE WHEN "recommandations" = 0 THEN -1.0 ELSE log10("recommandations") END'


def features_sql(labelled: bool) -> str:
    """feat (key, y, label, x): comments, all or the labelled ones, with a positive group total and their features."""
    source = 'SELECT "commentID" AS doc_id, "commentBody" AS text, * FROM comments' + (' WHERE "editorsSelection" IS NOT NULL' if labelled else "")
    words = WORDS_SQL.replace("FROM documents", "FROM chosen")
    moods, final = _sentiment_sql().replace("FROM documents", "FROM chosen").replace("WITH ", "", 1).rsplit("\nSELECT ", 1)
    return f"""{COMMENTS_SQL}, chosen AS MATERIALIZED ({source}), {words},
    moods AS MATERIALIZED (WITH {moods} SELECT {final}),
    hit AS (SELECT doc_id, tfidf, vector FROM post JOIN wv USING (term)),
    flat AS (SELECT doc_id, generate_subscripts(vector, 1) - 1 AS dim, tfidf, unnest(vector) AS x FROM hit),
    mean AS (SELECT doc_id, dim, sum(tfidf * x) / nullif(sum(tfidf), 0) AS value FROM flat GROUP BY 1, 2),
    vec AS (SELECT doc_id, list(round(coalesce(value, 0), 6) + 0.0 ORDER BY g.dim) AS v FROM chosen CROSS JOIN range({DIMS}) g(dim) LEFT JOIN mean USING (doc_id, dim) GROUP BY 1),
    sums AS (SELECT "articleID", sum("recommandations") AS total FROM chosen GROUP BY 1 HAVING sum("recommandations") > 0),
    shares AS (SELECT *, "recommandations"::DOUBLE / total AS share FROM chosen JOIN sums USING ("articleID")),
    feat AS MATERIALIZED (SELECT "commentID" AS key, {LOG_SQL} AS log_value, "editorsSelection"::INTEGER::DOUBLE AS label,
      list_concat(v, [positive, negative, neutral, "articleWordCount", "printPage",
        CASE WHEN "recommandations" = 0 THEN 0 WHEN "recommandations" <= 1 THEN 1 WHEN "recommandations" <= 10 THEN 2 WHEN "recommandations" <= 100 THEN 3 ELSE 4 END,
        CASE WHEN share = 0 THEN 0 WHEN share <= 0.01 THEN 1 WHEN share <= 0.1 THEN 2 WHEN share <= 0.5 THEN 3 ELSE 4 END]::DOUBLE[]) AS x
      FROM shares JOIN vec USING (doc_id) JOIN moods USING (doc_id))"""


def _impurity(n: str, s: str, q: str, classes: bool) -> str:
    mean = f"(({s}) / ({n}))"
    return f"(2 * {mean} * (1 - {mean}))" if classes else f"greatest(({q}) / ({n}) - {mean} * {mean}, 0.0)"


def grown_sql(train: str, target: str, width: int, classes: bool, depth: int, bins: int, categories: int, least: int) -> str:
    """nodes, from feat's rows where train holds."""
    parts = [
        f"tr AS MATERIALIZED (SELECT key, ({target})::DOUBLE AS y, x[1:{width}] AS x FROM feat WHERE {train})",
        "cells AS MATERIALIZED (SELECT key, y, generate_subscripts(x, 1) - 1 AS feature, unnest(x) AS v FROM tr)",
        f"smp AS (SELECT feature, list_sort(list(v)) AS xs FROM cells WHERE {draw_sql('key', 'bins', SEED)} < least(1.0, {SAMPLE_ROWS}.0::DOUBLE / (SELECT count(*) FROM tr)) GROUP BY 1)",
        f"""kinds AS MATERIALIZED (SELECT feature, CASE WHEN len(list_distinct(xs)) <= {categories} THEN 'category' ELSE 'number' END AS kind,
        list_sort(list_distinct(CASE WHEN len(list_distinct(xs)) <= {categories} THEN xs ELSE [xs[ceil(len(xs) * i / {bins}.0::DOUBLE)::INTEGER] for i in range(1, {bins})] END)) AS edges FROM smp)""",
        """binned AS MATERIALIZED (SELECT key, y, feature, kind, CASE WHEN kind = 'number' THEN len(list_filter(edges, lambda e: e < v)) ELSE coalesce(list_position(edges, v), 0) - 1 END AS bin
        FROM cells JOIN kinds USING (feature))""",
        "n0 AS (SELECT key, 1::BIGINT AS node FROM tr)",
    ]
    for level in range(depth + 1):
        whole, left = _impurity("tn", "ts", "tq", classes), _impurity("ln", "ls", "lq", classes)
        right = _impurity("tn - ln", "ts - ls", "tq - lq", classes)
        split = "gain > 0" if level < depth else "false"
        parts += [
            f"st{level} AS (SELECT node, feature, kind, bin, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM binned JOIN n{level} USING (key) GROUP BY ALL)",
            f"""cu{level} AS (SELECT node, feature, kind, bin, sum(n) OVER u AS ln, sum(s) OVER u AS ls, sum(q) OVER u AS lq, sum(n) OVER b AS tn, sum(s) OVER b AS ts, sum(q) OVER b AS tq,
            list(bin) OVER u AS side FROM (SELECT *, CASE WHEN kind = 'category' THEN round(s / n, {GAIN_DIGITS}) ELSE bin::DOUBLE END AS place FROM st{level})
            WINDOW u AS (PARTITION BY node, feature ORDER BY place, bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY node, feature))""",
            f"""be{level} AS MATERIALIZED (SELECT * FROM (SELECT *, {whole} AS impurity, CASE WHEN ln >= {least} AND tn - ln >= {least}
            THEN round({whole} - ln / tn * {left} - (tn - ln) / tn * {right}, {GAIN_DIGITS}) END AS gain FROM cu{level})
            QUALIFY row_number() OVER (PARTITION BY node ORDER BY coalesce(gain, -1) DESC, feature, ln, bin) = 1)""",
            f"""no{level} AS (SELECT node, {level} AS depth, {split} AS splits, feature, kind, bin, side, edges, tn::BIGINT AS n, {"CASE WHEN ts / tn > 0.5 THEN 1.0 ELSE 0.0 END" if classes else "ts / tn"} AS prediction, impurity, gain
            FROM be{level} JOIN (SELECT feature, edges FROM kinds) USING (feature))""",
        ]
        if level < depth:
            parts.append(
                f"""n{level + 1} AS MATERIALIZED (SELECT r.key, 2 * r.node + CASE WHEN CASE WHEN p.kind = 'number' THEN c.bin <= p.bin ELSE list_contains(p.side, c.bin) END THEN 0 ELSE 1 END AS node
                FROM n{level} r JOIN no{level} p ON r.node = p.node AND p.splits JOIN binned c ON c.key = r.key AND c.feature = p.feature)"""
            )
    every = " UNION ALL ".join(f"SELECT * FROM no{level}" for level in range(depth + 1))
    parts.append(
        f"""nodes AS MATERIALIZED (SELECT node, depth, CASE WHEN splits THEN feature END AS feature, CASE WHEN splits THEN kind END AS kind, CASE WHEN splits AND kind = 'number' THEN edges[bin + 1] END AS threshold,
        CASE WHEN splits AND kind = 'category' THEN [edges[i + 1] for i in list_sort(side) if i >= 0] END AS categories, CASE WHEN splits AND kind = 'category' THEN edges END AS known,
        CASE WHEN splits AND kind = 'category' THEN list_contains(side, -1) END AS other, n, prediction, impurity, CASE WHEN splits THEN gain END AS gain FROM ({every}))"""
    )
    return ",\n".join(parts)


def routed_sql(rows: str, width: int, depth: int) -> str:
    """routed: the rows (key, x, ...) with leaf and prediction."""
    parts = [f"r0 AS (SELECT *, 1::BIGINT AS node FROM {rows})"]
    for level in range(depth):
        parts.append(
            f"""r{level + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node), CASE WHEN p.feature IS NULL THEN r.node ELSE 2 * r.node + CASE WHEN CASE WHEN p.kind = 'number' THEN r.x[p.feature + 1] <= p.threshold
            ELSE list_contains(p.categories, r.x[p.feature + 1]) OR (p.other AND NOT list_contains(p.known, r.x[p.feature + 1])) END THEN 0 ELSE 1 END END AS node
            FROM r{level} r JOIN nodes p USING (node))"""
        )
    parts.append(f"routed AS MATERIALIZED (SELECT r.* EXCLUDE (node), node AS leaf, prediction FROM r{depth} r JOIN nodes USING (node))")
    return ",\n".join(parts)


def names_sql(width: int) -> str:
    rest = ["positive", "negative", "neutral", "articleWordCount", "printPage", "count_class", "share_class"]
    names = [f"text_vector[{i}]" for i in range(DIMS)] + rest
    return "names(feature, name) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(names[:width])) + ")"


NODES_SQL = """SELECT node, depth::INTEGER AS depth, coalesce(feature, -1)::INTEGER AS feature, kind, round(threshold, 6) AS threshold,
  array_to_string([printf('%.6f', c) for c in categories], ', ') AS categories, n, round(prediction, 6)::DOUBLE AS prediction, round(impurity, 6) AS impurity, round(gain, 6) AS gain FROM nodes"""
TEXT_SQL = """SELECT (row_number() OVER (ORDER BY node * pow(2.0, (SELECT max(depth) FROM nodes) - depth), depth) - 1)::INTEGER AS line,
  repeat('  ', depth) || CASE WHEN node > 1 AND node % 2 = 1 THEN 'else ' ELSE '' END || CASE WHEN feature IS NULL THEN printf('predict %.6f (n %d)', prediction, n)
  ELSE 'if ' || name || CASE WHEN kind = 'number' THEN printf(' <= %.6f', threshold) ELSE ' in ' || array_to_string([printf('%.6f', c) for c in categories], ', ') END || printf(' (n %d)', n) END AS text
  FROM nodes LEFT JOIN names USING (feature)"""
IMPORTANCES_SQL = """SELECT feature::INTEGER AS feature, name, round(sum(gain * n) / (SELECT sum(gain * n) FROM nodes WHERE feature IS NOT NULL), 6) AS importance
  FROM nodes JOIN names USING (feature) GROUP BY 1, 2"""

REBALANCED = f"(label = 1 OR {draw_sql('key', 'rebalance', SEED)} < 0.2)"
TRAINS = f"{draw_sql('key', 'split', SEED)} < 0.7"
CLASS_WIDTH, NUMBER_WIDTH = DIMS + 7, DIMS + 4
CLASS_TREE_SQL = f"""WITH {features_sql(True)},
{grown_sql(f"{REBALANCED} AND {TRAINS}", "label", CLASS_WIDTH, True, 5, 32, 10, 1)}, {names_sql(CLASS_WIDTH)}"""
CLASS_ROUTED_SQL = f"""{CLASS_TREE_SQL}, test AS (SELECT * FROM feat WHERE {REBALANCED} AND NOT ({TRAINS})),
{routed_sql("test", CLASS_WIDTH, 5)}"""
NUMBER_TREE_SQL = f"""WITH {features_sql(False)},
{grown_sql(TRAINS, "log_value", NUMBER_WIDTH, False, 5, 64, 60, 2)}, {names_sql(NUMBER_WIDTH)}"""
NUMBER_ROUTED_SQL = f"""{NUMBER_TREE_SQL}, test AS (SELECT * FROM feat WHERE NOT ({TRAINS})),
{routed_sql("test", NUMBER_WIDTH, 5)}"""
