"""Projections, samples, joins, aggregates and tests over the relational tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.common import ARTICLES_SQL, COMMENTS_SQL, articles, comments, draw_sql, rounded, table
from textpulse.functions.engagement import flag_double, flag_int
from textpulse.functions.names import parse_byline, parse_keywords
from textpulse.functions.tokens import only_letters
from textpulse.operators import factors, numbering, profiles, sampling, sketches
from textpulse.operators.engagement import group_totals, normalise_in_group, positive_totals
from textpulse.operators.histogram import equal_width_histogram
from textpulse.operators.joins import name_rows
from textpulse.operators.learning import class_scores, confusion_matrix, rmse
from textpulse.operators.tests_stat import anova, chi_square, contingency
from textpulse.operators.unnest import unnest
from textpulse.plans import reports
from textpulse.session import stage

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


def _reviewed(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")


def _flag_text(df, name):
    """A flag that may be null as text, so that both engines hand over the same type."""
    return df.withColumn(name, F.col(name).cast("string"))


# --- engagement ----------------------------------------------------------------------------------

NORMALISED_SQL = """totals AS (SELECT l_orderkey, sum(l_quantity) AS group_total FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 0),
normalised AS (SELECT l_orderkey, l_linenumber, l_quantity, group_total, l_quantity / group_total AS share,
    CASE WHEN l_quantity = 0 THEN -1 ELSE log10(l_quantity) END AS log_value,
    CASE WHEN l_quantity = 0 THEN 0 WHEN l_quantity <= 1 THEN 1 WHEN l_quantity <= 10 THEN 2 WHEN l_quantity <= 100 THEN 3 ELSE 4 END AS count_class
  FROM lineitem JOIN totals USING (l_orderkey)),
classed AS (SELECT *, CASE WHEN share = 0 THEN 0 WHEN share <= 0.01 THEN 1 WHEN share <= 0.1 THEN 2 WHEN share <= 0.5 THEN 3 ELSE 4 END AS share_class FROM normalised)"""


@query(
    "engagement_normalised",
    f"""WITH {NORMALISED_SQL} SELECT l_orderkey, l_linenumber, l_quantity, group_total, round(share, 6) AS share,
    round(log_value, 6) AS log_value, count_class, share_class FROM classed""",
)
def engagement_normalised(spark, d):
    return rounded(normalise_in_group(_lines(spark, d), "l_orderkey", "l_quantity"), "share", "log_value")


@query(
    "engagement_class_counts",
    f"""WITH {NORMALISED_SQL} SELECT count_class, share_class, count(*) AS n FROM classed GROUP BY 1, 2""",
)
def engagement_class_counts(spark, d):
    rows = normalise_in_group(_lines(spark, d), "l_orderkey", "l_quantity")
    return rows.groupBy("count_class", "share_class").agg(F.count(F.lit(1)).alias("n"))


@query("group_totals", "SELECT l_suppkey, sum(l_quantity) AS group_total, count(*) AS n FROM lineitem GROUP BY 1")
def group_totals_query(spark, d):
    return group_totals(table(spark, d, "lineitem"), "l_suppkey", "l_quantity")


@query(
    "positive_group_totals",
    """SELECT c_nationkey, round(sum(c_acctbal - 4500), 2) AS group_total, count(*) AS n FROM customer GROUP BY 1
    HAVING sum(c_acctbal - 4500) > 0""",
)
def positive_group_totals(spark, d):
    balance = table(spark, d, "customer").withColumn("over", F.col("c_acctbal") - 4500)
    return rounded(positive_totals(balance, "c_nationkey", "over"), "group_total", digits=2)


TARGET_SUMMARY_SQL = f"""WITH {NORMALISED_SQL},
long AS (SELECT 'l_quantity' AS "column", l_quantity AS v FROM classed UNION ALL SELECT 'share', share FROM classed
  UNION ALL SELECT 'log_value', log_value FROM classed)
SELECT "column", count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stddev, round(min(v), 6) AS min,
  round(quantile_disc(v, 0.25), 6) AS q25, round(quantile_disc(v, 0.5), 6) AS q50, round(quantile_disc(v, 0.75), 6) AS q75, round(max(v), 6) AS max
FROM long GROUP BY 1"""


def _holds(ranked):
    """Does the asked rank lie within the sketch's error of the ranks that the told value has?"""
    bound = sketches.rank_error()
    return (F.col("below") <= F.col("prob") + bound) & (F.col("upto") >= F.col("prob") - bound)


@query("target_summary", TARGET_SUMMARY_SQL)
def target_summary(spark, d):
    rows = reports.target_report(_lines(spark, d), "l_orderkey", "l_quantity")["rows"]
    out = profiles.numeric_describe(rows, ["l_quantity", "share", "log_value"], linear=False)
    return rounded(out, "mean", "stddev", "min", "q25", "q50", "q75", "max")


SKETCH_PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


@query(
    "merged_quantile_sketches",
    f"""SELECT l_returnflag, prob::DOUBLE AS prob, count(*) AS n, true AS holds, count(DISTINCT l_linenumber || l_linestatus) AS n_merged FROM lineitem, (SELECT unnest({SKETCH_PROBS}) AS prob) GROUP BY 1, 2""",
)
def merged_quantile_sketches(spark, d):
    """Sketches per flag, status and line number are stored, then merged per flag; ranks of the told prices against exact ones."""
    lines = table(spark, d, "lineitem")
    kept = stage(sketches.quantile_sketches(lines, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_extendedprice"), "sketches")
    told = sketches.sketch_quantiles(sketches.merge_sketches(kept, ["l_returnflag"]), ["l_returnflag"], SKETCH_PROBS)
    ranked = sketches.exact_ranks(lines, ["l_returnflag"], "l_extendedprice", told)
    merged = kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_merged"))
    return ranked.join(merged, "l_returnflag").select("l_returnflag", "prob", "n", _holds(ranked).alias("holds"), "n_merged")


@query("row_numbers", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS number FROM lineitem")
def row_numbers(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return numbering.row_numbers(lines, ["l_shipdate", "l_orderkey", "l_linenumber"], "number").drop("l_shipdate")


def _histogram_sql(source: str, value: str, prefix: str = "") -> str:
    with_ = f"WITH {prefix}, " if prefix else "WITH "
    return f"""{with_}vals AS (SELECT CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL),
ends AS (SELECT min(v) AS lo, max(v) AS hi FROM vals),
cnt AS (SELECT CAST(least(floor((v - lo) / (hi - lo) * 20), 19) AS INTEGER) + 1 AS bin, count(*) AS n FROM vals, ends GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + (g.bin - 1) * (hi - lo) / 20, 6) AS edge, coalesce(n, 0) AS n
FROM range(1, 21) AS g(bin) CROSS JOIN ends LEFT JOIN cnt ON cnt.bin = g.bin"""


@query("histogram_log_value", _histogram_sql("classed", "log_value", NORMALISED_SQL))
def histogram_log_value(spark, d):
    return rounded(reports.target_report(_lines(spark, d), "l_orderkey", "l_quantity")["histogram_log"], "edge")


@query("histogram_share", _histogram_sql("classed", "share", NORMALISED_SQL))
def histogram_share(spark, d):
    return rounded(reports.target_report(_lines(spark, d), "l_orderkey", "l_quantity")["histogram_share"], "edge")


@query("histogram_quantity", _histogram_sql("lineitem", "l_quantity"))
def histogram_quantity(spark, d):
    return rounded(equal_width_histogram(table(spark, d, "lineitem"), "l_quantity"), "edge")


@query("histogram_chars", _histogram_sql("documents", "n_chars"))
def histogram_chars(spark, d):
    return rounded(equal_width_histogram(table(spark, d, "documents"), "n_chars"), "edge")


# --- projections, filters, samples ---------------------------------------------------------------


@query(
    "event_flags",
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS flag_int,
    CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag_double FROM events WHERE event_type <> 'error'""",
)
def event_flags(spark, d):
    bought = F.col("event_type") == "purchase"
    rows = table(spark, d, "events").where(F.col("event_type") != "error")
    return rows.select("event_id", flag_int(bought).alias("flag_int"), flag_double(bought).alias("flag_double"))


@query("bernoulli_sample", f"""SELECT event_id, event_type FROM events WHERE {draw_sql("event_id", "sample", 7)} < 0.2""")
def bernoulli_sample(spark, d):
    return sampling.bernoulli_sample(table(spark, d, "events"), 0.2, "event_id", 7).select("event_id", "event_type")


@query(
    "class_rebalance",
    f"""WITH {COMMENTS_SQL} SELECT "commentID", "editorsSelection"::VARCHAR AS selected FROM comments
    WHERE coalesce("editorsSelection", false) OR {draw_sql('"commentID"', "rebalance", 7)} < 0.2""",
)
def class_rebalance(spark, d):
    rows = comments(spark, d)
    kept = sampling.rebalance(rows, F.col("editorsSelection"), 0.2, "commentID", 7)
    return kept.select("commentID", F.col("editorsSelection").cast("string").alias("selected"))


@query(
    "sample_of_groups",
    f"""WITH flags AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_set FROM lineitem GROUP BY 1),
    drawn AS (SELECT * FROM flags WHERE {draw_sql("l_orderkey", "group", 3)} < CASE WHEN any_set THEN 0.1 ELSE 0.02 END)
    SELECT l_orderkey, l_linenumber, l_quantity, any_set FROM lineitem JOIN drawn USING (l_orderkey)""",
)
def sample_of_groups(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    out = sampling.sample_by_group(rows, "l_orderkey", F.col("l_returnflag") == "R", 0.1, 0.02, 3)
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "any_set")


@query("group_any_flag", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_set, count(*) AS n FROM lineitem GROUP BY 1")
def group_any_flag(spark, d):
    return sampling.group_flag(table(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R")


@query(
    "random_preview",
    f"""SELECT o_orderkey, o_totalprice FROM orders ORDER BY {draw_sql("o_orderkey", "preview", 5)}, o_orderkey LIMIT 20""",
)
def random_preview(spark, d):
    return sampling.random_preview(table(spark, d, "orders"), 20, "o_orderkey", 5).select("o_orderkey", "o_totalprice")


@query("table_shape", "SELECT count(*) AS n, 6 AS n_columns FROM orders")
def table_shape(spark, d):
    return profiles.shape(table(spark, d, "orders"))


@query(
    "train_test_parts",
    f"""SELECT CASE WHEN {draw_sql("doc_id", "split", 11)} < 0.7 THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(n_chars)::BIGINT AS chars
    FROM documents GROUP BY 1""",
)
def train_test_parts(spark, d):
    train, test = sampling.random_split(table(spark, d, "documents"), "doc_id", 11)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


# --- joins ---------------------------------------------------------------------------------------


@query(
    "name_lookup",
    """SELECT n_name, n_orders FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    JOIN nation USING (n_nationkey)""",
)
def name_lookup(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    # Orders of a customer are counted before the join, so that no customer is a hot key.
    per_customer = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    counted = per_customer.join(customers, "o_custkey").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("n").alias("n_orders"))
    return name_rows(counted, table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("n_name", "n_orders")


# --- counts and profiles -------------------------------------------------------------------------


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, d):
    return profiles.row_count(table(spark, d, "lineitem"))


@query("category_counts", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def category_counts(spark, d):
    return profiles.category_counts(table(spark, d, "events"), "event_type")


@query("distinct_values", "SELECT DISTINCT p_type FROM part")
def distinct_values(spark, d):
    return profiles.distinct_values(table(spark, d, "part"), "p_type")


@query(
    "article_category_counts",
    f"""WITH {ARTICLES_SQL}
    SELECT 'documentType' AS variable, "documentType" AS value, count(*) AS n FROM articles GROUP BY 1, 2
    UNION ALL SELECT 'newDesk', "newDesk", count(*) FROM articles GROUP BY 1, 2
    UNION ALL SELECT 'sectionName', "sectionName", count(*) FROM articles GROUP BY 1, 2
    UNION ALL SELECT 'source', "source", count(*) FROM articles GROUP BY 1, 2
    UNION ALL SELECT 'typeOfMaterial', "typeOfMaterial", count(*) FROM articles GROUP BY 1, 2""",
)
def article_category_counts(spark, d):
    report = reports.article_report(articles(spark, d))
    parts = [report[f"counts_{c}"].select(F.lit(c).alias("variable"), "value", "n") for c in reports.ARTICLE_CATEGORIES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Trailing separators are cut, as trailing empty names are.
AUTHORS_SQL = """names AS (SELECT trim(unnest(string_split_regex(regexp_replace(regexp_replace("byline", '^By ', ''), '(,|( and ))+$', ''), ',|( and )'))) AS value FROM articles)"""


@query("author_counts", f"WITH {ARTICLES_SQL}, {AUTHORS_SQL} SELECT value, count(*) AS n FROM names GROUP BY 1")
def author_counts(spark, d):
    return reports.article_report(articles(spark, d))["authors"]


@query("author_number", f"WITH {ARTICLES_SQL}, {AUTHORS_SQL} SELECT count(DISTINCT value) AS n FROM names")
def author_number(spark, d):
    return reports.article_report(articles(spark, d))["author_number"]


@query(
    "bylines_parsed",
    f"""WITH {ARTICLES_SQL}, {AUTHORS_SQL.replace("SELECT trim", 'SELECT "articleID", trim')}
    SELECT "articleID", value FROM names""",
)
def bylines_parsed(spark, d):
    return unnest(articles(spark, d), ["articleID"], parse_byline("byline"), "value")


KEYWORDS_SQL = """words AS (SELECT "articleID", trim(replace(unnest(string_split(regexp_replace(regexp_replace("keywords", '^\\[', ''), '\\]$', ''), ''', ''')), '''', '')) AS value FROM articles)"""


@query("keyword_counts", f"WITH {ARTICLES_SQL}, {KEYWORDS_SQL} SELECT value, count(*) AS n FROM words WHERE value <> '' GROUP BY 1")
def keyword_counts(spark, d):
    return reports.article_report(articles(spark, d))["keywords"]


@query("keyword_number", f"WITH {ARTICLES_SQL}, {KEYWORDS_SQL} SELECT count(DISTINCT value) AS n FROM words WHERE value <> ''")
def keyword_number(spark, d):
    return reports.article_report(articles(spark, d))["keyword_number"]


@query("keywords_parsed", f"""WITH {ARTICLES_SQL}, {KEYWORDS_SQL} SELECT "articleID", value FROM words""")
def keywords_parsed(spark, d):
    return unnest(articles(spark, d), ["articleID"], parse_keywords("keywords"), "value")


@query(
    "letters_only",
    r"""SELECT regexp_matches(p_name, '^\p{L}*$') AS all_letters, regexp_matches(p_type, '^\p{L}*$') AS type_letters, count(*) AS n FROM part GROUP BY 1, 2""",
)
def letters_only(spark, d):
    rows = table(spark, d, "part").select(only_letters("p_name").alias("all_letters"), only_letters("p_type").alias("type_letters"))
    return rows.groupBy("all_letters", "type_letters").agg(F.count(F.lit(1)).alias("n"))


@query(
    "measure_describe",
    f"""WITH {ARTICLES_SQL}, long AS (SELECT 'articleWordCount' AS "column", "articleWordCount"::DOUBLE AS v FROM articles UNION ALL SELECT 'printPage', "printPage" FROM articles)
    SELECT "column", count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stddev, min(v) AS min, max(v) AS max FROM long GROUP BY 1""",
)
def measure_describe(spark, d):
    return rounded(reports.article_report(articles(spark, d))["describe"], "mean", "stddev")


PROFILE_SQL = """count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS stddev, min({v})::DOUBLE AS min,
 quantile_disc({v}, 0.25)::DOUBLE AS q25, quantile_disc({v}, 0.5)::DOUBLE AS q50, quantile_disc({v}, 0.75)::DOUBLE AS q75, max({v})::DOUBLE AS max"""


@query("group_profile_price", f"SELECT l_returnflag, {PROFILE_SQL.format(v='l_quantity')} FROM lineitem GROUP BY 1")
def group_profile_price(spark, d):
    return rounded(profiles.group_profile(table(spark, d, "lineitem"), "l_returnflag", "l_quantity"), "mean", "stddev")


@query(
    "group_profile_chars",
    f"""WITH {COMMENTS_SQL} SELECT "editorsSelection"::VARCHAR AS "editorsSelection", {PROFILE_SQL.format(v='"articleWordCount"')} FROM comments GROUP BY 1""",
)
def group_profile_chars(spark, d):
    out = reports.relation_report(comments(spark, d))["words"]
    return rounded(_flag_text(out, "editorsSelection"), "mean", "stddev")


@query(
    "group_profile_page",
    f"""WITH {COMMENTS_SQL} SELECT "editorsSelection"::VARCHAR AS "editorsSelection", {PROFILE_SQL.format(v='"printPage"')} FROM comments GROUP BY 1""",
)
def group_profile_page(spark, d):
    out = reports.relation_report(comments(spark, d))["page"]
    return rounded(_flag_text(out, "editorsSelection"), "mean", "stddev")


@query(
    "group_center",
    f"""WITH {COMMENTS_SQL} SELECT "editorsSelection"::VARCHAR AS "editorsSelection", round(avg("recommandations"), 6) AS mean, round(stddev_samp("recommandations"), 6) AS stddev,
    quantile_disc("recommandations", 0.5)::DOUBLE AS med FROM comments GROUP BY 1""",
)
def group_center(spark, d):
    out = reports.relation_report(comments(spark, d))["recommendations"]
    return rounded(_flag_text(out, "editorsSelection"), "mean", "stddev")


@query(
    "numeric_describe",
    """WITH long AS (SELECT 'o_totalprice' AS "column", o_totalprice AS v FROM orders UNION ALL SELECT 'o_custkey', o_custkey::DOUBLE FROM orders)
    SELECT "column", count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS stddev, round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS q25,
    round(quantile_cont(v, 0.5), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75, round(max(v), 4) AS max FROM long GROUP BY 1""",
)
def numeric_describe(spark, d):
    out = profiles.numeric_describe(table(spark, d, "orders"), ["o_totalprice", "o_custkey"])
    return rounded(out, "mean", "stddev", "min", "q25", "q50", "q75", "max", digits=4)


@query(
    "object_describe",
    """WITH long AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
    counted AS (SELECT "column", value, count(*) AS n FROM long GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rn FROM counted)
    SELECT "column", sum(n)::BIGINT AS n, count(*) AS n_unique, max(CASE WHEN rn = 1 THEN value END) AS top, max(n) AS freq FROM ranked GROUP BY 1""",
)
def object_describe(spark, d):
    return profiles.object_describe(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "box_plot",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM events),
    f AS (SELECT *, q25 - 1.5 * (q75 - q25) AS lower_fence, q75 + 1.5 * (q75 - q25) AS upper_fence FROM q)
    SELECT round(q25, 4) AS q25, round(q50, 4) AS q50, round(q75, 4) AS q75, round(lower_fence, 4) AS lower_fence, round(upper_fence, 4) AS upper_fence,
      min(value) FILTER (value BETWEEN lower_fence AND upper_fence) AS lower_whisker, max(value) FILTER (value BETWEEN lower_fence AND upper_fence) AS upper_whisker,
      count(*) FILTER (value NOT BETWEEN lower_fence AND upper_fence) AS n_outliers
    FROM events, f GROUP BY 1, 2, 3, 4, 5""",
)
def box_plot(spark, d):
    return rounded(profiles.box_plot(table(spark, d, "events"), "value"), "q25", "q50", "q75", "lower_fence", "upper_fence", digits=4)


# --- tests ---------------------------------------------------------------------------------------


def _anova_sql(source: str, cat: str, value: str, prefix: str = "", tail: str = "") -> str:
    with_ = f"WITH {prefix}, " if prefix else "WITH "
    return f"""{with_}src AS (SELECT {cat} AS cat, CAST({value} AS DOUBLE) AS v FROM {source} WHERE {cat} IS NOT NULL AND {value} IS NOT NULL),
g AS (SELECT cat, count(*) AS n, avg(v) AS m FROM src GROUP BY 1), t AS (SELECT avg(v) AS gm, count(*) AS nn FROM src),
b AS (SELECT sum(n * (m - gm) * (m - gm)) AS ssb, count(*) - 1 AS dfb, any_value(nn)::DOUBLE - count(*) AS dfw FROM g, t),
w AS (SELECT sum((v - m) * (v - m)) AS ssw FROM src JOIN g USING (cat)),
a AS (SELECT dfb, dfw, (ssb / dfb) / (ssw / dfw) AS f, ssb / (ssb + ssw) AS eta, (ssb - dfb * ssw / dfw) / (ssb + ssw + ssw / dfw) AS omega FROM b, w)
SELECT dfb, dfw, round(f, 6) AS f_value, round(eta, 6) AS eta_sq, round(omega, 6) AS omega_sq{tail} FROM a"""


# With four degrees of freedom between, the tail is y^b (1 + b (1 - y)), y = dfw / (dfw + 4 f), b = dfw / 2.
F_TAIL_4 = ", round(pow(dfw / (dfw + 4 * f), dfw / 2) * (1 + dfw / 2 * (1 - dfw / (dfw + 4 * f))), 6) AS p_value"


@query("anova_event_value", _anova_sql("events", "event_type", "value", tail=F_TAIL_4))
def anova_event_value(spark, d):
    return rounded(anova(table(spark, d, "events"), "event_type", "value"), "f_value", "eta_sq", "omega_sq", "p_value")


@query("anova_share_by_group", _anova_sql("classed", "l_orderkey", "share", NORMALISED_SQL))
def anova_share_by_group(spark, d):
    rows = normalise_in_group(_lines(spark, d), "l_orderkey", "l_quantity")
    return rounded(anova(rows, "l_orderkey", "share", p_value=False), "f_value", "eta_sq", "omega_sq")


@query("anova_length_by_selection", _anova_sql("comments", '"editorsSelection"', '"articleWordCount"', COMMENTS_SQL))
def anova_length_by_selection(spark, d):
    out = reports.relation_report(comments(spark, d))["anova_words"].drop("p_value")
    return rounded(out, "f_value", "eta_sq", "omega_sq")


@query("anova_page_by_selection", _anova_sql("comments", '"editorsSelection"', '"printPage"', COMMENTS_SQL))
def anova_page_by_selection(spark, d):
    out = reports.relation_report(comments(spark, d))["anova_page"].drop("p_value")
    return rounded(out, "f_value", "eta_sq", "omega_sq")


CELLS_SQL = """src AS (SELECT 'lang' AS feature, lang AS value, quality::VARCHAR AS label FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'source', source, quality::VARCHAR FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'quality', quality::VARCHAR, quality::VARCHAR FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'toxic', toxic::VARCHAR, quality::VARCHAR FROM documents JOIN labels USING (doc_id)),
cells AS (SELECT feature, value, label, count(*) AS n FROM src GROUP BY 1, 2, 3)"""


@query("contingency_cells", f"WITH {CELLS_SQL} SELECT feature, value, label, n FROM cells")
def contingency_cells(spark, d):
    return contingency(_reviewed(spark, d), ["lang", "source", "quality", "toxic"], "quality")


@query(
    "chi_square",
    f"""WITH {CELLS_SQL}, rv AS (SELECT feature, value, sum(n) AS nv FROM cells GROUP BY 1, 2), lv AS (SELECT feature, label, sum(n) AS nl FROM cells GROUP BY 1, 2),
    tt AS (SELECT feature, sum(nv) AS total FROM rv GROUP BY 1),
    grid AS (SELECT feature, value, label, nv * nl / total AS e, coalesce(n, 0) AS o FROM rv JOIN lv USING (feature) JOIN tt USING (feature) LEFT JOIN cells USING (feature, value, label))
    SELECT feature, round(sum((o - e) * (o - e) / e), 6) AS statistic, (count(DISTINCT value) - 1) * (count(DISTINCT label) - 1) AS dof FROM grid GROUP BY 1""",
)
def chi_square_query(spark, d):
    out = chi_square(_reviewed(spark, d), ["lang", "source", "quality", "toxic"], "quality")
    return rounded(out.drop("p_value"), "statistic")


# With four degrees of freedom the tail is exp(-x/2) (1 + x/2).
@query(
    "chi_square_p_value",
    """WITH cells AS (SELECT event_type, part, count(*) AS n FROM (SELECT event_type, value > 40 AS part FROM events) GROUP BY 1, 2),
    rv AS (SELECT event_type, sum(n) AS nv FROM cells GROUP BY 1), lv AS (SELECT part, sum(n) AS nl FROM cells GROUP BY 1), tt AS (SELECT sum(n) AS total FROM cells),
    x AS (SELECT sum((n - nv * nl / total) * (n - nv * nl / total) / (nv * nl / total)) AS chi FROM cells JOIN rv USING (event_type) JOIN lv USING (part), tt)
    SELECT 'event_type' AS feature, round(chi, 6) AS statistic, 4::BIGINT AS dof, round(exp(-chi / 2) * (1 + chi / 2), 6) AS p_value FROM x""",
)
def chi_square_p_value(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("value") > 40).alias("part"))
    return rounded(chi_square(rows, ["event_type"], "part"), "statistic", "p_value")


# --- factors -------------------------------------------------------------------------------------

LONG_SQL = """long AS (SELECT o_orderkey, 'o_orderstatus' AS variable, o_orderstatus AS modality FROM orders
  UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders)"""
FACTOR_COLUMNS = ["o_orderstatus", "o_orderpriority"]


@query("disjunctive_table", f"WITH {LONG_SQL} SELECT o_orderkey, variable, modality FROM long")
def disjunctive_table(spark, d):
    return factors.disjunctive(table(spark, d, "orders"), "o_orderkey", FACTOR_COLUMNS)


@query("modality_counts", f"WITH {LONG_SQL} SELECT variable, modality, count(*) AS n FROM long GROUP BY 1, 2")
def modality_counts(spark, d):
    return factors.modalities(table(spark, d, "orders"), FACTOR_COLUMNS)


ARTICLE_LONG_SQL = "long AS (" + " UNION ALL ".join(
    f"""SELECT "articleID" AS id, upper('{c}') || '.' || coalesce("{c}", 'null') AS label FROM articles""" for c in reports.TYPOLOGY
) + ")"


@query(
    "burt_table",
    f"""WITH {ARTICLES_SQL}, {ARTICLE_LONG_SQL} SELECT a.label AS row_label, b.label AS col_label, count(*) AS n FROM long a JOIN long b USING (id) GROUP BY 1, 2""",
)
def burt_table(spark, d):
    return factors.burt_table(articles(spark, d), reports.TYPOLOGY)


@query(
    "burt_matrix",
    """WITH lab AS (SELECT 'C_MKTSEGMENT.' || c_mktsegment AS row_label, c_mktsegment AS s FROM customer)
    SELECT row_label, """
    + ", ".join(
        f"""count(*) FILTER (s = '{s}') AS "C_MKTSEGMENT.{s}" """
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM lab GROUP BY 1",
)
def burt_matrix(spark, d):
    return factors.burt_matrix(table(spark, d, "customer"), ["c_mktsegment"])


MODALITIES = ["O_ORDERPRIORITY.1-URGENT", "O_ORDERPRIORITY.2-HIGH", "O_ORDERPRIORITY.3-MEDIUM", "O_ORDERPRIORITY.4-NOT SPECIFIED", "O_ORDERPRIORITY.5-LOW",
    "O_ORDERSTATUS.F", "O_ORDERSTATUS.O", "O_ORDERSTATUS.P"]
_LABELLED = "upper(variable) || '.' || modality"


@query(
    "burt_matrix_orders",
    f"""WITH {LONG_SQL}, l AS (SELECT o_orderkey, {_LABELLED} AS label FROM long)
    SELECT a.label AS row_label, """
    + ", ".join(f"""count(*) FILTER (b.label = '{m}') AS "{m}" """ for m in MODALITIES)
    + " FROM l a JOIN l b USING (o_orderkey) GROUP BY 1",
)
def burt_matrix_orders(spark, d):
    """Square over two columns; both see all their modalities at every scale."""
    return factors.burt_matrix(table(spark, d, "orders"), FACTOR_COLUMNS)


@query(
    "disjunctive_vectors",
    """WITH v AS (SELECT DISTINCT 'o_orderstatus' AS variable, o_orderstatus AS m FROM orders UNION SELECT DISTINCT 'x', o_orderpriority FROM orders),
    i AS (SELECT variable, m, row_number() OVER (ORDER BY variable, m) - 1 AS place FROM v)
    SELECT o_orderkey, s.place::VARCHAR || ' ' || p.place::VARCHAR AS ones, (SELECT count(*) FROM i)::INTEGER AS width FROM orders
    JOIN i s ON s.variable = 'o_orderstatus' AND s.m = o_orderstatus JOIN i p ON p.variable = 'x' AND p.m = o_orderpriority""",
)
def disjunctive_vectors(spark, d):
    """Places of the ones, and the width, of each order's one-hot vector."""
    rows = factors.disjunctive_vectors(table(spark, d, "orders"), FACTOR_COLUMNS).select("o_orderkey", vector_to_array("indicator").alias("x"))
    places = F.filter(F.transform("x", lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    return rows.select("o_orderkey", F.concat_ws(" ", places.cast("array<string>")).alias("ones"), F.size("x").alias("width"))


@query(
    "normalised_indicators",
    f"""WITH {LONG_SQL}, m AS (SELECT variable, modality, (SELECT count(*) FROM orders) / count(*)::DOUBLE - 1 AS present FROM long GROUP BY 1, 2)
    SELECT l.o_orderkey, l.variable, l.modality, round(m.present, 6) AS value FROM long l JOIN m USING (variable, modality)""",
)
def normalised_indicators(spark, d):
    rows = factors.normalised_indicators(table(spark, d, "orders"), "o_orderkey", FACTOR_COLUMNS)
    return rounded(rows, "value")


ONE_HOT_SQL = f"""{LONG_SQL}, lab AS (SELECT o_orderkey, {_LABELLED} AS label FROM long),
size AS (SELECT label, count(*)::DOUBLE AS n FROM lab GROUP BY 1), every AS (SELECT count(*)::DOUBLE AS n FROM orders),
z AS MATERIALIZED (SELECT o.o_orderkey, s.label, CASE WHEN l.label IS NULL THEN 0 ELSE 1 END / (s.n / e.n) - 1 AS value
  FROM orders o CROSS JOIN size s CROSS JOIN every e LEFT JOIN lab l ON l.o_orderkey = o.o_orderkey AND l.label = s.label)"""


@query("normalised_gram", f"WITH {ONE_HOT_SQL} SELECT a.label AS row_label, b.label AS col_label, round(sum(a.value * b.value), 4) AS value FROM z a JOIN z b USING (o_orderkey) GROUP BY 1, 2")
def normalised_gram(spark, d):
    return rounded(factors.normalised_gram(table(spark, d, "orders"), FACTOR_COLUMNS), "value", digits=4)


FEW = [MODALITIES[0], MODALITIES[4], MODALITIES[7]]


@query("normalised_indicator_rows", f"WITH {ONE_HOT_SQL} SELECT o_orderkey, label, round(value, 6) AS value FROM z WHERE label IN ({', '.join(repr(m) for m in FEW)})")
def normalised_indicator_rows(spark, d):
    rows = factors.affine_rows(table(spark, d, "orders"), "o_orderkey", FACTOR_COLUMNS)
    return rounded(factors.affine_values(rows, "o_orderkey", FEW), "value")


@query(
    "normalised_row_products",
    f"WITH {ONE_HOT_SQL} SELECT a.o_orderkey, round(sum(a.value * b.value), 6) AS product FROM z a JOIN (SELECT * FROM z WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)) b USING (label) GROUP BY 1",
)
def normalised_row_products(spark, d):
    orders = table(spark, d, "orders")
    rows = stage(factors.affine_rows(orders, "o_orderkey", FACTOR_COLUMNS), "affine")
    first = orders.agg(F.min("o_orderkey")).first()[0]
    return rounded(factors.affine_products(rows, "o_orderkey", first, len(MODALITIES)), "product")


# --- reports and evaluation ----------------------------------------------------------------------


@query(
    "comment_selection_counts",
    f"""WITH {COMMENTS_SQL} SELECT "editorsSelection"::VARCHAR AS value, count(*) AS n FROM comments GROUP BY 1""",
)
def comment_selection_counts(spark, d):
    return _flag_text(reports.relation_report(comments(spark, d))["selection"], "value")


RULE_SQL = "(CASE WHEN n_chars > 2500 THEN 1.0 ELSE 0.0 END)::DOUBLE"


def _predicted(spark, d):
    return _reviewed(spark, d).select(
        (1 - F.col("quality")).cast("double").alias("indexedLabel"),
        F.when(F.col("n_chars") > 2500, 1.0).otherwise(0.0).alias("prediction"),
    )


@query(
    "confusion_matrix",
    f"""SELECT (1 - quality)::DOUBLE AS label, {RULE_SQL} AS prediction, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""",
)
def confusion_matrix_query(spark, d):
    return confusion_matrix(_predicted(spark, d))


@query(
    "class_scores",
    f"""WITH p AS (SELECT (1 - quality)::DOUBLE AS y, {RULE_SQL} AS p FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT count(*) AS n, count(*) FILTER (y = p) AS ok, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 1) AS a, count(*) FILTER (p = 1) AS b FROM p)
    SELECT round(ok / n, 6) AS accuracy, round(1 - ok / n, 6) AS test_error, round(tp / a, 6) AS recall, round(tp / b, 6) AS "precision", round(2 * tp / (a + b), 6) AS f_measure FROM c""",
)
def class_scores_query(spark, d):
    return rounded(class_scores(_predicted(spark, d)), "accuracy", "test_error", "recall", "precision", "f_measure")


@query(
    "rmse",
    """SELECT round(sqrt(avg((log10(l_extendedprice) - (3.5 + l_quantity / 50)) * (log10(l_extendedprice) - (3.5 + l_quantity / 50)))), 6) AS rmse FROM lineitem""",
)
def rmse_query(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.log10("l_extendedprice").alias("y"), (F.lit(3.5) + F.col("l_quantity") / 50).alias("prediction")
    )
    return rounded(rmse(rows, "y"), "rmse")


