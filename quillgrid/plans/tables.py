"""Queries over table markup and HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markup, tables
from ..operators.datasets import with_predictions
from ..session import scan, table
from .base import Book, once

BOOK = Book()
TAG_SQL = "regexp_extract_all(otsl, '<(nl|fcel|ecel|lcel|ucel|xcel)>', 1)"
EXAMPLES = "(SELECT DISTINCT record_id, otsl, html, path, source FROM examples_output)"
#: Markup of each region: a header over all columns, then a row for each nation under the region's spanning cell.
DOCS = """
docs AS (SELECT r_regionkey AS region_id, r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS k FROM region JOIN nation ON n_regionkey = r_regionkey),
sizes AS (SELECT region_id, max(k) AS n FROM docs GROUP BY 1)"""


def region_markup(spark: SparkSession, d: str) -> DataFrame:
    """(region_id, otsl): a header cell over three columns, and the region's cell down its nations' rows."""
    rows = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    listed = rows.groupBy(F.col("r_regionkey").alias("region_id"), "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    line = lambda n, i: F.concat(F.when(i == 0, F.concat(F.lit("<fcel>"), F.col("r_name"))).otherwise("<ucel>"), F.lit("<fcel>"), n["n_name"], F.lit("<fcel>"), n["n_nationkey"].cast("string"), F.lit("<nl>\n"))
    return listed.select("region_id", F.concat(F.lit("<fcel>Nations<lcel><lcel><nl>\n"), F.array_join(F.transform("ns", line), "")).alias("otsl"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """(region_id, n_rows, n_cols, n_cells, n_span_cells, html) of the regions' tables."""
    t = tables.read_table(F.col("otsl"))
    out = region_markup(spark, d).withColumn("t", t)
    spans = F.size(F.filter("t.cells", lambda c: (c["row_span"] > 1) | (c["col_span"] > 1)))
    return out.select("region_id", F.col("t.num_rows").alias("n_rows"), F.col("t.num_cols").alias("n_cols"), F.size("t.cells").alias("n_cells"), spans.alias("n_span_cells"), tables.otsl_to_html("otsl").alias("html"))


@BOOK.query(f"""
SELECT record_id, len({TAG_SQL}) AS n_tags, len(list_filter({TAG_SQL}, lambda x: x = 'nl')) AS n_nl, len(list_filter({TAG_SQL}, lambda x: x = 'fcel')) AS n_fcel,
       len(list_filter({TAG_SQL}, lambda x: x IN ('lcel', 'ucel', 'xcel'))) AS n_span FROM {EXAMPLES} WHERE otsl IS NOT NULL""")
def t01_otsl_tokens(spark: SparkSession, d: str) -> DataFrame:
    e = once(spark, d, "examples_output", "record_id", ["otsl"]).where("otsl is not null").withColumn("t", tables.tokens(F.col("otsl")))
    n = lambda *tags: F.size(F.filter("t", lambda x: x.isin(*tags))).cast("bigint")
    return e.select("record_id", F.size("t").cast("bigint").alias("n_tags"), n("nl").alias("n_nl"), n("fcel").alias("n_fcel"), n("lcel", "ucel", "xcel").alias("n_span"))


@BOOK.query(f"""
WITH r AS (SELECT record_id, unnest(string_split(otsl, '<nl>')) AS line FROM {EXAMPLES} WHERE otsl IS NOT NULL),
c AS (SELECT record_id, len(regexp_extract_all(line, '<(fcel|ecel|lcel|ucel|xcel)>')) AS w FROM r)
SELECT record_id, count(*) FILTER (w > 0) AS n_rows, coalesce(max(w), 0) AS n_cols, coalesce(sum(w), 0)::BIGINT AS n_slots FROM c GROUP BY 1""")
def t02_otsl_rows(spark: SparkSession, d: str) -> DataFrame:
    e = once(spark, d, "examples_output", "record_id", ["otsl"]).where("otsl is not null").withColumn("r", tables.tag_rows(F.col("otsl")))
    slots = F.aggregate("r", F.lit(0), lambda s, x: s + F.size(x))
    return e.select("record_id", F.size("r").cast("bigint").alias("n_rows"), tables.width(F.col("r")).cast("bigint").alias("n_cols"), slots.cast("bigint").alias("n_slots"))


@BOOK.query(f"""
WITH {DOCS}
SELECT region_id, 0::BIGINT AS r, 0::BIGINT AS c, 'fcel' AS tag, 1::BIGINT AS row_span, 3::BIGINT AS col_span FROM sizes
UNION ALL SELECT region_id, 1, 0, 'fcel', n, 1 FROM sizes
UNION ALL SELECT region_id, k, c, 'fcel', 1, 1 FROM docs, (VALUES (1), (2)) v(c)""")
def t03_otsl_cells(spark: SparkSession, d: str) -> DataFrame:
    c = tables.relational_cells(region_markup(spark, d), "region_id", "otsl")
    return c.select("region_id", *[F.col(x).cast("bigint").alias(x) for x in ("r", "c")], "tag", F.col("row_span").cast("bigint").alias("row_span"), F.col("col_span").cast("bigint").alias("col_span"))


@BOOK.query(f"""
WITH {DOCS}
SELECT region_id, '<table><tr><td colspan="3">Nations</td></tr>' || string_agg('<tr>' || CASE WHEN k = 1 THEN CASE WHEN n > 1 THEN '<td rowspan="' || n || '">' ELSE '<td>' END || r_name || '</td>' ELSE '' END
       || '<td>' || n_name || '</td><td>' || n_nationkey || '</td></tr>', '' ORDER BY k) || '</table>' AS html FROM docs JOIN sizes USING (region_id) GROUP BY region_id""")
def t04_otsl_html(spark: SparkSession, d: str) -> DataFrame:
    return region_markup(spark, d).select("region_id", tables.otsl_to_html("otsl").alias("html"))


@BOOK.query(f"""
WITH {DOCS}
SELECT region_id, 0::BIGINT AS r, c, 0::BIGINT AS origin_r, 0::BIGINT AS origin_c FROM sizes, range(3) t(c)
UNION ALL SELECT region_id, r, 0, 1, 0 FROM sizes, generate_series(1, n) t(r)
UNION ALL SELECT region_id, k, c, k, c FROM docs, (VALUES (1), (2)) v(c)""")
def t05_grid_slots(spark: SparkSession, d: str) -> DataFrame:
    c = tables.relational_cells(region_markup(spark, d), "region_id", "otsl")
    return tables.grid_slots(c, "region_id").select("region_id", *[F.col(x).cast("bigint").alias(x) for x in ("r", "c", "origin_r", "origin_c")])


@BOOK.query(f"""
WITH {DOCS}
SELECT region_id, n + 1 AS n_rows, 3::BIGINT AS n_cols, 2 * n + 2 AS n_cells, CASE WHEN n > 1 THEN 2 ELSE 1 END::BIGINT AS n_span_cells FROM sizes""")
def t06_flagship(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d).select("region_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_rows", "n_cols", "n_cells", "n_span_cells")])


@BOOK.query()
def t07_examples_html(spark: SparkSession, d: str) -> DataFrame:
    """Every value as HTML, and whether that is the record's own HTML in normal form."""
    e = scan(spark, d, "examples_output", ["record_id", "otsl", "html"]).dropDuplicates(["record_id"])
    made = tables.otsl_to_html("otsl")
    return e.select("record_id", made.alias("html"), markup.normal_table_udf("otsl").eqNullSafe(markup.normal_table_udf("html")).alias("same"))


@BOOK.query()
def t08_teds(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each value's table with the record's own HTML, with and without content."""
    e = scan(spark, d, "examples_output", ["record_id", "otsl", "html"]).dropDuplicates(["record_id"]).select("record_id", markup.normal_table_udf("otsl").alias("p"), markup.normal_table_udf("html").alias("t"))
    s = e.select("record_id", markup.teds_both_udf("p", "t").alias("s"))
    return s.select("record_id", F.round("s.teds", 9).alias("teds"), F.round("s.teds_structure", 9).alias("teds_structure"))


@BOOK.query("SELECT r_regionkey AS region_id, 1.0::DOUBLE AS teds FROM region")
def t09_teds_self(spark: SparkSession, d: str) -> DataFrame:
    h = region_markup(spark, d).select("region_id", markup.normal_table_udf("otsl").alias("h"))
    return h.select("region_id", markup.teds_udf()("h", "h").alias("teds"))


@BOOK.query(f"""
WITH {DOCS}
SELECT region_id, 1.0::DOUBLE AS sc_tt, 0.0::DOUBLE AS sc_tf, 0.0::DOUBLE AS sc_f FROM sizes""")
def t10_span_scores(spark: SparkSession, d: str) -> DataFrame:
    h = region_markup(spark, d).select("region_id", markup.td_paths(tables.otsl_to_html("otsl"))["cells"].alias("p"))
    return h.select("region_id", *markup.span_scores(F.col("p"), F.col("p"))).na.fill(0.0)


@BOOK.query(f"""
WITH e AS {EXAMPLES}, t AS (SELECT record_id, html FROM e WHERE html IS NOT NULL), p AS (SELECT record_id, otsl FROM e WHERE otsl <> '')
SELECT t.record_id, coalesce(p.otsl, '') AS prediction, length(t.html) AS n_truth FROM t LEFT JOIN p USING (record_id)""")
def t11_batch_join(spark: SparkSession, d: str) -> DataFrame:
    """Truth with predictions by record, a missing one as ''."""
    e = once(spark, d, "examples_output", "record_id", ["otsl", "html"])
    truth, pred = e.where("html is not null").select("record_id", "html"), e.where("otsl <> ''").select("record_id", F.col("otsl").alias("prediction"))
    return with_predictions(truth, pred, "record_id", "prediction").select("record_id", "prediction", F.char_length("html").cast("bigint").alias("n_truth"))


@BOOK.query(f"SELECT record_id, CASE WHEN otsl IS NOT NULL AND NOT regexp_matches(otsl, '<nl>\\s*$') THEN 'ERROR' ELSE left(otsl, 300) END AS gated FROM {EXAMPLES}")
def t12_completion_gate(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.rewards import completion_gate

    e = once(spark, d, "examples_output", "record_id", ["otsl"])
    return e.select("record_id", completion_gate(F.col("otsl"), F.col("otsl").isNotNull(), 300).alias("gated"))


@BOOK.query(f"SELECT record_id, CASE WHEN otsl IS NOT NULL AND NOT regexp_matches(otsl, '<nl>\\s*$') THEN 'ERROR' ELSE left(otsl, 30000) END AS gated FROM {EXAMPLES}")
def t14_completion_gate_whole(spark: SparkSession, d: str) -> DataFrame:
    """The gate with the reference's cut; t12 cuts at 300, so that short values are cut as well."""
    from ..operators.rewards import completion_gate

    e = once(spark, d, "examples_output", "record_id", ["otsl"])
    return e.select("record_id", completion_gate(F.col("otsl"), F.col("otsl").isNotNull()).alias("gated"))


@BOOK.query()
def t13_normal_html(spark: SparkSession, d: str) -> DataFrame:
    e = scan(spark, d, "examples_output", ["record_id", "html"]).dropDuplicates(["record_id"])
    return e.select("record_id", markup.normalize_html_udf("html").alias("html"), F.size(markup.cell_tokens("html")).alias("n_cell_tokens"))


QUERIES, ORACLE = BOOK.queries, BOOK.oracle
