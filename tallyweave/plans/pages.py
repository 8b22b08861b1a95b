"""Queries over positioned words.

The words are laid out from ``lineitem``: a page per order, a line per item with
a label, a quantity, a price and a supplier number under a header of four.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import align, layout, panels
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


#: Header labels with left and right edges; values are right-aligned with these edges.
HEADER = [("Item", 40, 70), ("Qty", 180, 200), ("Price", 270, 300), ("Supplier", 360, 400)]


def words(spark: SparkSession, d: str) -> DataFrame:
    """Words (doc_id, page, word_no, x0, y0, x1, y1, text) in whole units."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(order).alias("n"), "l_quantity", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), "l_suppkey")
    price = F.concat((F.col("cents") / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    line = F.col("n")
    cells = [F.concat(F.lit("Article"), line.cast("string")), F.col("l_quantity").cast("bigint").cast("string"), price, (F.col("l_suppkey") + 10000).cast("string")]
    right = [90, 200, 300, 400]
    y = line * 20 + 20
    # a baseline that wavers by up to two units, and an edge by one
    cell = [F.struct((line * 4 + k).cast("int").alias("word_no"), (F.lit(right[k]) + (line + k) % 2).cast("double").alias("x1"), (y + k % 3).cast("double").alias("y0"), cells[k].alias("text")) for k in range(4)]
    placed = items.select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array(*cell)).alias("w")).select(
        "doc_id", F.lit(1).alias("page"), "w.word_no", (F.col("w.x1") - 5 * F.length("w.text")).alias("x0"), "w.y0", "w.x1", (F.col("w.y0") + 10).alias("y1"), "w.text"
    )
    heads = [F.struct(F.lit(k).cast("int").alias("word_no"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), F.lit(t).alias("text")) for k, (t, x0, x1) in enumerate(HEADER)]
    header = items.select(F.col("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(*heads)).alias("w")).select(
        "doc_id", F.lit(1).alias("page"), "w.word_no", "w.x0", F.lit(20.0).alias("y0"), "w.x1", F.lit(30.0).alias("y1"), "w.text"
    )
    return placed.unionByName(header)


_CELLS = ["'Article' || n", "l_quantity::BIGINT::VARCHAR", "(cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0')", "(l_suppkey + 10000)::VARCHAR"]
_PLACED = " UNION ALL ".join(
    f"SELECT l_orderkey AS doc_id, (n * 4 + {k})::INT AS word_no, ({r} + (n + {k}) % 2)::DOUBLE AS x1, (n * 20 + 20 + {k % 3})::DOUBLE AS y0, {_CELLS[k]} AS text FROM items" for k, r in enumerate((90, 200, 300, 400))
)
_HEADS = " UNION ALL ".join(f"SELECT doc_id, 1 AS page, {k} AS word_no, {x0}::DOUBLE AS x0, 20.0::DOUBLE AS y0, {x1}::DOUBLE AS x1, 30.0::DOUBLE AS y1, '{t}' AS text FROM orders_" for k, (t, x0, x1) in enumerate(HEADER))
_WORDS = f"""items AS (SELECT *, round(l_extendedprice * 100)::BIGINT AS cents, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem), orders_ AS (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem),
    words AS (SELECT doc_id, 1 AS page, word_no, x1 - 5 * length(text) AS x0, y0, x1, y0 + 10 AS y1, text FROM ({_PLACED}) UNION ALL {_HEADS})"""
_NUMERIC = f"(regexp_full_match(text, '{layout.BAND_NUMBER}') OR regexp_full_match(text, '{layout.MONEY}'))"


@query(
    f"""WITH {_WORDS}, marks AS (SELECT DISTINCT doc_id, x1 FROM words WHERE {_NUMERIC} OR regexp_full_match(text, '{layout.DASHES}') OR regexp_full_match(text, '{layout.NOTE}')),
    stepped AS (SELECT *, coalesce(x1 - lag(x1) OVER (PARTITION BY doc_id ORDER BY x1) > 12, true)::INT AS fresh FROM marks)
    SELECT doc_id, x1, sum(fresh) OVER (PARTITION BY doc_id ORDER BY x1)::BIGINT AS cluster FROM stepped"""
)
def gap_cluster_1d(spark, d):
    marks = words(spark, d).where(layout.is_column_mark(F.col("text"))).select("doc_id", "x1").distinct()
    return layout.gap_clusters(marks, ["doc_id"], "x1", 12.0)


@query(
    f"""WITH RECURSIVE {_WORDS}, ordered AS (SELECT doc_id, y0, row_number() OVER (PARTITION BY doc_id ORDER BY round_even(y0, 1), x0, word_no) AS n FROM words),
    fold AS (SELECT doc_id, n, y0 AS anchor, 0 AS line_no FROM ordered WHERE n = 1
        UNION ALL SELECT o.doc_id, o.n, CASE WHEN abs(o.y0 - f.anchor) <= 3 THEN f.anchor ELSE o.y0 END, CASE WHEN abs(o.y0 - f.anchor) <= 3 THEN f.line_no ELSE f.line_no + 1 END
        FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.n = f.n + 1)
    SELECT doc_id, 1 AS page, line_no, count(*)::INT AS n_words, min(anchor) AS y FROM fold GROUP BY doc_id, line_no"""
)
def line_cluster_anchored(spark, d):
    return layout.line_clusters(words(spark, d))


@query(
    f"""WITH {_WORDS}, heads AS (SELECT * FROM words WHERE y0 = 20), steps AS (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY doc_id ORDER BY x0, word_no) > 9, true)::INT AS fresh FROM heads),
    groups AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY x0, word_no) AS group_no FROM steps)
    SELECT doc_id, group_no::BIGINT AS group_no, min(x0) AS x0, max(x1) AS x1, string_agg(text, ' ' ORDER BY x0, word_no) AS label FROM groups GROUP BY doc_id, group_no"""
)
def header_groups(spark, d):
    heads = words(spark, d).where(F.col("y0") == 20).withColumn("line_no", F.lit(0))
    return layout.header_groups(heads).select("doc_id", "group_no", "x0", "x1", "label")


@query(f"WITH {_WORDS} SELECT doc_id, word_no, ((x0 >= 125)::INT + (x0 >= 235)::INT + (x0 >= 330)::INT) AS col_no FROM words")
def column_assign(spark, d):
    w = words(spark, d)
    bounds = w.select("doc_id").distinct().withColumn("bounds", F.array(*map(F.lit, (125.0, 235.0, 330.0))))
    return layout.assign_columns(w, bounds, ["doc_id"]).select("doc_id", "word_no", "col_no")


@query(
    f"""WITH {_WORDS}, bins AS (SELECT doc_id, round_even(x0 / 4, 0) * 4 AS x, count(*) AS n, min(word_no) AS f FROM words WHERE regexp_full_match(text, '{layout.MONEY}') GROUP BY ALL)
    SELECT doc_id, x::DOUBLE AS x, n FROM bins QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1"""
)
def value_column_mode(spark, d):
    return layout.value_column(words(spark, d), ["doc_id"])


@query(f"WITH {_WORDS} SELECT doc_id, coalesce(median(x1 - x0), 0)::DOUBLE AS median FROM words GROUP BY doc_id")
def cell_median(spark, d):
    return layout.medians(words(spark, d).withColumn("w", F.col("x1") - F.col("x0")), ["doc_id"], "w")


_LINES = f"""lines_ AS (SELECT doc_id, (floor((y0 - 20) / 20) + 2 * (y0 >= 80)::INT)::INT AS line_no, bool_or({_NUMERIC} OR regexp_full_match(text, '{layout.DASHES}')) AS member,
    bool_or(regexp_full_match(text, '{layout.BAND_NUMBER}')) AS numeric_, NOT bool_or({_NUMERIC}) AS header FROM words GROUP BY ALL)"""


@query(
    f"""WITH {_WORDS}, {_LINES}, stepped AS (SELECT *, coalesce(line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) > 3, true)::INT AS fresh FROM lines_ WHERE member),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM stepped),
    bands AS (SELECT doc_id, run, min(line_no) AS first_line, max(line_no) AS last_line FROM runs GROUP BY doc_id, run HAVING count_if(numeric_) >= 3),
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS band_no, coalesce(lag(last_line) OVER (PARTITION BY doc_id ORDER BY first_line) + 1, 0) AS after_ FROM bands),
    headed AS (SELECT p.doc_id, band_no, first_line, last_line, after_, max(CASE WHEN l.line_no < first_line AND l.line_no >= greatest(after_, first_line - 5) THEN l.line_no END) AS h FROM placed p LEFT JOIN (SELECT * FROM lines_ WHERE header) l USING (doc_id) GROUP BY ALL)
    SELECT doc_id, 1 AS page, band_no::INT AS band_no, first_line, last_line, coalesce(h, CASE WHEN first_line - 1 >= after_ THEN greatest(first_line - 1, 0) ELSE first_line END) AS header_line FROM headed"""
)
def data_bands(spark, d):
    token = F.col("text")
    line = (F.floor((F.col("y0") - 20) / 20) + 2 * (F.col("y0") >= 80).cast("int")).cast("int")
    lines = words(spark, d).groupBy("doc_id", "page", line.alias("line_no")).agg(
        F.bool_or(layout.is_cell(token)).alias("member"), F.bool_or(token.rlike(layout.whole(layout.BAND_NUMBER))).alias("numeric"), (~F.bool_or(layout.is_number(token))).alias("header")
    )
    return layout.data_bands(lines)


@query(
    f"""WITH {_WORDS}, counted AS (SELECT l_orderkey AS doc_id FROM lineitem GROUP BY 1 HAVING count(*) >= 3)
    SELECT doc_id, 1 AS table_no, 'Item|Qty|Price|Supplier' AS labels, string_agg(cell, chr(10) ORDER BY n) AS rows
    FROM (SELECT l_orderkey AS doc_id, n, {" || '|' || ".join(f"({c})" for c in _CELLS)} AS cell FROM items) JOIN counted USING (doc_id) GROUP BY doc_id"""
)
def reconstruct_tables(spark, d):
    """Tables rebuilt from the words; an order of fewer than three items is too short for one."""
    tables = layout.rebuild_tables(words(spark, d))
    return tables.select("doc_id", "table_no", F.array_join("labels", "|").alias("labels"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"))


@query(
    """WITH glyphs AS (SELECT l_orderkey AS doc_id, CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS dx, CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE 1 END AS dy, l_quantity::BIGINT AS n FROM lineitem),
    counted AS (SELECT doc_id, sum(CASE WHEN dx = 0 AND dy < 0 THEN n ELSE 0 END) AS up, sum(CASE WHEN dx = 0 AND dy > 0 THEN n ELSE 0 END) AS down, sum(n) AS total FROM glyphs GROUP BY doc_id)
    SELECT doc_id, CASE WHEN up >= down THEN 90 ELSE 270 END AS turn FROM counted WHERE up + down >= 20 AND up + down >= 0.85 * total"""
)
def orientation_pages(spark, d):
    """Pages to be turned; a line's quantity stands for its number of glyphs."""
    items = table(spark, d, "lineitem")
    glyphs = items.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.when(F.col("l_suppkey") % 10 == 0, 1).otherwise(0).alias("dir_x"), F.when(F.col("l_orderkey") % 3 == 0, -1).otherwise(1).alias("dir_y"), F.explode(F.sequence(F.lit(1), F.col("l_quantity").cast("int"))))
    return layout.page_turns(glyphs).select("doc_id", "turn")


@query()
def align_blocks(spark, d):
    """Outline nodes' paragraphs against chunk lines as anchors; the order-bound matching has no SQL."""
    from ..functions.text import word_form

    nodes = table(spark, d, "outline_nodes").select("doc_id", F.lit(1).alias("section_no"), "node_no", "node_key", F.posexplode(F.coalesce("body", F.array().cast("array<string>"))).alias("p", "t"))
    blocks = nodes.select("doc_id", "section_no", (F.shiftleft(F.col("node_key"), 24) + F.col("p")).alias("block_no"), word_form(F.col("t")).alias("norm"), F.col("t").startswith("|").alias("table"))
    chunks = table(spark, d, "chunks").where(F.col("text").isNotNull())
    anchors = chunks.select("doc_id", F.lit(1).alias("section_no"), F.coalesce("page_start", F.lit(1)).alias("page"), F.col("text").startswith("|").alias("table"), word_form(F.col("text")).alias("norm"), F.col("chunk_key").cast("double").alias("yf0"), (F.col("chunk_key") + 1).cast("double").alias("yf1"))
    return align.align_blocks(blocks, anchors)


@query(
    f"""WITH {_WORDS}, bands AS (SELECT doc_id, min(y0) AS top, max(y1) AS bottom FROM words WHERE word_no >= 8 GROUP BY doc_id)
    SELECT w.doc_id, word_no FROM words w LEFT JOIN bands b ON w.doc_id = b.doc_id AND (w.y0 + w.y1) / 2 BETWEEN top AND bottom WHERE b.doc_id IS NULL"""
)
def outside_bands(spark, d):
    """Words above the band of the second line and those below it."""
    w = words(spark, d)
    bands = w.where(F.col("word_no") >= 8).groupBy("doc_id").agg(F.min("y0").alias("top"), F.max("y1").alias("bottom"))
    return panels.outside_bands(w, bands, ["doc_id"]).select("doc_id", "word_no")


@query(f"WITH {_WORDS} SELECT doc_id, word_no FROM words WHERE (y0 + y1) / 2 BETWEEN 40 AND 90")
def clipped_words(spark, d):
    return panels.inside(words(spark, d), 40.0, 90.0).select("doc_id", "word_no")


@query()
def alignment_coverage(spark, d):
    """How many blocks the alignment placed."""
    return panels.coverage(align_blocks(spark, d))
