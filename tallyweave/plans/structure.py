"""Queries over the structure of documents: lines, headings, chunks, sections, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SLICE_ANY, SLICE_LINE
from ..operators import chunks as C
from ..operators import figures, grids, headings, outline, panels
from ..sources.tables import dealt, table
from . import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def documents(spark: SparkSession, d: str) -> DataFrame:
    return dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


@query(f"SELECT doc_id, line_no::INT AS line_no, raw FROM ({sql.lines()})")
def doc_lines(spark, d):
    return grids.numbered_lines(documents(spark, d))


_KIND = f"CASE WHEN {sql.matches('bare', SLICE_LINE)} THEN 'marker' WHEN {sql.matches('bare', '^#{1,6}' + chr(92) + 's+')} THEN 'heading' WHEN bare = '' THEN 'blank' ELSE 'text' END"
_KINDS = f"""SELECT doc_id, line_no::INT AS line_no, raw, {_KIND} AS kind, length(regexp_extract(bare, '^(#{{1,6}})\\s', 1))::INT AS level,
    {sql.strip("regexp_replace(bare, '^#{1,6}" + chr(92) + "s+', '')")} AS title,
    TRY_CAST(nullif(regexp_extract(CASE WHEN {sql.matches('bare', SLICE_LINE)} THEN bare END, {sql.quoted(SLICE_ANY)}, 1), '') AS INT) AS page_start,
    TRY_CAST(nullif(regexp_extract(CASE WHEN {sql.matches('bare', SLICE_LINE)} THEN bare END, {sql.quoted(SLICE_ANY)}, 2), '') AS INT) AS page_end
    FROM (SELECT *, {sql.strip('raw')} AS bare FROM ({sql.lines()}))"""


@query(f"SELECT doc_id, line_no, kind, level, page_start, page_end FROM ({_KINDS})")
def line_kinds(spark, d):
    lined = documents(spark, d).select("doc_id", F.posexplode(C.line_kinds(F.col("text"))).alias("line_no", "l"))
    return lined.select("doc_id", "line_no", "l.kind", "l.level", "l.page_start", "l.page_end")


@query(sql.relevel("zh", False, 40))
def relevel_zh(spark, d):
    return headings.relevel(documents(spark, d))


@query(sql.relevel("en", False, 90))
def relevel_en(spark, d):
    return headings.relevel(documents(spark, d), language="en")


@query(sql.relevel("zh", True, 40))
def promote_headings_zh(spark, d):
    return headings.relevel(documents(spark, d), promote=True)


@query(sql.relevel("en", True, 90))
def promote_headings_en(spark, d):
    return headings.relevel(documents(spark, d), language="en", promote=True)


@query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?m)^#{1,6}\s'))::INT AS n_headings FROM documents")
def heading_counts(spark, d):
    return documents(spark, d).select("doc_id", headings.heading_count(F.col("text")).alias("n_headings"))


_HEADED = f"""headed AS (SELECT doc_id, line_no, raw, bare, CASE WHEN {sql.matches('bare', '^#{1,6}' + chr(92) + 's+')} AND NOT {sql.matches('bare', '^#' + chr(92) + 's*---')} THEN length(regexp_extract(bare, '^(#{{1,6}})', 1)) END AS level,
    {sql.strip("regexp_replace(bare, '^#{1,6}" + chr(92) + "s+', '')")} AS title FROM (SELECT *, {sql.strip('raw')} AS bare FROM ({sql.lines()})))"""
_CARRIED = ", ".join(f"last_value(CASE WHEN level <= {n} THEN struct_pack(l := level, t := title) END IGNORE NULLS) OVER w AS h{n}" for n in range(1, 7))
_PATH = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN h{n}.l = {n} THEN h{n}.t END" for n in range(1, 7)) + "], lambda x: x IS NOT NULL), ' > ')"
_PATHS = f"{_HEADED}, carried AS (SELECT *, {_CARRIED} FROM headed WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)), paths AS (SELECT doc_id, line_no, raw, bare, level, {_PATH} AS path FROM carried)"


@query(f"WITH {_PATHS} SELECT doc_id, line_no::INT AS line_no, path FROM paths WHERE bare <> ''")
def breadcrumb_level(spark, d):
    from ..functions.text import strip

    lines = grids.level_path(grids.numbered_lines(documents(spark, d)))
    return lines.where(strip(F.col("raw")) != "").select("doc_id", "line_no", F.array_join("path", " > ").alias("path"))


def _fold(max_chars: int) -> str:
    """The chunker as a recursion over the lines of each document."""
    return f"""
        WITH RECURSIVE kinds AS ({_KINDS}),
        numbered AS (SELECT *, length(raw) AS size FROM kinds WHERE kind <> 'blank'),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM numbered),
        fold AS (
            SELECT doc_id, 0::BIGINT AS n, NULL::VARCHAR AS raw, 'start' AS kind, []::VARCHAR[] AS stack, NULL::INT AS ps, NULL::INT AS pe, -1::BIGINT AS held, 0 AS chunk FROM (SELECT DISTINCT doc_id FROM ordered)
            UNION ALL
            SELECT o.doc_id, o.n, o.raw, o.kind,
                CASE WHEN o.kind = 'heading' THEN list_append(list_slice(f.stack, 1, least(len(f.stack), o.level - 1)), o.title) ELSE f.stack END,
                CASE WHEN o.kind = 'marker' THEN o.page_start ELSE f.ps END, CASE WHEN o.kind = 'marker' THEN o.page_end ELSE f.pe END,
                CASE WHEN o.kind = 'marker' THEN -1 WHEN o.kind = 'text' AND f.held >= 0 AND f.held + 1 + o.size <= {max_chars} THEN f.held + 1 + o.size ELSE o.size END,
                CASE WHEN o.kind = 'marker' OR (o.kind = 'text' AND f.held >= 0 AND f.held + 1 + o.size <= {max_chars}) THEN f.chunk ELSE f.chunk + 1 END
            FROM fold f JOIN ordered o ON o.doc_id = f.doc_id AND o.n = f.n + 1)
        SELECT doc_id, printf('chunk_%04d', chunk) AS chunk_id, first(ps ORDER BY n) AS page_start, first(pe ORDER BY n) AS page_end, array_to_string(first(stack ORDER BY n), ' > ') AS section,
            {sql.strip("string_agg(raw, chr(10) ORDER BY n)")} AS text
        FROM fold WHERE kind IN ('heading', 'text') GROUP BY doc_id, chunk"""


def _chunks(spark, d, max_chars: int) -> DataFrame:
    built = C.build_chunks(documents(spark, d), max_chars=max_chars)
    return built.select("doc_id", "chunk_id", "page_start", "page_end", F.array_join("section_path", " > ").alias("section"), "text")


@query(_fold(4500))
def chunk_windows(spark, d):
    return _chunks(spark, d, 4500)


@query(_fold(400))
def chunk_windows_small(spark, d):
    """The same with a window that most paragraphs meet."""
    return _chunks(spark, d, 400)


_PATH_TEXT = "array_to_string(coalesce(section_path, []), ' > ')"
_CRUMBS = "array_to_string(list_transform(coalesce(section_path, []), lambda t, i: repeat('#', least(i, 6)::INT) || ' ' || t), chr(10))"
_META = f"'[' || chunk_id || '|pages:' || coalesce(page_start::VARCHAR, 'None') || '-' || coalesce(page_end::VARCHAR, 'None') || '|section:' || {_PATH_TEXT} || ']'"
_BLOCK = f"{_META} || chr(10) || CASE WHEN len(coalesce(section_path, [])) > 0 THEN {_CRUMBS} || chr(10) || '---' || chr(10) ELSE '' END || text"


@query(f"SELECT chunk_key, {_BLOCK} AS block FROM chunks")
def chunk_breadcrumb_text(spark, d):
    c = table(spark, d, "chunks")
    return c.select("chunk_key", C.with_breadcrumb(*(F.col(x) for x in ("chunk_id", "page_start", "page_end", "section_path", "text"))).alias("block"))


@query(
    """SELECT chunk_key, doc_id, page_start, page_end FROM chunks c
    WHERE NOT EXISTS (SELECT 1 FROM chunks x WHERE x.doc_id = c.doc_id AND x.page_start IS NOT NULL)
    OR (coalesce(page_end, page_start) >= 5 AND page_start <= 12)"""
)
def page_range_filter(spark, d):
    return C.on_pages(table(spark, d, "chunks").select("chunk_key", "doc_id", "page_start", "page_end"), "12-5")


@query(
    f"""WITH RECURSIVE blocks AS (SELECT doc_id, {_BLOCK} AS b, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, {_BLOCK}) AS n FROM chunks WHERE text IS NOT NULL),
    fold AS (SELECT doc_id, n, b, length(b) + 2 AS held, 1 AS win FROM blocks WHERE n = 1
        UNION ALL SELECT o.doc_id, o.n, o.b, CASE WHEN f.held + length(o.b) + 2 <= 3000 THEN f.held + length(o.b) + 2 ELSE length(o.b) + 2 END, CASE WHEN f.held + length(o.b) + 2 <= 3000 THEN f.win ELSE f.win + 1 END
        FROM fold f JOIN blocks o ON o.doc_id = f.doc_id AND o.n = f.n + 1)
    SELECT doc_id, win AS window_no, count(*)::INT AS n_blocks, string_agg(b, chr(10) || chr(10) ORDER BY n) AS text FROM fold GROUP BY doc_id, win"""
)
def pack_windows(spark, d):
    return C.pack_windows(table(spark, d, "chunks").where(F.col("text").isNotNull()), 3000)


_TABLES = f"""WITH {_PATHS},
    flagged AS (SELECT *, starts_with(bare, '|') AS is_row FROM paths),
    starts AS (SELECT *, (is_row AND NOT coalesce(lag(is_row) OVER (PARTITION BY doc_id ORDER BY line_no), false))::INT AS fresh FROM flagged),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM starts),
    rows_ AS (SELECT doc_id, run, line_no, path, regexp_split_to_array(regexp_replace(regexp_replace(bare, '^\\|', ''), '\\|$', ''), '\\|') AS cells_ FROM runs WHERE is_row AND NOT {sql.matches('bare', grids.SEPARATOR)}),
    grids AS (SELECT doc_id, run, first(path ORDER BY line_no) AS path, max(len(cells_)) AS width, list(cells_ ORDER BY line_no) AS grid FROM rows_ GROUP BY doc_id, run),
    tables_ AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS table_no, path, width, grid FROM grids),
    cells_ AS (SELECT doc_id, table_no, path, width, row_no - 1 AS row_no, unnest(generate_series(0, width - 1)) AS col_no, grid[row_no] AS r FROM (SELECT *, unnest(generate_series(1, len(grid))) AS row_no FROM tables_)),
    clean AS (SELECT doc_id, table_no, path, row_no, col_no, coalesce(r[col_no + 1], '') AS c FROM cells_)"""


def _inline(x: str) -> str:
    for pattern, new in ((r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"), (r"`([^`]*)`", r"\1"), (r"\[([^\]]*)\]\([^)]*\)", r"\1")):
        x = f"regexp_replace({x}, {sql.quoted(pattern)}, {sql.quoted(new)}, 'g')"
    return sql.strip(x)


@query(f"{_TABLES} SELECT DISTINCT doc_id, table_no::INT AS table_no, CASE WHEN path = '' THEN 'Table ' || table_no ELSE path END AS title, (max(row_no) OVER (PARTITION BY doc_id, table_no) + 1)::INT AS n_rows FROM clean")
def pipe_tables(spark, d):
    return grids.pipe_tables(documents(spark, d)).select("doc_id", "table_no", "title", F.size("grid").alias("n_rows"))


@query(f"{_TABLES} SELECT doc_id, table_no::INT AS table_no, row_no::INT AS row_no, col_no::INT AS col_no, {_inline('c')} AS cell FROM clean")
def table_cells(spark, d):
    return grids.cells(grids.pipe_tables(documents(spark, d)))


@query(f"{_TABLES} SELECT doc_id, table_no::INT AS table_no, col_no::INT AS col_no, max(least(length(x) + 0.8 * len(regexp_extract_all(x, '[一-鿿]')), 60.0))::DOUBLE AS width FROM (SELECT *, {_inline('c')} AS x FROM clean) GROUP BY ALL")
def column_widths(spark, d):
    from ..functions.text import display_width

    cells = grids.cells(grids.pipe_tables(documents(spark, d)))
    return cells.groupBy("doc_id", "table_no", "col_no").agg(F.max(F.least(display_width(F.col("cell")), F.lit(60.0))).alias("width"))


@query()
def html_table_grids(spark, d):
    """Grids of the HTML tables in chunk texts, spans expanded; SQL has no words for spans."""
    return grids.html_tables(table(spark, d, "chunks"), "chunk_key", "text")


@query(r"SELECT chunk_key, unnest(generate_series(1, len(items)))::INT AS item_no, unnest(items) AS item FROM (SELECT chunk_key, regexp_extract_all(text, '(?is)<li[^>]*>(.*?)</li>', 1) AS items FROM chunks WHERE text IS NOT NULL) WHERE len(items) > 0")
def html_list_items(spark, d):
    items = table(spark, d, "chunks").select("chunk_key", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)<li[^>]*>(.*?)</li>"), 1)).alias("n", "item"))
    return items.select("chunk_key", (F.col("n") + 1).alias("item_no"), "item")


@query(
    f"""WITH kinds AS ({_KINDS}),
    marked AS (SELECT *, greatest(sum((kind = 'marker')::INT) OVER (PARTITION BY doc_id ORDER BY line_no), 1) AS section_no FROM kinds)
    SELECT doc_id, section_no::INT AS section_no, max(page_start) AS page_start, max(page_end) AS page_end, {sql.strip("coalesce(string_agg(CASE WHEN kind <> 'marker' THEN raw END, chr(10) ORDER BY line_no), '')")} AS body
    FROM marked GROUP BY doc_id, section_no"""
)
def split_sections(spark, d):
    return outline.slice_sections(documents(spark, d))


_FENCED = f"""bared AS (SELECT *, lower({sql.strip('raw')}) AS bare FROM ({sql.lines()})),
    fenced AS (SELECT *, regexp_matches(bare, '^(```|~~~)')::INT AS f FROM bared),
    opened AS (SELECT *, (sum(f) OVER (PARTITION BY doc_id ORDER BY line_no) - f) % 2 AS open_ FROM fenced)"""


@query(
    f"""WITH {_FENCED}, gaps AS (SELECT *, (open_ = 0 AND bare = '')::INT AS gap FROM opened), numbered AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM gaps),
    held AS (SELECT doc_id, b, list(raw ORDER BY line_no) AS l FROM numbered WHERE gap = 0 GROUP BY doc_id, b)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b)::INT AS block_no,
        regexp_matches(lower(l[1]), '^\\s*<table') OR (contains(l[1], '|') AND regexp_matches(coalesce(l[2], ''), '^\\s*\\|?\\s*:?-{{3,}}')) AS is_table, array_to_string(l, chr(10)) AS block FROM held"""
)
def md_blocks(spark, d):
    return outline.blocks(documents(spark, d))


@query(
    f"""WITH bared AS (SELECT *, {sql.strip('raw')} AS bare FROM ({sql.lines()})), fenced AS (SELECT *, starts_with(bare, '```')::INT AS f FROM bared),
    opened AS (SELECT *, (sum(f) OVER (PARTITION BY doc_id ORDER BY line_no) - f) % 2 AS open_ FROM fenced),
    heads AS (SELECT *, (open_ = 0 AND f = 0 AND regexp_matches(bare, '^#{{1,6}}\\s+\\S'))::INT AS head FROM opened),
    nodes AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY line_no) AS node_no FROM heads)
    SELECT doc_id, node_no::INT AS node_no, coalesce(max(CASE WHEN head = 1 THEN length(regexp_extract(bare, '^(#{{1,6}})', 1)) END), 1)::INT AS level,
        coalesce(max(CASE WHEN head = 1 THEN {sql.strip("regexp_replace(bare, '^#{1,6}" + chr(92) + "s+', '')")} END), '') AS title,
        coalesce(string_agg(CASE WHEN head = 0 THEN bare END, chr(10) ORDER BY line_no), '') AS body
    FROM nodes WHERE bare <> '' GROUP BY doc_id, node_no"""
)
def outline_nodes(spark, d):
    nodes = outline.outline(documents(spark, d))
    return nodes.select("doc_id", F.col("node_no").cast("int").alias("node_no"), "level", "title", F.array_join("body", "\n").alias("body"))


_LANGUAGE = "CASE WHEN len(regexp_extract_all(coalesce({0}, ''), '[一-鿿]')) >= len(regexp_extract_all(coalesce({0}, ''), '[A-Za-z]')) THEN 'zh' ELSE 'en' END"


@query(f"SELECT doc_id, {_LANGUAGE.format('text')} AS language FROM documents")
def detect_language(spark, d):
    return documents(spark, d).select("doc_id", outline.rough_language(F.col("text")).alias("language"))


@query(
    f"""WITH told AS (SELECT company, {_LANGUAGE.format('text')} AS language FROM documents), counted AS (SELECT company, language, count(*) AS n FROM told GROUP BY ALL)
    SELECT company, language, n FROM counted QUALIFY row_number() OVER (PARTITION BY company ORDER BY n DESC, language) = 1"""
)
def primary_language(spark, d):
    told = table(spark, d, "documents").select("company", outline.rough_language(F.col("text")).alias("language"))
    return outline.primary_language(told, "company")


_FINGERPRINT = f"""WITH bared AS (SELECT doc_id, line_no, {sql.strip('raw')} AS line FROM ({sql.lines()})),
    told AS (SELECT *, CASE WHEN starts_with(line, '```') THEN NULL WHEN starts_with(line, '#') THEN 'heading' WHEN (contains(line, '|') AND regexp_matches(line, '[0-9]')) OR (length(line) < 160 AND len(regexp_extract_all(line, '[0-9]')) >= 3) THEN 'data' END AS kind FROM bared WHERE line <> ''),
    firsts AS (SELECT doc_id, kind, line, line_no FROM told WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, kind, CASE WHEN kind = 'data' THEN substring(line, 1, 80) ELSE line_no::VARCHAR END ORDER BY line_no) = 1),
    placed AS (SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY line_no)::INT AS place, line FROM firsts),
    prints AS (SELECT * FROM placed WHERE place <= CASE WHEN kind = 'heading' THEN 120 ELSE 80 END)"""


@query(f"{_FINGERPRINT} SELECT * FROM prints")
def fingerprint_lines(spark, d):
    return outline.fingerprint_lines(documents(spark, d))


@query(
    f"""{_FINGERPRINT}, listed AS (SELECT d.doc_id, coalesce(list(line ORDER BY place) FILTER (kind = 'heading'), []) AS h, coalesce(list(line ORDER BY place) FILTER (kind = 'data'), []) AS x FROM documents d LEFT JOIN prints p USING (doc_id) GROUP BY d.doc_id),
    joined AS (SELECT *, array_to_string(list_concat(['[Material headings]'], CASE WHEN len(h) > 0 THEN h ELSE ['(no markdown headings found)'] END, [chr(10) || '[Representative data lines]'], CASE WHEN len(x) > 0 THEN x ELSE ['(no obvious table/data lines found)'] END), chr(10)) AS f FROM listed)
    SELECT doc_id, CASE WHEN length(f) > 9000 THEN substring(f, 1, 9000) || chr(10) || '...(fingerprint truncated)' ELSE f END AS fingerprint, {_LANGUAGE.format("array_to_string(h, ' ') || array_to_string(list_slice(x, 1, 30), ' ')")} AS language FROM joined"""
)
def fingerprints(spark, d):
    return outline.fingerprints(documents(spark, d))


@query(
    r"""SELECT chunk_key, unnest(generate_series(1, len(r)))::INT AS ref_no, unnest(r) AS ref FROM (SELECT chunk_key, list_transform(list_distinct_keep, lambda x: trim(x, ' ')) AS r FROM (
    SELECT chunk_key, list_filter(a, lambda x, i: list_position(a, x) = i) AS list_distinct_keep FROM (SELECT chunk_key, regexp_extract_all(text, '!\[[^\]]*\]\(([^)]+)\)', 1) AS a FROM chunks WHERE text IS NOT NULL))) WHERE len(r) > 0"""
)
def image_refs(spark, d):
    refs = table(spark, d, "chunks").select("chunk_key", F.posexplode(figures.image_refs(F.col("text"))).alias("n", "ref"))
    return refs.select("chunk_key", (F.col("n") + 1).alias("ref_no"), "ref")


@query(
    r"""WITH refs AS (SELECT DISTINCT chunk_key, text, unnest(regexp_extract_all(text, '!\[[^\]]*\]\(([^)]+)\)', 1)) AS ref FROM chunks WHERE text IS NOT NULL)
    SELECT chunk_key, ref, trim(regexp_replace(CASE WHEN strpos(text, ref) > 1 THEN substring(text, greatest(1, strpos(text, ref) - 600), strpos(text, ref) - greatest(1, strpos(text, ref) - 600)) ELSE '' END, '!\[[^\]]*\]\([^)]+\)', '', 'g'), ' ') AS context FROM refs"""
)
def preceding_context(spark, d):
    refs = table(spark, d, "chunks").select("chunk_key", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(figures.IMAGE), 1))).alias("ref"))
    return refs.select("chunk_key", "ref", figures.preceding("text", "ref").alias("context"))


@query(
    r"""WITH refs AS (SELECT chunk_key, doc_id, unnest(regexp_extract_all(text, '!\[[^\]]*\]\(([^)]+)\)', 1)) AS ref FROM chunks WHERE text IS NOT NULL),
    files AS (SELECT doc_id % 3 AS root_no, 'root' || (doc_id % 3) || '/' || ref AS path FROM refs WHERE doc_id % 4 > 0),
    best AS (SELECT regexp_extract(path, '([^/\\]*)$', 1) AS name, first(path ORDER BY root_no, path) AS path FROM files GROUP BY 1)
    SELECT DISTINCT chunk_key, ref, best.path FROM refs LEFT JOIN best ON regexp_extract(ref, '([^/\\]*)$', 1) = name"""
)
def resolved_images(spark, d):
    """References against an index of files under several roots; here the files are named after other references."""
    refs = table(spark, d, "chunks").select("chunk_key", "doc_id", F.explode(F.regexp_extract_all("text", F.lit(figures.IMAGE), 1)).alias("ref"))
    root = F.col("doc_id") % 3
    index = refs.where(F.col("doc_id") % 4 > 0).select(root.alias("root_no"), F.concat(F.lit("root"), root.cast("string"), F.lit("/"), "ref").alias("path"))
    return figures.resolve(refs, index).select("chunk_key", "ref", "path").distinct()


@query(
    """SELECT node_key, coalesce(array_to_string(list(title) OVER (PARTITION BY doc_id ORDER BY node_no, node_key ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), chr(10)), '') AS context
    FROM outline_nodes WHERE title IS NOT NULL"""
)
def context_last5(spark, d):
    nodes = table(spark, d, "outline_nodes").where(F.col("title").isNotNull()).withColumn("o", F.struct("node_no", "node_key"))
    return figures.last_texts(nodes, "doc_id", "o", "title").select("node_key", "context")


@query("SELECT doc_id, part::INT AS part, (1 + (part - 1) * 200)::INT AS page_from, least(part * 200, n_chars)::INT AS page_to FROM (SELECT doc_id, n_chars, unnest(generate_series(1, ceil(n_chars / 200.0)::BIGINT)) AS part FROM documents WHERE n_chars > 0)")
def page_batches(spark, d):
    """Page ranges of at most 200; a document's characters stand for pages here."""
    sized = table(spark, d, "documents").where(F.col("n_chars") > 0).select("doc_id", F.col("n_chars").cast("int").alias("n"))
    each = sized.select("doc_id", "n", F.posexplode(F.sequence(F.lit(1), F.col("n"), F.lit(200))).alias("p", "page_from"))
    return each.select("doc_id", (F.col("p") + 1).alias("part"), "page_from", F.least(F.col("page_from") + 199, F.col("n")).alias("page_to"))


@query(
    """SELECT doc_id, string_agg('# --- PDF 物理切片：第 ' || page_start || ' - ' || page_end || ' 页 ---' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY page_start, chunk_key) AS text
    FROM chunks WHERE page_start IS NOT NULL AND page_end IS NOT NULL AND text IS NOT NULL GROUP BY doc_id"""
)
def merged_slices(spark, d):
    parts = table(spark, d, "chunks").where(F.col("page_start").isNotNull() & F.col("page_end").isNotNull() & F.col("text").isNotNull())
    part = F.concat(F.format_string("# --- PDF 物理切片：第 %d - %d 页 ---\n\n", "page_start", "page_end"), F.col("text"))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_start", "chunk_key", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("text"))


@query(
    f"""SELECT doc_id, line_no::INT AS line_no, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_
    FROM (SELECT *, length(regexp_replace(raw, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS n FROM ({sql.lines()}))"""
)
def line_offsets(spark, d):
    lines = panels.line_offsets(grids.numbered_lines(documents(spark, d)), ["doc_id"], "line_no", "raw")
    return lines.select("doc_id", "line_no", F.col("offset").cast("bigint").alias("offset_"))


@query(
    f"""WITH l AS (SELECT *, {sql.strip('raw')} AS bare FROM ({sql.lines()})), n AS (SELECT *, lag(bare) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM l)
    SELECT doc_id, string_agg(CASE WHEN prev IS NOT NULL AND starts_with(bare, '|') <> starts_with(prev, '|') AND bare <> '' AND prev <> '' THEN chr(10) || raw ELSE raw END, chr(10) ORDER BY line_no) AS text FROM n GROUP BY doc_id"""
)
def spaced_tables(spark, d):
    """Texts with empty lines around their pipe tables."""
    return documents(spark, d).where(F.coalesce("text", F.lit("")) != "").select("doc_id", panels.spaced_tables(F.col("text")).alias("text"))


@query(r"""SELECT chunk_key, regexp_replace(text, '<td>(\s*[-(（]?[\d,，.]+[%)）]?\s*)</td>', '<td class="num">\1</td>', 'g') AS html FROM chunks WHERE contains(text, '<td>')""")
def numeric_cells(spark, d):
    held = table(spark, d, "chunks").where(F.col("text").contains("<td>"))
    return held.select("chunk_key", panels.numeric_cells(F.col("text")).alias("html"))
