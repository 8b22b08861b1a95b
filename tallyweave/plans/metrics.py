"""Queries over rules, retrieval and extracted results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import parse_number
from ..functions.text import absent, parse_list, safe_file_name, safe_sheet_base, search_window, value_with_unit
from ..operators import chunks as C
from ..operators import extraction, outline, results, retrieval, routing, rules
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


# --- retrieval --------------------------------------------------------------------------------------------------


def _terms(column: str, where: str) -> str:
    """(rule_key, profile, place, alternative) of a rule's terms in match form."""
    bare = sql.strip("term")
    return f"""SELECT rule_key, place, unnest(CASE WHEN {bare} = '' THEN [''] WHEN len(parts) > 0 THEN parts ELSE [{bare}] END) AS g FROM (
        SELECT rule_key, place, term, list_filter(list_transform(string_split(term, '/'), lambda p: {sql.strip('p')}), lambda p: p <> '') AS parts FROM (
        SELECT rule_key, unnest(generate_series(0, len({column}) - 1)) AS place, coalesce(unnest({column}), '') AS term FROM rules WHERE len({column}) > 0 AND {where}))"""


_SIGNALS = " + ".join(f"contains(coalesce(text, ''), {sql.quoted(s)})::INT" for s in retrieval.TABLE_SIGNALS)
_SCORED = f"""WITH c AS (SELECT chunk_key, doc_id, chunk_id, profile, {sql.match_form("coalesce(text, '')")} AS t, {sql.match_form("array_to_string(coalesce(section_path, []), ' > ')")} AS s, (({_SIGNALS}) >= 2)::INT AS tab FROM chunks),
    r AS (SELECT rule_key, profile FROM rules WHERE coalesce(enabled, true) AND NOT coalesce(allow_parent_note, false)),
    terms AS (SELECT rule_key, kind, place, {sql.match_form('g')} AS g FROM (SELECT 'a' AS kind, * FROM ({_terms('aliases', 'true')}) UNION ALL SELECT 's', * FROM ({_terms('section_hint', 'true')}) UNION ALL SELECT 'c', * FROM ({_terms('company_hints', 'true')}))),
    hits AS (SELECT chunk_key, terms.rule_key, kind, place, bool_or(contains(t, g)) AS in_text, bool_or(contains(s, g)) AS in_section
        FROM c JOIN r USING (profile) JOIN terms USING (rule_key) WHERE g <> '' GROUP BY ALL),
    sums AS (SELECT chunk_key, rule_key, sum(CASE kind WHEN 'a' THEN 4.0 * in_text::INT WHEN 'c' THEN 10.0 * (in_text::INT + in_section::INT) ELSE (2.0 + place) * in_text::INT + (3.0 + place) * in_section::INT END) AS score FROM hits GROUP BY ALL),
    scored AS (SELECT c.doc_id, c.chunk_key, c.chunk_id, r.rule_key, (coalesce(sums.score, 0) + c.tab)::DOUBLE AS score FROM c JOIN r USING (profile) LEFT JOIN sums ON sums.chunk_key = c.chunk_key AND sums.rule_key = r.rule_key)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.scored(dealt(table(spark, d, "chunks").select("doc_id", "chunk_key", "chunk_id", "profile", "section_path", "text"), "doc_id"), rules.enabled_rules(table(spark, d, "rules")))


@query(f"{_SCORED} SELECT * FROM scored WHERE score > 0")
def score_chunks(spark, d):
    return scored(spark, d)


@query(f"{_SCORED} SELECT *, row_number() OVER (PARTITION BY doc_id, rule_key ORDER BY score DESC, chunk_id, chunk_key)::INT AS rank FROM scored WHERE score > 0 QUALIFY rank <= 12")
def retrieve_topk(spark, d):
    return retrieval.best_chunks(scored(spark, d), 12)


@query(
    f"""{_SCORED}, signal AS (SELECT * FROM scored JOIN (SELECT chunk_key, tab FROM c) USING (chunk_key) WHERE score = 1.0 AND tab = 1)
    SELECT rule_key, count(*) AS n_chunks FROM signal GROUP BY rule_key"""
)
def table_signal_only(spark, d):
    """Chunks that a rule retrieves for their table words alone."""
    return scored(spark, d).where(F.col("score") == retrieval.WEIGHTS["table"]).groupBy("rule_key").agg(F.count("*").alias("n_chunks"))


@query()
def extract_stub(spark, d):
    """Retrieval, prompts, a responder without a model, and normalised results, in one plan."""
    chunks, active = table(spark, d, "chunks"), rules.enabled_rules(table(spark, d, "rules"))
    best = retrieval.best_chunks(scored(spark, d), 12)
    prompts = extraction.rule_prompts(extraction.contexts(best, chunks), active)
    replies = extraction.respond(prompts, ["doc_id", "rule_key"], extraction.first_number_near_name)
    return replies.select("doc_id", "rule_key", "value", parse_number(F.col("value")).alias("value_num"), "unit", "source_text", "error")


@query()
def extract_whole_stub(spark, d):
    """Every window of a document against all of its profile's rules; the first value wins."""
    chunks = table(spark, d, "chunks").where(F.col("text").isNotNull())
    windows = C.pack_windows(chunks, 32000)
    of = chunks.groupBy("doc_id").agg(F.min("profile").alias("profile"))
    active = rules.enabled_rules(table(spark, d, "rules")).select("profile", F.col("id").alias("rule_id"), "rule_key", "name")
    prompts = windows.join(of, "doc_id").join(active, "profile").withColumn("prompt", extraction.render("[Metric] {rule_id} {rule_name}\n[Context]\n{context}", {"rule_id": F.col("rule_id"), "rule_name": F.col("name"), "context": F.col("text")}))
    replies = extraction.respond(prompts, ["doc_id", "rule_key", "window_no"], extraction.first_number_near_name)
    return results.first_present(replies, ["doc_id", "rule_key"])


# --- results ----------------------------------------------------------------------------------------------------


@query(f"SELECT result_id, {sql.parse_number('value')} AS value_num FROM metric_results")
def parse_numbers(spark, d):
    return table(spark, d, "metric_results").select("result_id", parse_number(F.col("value")).alias("value_num"))


@query(f"SELECT result_id, doc_id, id, name, coalesce(rule_group, '') AS rule_group, value, {sql.parse_number('value')} AS value_num, unit, source_text, coalesce(error, '') AS error FROM metric_results")
def normalize_results(spark, d):
    return results.normalised(table(spark, d, "metric_results"))


@query("SELECT company, count(*) FILTER (value IS NULL OR value IN ('', 'null')) AS n_absent, count(*) AS n FROM metric_results GROUP BY company")
def absent_values(spark, d):
    return table(spark, d, "metric_results").groupBy("company").agg(F.count_if(absent(F.col("value"))).alias("n_absent"), F.count("*").alias("n"))


@query(
    """WITH items AS (SELECT doc_id, id, (result_id % 3)::INT AS window_no, result_id, value, unit FROM metric_results),
    last AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY doc_id, id, window_no ORDER BY result_id DESC) = 1)
    SELECT doc_id, id, value, unit, window_no AS from_window FROM last WHERE value IS NOT NULL AND value NOT IN ('', 'null') QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY window_no) = 1"""
)
def first_non_null_merge(spark, d):
    """The results of a document as replies of three windows."""
    items = table(spark, d, "metric_results").withColumn("window_no", (F.col("result_id") % 3).cast("int")).withColumnRenamed("result_id", "item_no")
    return results.first_present(items, ["doc_id", "id"])


@query(
    """WITH found AS (SELECT doc_id, id, first(value ORDER BY result_id DESC) AS value, first(unit ORDER BY result_id DESC) AS unit FROM metric_results GROUP BY ALL),
    wanted AS (SELECT d.doc_id, r.id, min(r.name) AS name FROM documents d JOIN rules r USING (profile) WHERE coalesce(r.enabled, true) GROUP BY ALL)
    SELECT w.doc_id, w.id, w.name, f.value, """
    + sql.parse_number("f.value")
    + """ AS value_num, f.unit, '' AS error FROM wanted w LEFT JOIN found f ON w.doc_id = f.doc_id AND w.id = f.id"""
)
def results_per_rule(spark, d):
    """Every enabled rule of a document's profile, with the last result or nulls."""
    active = rules.enabled_rules(table(spark, d, "rules")).groupBy("profile", "id").agg(F.min("name").alias("name"))
    wanted = table(spark, d, "documents").select("doc_id", "profile").join(active, "profile")
    found = results.last_result(table(spark, d, "metric_results"), ["doc_id", "id"]).select("doc_id", "id", "value", "unit")
    return results.for_every_rule(wanted.select("doc_id", "id", "name"), found)


_CELL = "CASE WHEN value IS NULL OR value IN ('', 'null') THEN '' ELSE concat_ws(' ', value, nullif(unit, '')) END"


@query(
    f"""WITH last AS (SELECT id, company, name, rule_group, {_CELL} AS cell FROM metric_results WHERE company IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, company ORDER BY result_id DESC) = 1)
    SELECT id, company, first_value(name) OVER (PARTITION BY id ORDER BY company) AS name, first_value(rule_group) OVER (PARTITION BY id ORDER BY company) AS rule_group, cell FROM last"""
)
def comparison_long(spark, d):
    """All companies' values by id, with the name and group of the first company that has it."""
    return results.comparison_long(table(spark, d, "metric_results"), "company")


@query(
    """WITH last AS (SELECT id, company, name, value, unit FROM metric_results WHERE company IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, company ORDER BY result_id DESC) = 1)
    SELECT id, min(name) AS name, count(*) AS n_entities, string_agg(company || '=' || value || coalesce(unit, ''), '; ' ORDER BY company) AS entries FROM last WHERE value IS NOT NULL AND value NOT IN ('', 'null') GROUP BY id"""
)
def records_multi(spark, d):
    """Records by id over all companies, the map written out in order."""
    recs = results.records(table(spark, d, "metric_results").where(F.col("company").isNotNull()), "company")
    entries = F.array_sort(F.map_entries("values"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"], F.coalesce(e["value"]["unit"], F.lit("")))), "; ")
    return recs.select("id", "name", F.size("values").cast("bigint").alias("n_entities"), text.alias("entries"))


@query(
    """WITH last AS (SELECT id, company, name, value, unit FROM metric_results WHERE company IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, company ORDER BY result_id DESC) = 1)
    SELECT id, '- ' || min(name) || ': ' || string_agg(company || '=' || value || coalesce(unit, ''), '; ' ORDER BY company) AS line FROM last WHERE value IS NOT NULL AND value NOT IN ('', 'null') GROUP BY id"""
)
def metric_blocks(spark, d):
    """A line per metric with the values of all companies."""
    return results.records(table(spark, d, "metric_results").where(F.col("company").isNotNull()), "company").select("id", outline.metric_block(F.col("name"), F.col("values")).alias("line"))


@query(f"{_SCORED} SELECT *, row_number() OVER (PARTITION BY doc_id, rule_key ORDER BY score DESC, chunk_id, chunk_key)::INT AS rank FROM scored WHERE score > 0 QUALIFY rank <= 1")
def retrieve_best(spark, d):
    """The best chunk of each document and rule: a limit that cuts."""
    return retrieval.best_chunks(scored(spark, d), 1)


@query("SELECT m.result_id, coalesce(r.place, 9999) AS place FROM metric_results m LEFT JOIN (SELECT id, min(rule_key) AS place FROM rules GROUP BY id) r USING (id)")
def results_in_rule_order(spark, d):
    placed = results.in_rule_order(table(spark, d, "metric_results").select("result_id", "id"), table(spark, d, "rules").select("id", "rule_key"))
    return placed.select("result_id", "place")


@query(
    """WITH names AS (SELECT DISTINCT company FROM documents WHERE company IS NOT NULL), based AS (SELECT company, coalesce(nullif(substring(regexp_replace(company, '[\\\\/*?:\\[\\]]', '_', 'g'), 1, 6), ''), 'Sheet') AS base FROM names),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY company) AS n FROM based)
    SELECT company, CASE WHEN n = 1 THEN base ELSE substring(base, 1, (31 - length('_' || n))::BIGINT) || '_' || n END AS sheet FROM placed"""
)
def sheet_names(spark, d):
    """Sheets named after companies; a short base makes many alike."""
    names = table(spark, d, "documents").where(F.col("company").isNotNull()).select("company").distinct()
    return results.sheet_names(names, "company", safe_sheet_base(F.col("company"), 6))


@query("""SELECT result_id, regexp_replace(coalesce(nullif(name, ''), 'unknown'), '[\\\\/:*?"<>|\\s]+', '_', 'g') AS file_name FROM metric_results""")
def safe_file_names(spark, d):
    return table(spark, d, "metric_results").select("result_id", safe_file_name(F.col("name")).alias("file_name"))


@query(f"SELECT result_id, {_CELL} AS cell FROM metric_results")
def value_cells(spark, d):
    return table(spark, d, "metric_results").select("result_id", value_with_unit(F.col("value"), F.col("unit")).alias("cell"))


# --- rules ------------------------------------------------------------------------------------------------------

_BLANK = lambda c: f"coalesce({sql.strip(c)}, '') = ''"


@query(
    f"""WITH nth AS (SELECT *, row_number() OVER (PARTITION BY profile, id ORDER BY rule_key) AS n FROM rules)
    SELECT profile, rule_key, 'missing id' AS fault FROM nth WHERE {_BLANK('id')} UNION ALL SELECT profile, rule_key, 'missing name' FROM nth WHERE {_BLANK('name')}
    UNION ALL SELECT profile, rule_key, 'duplicate id' FROM nth WHERE NOT {_BLANK('id')} AND n > 1 UNION ALL SELECT profile, rule_key, 'calc without formula' FROM nth WHERE extraction_mode = 'calc' AND {_BLANK('calc')}"""
)
def rule_lint(spark, d):
    return rules.rule_faults(table(spark, d, "rules"))


@query("SELECT profile, count(*) AS n_enabled FROM rules WHERE coalesce(enabled, true) GROUP BY profile")
def enabled_rule_counts(spark, d):
    return rules.enabled_rules(table(spark, d, "rules")).groupBy("profile").agg(F.count("*").alias("n_enabled"))


@query(
    f"""WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY rule_key) AS i FROM rules), given AS (SELECT *, CASE WHEN {_BLANK('id')} THEN printf('M%02d', i) ELSE {sql.strip('id')} END AS g FROM numbered),
    nth AS (SELECT *, row_number() OVER (PARTITION BY profile, g ORDER BY rule_key) AS n FROM given) SELECT rule_key, CASE WHEN n > 1 THEN g || '_' || i ELSE g END AS id FROM nth"""
)
def rule_ids(spark, d):
    return rules.distinct_ids(table(spark, d, "rules").select("rule_key", "profile", "id")).select("rule_key", "id")


@query("SELECT profile, rule_group, count(*) AS n_rules, string_agg(id, ',' ORDER BY rule_key) AS ids FROM rules GROUP BY profile, rule_group")
def rules_grouped(spark, d):
    return rules.rules_by_group(table(spark, d, "rules"))


@query(
    """SELECT rule_key, array_to_string(CASE WHEN coalesce(name_in_material, '') <> '' AND NOT list_contains(coalesce(aliases, []), name_in_material) THEN list_prepend(name_in_material, coalesce(aliases, [])) ELSE coalesce(aliases, []) END, '|') AS aliases FROM rules"""
)
def rule_aliases(spark, d):
    return rules.with_material_name(table(spark, d, "rules")).select("rule_key", F.array_join("aliases", "|").alias("aliases"))


@query(
    f"""SELECT rule_key, array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(array_to_string(aliases, '；'), ''), '[\\n；;，]', ',', 'g'), ','), lambda x: {sql.strip('x')}), lambda x: x <> ''), '|') AS entries FROM rules"""
)
def rule_list_cells(spark, d):
    """Lists written to a cell and read again."""
    return table(spark, d, "rules").select("rule_key", F.array_join(parse_list(F.array_join("aliases", "；")), "|").alias("entries"))


@query(
    """WITH texts AS (SELECT n.node_key, d.profile, lower(coalesce(n.title, '') || chr(10) || array_to_string(coalesce(n.body, []), chr(10))) AS t FROM outline_nodes n JOIN documents d USING (doc_id)),
    keys AS (SELECT rule_key, profile, lower(unnest(list_concat([name, name_in_material, rule_group], coalesce(aliases, [])))) AS k FROM rules)
    SELECT DISTINCT node_key, rule_key FROM texts JOIN keys USING (profile) WHERE coalesce(k, '') <> '' AND contains(t, k)"""
)
def section_metric_match(spark, d):
    nodes = table(spark, d, "outline_nodes").join(table(spark, d, "documents").select("doc_id", "profile"), "doc_id")
    return outline.matching_metrics(nodes, table(spark, d, "rules"), ["profile"])


# --- routing and sources ----------------------------------------------------------------------------------------

ROUTES = [("*energy*", "energy"), ("web/*_v[0-9].md", "versions"), ("*/draft?*", "never"), ("*_draft.md", "drafts"), ("DOCX/*", "word")]
_PATH = "coalesce(source, '') || '/' || coalesce(profile, '') || '.md'"
_ROUTED = " ".join(f"WHEN regexp_matches({_PATH}, {sql.quoted(routing.glob_to_regex(p))}) THEN {sql.quoted(t)}" for p, t in ROUTES)


@query(f"SELECT doc_id, CASE {_ROUTED} ELSE 'standard' END AS route FROM documents")
def route_profiles(spark, d):
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("profile", F.lit("")), F.lit(".md"))
    return table(spark, d, "documents").select("doc_id", routing.route(path, ROUTES, "standard").alias("route"))


@query("SELECT DISTINCT company AS profile FROM documents WHERE company IS NOT NULL AND company NOT IN (SELECT profile FROM profiles WHERE profile IS NOT NULL)")
def unknown_profiles(spark, d):
    """Companies taken for profiles, to have unknown ones."""
    return routing.unknown_profiles(table(spark, d, "documents").select(F.col("company").alias("profile")), table(spark, d, "profiles"))


@query("SELECT lower(coalesce(company, '') || '/' || coalesce(source, '')) AS path, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def distinct_materials(spark, d):
    """Materials by path regardless of case, the first kept."""
    path = F.lower(F.concat(F.coalesce("company", F.lit("")), F.lit("/"), F.coalesce("source", F.lit(""))))
    return table(spark, d, "documents").groupBy(path.alias("path")).agg(F.min("doc_id").alias("doc_id"))


KEYWORDS, BARRED = ["年度报告", "Annual Report"], ["摘要", "Summary"]


@query(
    """WITH titles AS (SELECT doc_id, company, fiscal_year, regexp_extract(coalesce(text, ''), '^[^\\n]*') AS title FROM documents WHERE company IS NOT NULL)
    SELECT company, fiscal_year, doc_id, CASE WHEN contains(title, 'Annual Report') THEN 'en' ELSE 'zh' END AS edition FROM titles
    WHERE contains(title, fiscal_year::VARCHAR) AND (contains(title, '年度报告') OR contains(title, 'Annual Report')) AND NOT (contains(title, '摘要') OR contains(title, 'Summary'))
    QUALIFY row_number() OVER (PARTITION BY company, fiscal_year ORDER BY edition, doc_id) = 1"""
)
def announcement_choice(spark, d):
    """Of each company and year the first title with the year and a keyword and nothing barred, the English edition preferred."""
    from ..operators.announcements import choose

    titled = table(spark, d, "documents").where(F.col("company").isNotNull()).select("doc_id", "company", "fiscal_year", F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^\n]*", 0).alias("title"))
    return choose(titled, ["company", "fiscal_year"], "fiscal_year", {"en": ["Annual Report"], "zh": ["年度报告"]}, BARRED, "doc_id")


@query("SELECT DISTINCT fiscal_year, fiscal_year || '-01-01~' || (fiscal_year + 1) || '-06-30' AS dates FROM documents WHERE fiscal_year IS NOT NULL")
def search_windows(spark, d):
    return table(spark, d, "documents").where(F.col("fiscal_year").isNotNull()).select("fiscal_year", search_window(F.col("fiscal_year")).alias("dates")).distinct()
