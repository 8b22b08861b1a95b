"""Retrieval, results and layout against plain loops."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import align, announcements, layout, results, retrieval, routing


def form(s):
    return "".join(unicodedata.normalize("NFKC", s or "").lower().split())


def loop_score(rule, chunk):
    text, section = form(chunk["text"]), form(" > ".join(chunk["section_path"] or []))

    def alternatives(term):
        term = (term or "").strip()
        parts = [p.strip() for p in term.split("/") if p.strip()]
        return parts or ([term] if term else [])

    total = sum(4.0 for a in rule["aliases"] or [] if any(form(g) in text for g in alternatives(a)))
    for hint in rule["company_hints"] or []:
        total += 10.0 * ((form(hint) in text) + (form(hint) in section)) if form(hint) else 0
    for i, hint in enumerate(rule["section_hint"] or []):
        groups = alternatives(hint)
        total += (2.0 + i) * any(form(g) in text for g in groups) + (3.0 + i) * any(form(g) in section for g in groups)
    return total + (1.0 if sum(s in (chunk["text"] or "") for s in retrieval.TABLE_SIGNALS) >= 2 else 0.0)


def test_scores_against_a_loop(spark, data):
    chunks, rules = spark.read.parquet(f"{data}/chunks.parquet"), spark.read.parquet(f"{data}/rules.parquet")
    got = {(r.chunk_key, r.rule_key): r.score for r in retrieval.scored(chunks, rules).collect()}
    want, local = {}, [c.asDict() for c in chunks.collect()]
    for rule in (r.asDict() for r in rules.collect()):
        for chunk in local:
            if chunk["profile"] == rule["profile"] and not rule["allow_parent_note"]:
                s = loop_score(rule, chunk)
                if s > 0:
                    want[chunk["chunk_key"], rule["rule_key"]] = s
    assert got == pytest.approx(want)


CHUNK = "doc_id int, chunk_key int, chunk_id string, section_path array<string>, text string, is_parent_note_block boolean"
RULE = "rule_key int, allow_parent_note boolean, aliases array<string>, section_hint array<string>, company_hints array<string>"


def test_parent_notes_and_table_signals(spark):
    chunks = spark.createDataFrame([(1, 1, "chunk_0001", None, "项目 本期", None), (1, 2, "chunk_0002", ["x"], "Ａlpha", True)], CHUNK)
    rules = spark.createDataFrame([(1, False, ["none"], None, None), (2, True, ["alpha/beta"], ["", "x"], None)], RULE)
    assert sorted((r.rule_key, r.chunk_key, r.score) for r in retrieval.scored(chunks.withColumn("profile", F.lit("p")), rules.withColumn("profile", F.lit("p"))).collect()) == [(1, 1, 1.0), (2, 2, 8.0)]


def test_ties_go_by_chunk_id_as_text(spark):
    pairs = spark.createDataFrame([(1, 1, "chunk_9999", 1, 1.0), (1, 2, "chunk_10000", 1, 1.0), (1, 3, "chunk_0001", 1, 0.5)], "doc_id int, chunk_key int, chunk_id string, rule_key int, score double")
    assert [(r.chunk_id, r["rank"]) for r in retrieval.best_chunks(pairs, 2).orderBy("rank").collect()] == [("chunk_10000", 1), ("chunk_9999", 2)]


def test_first_value_over_windows(spark):
    rows = [(1, "A", 1, 1, "null", None), (1, "A", 2, 1, "5", "x"), (1, "A", 3, 1, "6", "y"), (1, "B", 1, 1, "7", None), (1, "B", 1, 2, "8", None), (1, "C", 1, 1, "9", None), (1, "C", 1, 2, "", None)]
    frame = spark.createDataFrame(rows, "doc_id int, id string, window_no int, item_no int, value string, unit string")
    assert sorted((r.id, r.value, r.from_window) for r in results.first_present(frame, ["doc_id", "id"]).collect()) == [("A", "5", 2), ("B", "8", 1)]


def test_comparison(spark):
    rows = [(1, "R1", "x", "n1", "g", "5", "%"), (2, "R1", "y", "n2", "g", None, None), (3, "R2", "y", "only y", "h", "0", ""), (4, "R1", "x", "n1", "g", "6", "%"), (5, "R9", "z", "n", "g", "1", "")]
    frame = spark.createDataFrame(rows, "result_id int, id string, entity string, name string, rule_group string, value string, unit string")
    got = {r.id: (r.name, r.x, r.y) for r in results.comparison(frame, ["x", "y"]).collect()}
    assert got == {"R1": ("n1", "6 %", ""), "R2": ("only y", None, "0")}


def test_routes(spark):
    routes = routing.load_routes([{"match": "*hk*", "profile": "hk"}, {"match": "a/*", "profile": "a"}, {"match": "x"}, {"profile": "y"}])
    frame = spark.createDataFrame([("a/HK/b.md",), ("a/b.md",), ("c",), (None,)], "p string")
    assert [r[0] for r in frame.select(routing.route(F.col("p"), routes, "d")).collect()] == ["hk", "a", "d", "d"]


def test_overlay():
    assert routing.overlay({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"c": 3}, "d": {"e": 1}}) == {"a": {"b": 1, "c": 3}, "d": {"e": 1}}


def test_announcements(spark):
    rows = [(1, "c", 2023, "c 2023 年度报告"), (2, "c", 2023, "c 2023 Annual Report"), (3, "c", 2023, "c 2023 Annual Report Summary"), (4, "d", 2023, "d 2022 Annual Report")]
    got = announcements.choose(spark.createDataFrame(rows, "n int, company string, year int, title string"), ["company"], "year", {"en": ["Annual Report"], "zh": ["年度报告"]}, ["Summary"], "n")
    assert [(r.company, r.n, r.edition) for r in got.collect()] == [("c", 2, "en")]


def word(x0, y0, text, x1=None, h=8):
    return layout.make_word(float(x0), float(y0), float(x1 if x1 is not None else x0 + 5 * len(text)), float(y0 + h), text)


def table_page(top=0):
    words = [word(0, top, "Item"), word(100, top, "Note", 130), word(170, top, "2023", 200), word(240, top, "Change", 280)]
    words[2] = word(170, top, "Current", 205)
    for i, (label, note, now, change) in enumerate([("Revenue", "1", "1,234.00", "99.50"), ("Costs", "2", "2,345.00", "-"), ("Tax", "3", "1,111.10", "-"), ("Profit", "4", "9,876.50", "12.25")]):
        y = top + 14 * (i + 1)
        words += [word(0, y, label), word(125, y, note, 130), word(165, y, now, 205), word(255, y, change, 280)]
    return words


def test_tables_are_rebuilt():
    prose = [word(0, y, "plain prose") for y in (90, 110, 130, 150)]  # fewer than three lines between would not part the tables
    tables = layout.tables_of(table_page() + prose + table_page(200), [])
    assert len(tables) == 2 and tables[0].labels == ["Item", "Note", "Current", "Change"]
    assert tables[0].rows == [["Revenue", "1", "1,234.00", "99.50"], ["Costs", "2", "2,345.00", "-"], ["Tax", "3", "1,111.10", "-"], ["Profit", "4", "9,876.50", "12.25"]]
    assert tables[0].top < tables[1].top


def test_wrapped_labels_join_the_row_above():
    words = table_page() + [word(0, 35, "attributable")]
    assert layout.tables_of(words, [])[0].rows[1][0] == "Costs attributable"


def test_main_table_and_too_little():
    assert layout.main_table(table_page(), []).rows[0][0] == "Revenue"
    assert layout.main_table([word(0, 0, "x")], []) is None and layout.tables_of([], []) == []
    assert layout.main_table([word(0, i * 20, "prose") for i in range(6)], []) is None


def test_group_rules_cover_columns():
    words = [word(150, -14, "Group", 260)] + table_page()
    tables = layout.tables_of(words, [(-4.0, 150.0, 285.0)])
    assert tables[0].labels[2].startswith("Group") and tables[0].labels[3].startswith("Group")


def test_rebuilding_over_pages(spark):
    rows = [(d, p, i, w.x0, w.y0, w.x1, w.y1, w.text) for d in (1, 2) for p in (1, 2) for i, w in enumerate(table_page())]
    frame = spark.createDataFrame(rows, "doc_id bigint, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    rules = spark.createDataFrame([(1, 1, -4.0, 150.0, 285.0)], "doc_id bigint, page int, y double, x0 double, x1 double")
    assert layout.rebuild_tables(frame, rules).count() == 4
    assert layout.rebuild_tables(frame).count() == 4 and layout.rebuild_tables(frame, dominant=True).count() == 4


def test_alignment():
    blocks = [{"norm": "alphabeta", "table": False}, {"norm": "tabledata", "table": True}, {"norm": "gammadelta", "table": False}, {"norm": "", "table": False}]
    anchors = [{"norm": "alphabets", "table": False, "page": 1, "yf0": 0.1, "yf1": 0.2}, {"norm": "", "table": True, "page": 1, "yf0": 0.3, "yf1": 0.4}, {"norm": "gammadelt", "table": False, "page": 2, "yf0": 0.1, "yf1": 0.2}]
    assert [a and (a["page"], a["yf0"]) for a in align.align(blocks, anchors)] == [(1, 0.1), (1, 0.3), (2, 0.1), None]
    untyped = [a | {"table": False} for a in anchors[:1]] + [{"norm": "table", "table": False, "page": 1, "yf0": 0.3, "yf1": 0.4}, {"norm": "data", "table": False, "page": 1, "yf0": 0.4, "yf1": 0.5}]
    assert align.align(blocks[:2], untyped)[1] == {"page": 1, "yf0": 0.3, "yf1": 0.5}
    assert align.align(blocks, []) == [None] * 4


def test_alignment_sees_whole_blocks(spark, tmp_path):
    from tallyweave.plans import pages

    long = "| " + " | ".join(f"cell {i}" for i in range(60)) + " | closing balance of the year |"
    spark.createDataFrame([(1, 1, 1, [long])], "doc_id bigint, node_no int, node_key bigint, body array<string>").write.parquet(str(tmp_path / "outline_nodes.parquet"))
    spark.createDataFrame([(1, 7, 3, "closing balance of the year")], "doc_id bigint, chunk_key bigint, page_start int, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    assert [(r.page, r.yf0) for r in pages.align_blocks(spark, str(tmp_path)).collect()] == [(3, 7.0)]


def test_the_best_chain_against_all_chains():
    import itertools
    import random

    from tallyweave.operators import align

    rng = random.Random(2)
    for _ in range(300):
        options = [[(a, a + rng.randint(0, 1), float(rng.randint(1, 5))) for a in rng.sample(range(6), rng.randint(0, 3))] for _ in range(rng.randint(0, 4))]
        best = 0.0
        for chain in itertools.product(*[[None, *o] for o in options]):
            taken = [c for c in chain if c]
            if all(a[1] < b[0] for a, b in zip(taken, taken[1:])):
                best = max(best, sum(c[2] for c in taken))
        chosen = [c for c in align.best_chain(options) if c]
        assert sum(c[2] for c in chosen) == best and all(a[1] < b[0] for a, b in zip(chosen, chosen[1:]))


def test_replies_with_brackets_inside_strings():
    from tallyweave.operators.extraction import parse_reply

    assert parse_reply('so: {"value": "a } b", "unit": "{"} end', False) == [{"value": "a } b", "unit": "{"}]
    assert parse_reply("[note] {broken {\"value\": 1}", False) == [{"value": 1}] and parse_reply("[" * 100_000, True) is None
    assert parse_reply('{"results": []}', True) == [] and parse_reply('{"result": {"value": 2}}', False) == [{"value": 2}]
