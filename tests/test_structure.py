"""Chunks, headings, tables and sections against plain loops and golden cases."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import chunks as C
from tallyweave.operators import extraction, figures, grids, headings, outline
from tallyweave.operators.rules import distinct_ids, header_name, rule_faults, typed_rules


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def loop_chunks(text, limit):
    """The chunker as a loop."""
    out, stack, pages, held = [], [], (None, None), None
    for raw in text.splitlines():
        bare = raw.strip()
        marker = re.match(r"^\s*#\s*---.*?(?:第|Pages?)\s*(\d+)\s*-\s*(\d+)\s*(?:页)?.*?---\s*$", bare, re.I)
        head = re.match(r"^(#{1,6})\s+(.*)$", bare)
        if marker:
            pages, held = (int(marker[1]), int(marker[2])), None
        elif head:
            del stack[len(head[1]) - 1 :]
            stack.append(head[2].strip())
            held = [raw]
            out.append((pages, list(stack), held))
        elif bare:
            if held is None or len("\n".join([*held, raw])) > limit:
                held = []
                out.append((pages, list(stack), held))
            held.append(raw)
    return [(f"chunk_{i + 1:04d}", *p, s, "\n".join(h).strip()) for i, (p, s, h) in enumerate(out)]


def test_chunks_against_a_loop(spark):
    random.seed(7)
    pool = ["# A", "## B", "### C", "#### D", "", "  ", "text one", "another line of text", "# --- PDF 物理切片：第 3 - 4 页 ---", "# --- Pages 7 - 9 ---", "x" * 60, "#NoSpace", "  indented"]
    texts = ["\n".join(random.choices(pool, k=random.randint(0, 40))) for _ in range(60)] + ["", None, "\n\n", "y" * 500]
    got = C.build_chunks(docs(spark, texts), max_chars=50)
    by = {}
    for r in got.orderBy("doc_id", "chunk_id").collect():
        by.setdefault(r.doc_id, []).append((r.chunk_id, r.page_start, r.page_end, list(r.section_path), r.text))
    for i, text in enumerate(texts):
        assert by.get(i, []) == loop_chunks(text or "", 50), text


def test_breadcrumbs_differ(spark):
    text = "# A\n### B\n### C\nline\n| x | 1 |"
    chunk = C.build_chunks(docs(spark, [text])).orderBy(F.desc("chunk_id")).first()
    assert list(chunk.section_path) == ["A", "B", "C"]
    assert grids.pipe_tables(docs(spark, [text])).first().title == "A > C"


@pytest.mark.parametrize(
    "line, want, language, promote",
    [
        ("# 1.1 X", "#### 1.1 X", "zh", False), ("# （一）X", "## （一）X", "zh", False), ("# X", "## X", "zh", False), ("2024 年度", "### 2024 年度", "zh", True), ("2024 年度", "2024 年度", "zh", False), ("#foo", "## foo", "zh", False),
        ("Note 5 Revenue", "#### Note 5 Revenue", "en", True), ("1.1 Basis", "### 1.1 Basis", "en", True), ("1. General", "## 1. General", "en", True), ("## **Business Review**", "# Business Review", "en", False),
        ("| 1. a |", "| 1. a |", "en", True), ("# --- Pages 1 - 2 ---", "# --- Pages 1 - 2 ---", "zh", True), ("一、" + "长" * 60, "一、" + "长" * 60, "zh", True),
    ],
)
def test_relevel(spark, line, want, language, promote):
    assert headings.relevel(docs(spark, [line]), language=language, promote=promote).first().text == want


def test_relevel_is_idempotent(spark, data):
    once = headings.relevel(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), promote=True)
    twice = headings.relevel(once, promote=True)
    assert once.exceptAll(twice).count() == 0


def test_page_ranges():
    assert C.page_range("12-5") == (5, 12) and C.page_range("7") == (7, 7) and C.page_range(None) is None
    for bad in ("x", "5-", "1-2-3", "-3"):
        with pytest.raises(ValueError):
            C.page_range(bad)


def test_page_filter_keeps_documents_without_pages(spark):
    chunks = spark.createDataFrame([(1, 1, None, None), (2, 2, None, None), (3, 2, 5, None), (4, 2, 9, 9)], "chunk_key int, doc_id int, page_start int, page_end int")
    assert sorted(r.chunk_key for r in C.on_pages(chunks, "4-6").collect()) == [1, 3]


def test_windows_hold_the_budget(spark):
    random.seed(1)
    sizes = [random.randint(1, 50) for _ in range(200)] + [500]
    frame = spark.createDataFrame([(1, f"{i:05d}", "x" * n) for i, n in enumerate(sizes)], "doc_id int, chunk_id string, text string")
    packed = C.pack_windows(frame, 100, block=F.col("text")).orderBy("window_no").collect()
    want, held = [], None
    for n in sizes:
        if held is None or held + n + 2 > 100:
            want.append(0)
            held = 0
        held += n + 2
        want[-1] += 1
    assert [r.n_blocks for r in packed] == want


def test_pipe_tables(spark):
    text = "| a | b |\n|---|---|\n| 1 |\n| - | - |\n|  |  |\n\n# T\n| **x** | y | z |"
    tables = grids.pipe_tables(docs(spark, [text])).orderBy("table_no").collect()
    assert [(t.title, [list(r) for r in t.grid]) for t in tables] == [("Table 1", [["a", "b"], ["1", ""]]), ("T", [["x", "y", "z"]])]


def test_spans():
    assert grids.expand_spans("<table><tr><td colspan=2>a</td><td>c</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>") == [["a", "", "c"], ["1", "2", "3"]]
    assert grids.expand_spans("<table><tr><td rowspan='2'>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == [["a", "b"], ["a", "c"]]
    assert grids.expand_spans("<table></table>") == []


def test_sections_keep_the_preamble(spark):
    text = "intro\n# --- Pages 1 - 2 ---\none\n# --- Pages 3 - 4 ---\ntwo"
    assert [(r.section_no, r.page_start, r.page_end, r.body) for r in outline.slice_sections(docs(spark, [text])).orderBy("section_no").collect()] == [(1, 1, 2, "intro\none"), (2, 3, 4, "two")]


def test_blocks_keep_fences_whole(spark):
    text = "a\n\n```\nx\n\ny\n```\n\n| h |\n|---|\n| 1 |"
    assert [(r.block, r.is_table) for r in outline.blocks(docs(spark, [text])).orderBy("block_no").collect()] == [("a", False), ("```\nx\n\ny\n```", False), ("| h |\n|---|\n| 1 |", True)]


def test_languages(spark):
    got = spark.createDataFrame([("",), (None,), ("123",), ("ab中文",), ("abc中文",)], "t string").select(outline.rough_language(F.col("t"))).collect()
    assert [r[0] for r in got] == ["zh", "zh", "zh", "zh", "en"]


def test_images_replaced(spark):
    frame = spark.createDataFrame([("a ![x](p/1.png) b ![](2.png) c ![z](3.png)", [("p/1.png", "ok", "T"), ("2.png", "empty", None), ("3.png", "failed", None)])], "t string, o array<struct<ref: string, status: string, text: string>>")
    assert frame.select(figures.replaced(F.col("t"), F.col("o"))).first()[0] == "a \n\nT\n\n b  c ![z](3.png)"


def test_replies():
    assert extraction.parse_reply('```json\n{"value": 1}\n```', False) == [{"value": 1}]
    assert extraction.parse_reply("[1]", False) is None
    assert extraction.parse_reply('x {"results": [{"id": 1}, 2]} y', True) == [{"id": 1}]
    assert extraction.parse_reply('[{"id": 1}]', True) == [{"id": 1}] and extraction.parse_reply('{"id": 1}', True) == [{"id": 1}]
    assert extraction.parse_reply(None, True) is None and extraction.parse_reply("nothing", True) is None


def test_retries_end_in_an_error_row(spark):
    calls = []

    def fails(prompt):
        calls.append(prompt)
        raise RuntimeError("rate limited")

    assert extraction.ask("p", fails, False) == ([], "rate limited") and len(calls) == 3


def test_templates_are_filled_in_one_pass(spark):
    frame = spark.createDataFrame([("{b} x", None)], "a string, b string")
    assert frame.select(extraction.render("{a}-{b}-{unknown}-{{}}", {"a": F.col("a"), "b": F.col("b")})).first()[0] == "{b} x-None-{unknown}-{}"


def test_rule_cells(spark):
    cells = spark.createDataFrame([("R1", "Name", "", "", "a；b"), ("", "x", "", "", ""), ("R2", "n", "否", "是", None)], "id string, name string, enabled string, allow_parent_note string, aliases string")
    got = {r.id: r for r in typed_rules(cells).collect()}
    assert set(got) == {"R1", "R2"} and got["R1"].enabled and not got["R1"].allow_parent_note and list(got["R1"].aliases) == ["a", "b"] and not got["R2"].enabled and got["R2"].allow_parent_note
    assert got["R1"].extraction_mode == "direct" and header_name(" 指标 名称 ") == "name" and header_name("nothing") is None


def test_rule_ids(spark):
    rules = spark.createDataFrame([(1, "p", "A"), (2, "p", "A"), (3, "p", ""), (4, "p", None), (5, "q", "A")], "rule_key int, profile string, id string")
    assert [r.id for r in distinct_ids(rules).orderBy("rule_key").collect()] == ["A", "A_2", "M03", "M04", "A"]


def test_rule_faults(spark):
    rules = spark.createDataFrame([(1, "p", "A", "n", "direct", None), (2, "p", "A", " ", "calc", ""), (3, "p", None, "n", None, None)], "rule_key int, profile string, id string, name string, extraction_mode string, calc string")
    assert sorted((r.rule_key, r.fault) for r in rule_faults(rules).collect()) == [(2, "calc without formula"), (2, "duplicate id"), (2, "missing name"), (3, "missing id")]


def test_scores_against_plain_search(spark):
    """The automaton gives what looking for each term gives, in one pass or in blocks of rules."""
    import random

    from tallyweave.operators import retrieval

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ab 資Ａ/") for _ in range(rng.randint(0, 4)))
    chunks = [(i, i, f"c{i}", rng.choice(["p", "q", None]), rng.choice([None, [], [word(), None]]), rng.choice([None, "", word() * 3 + " Unit Item "])) for i in range(60)]
    lists = lambda: rng.choice([None, [], [word(), None, word()]])
    rules = [(i, rng.choice(["p", "q", None]), False, lists(), lists(), lists()) for i in range(30)]
    left = spark.createDataFrame(chunks, "doc_id bigint, chunk_key bigint, chunk_id string, profile string, section_path array<string>, text string")
    right = spark.createDataFrame(rules, "rule_key bigint, profile string, allow_parent_note boolean, aliases array<string>, section_hint array<string>, company_hints array<string>")
    form = lambda t: "".join(unicodedata.normalize("NFKC", t or "").lower().split())

    def alternatives(term):
        parts = [p.strip() for p in (term or "").split("/") if p.strip()]
        return [form(p) for p in parts or [(term or "").strip()] if form(p)]

    wanted = {}
    for _, key, _, profile, path, text in chunks:
        body, section = form(text), form(" > ".join(p for p in path or [] if p is not None))
        for rule, of, _, aliases, sections, companies in rules:
            if profile is not None and of == profile:
                total = 1.0 * (sum(s in (text or "") for s in retrieval.TABLE_SIGNALS) >= 2)
                total += sum(4.0 * any(g in body for g in alternatives(t)) for t in aliases or [])
                total += sum(10.0 * (any(g in body for g in alternatives(t)) + any(g in section for g in alternatives(t))) for t in companies or [])
                total += sum((2.0 + i) * any(g in body for g in alternatives(t)) + (3.0 + i) * any(g in section for g in alternatives(t)) for i, t in enumerate(sections or []))
                if total:
                    wanted[key, rule] = total
    for block_bytes in (retrieval.BLOCK_BYTES, 300):
        assert {(r.chunk_key, r.rule_key): r.score for r in retrieval.scored(left, right, block_bytes=block_bytes).collect()} == wanted
    assert retrieval.scored(left, right.limit(0)).count() == 0 and retrieval.scored(left.limit(0), right).count() == 0
