"""Profiles, rule workbooks, pages as Markdown, the staged run, and errors that come out with the results."""

import json

import pytest

from tallyweave.operators import extraction, pagetext, pipeline, results, rules
from tallyweave.sources import office, profiles, writers

HEADERS = {
    "id": "编号", "name": "指标名称", "name_in_material": "素材中的叫法", "source": "口径", "enabled": "是否启用", "section_hint": "定位线索", "aliases": "别名", "extraction_mode": "抽取模式", "calc": "计算", "aggregation": "聚合", "allow_parent_note": "母公司附注", "skip_reason": "备注",
}


def test_headers_in_both_languages():
    assert all(rules.header_name(zh) == rules.header_name(en) == en for en, zh in HEADERS.items())
    assert [rules.header_name(h) for h in ("素材名称", "来源说明", "章节线索", "跳过原因", "anything")] == ["name_in_material", "source", "section_hint", "skip_reason", None]


def test_a_workbook_keeps_all_columns(spark, tmp_path):
    book = str(tmp_path / "rules.xlsx")
    office.write_workbook(book, [("资产", [list(HEADERS.values()), ["A1", "总资产", "资产总计", "年报", "是", "资产负债表，附注", "a；b", "calc", "x+y", "sum", "否", "无"]])])
    got = profiles.rules_of_workbook(spark, book).first().asDict()
    assert got["name_in_material"] == "资产总计" and got["source"] == "年报" and list(got["section_hint"]) == ["资产负债表", "附注"] and list(got["aliases"]) == ["a", "b"]
    assert (got["extraction_mode"], got["calc"], got["aggregation"], got["allow_parent_note"], got["skip_reason"], got["rule_group"]) == ("calc", "x+y", "sum", False, "无", "资产")
    cache = str(tmp_path / "cache" / "rules.json")
    first = profiles.cached_rules(spark, book, cache)
    assert [r.id for r in first.collect()] == ["A1"] and json.load(open(cache))["count"] == 1
    out = str(tmp_path / "again.xlsx")
    profiles.rules_workbook(out, first)
    again = profiles.rules_of_workbook(spark, out).first()
    assert again.id == "A1" and list(again.aliases) == ["a", "b"] and again.enabled and again.rule_group == "资产"


def test_profiles_are_saved_and_loaded(tmp_path):
    root = str(tmp_path)
    name = profiles.save_profile(root, " My / report ", {"language": "en", "retrieval": {"topk": 3}, "llm": {"max_chars_context": 99}, "chunking": {"max_chars": 7}}, [{"id": "A"}], {"whole_template": "W {context}"})
    assert name == "My_report" and profiles.list_profiles(root) == ["My_report"]
    got = profiles.load_profile(root, name)
    assert (got.language, got.topk, got.window, got.max_chars, got.whole_template, got.heading_levels) == ("en", 3, 99, 7, "W {context}", 6)
    with pytest.raises(ValueError, match="My_report"):
        profiles.load_profile(root, "other")
    with pytest.raises(ValueError):
        profiles.save_profile(root, "My report", {}, [])


def test_types_of_rules(spark):
    raw = spark.createDataFrame([(1, '{"aliases": ["a"], "enabled": true}'), (2, '{"aliases": "a", "enabled": "yes", "section_hint": null}'), (3, "{}"), (4, None)], "rule_key int, rule string")
    assert sorted((r.rule_key, r.fault) for r in rules.type_faults(raw).collect()) == [(2, "aliases is no list"), (2, "enabled is neither true nor false")]


def test_rules_block(spark):
    table = spark.createDataFrame([(1, "p", "A", "n", "x\ny ", "a/b"), (2, "p", "B", "m", None, None)], "rule_key int, profile string, id string, name string, source string, calc string")
    assert extraction.rules_block(table).first().rules_block == '- id: A | name: n | source: x y | calc: "a/b"\n- id: B | name: m'


RULES = "rule_key bigint, profile string, id string, name string, name_in_material string, source string, enabled boolean, allow_parent_note boolean, section_hint array<string>, aliases array<string>, company_hints array<string>, extraction_mode string, calc string, aggregation string, skip_reason string, rule_group string"


def rule(key, id_, name):
    return (key, "p", id_, name, None, None, True, False, None, [name], None, "direct", None, None, None, "g")


def test_errors_and_sources_come_out(spark):
    documents = spark.createDataFrame([(1, "p", "# Balance\nassets 5 units of account"), (2, "p", "# Other\nnothing of note")], "doc_id bigint, profile string, text string")
    table = spark.createDataFrame([rule(1, "A", "assets"), rule(2, "B", "zzz")], RULES)

    def failing(prompt):
        raise RuntimeError("service down")

    got = {(r.doc_id, r.id): r for r in pipeline.extract(documents, table, failing).collect()}
    assert len(got) == 4 and got[1, "A"].error == "service down" and got[1, "B"].error == got[2, "B"].error == pipeline.NO_CONTEXT
    good = {(r.doc_id, r.id): r for r in pipeline.extract(documents, table, extraction.first_number_near_name).collect()}
    assert good[1, "A"].value == "5" and good[1, "A"].value_num == 5.0 and "5" in good[1, "A"].source_text and good[1, "A"].error == ""
    whole = pipeline.extract_whole(documents, table, failing).collect()
    assert len(whole) == 4 and {r.error for r in whole} == {"service down"}

    def listing(prompt):
        return json.dumps({"results": [{"id": "A", "value": "7", "unit": "u", "source_text": "s"}]}) if "- id: A | name: assets" in prompt else "{}"

    told = {(r.doc_id, r.id): r for r in pipeline.extract_whole(documents, table, listing).collect()}
    assert (told[1, "A"].value, told[1, "A"].source_text, told[1, "A"].error, told[1, "B"].value) == ("7", "s", "", None)


def test_stages_end_at_an_error(spark):
    run = pipeline.run_stages([("a", lambda r: spark.range(2)), ("b", lambda r: 1 / 0), ("c", lambda r: r.results["a"])])
    assert list(run.results) == ["a"] and list(run.errors) == ["b"]
    assert list(pipeline.run_stages([("a", lambda r: 1), ("b", lambda r: 2)], wanted=["b"]).results) == ["b"]


def test_pages_as_markdown(spark):
    words = [(1, 1, i, x, y, x + 20, y + 8, t) for i, (x, y, t) in enumerate([(0.0, 10.0, "Above"), (40.0, 11.0, "it"), (0.0, 50.0, "in"), (0.0, 90.0, "below")])] + [(1, 2, 1, 0.0, 0.0, 9.0, 9.0, "next")]
    frame = spark.createDataFrame(words, "doc_id bigint, page int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")
    tables = spark.createDataFrame([(1, 1, 1, ["a", "b"], [["1|2", "x\ny"], ["", "3"]], 45.0, 60.0)], "doc_id bigint, page int, table_no int, labels array<string>, rows array<array<string>>, y0 double, y1 double")
    got = {r.page: r.text for r in pagetext.page_markdown(frame, tables).collect()}
    assert got[1] == "# --- PDF 物理切片：第 1 - 1 页 ---\n\nAbove it\n\n| a | b |\n| --- | --- |\n| 1\\|2 | x y |\n|  | 3 |\n\nbelow" and got[2].endswith("\n\nnext")
    assert pagetext.region_markdown(tables).count() == 1 and pagetext.region_markdown(tables, 3).count() == 0
    assert pagetext.wants_turning("zh", True) and not pagetext.wants_turning("en", True) and pagetext.with_content(spark.createDataFrame([("a",), (" ",), (None,)], "text string")).count() == 1


def test_report_document_and_aliases(spark, tmp_path):
    sections = spark.createDataFrame([(1, "One", "text a\ntext b"), (2, "Two", None)], "section_no int, title string, body string")
    records = spark.createDataFrame([(2, "A", "n", "5", "u"), (2, "B", None, None, None)], "section_no int, id string, name string, value string, unit string")
    path = str(tmp_path / "r.docx")
    writers.report_document(path, "Report", sections, records)
    assert office.read_document(path) == [("heading1", "Report"), ("heading2", "One"), ("text", "text a"), ("text", "text b"), ("heading2", "Two"), ("table", [["id", "name", "value"], ["A", "n", "5 u"], ["B", "", ""]])]
    got = {r.id: list(r.aliases) for r in results.with_aliases(records.select("id"), spark.createDataFrame([(1, "A", ["x"]), (2, "A", ["y"])], "rule_key int, id string, aliases array<string>")).collect()}
    assert got == {"A": ["x"], "B": []}


def test_prompts_are_written(spark, tmp_path):
    from datetime import datetime

    profiles.save_prompts(spark.createDataFrame([("a/b", "p1"), (None, "p2")], "rule_id string, prompt string"), str(tmp_path / "p"), at=datetime(2024, 1, 2, 3, 4, 5))
    assert sorted((r.file, r.value) for r in spark.read.text(str(tmp_path / "p")).collect()) == [("20240102_030405_000000_main_a_b", "p1"), ("20240102_030405_000000_main_unknown", "p2")]


class Service:
    def __init__(self, polls):
        self.polls, self.seen = list(polls), []

    def request(self, name):
        return f"job-{name}"

    def upload(self, job, name, content):
        self.seen.append((job, name, content))

    def poll(self, job):
        return self.polls.pop(0) if len(self.polls) > 1 else self.polls[0]

    def fetch(self, job):
        return ["p1", "p2"]


def test_job_services():
    from tallyweave.sources import engines

    waits = []
    service = Service(["queued", "running", "done"])
    assert engines.job_engine(service, 8, 30, waits.append)("a/b.pdf", b"x") == ["p1", "p2"] and waits == [8, 8] and service.seen == [("job-b.pdf", "b.pdf", b"x")]
    for polls in (["failed"], ["running"]):
        with pytest.raises(RuntimeError):
            engines.job_engine(Service(polls), 8, 30, waits.append)("b.pdf", b"")


def test_conversion_of_files(spark):
    from tallyweave.sources import engines

    files = spark.createDataFrame([("a.txt", bytearray("# 一、总则\nx\fy".encode())), ("b.txt", None)], "path string, content binary")
    got = {r.path: r for r in engines.convert(files, "text").collect()}
    assert got["a.txt"].text.count("物理切片") == 2 and got["a.txt"].text.endswith("y") and got["a.txt"].error == ""
    assert got["b.txt"].error and got["b.txt"].text == ""
    with pytest.raises(ValueError, match="text"):
        engines.convert(files, "none")


def test_announcements_of_a_folder(spark, tmp_path):
    from tallyweave.sources import engines

    for name in ("Acme 2023 annual.pdf", "Acme 2023 interim.pdf", "Acme 2022.pdf"):
        (tmp_path / name).write_text("")
    engines.DOWNLOADS["folder"] = engines.folder_source(str(tmp_path))
    wanted = spark.createDataFrame([("acme", 2023, "annual"), ("acme", 2021, "annual"), ("other", 2023, "annual")], "company string, year int, report_type string")
    got = [(r.company, r.year, r.title, r.error) for r in engines.announcements(wanted, "folder").orderBy("company", "year", "title").collect()]
    assert got == [("acme", 2021, "Acme 2022.pdf", ""), ("acme", 2021, "Acme 2023 annual.pdf", ""), ("acme", 2021, "Acme 2023 interim.pdf", ""), ("acme", 2023, "Acme 2023 annual.pdf", ""), ("other", 2023, None, "nothing found")]


def test_command_line(tmp_path, capsys):
    from tallyweave.__main__ import main

    profiles.save_profile(str(tmp_path), "p", {}, [])
    assert main(["profiles", str(tmp_path)]) == 0 and capsys.readouterr().out == "p\n"


def test_no_checkpoint_folder_on_a_cluster(spark, monkeypatch):
    from tallyweave import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Frame:
        sparkSession = type("S", (), {"sparkContext": Context()})()

    with pytest.raises(ValueError, match="checkpoint"):
        session.cut_lineage(Frame())
