"""Files in and out, adapters, the pipeline, streams and the command line."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyweave.__main__ import main
from tallyweave.operators import panels, pipeline
from tallyweave.operators.extraction import first_number_near_name
from tallyweave.operators.outline import blocks, slice_sections
from tallyweave.operators.rules import typed_rules
from tallyweave.sources import engines, files, office, writers
from tallyweave.streaming import incremental


def test_report_files(spark, tmp_path):
    for name in ("B.pdf", "a.PNG", "x_asimg.pdf", "notes.md", "w_mineru/c.pdf", "sub/d.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    listed = files.report_files(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in listed.collect()] == ["a.PNG", "B.pdf", "d.jpg"]
    assert files.union_of_materials([listed, listed.select(F.upper("path").alias("path"))]).count() == 3
    todo = listed.select(files.stem(F.col("path")).alias("stem"), F.lit("fast").alias("options"))
    done = spark.createDataFrame([("B", "fast", 2000), ("a", "fast", 10), ("d", "other", 2000)], "stem string, options string, size int")
    assert sorted(r.stem for r in files.pending(todo, done).collect()) == ["a", "d"]


def test_markdown_without_mark(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbf# A\nb\n")
    row = files.read_markdown(spark, str(tmp_path)).first()
    assert row.text == "# A\nb\n" and row.path.endswith("a.md")


def test_rule_and_route_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"_sig": "x", "rules": [{"id": "R1", "name": "n", "aliases": ["a"]}, {"id": "R1", "name": "m", "enabled": False, "group": "g"}]}), encoding="utf-8")
    rules = files.read_rules(spark, str(tmp_path / "r.json"), "p").orderBy("rule_key").collect()
    assert [(r.rule_key, r.enabled, r.rule_group, r.profile) for r in rules] == [(1, True, None, "p"), (2, False, "g", "p")]
    (tmp_path / "routes.json").write_text(json.dumps({"default": "d", "routes": [{"match": "*x*", "profile": "p"}, {"match": "y"}]}), encoding="utf-8")
    assert files.read_routes(str(tmp_path / "routes.json")) == ([("*x*", "p")], "d")


def test_layout_files(spark, tmp_path):
    span = {"content": "Net Profit!"}
    nested = {"pdf_info": [{"page_idx": 0, "page_size": [100.0, 200.0], "para_blocks": [{"type": "text", "bbox": [0.0, 20.0, 9.0, 40.0], "lines": [{"spans": [span]}]}, {"type": "table", "bbox": [0.0, 50.0, 9.0, 100.0], "blocks": [{"type": "table_body", "lines": [{"spans": [{"html": "<td>5</td>"}]}]}]}]}]}
    (tmp_path / "m.json").write_text(json.dumps(nested))
    assert [(r.page, r.is_table, r.norm, r.yf0, r.yf1) for r in files.layout_anchors(spark, str(tmp_path / "m.json")).orderBy("yf0").collect()] == [(1, False, "netprofit", 0.1, 0.2), (1, True, "5", 0.25, 0.5)]
    (tmp_path / "f.json").write_text(json.dumps([{"type": "text", "bbox": [0.0, 10.0, 1.0, 50.0], "page_idx": 0, "text": "a"}, {"type": "table", "bbox": [0.0, 60.0, 1.0, 100.0], "page_idx": 0, "table_body": "<b>c</b>"}]))
    assert [(r.norm, r.yf1) for r in files.flat_anchors(spark, str(tmp_path / "f.json")).orderBy("yf0").collect()] == [("a", 0.5), ("c", 1.0)]


def test_thin_rules(spark):
    strokes = spark.createDataFrame([(1, 1, "line", 0.0, 5.0, 50.0, 5.2), (1, 1, "line", 0.0, 5.0, 3.0, 5.0), (1, 1, "box", 50.0, 9.0, 0.0, 11.0), (1, 1, "box", 0.0, 0.0, 50.0, 30.0)], "doc_id bigint, page int, kind string, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.y, r.x0, r.x1) for r in files.thin_rules(strokes).collect()) == [(5.0, 0.0, 50.0), (9.0, 0.0, 50.0)]


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    names = office.write_workbook(path, [("A/B", [["id", "name", "启用"], ["R1", "毛利率", "否"], [None, "x", None], ["R2", 5.5, None]]), ("a_b", [["only"]]), ("", [])])
    assert names == ["A_B", "a_b_2", "Sheet"] and zipfile.is_zipfile(path)
    sheets = dict(office.read_workbook(path))
    assert sheets["A_B"] == [["id", "name", "启用"], ["R1", "毛利率", "否"], [None, "x"], ["R2", "5.5"]]
    cells = office.rule_cells(path)
    typed = typed_rules(spark.createDataFrame([(c.get("id"), c.get("name"), c.get("enabled"), c["rule_group"]) for c in cells], "id string, name string, enabled string, rule_group string"))
    assert [(r.id, r.enabled, r.rule_group) for r in typed.collect()] == [("R1", False, "A_B"), ("R2", True, "A_B")]
    frame = spark.createDataFrame([("R1", 1.5), ("R2", None)], "id string, v double")
    writers.save_workbook(path, [("Comparison", frame)])
    assert office.read_workbook(path)[0][1] == [["id", "v"], ["R1", "1.5"], ["R2"]]
    with pytest.raises(ValueError):
        writers.save_workbook(path, [("x", frame)], most=1)


def test_documents(spark, tmp_path):
    path = str(tmp_path / "d.docx")
    text = "# Title\npara\n\n| a | b |\n|---|---|\n| 1 | 2 |"
    writers.markdown_document(path, blocks(spark.createDataFrame([(1, text)], "doc_id bigint, text string")))
    assert office.read_document(path) == [("heading1", "Title"), ("text", "para"), ("table", [["a", "b"], ["1", "2"]])]


def test_proofreading(spark):
    sections = slice_sections(spark.createDataFrame([(1, "# --- Pages 1 - 2 ---\none <b>\n# --- Pages 3 - 4 ---\ntwo  ")], "doc_id bigint, text string"))
    html = writers.proofreading_pages(sections).first().html
    assert html.count("<section") == 2 and "one &lt;b&gt;" in html
    edits = spark.createDataFrame([(1, 2, "TWO \n")], "doc_id bigint, section_no int, body string")
    assert writers.merged_edits(sections, edits).first().text == "one <b>\n\nTWO\n"


def test_engines(spark):
    fine = spark.createDataFrame([("a.txt", bytearray(b"p1\x0cp2")), ("b.txt", None)], "path string, content binary")
    assert [(r.path, r.page, r.text, bool(r.error)) for r in engines.recognise(fine, "text").orderBy("path", "page").collect()] == [("a.txt", 1, "p1", False), ("a.txt", 2, "p2", False), ("b.txt", None, None, True)]

    def describer(path, context):
        if "bad" in path:
            raise OSError("no")
        return "" if "empty" in path else f"{context}!"

    images = spark.createDataFrame([("1", "x", "c"), ("2", "bad", ""), ("3", "empty", ""), ("4", None, "")], "ref string, path string, context string")
    assert [(r.status, r.text) for r in engines.describe(images, describer).orderBy("ref").collect()] == [("ok", "c!"), ("failed", None), ("empty", ""), ("missing", None)]


RULES = "rule_key bigint, id string, name string, source string, enabled boolean, allow_parent_note boolean, section_hint array<string>, aliases array<string>, company_hints array<string>, extraction_mode string, calc string"


def test_pipeline(spark):
    documents = spark.createDataFrame([(1, "一、概况\n净利润为 1,234 万元。"), (2, "nothing"), (3, None)], "doc_id bigint, text string")
    rules = spark.createDataFrame([(1, "R1", "净利润", None, True, False, None, ["净利润"], None, "direct", None), (2, "R2", "off", None, False, False, None, ["净利润"], None, "direct", None)], RULES)
    got = {(r.doc_id, r.id): (r.value, r.value_num, r.unit) for r in pipeline.extract(documents, rules, first_number_near_name).collect()}
    assert got == {(1, "R1"): ("1,234", 1234.0, "万元"), (2, "R1"): (None, None, None), (3, "R1"): (None, None, None)}
    whole = pipeline.extract_whole(documents, rules, lambda p: json.dumps([{"id": "R1", "value": 5 if "1,234" in p else None}]))
    assert {(r.doc_id, r.value) for r in whole.collect()} == {(1, "5"), (2, None), (3, None)}


def test_streams(spark, data, tmp_path):
    results = spark.read.parquet(f"{data}/metric_results.parquet")
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    results.repartition(3).write.parquet(source)
    incremental.run_all(incremental.normalised_stream(incremental.arriving(spark, source, results.schema, files_per_trigger=1)), target, marks)
    assert spark.read.parquet(target).count() == results.count()
    results.limit(5).write.mode("append").parquet(source)
    incremental.run_all(incremental.normalised_stream(incremental.arriving(spark, source, results.schema)), target, marks)
    assert spark.read.parquet(target).count() == results.count() + 5
    days = incremental.counts_by_day(incremental.arriving(spark, source, results.schema))
    query = days.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("days").agg(F.sum("n")).first()[0] == results.where("extracted_at IS NOT NULL").count() + results.limit(5).where("extracted_at IS NOT NULL").count()
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    documents.write.parquet(str(tmp_path / "docs"))
    incremental.run_all(incremental.chunk_stream(incremental.arriving(spark, str(tmp_path / "docs"), documents.schema)), str(tmp_path / "chunks"), str(tmp_path / "m2"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() > 100


def test_results_by_entity(spark, tmp_path):
    writers.save_results(spark.createDataFrame([("a", 1), ("b", 2)], "entity string, v int"), str(tmp_path / "r"), "entity")
    assert sorted(p.name for p in (tmp_path / "r").iterdir() if p.is_dir()) == ["entity=a", "entity=b"]


def test_command_line(capsys):
    assert main(["list"]) == 0 and "retrieve_topk" in capsys.readouterr().out


def test_figures_are_archived(spark):
    documents = spark.createDataFrame([(1, "before ![x](p/1.png) and ![y](2.png) and ![x](p/1.png)"), (2, "none"), (3, None)], "doc_id bigint, text string")
    index = spark.createDataFrame([(1, "late/1.png"), (0, "root/1.png")], "root_no int, path string")
    done, outcomes = panels.archived_images(documents, index, lambda refs: engines.describe(refs, lambda path, context: f"[{path}: {context}]"))
    assert {r.doc_id: r.text for r in done.collect()} == {1: "before \n\n[root/1.png: before ![x](]\n\n and ![y](2.png) and \n\n[root/1.png: before ![x](]\n\n", 2: "none", 3: None}
    assert sorted((r.ref, r.status) for r in outcomes.collect()) == [("2.png", "missing"), ("p/1.png", "ok")]


def test_inferred_rules(spark):
    reply = '```json\n[{"id": "A", "name": "n", "name_in_material": "m", "aliases": ["x"], "group": "g"}, {"id": "A", "name": "o"}, {"name": "p"}, {"id": "B", "name": " "}]\n```'
    got = panels.inferred_rules(spark.createDataFrame([("p", reply), ("q", "nonsense"), ("r", None)], "profile string, reply string"))
    assert [(r.id, r.name, list(r.aliases), r.rule_group) for r in got.orderBy("rule_key").collect()] == [("A", "n", ["m", "x"], "g"), ("A_2", "o", [], None), ("M03", "p", [], None)]


def test_anchors_of_sections(spark):
    anchors = spark.createDataFrame([(1, 2), (1, 9)], "doc_id bigint, page int")
    sections = spark.createDataFrame([(1, 1, 1, 3), (1, 2, 4, 6)], "doc_id bigint, section_no int, page_start int, page_end int")
    assert [(r.page, r.section_no) for r in panels.anchors_of_sections(anchors, sections).collect()] == [(2, 1)]
