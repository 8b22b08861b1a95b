"""Problems 2 to 6 and 9: kernels on golden cases, and the operators' defined results on odd tables."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.llm import languages, lookalikes, markup, pieces, residue, scans

# --- problem 2 --------------------------------------------------------------------------------------------------


def check_cut(text, limit, overlap):
    spans = pieces.cut(text, limit, overlap)
    assert spans[0][1] == 0 and spans[-1][2] == len(text)
    for (_, begin, end), (shown, begin2, _) in zip(spans, spans[1:]):
        assert end == begin2 and begin2 - shown == min(max(0, min(overlap, limit - 1)), begin2)
    assert all(end - shown <= limit and end > begin for shown, begin, end in spans)
    return spans


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 。.\n#|-中é́1A", min_size=1, max_size=300), st.integers(1, 60), st.integers(0, 70))
def test_pieces_cover_the_text(text, limit, overlap):
    check_cut(text, limit, overlap) if len(text) > limit else None
    assert len(pieces.cut(text, limit, overlap)) > 1 or len(text) <= limit


def test_pieces_end_at_boundaries():
    text = "# A\n" + "Sentence one is here. " * 10 + "\n# B\n" + "Another sentence. " * 10
    spans = check_cut(text, 250, 0)
    assert text[spans[1][1] :].startswith("# B") and len(spans) == 2
    assert pieces.cut("a" * 10, 10, 3) == [(0, 0, 10)] and pieces.cut("", 5, 0) == [(0, 0, 0)] and pieces.cut("abc", None, 1) == [(0, 0, 3)]


CHUNKS = "chunk_key bigint, profile string, section_path array<string>, page_start int, text string"


def test_splitting_odd_tables(spark):
    rows = [(1, "p", None, None, None), (2, "p", [], 1, ""), (3, "p", ["s", None], 2, "x" * 100), (3, "p", ["s", None], 2, "x" * 100), (4, None, None, None, "y" * 100), (5, "none", None, None, "y" * 100), (6, "q", None, None, "z" * 9)]
    limits = spark.createDataFrame([("p", 30, 5), ("p", 40, 3), ("q", None, 1), (None, 3, 0)], "profile string, chunk_max_chars int, chunk_overlap_chars int")
    frame = spark.createDataFrame(rows, CHUNKS).withColumn("piece_no", F.lit("clash")).withColumn("_max", F.lit(-1))
    got = pieces.split_oversized(frame, limits)
    by = {(r.chunk_key, r.n): r.c for r in got.groupBy("chunk_key", F.col("n_pieces").alias("n")).agg(F.count("*").alias("c")).collect()}
    assert by == {(1, 1): 1, (2, 1): 1, (3, 4): 8, (4, 1): 1, (5, 1): 1, (6, 1): 1}
    assert [r[0] for r in pieces.oversized(frame, limits).collect()] == [3]
    assert got.where("chunk_key = 3 AND length(text) > 30").count() == 0 and pieces.split_oversized(frame.limit(0), limits).count() == 0


# --- problem 3 --------------------------------------------------------------------------------------------------

HELD_OUT = {
    "en": "Our warehouses were full for most of the winter, so the new drivers had little to do until spring.",
    "fr": "Nos entrepôts étaient pleins pendant presque tout l'hiver, et les nouveaux chauffeurs avaient peu à faire avant le printemps.",
    "de": "Unsere Lager waren fast den ganzen Winter über voll, sodass die neuen Fahrer bis zum Frühling wenig zu tun hatten.",
    "es": "Nuestros almacenes estuvieron llenos casi todo el invierno, así que los nuevos conductores tuvieron poco que hacer hasta la primavera.",
    "zh": "整个冬天我们的仓库几乎都是满的，所以新来的司机直到春天之前都没有多少事情可做。",
    "ja": "冬の間ほとんどずっと倉庫がいっぱいだったので、新しい運転手たちは春まであまりすることがありませんでした。",
}


@pytest.mark.parametrize("lang", HELD_OUT)
def test_held_out_sentences(lang):
    told = languages.sentence_languages([HELD_OUT[lang]])
    assert [t[3] for t in told] == [lang] and 0 < told[0][4] <= 1


def test_what_is_no_sentence():
    texts = ["# Corporate Governance and Remuneration Report of the Company", "| a | b c d e f g h i j k l m n o p q r s t u v w x y z. |", "```\nfor page in range(10): print(page) and something else here.\n```", "q7x9 zk3vv81 mmqp0 xx77 kkrt9 wwz81 qqp.", "Short one.", "", "Yorrimund Trust Annual Report 2023"]
    assert languages.sentence_languages(texts) == []


def test_mixed_text_and_names():
    zh, en = HELD_OUT["zh"], HELD_OUT["en"]
    assert [t[3] for t in languages.sentence_languages([zh + " " + en])] == ["zh", "en"]
    assert [t[3] for t in languages.sentence_languages(["针对Marlowick Industrial Holdings地产开发服务的索赔尚处于早期阶段，无法可靠估计损失。"])] == ["zh"]
    assert [t[3] for t in languages.sentence_languages(["The directors consider the going-concern basis appropriate for 晟川控股, as before."])] == ["en"]
    assert [t[3] for t in languages.sentence_languages(["By Decem-\nber 2019, the brok-\nerage team moved to shared offices and kept its licences."])] == ["en"]


@pytest.mark.parametrize("label, lang", [("zh-CN", "zh"), ("ZH_Hant", "zh"), ("Chinese", "zh"), (" english ", "en"), ("fr-FR", "fr"), ("Deutsch", "de"), ("日本語", "ja"), ("es", "es"), ("auto", None), ("und", None), ("", None), (None, None), ("unknown", None)])
def test_labels(label, lang, spark):
    assert languages.label_language(label) == lang
    frame = spark.createDataFrame([("p", label)], "profile string, language string")
    assert languages.label_map(frame).first()._named == lang


def test_wrong_labels(spark):
    rows = [(1, "e", HELD_OUT["en"]), (2, "e", HELD_OUT["fr"]), (3, "e", HELD_OUT["en"] + "\n\n" + HELD_OUT["ja"]), (4, "n", HELD_OUT["en"]), (5, None, HELD_OUT["de"]), (6, "e", None), (7, "e", ""), (2, "e", HELD_OUT["fr"]), (8, "e", "x" * 100_000)]
    labels = spark.createDataFrame([("e", "EN"), ("n", "und"), (None, "de")], "profile string, language string")
    frame = spark.createDataFrame(rows, "chunk_key bigint, profile string, text string").withColumn("lang", F.lit("clash"))
    got = sorted(tuple(r) for r in languages.wrongly_labelled(frame, labels).collect())
    assert got == [(2, "fr"), (3, "en"), (3, "ja"), (4, "en"), (5, "de")]
    assert languages.wrongly_labelled(frame.limit(0), labels).count() == 0
    spans = languages.segments(frame.where("chunk_key = 3")).orderBy("segment_no").collect()
    assert [(s.segment_no, s.lang) for s in spans] == [(1, "en"), (2, "ja")] and spans[0].char_end <= spans[1].char_start


def test_groups_of_sentences_change_nothing(monkeypatch):
    texts = list(HELD_OUT.values()) * 5
    whole = languages.sentence_languages(texts)
    monkeypatch.setattr(languages, "TOGETHER", 150)
    assert languages.sentence_languages(texts) == whole


def test_one_very_long_text():
    text = (HELD_OUT["en"] + " " + HELD_OUT["zh"] + "\n") * 8000
    told = languages.sentence_languages([text, HELD_OUT["fr"]])
    assert len(told) == 16001 and told[-1][0] == 1 and {t[3] for t in told[:-1]} == {"en", "zh"}
    assert all(text[t[1] : t[2]].strip() in (HELD_OUT["en"], HELD_OUT["zh"]) for t in told[:-1])


def test_one_very_long_text_in_pieces():
    text = ("# Part\n" + "A sentence of some length stands here. " * 200 + "\n") * 300
    check_cut(text, 3000, 100)


# --- problem 4 --------------------------------------------------------------------------------------------------


def consistent(spark, values):
    frame = spark.createDataFrame(list(enumerate(values)), "k bigint, t string")
    return [r.text for r in lookalikes.consistent_texts(frame, "k", "t").orderBy("k").collect()]


def test_consistent_form(spark):
    given_ = ["Ｎｅｔ　ｐｒｏｆｉｔ", "Riѕk\u2007covеragе", "De\u0301ficit", "N\xadet", "收⼊\u200b率", "ｷｬｯｼｭﾌﾛｰ ﾋﾞﾙ", "ﬁnance", "a\nb", None, "", "H2O ² 5", "Ⅳ"]
    want = ["Net profit", "Risk coverage", "Déficit", "Net", "收入率", "キャッシュフロー ビル", "finance", "a\nb", None, "", "H2O ² 5", "Ⅳ"]
    assert consistent(spark, given_)[:-1] == want[:-1]


def test_digits_stay_digits(spark):
    values = [chr(c) for c in range(0x20, 0x3000) if unicodedata.category(chr(c)) in ("Nd", "No")]
    for before, after in zip(values, consistent(spark, values)):
        assert not any(ch.isalpha() for ch in after) or before == after


def test_aliases(spark):
    chunks = [(1, "p", "the Nеt profit rose"), (2, "p", "the Net profit rose"), (3, "p", "Net\nprofit"), (4, "p", "net profit"), (5, "q", "Nеt profit"), (6, "p", None), (7, "p", ""), (8, None, "Nеt profit"), (1, "p", "the Nеt profit rose"), (9, "p", "Nеt profit and Ｎｅｔ profit")]
    rules = [(1, "p", ["Net profit", "other"]), (2, "p", ["Ｎｅｔ profit"]), (3, "p", None), (4, "p", ["", "\u200b", None]), (5, None, ["Net profit"])]
    frame = spark.createDataFrame(chunks, "chunk_key bigint, profile string, text string").withColumn("form", F.lit("clash")).withColumn("aliases", F.lit("clash"))
    table = spark.createDataFrame(rules, "rule_key bigint, profile string, aliases array<string>")
    want = {(1, 1), (1, 9), (2, 1), (2, 2)}
    assert {tuple(r) for r in lookalikes.readable_aliases(frame, table).collect()} == want
    assert {tuple(r) for r in lookalikes.readable_aliases(frame, table, block_bytes=10).collect()} == want
    assert lookalikes.readable_aliases(frame.limit(0), table).count() == 0 and lookalikes.readable_aliases(frame, table.limit(0)).count() == 0


# --- problem 5 --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("<p>x</p>", {"html"}), ("x <BR />y", {"html"}), ("R&amp;D", {"html"}), ("</td></tr", {"html"}), ("<!-- page 3 -->", {"html"}), ("**x** y", {"markdown"}), ("`x_1`", {"markdown"}), ("[a](b.md)", {"markdown"}), ("![](i.png)", {"markdown"}), ("> quoted", {"markdown"}),
        ("x[^3]", {"markdown"}), ("~~x~~", {"markdown"}), ("```\ncode\n```", {"markdown"}), ("*x y*", {"markdown"}), ("__x__", {"markdown"}), ("'''x'''", {"wiki"}), ("[[A|b]]", {"wiki"}), ("{{note|x|4}}", {"wiki"}), ("== x ==", {"wiki"}), ("{| class\n|}", {"wiki"}),
        ("\\textbf{x}", {"latex"}), ("$\\Delta$", {"latex"}), ("\\(x\\)", {"latex"}), ("\\begin{tabular}{l}", {"latex"}), ("a 5\\% b", {"latex"}), ("$r_{1}=\\frac{a}{b}$", {"latex"}),
        # ordinary use
        ("# Heading", set()), ("| a | b |\n|---|---|", set()), ("- item\n* item\n1. item", set()), ("5 * 3 * 2 = 30", set()), ("under <5% and a < b", set()), ("R&D and P&L", set()), ("\\\\desk\\reports", set()), ("value_num_raw", set()), ("HK$5 million to HK$6 million", set()), ("see [3] and (a)[i]", set()), ("marked * or **, see {a, b}", set()), ("it's 'quoted'", set()), ("", set()), (None, set()),
    ],
)
def test_kinds_of_markup(text, kinds):
    assert markup.kinds(text) == kinds


@pytest.mark.parametrize(
    "text, clean",
    [
        ("<h3>T</h3>\n<ul><li>a</li><li>b</li></ul>", "### T\n\n- a\n\n- b"), ("<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("R&amp;D &lt; 5", "R&D < 5"), ("**b** _i_ [t](u) ![alt](i.png)", "b i t alt"), ("'''b''' [[A|c]] == x", "b c == x"),
        ("\\subsection{T}\n\\textbf{b} $x^{2}$", "### T\nb $x^{2}$"), ("\\(a+b\\)", "$a+b$"), ("```py\nx = '''1'''\n```\n'''b'''", "```\nx = '''1'''\n```\nb"), ("{| class\n! a !! b\n|-\n| 1 || 2\n|}", "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("plain", "plain"),
    ],
)
def test_conversion(text, clean):
    assert markup.convert(text)[0] == clean


def brute_repeated(tokens, pages, span, least):
    runs = {}
    for i in range(len(tokens) - span + 1):
        if len(set(pages[i : i + span])) == 1:
            runs.setdefault(tuple(tokens[i : i + span]), []).append(i)
    out = [False] * len(tokens)
    for starts in runs.values():
        where = {pages[i] for i in starts}
        if len(where) >= least:
            for i in starts:
                if pages[i] != min(where):
                    out[i : i + span] = [True] * span
    return out


def test_suffix_array_against_brute_force():
    import numpy as np

    random.seed(2)
    for _ in range(60):
        pages = sorted(random.randint(0, 4) for _ in range(120))
        tokens = [random.randint(0, 2) for _ in pages]
        span = random.randint(1, 6)
        assert markup.repeated(np.array(tokens), np.array(pages), span, 3).tolist() == brute_repeated(tokens, pages, span, 3)


def test_boilerplate_stays_once():
    line = "This page is provided by the portal of the exchange and may not be copied further."
    texts = [f"{line}\nunique {i}" for i in range(4)]
    assert markup.without_boilerplate(texts, [1, 2, 3, 4]) == [texts[0], "unique 1", "unique 2", "unique 3"]
    assert markup.without_boilerplate(texts, [1, 1, 1, 1]) == texts and markup.without_boilerplate([None, ""], [1, 2]) == [None, ""]


def test_markup_of_odd_tables(spark):
    rows = [(1, 1, "chunk_0001", None, None), (2, 1, "chunk_0002", "", []), (3, None, None, "**x**", ["<b>y</b>", None]), (3, None, None, "**x**", ["<b>y</b>", None])]
    frame = spark.createDataFrame(rows, "chunk_key bigint, doc_id bigint, chunk_id string, text string, section_path array<string>").withColumn("markup", F.lit("clash"))
    assert sorted(tuple(r) for r in markup.residue(frame).collect()) == [(3, "html"), (3, "markdown")]
    assert markup.convert_markup(frame).count() == 4 and markup.convert_markup(frame.limit(0)).count() == 0
    assert markup.clean_reports(frame).count() == 4


def test_clean_reports(spark):
    line = "This page is provided by the portal of the exchange and may not be copied further."
    rows = [(i, 1, f"chunk_{i:04d}", f"{line}\n**unique** {i}", None) for i in (1, 2, 3, 4)] + [(9, 1, "chunk_0004", f"{line}\n**unique** 4", ["*x*"])]
    frame = spark.createDataFrame(rows, "chunk_key bigint, doc_id bigint, chunk_id string, text string, section_path array<string>")
    got = {r.chunk_key: r.text for r in markup.clean_reports(frame).collect()}
    assert got == {1: f"{line}\nunique 1", 2: "unique 2", 3: "unique 3", 4: "unique 4", 9: "unique 4"}


# --- problem 6 --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "line, kind",
    [
        *((x, "page_no") for x in ("- 3 -", "第 12 页", "第3页 共9页", "12 / 180", "Page 4 of 90", "p. 7", "[5]", "－8－", "· 9 ·", "— 10 —", "47", "Seite 3 von 9")),
        *((x, "running_head") for x in ("沅岳能源2019年年度报告", "2021年年度报告 沅岳能源 12", "沅岳能源｜业绩摘要", "年度报告　分部报告 9", "Yorrimund Trust Annual Report 2021", "12 2020 Informe semestral | Grupo Almirande Invest", "MARLOWICK ENERGY QUARTERLY UPDATE", "Geschäftsbericht / Risikobericht", "霞橋ホールディングス II2019年年次報告書")),
        *((x, None) for x in ("2021", "§ 7", "50,677.24", "# 2021年年度报告 沅岳能源", "| 12 |", "", "本年度报告已由董事会批准。", "The annual report was approved.", "1,234", "净利润增长12%，达到", "12 months of Annual Report work were spent on it,")),
    ],
)
def test_margins(line, kind):
    assert scans.margin(line) == kind


def small_models():
    text = "the company recorded management of the balance and the compound interest. " * 60 + "由于期货业务管理层已经审计完毕。" * 60
    from collections import Counter

    words = Counter(w.lower() for w in scans._LATIN.findall(text))
    return scans.Lexicon(dict(words), sum(words.values())), scans.Contexts(*scans.context_counts(text))


@pytest.mark.parametrize(
    "lines, kinds",
    [
        (["the manage-", "ment of the company"], ["hyphen"]), (["the manage¬", "12 / 90", "ment"], ["hyphen", "page_no"]), (["the cornpany recorded"], ["ocr_char"]), (["the c0mpany"], ["ocr_char"]), (["the rec0rded manage- ", "rnent"], ["hyphen", "ocr_char"]),
        (["由于朝货业务管理层"], ["ocr_char"]), (["期货业务菅理层己经"], ["ocr_char"]), (["the company", "recorded the balance"], []), (["the balance of interest-", "the company"], []), ([None, ""], []), (["B2B and 5G in 2O21"], ["ocr_char"]), (["B2B and 5G in 2021"], []), (["RMB1,234 for R01 and FY21"], []), (["a loss of RMBl08.4 million"], ["ocr_char"]),
    ],
)
def test_noises(lines, kinds):
    lexicon, contexts = small_models()
    assert scans.noises([lines], lexicon, contexts) == [kinds]


def test_repair():
    lexicon, contexts = small_models()
    lines = ["the cornpany recorded manage-", "Page 3 of 9", "ment of the balance.", "", "由于朝货业务菅理层", "已经审计完毕。"]
    assert scans.repair(lines, lexicon, contexts) == ["the company recorded management of the balance.", "由于期货业务管理层已经审计完毕。"]


def test_paragraphs_are_kept_apart():
    lines = ["A first sentence that runs over", "two lines.", "# Heading", "- item one", "- item two.", "Another paragraph goes on here", "and ends."]
    assert [len(p) for p in scans.paragraphs(lines)] == [2, 1, 1, 1, 2]
    assert scans.paragraphs([]) == []


def test_scans_of_odd_tables(spark):
    chunks = spark.createDataFrame([(1, None), (2, ""), (3, "a\n- 3 -\nb"), (3, "a\n- 3 -\nb")], "chunk_key bigint, text string").withColumn("item", F.lit("clash"))
    nodes = spark.createDataFrame([(1, None), (2, []), (3, [None, "x", "第 3 页"])], "node_key bigint, body array<string>")
    assert sorted(tuple(r) for r in scans.scan_noise(chunks, nodes).collect()) == [("chunk", 3, "page_no"), ("node", 3, "page_no")]
    assert scans.scan_noise(chunks.limit(0), nodes.limit(0)).count() == 0
    assert scans.repaired(chunks, nodes).where("item = 'node'").count() == 1


# --- problem 9 --------------------------------------------------------------------------------------------------

PROSE = "On other days the department returned about forty clients to the portal for some minutes. The directors reviewed the accounts of the group and found that revenue had grown. Volume XX of the archive covers 2019; see [3] and the set {a, b}. "


@pytest.fixture(scope="module")
def models():
    import numpy as np

    text = (PROSE + "公司管理层认为本年度的业绩与上年同期相比有所增长，主要原因是客户需求增强。") * 400
    prose = np.bincount(residue.grams(residue.letters(text)), minlength=residue.BUCKETS).astype(float)
    shapes = np.bincount(residue.grams(residue.shape(text)[0], residue.SHAPE_GRAM), minlength=residue.BUCKETS).astype(float)
    return residue.Models(prose, shapes)


@pytest.mark.parametrize(
    "text, kind",
    [
        ("For the year {{company_name}} grew.", "placeholder"), ("收入为【此处填写金额】万元", "placeholder"), ("增长XX%，达到", "placeholder"), ("由（待填写）批准", "placeholder"), ("due on ____ at", "placeholder"), ("a fee of %(net_profit)s.", "placeholder"), ("by [Insert name] on", "placeholder"), ("the [PERIOD TBC]", "placeholder"),
        ("Lorem ipsum dolor sit amet fusce mauris", "filler"), ("此处为占位文本，排版时请删除。", "filler"), ("Body copy, body copy, body copy.", "filler"), ("404 Not Found", "error"), ("HTTP Status 502 - Bad Gateway", "error"), ("系统繁忙，请稍后再试", "error"), ("Seite nicht gefunden", "error"), ('{"code": 500, "message": "x", "trace": "1"}', "error"),
        ("Please enable JavaScript to view this page.", "script"), ("本页面需要 JavaScript 支持，请启用后重新加载。", "script"),
    ],
)
def test_residue(text, kind, models):
    assert {k for _, _, k in residue.residue_of(f"{PROSE}\n{text}\n{PROSE}", models)} == {kind}


@pytest.mark.parametrize(
    "text",
    [
        PROSE, "", None, " ", "On two days the client portal returned error 503 or 504 for about forty minutes, and the IT department reimbursed affected clients.", "The legal team replaced the placeholder clauses in its contract template and trained the branches in filling in every field.",
        "新版披露系统不再要求浏览器启用 JavaScript，公司预计可改善老旧终端的访问体验。", "三名离职人员会话过期后系统拒绝其访问，符合权限管理制度要求。", "注册地址：总部三层会议室；法定代表人职务：董事会秘书；编制日期：2020年1月8日；职工68人。",
    ],
)
def test_no_residue(text, models):
    assert residue.residue_of(text, models) == []


def test_thresholds_hold_on_held_out_sentences():
    label, mean, covered = residue.held_out()
    least, share = residue.thresholds()
    called = (mean >= least) & (covered >= share)
    assert (called & ~label).sum() <= residue.FALSE_ALARMS * (~label).sum() and (called & label).sum() >= 0.4 * label.sum()


def test_texts_are_judged_alone(models):
    """What stands before or behind a text in its batch changes nothing."""
    texts = ["404 Not Found", PROSE, "", "Please enable JavaScript to view this page.", "{{a}}"] * 3
    assert residue.find(texts, models) == [residue.residue_of(t, models) for t in texts]


def test_residue_of_odd_tables(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "404 Not Found"), (-3, "404 Not Found"), (-4, "x" * 200_000)], "doc_id bigint, text string")
    both = documents.unionByName(odd).withColumn("kinds", F.lit("clash"))
    marked = residue.mark_residue(both)
    assert marked.count() == documents.count() + 5 and marked.where("doc_id < 0 AND coverage > 0").count() == 2
    assert residue.with_residue(both).where("doc_id < 0").count() == 1 and residue.with_residue(both.limit(0)).count() == 0


# --- hostile texts ----------------------------------------------------------------------------------------------

HOSTILE = ["'a", "$a_{b ", "\\\\(", "[[a ", "{{a ", "<td x", "`a", "```\n", "**a ", "__a ", "==a\n", "{|\n", "<!--", "a!b", "ab-\n", "\n", "- a\n", "# a\n", "| a |\n", "XX", "lorem ipsum "]


@pytest.mark.parametrize("unit", HOSTILE)
def test_hostile_texts_take_linear_time(unit, models):
    import time

    lexicon, contexts = small_models()
    text = unit * 10_000
    for kernel in (markup.convert, lambda t: scans.noises([[t]], lexicon, contexts), lambda t: scans.repair([t], lexicon, contexts), lambda t: residue.residue_of(t, models), lambda t: languages.sentence_languages([t]), lambda t: pieces.cut(t, 1000, 50)):
        began = time.perf_counter()
        kernel(text)
        assert time.perf_counter() - began < 10


def test_frequent_residue_is_not_natural(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    page = "Sorry, the page you requested could not be found. Check the address or return to the home page."
    copies = documents.select((-F.col("doc_id") - 1).alias("doc_id"), F.lit(page).alias("text"))
    blank = documents.select((-F.col("doc_id") - 1_000_001).alias("doc_id"), F.lit("The report of {{company_name}} follows.").alias("text"))
    found = residue.with_residue(documents.unionByName(copies).unionByName(blank))
    assert found.where("doc_id < 0").count() == 2 * documents.count()


def test_long_placeholder(models):
    assert {k for _, _, k in residue.residue_of(f"{PROSE}\nSigned by [Insert name of the company and its auditor] today.\n{PROSE}", models)} == {"placeholder"}


def test_rare_words_keep_their_count_in_a_large_corpus(spark):
    """A word seen often enough against its look-alike stands, however large the rest is."""
    rows = [(i, "filler words " * 60_000) for i in range(30)] + [(100, "modern " * 30), (101, "modem " * 2), (102, "modem")]
    items = scans.items_of(spark.createDataFrame(rows, "chunk_key bigint, text string"), spark.createDataFrame([], "node_key bigint, body array<string>"))
    words, total, keys, counts = scans.corpus_counts(items)
    assert total > 3_500_000 and words["modem"] == 3 and words["modern"] == 30
    assert scans.Lexicon(words, total).misread("modem") is None


def test_readings_compete_on_one_path():
    words = {"department": 500, "depart": 100, "management": 400, "manage": 200, "of": 9000, "the": 9000, "long": 300, "term": 300, "information": 300}
    lexicon = scans.Lexicon(words, 100_000)
    assert scans.decoded("the clepart ment of", lexicon) == ("the department of", {"merge", "ocr_char"})
    assert scans.decoded("the depart ment ofmanagement", lexicon) == ("the department of management", {"merge", "split"})
    assert scans.decoded(scans.join_lines(["the inforrna-", "tion of"]), lexicon) == ("the information of", {"hyphen", "ocr_char"})
    assert scans.decoded(scans.join_lines(["the long-", "term man-", "age-", "ment"]), lexicon) == ("the long-term management", {"hyphen"})


def test_boilerplate_of_a_long_report(spark):
    notice = "This notice of the registrar holds for every page of the report and may not be copied."
    rows = [(i, 1, f"c{i:04d}", f"Own text {i}" + (f"\n{notice}" if i in (10, 80, 150) else ""), None) for i in range(1, 201)]
    frame = spark.createDataFrame(rows, "chunk_key bigint, doc_id bigint, chunk_id string, text string, section_path array<string>")
    got = {r.chunk_key: r.text for r in markup.clean_reports(frame).collect()}
    assert got[10].endswith(notice) and got[80] == "Own text 80" and got[150] == "Own text 150" and len(got) == 200


def test_boilerplate_goes_by_runs():
    run = "All rights reserved\nby the registrar of\nthe company and its agents\nin every country"
    texts = [f"own {i}\n{run}\n| own | {i} |" for i in "abcd"]
    assert markup.without_boilerplate(texts, [1, 2, 3, 4]) == [texts[0], *[f"own {i}\n| own | {i} |" for i in "bcd"]]
    code = [f"own {i}\n```\n{run}\nx = {i}\n```" for i in "abcd"]
    assert markup.without_boilerplate(code, [1, 2, 3, 4]) == code


# --- results depend on the row only -----------------------------------------------------------------------------


def test_languages_do_not_depend_on_the_batch(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/chunks.parquet").where("text IS NOT NULL").select("text").collect()]
    alone = [[row[1:] for row in languages.sentence_languages([t])] for t in texts]
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    together: list[list] = [[] for _ in texts]
    for number, *row in languages.sentence_languages([texts[i] for i in order]):
        together[order[number]].append(tuple(row))
    assert [[(*r[:3], round(r[3], 9)) for r in rows] for rows in together] == [[(*r[:3], round(r[3], 9)) for r in rows] for rows in alone]


def test_parts_of_a_long_text_change_nothing(monkeypatch, spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/chunks.parquet").where("text IS NOT NULL").orderBy("chunk_key").limit(60).select("text").collect()]
    whole = languages.sentence_languages(["\n\n".join(texts)])
    monkeypatch.setattr(languages, "TOGETHER", 700)
    parts = languages.sentence_languages(["\n\n".join(texts)])
    assert [r[:4] for r in parts] == [r[:4] for r in whole] and len(whole) > 100


def test_long_constructs_are_no_prose():
    cell = "The board of directors is pleased to present the annual report of the company. "
    for text in (f"<table>{cell * 400}</table>", f"<li>{cell * 20}</li>", f"\\begin{{tabular}}{{l}}{cell * 100}\\end{{tabular}}", f"<!--{cell * 10}-->"):
        assert languages.sentence_languages([text]) == []
    assert len(languages.sentence_languages([f"<table> {cell * 3}"])) == 3  # nothing closes it


def test_markup_loses_no_content():
    assert markup.convert("Intro <b>x</b>\n<!-- unclosed note\nNet profit 5\nMore text")[0] == "Intro x\n unclosed note\nNet profit 5\nMore text"
    assert markup.convert("<p>use `<div>` and `[[a]]` tags</p> [[b|c]]")[0] == "use <div> and [[a]] tags\n c"
    assert markup.convert("<table><tr><td>a|b</td><td>c</td></tr></table>")[0].split("\n")[0] == "| a\\|b | c |"
    long = "x_1 + " * 300
    assert markup.convert(f"with \\({long}y\\) done") == (f"with ${long}y$ done", {"latex"})
    rows = "".join(f"|-\n| {i} || {i}\n" for i in range(4000))
    clean, kinds = markup.convert("{|\n" + rows + "|}")
    assert kinds == {"wiki"} and clean.count("\n") == 4000 and "{|" not in clean


def test_every_script_is_composed(spark):
    texts = ["각", "각 x", "ẹ́", "が", "क़", "آ"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_key bigint, text string")
    got = [r.text for r in lookalikes.consistent_texts(frame, "chunk_key", "text").orderBy("chunk_key").collect()]
    assert got == [unicodedata.normalize("NFC", t.replace(" ", " ")) for t in texts]


def test_pieces_of_many_lines_take_linear_time():
    import time

    began = time.perf_counter()
    pieces.cut("a line of text without an end\n" * 80_000, 4000, 100)
    assert time.perf_counter() - began < 3


def test_splits_and_merges_of_misread_words_are_decoded_jointly():
    words = {"the": 9000, "of": 9000, "company": 500, "recorded": 500, "balance": 400, "management": 500, "manage": 100, "corn": 30}
    lexicon = scans.Lexicon(words, 100_000)
    assert scans.decoded("the cornpanyrecorded balance", lexicon) == ("the company recorded balance", {"split", "ocr_char"})
    assert scans.decoded("the corn pany recorded", lexicon) == ("the company recorded", {"merge", "ocr_char"})
    assert scans.decoded("manage rnent of the balance", lexicon) == ("management of the balance", {"merge", "ocr_char"})
    assert scans.decoded("the c0m pany recorded the ba1 ance", lexicon) == ("the company recorded the balance", {"merge", "ocr_char"})
