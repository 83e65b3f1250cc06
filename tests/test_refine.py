"""The refiner's behaviour on small texts, and its quirks."""

import json
import re
import tracemalloc
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill import semantics as S
from textmill.config import PRESETS, RefineConfig, gate, resolve
from textmill.functions import kernels as K
from textmill.functions import text as X
from textmill.operators import lines as L
from textmill.operators import refine as R


def run(text, preset="safe", decisions=False, **overrides):
    return K.refine(text, resolve(preset, **overrides), decisions)


def pages(make, n=6):
    return "\n\n\n".join("\n".join(make(i)) for i in range(1, n + 1))


HEADED = pages(lambda i: ["Institute Bulletin of many tests and trials", "Volume 7 of the bulletin series", f"Section {i}", *(f"text line number {i}.{j} goes on here" for j in range(8)), "printed by the institute press", "all copies numbered by hand 12"])


def test_artifacts_go():
    out, report = run("Hello\u00a0World\u200b\n\ufeffglyph<abc>\n........ 23")
    assert "Hello World" in out and not set("\u00a0\u200b\ufeff") & set(out) and "glyph<" not in out
    assert report.normalized_extracted and report.removed_toc_lines == 1 and report.output_len == len(out)


@pytest.mark.parametrize("text, want", [("ﬁ", "fi"), ("The law is E = mc^2.", "The law is E = mc^2."), ("", ""), (None, None), ("a\fb", "ab"), ("-5", "• 5"), ("---", "• --"), ("**bold**", "• *bold**"), ("Results… 23", "")])
def test_small_texts(text, want):
    assert run(text)[0] == want


def test_refining_again_changes_nothing():
    out, _ = run("Some   words\n\nwith   gaps\n• item")
    assert run(out)[0] == out


def test_prose_keeps_its_length():
    text = "A plain sentence that says little. " * 200
    assert len(run(text)[0]) > 0.95 * len(text)


def test_markdown_bullets():
    assert run("• Item one\n• Item two", profile="markdown_safe")[0] == "- Item one\n- Item two"


def test_soft_hyphens_stay_in_text_that_is_not_extracted():
    assert "\u00ad" in run("soft\u00adhyphen")[0] and "\u00ad" not in run("soft\u00adhyphen", normalize_extracted=True)[0]


def test_running_headers_go_and_sections_stay():
    out, report = run(HEADED, normalize_extracted=True, drop_repeated_lines="on")
    assert "Bulletin" not in out and "copies numbered" not in out and "Section 3" in out
    assert report.removed_header_footer_lines == report.removed_repeated_lines == 24


def test_five_blocks_are_too_few():
    text = HEADED.rsplit("\n\n\n", 1)[0]
    assert run(text, normalize_extracted=True, drop_repeated_lines="on")[1].removed_header_footer_lines == 0


def test_navigation_and_citations():
    out, report = run("Title\n[9] J. Smith, a cited work\nINTRODUCTION  METHODS  RESULTS  END\nText", normalize_extracted=True, decisions=True)
    by = {d.raw_text: d for d in report.decisions}
    assert by["INTRODUCTION  METHODS  RESULTS  END"].category == "toc_navigation" and by["[9] J. Smith, a cited work"].category == "other"
    assert "METHODS" not in out and report.removed_toc_lines == 0


def test_references_are_cut():
    out, report = run("Body\nReferences to work\n[1] One", "strict")
    assert out == "Body" and report.removed_references_lines == 2
    assert "Works cited" in run("Body\nWorks cited\n[1] One", "strict")[0]


@pytest.mark.parametrize("n, kept", [(7, True), (8, False)])
def test_single_character_runs(n, kept):
    out, _ = run("Start\n" + "\n".join("abcdefghij"[:n]) + "\nEnd", drop_layout_noise="on")
    assert ("\na\n" in out) == kept


@pytest.mark.parametrize("n, kept", [(3, True), (4, False)])
def test_axis_runs(n, kept):
    out, _ = run("Start\n" + "0.1234 0.5678 0.9012\n" * n + "End", drop_layout_noise="on")
    assert ("0.1" in out) == kept


def test_structure():
    assert "information is important." in run("This infor-\nmation is important.\nAnother line.", structure_mode="light", normalize_extracted=False)[0]
    assert run("a line that goes\non in lower case", structure_mode="light")[0] == "a line that goes on in lower case"
    out, report = run("Introduction\nSome text here.\nReferences\n[1] A work", structure_mode="aggressive", decisions=True)
    assert "## SECTION: Introduction" in out and "## REFERENCES" in out and "[1] A work" in out
    assert {"section_marker_inserted"} <= {d.category for d in report.decisions}


def test_profiles():
    assert K.text_profile("x" * 239) == "unknown" and K.text_profile(("word " * 30 + "\n") * 7) == "unknown"
    assert K.text_profile(("word " * 30 + "\n") * 8) == "clean_web"
    assert K.text_profile(("(cid:3) glyph<a> " + "word " * 10 + "\n") * 8) == "pdf_like"
    assert K.text_profile("a\nb\nc\n" * 10 + ("word " * 30 + "\n") * 10) == "ocr_like"


def test_counts_of_code_points_are_those_of_the_patterns():
    odd = "canción y y es\u2003a b c d e f\u00a0_a b c aaaaabbbbb\n\n\n\n\n\naaaa \ue000\ufffd\x80\u200b\U000e0001\U0001f600 \x1c\x85 \u00e9a b c9 x\ty\nz"
    for text in [odd[i : i + n] for n in (1, 2, 4, 5, 6, 9, 40, len(odd)) for i in range(len(odd))] + [odd * 2000]:
        strange = sum(not (c.isprintable() or c.isspace()) for c in text)
        want = (bool(re.search(S.PRIVATE, text)), bool(re.search(S.REPLACEMENT, text)), K.GONE_ALWAYS.search(text) is not None, strange, len(re.findall(S.LONG_RUN, text)), len(re.findall(S.BROKEN_WORDS, text)))
        assert K._counts(text) == want, text


def test_lines_of_words_are_not_searched_for_units(monkeypatch):
    searched = []
    for name in ("UNITS", "CAPTION"):
        monkeypatch.setattr(K, name, type("Searched", (), {"search": lambda self, line, p=getattr(K, name): searched.append(line) or p.search(line)})())
    words = "A line of common words that goes on and on for more than ninety characters, as lines of texts from the web usually do."
    assert run("glyph<a> (cid:3)\n" + f"{words}\n" * 20 + "0.1010 0.2020 0.3030 0.4040\n" * 4, "strict", drop_layout_noise="on")[1].removed_layout_noise_lines == 4
    assert set(searched) == {"0.1010 0.2020 0.3030 0.4040"}


def test_a_growing_paragraph_is_held_once():
    text = "Start of a paragraph, then\n" + "lines that are joined to it one by one, without an end and\n" * 1000
    tracemalloc.start()
    try:
        out = run(text, "strict")[0]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out == text.replace("\n", " ").strip() and peak < 60 * len(text)


def test_entities_count():
    assert not K.polluted("&amp; &lt;") and K.polluted("&amp; &lt; &gt;")


def test_config():
    assert resolve("raw") == resolve("safe") == PRESETS["bench"] and resolve("safe", collapse_blank_lines=False).collapse_blank_lines is False
    assert RefineConfig().keeps_tables and not resolve("strict").keeps_tables
    assert gate("on", False) and gate("auto", True) and not gate("auto", False) and not gate("nonsense", True)
    with pytest.raises(KeyError):
        resolve("none")


def test_columns_match_the_kernel(spark):
    texts = [HEADED, "Hello World", None, "", "glyph<a>\n........ 23", "| a |  b |\n x   y"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r[0] for r in table.select(R.refine("text")).collect()] == [run(t)[0] for t in texts]
    assert table.select(R.refine("text", "raw")).first()[0] == HEADED
    rows = R.with_report(table, "text", "doc_id", "light", decisions=True, detail=True, normalize_extracted=True, drop_repeated_lines="on").collect()
    for row, text in zip(rows, texts):
        out, report = run(text, "light", True, normalize_extracted=True, drop_repeated_lines="on")
        assert row.refined == out and row.report.detail_enabled and len(row.report.decisions) == len(report.decisions)
        assert row.report.removed_header_footer_lines == report.removed_header_footer_lines


def test_names_in_use_are_lengthened(spark):
    table = spark.createDataFrame([(1, "a  b", "x", 3)], "doc_id long, text string, Refined string, report int")
    out = R.with_report(table, "text", "doc_id")
    assert out.columns[2:] == ["Refined", "report", "refined_", "report_"] and out.first()["refined_"] == "a b"
    odd = spark.createDataFrame([("d", "x\n....... 3", 1)], "doc_id string, text string, report int")
    assert R.line_decisions(odd).count() == 2


def test_command_line():
    import subprocess
    import sys

    run_ = lambda *a: subprocess.run([sys.executable, "-m", "textmill", *a], input="a  b\n........ 23\nc", capture_output=True, text=True, check=True).stdout
    assert run_() == "a b\nc" and run_("raw") == "a  b\n........ 23\nc" and run_("safe", "profile=markdown_safe") == "a b\n........ 23\nc"


def test_exported_variants(spark):
    from textmill.config import VARIANTS
    from textmill.plans import reports

    rows = R.variants(spark.createDataFrame([("d", "This infor-\nmation.\n....... 3")], "doc_id string, text string"), VARIANTS, decisions=True)
    out = {r.variant: r for r in reports.variant_rows(rows).collect()}
    assert set(out) == set(VARIANTS) and out["raw"].decisions is None and out["structure"].text == "This information."
    assert list(out["plain"].decisions[0].asDict()) == ["action", "category", "page_idx", "line_idx", "raw_text", "normalized_text"]
    gone = [r for r in reports.removed_rows(rows).collect() if r.variant == "plain"]
    assert [(r.removal_type, r.repr_text, r.codepoints[0]) for r in gone] == [("toc", "'....... 3'", "U+002E")]


def test_decisions_table(spark):
    table = spark.createDataFrame([("a", "x😀\n....... 3")], "doc_id string, text string")
    rows = R.line_decisions(table).collect()
    assert [(r.line_idx, r.action, r.category) for r in rows] == [(0, "keep", "other"), (1, "drop", "toc")]
    assert list(rows[0].codepoints) == ["U+0078", "U+1F600"]


def test_native_stages_match_the_kernel(spark):
    text = HEADED + "\n\narXiv:1234.5678\na\nb\nc\nd\ne\nf\ng\nh\nONE  TWO  THREE\nReferences\n[1] x"
    cfg = resolve("safe", drop_layout_noise="on", drop_repeated_lines="on", drop_references_section="on", normalize_extracted=True)
    want = [(d.line_idx, d.action, d.category) for d in K.refine(text, cfg, True)[1].decisions]
    lines = L.exploded(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [tuple(r) for r in L.decided(lines).orderBy("line_idx").select("line_idx", "action", "category").collect()] == want


def test_native_predicates_match_the_kernel(spark):
    lines = ["", " ", "a", "é", "Introduction", "Methods and Results", "1. First", "Fig. 3 shows", "0.1 0.2 0.3 0.4 0.5", "12.5 km 13.5 km", "| a | b |", "it goes on", "9 it", "END  OF  ALL", "ONE  TWO  SIX", "https://x y", "Page 3 of 4", "A" * 91, "Références", "x - y", "10 000 000 - 20 000 000"]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, line string").coalesce(1)
    c = F.col("line")
    pairs = {"single": (X.is_single(c), K.is_single), "axis": (X.is_axis(c), K.is_axis), "nav": (X.is_navigation(c), K.is_navigation), "title": (X.is_title(c), K.is_title), "guard": (X.is_guarded(X.key_of(c)), lambda v: K.is_guarded(K.BLANKS.sub(" ", v.strip()))), "low": (X.starts_lower(c), K.starts_lower), "end": (X.is_terminal(c), K.is_terminal), "tab": (X.is_table(c), K.is_table)}
    rows = table.select("i", *(x.alias(n) for n, (x, _) in pairs.items())).orderBy("i").collect()
    for row, line in zip(rows, lines):
        assert {n: row[n] for n in pairs} == {n: bool(f(line)) for n, (_, f) in pairs.items()}, line


def test_lines_split_as_python_does(spark):
    texts = ["a\nb", "a\r\nb\n", "", "\n", "a\x0bb\x0cc\x1cd\x85e\u2028f", "a\n\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(X.lines_of(F.col("t"))).collect()
    assert [list(r[0]) for r in rows] == [t.splitlines() for t in texts]


def test_sources_and_sinks(spark, tmp_path):
    from textmill.sources import io

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ntwo")
    assert [tuple(r) for r in io.read_texts(spark, str(tmp_path / "in"), "*.txt").collect()] == [("a.txt", "one\ntwo")]
    with pytest.raises(FileNotFoundError):
        io.read_texts(spark, str(tmp_path / "in"), "*.pdf")
    table = spark.createDataFrame([("a", "x\n....... 3")], "doc_id string, text string")
    io.write_decisions(R.line_decisions(table), str(tmp_path / "d"), dropped_only=True)
    found = [json.loads(x) for p in (tmp_path / "d").glob("*.json") for x in p.read_text().splitlines()]
    assert [(d["line_idx"], d["category"], d["repeat_count"]) for d in found] == [(1, "toc", None)]
    io.write_xlsx(tmp_path / "t.xlsx", {"one": spark.createDataFrame([(1, "a<b", None, True, float("nan"))], "i int, s string, n string, b boolean, f double")})
    sheet = zipfile.ZipFile(tmp_path / "t.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert "a&lt;b" in sheet and 't="b"' in sheet and "C2" not in sheet
    rows = spark.createDataFrame([("d", 3, "a\nb")], "doc_id string, chunk_index int, chunk string")
    row = io.index_rows(rows, "raw").select("index_id", io.snippet(F.col("chunk"), 2).alias("s")).first()
    assert (row.index_id, row.s) == ("d__raw__3", "a ")
    io.write_texts(spark.createDataFrame([("x\ny",)], "text string"), str(tmp_path / "o"))
    assert "".join(p.read_text() for p in (tmp_path / "o").glob("*.txt")) == "x\ny\n"
    assert [io.column_name(i) for i in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]
    assert io.html_strings("<p>a<script>x</script>b</p>") == "a\nb"
    assert spark.range(1).select(io.doc_id_of(F.lit("https://a.b/c?d=é"))).first()[0] == "https_a_b_c_d_é"
    io.write_csv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "c"), ["b", "a"])
    assert "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv")).splitlines()[0] == "b,a"


def test_kernels_hold_few_texts_at_a_time(spark):
    """Arrow batches of all rows are given on in slices, and decisions without measures have no code points."""
    rows = spark.createDataFrame([(i, f"line {i}\nSubmitted to x\n(cid:3)") for i in range(1000)], "doc_id long, text string").coalesce(1)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in R._sliced(batches))
    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) <= R.SLICE
    found = R.variants(rows, {"safe": ("safe", {})}, decisions=True, measures=False).select("doc_id", F.explode("report.decisions").alias("d")).select("doc_id", "d.*").collect()
    assert len(found) == 2000 and all(r.codepoints is None and r.caps_ratio is None for r in found) and sum(r.category == "boilerplate" for r in found) == 1000


def test_raw_preset_needs_no_kernel(spark):
    rows = spark.createDataFrame([(1, "a\u00e9"), (2, None), (3, "")], "doc_id long, text string")
    got = R.with_report(rows, "text", "doc_id", "raw")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.refined, r.report.input_len, r.report.output_len, r.report.text_profile, r.report.decisions) for r in got.orderBy("doc_id").collect()] == [("a\u00e9", 2, 2, "unknown", []), (None, 0, 0, "unknown", []), ("", 0, 0, "unknown", [])]


def test_codepoints_of_any_text(spark):
    texts = ["", "a", "\u00e9 \u20ac", "\U0001f600x\U0010ffff", "0\ue001", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.codepoints(F.col("t")).alias("a"), X.codepoints_joined(F.col("t")).alias("j")).orderBy("i").collect()
    want = [None if t is None else [f"U+{ord(c):04X}" for c in t] for t in texts]
    assert [r.a for r in rows] == want and [r.j for r in rows] == [None if w is None else " ".join(w) for w in want]


def test_line_windows_have_partitions_by_size(spark, monkeypatch):
    rows = L.exploded(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    monkeypatch.setattr(L, "TASK_BYTES", -(-size // 23))
    assert L.together(rows).rdd.getNumPartitions() == 23
    assert L.together(spark.createDataFrame([(1, 0, "a")], "doc_id long, line_idx int, line string")).rdd.getNumPartitions() == 4
