import json
import pathlib

from quireflow import pipeline
from quireflow.sources import scan

LINES = [("Invoice 2020", 0.9, (0.0, 0.0, 90.0, 10.0)), ("Item\tPrice", 0.9, (0.0, 12.0, 90.0, 10.0)), ("Pen\t1.50", 0.9, (0.0, 24.0, 90.0, 10.0))]


def _engines():
    tokens = [{"text": t, "confidence": c, "bbox": dict(zip("xywh", b))} for t, c, b in LINES]
    scan.register("first", 0, lambda content, path: {"text": content.decode(), "confidence": 0.9, "lines": tokens} if content != b"?" else {})
    scan.register("second", 1, lambda content, path: {"text": content.decode().replace("o", "0").replace("?", ""), "confidence": 0.5})
    scan.register("failing", 2, lambda content, path: 1 / 0)


def test_folder_to_json(spark, tmp_path):
    _engines()
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.png").write_bytes(b"Invoice 2020\nTotal: $12.00\nItem\tPrice\nPen\t1.50")
    (folder / "b.jpg").write_bytes(b"?")
    (folder / "c.txt").write_bytes(b"not read")
    summary = pipeline.process_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["first", "second", "failing"])
    assert {r["status"]: r["documents"] for r in summary.collect()} == {"success": 1, "no_valid_results": 1}
    rows = {r["status"]: r for f in pathlib.Path(tmp_path / "out").rglob("*.json") for r in map(json.loads, f.read_text().splitlines())}
    good, bad = rows["success"], rows["no_valid_results"]
    assert good["consensus"]["method"] == "high_similarity_highest_confidence" and good["consensus"]["consensus_text"].startswith("Invoice 2020")
    assert good["structure"]["tables"] == 1 and good["errors"] == ["division by zero"] and set(good["text_variations"]) == {"first", "second", "failing"}
    assert [(f["field"], f["value"], f["field_kind"], f["confidence"]) for f in good["fields"]] == [("Total", "$12.00", "currency", 0.95)]
    assert {t["type"] for t in good["types"]} >= {"invoice_receipt"} and bad["document_type"] == "unknown_document" and "consensus_text" not in bad["consensus"]


def test_pages(spark):
    scans = spark.createDataFrame([("a.pdf", b"1|2|3"), ("b.png", b"x"), ("c.pdf", b"")], "path string, content binary")
    got = pipeline.split_pages(scans, lambda content, path: content.split(b"|") if path.endswith("pdf") else 1 / 0).collect()
    assert sorted((r["path"], r["page_no"], bytes(r["content"])) for r in got) == [("a.pdf", 1, b"1"), ("a.pdf", 2, b"2"), ("a.pdf", 3, b"3"), ("b.png", 1, b"x"), ("c.pdf", 1, b"")]


def test_rules(spark):
    fields = spark.createDataFrame([(1, "Total", "EUR 12.50 net", "invoice"), (1, "Name", "Ann", "invoice"), (2, "Total", "7.00", None)], "doc_id int, field string, value string, document_type string")
    rules = spark.createDataFrame([("total", None, r"[A-Z]+", 0.2, 9), ("total", "invoice", r"\d+\.\d\d", 0.9, 2), ("name", "deed", "A", 1.0, 1)], "field_name string, document_type string, extraction_rule string, success_rate double, usage_count int")
    got = {(r["doc_id"], r["field"]): r["value"] for r in pipeline.apply_rules(fields, rules, "doc_id").collect()}
    assert got == {(1, "Total"): "12.50", (1, "Name"): "Ann", (2, "Total"): "7.00"}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from quireflow.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"Name: Ann Lee and more")
    (tmp_path / "plugin_of_test.py").write_text("from quireflow.sources import scan\nscan.register('plain', 0, lambda content, path: {'text': content.decode(), 'confidence': 0.8})\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert main([str(tmp_path / "in"), "--plugins", "plugin_of_test", "--engines", "plain", "--output", str(tmp_path / "res")]) == 0
    assert capsys.readouterr().out == "success: 1\n"
