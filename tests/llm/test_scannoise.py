from quireflow.llm.scannoise import Reader, find_scan_noise, furniture, inspect, is_page_number, repair_scans

WORDS = {w: 5000 for w in "the tax on delivery note comes to which includes footnote but not layout reading reader signed it separate cover department forwarded handwritten is still legible".split()} | {"hand-written": 4000, "third-party": 4000}


def noise(text):
    return inspect(text, Reader(WORDS))[0]


def test_kinds():
    text = "Acme Records | 1\nThe tax on the delivery note comes to which\nincludes the footnote but not the lay-\nout. The departmerit signed it and it is hand-\nwritten still.\n- 2 -\n\fAcme Recqrds | 2\nThe reader fonvarded the note which includes\nthe footnote."
    assert noise(text) == [(0, "running_header"), (2, "hyphenation"), (3, "misread"), (5, "page_number"), (6, "running_header")]


def test_repair():
    text = "The tax on the note comes to the deliv-\nery note c0mes to the reader, which includes\nthe footnote."
    assert inspect(text, Reader(WORDS))[1] == "The tax on the note comes to the delivery note comes to the reader, which includes the footnote."


def test_page_numbers():
    assert all(map(is_page_number, ["3", "- iv -", "[12]", "Page 4 of 8", "p. l of 3", "Blatt 2", "2/7", "xii", "— 9 —"]))
    assert not any(map(is_page_number, ["", "2021", "Invoice 7", "well", "12 lines", "a" * 5000]))


def test_a_title_is_no_header():
    assert furniture(["Minutes", "The tax on the note comes to it", "signed"])[0] == set()


def test_edges(spark):
    text = "The tax on the delivery note comes to the\nreader and the footnote is still legible."
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "=\\) '^ /\n:_]({>^}:_\n<;;*))"), (5, (text + "\n") * 3000), (6, text.replace("delivery", "de1ivery"))]
    df = spark.createDataFrame([(*r, 7) for r in rows], "id int, text string, line_no int")
    assert [(r["id"], r["line_no"], r["noise_kind"]) for r in find_scan_noise(df, "text").filter("id <> 5").collect()] == [(6, 0, "misread")]
    fixed = {r["id"]: r["scan_repaired"] for r in repair_scans(df, "text").collect()}
    assert fixed[2] is None and fixed[3] == "" and fixed[4] == rows[4][1] and "delivery" in fixed[6]
    assert find_scan_noise(df.limit(0), "text").collect() == []


def test_a_misread_form_stays_one_in_a_large_corpus():
    text = "The tax tor the note comes to the reader."
    for times in (1, 1000):
        reader = Reader({w: n * times for w, n in {"the": 9000, "tax": 400, "for": 5000, "tor": 17, "note": 300, "comes": 300, "reader": 300, "to": 6000}.items()})
        assert inspect(text, reader) == ([(0, "misread")], "The tax for the note comes to the reader.")
        assert reader.judge("(for)") == (1, "(for)", None)


def test_a_header_that_stands_twice_once_damaged():
    body = ["The tax on the delivery note comes to which includes", "the footnote and the reader signed it for the cover", "department that forwarded the note to the reader and"]
    more = ["handwritten is still legible but not in the layout", "of what it signed separate from all that comes after"]
    for a, b in (("Schedule.B (continued)", "Schedule B (continued)"), ("Printed 06.10.2016", "Pricted 06.10.2016"), ("Toner cartridge Register 2019", "Toner .artridge Register 2019")):
        assert furniture([a, *body, b, *more])[0] == {0, 4}
    assert furniture(["Please note that the copy is dated and signed", *body, "Please note that the copy is burned and signed", *more])[0] == set()


def test_a_long_header():
    head = "Consolidated register of deliveries and returns of the northern reading rooms"
    text = iter(("the tax on it comes to what includes the note but", "signed for all that was forwarded under a cover of", "handwritten pages are legible but separate from it", "layout and footnote were read by another of the two", "department heads do ask for a copy of every letter", "neither of them was there when the box came back in", "some weeks later it was found behind a cabinet with", "registers of an older kind, bound in green leather,", "which nobody had opened since the move of the rooms", "into the cellar, where they have been kept dry ever"))
    lines = [x for n in range(5) for x in (("\f" if n else "") + head.replace("deliveries", "delivcries" if n == 2 else "deliveries"), next(text), next(text), f"- {n + 1} -")]
    assert len(head) > 70
    assert furniture(lines) == ({0, 4, 8, 12, 16}, {3, 7, 11, 15, 19})


def test_verdicts_are_the_same_for_a_thousand_copies():
    counts = {"the": 900_000, "department": 3000, "for": 60_000, "tor": 170, "reader": 900, "comes": 800, "note": 700}
    tokens = ["departrnent", "departm3nt", "tor", "rcader", "notc", "c0mes", "unseenword"]
    verdicts = [[Reader({w: n * k for w, n in counts.items()}, 7_000_000 * k).judge(t) for t in tokens] for k in (1, 1000)]
    assert verdicts[0] == verdicts[1] and [v[2] for v in verdicts[0]] == ["department", "department", "for", "reader", "note", "comes", None]


def test_furniture_of_a_long_text_is_not_quadratic():
    import time

    took = []
    for pages in (400, 1600):
        lines = [x for n in range(pages) for x in (f"\fRegister {n % 7} of the north | {n}", *(f"entry {n * 31 + k} of the reading room number {k * 17 + n}" for k in range(18)))]
        t = time.process_time()
        assert len(furniture(lines)[0]) >= pages
        took.append(time.process_time() - t)
    assert took[1] < 10 * took[0] + 0.5
