import random

import numpy as np

from quireflow.llm.texttype import FUNCTIONS, TYPES, classify_texts, majority, measure

PROSE = "The tax on the delivery note comes to $58.92, which includes the footnote but\nnot the layout. It took 72 attempts to read the margin, partly because the ink\nwas third-party. Both readings agree on the interest rate, so the second reader\nfiled it under separate cover."
LIST = "Supplies to order:\n1) map tube for copy paper\n2) cable tie for microfilm reel\n3) feed roller\n4) mail tray"
TABLE = "Date\tReference\tAmount\n04/25/2022\tINV-20197\t66.21\n02/19/2022\tINV-80493\t1,969.86\n08/22/2020\tINV-96382\t73.99"
JUNK = "`_`-)._\\=#}<~[}}\n'#-><.#==_, _=>>]~]\n.::  :{/#}^^ =.<;~>##[^("


def test_kinds_and_edges(spark):
    rows = [(i, t) for i, t in enumerate([PROSE, LIST, TABLE, JUNK] * 15)] + [(60 + i, "TEST PAGE " * (20 + i)) for i in range(15)] + [(100, None), (101, ""), (102, " \n "), (103, PROSE * 400), (104, "scan " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id int, text string, text_kind string")
    out = classify_texts(df, "text")
    assert out.columns == ["id", "text", "text_stats", "text_kind", "text_posterior"]
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    assert [got[i]["text_kind"] for i in range(4)] == ["prose", "list", "table", "junk"]
    assert [got[i]["text_kind"] for i in (100, 101, 102)] == [None] * 3 and got[100]["text_stats"] is None
    assert got[103]["text_kind"] == "prose" and got[104]["text_kind"] == "junk"
    assert abs(sum(got[0]["text_posterior"].values()) - 1) < 1e-9
    assert classify_texts(df.limit(0), "text").collect() == []


def test_without_text(spark):
    df = spark.createDataFrame([(1, PROSE), (1, PROSE), (2, None)], "id int, text string")
    assert "text" not in classify_texts(df, "text", keep_text=False).columns
    assert classify_texts(df, "text", keep_text=False).count() == 3


def test_measure_of_nothing():
    assert not any(measure(""))


def planted():
    """(text, kind) with few words, marks and signs in common between the kinds; junk of six sorts."""
    rng = random.Random(3)
    small, big = "the of to in is and for was on it by".split(), "ledger carrier microfilm deposit notary envelope register balance parcel binding tenant surveyor".split()
    out = []
    for _ in range(150):
        words = [w for _ in range(rng.randint(20, 60)) for w in (rng.choice(small), rng.choice(big))]
        body, line = [], ""
        for k, w in enumerate(words):
            w = w.capitalize() if k % 14 == 0 else w + "." if k % 14 == 13 else w
            line = f"{line} {w}" if line else w
            if len(line) > 55:
                body.append(line)
                line = ""
        out.append(("\n".join([*body, line + "."]), "prose"))
        mark = rng.choice(["- ", "{}) ", ""])
        out.append(("\n".join(mark.replace("{}", str(k)) + " ".join(rng.choices(big, k=rng.randint(2, 4))) for k in range(rng.randint(5, 12))), "list"))
        sep = rng.choice(["\t", " | ", ";", ","])
        out.append(("\n".join(sep.join([f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/2020", f"INV-{rng.randint(10, 99)}", rng.choice(big), f"{rng.randint(1, 999)}.{rng.randint(10, 99)}"]) for _ in range(rng.randint(4, 9))), "table"))
        junk = [
            lambda: "\n".join("".join(rng.choices("#=~_/<>{}^.:;", k=30)) for _ in range(5)), lambda: "\n".join("SCAN PAGE " * 3 for _ in range(rng.randint(4, 9))), lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=400)),
            lambda: "\n".join(" ".join(f"{rng.randint(0, 255):02x}" for _ in range(12)) for _ in range(5)), lambda: "\n".join(" ".join(rng.choices("bcdfgklmnprst", k=12)) for _ in range(4)), lambda: "\n".join(" ".join("".join(rng.choices("bcdfghklmnprstvx", k=6)) for _ in range(6)) for _ in range(5)),
        ]
        out.append((junk[rng.randrange(6)](), "junk"))
    return out


def test_learned_weights_beat_the_majority(spark):
    cases = planted()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, text string")
    rows = classify_texts(df, "text").collect()
    right = sum(r["text_kind"] == cases[r["id"]][1] for r in rows) / len(cases)
    outcomes = np.array([[1 if low is not None and (v := r["text_stats"][name]) <= low else (1 if a == b else 2) if high is not None and r["text_stats"][name] >= high else 0 for name, low, high, a, b in FUNCTIONS] for r in rows])
    plain = sum(TYPES[p.argmax()] == cases[r["id"]][1] for p, r in zip(majority(outcomes), rows)) / len(cases)
    assert right > 0.98 and right > plain + 0.02


def test_repeated_texts_change_nothing(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(planted()[:200])], "id int, text string")
    many = df.union(df).union(df)
    assert {r["id"]: r["text_kind"] for r in classify_texts(many, "text").collect()} == {r["id"]: r["text_kind"] for r in classify_texts(df, "text").collect()}


def test_thresholds_use_one_statistic_each():
    assert len({f[0] for f in FUNCTIONS}) == len(FUNCTIONS) and sum(f[1] is not None and f[2] is not None and f[3] != f[4] for f in FUNCTIONS) <= 6
