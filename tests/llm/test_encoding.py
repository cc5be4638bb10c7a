import zlib
from collections import Counter

from quireflow.llm import encoding
from quireflow.llm.encoding import FOLDS, LEAST_MARGIN, Judge, Model, best_restoration, garbled, ngrams, repair_encoding, tally, train, undo, undone, validated_margin

CLEAN = ["Für den Vorgang wurde die Mängelliste geprüft und bestätigt, höflich und gültig.", "La señora ha añadido el albarán mañana; está todavía en revisión.", "À ce jour, le greffier n’a reçu ni le dossier médical.", "Мы просим оплатить счёт до конца месяца и вернуть печать.", "NÃO ASSINE: A CERTIDÃO NÃO É VÁLIDA. São Paulo, informação."]


def test_chains_round_trip():
    for true, read in (("utf-8", "cp1252"), ("cp1252", "mac_roman"), ("koi8-r", "cp1251"), ("cp1251", "latin-1"), ("cp1252", "cp437")):
        for w in ("geprüft", "señora") if true in ("utf-8", "cp1252") else ("печать",):
            bad = w.encode(true).decode(read)
            assert undo(bad, f"{true}>{read}") == w and (f"{true}>{read}", w) in undone(bad)


def test_twice_garbled():
    grams = {}
    for w in ("geprüft", "bestätigt"):
        for g, n in ngrams(w, 100).items():
            grams[g] = grams.get(g, 0) + n
    assert best_restoration(Model(grams), "geprüft".encode().decode("cp1252").encode().decode("cp1252"))[2] == "geprüft"


def test_repair(spark):
    bad = {10: CLEAN[0].encode().decode("cp1252"), 11: CLEAN[1].encode("cp1252").decode("mac_roman"), 12: CLEAN[3].encode("koi8-r").decode("cp1251"), 13: CLEAN[0] + "\n" + CLEAN[1].encode().decode("latin-1"), 14: "Der Verk�ufer hat es"}
    rows = [(100 + i, CLEAN[i % 5]) for i in range(100)] + list(bad.items()) + [(1, None), (2, ""), (3, "plain text"), (4, CLEAN[1] * 2000), (10, bad[10])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id int, text string, encoding_fix int")
    out = repair_encoding(df, "text")
    assert out.columns == ["id", "text", "encoding_fix"] and out.count() == len(rows)
    got = {r["id"]: r["encoding_fix"] for r in out.collect()}
    assert {i for i, f in got.items() if f["garbled"]} == set(bad)
    assert got[10]["restored"] == CLEAN[0] and got[11]["restored"] == CLEAN[1] and got[12]["restored"] == CLEAN[3] and got[13]["restored"] == CLEAN[0] + "\n" + CLEAN[1]
    assert got[14]["lost"] and got[1]["restored"] is None and got[2]["restored"] == ""
    assert repair_encoding(df.limit(0), "text").collect() == []


def test_held_out_passages(spark, data):
    """Precision and recall on the clean passages of other records, and the same passages garbled in every way."""
    docs = spark.read.parquet(f"{data}/../sf0.01/documents.parquet").select("text")
    model, margin = train(docs, "text")
    judge = Judge(model)
    other = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect() if r["text"] and "\ufffd" not in r["text"]]
    texts = [p for t in other for p in t.split("\n") if not p.isascii() and not judge.chains([w for w in p.split() if not w.isascii()], 1.0)]
    clean = [[w for w in p.split() if not w.isascii()] for p in dict.fromkeys(texts)]
    bad = [g for i, p in enumerate(clean) for k in range(i % 20, 180, 20) if len("".join(p)) > 8 and (g := garbled(p, k))]
    assert len(clean) > 100 and len(bad) > 300
    found = sum(bool(judge.chains(p, margin)) for p in bad)
    assert found >= 0.97 * len(bad)


def test_a_rare_long_word_is_no_garbled_one():
    """Garbled copies of a few records must not teach the model that their spelling is clean."""
    grams = {}
    for w, n in (("предварительной", 200), ("печать", 300), ("geprüft", 300), ("señora", 300)):
        for g, k in ngrams(w, n).items():
            grams[g] = grams.get(g, 0) + k
    judge = Judge(Model(grams))
    assert not judge.chains(["предварительной"], LEAST_MARGIN) and judge.chains(["предварительной".encode("cp1251").decode("cp1252")], LEAST_MARGIN) == {"cp1251>cp1252"}


def test_the_margin_grows_with_false_alarms():
    class Fixed:
        def score(self, words):
            return 7.2 if words == ["geprüft"] else 1.0 if words[0].isascii() else 14.0

    assert validated_margin(Fixed(), [["plain"]]) == LEAST_MARGIN  # nothing to garble
    assert validated_margin(Fixed(), [["geprüft"]] * 40) == 7.5


def test_every_clean_passage_counts_for_the_margin(spark, monkeypatch):
    """One unusual record raises the margin wherever it stands; the result is that of brute force, in any number of tasks."""
    texts = [f"{CLEAN[i % 3]} {i}" for i in range(60)] + ["Zażółć gęślą jaźń."]
    words = {t: [w for w in t.split() if not w.isascii()] for t in texts}
    part = {t: zlib.crc32(t.encode()) % FOLDS for t in texts}
    expected = Counter()
    for fold in range(FOLDS):
        grams = Counter()
        for t in texts:
            if part[t] != fold:
                for w in words[t]:
                    grams.update(ngrams(w))
        passages = {tuple(words[t]) for t in texts if part[t] == fold}
        expected += tally(Judge(Model(dict(grams))), [list(p) for p in sorted(passages)])
    seen = []
    cheapest = encoding.cheapest_margin
    monkeypatch.setattr(encoding, "cheapest_margin", lambda counts: seen.append(counts) or cheapest(counts))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert train(df, "text")[1] == 6.0
    monkeypatch.setattr(encoding, "TASK_PASSAGES", 2)
    assert train(df, "text")[1] == 6.0
    assert seen[0] == seen[1] == expected and sum(n for (bad, _), n in expected.items() if not bad) > FOLDS


def test_all_ways_of_garbling_are_judged():
    class Fixed:
        def score(self, words):
            return 14.0

    passages = [["geprüft", "señora"], ["печать"], ["plain"]]
    counts = tally(Fixed(), passages)
    assert sum(n for (bad, _), n in counts.items() if bad) == sum(bool(garbled(p, k)) for p in passages for k in range(180))
