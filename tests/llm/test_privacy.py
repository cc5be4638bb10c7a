import datetime as dt
import re

from hypothesis import given
from hypothesis import strategies as st

from quireflow.llm import privacy
from quireflow.llm.privacy import Finder, feistel, find_personal, pseudonym_date, pseudonym_number, pseudonym_phone, pseudonym_valid, redact, redacted, shifted_date, tag

KEY = b"secret"
F_ = Finder({"Tamsin", "Wystan"}, {"Braxenko", "Kolvardi", "Gostidge"})


def kinds(text):
    return [(k, text[a:b]) for k, a, b in sorted(F_.find(text), key=lambda m: m[1])]


def test_mentions():
    assert kinds("Name: Tamsin L. Braxenko lives at 2737 Holildden Court, Eskarbeck.") == [("name", "Tamsin L. Braxenko"), ("address", "2737 Holildden Court")]
    assert kinds("KOLVARDI, WYSTAN and Mrs Gostidge and W. Kolvardi") == [("name", "KOLVARDI, WYSTAN"), ("name", "Gostidge"), ("name", "W. Kolvardi")]
    assert kinds("Write to <t.brax+x@mail.pellar.test> or (315) 555-0172 ext. 4.") == [("email", "t.brax+x@mail.pellar.test"), ("phone", "(315) 555-0172 ext. 4")]
    assert kinds("holds social security number 952 43 2936, passport no. X4647848") == [("id_number", "952 43 2936"), ("id_number", "X4647848")]
    assert kinds("y (at) o (dot) test, P.O. Box 12, +33 1 99 00 67 10")[0] == ("email", "y (at) o (dot) test")


def test_no_mentions():
    for t in ["", "Kindly compare part 367-61-7387", "The number reads ***-**-4413", "The Kolvardi Agreement", "Gostidge & Kolvardi Ltd", "12 @ 4.50 each", "Tracking 9400 1187 2204", "INV-89226 of 2020"]:
        assert kinds(t) == []


def test_over_a_line_end():
    assert kinds("so Tamsin\nBraxenko called +1 315 555\n0147 instead") == [("name", "Tamsin\nBraxenko"), ("phone", "+1 315 555\n0147")]


@given(st.text("0123456789", max_size=20))
def test_feistel_is_a_permutation(s):
    out = feistel(s, "0123456789", KEY)
    assert len(out) == len(s) and feistel(out, "0123456789", KEY, back=True) == s


def test_feistel_covers_its_domain():
    assert len({feistel(f"{i:03}", "0123456789", KEY) for i in range(1000)}) == 1000


@given(st.dates(dt.date(1900, 1, 1), dt.date(2099, 12, 31)))
def test_dates_come_back(d):
    assert pseudonym_date(pseudonym_date(d, KEY), KEY, back=True) == d


def test_format_stays():
    out = pseudonym_number("+1 (315) 555-0172", KEY)
    assert [c if not c.isdigit() else "9" for c in out] == [c if not c.isdigit() else "9" for c in "+1 (315) 555-0172"]
    assert pseudonym_number(out, KEY, back=True) == "+1 (315) 555-0172"


def test_equal_values_stay_linked():
    t = "Tamsin Braxenko, tamsin   braxenko"
    assert redacted("a Tamsin Braxenko", [("name", 2, 17)], KEY)[2:] == redacted("Tamsin\nBraxenko", [("name", 0, 15)], KEY)
    assert redacted(t, [], KEY) == t


def test_edges(spark):
    text = "Yesterday Tamsin Braxenko called 315-555-0147 about it."
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, text + " word" * 60_000)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "id int, text string, start_pos int")
    got = find_personal(df, "text")
    assert got.columns == ["id", "pii_type", "start_pos", "end_pos"]
    assert sorted((r["id"], r["pii_type"], r["start_pos"]) for r in got.collect()) == [(1, "phone", 33), (1, "phone", 33), (4, "phone", 33)]
    out = {r["id"]: r["pii_redacted"] for r in redact(df, "text", "k").collect()}
    assert out[2] is None and out[3] == "" and "[PHONE:" in out[1] and "0147" not in out[1]
    assert find_personal(df.limit(0), "text").collect() == []


def test_valid_numbers_stay_valid():
    phones = [f"{a}-{b}-{c:04}" for a in range(203, 990, 41) for b in range(200, 990, 97) for c in (0, 147, 9999)]
    out = [pseudonym_phone(p, KEY) for p in phones]
    assert all(privacy._PHONE.fullmatch(x) for x in out) and len(set(out)) == len(phones) and [pseudonym_phone(x, KEY, back=True) for x in out] == phones
    assert pseudonym_phone("(315) 555-0172 ext. 4", KEY)[-7:-1] == " ext. "
    ids = [f"AB {n:02} {n + 1:02} 77 C" for n in range(40)] + ["952-43-2936", "X4647848"]
    out = [pseudonym_valid(x, KEY, privacy._ID) for x in ids]
    assert all(privacy._ID.fullmatch(x) for x in out) and [pseudonym_valid(x, KEY, privacy._ID, back=True) for x in out] == ids and {x[-1] for x in out[:40]} <= set("ABCD")


def test_tags_do_not_collide():
    assert len({tag(f"{n} Elm Street", KEY) for n in range(200_000)}) == 200_000 and len(tag("x", KEY)) == 32


def test_dates_keep_their_format():
    for d, shape in (("07.03.1961", r"\d\d\.\d\d\.\d{4}"), ("3/17/1984", r"\d{1,2}/\d{1,2}/\d{4}"), ("1984-02-29", r"\d{4}-\d\d-\d\d"), ("March 5, 1971", r"[A-Z][a-z]+ \d{1,2}, \d{4}"), ("5 mars 1971", r"\d{1,2} [a-zéû]+ \d{4}")):
        out = shifted_date(d, KEY)
        assert re.fullmatch(shape, out) and out != d and shifted_date(out, KEY) is not None
    assert shifted_date("31.02.1961", KEY) is None and shifted_date("07 Blatt 1961", KEY) is None
    text = "Tamsin Braxenko, born on 07.03.1961, signed on 08.03.2021."
    out = redacted(text, F_.find(text, births=True), KEY)
    assert "1961" not in out and "08.03.2021" in out and out.count("[DATE:") == 1
    assert "date" not in [k for k, _, _ in F_.find(text)]


def test_every_label_is_looked_for():
    """Every label is found, however it is spaced or cased."""
    for label in privacy.LABELS:
        plain = label.replace("\\b", "").replace("(?:number|no)", "no").replace("(?:card|number|no)", "number").replace("(?:nummer|-nr)", "-nr").replace("[cs]", "c").replace(".?", ".").replace("\\.", ".").replace("d.id", "d’id")
        for blank in (" ", "  ", "\t", "   "):
            text = f"his {plain.replace(chr(92) + 's+', blank).replace(chr(92) + 's*', blank)}: 952-43-2936".upper()
            assert privacy._LABEL.search(text), (label, text)
            assert kinds(text) == [("id_number", "952-43-2936")], text


def test_long_parts_are_whole():
    local = "a." * 60 + "b"
    assert kinds(f"Write to {local}@mail.pellar.test now") == [("email", f"{local}@mail.pellar.test")]
    assert kinds("Tracking" + " " * 200 + "315-555-0147") == [] and kinds("social" + " " * 90 + "security" + " " * 30 + "952-43-2936") == [("id_number", "952-43-2936")]


@given(st.text("AB19 -x/_.", max_size=60))
def test_id_numbers_are_those_of_the_whole_text(t):
    assert [m.span() for m in privacy.id_numbers(t)] == [m.span() for m in privacy._ID.finditer(t)]


def test_every_birth_label_is_looked_for():
    labels = ("born", "born  on", "Date of  birth", "birthdate", "DOB", "geb.", "geboren am", "Geburtsdatum", "né le", "Née  le", "date de naissance", "nacida el", "fecha de nacimiento", "nascido em", "data de nascimento")
    for label in labels:
        assert privacy._BIRTH.search(label), label
        assert ("date", "07.03.1961") in [(k, f"{label} 07.03.1961"[a:b]) for k, a, b in F_.find(f"{label} 07.03.1961", True)], label
    for pattern in privacy.BIRTH_LABELS:
        assert any(h in pattern.replace("s*", "").replace("\\", "") for h in privacy._BIRTH_HINTS), pattern


def test_rare_names_stay_beside_very_frequent_ones(spark, monkeypatch):
    """Names seen a few times are learned however many pairs the corpus has."""
    rows = [("pair", a, b, n) for a, n in (("Tamsin", 10**9), ("Wystan", 3)) for b in ("Braxenko", "Kolvardi", "Gostidge", "Dolmerrin", "Pellark")] + [("pair", "Wystan", "Umbergast", 2), ("pair", "Wystan", "Onlyonce", 1)]
    monkeypatch.setattr(privacy, "name_pairs", lambda texts, text: spark.createDataFrame(rows, "kind string, a string, b string, n bigint"))
    got = {(r["name"], r["kind"]) for r in privacy.learn_names(spark.range(0), "id").collect()}
    assert got == {("Tamsin", "g"), ("Wystan", "g")} | {(b, "f") for b in ("Braxenko", "Kolvardi", "Gostidge", "Dolmerrin", "Pellark", "Umbergast")}


def test_names_beyond_the_broadcast_are_all_found(spark, monkeypatch):
    """Dictionaries of any size give the same mentions and the same redaction, also of null, empty and repeated texts."""
    families = ("Braxenko", "Kolvardi", "Gostidge", "Dolmerrin", "Pellark", "Umbergast")
    texts = [f"yesterday {g} {f} called" for g in ("Tamsin", "Wystan") for f in families] * 2
    texts += ["then KOLVARDI, WYSTAN came", "and Mrs Gost-\nidge with W. Umbergast", "and Mrs Kolvarcli", "nobody", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")

    def results():
        return sorted(map(tuple, find_personal(df, "body").collect())), sorted(((r["id"], r["pii_redacted"]) for r in redact(df, "body", "k").collect()))

    whole = results()
    assert len(whole[0]) == 28 and len(whole[1]) == len(texts)
    monkeypatch.setattr(privacy, "NAME_BYTES", 0)
    assert results() == whole
