from quireflow.operators.multivalue import automaton, cover, cover_near, split_cells, split_lines, split_table_lines, unquoted

TABLE = ["Statement", "Code;Description;Unit price", 'X1;"sealed box, green";"1,074.20"', "K2; blue box\t31.55", "B3;;12.28", "All totals are subject to review"]


def values(lines, words=()):
    return [(a, i, v) for a, i, v in split_lines(list(lines), automaton(list(words)), set(words))]


def test_lines_of_a_table():
    got = values(TABLE)
    assert (2, 1, "sealed box, green") in got and (2, 2, "1,074.20") in got
    assert [(i, v) for a, i, v in got if a == 3] == [(0, "K2"), (1, "blue box"), (2, "31.55")]
    assert [(i, v) for a, i, v in got if a == 4] == [(0, "B3"), (2, "12.28")]
    assert {a for a, _, _ in got} == {1, 2, 3, 4}


def test_lines_that_are_no_table():
    assert values([]) == [] and values([""]) == []
    assert values(["We ask for it, please, soon.", "In May, 2020, the clerk, who", "signed, left."]) == []
    assert values(["00000000  ed 36 dc ea e1 36 80 fe 7c", "00000010  97 17 1a d2 9f 28 81 81 37"] * 3) == []
    assert values(["|" * 5000] * 3) == []


def test_edging_bars_are_no_places():
    got = values(["| a1 | 10.00 |", "| b2 | 11.00 |", "|c3|12.00|"])
    assert got == [(0, 0, "a1"), (0, 1, "10.00"), (1, 0, "b2"), (1, 1, "11.00"), (2, 0, "c3"), (2, 1, "12.00")]


def test_cover_is_the_cheapest_segmentation():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 6)
        text = "|".join("abc"[rng.randint(0, 2)] * rng.randint(1, 3) for _ in range(n + 1))
        seps = [(i, i + 1, rng.random(), rng.random()) for i, c in enumerate(text) if c == "|"]
        price = {w: rng.random() for w in itertools.accumulate([text])}

        def cost(p, rng=rng, price=price):
            return price.setdefault(p, (hash(p) % 1000) / 500)

        def total(cuts):
            v, start = 0.0, 0
            for k, (s, e, split, keep) in enumerate(seps):
                if k in cuts:
                    v += split + cost(text[start:s])
                    start = e
                else:
                    v += keep
            return v + cost(text[start:])

        best = min(total(set(c)) for r in range(len(seps) + 1) for c in itertools.combinations(range(len(seps)), r))
        got = cover(text, seps, [], cost)
        starts, pos = set(), 0
        for p in got[:-1]:
            pos += len(p)
            starts.add(next(k for k, s in enumerate(seps) if s[0] == pos))
            pos += 1
        assert abs(total(starts) - best) < 1e-9


def test_unquoted():
    assert unquoted(' "a ""b"" c" ') == 'a "b" c' and unquoted("'x'") == "x" and unquoted("") == ""


def test_cells(spark):
    rows = [(i, t, "Tags") for i, t in enumerate(["tax", "lease", "void", "tax; lease", '"void" | tax', ", lease, void", "late fee"])]
    rows += [(100 + i, t, "Owner") for i, t in enumerate(["Raskmann, Gideon", "Thavovic, Hestia", "Rufeel & Sons", "Thesum Paper Works"])]
    rows += [(200, None, "Tags"), (201, "", "Tags"), (202, "tax, lease", None), (3, "tax; lease", "Tags"), (203, "tax," * 20_000, "Tags")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, kind string, items string")
    got = {r["id"]: [(i["item_pos"], i["item_value"]) for i in r["items"]] for r in split_cells(df, "text", "kind").collect()}
    assert got[3] == [(0, "tax"), (1, "lease")] and got[4] == [(0, "void"), (1, "tax")] and got[5] == [(1, "lease"), (2, "void")]
    assert all(got[k] == [] for k in (0, 100, 101, 102, 200, 201, 202)) and len(got[203]) == 20_000
    assert split_cells(df.limit(0), "text", "kind").collect() == []


def test_readings(spark):
    t = "array<struct<text:string,confidence:double>>"
    df = spark.createDataFrame([(1, [(x, 0.5) for x in TABLE]), (2, None), (3, []), (4, [(None, None)]), (1, [(x, 0.5) for x in TABLE])], f"id int, lines {t}")
    got = [(r["id"], len(r["items"])) for r in split_table_lines(df, "lines").collect()]
    assert sorted(got) == [(1, 11), (1, 11), (2, 0), (3, 0), (4, 0)]
    assert split_table_lines(df.limit(0), "lines").collect() == []


def test_rare_values_of_a_large_dictionary(spark):
    codes = [f"SN{i:05d}" for i in range(1500)]
    rows = [(f"{a}, {b}", "Serial numbers") for a, b in zip(codes[::2], codes[1::2])] + [(c, "Serial numbers") for c in codes]
    rows += [('"Dent, Arno"', "Owner"), ("Dent, Arno; Ruf", "Owner"), ("Ruf", "Owner")]
    filler = [("yes", "Paid")] * 150_000
    df = spark.createDataFrame(rows + filler, "text string, kind string")
    got = {r["text"]: [i["item_value"] for i in r["items"]] for r in split_cells(df, "text", "kind").filter("size(items) > 0").collect()}
    assert len(got) == 751 and got["SN00000, SN00001"] == ["SN00000", "SN00001"] and got["Dent, Arno; Ruf"] == ["Dent, Arno", "Ruf"]


def test_cover_near_is_the_cheapest_for_a_width():
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(0, 6)
        marks = [rng.choice("|;,") for _ in range(n)]
        words = ["abc"[rng.randint(0, 2)] * rng.randint(1, 3) for _ in range(n + 1)]
        text = words[0] + "".join(m + w for m, w in zip(marks, words[1:]))
        kinds = {"|": (0.0, 2.0), ";": (0.1, 0.9), ",": (0.9, 0.0)}
        seps = [(i, i + 1, *kinds[c]) for i, c in enumerate(text) if c in kinds]
        spans = [(2, 7)] if rng.random() < 0.4 else []
        width, cost = rng.randint(1, 5), lambda p: (sum(map(ord, p)) % 4) / 10

        def total(cuts):
            v, start, k = 0.0, 0, 1
            for j, (s, e, split, keep) in enumerate(seps):
                inside = any(a <= s and e <= b for a, b in spans)
                if j in cuts:
                    v += (3.0 if inside else split) + cost(text[start:s])
                    start, k = e, k + 1
                else:
                    v += 0.0 if inside else keep
            return v + cost(text[start:]) + 0.8 * abs(k - width)

        best = min(total(set(c)) for r in range(len(seps) + 1) for c in itertools.combinations(range(len(seps)), r))
        got, pos, cuts = cover_near(text, seps, spans, cost, width, 0.8), 0, set()
        for p in got[:-1]:
            pos += len(p)
            cuts.add(next(k for k, s in enumerate(seps) if s[0] == pos))
            pos += 1
        assert abs(total(cuts) - best) < 1e-9


def test_a_wide_table():
    rows = ["; ".join(f'"v{i}; {k}"' if k % 50 == 7 else f"{i}{k}.50" for k in range(300)) for i in range(4)]
    got = values(rows)
    assert len(got) == 1200 and (1, 7, "v1; 7") in got and (3, 299, "3299.50") in got


def test_ten_times_as_many_distinct_codes(spark):
    for k in (1, 10):
        codes = [f"SN{i:05d}" for i in range(400 * k)]
        parts = [f"{i % 900 + 100}-{'ABC'[i % 3]}" for i in range(400 * k)]
        rows = [(f"{a}, {b}", "Serial numbers") for a, b in zip(codes[::2], codes[1::2])] + [(c, "Serial numbers") for c in codes[::3]]
        rows += [(f"{a}; {b}", "Part numbers") for a, b in zip(parts[::2], parts[1::2])] + [(c, "Part numbers") for c in parts[::3]]
        df = spark.createDataFrame(rows, "text string, kind string")
        got = split_cells(df, "text", "kind").filter("size(items) = 2").groupBy("kind").count().collect()
        assert {r["kind"]: r["count"] for r in got} == {"Serial numbers": 200 * k, "Part numbers": 200 * k}
