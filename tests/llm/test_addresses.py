import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.llm import addresses
from quireflow.llm.addresses import PARTS, candidate_pairs, link_addresses, linkage_weights, parse, same_place_pairs


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("2303 East Aldishpool Lane, Apt 22\nRufondcroft, PA 56638, USA", (None, "2303", "aldishpool", "e", "ln", "rufondcroft", "pa", "56638")),
        ("North Galaphstead Circ. 796 Apt. 26 / Latikvale, TN 32588", (None, "796", "galaphstead", "n", "cir", "latikvale", "tn", "32588")),
        ("27520, 1073 S Ivoaphgarth Road", (None, "1073", "ivoaphgarth", "s", "rd", None, None, "27520")),
        ("2013, Pimethbridge Pimevrise, OH", (None, "2013", "pimethbridge", None, None, "pimevrise", "oh", None)),
        ("2048  Plowen  mere  Ln, Belirtsted", (None, "2048", "plowenmere", None, "ln", "belirtsted", None, None)),
        ("54739-5283, P O Box 1083", ("1083", None, None, None, None, None, None, "54739")),
        ("Belirtsted, Box 1060", ("1060", None, None, None, None, "belirtsted", None, None)),
    ],
)
def test_parse(text, parts):
    assert parse(text) == parts


def test_places(spark):
    a = ["12 North Elm St, Dale, PA 10001", "12 N. Elm Street Dale", "12 Elm St Apt 4, 10001 Dale", "Elm St N 12, Dale, PA 10001", "12 N Elmm St, Dale, PA 10001", "12 Nth Elm St / Dale"]
    b = ["12 S Elm St, Dale, PA 10001", "12 South Elm Street, Dale"]
    c = ["PO Box 7, Dale, PA 10001", "P.O. Box 7\nDale"]
    other = ["13 N Elm St, Dale, PA 10001", "12 Elm Ave, Dale, PA 10001", None, "", "x" * 50_000, "somewhere"]
    rows = list(enumerate([*a, *b, *c, *other]))
    df = spark.createDataFrame([(*r, "x") for r in [*rows, rows[0]]], "id int, value string, place_id string")
    out = link_addresses(df, "value")
    assert out.columns == ["id", "value", "place_id"] and out.count() == len(rows) + 1
    pairs = {(r["a"], r["b"]) for r in same_place_pairs(out, "id").collect()}
    groups = [range(0, 6), range(6, 8), range(8, 10)]
    assert pairs == {(x, y) for g in groups for x in g for y in g if x < y}
    assert link_addresses(df.limit(0), "value").collect() == []


def test_weights_tell_matches_from_chance():
    patterns = np.array([[2, 1], [2, -1], [0, 0], [0, 1]])
    chance = [{-1: 0.01, 0: 0.95, 1: 0.02, 2: 0.02}, {-1: 0.3, 0: 0.6, 1: 0.1, 2: 1e-3}]
    post = linkage_weights(patterns, np.array([50.0, 20.0, 400.0, 60.0]), chance)
    assert min(post[:2]) > 0 > max(post[2:])


def test_a_misspelling_that_is_repeated(spark):
    right = [f"{n} N Galaphstead St, Dale, PA 10001" for n in range(10, 40)]
    wrong = [f"12 N Galaphstaed St, Dale, PA 10001{x}" for x in ("", ", USA", ", U.S.A.", " USA")]
    df = spark.createDataFrame(list(enumerate([*right * 3, *wrong])), "id int, value string")
    ids = {r["value"]: r["place_id"] for r in link_addresses(df, "value").collect()}
    assert {ids[w] for w in wrong} == {ids[right[2]]} and len({ids[x] for x in right}) == len(right)


def test_links_are_closed(spark):
    base = [f"{n} N Galaphstead St, Dale, PA 10001" for n in range(10, 40)]
    chain = ["50 N Galaphstaex St, Dale, PA 10001", "50 N Galaphstaed St, Dale, PA 10001", "50 N Galbphstaed St, Dale, PA 10001"]
    ids = {r["value"]: r["place_id"] for r in link_addresses(spark.createDataFrame(list(enumerate([*base, *chain])), "id int, value string"), "value").collect()}
    assert len({ids[x] for x in chain}) == 1 and len(set(ids.values())) == len(base) + 1


@pytest.fixture(scope="module")
def found(spark, data):
    rows = spark.read.parquet(f"{data}/../sf0.01/pattern_matches.parquet").filter("pattern in ('us_address', 'po_box')")
    return rows.select("match_id", "value").distinct()


def pairs_of(df):
    return {(r["a"], r["b"]) for r in same_place_pairs(link_addresses(df, "value"), "match_id").collect()}


def test_repeated_rows_change_no_link(spark, found):
    again = found.union(found.withColumn("match_id", -F.col("match_id") - 1)).union(found.withColumn("match_id", F.col("match_id") + 10**9))
    assert {(a, b) for a, b in pairs_of(again) if a >= 0 and b < 10**9} == pairs_of(found)


def test_the_weights_decide(spark, data, monkeypatch):
    rows = spark.read.parquet(f"{data}/../sf0.1/pattern_matches.parquet").filter("pattern = 'po_box' or value like '%1__%'")
    found = rows.filter("pattern in ('us_address', 'po_box')").select("match_id", "value").distinct()
    learned = pairs_of(found)
    monkeypatch.setattr(addresses, "linkage_weights", lambda patterns, counts, chance: np.ones(len(patterns)))
    level = pairs_of(found)
    assert learned < level  # equal box numbers and streets of different cities are told apart by the weights alone


def test_blocks_find_nearly_all_links(spark, found):
    """Against brute force: all pairs of forms of one number, judged by typing errors in street and city and nothing that contradicts."""
    forms = {(hash(p), *p): 1 for r in found.collect() if r["value"] and ((p := parse(r["value"]))[0] or (p[1] and p[2]))}
    df = spark.createDataFrame([(*f, 1) for f in forms], "form long, " + ", ".join(f"{p} string" for p in PARTS) + ", n long")
    blocked = {(min(r), max(r)) for r in candidate_pairs(df).select("a_form", "b_form").collect()}
    assert candidate_pairs(df).count() == len(blocked)
    near = addresses._closeness
    a, b = (df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]) for p in "ab")
    same = F.coalesce("a_box", "a_number") == F.coalesce("b_box", "b_number")
    true = (near(F.col("a_street"), F.col("b_street")) > 0) & (near(F.col("a_city"), F.col("b_city")) > 0)
    fits = F.coalesce(F.col("a_type") == F.col("b_type"), F.lit(True)) & F.coalesce(F.col("a_dir") == F.col("b_dir"), F.lit(True))
    brute = {(r[0], r[1]) for r in a.join(b, same & (F.col("a_form") < F.col("b_form")) & true & fits).select("a_form", "b_form").collect()}
    assert len(brute) > 400 and len(brute & blocked) >= 0.98 * len(brute)


def test_ordinals():
    assert parse("856 N. Seventeenth Ave, Dale")[2] == parse("856 N 17th Avenue, Dale")[2] == "17th"
    assert parse("9 Twenty-first St, Dale")[2] == "21st" and parse("9 fortieth st, Dale")[2] == "40th"


def test_a_hot_block_is_divided(spark, monkeypatch):
    monkeypatch.setattr(addresses, "BLOCK_ROWS", 10)
    values = [f"12 N Galaphst{a}d St{b}, Dale, PA 10001" for a in ("ea", "ae", "eea", "e", "ead") for b in ("", " Apt 3", ", Suite 9")] + [f"12 Galaphstead St, Dale{x}" for x in ("", ", PA", ", PA 10001", " 10001")]
    df = spark.createDataFrame(list(enumerate(values)) + [(1000 + i, f"{i} Elm Rd, Holm, NE {20000 + i}") for i in range(60)], "id int, value string")
    ids = [r["place_id"] for r in link_addresses(df, "value").orderBy("id").collect()]
    assert len(set(ids[: len(values)])) == 1 and len(set(ids)) == 61
