"""Deciding which postal addresses denote the same place.

Addresses are parsed into components and reduced to their distinct forms. Forms that share a block (number with
postcode, with city, with the sound of the street) are compared part by part; the weights of the agreement levels, a
missing part being a level of its own, are estimated by expectation-maximization over the counted level patterns. Every
form is linked with the likeliest of the forms that have more parts or, with as many, more rows, if a match is likelier
than not and nothing contradicts; the chains of links lead to one form of a place.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.session import written

#: Canonical street types, directions and states.
STREET_TYPES = {
    "st": "street st str", "ave": "avenue ave aven av avn", "rd": "road rd", "blvd": "boulevard blvd boul bvd", "ln": "lane ln", "dr": "drive drv dr", "ct": "court crt ct",
    "pl": "place pl plc", "cir": "circle circ cir crcl", "way": "way wy", "ter": "terrace terr ter", "sq": "square sq", "pkwy": "parkway pkwy", "hwy": "highway hwy", "trl": "trail trl", "cres": "crescent cres", "aly": "alley aly",
}
DIRECTIONS = {"n": "north nth n", "s": "south sth s", "e": "east e est", "w": "west wst w"}
STATES = "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()

#: Blocks are divided among tasks by so many forms.
BLOCK_ROWS = 2000
#: How many observations random pairs count for in the probabilities of non-matches.
CHANCE_WEIGHT = 1000.0

_TYPE = {w: k for k, ws in STREET_TYPES.items() for w in ws.split()}
_DIR = {w: k for k, ws in DIRECTIONS.items() for w in ws.split()}


def _ordinals() -> dict[str, str]:
    """Ordinal words to 99 -> 1st, 2nd, ...; compounds as one word, with a hyphen and without."""
    out = {w: i for i, w in enumerate(ORDINALS, 1)}
    for t, ten in enumerate(TENS, 2):
        out[ten[:-1] + "ieth"] = 10 * t
        for i, w in enumerate(ORDINALS[:9], 1):
            out[f"{ten}-{w}"] = out[ten + w] = 10 * t + i
    ends = {1: "st", 2: "nd", 3: "rd"}
    return {w: f"{i}{'th' if i in (11, 12, 13) else ends.get(i % 10, 'th')}" for w, i in out.items()}


_ORD = _ordinals()

_ZIP = re.compile(r"(?<![\d-])(\d{5})(?:-\d{4})?(?![\d-])")
_BOX = re.compile(r"\b(?:p\.? ?o\.? ?box|post office box|pob|box)[ .#]*(\d+)")
_UNIT = re.compile(r"(?:\b(?:apartment|apt|unit|suite|ste|floor|fl|room|rm)\b\.? ?#?|# ?)\w{1,5}\b")
_COUNTRY = re.compile(r"\b(?:u\.?s\.?a\b\.?|united states)")
_CUT = re.compile(r"[\n/;:|,]| - ")
PARTS = ("box", "number", "street", "dir", "type", "city", "state", "zip")
_SCHEMA = ", ".join(f"{p} string" for p in PARTS)


def parse(value: str) -> tuple[str | None, ...]:
    """The PARTS of an address text; parts that are left out are None."""
    t = " " + re.sub(r"[^\S\n]+", " ", value.lower()).strip() + " "
    t = _COUNTRY.sub("|", t)
    zips = _ZIP.findall(t)
    code = zips[0] if zips else None
    t = _ZIP.sub("|", t, count=1)
    t = _UNIT.sub("|", t)
    t = re.sub(r"\bno\. ?(?=\d)", "", t)
    box = _BOX.search(t)
    if box:
        t = t[: box.start()] + "|" + t[box.end() :]
    segments = [[w for w in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", s)] for s in _CUT.split(t)]
    segments = [s for s in segments if s]
    state = None
    for s in reversed(segments):  # the state is the last word of a segment, after the city or alone
        if s[-1] in STATES and not (s[-1] in _TYPE and len(s) > 1 and not any(w in _TYPE for w in s[:-1])):
            state = s.pop()
            break
    segments = [s for s in segments if s]
    if box:
        words = [w for s in segments for w in s if not w.isdigit()]
        return box[1], None, None, None, None, "".join(words) or None, state, code
    number = None
    home = None
    for i, s in enumerate(segments):
        digits = [j for j, w in enumerate(s) if re.fullmatch(r"\d{1,5}[a-z]?", w)]
        if digits:
            number, home = s.pop(digits[0]), i
            break
    if number is None:
        return None, None, None, None, None, None, state, code
    typed = next((i for i, s in enumerate(segments) if any(w in _TYPE and j for j, w in enumerate(s))), None)
    if typed is None and not segments[home] and home + 1 < len(segments):
        home += 1
    at = typed if typed is not None else home
    s = segments[at]
    kind = direction = None
    rest: list[str] = []
    if typed is not None:
        j = max(j for j, w in enumerate(s) if w in _TYPE and j)
        j = next((k for k, w in enumerate(s) if w in _TYPE and k and not (k == 1 and s[0] in _DIR and len(s) > 2)), j)
        kind = _TYPE[s[j]]
        name, rest = s[:j], s[j + 1 :]
    else:
        name = list(s)
    if len(name) > 1 and name[0] in _DIR:
        direction = _DIR[name.pop(0)]
    if rest and rest[0] in _DIR:
        direction = direction or _DIR[rest.pop(0)]
    others = [w for i, x in enumerate(segments) if i != at for w in x if not w.isdigit()]
    if typed is None and len(name) > 1 and name[-1] in _DIR:
        direction = direction or _DIR[name.pop()]
    if others and others[0] in _DIR and not rest:
        direction = direction or _DIR[others.pop(0)]
    city = "".join(rest + others) or None
    if city is None and typed is None and len(name) > 1:
        city = name.pop()
    street = "".join(_ORD.get(w, w) for w in name) or None
    return None, number.lstrip("0") or "0", street, direction, kind, city, state, code


def _closeness(a: Column, b: Column) -> Column:
    """2 the same, 1 a typing error apart, 0 different, -1 missing."""
    d = F.levenshtein(a, b)
    return F.when(a.isNull() | b.isNull(), -1).when(a == b, 2).when((d <= 2) & (d * 4 <= F.greatest(F.length(a), F.length(b))), 1).otherwise(0)


def _agreement(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), -1).when(a == b, 1).otherwise(0)


def linkage_weights(patterns: np.ndarray, counts: np.ndarray, chance: list[dict[int, float]], rounds: int = 100) -> np.ndarray:
    """Log odds of a match per level pattern: Fellegi-Sunter model fitted by expectation-maximization.

    chance has, for each component, how often two forms picked at random reach a level: the start, and CHANCE_WEIGHT
    observations' worth of prior, for the probabilities of non-matches. Those of matches and the share of matches are
    learned from the compared pairs alone. A missing value is a level like any other.
    """
    k = patterns.shape[1]
    levels = [sorted(set(patterns[:, j])) for j in range(k)]
    agree = np.array([[1.0 if v > 0 else 0.6 if v < 0 else 0.05 for v in row] for row in patterns]).prod(axis=1)
    post = np.clip(agree, 0.02, 0.98)
    odds = np.zeros(len(patterns))
    for _ in range(rounds):
        w, v = post * counts, (1 - post) * counts
        prior = np.clip((w.sum() + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6)
        odds = np.full(len(patterns), np.log(prior) - np.log(1 - prior))
        for j in range(k):
            for level in levels[j]:
                hit = patterns[:, j] == level
                m = (w[hit].sum() + 0.5) / (w.sum() + 0.5 * len(levels[j]))
                u = (v[hit].sum() + CHANCE_WEIGHT * chance[j].get(level, 1e-4)) / (v.sum() + CHANCE_WEIGHT)
                odds[hit] += np.log(m) - np.log(u)
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return odds


def _levels() -> dict[str, Column]:
    c = F.col
    # the number of a post box stands for its street
    boxed = c("a_box").isNotNull() | c("b_box").isNotNull()
    place = F.when(boxed, F.when(c("a_box") == c("b_box"), 2).otherwise(0)).otherwise(_closeness(c("a_street"), c("b_street")))
    return {
        "l_street": place, "l_city": _closeness(c("a_city"), c("b_city")), "l_zip": _agreement(c("a_zip"), c("b_zip")),
        "l_type": _agreement(c("a_type"), c("b_type")), "l_dir": _agreement(c("a_dir"), c("b_dir")), "l_state": _agreement(c("a_state"), c("b_state")),
    }


def chance_levels(forms: DataFrame) -> list[dict[int, float]]:
    """Level frequencies of about four random partners for every form."""
    buckets = max(1, forms.count() // 2)
    a = forms.select(F.pmod(F.xxhash64("form", F.lit(1)), F.lit(buckets)).alias("key"), *[F.col(c).alias("a_" + c) for c in forms.columns])
    b = forms.select(F.pmod(F.xxhash64("form", F.lit(2)), F.lit(buckets)).alias("key"), *[F.col(c).alias("b_" + c) for c in forms.columns])
    levels = _levels()
    seen = a.join(b, "key").filter(F.col("a_form") != F.col("b_form")).select(*[v.alias(k) for k, v in levels.items()]).groupBy(*levels).count().collect()  # at most 4 * 4 * 3^4 patterns
    out = []
    for name in levels:
        total = sum(r["count"] for r in seen)
        freq: dict[int, float] = {}
        for r in seen:
            freq[r[name]] = freq.get(r[name], 0) + r["count"]
        out.append({v: (freq.get(v, 0) + 0.5) / (total + 2) for v in (-1, 0, 1, 2)})
    return out


def _block_keys() -> Column:
    """Blocks of a form: its number or box with the postcode, with the city, with the first or last letters of street and city."""
    no = F.coalesce(F.concat(F.lit("b"), "box"), "number")
    street, city = F.coalesce("street", F.lit("-")), F.col("city").isNotNull()
    def ends(kind: str, a: int, b: int) -> Column:
        return F.when(city, F.concat_ws("|", F.lit(kind), no, F.substring(street, a, 2), F.substring("city", b, 2)))

    keys = [F.when(F.col("zip").isNotNull(), F.concat_ws("|", F.lit("z"), no, "zip")), F.when(city, F.concat_ws("|", F.lit("c"), no, "city")), ends("f", 1, 1), ends("l", -2, -2), ends("m", -2, 1)]
    return F.array_compact(F.array(*keys))


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows with one block key; blocks of more than BLOCK_ROWS rows on the right are divided among tasks."""
    sizes = right.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK_ROWS).select("key", F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("salts"))
    a = left.join(sizes, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    b = right.join(sizes, "key", "left").withColumn("salt", F.pmod(F.xxhash64("b_form"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return a.join(b, ["key", "salt"]).drop("salt")


def candidate_pairs(forms: DataFrame) -> DataFrame:
    """Pairs (a_..., b_...) of different forms that share a block; every pair comes once, from the first block both are in.

    Forms without a city are compared with all forms of their number and street sound; forms with one only with those
    whose postcode or city is the same or whose street and city have equal ends.
    """
    c = F.col

    def side(f: DataFrame, prefix: str, key: Column) -> DataFrame:
        return f.select(key.alias("key"), *[c(x).alias(prefix + x) for x in f.columns])

    same = lambda x: c("a_" + x).eqNullSafe(c("b_" + x)) & c("a_" + x).isNotNull()
    sound = F.concat_ws("|", F.coalesce(F.concat(F.lit("b"), "box"), "number"), F.soundex("street"))
    kind = F.substring("key", 1, 1)

    def ends(a: int, b: int) -> Column:
        two = lambda p: F.concat_ws("|", F.substring(F.coalesce(p + "street", F.lit("-")), a, 2), F.substring(p + "city", b, 2))
        return two("a_") == two("b_")

    first = (kind == "z") | ~same("zip") & ((kind == "c") | ~same("city") & ((kind == "f") | ~ends(1, 1) & ((kind == "l") | ~ends(-2, -2))))
    blocked = _joined(side(forms, "a_", F.explode(_block_keys())), side(forms, "b_", F.explode(_block_keys()))).filter((c("a_form") < c("b_form")) & first).drop("key")
    streets = forms.filter("street is not null")
    loose = _joined(side(streets.filter("city is null"), "a_", sound), side(streets, "b_", sound)).filter((c("a_form") != c("b_form")) & ~same("zip") & (c("b_city").isNotNull() | (c("a_form") < c("b_form")))).drop("key")
    return blocked.unionByName(loose)


def _links(forms: DataFrame, chance: list[dict[int, float]]) -> DataFrame:
    """(form, lead, weight, rank): pairs whose weight makes a match likelier than not; rank is that of lead.

    lead has more known parts or, with as many, more rows. As an exact check after the weights, street, direction and type may not
    contradict; whether cities that differ are one is left to the weights.
    """
    c = F.col
    levels = _levels()
    rank = lambda p: F.struct(*[c(p + x).isNotNull().cast("int").alias(x) for x in ("type", "dir", "city")], c(p + "n").alias("n"), c(p + "form").alias("form"))
    pairs = candidate_pairs(forms).withColumns({"a_rank": rank("a_"), "b_rank": rank("b_")})
    compared = written(pairs.select("a_form", "b_form", "a_rank", "b_rank", *[v.alias(k) for k, v in levels.items()]), "address-pairs")
    names = list(levels)
    seen = compared.groupBy(*names).count().collect()  # at most 4 * 4 * 3^4 patterns
    odds = linkage_weights(np.array([[r[n] for n in names] for r in seen]), np.array([float(r["count"]) for r in seen]), chance) if seen else []
    weights = compared.sparkSession.createDataFrame([(*[int(r[n]) for n in names], float(p)) for r, p in zip(seen, odds)], ", ".join(f"{n} int" for n in names) + ", weight double")
    scored = compared.join(F.broadcast(weights), names)
    fits = (c("l_type") != 0) & (c("l_dir") != 0) & (c("l_street") > 0)
    top = F.greatest("a_rank", "b_rank")
    links = scored.filter((c("weight") > 0) & fits).select(F.least("a_rank", "b_rank")["form"].alias("form"), top["form"].alias("lead"), F.round("weight", 6).alias("weight"), top.alias("rank"))
    return written(links, "address-links")


def _roots(forms: DataFrame, links: DataFrame) -> DataFrame:
    """(form, root) for all forms: the end of the chain of likeliest leads, by pointer jumping (a written table a round, log of the longest chain)."""
    parents = links.groupBy("form").agg(F.max_by("lead", F.struct("weight", "rank")).alias("parent"))
    at = written(forms.select("form").join(parents, "form", "left").select("form", F.coalesce("parent", "form").alias("root")), "address-roots")
    while True:
        up = at.select(F.col("form").alias("root"), F.col("root").alias("next"))
        jumped = written(at.join(up, "root").select("form", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "address-roots")
        at = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return at


def _bridged(forms: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, merged): roots that any accepted link connects, over any number of links, become one if their parts are the same.

    So two spellings too far apart for a link of their own are one place by a third between them; direction and type
    must be equal, so that a form that leaves them out never joins places that differ in them.
    """
    c = F.col
    ends = links.select("form", "lead").join(roots, "form").select("lead", c("root").alias("x")).join(roots.withColumnRenamed("form", "lead"), "lead").select("x", c("root").alias("y")).filter("x <> y").distinct()
    parts = lambda p: forms.select(c("form").alias(p), *[c(x).alias(f"{p}_{x}") for x in ("dir", "type", "city")])
    alike = c("x_dir").eqNullSafe(c("y_dir")) & c("x_type").eqNullSafe(c("y_type")) & (_closeness(c("x_city"), c("y_city")) != 0)
    pairs = written(ends.join(parts("x"), "x").join(parts("y"), "y").filter(alike).select("x", "y"), "address-bridges")
    edges = written(pairs.unionByName(pairs.select(c("y").alias("x"), c("x").alias("y"))).distinct(), "address-edges")
    label = written(edges.select("x").distinct().select("x", c("x").alias("merged")), "address-labels")
    while True:  # every round carries the least label one link further
        heard = edges.join(label.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("merged").alias("heard"))
        told = written(label.join(heard, "x").select("x", F.least("merged", "heard").alias("merged"), (c("heard") < c("merged")).alias("moved")), "address-labels")
        label = told.drop("moved")
        if told.filter("moved").isEmpty():
            return label.withColumnRenamed("x", "root")


def link_addresses(rows: DataFrame, value: str) -> DataFrame:
    """Adds place_id (string) to every row; equal ids are the same place.

    Null and empty values and texts without a house or box number get a null id. Rows are neither dropped nor
    repeated; repeated values get the same id, and how often a value is repeated changes no link. A column named
    place_id is replaced.
    """

    @F.pandas_udf(_SCHEMA)
    def parsed(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(v) if v else (None,) * len(PARTS) for v in values], columns=list(PARTS))

    c = F.col
    keep = [x for x in rows.columns if x.lower() != "place_id"]
    values = rows.select(c(value).alias("__qf_v")).filter(F.length("__qf_v") > 0).groupBy("__qf_v").agg(F.count("*").alias("n"))
    texts = written(values.select("__qf_v", "n", parsed("__qf_v").alias("p")).select("__qf_v", "n", "p.*").filter("box is not null or (number is not null and street is not null)"), "address-texts")
    # the city most rows of a postcode name stands in for one that is left out or a typing error away
    zips = texts.filter("zip is not null and city is not null").groupBy("zip", "city").agg(F.sum("n").alias("n"))
    of_zip = zips.groupBy("zip").agg(F.max_by("city", F.struct("n", "city")).alias("zip_city"), F.max("n").alias("most"), F.sum("n").alias("all")).filter("most * 2 > all").select("zip", "zip_city")
    city = F.when(c("city").isNull() | (_closeness(c("city"), c("zip_city")) == 1), F.coalesce("zip_city", "city")).otherwise(c("city"))
    filled = texts.join(of_zip, "zip", "left").withColumn("city", city).withColumn("form", F.xxhash64(*PARTS))
    by_text = written(filled.select("__qf_v", "form", "n", *PARTS), "address-forms")
    forms = written(by_text.groupBy("form", *PARTS).agg(F.sum("n").alias("n")), "address-counts")
    links = _links(forms, chance_levels(forms))
    roots = _roots(forms, links)
    roots = roots.join(_bridged(forms, links, roots), "root", "left").select("form", F.coalesce("merged", "root").alias("root"))
    # exact check: what contradicts the root of its chain is a place of its own
    root = forms.select(c("form").alias("root"), *[c(x).alias("r_" + x) for x in PARTS])
    part = lambda x: F.coalesce(x, "r_" + x, F.lit(""))
    name = F.concat_ws("|", F.coalesce(F.concat(F.lit("box "), "r_box"), "r_number"), F.coalesce("r_street", F.lit("")), part("dir"), part("type"), F.coalesce("r_city", F.lit("")), F.hex("root"))
    places = forms.select("form", "dir", "type").join(roots, "form").join(root, "root").select("form", name.alias("place_id"))
    ids = written(by_text.select("__qf_v", "form").join(places, "form").select("__qf_v", "place_id"), "address-places")
    return rows.select(*keep).join(ids, F.col(value) == F.col("__qf_v"), "left").select(*[rows[x] for x in keep], "place_id")


def same_place_pairs(places: DataFrame, key: str) -> DataFrame:
    """(a, b): pairs of different keys with one place_id, a < b; large places are salted over many tasks.

    The result has all pairs of a place by definition; equal keys count once.
    """
    once = places.filter("place_id is not null").select(F.col(key).alias("k"), "place_id").distinct()
    sizes = once.groupBy("place_id").agg(F.count("*").alias("size")).filter("size > 1").withColumn("salts", F.ceil(F.col("size") / 2000).cast("int"))
    sized = once.join(sizes, "place_id")
    left = sized.select("place_id", F.col("k").alias("a"), F.pmod(F.xxhash64("k"), F.col("salts")).cast("int").alias("salt"))
    right = sized.select("place_id", F.col("k").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.join(right, ["place_id", "salt"]).filter("a < b").select("a", "b")
