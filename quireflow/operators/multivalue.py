"""Splitting fields that pack several values: dictionary-guided segmentation.

A dictionary of known whole values is counted over the whole input. For a field, a multi-pattern automaton finds the
known values in it that contain separator characters, quoted spans and amounts are protected alike, and dynamic
programming picks the cheapest cover of the field by values. For cells the values that can stand in a cell are joined
to it from the whole dictionary. For lines of tables the dictionary that reaches the workers holds only values that make
up at least MIN_SHARE of all counted values, so it never has more than 1 / MIN_SHARE entries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.session import written

#: An entry of the lines' dictionary makes up at least this share of the counted values: at most 50,000 entries.
MIN_SHARE = 2e-5
#: A column is one of packed values if the pieces of at least this share of its separated cells are values of its kind.
PACKED_SHARE = 0.5

_QUOTED = re.compile(r'"(?:[^"]|"")*"|\'[^\']*\'')
_CELL_SEP = re.compile(r"[,;|\t\n/&·]")
#: Where a value can start or end in a cell.
_BOUND = re.compile(r"[,;|\t\n/&·]| {2,}")
#: Dictionary values with more separators than this are looked up by a piece of them.
WIDE = 6
_AMOUNT = re.compile(r"\(?(?:[$€£] ?)?(?<![\d.])\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?(?!\d)")
ITEMS = "array<struct<item_pos:int,item_value:string>>"


def unquoted(s: str) -> str:
    """A place without surrounding blanks and enclosing quotes, doubled inner quotes made single."""
    s = s.strip()
    if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'":
        s = s[1:-1].replace(s[0] * 2, s[0])
    return s.strip()


def shape(s: str) -> str:
    """Letters as a (case of one-word codes kept), digits as 9: the kind of a code-like value."""
    return re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "a", s))


def automaton(values: list[str]) -> ahocorasick.Automaton | None:
    a = ahocorasick.Automaton()
    single = set(values)
    for v in values:
        if _CELL_SEP.search(v) and not all(p.strip() in single for p in _CELL_SEP.split(v)):  # else it is packed itself
            a.add_word(v, len(v))
    if not len(a):
        return None
    a.make_automaton()
    return a


def _protected(text: str, known: ahocorasick.Automaton | None) -> list[tuple[int, int]]:
    """Spans of known values, quoted values and grouped amounts; separators inside them may be skipped."""


    def whole(a: int, b: int) -> bool:
        """Whether a separator or an end of the text stands on both sides."""
        before, after = text[max(0, a - 8) : a].rstrip(" "), text[b : b + 8].lstrip(" ")
        return (not before or _CELL_SEP.match(before[-1]) or text[:a].endswith("  ")) and (not after or _CELL_SEP.match(after[0]) or text.startswith("  ", b))

    spans = [m.span() for m in _QUOTED.finditer(text) if whole(*m.span())]
    spans += [m.span() for m in _AMOUNT.finditer(text)]
    if known is not None:
        for end, size in known.iter(text):
            a, b = end - size + 1, end + 1
            if whole(a, b):
                spans.append((a, b))
    return spans


def covers(text: str, seps: list[tuple[int, int, float, float]], spans: list[tuple[int, int]], cost, off: float | None = None) -> dict[int, tuple[float, list[str]]]:
    """For every number of places the cheapest segmentation of text into so many, as (cost, places); all under 0 without off.

    Numbers whose cheapest segmentation costs more than splitting everywhere and off for each of its places are left out.

    seps: (start, end, cost of splitting here, cost of keeping it inside a value), in order. Keeping a separator is
    free inside a protected span and splitting there costs 3. cost(place) is the cost of a place.
    """
    inside = [any(a <= s and e <= b for a, b in spans) for s, e, *_ in seps]
    n = len(seps)
    lo = [0, *[e for _, e, *_ in seps]]  # where a place may start
    hi = [*[s for s, *_ in seps], len(text)]
    split = [*[3.0 if inside[j] else seps[j][2] for j in range(n)], 0.0]
    counted = off is not None
    most = sum(split) + sum(cost(text[a:b]) for a, b in zip(lo, hi)) + (off * n if counted else 0.0) + 1e-9
    best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(n + 2)]
    best[0][0] = (0.0, -1, -1)
    for i in range(n + 1):
        base = min(v for v, *_ in best[i].values()) if best[i] else float("inf")
        keep = 0.0
        for j in range(i, n + 1):
            if j > i:
                keep += 0.0 if inside[j - 1] else seps[j - 1][3]
                if base + keep > most:
                    break
            total = keep + split[j] + cost(text[lo[i] : hi[j]])
            for c, (v, *_) in best[i].items():
                cc = c + 1 if counted else 0
                if cc not in best[j + 1] or best[j + 1][cc][0] > v + total:
                    best[j + 1][cc] = (v + total, i, c)
    out = {}
    for count, (value, *_) in best[n + 1].items():
        places, k, c = [], n + 1, count
        while k > 0:
            _, i, p = best[k][c]
            places.append(text[lo[i] : hi[k - 1]])
            k, c = i, p
        out[count] = (value, places[::-1])
    return out


def cover(text: str, seps: list[tuple[int, int, float, float]], spans: list[tuple[int, int]], cost) -> list[str]:
    """The cheapest segmentation of text into places; see covers."""
    return covers(text, seps, spans, cost)[0][1]


def cover_near(text: str, seps: list[tuple[int, int, float, float]], spans: list[tuple[int, int]], cost, expected: int, off: float) -> list[str]:
    """The cheapest segmentation where every place more or less than expected costs off.

    A separator that costs more to keep than two more places and off do (2 or more) is always split where nothing
    protects it. So the text is cut there first, each part is covered for every number of places, and the parts' numbers
    are combined: the time grows with the parts, not with the square of the line.
    """
    parts, start, own = [], 0, []
    for s, e, split, keep in seps:
        if keep >= 2 and not any(a <= s and e <= b for a, b in spans):
            parts.append((text[start:s], start, own, split))
            start, own = e, []
        else:
            own.append((s, e, split, keep))
    parts.append((text[start:], start, own, 0.0))
    ways: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for part, at, own, split in parts:
        if own:
            shifted = [(a - at, b - at) for a, b in spans if b > at and a < at + len(part)]
            options = covers(part, [(s - at, e - at, x, y) for s, e, x, y in own], shifted, cost, off)
        else:
            options = {1: (cost(part), [part])}
        new: dict[int, tuple[float, tuple | None]] = {}
        for c, (v, chain) in ways.items():
            for k, (w, places) in options.items():
                if c + k not in new or new[c + k][0] > v + w + split:
                    new[c + k] = (v + w + split, (chain, places))
        ways = new
    best = min(ways, key=lambda c: (ways[c][0] + off * abs(c - expected), c))
    out, chain = [], ways[best][1]
    while chain:
        chain, places = chain
        out.append(places)
    return [p for places in reversed(out) for p in places]


def _pieces(text: str, known: ahocorasick.Automaton | None, cost) -> list[str]:
    spans = _protected(text, known)
    seps = [(m.start(), m.end(), 0.0, 1.0) for m in _CELL_SEP.finditer(text)]
    return [unquoted(p) for p in cover(text, seps, spans, cost)]


def cell_dictionary(cells: DataFrame, text: str, kind: str) -> DataFrame:
    """Counts of whole values by kind: (kind, value, n), from cells without any separator and from quoted places."""
    whole = F.when(~F.col(text).rlike(_CELL_SEP.pattern), F.array(F.col(text)))
    quoted = F.transform(F.regexp_extract_all(F.col(text), F.lit('(?:^|[,;|\\t\\n/&·])\\s*"((?:[^"]|"")*)"\\s*(?=$|[,;|\\t\\n/&·])'), 1), lambda v: F.replace(v, F.lit('""'), F.lit('"')))
    counted = cells.filter(F.col(text).isNotNull() & F.col(kind).isNotNull())
    values = counted.select(F.col(kind).alias("kind"), F.explode(F.coalesce(whole, quoted)).alias("value")).select("kind", F.trim("value").alias("value")).filter("value <> ''")
    return values.groupBy("kind", "value").agg(F.count("*").alias("n"))


def _loose(piece: str) -> str:
    return re.sub(r"[\s\"']+", " ", piece).strip()


def lookups(text: str) -> set[str]:
    """The keys under which any dictionary value that stands in the text is found.

    A value of up to WIDE separators is its own key, one of more its first piece that is not empty, marked.
    """
    bounds = [(m.start(), m.end(), m[0][0] != " ") for m in _BOUND.finditer(text)]
    lo, hi = [0, *[e for _, e, _ in bounds]], [*[s for s, *_ in bounds], len(text)]
    out = set()
    for i in range(len(lo)):
        wide = 0
        for j in range(i, len(hi)):
            if j > i and bounds[j - 1][2]:
                wide += 1
                if wide > WIDE:
                    break
            place = text[lo[i] : hi[j]].strip()
            out.add(place)
            out.add(unquoted(place))
    if sum(x for *_, x in bounds) > WIDE:
        out |= {"\0" + _loose(p) for p in _CELL_SEP.split(text)}
    out.discard("")
    return out


def _key(value: str) -> str:
    pieces = _CELL_SEP.split(value)
    return value if len(pieces) <= WIDE + 1 else "\0" + next((k for p in pieces if (k := _loose(p))), "")


def _learned(counts: DataFrame, separated: DataFrame) -> DataFrame:
    """Adds to (kind, text, ...) the dictionary's values that stand in the text (words) and the usual shapes of its kind (shapes).

    Both are exact: the whole dictionary is joined, and the shapes are counted over all of it.
    """

    @F.pandas_udf("key string, shape string")
    def described(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"key": [_key(v) for v in values], "shape": [shape(v) for v in values]})

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, t, x) for k, t in zip(b["kind"], b["text"]) for x in lookups(t)]
            yield pd.DataFrame(rows, columns=["kind", "text", "key"])

    known = written(counts.select("kind", "value", "n", described("value").alias("d")).select("kind", "value", "n", "d.*"), "cell-values")
    of_kind = known.groupBy("kind", "shape").agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("kind")))
    shapes = of_kind.filter(F.col("n") >= 0.02 * F.col("total")).groupBy("kind").agg(F.collect_set("shape").alias("shapes"))  # at most 50 a kind
    pieces = separated.select("kind", "text").mapInPandas(keys, "kind string, text string, key string")
    found = pieces.join(known.select("kind", "key", "value"), ["kind", "key"]).filter(~F.col("key").startswith("\0") | F.contains(F.replace("text", F.lit('""'), F.lit('"')), F.col("value")))
    words = found.groupBy("kind", "text").agg(F.collect_set("value").alias("words"))
    return separated.join(words, ["kind", "text"], "left").join(shapes, "kind", "left")


def split_cells(cells: DataFrame, text: str, kind: str) -> DataFrame:
    """Adds items, an array of (item_pos, item_value), to every cell.

    kind is the column with the heading that names what the cells hold. items is empty for null or empty cells, null
    kinds and cells that hold one value; empty places count for item_pos but give no item. Whether a heading names
    packed values is learned over all its cells: with the dictionary of its whole values and their shapes, the pieces
    of most of its separated cells must be values of the kind. Any other columns are kept; a column named items is
    replaced. Repeated rows give repeated results.
    """

    @F.pandas_udf(f"good boolean, items {ITEMS}")
    def split(texts: pd.Series, words: pd.Series, shapes: pd.Series) -> pd.DataFrame:
        good, items = [], []
        for t, ws, ss in zip(texts, words, shapes):
            ws, ss = set() if ws is None else set(ws), set() if ss is None else set(ss)

            def cost(place: str, ws=ws, ss=ss) -> float:
                v = unquoted(place)
                return 0.2 if not v else 0.0 if v in ws else 0.3 if shape(v) in ss else 1.0

            ps = _pieces(t, automaton(list(ws)), cost)
            full = [p for p in ps if p]
            good.append(len(full) >= 2 and all(p in ws or shape(p) in ss for p in full))
            items.append([{"item_pos": i, "item_value": p} for i, p in enumerate(ps) if p] if len(full) >= 2 else [])
        return pd.DataFrame({"good": good, "items": items})

    separated = cells.filter(F.col(text).rlike(_CELL_SEP.pattern) & F.col(kind).isNotNull()).groupBy(F.col(kind).alias("kind"), F.col(text).alias("text")).agg(F.count("*").alias("n"))
    learned = _learned(cell_dictionary(cells, text, kind), written(separated, "separated-cells"))
    cut = written(learned.select("kind", "text", "n", split("text", "words", "shapes").alias("s")).select("kind", "text", "n", "s.*"), "cell-places")
    judged = cut.groupBy("kind").agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("n"))
    packed = judged.filter((F.col("good") > 0) & (F.col("good") >= PACKED_SHARE * F.col("n"))).select("kind")
    places = cut.filter(F.size("items") > 0).join(packed, "kind").select(F.col("kind").alias("__qf_kind"), F.col("text").alias("__qf_text"), F.col("items").alias("__qf_items"))
    keep = [c for c in cells.columns if c.lower() != "items"]
    joined = cells.select(*keep).join(places, (F.col(text) == F.col("__qf_text")) & (F.col(kind) == F.col("__qf_kind")), "left")
    return joined.select(*keep, F.coalesce("__qf_items", F.array().cast(ITEMS)).alias("items"))


# Lines of tables

_LINE_SEP = re.compile(r" *\t *| *\| *| *; *| {2,}| *, *")
_TYPED = re.compile(
    r"\(?[$€£]?\s?\d[\d,]*\.\d\d\)?(?: ?(?:€|EUR|USD))?|[$€£]?\d+|\d+(?:\.\d+)?\s?%|\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}|\d{4}-\d\d-\d\d|[A-Z]{1,4}-?\d{2,}|\d+-[A-Z]-\d+"
)
#: Characters that scanning confuses with digits, for judging whether a cell is a number, date or code.
_DIGITS = str.maketrans("OoQDIl|!iZzSsBG", "000011111225586")
_MAINS = ("\t", "|", ";", "  ", ",")


def _cls(sep: str) -> str:
    for c in "\t|;,":
        if c in sep:
            return c
    return "  "


def _typed(v: str) -> bool:
    v = unquoted(v)
    if _TYPED.fullmatch(v):
        return True
    return sum(c.isdigit() for c in v) * 2 >= len(v) and bool(_TYPED.fullmatch(v.translate(_DIGITS)))


def _fields(line: str) -> tuple[str, list[re.Match], list[tuple[int, int]]]:
    """The line without edging bars, its separators and protected quoted spans."""
    spans = [m.span() for m in _QUOTED.finditer(line)]
    return line, list(_LINE_SEP.finditer(line)), spans


def _bare(line: str) -> str:
    s = line.strip(" ")
    if s.startswith("|") and s.endswith("|") and len(s) > 1:
        s = s[1:-1]
    return s


def _split_by(line: str, main: str) -> int:
    bare = _QUOTED.sub("Q", _AMOUNT.sub("9.99", line))
    return 1 + sum(1 for m in _LINE_SEP.finditer(bare) if _cls(m[0]) == main or (_cls(m[0]) != "," and main != ","  and _cls(m[0]) in "\t|;  ") or (main == "," and _cls(m[0]) in "\t|"))


def _layout(lines: list[str]) -> tuple[str, int] | None:
    """Main separator and number of columns of a reading that is a table; None for any other."""
    bare = [_bare(x) for x in lines]
    total = Counter()
    for x in bare:
        flat = _QUOTED.sub("Q", _AMOUNT.sub("9.99", x))
        for c in {_cls(m[0]) for m in _LINE_SEP.finditer(flat)}:
            total[c] += 1
    best = None
    for main in _MAINS:
        if total[main] < 2 or total[main] < 0.34 * len(lines):
            continue
        sizes = Counter(n for n in (_split_by(x, main) for x in bare) if n > 1)
        if not sizes:
            continue
        n, k = sizes.most_common(1)[0]
        support = k * (0.7 if main == "," else 1.0) + total[main] * 0.01
        if n >= 2 and k >= 2 and (best is None or support > best[0]):
            best = (support, main, n, k)
    if best is None or best[3] < 0.4 * len(lines):
        return None
    return best[1], best[2]


def split_lines(lines: list[str], known: ahocorasick.Automaton | None, words: set[str]) -> list[tuple[int, int, str]]:
    """(line, place, value) of the table rows and headings among the lines of one reading."""
    lay = _layout(lines)
    if lay is None:
        return []
    main, width = lay

    memo: dict[str, float] = {}

    def cost(place: str) -> float:
        if place not in memo:
            v = unquoted(place)
            memo[place] = 0.25 if not v else 0.0 if v in words or _typed(v) else 0.3
        return memo[place]

    rows, typed, cells = [], 0, 0
    for at, line in enumerate(lines):
        bare = _bare(line)
        seps = []
        for m in _LINE_SEP.finditer(bare):
            c = _cls(m[0])
            if c == main:
                split, keep = 0.0, 2.0
            elif c == ",":
                split, keep = 0.9, 0.0
            elif c == ";":
                split, keep = 0.1, 0.9
            else:
                split, keep = 0.05, 1.5
            seps.append((m.start(), m.end(), split, keep))
        if not seps:
            continue
        ps = cover_near(bare, seps, _protected(bare, known), cost, width, 0.8)
        values = [unquoted(p) for p in ps]
        full = [v for v in values if v]
        if len(full) < 2 or abs(len(values) - width) > 1:
            continue
        hit = sum(_typed(v) for v in full)
        rows.append((at, values, hit))
        typed += hit
        cells += len(full)
    # a table has numbers, dates or codes in its rows; its short or untyped rows are kept only as headings
    if not rows or typed < 0.3 * cells:
        return []
    hexdump = sum(1 for at, v, _ in rows if re.fullmatch(r"(?:[0-9a-f]{2} ){7,}[0-9a-f]{2}", v[-1])) * 2 >= len(rows)
    if hexdump:
        return []
    out = []
    for at, values, hit in rows:
        if len(values) != width and hit * 2 < len(values):
            continue
        out += [(at, i, v) for i, v in enumerate(values) if v]
    return out


def line_dictionary(readings: DataFrame, lines: str) -> DataFrame:
    """Counts (value, n) of values with a separator inside, from lines that bars or tabs divide without doubt.

    A value all pieces of which stand in places of their own as often as it does is no whole value.
    """
    line = readings.select(F.explode(F.transform(lines, lambda x: x["text"])).alias("line")).filter(F.col("line").rlike(r"\||\t"))
    places = line.select(F.explode(F.split("line", r"\s*[|\t]\s*")).alias("value")).filter(F.length("value") > 0).groupBy("value").agg(F.count("*").alias("n"))
    places = written(places, "line-places")
    values = places.filter(F.col("value").rlike(r"^[A-Za-z][^\d\"]*[,;&/][^\d\"]*$"))
    pieces = values.select("value", "n", F.explode(F.transform(F.split("value", "[,;&/]"), lambda p: F.trim(p))).alias("piece")).filter("piece <> ''")
    alone = pieces.join(places.select(F.col("value").alias("piece"), F.col("n").alias("alone")), "piece", "left")
    return alone.groupBy("value", "n").agg(F.min(F.coalesce("alone", F.lit(0))).alias("least")).filter("least < n").select("value", "n")


def split_table_lines(readings: DataFrame, lines: str) -> DataFrame:
    """Adds items, an array of (line_no, item_pos, item_value), to every reading.

    lines is a column array<struct<text, ...>>. Only lines that are rows or headings of a table with two or more
    cells give items; null and empty arrays, null lines, prose, lists and junk give an empty array. Any other columns
    are kept; a column named items is replaced. Repeated rows give repeated results.
    """
    counts = line_dictionary(readings, lines)
    total = counts.agg(F.sum("n")).first()[0] or 0
    words = {r["value"] for r in counts.filter(F.col("n") >= MIN_SHARE * total).collect()}  # at most 1 / MIN_SHARE
    shared = readings.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("array<struct<line_no:int,item_pos:int,item_value:string>>")
    def items(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = shared.value
        known = automaton(list(words))
        for texts in batches:
            out = []
            for ls in texts:
                got = [] if ls is None else split_lines([x or "" for x in ls], known, words)
                out.append([{"line_no": a, "item_pos": i, "item_value": v} for a, i, v in got])
            yield pd.Series(out)

    keep = [c for c in readings.columns if c.lower() != "items"]
    return readings.select(*keep, items(F.transform(lines, lambda x: x["text"])).alias("items"))
