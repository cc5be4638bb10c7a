"""Personal information in free text: finding it and replacing it with typed placeholders.

Numbers are validated by their form and label and keyed-permuted within their format by a Feistel network, names,
mail and street addresses get a keyed tag; equal values therefore stay linked across documents. The permutation of a
number is walked until the result is valid like the number itself, that of a birth date until it is a date. First names
and surnames are learned from the corpus: words in capitals that many other words in capitals follow. All names count,
however rare. Dictionaries that fit NAME_BYTES go to the workers whole; larger ones stay a table to which the words of the
texts are joined, so each text comes with the names it can have.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.llm.scannoise import CONFUSIONS, furniture
from quireflow.session import written

#: Dictionaries of names up to this size are broadcast; larger ones are joined.
NAME_BYTES = 64 << 20
#: A surname follows first names at least so many times.
MIN_SEEN = 2
#: A first name is followed by at least so many different surnames (their effective number, 1 over the sum of squared shares).
MIN_FOLLOWERS = 4
#: Titles before a name, and words after it that make it a firm or a thing.
TITLES = "mr mrs ms miss mx dr prof herr frau señor señora señorita sr sra don doña monsieur madame mme mlle m sir madam".split()
THINGS = "agreement ltd llp inc associates company co partners trust act report bank & and sons office holdings group gmbh ag".split()
_STREET = (
    "street st str avenue aven ave av road rd boulevard boul blvd lane ln drive drv dr court crt ct place pl circle circ cir way wy terrace ter square sq parkway pkwy highway hwy trail trl crescent cres close row walk alley"
)

_AT = re.compile(r"@|[(\[]\s?[aA][tT]\s?[)\]]")
_LOCAL_END = re.compile(r"[A-Za-z0-9_+\-]")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"\s{0,2}[A-Za-z0-9\-]+(?:(?:\s{0,2}[(\[]\s?dot\s?[)\]]\s{0,2}|\.(?=[A-Za-z]{2,}))[A-Za-z0-9\-]+)+", re.I)
#: Where a number can be a phone number; _PHONE decides.
_DIAL = re.compile(r"[+(\d][\d ()+./\-]{7,}\d")
_PHONE = re.compile(
    r"(?<![\w*/.\-])(?:"
    r"\+\d{1,3}(?:[ .\-/]{0,2}\(?\d{1,5}\)?){2,6}"
    r"|(?:1[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}"
    r"|(?:1[ .\-])?[2-9]\d{2}(?P<sep>[ .\-/])[2-9]\d{2}[ .\-]\d{4}"
    r"|0[1-9]\d{1,3}[ /\-]\d{3,6}(?:[ \-]\d{1,6})?"
    r"|00[1-9]\d(?:[ .\-/]?\(?\d{1,8}\)?){1,4}"
    r"|[2-9]\d{2}[2-9]\d{6}"
    r")(?![\w\-]|[.,]\d)"
)
_ID = re.compile(r"(?<![\w*\-/])(?:\d{3}[- ]\d{2}[- ]\d{4}|\d{9}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]{1,2}\d{6,9}[A-Z]?|[A-Z]\d{3}-\d{4}-\d{3,4}|[A-Z0-9]{9,12}|\d{2,3}(?:[ -]\d{2,4}){2,4})(?![\w\-])")
#: Labels of identity numbers, of birth dates.
LABELS = (
    r"social\s+security", r"soc\.?\s*sec", r"\bssn\b", r"\bs\.s\.n", r"\bni\s+(?:number|no)", r"national\s+insurance", r"insurance\s+(?:number|no)", "passport", "passeport", "pasaporte", "reisepass", r"pass(?:nummer|-nr)", r"identity\s+card",
    r"\bid\s+(?:card|number|no)", "personalausweis", "ausweis", r"carte\s+d.identité", r"\bdni\b", r"\bnif\b", r"tax\s+id", r"licen[cs]e", "führerschein", "permis", "sozialversicherung", r"sécurité\s+sociale", r"seguridad\s+social",
)
BIRTH_LABELS = (r"\bborn(?:\s+on)?", r"date\s+of\s+birth", r"birth\s*date", r"\bdob\b", r"\bgeb(?:oren)?\.?(?:\s+am)?", "geburtsdatum", r"\bnée?\s+le", r"date\s+de\s+naissance", r"\bnacid[oa]\s+el", r"fecha\s+de\s+nacimiento", r"\bnascid[oa]\s+em", r"data\s+de\s+nascimento")
_ID_RUN = re.compile(r"[A-Z0-9][A-Z0-9 \-]{6,}")
_LABEL = re.compile("|".join(LABELS), re.I)
#: Letters of which every label of a birth date has one group.
_BIRTH_HINTS = ("born", "birth", "dob", "geb", "né", "nai", "nacid", "nacim", "nascid", "nascim")
_BIRTH = re.compile("|".join(BIRTH_LABELS), re.I)
#: A date: numbers in one of three orders, or the name of a month between or before them.
_DATE = re.compile(r"(?<![\d./\-])(?:\d{1,2}(?P<s>[./\-])\d{1,2}(?P=s)\d{4}|\d{4}-\d\d-\d\d|\d{1,2}\.? [^\W\d_]{3,9} \d{4}|[^\W\d_]{3,9} \d{1,2}, \d{4})(?![\d\-])")
_GAP = 40
_NOT_ID = re.compile(r"(?:\bpart|tracking|invoice|order|serial|account|reference|form|route|lots?)\s*(?:no\.?|number|nr\.?|#)?\s*:?\s*$", re.I)
_DIRECTION = r"(?:(?:north|south|east|west|nth|sth|n|s|e|w)\b\.? )?"
_HOUSE = re.compile(r"\d{1,5}[A-Za-z]?,? (?=[^\W_])")
_STREET_AT = re.compile(
    rf"\d{{1,5}}[a-z]?,? {_DIRECTION}(?:[^\W\d_]+(?:['’-][^\W\d_]+)*|\d{{1,3}}(?:st|nd|rd|th)) (?:[^\W\d_]+(?:['’-][^\W\d_]+)* ){{0,2}}?(?:{'|'.join(_STREET.split())})\b", re.I
)
_BOX_HINTS = ("box", "pob", "postfach", "boîte", "apartado", "casilla")
_BOX_AT = re.compile(r"(?<!\w)(?:p\. ?o\. ?box|p ?o box|post office box|pob|postfach|boîte postale|apartado|casilla)\s{1,2}\d{1,6}\b", re.I)
_TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.? ?$", re.I)
_CAPITAL = re.compile(r"(?<![\w'’\-])[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’-][^\W\d_]+)*")
_PAIR = re.compile(r"([A-ZÀ-Þ][a-zà-ÿ]{2,}) (?:[A-Z]\. )?([A-ZÀ-Þ][a-zà-ÿ]{2,})(?![\w'’-]|\s+[A-ZÀ-Þ]| & )")
_LEAD = re.compile(r"([A-ZÀ-Þ][a-zà-ÿ]{2,}) (?=[A-ZÀ-Þ][a-zà-ÿ]{2,} (?:[A-ZÀ-Þ]\. )?[A-ZÀ-Þ][a-zà-ÿ]{2,})")
_NUMBERED = re.compile(r"no\. ?$", re.I)


def flatten(text: str) -> tuple[str, list[int], list[int]]:
    """The text as one line without page furniture and word breaks; starts of its pieces there and in the text."""
    lines = text.split("\n")
    heads, numbers = furniture(lines) if len(lines) > 3 else (set(), set())
    skip = heads | numbers
    out: list[str] = []
    here: list[int] = []
    there: list[int] = []
    pos = size = 0
    last = len(lines) - 1
    for i, line in enumerate(lines):
        if i not in skip:
            s = line.rstrip(" \f")
            body = s.lstrip(" \f\t")
            if not body:
                if out:
                    out.append("\n")
                    here.append(size)
                    there.append(pos)
                    size += 1
            else:
                if len(body) > 1 and i < last and body[-1] in "-­¬‐":
                    piece = body[:-1] if body[-2].isalpha() else body
                else:
                    piece = body + " "
                out.append(piece)
                here.append(size)
                there.append(pos + len(s) - len(body))
                size += len(piece)
        pos += len(line) + 1
    return "".join(out), here, there


def _words_before(t: str, at: int, count: int) -> str:
    """The last words before a place, with whatever blanks are between."""
    a = at
    for _ in range(count):
        while a and t[a - 1].isspace():
            a -= 1
        while a and not t[a - 1].isspace():
            a -= 1
    return t[a:at]


def _local_part(t: str, at: int) -> int | None:
    """Where the local part of a mail address starts that ends before a place, at most two blanks away."""
    b = at
    while b and at - b < 2 and t[b - 1].isspace():
        b -= 1
    a = b
    while a and t[a - 1] in _LOCAL_SIGNS:
        a -= 1
    while a < b and not t[a].isalnum():
        a += 1
    return a if a < b and _LOCAL_END.match(t[b - 1]) else None


def id_numbers(t: str) -> Iterator[re.Match]:
    """All matches of _ID; they consist of capitals, digits, blanks and hyphens, so only runs of these are searched."""
    for run in _ID_RUN.finditer(t):
        yield from _ID.finditer(t, run.start(), min(len(t), run.end() + 1))


def labelled(t: str, labels: re.Pattern, values: Iterator[re.Match]) -> Iterator[re.Match]:
    """The values that a label stands before, at most _GAP characters and no digit away.

    Values are far fewer than the places of a text, so they are searched first and labels only before them; a label has
    at most three words, with any blanks between.
    """
    for m in values:
        at = max(0, m.start() - _GAP)
        before = t[at - len(_words_before(t, at, 4)) : m.start()]
        for label in labels.finditer(before):
            gap = before[label.end() :]
            if len(gap) <= _GAP and not any(map(str.isdigit, gap)):
                yield m
                break


def _starts(t: str, at: int) -> bool:
    """Whether a word starts here, but not one after a house number or an ampersand."""
    before = t[max(0, at - 2) : at]
    return not before or not (before[-1].isalnum() or before[-1] in "._" or (before[-1] == " " and before[0] in "&0123456789" and len(before) == 2))


def name_pairs(texts: DataFrame, text: str) -> DataFrame:
    """(kind, a, b, n) over whole texts: pairs of words in capitals, words before such pairs, words in lower case."""

    def table(total: Counter, lower: Counter) -> pd.DataFrame:
        rows = [(*k, n) for k, n in total.items()] + [("lower", w, "", n) for w, n in lower.items() if len(w) > 2 and w.isalpha() and w.islower()]
        total.clear()
        lower.clear()
        return pd.DataFrame(rows, columns=["kind", "a", "b", "n"])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        lower: Counter = Counter()
        for b in batches:
            for t in b[text]:
                if t:
                    total.update(("pair", m[1], m[2]) for m in _PAIR.finditer(t) if _starts(t, m.start()))
                    total.update(("lead", m[1], "") for m in _LEAD.finditer(t) if _starts(t, m.start()))
                    lower.update(set(t.split()))
            if len(total) + len(lower) > 300_000:
                yield table(total, lower)
        yield table(total, lower)

    return texts.select(text).mapInPandas(counted, "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def learn_names(texts: DataFrame, text: str) -> DataFrame:
    """(name, kind) of all names of the corpus, each once: g for a first name, f for a surname that is no first name."""
    counts = written(name_pairs(texts, text), "name-pairs")
    pairs = counts.filter("kind = 'pair'").select("a", "b", "n").filter(~F.lower("a").isin(*TITLES) & ~F.lower("b").isin(*TITLES))
    lower = counts.filter("kind = 'lower'").select(F.initcap("a").alias("a"), F.col("n").alias("lower_n"))
    # a word that is usual in lower case is no surname
    rare = pairs.groupBy("b").agg(F.sum("n").alias("b_n")).join(lower.withColumnRenamed("a", "b"), "b", "left").filter(F.coalesce("lower_n", F.lit(0)) * 20 <= F.col("b_n")).select("b")
    every = pairs.groupBy("a").agg(F.sum("n").alias("all_n"))
    pairs = pairs.join(rare, "b")
    # many surnames follow a first name, none of them by far the most, and seldom two words in capitals
    leads = counts.filter("kind = 'lead'").select("a", F.col("n").alias("lead_n"))
    spread = pairs.groupBy("a").agg(F.sum("n").alias("n"), (F.pow(F.sum("n"), 2.0) / F.sum(F.pow("n", 2.0))).alias("followers"))
    firsts = spread.filter(F.col("followers") >= MIN_FOLLOWERS).join(leads, "a", "left").filter(F.coalesce("lead_n", F.lit(0)) * 2 <= F.col("n"))
    firsts = firsts.join(every, "a").filter(F.col("n") * 2 >= F.col("all_n")).join(lower, "a", "left").filter(F.coalesce("lower_n", F.lit(0)) * 20 <= F.col("n")).select("a")
    given = written(firsts, "first-names")
    family = pairs.join(given, "a").groupBy("b").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_SEEN).select(F.col("b").alias("a")).join(given, "a", "left_anti")
    return written(given.select(F.col("a").alias("name"), F.lit("g").alias("kind")).unionByName(family.select(F.col("a").alias("name"), F.lit("f").alias("kind"))), "names")


def forms(word: str) -> Iterator[str]:
    """The names that a word in capitals can be: itself, and itself with one misreading undone."""
    yield word.capitalize()
    if len(word) >= 5 and word[0].isupper():
        low = word.lower()
        for bad, good in CONFUSIONS:
            p = low.find(bad)
            while p >= 0:
                yield (low[:p] + good + low[p + len(bad) :]).capitalize()
                p = low.find(bad, p + 1)


def with_names(texts: DataFrame, text: str) -> tuple[DataFrame, Broadcast | None]:
    """texts with __qf_given and __qf_family, and (first names, surnames) of the corpus as a broadcast.

    Names that fit NAME_BYTES are broadcast and the columns are null. Otherwise there is no broadcast, and the columns
    hold the names that words of the row's text can be; rows meet them by a hash of the text.
    """
    names = learn_names(texts, text)
    if (names.agg(F.sum(F.octet_length("name") + 100)).first()[0] or 0) <= NAME_BYTES:
        known: dict[str, set[str]] = {"g": set(), "f": set()}
        for r in names.collect():
            known[r["kind"]].add(r["name"])
        none = F.lit(None).cast("array<string>")
        return texts.withColumns({"__qf_given": none, "__qf_family": none}), texts.sparkSession.sparkContext.broadcast((known["g"], known["f"]))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str]] = {}
        keys: list[str] = []
        some: list[str] = []

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(some, pa.string())], ["__qf_key", "name"])
            keys.clear()
            some.clear()
            return out

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                here: set[str] = set()
                for w in set(_CAPITAL.findall(flatten(t)[0])):
                    if w not in memo:
                        if len(memo) > 100_000:
                            memo.clear()
                        memo[w] = [y for y in forms(w) if len(y) > 2]
                    here.update(memo[w])
                keys += [key] * len(here)
                some += here
                if len(keys) > 50_000:
                    yield made()
        yield made()

    key = F.sha2(F.col(text), 256)
    words = texts.filter(F.length(text) > 0).select(key.alias("__qf_key"), text).mapInArrow(possible, "__qf_key string, name string")
    found = words.join(names, "name").groupBy("__qf_key").agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("name"))).alias(c) for k, c in (("g", "__qf_given"), ("f", "__qf_family"))))
    return texts.withColumn("__qf_key", key).join(found, "__qf_key", "left").drop("__qf_key"), None


class Finder:
    """Finds mentions in one text; given and family are capitalised words."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = given, family
        self.memo: dict[str, str] = {}

    def kind(self, word: str) -> str:
        """g for a first name, f for a surname, t for a title, empty for any other word; misread names count."""
        if word not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            k = "t" if word.lower() in TITLES else next(("g" if y in self.given else "f" for y in forms(word) if y in self.given or y in self.family), "")
            self.memo[word] = k
        return self.memo[word]

    def find(self, text: str, births: bool = False) -> list[tuple[str, int, int]]:
        """(type, start, end) in the text's own offsets, in order, not overlapping; with births also birth dates, as date."""
        flat, here, there = flatten(text)
        if not flat:
            return []

        def at(p: int) -> int:
            k = bisect.bisect_right(here, p) - 1
            return there[k] + p - here[k]

        spans: list[tuple[str, int, int]] = []

        def free(a: int, b: int) -> bool:
            return all(b <= x or y <= a for _, x, y in spans)

        for m in _AT.finditer(flat):
            domain = _DOMAIN.match(flat, m.end())
            local = _local_part(flat, m.start()) if domain else None
            if local is not None and free(local, domain.end()):
                spans.append(("email", local, domain.end()))
        low = flat.lower()
        for house in _HOUSE.finditer(flat):
            a = house.start()
            if a and (flat[a - 1].isalnum() or flat[a - 1] in "_*/$€£.,-"):
                continue
            m = _STREET_AT.match(flat, a)
            if m:
                number = _NUMBERED.search(flat, max(0, a - 4), a)
                a = number.start() if number else a
                if free(a, m.end()):
                    spans.append(("address", a, m.end()))
        if any(h in low for h in _BOX_HINTS):
            spans += [("address", *m.span()) for m in _BOX_AT.finditer(flat) if free(*m.span())]
        if births and any(h in low for h in _BIRTH_HINTS):
            spans += [("date", *m.span()) for m in labelled(flat, _BIRTH, _DATE.finditer(flat)) if shifted_date(m[0], b"") is not None and free(*m.span())]
        for m in labelled(flat, _LABEL, (m for m in id_numbers(flat) if any(map(str.isdigit, m[0])))):
            if not _NOT_ID.search(_words_before(flat, m.start(), 4)) and free(*m.span()):
                spans.append(("id_number", *m.span()))
        for dial in _DIAL.finditer(flat):
            for m in _PHONE.finditer(flat, dial.start(), min(len(flat), dial.end() + 2)):
                digits = sum(c.isdigit() for c in m[0])
                if 9 <= digits <= 15 and free(*m.span()) and not _NOT_ID.search(_words_before(flat, m.start(), 4)):
                    end = m.end()
                    ext = re.match(r",? ?(?:ext\.?|extension|x) ?\d{1,5}", flat[end : end + 16])
                    spans.append(("phone", m.start(), end + (ext.end() if ext else 0)))
        self._names(flat, spans, free)
        return sorted((k, at(a), at(b - 1) + 1) for k, a, b in spans)

    def _names(self, flat: str, spans: list, free) -> None:
        words = [(*m.span(), m[0]) for m in _CAPITAL.finditer(flat)]
        n = len(words)
        known = self.memo
        i = 0
        while i < n:
            a, b, w = words[i]
            k = known.get(w)
            if k is None:
                k = self.kind(w) if len(w) > 1 else ""
            if b - a == 1:
                k = "i" if flat[b : b + 1] == "." else ""
            if not k:
                i += 1
                continue
            end = None
            start = a
            if k == "g":
                j = i + 1
                while j < n and len(words[j][2]) == 1 and words[j][2].isupper() and words[j][0] - words[j - 1][1] <= 2:
                    j += 1
                follows = j < n and words[j][0] - words[j - 1][1] <= 2 and words[j][2][0].isupper() and "," not in flat[words[j - 1][1] : words[j][0]] and "\n" not in flat[words[j - 1][1] : words[j][0]]
                if follows and (self.kind(words[j][2]) == "f" or (words[j][2].lower() not in THINGS and len(words[j][2]) > 2 and not w.isupper())):
                    end = words[j][1]
                else:
                    end = b
                    j = i + 1 if j == i + 1 else j
                    end = words[j - 1][1]
                i_next = j + 1 if end == (words[j][1] if j < n else -1) else j
            elif k == "f":
                # surname, first name
                j = i + 1
                if j < n and re.fullmatch(r",\s{1,2}", flat[b : words[j][0]]) and self.kind(words[j][2]) == "g" and (w.isupper() == words[j][2].isupper()):
                    end = words[j][1]
                    i_next = j + 1
                    while i_next < n and len(words[i_next][2]) == 1 and words[i_next][0] - words[i_next - 1][1] <= 2:
                        end = words[i_next][1]
                        i_next += 1
                elif _TITLED.search(flat, max(0, a - 12), a) and flat[b : b + 3] != " & ":
                    end = b
                    i_next = i + 1
            elif k == "i":
                j = i + 1
                while j < n and len(words[j][2]) == 1 and words[j][2].isupper() and words[j][0] - words[j - 1][1] <= 2:
                    j += 1
                if j < n and words[j][0] - words[j - 1][1] <= 2 and self.kind(words[j][2]) == "f" and not re.search(r"\d,? ?$", flat[max(0, a - 3) : a]):
                    end = words[j][1]
                    i_next = j + 1
            if end is None:
                i += 1
                continue
            if free(start, end):
                spans.append(("name", start, end))
            i = max(i + 1, i_next)


# Format-preserving pseudonyms


def _round(key: bytes, i: int, half: str, modulus: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{i}|{half}".encode(), key=key, digest_size=16).digest(), "big") % modulus


def feistel(symbols: str, alphabet: str, key: bytes, back: bool = False, rounds: int = 10) -> str:
    """A keyed permutation of the strings of this length over an alphabet; back undoes it. One symbol is shifted."""
    base, n = len(alphabet), len(symbols)
    if n == 0:
        return symbols
    value = {c: i for i, c in enumerate(alphabet)}
    if n == 1:
        shift = _round(key, 0, str(n), base)
        return alphabet[(value[symbols] + (-shift if back else shift)) % base]
    u = n // 2
    sizes = (u, n - u)

    def number(s: str) -> int:
        x = 0
        for c in s:
            x = x * base + value[c]
        return x

    def spell(x: int, size: int) -> str:
        out = []
        for _ in range(size):
            x, r = divmod(x, base)
            out.append(alphabet[r])
        return "".join(reversed(out))

    a, b = number(symbols[:u]), number(symbols[u:])
    for i in reversed(range(rounds)) if back else range(rounds):
        if i % 2 == 0:
            f = _round(key, i, f"{n}:{b}", base ** sizes[0])
            a = (a - f if back else a + f) % base ** sizes[0]
        else:
            f = _round(key, i, f"{n}:{a}", base ** sizes[1])
            b = (b - f if back else b + f) % base ** sizes[1]
    return spell(a, sizes[0]) + spell(b, sizes[1])


def pseudonym_number(value: str, key: bytes, back: bool = False) -> str:
    """A number with its digits and capitals permuted and everything else in place."""
    digits = feistel("".join(c for c in value if c in "0123456789"), "0123456789", key, back)
    letters = feistel("".join(c for c in value if "A" <= c <= "Z"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", key, back)
    d, u = iter(digits), iter(letters)
    return "".join(next(d) if c in "0123456789" else next(u) if "A" <= c <= "Z" else c for c in value)


def pseudonym_date(day: dt.date, key: bytes, first: int = 1900, last: int = 2099, back: bool = False) -> dt.date:
    """Another day of the years first to last, by walking the permutation until it hits one."""
    low, high = dt.date(first, 1, 1).toordinal(), dt.date(last, 12, 31).toordinal()
    x = str(day.toordinal() - low).zfill(5)
    while True:
        x = feistel(x, "0123456789", key, back)
        if int(x) <= high - low:
            return dt.date.fromordinal(low + int(x))


def pseudonym_valid(value: str, key: bytes, pattern: re.Pattern, back: bool = False) -> str:
    """A number permuted within its format, by walking the permutation until the pattern takes the result whole.

    So a valid number stays a valid one and different numbers stay different; back undoes it. A value the pattern does
    not take itself is permuted once.
    """
    if not pattern.fullmatch(value):
        return pseudonym_number(value, key, back)
    while True:
        value = pseudonym_number(value, key, back)
        if pattern.fullmatch(value):
            return value


_EXTENSION = re.compile(r"(,? ?(?:ext\.?|extension|x) ?)(\d{1,5})$")


def pseudonym_phone(value: str, key: bytes, back: bool = False) -> str:
    """A phone number and its extension, each permuted within its format."""
    ext = _EXTENSION.search(value)
    main = value[: ext.start()] if ext else value
    return pseudonym_valid(main, key, _PHONE, back) + (ext[1] + pseudonym_number(ext[2], key, back) if ext else "")


#: Names of months.
MONTHS = {
    "en": "January February March April May June July August September October November December", "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
}
_MONTH_AT = {m.lower(): (lang, i) for lang, names in MONTHS.items() for i, m in enumerate(names.split(), 1)}


def shifted_date(text: str, key: bytes, back: bool = False) -> str | None:
    """A date in its own format with its day permuted; None if it is no date. Days of 1900 to 2099 are permuted among themselves.

    Of two numbers the one over 12 is the day; where both can be, points mean the day and slashes the month comes first.
    """
    parts = re.findall(r"\d+|[^\W\d_]+", text)
    word = next((p for p in parts if not p.isdigit()), None)
    try:
        if word:
            lang, month = _MONTH_AT[word.lower()]
            day, year = (int(p) for p in parts if p.isdigit())
            order = "wdy" if parts[0] == word else "dwy"
        elif len(parts[0]) == 4:
            year, month, day = map(int, parts)
            order = "ymd"
        else:
            a, b, year = map(int, parts)
            order = "mdy" if ("/" in text and a <= 12) or b > 12 else "dmy"
            day, month = (b, a) if order == "mdy" else (a, b)
        date = dt.date(year, month, day)
    except (KeyError, ValueError):
        return None
    if not 1900 <= year <= 2099:
        return None
    new = pseudonym_date(date, key, back=back)
    month = MONTHS[lang].split()[new.month - 1] if word else None
    if word:
        month = month.upper() if word.isupper() else month.capitalize() if word[0].isupper() else month.lower()
    shown = {"d": str(new.day), "m": str(new.month), "y": str(new.year), "w": month}
    values = iter(order)
    return re.sub(r"\d+|[^\W\d_]+", lambda m: shown[next(values)].zfill(2 if m[0].isdigit() and len(m[0]) == 2 else 1), text)


def tag(value: str, key: bytes) -> str:
    """16 bytes of a keyed hash of the words of a value, in hexadecimal."""
    plain = " ".join(re.sub(r"[^\w]+", " ", value.lower()).split())
    return hashlib.blake2b(plain.encode(), key=key, digest_size=16).hexdigest()


def redacted(text: str, mentions: list[tuple[str, int, int]], key: bytes) -> str:
    """The text with each mention as [TYPE:pseudonym]."""
    out, last = [], 0
    for kind, a, b in sorted(mentions, key=lambda m: m[1]):
        if a < last:
            continue
        value = re.sub(r"[-­¬‐] ?\n\s*", "-" if kind in ("phone", "id_number") else "", text[a:b])
        value = " ".join(value.split())
        if kind == "phone":
            shown = pseudonym_phone(value, key)
        elif kind == "id_number":
            shown = pseudonym_valid(value, key, _ID)
        elif kind == "date":
            shown = shifted_date(value, key) or tag(value, key)
        else:
            shown = tag(value, key)
        out += [text[last:a], f"[{kind.upper()}:{shown}]"]
        last = b
    return "".join(out) + text[last:]


def find_personal(texts: DataFrame, text: str) -> DataFrame:
    """One row per mention: the columns of texts but text, pii_type, start_pos and end_pos.

    Offsets count code points of the unchanged text. Null and empty texts give no rows; repeated rows give repeated
    results. Columns named like the three new ones are replaced.
    """
    keep = [c for c in texts.columns if c != text and c.lower() not in ("pii_type", "start_pos", "end_pos")]
    named, shared = with_names(texts, text)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*shared.value) if shared else None
        for b in batches:
            rows, kinds, starts, ends = [], [], [], []
            for row, (t, given, family) in enumerate(zip(*(b.column(i).to_pylist() for i in range(3)))):
                for kind, start, end in (finder or Finder(set(given or ()), set(family or ()))).find(t):
                    rows.append(row)
                    kinds.append(kind)
                    starts.append(start)
                    ends.append(end)
            kept = b.take(pa.array(rows, pa.int32())).columns[3:]
            made = [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*keep, "pii_type", "start_pos", "end_pos"])

    fields = [T.StructField("pii_type", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())]
    some = named.select(F.col(text).alias("__qf_text"), "__qf_given", "__qf_family", *keep).filter(F.length("__qf_text") > 0)
    return some.mapInArrow(found, T.StructType([*texts.select(*keep).schema.fields, *fields]))


def redact(texts: DataFrame, text: str, key: str) -> DataFrame:
    """Adds pii_mentions (array of (pii_type, start_pos, end_pos)) and pii_redacted (the text with placeholders).

    key is the secret of the pseudonyms: the same key links equal values across tables and runs. Besides the types of
    find_personal, dates labelled as birth dates are replaced, as date. Null texts give
    nulls, empty ones no mentions. Offsets count code points of the unchanged text. Rows are neither dropped nor
    repeated; columns of the two names are replaced.
    """
    keep = [c for c in texts.columns if c.lower() not in ("pii_mentions", "pii_redacted")]
    secret = hashlib.sha256(key.encode()).digest()
    named, shared = with_names(texts, text)

    @F.pandas_udf("mentions array<struct<pii_type:string,start_pos:int,end_pos:int>>, redacted string")
    def find(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        finder = Finder(*shared.value) if shared else None
        for columns in batches:
            rows = []
            for t, given, family in zip(*columns):
                found = (finder or Finder(set() if given is None else set(given), set() if family is None else set(family))).find(t, True) if t else []
                rows.append(([{"pii_type": k, "start_pos": x, "end_pos": y} for k, x, y in found], redacted(t, found, secret) if t else t))
            yield pd.DataFrame(rows, columns=["mentions", "redacted"])

    out = named.select(*keep, F.when(F.col(text).isNotNull(), find(F.col(text), "__qf_given", "__qf_family")).alias("__qf_r"))
    return out.select(*keep, F.col("__qf_r.mentions").alias("pii_mentions"), F.col("__qf_r.redacted").alias("pii_redacted"))
