"""Repairing text read from scanned pages.

Running headers and footers are found by fuzzy repetition of lines at page edges, page numbers by their form, words
with misread characters and words broken across lines by a vocabulary counted over the whole corpus. What remains is
joined into paragraphs. The vocabulary that reaches the workers holds only words of at least MIN_SHARE of all words
and fits VOCABULARY_BYTES, whatever the size of the corpus. All verdicts depend on ratios of counts, so that they are
the same for a corpus and for a thousand copies of it.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireflow.session import written

#: A word of the vocabulary makes up at least this share of all words: at most a million entries.
MIN_SHARE = 1e-6
#: Bytes the vocabulary may take when it is sent to the workers; a larger one is cut at a higher share.
VOCABULARY_BYTES = 96 << 20
#: A word that is not in the vocabulary counts as this share of all words, but at least as one.
UNSEEN_SHARE = 1.6e-7
#: A correction must be this many times as frequent as the word it corrects.
RATIO = 25

#: What is read for what, in lower case.
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("@", "a"), ("f", "t"), ("t", "f"), ("0", "o"), ("ri", "n"), ("cl", "d"), ("5", "s"), ("1", "i"), ("|", "i"), ("1", "l"), ("(", "c"), ("!", "l"), ("!", "i"), ("|", "l"),
    ("li", "h"), ("rn", "m"), ("ii", "u"), ("9", "g"), ("6", "b"), ("ſ", "f"), ("ſ", "s"), ("vv", "w"), ("v", "y"), ("d", "cl"), ("6", "é"), ("6", "ó"), ("u", "ll"), ("m", "rn"), ("rm", "nn"), ("nn", "rm"),
    ("h", "b"), ("b", "h"), ("8", "b"), ("n", "ri"), ("u", "ii"), ("h", "li"), ("w", "vv"), ("y", "v"), ("l", "i"), ("i", "l"), ("0", "ö"), ("3", "e"), ("$", "s"), ("€", "e"), ("¢", "c"), ("tn", "m"), ("iii", "m"), ("in", "m"),
)
#: The confusions by the first character of what is read.
_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _bad, _good in CONFUSIONS:
    _BY_FIRST.setdefault(_bad[0], []).append((_bad, _good))
_ODD = re.compile(r"[@0-9|(!ſ$€¢]")
_ODD_INSIDE = re.compile(r"[^\W\d_]+[015|!6ſ][^\W\d_]*[a-zà-ÿ]{2}")
_HYPHENS = "-­¬‐"
_ENDS = frozenset(_HYPHENS)
_BROKEN = re.compile(rf"[{_HYPHENS}] ?\n\s*")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
#: A word as it stands, with characters that can be misread letters.
_EDGE_SIGNS = ".,;:?\"“”„«»'’-­¬‐…"
_GLUED = re.compile(r"[#&~^§%@*_=<>{}\\](?=[^\W\d_])|(?<=[^\W\d_])[#&~^§%*_=<>{}\\](?=[\w\s])")
_ROMAN = re.compile(r"(?=[ivxlc])(?:x{0,3}(?:ix|iv|v?i{0,3})|x?l?x{0,3})")
_PAGE = re.compile(
    r"[-–—\[(|*]{0,2}\s*(?P<word>[^\W\d_]{1,8}(?:\.\s*|\s+))?(?:n[°ºo]\.?\s*)?(?P<n>[\dlIOoSB|!]{1,4}|[ivxlcIVXLC]{1,7})(?P<of>\s*(?:of|von|de|sur|di|из|/)\s*[\dlIOoSB|!]{1,4})?\s*[-–—\])|*]{0,2}"
)
_PAGE_ENDS = frozenset("0123456789dlIOoSB|!ivxlcIVXLC-–—])*")
_PAGE_WORDS = ("page", "pag", "pág", "p", "pg", "s", "seite", "blatt", "folio", "fol", "página", "sheet", "стр", "страница", "hoja", "feuille", "feuillet", "leaf", "bl", "sida", "str")
_MARK = re.compile(r"\s*(?:[-*•·▪◦‣–+]\s|[oO] (?=\w)|\(?\w{1,3}[.)]\s|\[[ xX]?\])")


def count_words(texts: DataFrame, text: str) -> DataFrame:
    """(word, n) over whole texts in lower case; words broken at line ends are left out."""

    def words(tokens: Counter) -> pd.DataFrame:
        found: Counter = Counter()
        for token, n in tokens.items():
            if token.isalpha():
                found[token] += n
            elif "\x00" not in token:
                for w in _WORD.findall(token):
                    found[w] += n
        return pd.DataFrame(list(found.items()), columns=["word", "n"])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for t in b[text]:
                if t:
                    total.update(_BROKEN.sub("\x00", t.lower()).split())
            if len(total) > 400_000:
                yield words(total)
                total.clear()
        yield words(total)

    return texts.select(text).mapInPandas(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(texts: DataFrame, text: str) -> tuple[dict[str, int], int]:
    """(count by word, count of all words) of the corpus; the rarest words are left out (MIN_SHARE, VOCABULARY_BYTES)."""
    counts = written(count_words(texts, text), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(2.0, MIN_SHARE * total)
    while (counts.filter(F.col("n") >= least).agg(F.sum(F.octet_length("word") + 100)).first()[0] or 0) > VOCABULARY_BYTES:
        least *= 2
    return {r["word"]: r["n"] for r in counts.filter(F.col("n") >= least).collect()}, total


class _Kinds(dict):
    """Kind by token as it stands; tokens that are a misread word are in fixes too."""

    def __init__(self, reader: Reader):
        super().__init__()
        self.reader = reader
        self.fixes: dict[str, tuple[str, str]] = {}

    def trim(self) -> None:
        if len(self) > 400_000:
            self.clear()
            self.fixes.clear()

    def __missing__(self, raw: str) -> int:
        kind, bare, fix = self.reader.judge(raw)
        if fix:
            self.fixes[raw] = (bare, fix)
        self[raw] = kind
        return kind


class Reader:
    """Judges words and lines against a vocabulary."""

    def __init__(self, words: dict[str, int], total: int | None = None):
        self.words = words
        self.top = max(words.values(), default=0)
        self.longest = max(map(len, words), default=0)
        self.unseen = max(1.0, UNSEEN_SHARE * (sum(words.values()) if total is None else total))
        self.memo: dict[str, str | None] = {}
        self.kinds = _Kinds(self)

    def judge(self, raw: str) -> tuple[int, str, str | None]:
        """(1 for a known word, -1 for an unknown one, 0 for anything else; the bare token; its correction)."""
        w = raw.strip(_EDGE_SIGNS)
        low = w.lower()
        if not w or "|" in w and (re.search(r"[^\W\d_]{3}\|[^\W\d_]{3}", w) and not self._count(w.lower().replace("|", "i")) and not self._count(w.lower().replace("|", "l")) or w[0] == "|" or w[-1] == "|" or re.search(r"\d\||\|\d", w)):
            return 0, w, None
        core = low.strip("()[]'’")
        long_enough = len(core) > 2 and any(c.isalpha() for c in core)
        n = self.words.get(core, 0)
        if n * RATIO > self.top:  # no word is often enough to be meant
            return (1 if long_enough else 0), w, None
        fix = None if w.isdigit() else self.correction(w)
        if fix and core != low and n * RATIO > self._count(fix):  # a word in brackets
            fix = None
        return (0 if not long_enough else 1 if fix or core in self.words or _WORD.match(core) and _WORD.match(core)[0] in self.words else -1), w, fix

    def correction(self, token: str) -> str | None:
        """The word a token was misread from, None if it is read rightly or can't be told."""
        if token not in self.memo:
            if len(self.memo) > 400_000:
                self.memo.clear()
            self.memo[token] = self._correct(token)
        return self.memo[token]

    def _correct(self, token: str) -> str | None:
        w = token.lower().strip("'’)")
        if w.endswith(")") or not w:
            return None
        n = self._count(w)
        odd = _ODD.search(w) is not None
        letters = sum(c.isalpha() for c in w)
        if letters < 2 or (len(w) - letters > 3 and letters < len(w) - letters):
            return None
        if len(w) > 2 * self.longest + 4:  # no two confusions make it a word, or a compound of two
            return None
        if odd and ("@" in w and "." in w or re.fullmatch(r"[A-Z]{1,4}[-/]?\d[\d\-/A-C]*", token)):
            return None
        if w[0] == "(":
            rest = self.words.get(w[1:], 0)
            return "c" + w[1:] if ")" not in token and self.words.get("c" + w[1:], 0) >= max(4 * self.unseen, RATIO * rest) else None
        if not odd and (n * RATIO > self.top or len(w) < 3):
            return None
        best, best_n = None, 0
        tried = {w}
        frontier, single = [w], []
        get, compound = self.words.get, "-" in w
        for _ in range(2):  # one confusion, or two where the first alone gives no word
            found = []
            for x in frontier:
                for at, c in enumerate(x):
                    for bad, good in _BY_FIRST.get(c, ()):
                        if len(bad) > 1 and not x.startswith(bad, at):
                            continue
                        y = x[:at] + good + x[at + len(bad) :]
                        if y not in tried:
                            tried.add(y)
                            found.append(y)
                            m = get(y, 0) or (self._count(y) if compound else 0)
                            if m > best_n or (m == best_n and best and y < best):
                                best, best_n = y, m
            single = single or found
            if best or not odd:
                break
            frontier = found
        if best and best_n >= (4 * self.unseen if odd and not n else RATIO * max(n, self.unseen)):
            return best
        if odd and not n and _ODD_INSIDE.fullmatch(token):
            return next((y for y in single if y.isalpha()), None)
        return None

    def _count(self, w: str) -> int:
        if w in self.words:
            return self.words[w]
        if "-" in w:
            return min((self.words.get(p, 0) for p in w.split("-") if p), default=0)
        return 0

    def known(self, w: str) -> bool:
        return self.words.get(w.lower(), 0) > 0


_TAIL_NUMBER = re.compile(r"[\s|*·–—-]*(?:\b[\dlIO]{1,4}|\b[ivxl]{1,6})$")
_NUMBERED = re.compile(r"[\s|]\s*(?:\d{1,4}|[ivxl]{1,6})$")
_HEAD_NUMBER = re.compile(r"\d{1,4}\s*[|*·–—-]?\s+(?=\D)")


def _norm(line: str) -> str:
    """A line without surrounding blanks, without the number of a page at its ends."""
    s = line
    if s[-1] in "0123456789lIOivx":
        s = _TAIL_NUMBER.sub("", s)
    if s[:1].isdigit():
        s = _HEAD_NUMBER.sub("", s, count=1)
    return s.lower().strip(" |*·-–—")


def _close(a: str, b: str) -> bool:
    """Whether two lines are the same but for a few damaged, lost or added characters."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 5 or (a[:2] != b[:2] and a[-2:] != b[-2:]):
        return False
    if len(a) == len(b):
        return sum(map(str.__eq__, a, b)) >= 0.75 * len(a)
    short = min(len(a), len(b))
    head = next((i for i in range(short) if a[i] != b[i]), short)
    tail = next((i for i in range(short - head) if a[-1 - i] != b[-1 - i]), short - head)
    return head + tail >= 0.85 * short


def _damaged(a: str, b: str) -> bool:
    """Whether two lines differ in places of one or two characters only."""
    return a == b or all(kind == "equal" or max(j - i, n - m) <= 2 for kind, i, j, m, n in SequenceMatcher(None, a, b, autojunk=False).get_opcodes())


def is_page_number(s: str) -> bool:
    """Whether a line without surrounding blanks holds only the number of a page."""
    if len(s) > 24:
        s = " ".join(s.split())
    if not s or len(s) > 40:  # longer than any match of the pattern
        return False
    m = _PAGE.fullmatch(s)
    if not m:
        return False
    n, word, of = m["n"], (m["word"] or "").strip(" .").lower(), m["of"]
    roman = n.isalpha() and bool(_ROMAN.fullmatch(n.lower()))
    number = any(c.isdigit() for c in n) or (n in ("l", "I") and (word or of))
    if not (roman or number):
        return False
    if word:
        return any(word == w or (len(w) > 3 and len(word) == len(w) and sum(a != b for a, b in zip(word, w)) == 1) for w in _PAGE_WORDS)
    if of:
        return not roman
    if s[0] in "-–—[(|*" and s[-1] in "-–—])|*":
        return True
    return (n.isdigit() and len(n) <= 3 and s == n) or (roman and s == n and n.islower())


def furniture(lines: list[str]) -> tuple[set[int], set[int]]:
    """(running header and footing lines, page number lines) of one text.

    A group of recurring lines is furniture only if one of its lines stands at an edge of a page or of the text or recurs
    undamaged but for a page's number. So groups are grown from those lines alone, but any line can be a member.
    """
    bare = [x.strip(" \f\t") for x in lines]
    full = [i for i, x in enumerate(bare) if x]
    numbers = {i for i in full if (x := bare[i])[-1] in _PAGE_ENDS and len(x) - x.count(" ") <= 40 and is_page_number(x)}
    body = [i for i in full if i not in numbers]
    breaks: set[int] = set()
    for i, x in enumerate(lines):
        if "\f" in x and (k := bisect.bisect_left(full, i)) < len(full):
            breaks.add(full[k])
    norms: dict[int, str] = {}
    by_norm: dict[str, list[int]] = {}
    for i in body:
        s = _norm(bare[i])
        if s[2:]:
            norms[i] = s
            if s in by_norm:
                by_norm[s].append(i)
            else:
                by_norm[s] = [i]
    at_edge: set[int] = set()
    for i in numbers | breaks:
        k = bisect.bisect_left(full, i)
        at_edge.update(full[max(0, k - 1) : k + (2 if i in numbers else 1)])
    numbered = {i for i in norms if bare[i][-1] in "0123456789ivxl" and _NUMBERED.search(bare[i])}
    first, last, top = set(full[:3]), set(full[-2:]), set(full[:2])
    repeated = sum(len(v) > 1 for v in by_norm.values())
    starts = at_edge | first | last
    seeds = sorted(((s, at) for s, at in by_norm.items() if not starts.isdisjoint(at) or (len(at) > 1 and not numbered.isdisjoint(at))), key=lambda kv: (-len(kv[1]), kv[1][0]))
    # lines that are close share their first or their last two characters
    heads: dict[str, list[str]] = {s[:2]: [] for s, _ in seeds}
    tails: dict[str, list[str]] = {s[-2:]: [] for s, _ in seeds}
    for s in by_norm if seeds else ():
        if s[:2] in heads:
            heads[s[:2]].append(s)
        if s[-2:] in tails:
            tails[s[-2:]].append(s)
    groups: list[list[int]] = []
    used: set[int] = set()
    for s, at in seeds:
        if at[0] in used:
            continue
        # without a sign of pages only single characters may differ: sentences in which a word differs are no headers
        paged = (repeated or breaks or len(numbers) > 1) and (len(at) > 1 or at[0] in at_edge or at[0] in top)
        low, high = len(s) - 3, len(s) + 3
        near = {t for t in (*heads[s[:2]], *tails[s[-2:]]) if low < len(t) < high and t != s and _close(s, t) and (paged or _damaged(s, t))}
        group = sorted(j for t in (s, *near) for j in by_norm[t] if j not in used)
        if len(group) > 1:
            groups.append(group)
            used.update(group)
    out: set[int] = set()
    width = sorted(len(bare[i]) for i in body)[int(0.8 * (len(body) - 1))] if groups else 0
    wrapped = len([i for i in body if len(lines[i]) >= 38]) * 2 >= len(body)
    for g in groups:
        text = lines[g[0]].strip(" \f\t")
        if _MARK.match(text) and not any(j in breaks for j in g):
            continue
        edges = sum(i in at_edge or i in first or i in last for i in g)
        counting = [int(m[1]) for i in g if (m := re.search(r"(\d{1,4})\s*$", lines[i]))]
        rising = len(counting) > 1 and len(set(counting)) == len(counting) and sorted(counting) == counting and counting[-1] - counting[0] < 4 * len(counting) + 4
        ends = sum(lines[i].rstrip()[-1:] in ".,;" for i in g) > len(g) / 2 and not text.endswith(("Co.", "Inc.", "Ltd."))
        upper = not text[0].islower() or text.startswith("www")
        if ends and not edges == len(g):
            continue
        cells = re.search(r"\t|\|.*\||;.*;| {2,}\S.* {2,}\S|(?<![\d.])[\d,]+\.\d\d(?![\d.])", text)
        if cells:
            continue
        strong = (rising and bool(numbered & set(g))) or (edges * 3 >= 2 * len(g) and (breaks or numbers) and upper)
        # without a sign of pages a line as wide as those of the body is a line of the body
        weak = upper and (g[0] in first or g[-1] in last) and wrapped and not text.endswith(":") and (len(text) < 0.9 * width or len(g) > 2)
        entries = upper and g[0] in first and not wrapped and repeated <= 1 and not text.endswith(":")
        if strong or weak or entries:
            out.update(g)
    return out, numbers


def inspect(text: str, reader: Reader, repair: bool = True) -> tuple[list[tuple[int, str]], str | None]:
    """(noise as (line_no, kind), repaired text if wanted) of one text; junk has no noise and is returned unchanged."""
    lines = text.split("\n")
    tokens = text.split()
    reader.kinds.trim()
    kinds = list(map(reader.kinds.__getitem__, tokens))
    good, bad = kinds.count(1), kinds.count(-1)
    if not good + bad:
        return [], text
    tokens = set(tokens)
    distinct = len(tokens)
    fixes = {t: reader.kinds.fixes[t] for t in tokens if t in reader.kinds.fixes}
    same = len([x for x in lines if len(x) > 2 and x[0] == x[-1] and x.count(x[0]) == len(x)])
    few = same * 4 >= len(lines) or (len(kinds) >= 8 and distinct <= 4 and distinct < 0.12 * len(kinds))
    known = good / (good + bad)
    if known < 0.5 or few or (known < 0.85 and len(_GLUED.findall(text)) > 0.15 * len(kinds)):
        return [], text
    headers, numbers = furniture(lines)
    found = [(i, "running_header") for i in headers] + [(i, "page_number") for i in numbers]
    body = [i for i in range(len(lines)) if i not in headers and i not in numbers and lines[i].strip(" \f\t")]
    ends = {i: lines[i].rstrip(" ")[-1:] for i in body}
    styles = Counter(e for e in ends.values() if e in _ENDS)
    fixed = {i: lines[i].strip("\f") for i in body} if repair else dict.fromkeys(body, "")
    glue: dict[int, str] = {}
    halves: dict[int, tuple[bool, bool]] = {}
    for k, i in enumerate(body[:-1]):
        if ends[i] not in _ENDS:
            continue
        s = lines[i].rstrip(" ")
        if len(s) < 3 or not s[-2].isalnum() and s[-2] not in "|!@(":
            continue
        j = body[k + 1]
        head = re.search(r"[^\s\"“„«]+$", s[:-1])
        tail = re.match(r"\s*([^\s,;:.?\"”»]+)", lines[j].lstrip("\f"))
        if not head or not tail:
            continue
        a, b = head[0], tail[1]
        broken = _is_broken(a, b, s[-1], styles, reader)
        glue[i] = "" if broken else "-" if s[-1] in "-‐" else ""
        halves[i] = (True, False)
        halves[j] = (halves.get(j, (False, False))[0], True)
        if broken:
            found.append((i, "hyphenation"))
            fix = reader.correction(a + b) if not reader.known((a + b).strip("()'’")) else None
            if fix:
                ends_well = fix.startswith(a.lower())
                found.append((j if ends_well else i, "misread"))
    for i in body if fixes else ():
        row = lines[i].split()
        if fixes.keys().isdisjoint(row):
            continue
        skip_last, skip_first = halves.get(i, (False, False))
        bad = False
        for n, raw in enumerate(row):
            if raw in fixes and not (n == 0 and skip_first) and not (n == len(row) - 1 and skip_last):
                bad = True
                w, fix = fixes[raw]
                fixed[i] = fixed[i].replace(w, _cased(w, fix), 1)
        if bad:
            found.append((i, "misread"))
    return sorted(set(found)), _paragraphs(lines, body, fixed, glue) if repair else None


def _is_broken(a: str, b: str, sign: str, styles: Counter, reader: Reader) -> bool:
    """Whether a word was broken between a and b that has no hyphen of its own there."""
    b0 = b.strip("()'’")
    a0 = re.sub(r"^[(\['’]+", "", a)
    if not b0 or not (b0[0].isalpha() or b0[0] in "@(|!1056") or "@" in b[1:] and "." in b or not any(c.isalpha() for c in a0):
        return False
    if re.search(r"\d", a0) and re.search(r"\d", b0) or re.fullmatch(r"[A-Z]{1,4}", a0) and re.match(r"\d", b0):
        return False
    joined, linked = (a0 + b0).lower(), f"{a0}-{b0}".lower()
    if sign in "­¬":
        return True
    other = sum(n for c, n in styles.items() if c != sign)
    own, whole = reader.words.get(linked, 0), reader.words.get(joined, 0)
    if own and (own * 20 >= whole or other > 0):
        return False
    if whole:
        return True
    if reader.correction(joined) and reader.words.get(reader.correction(joined), 0) > 0:
        return not own
    if "-" in a0 and reader.known(a0.split("-")[-1] + b0):
        return True
    corrected = reader.correction(linked)
    if corrected and "-" in corrected and reader.words.get(corrected, 0) > 0:
        return False
    if b0[0].isupper() and not a0.isupper():
        return False
    return not (reader.known(a0) and reader.known(b0) and len(a0) > 3 and len(b0) > 3)


def _cased(seen: str, fix: str) -> str:
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return fix.upper()
    return fix[0].upper() + fix[1:] if seen[0].isupper() else fix


def _paragraphs(lines: list[str], body: list[int], fixed: dict[int, str], glue: dict[int, str]) -> str:
    """Wrapped lines joined; blank lines, indents and lines that are short in a wrapped text end a paragraph."""
    if not body:
        return ""
    width = sorted(len(lines[i]) for i in body)[int(0.8 * (len(body) - 1))]
    wrapped = width >= 36 and not any(re.search(r"\t|\|.*\|", lines[i]) for i in body)
    out: list[str] = []
    for k, i in enumerate(body):
        s = fixed[i].rstrip(" ")
        new = k == 0
        if k:
            j = body[k - 1]
            gap = i - j > 1 and any(not lines[m].strip(" \f\t") for m in range(j + 1, i))
            full = len(lines[j].rstrip()) >= 0.72 * width
            ended = lines[j].rstrip()[-1:] in ".!?:"
            new = not wrapped or (gap and (ended or not full)) or (lines[i].startswith(" ") and ended) or (not full and ended) or bool(_MARK.match(lines[i]))
            if j in glue:
                new = False
        if new:
            out.append(s.strip())
        elif body[k - 1] in glue:
            out[-1] = out[-1][:-1].rstrip(_HYPHENS) + ("" if glue[body[k - 1]] == "" else "-") + s.strip()
        else:
            out[-1] += " " + s.strip()
    return "\n".join(out)


def find_scan_noise(texts: DataFrame, text: str) -> DataFrame:
    """One row per line of a text and kind of noise in it: the columns of texts but text, line_no and noise_kind.

    Null, empty and junk texts give no rows; repeated rows give repeated results. Columns named line_no or noise_kind
    are replaced.
    """
    keep = [c for c in texts.columns if c.lower() not in ("line_no", "noise_kind") and c != text]
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary(texts, text))

    def noisy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for b in batches:
            rows, at, kinds = [], [], []
            for row, t in enumerate(b.column(0).to_pylist()):
                for i, kind in inspect(t, reader, False)[0] if t else ():
                    rows.append(row)
                    at.append(i)
                    kinds.append(kind)
            kept = b.take(pa.array(rows, pa.int32())).columns[1:]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at, pa.int32()), pa.array(kinds, pa.string())], [*keep, "line_no", "noise_kind"])

    found = texts.select(F.col(text).alias("__qf_text"), *keep)
    schema = T.StructType([*texts.select(*keep).schema.fields, T.StructField("line_no", T.IntegerType()), T.StructField("noise_kind", T.StringType())])
    return found.filter(F.length("__qf_text") > 0).mapInArrow(noisy, schema)


def repair_scans(texts: DataFrame, text: str) -> DataFrame:
    """Adds scan_noise (array of (line_no, noise_kind)) and scan_repaired (the text in continuous paragraphs).

    Null texts give nulls, empty and junk texts no noise and themselves. Rows are neither dropped nor repeated;
    columns of the two names are replaced.
    """
    keep = [c for c in texts.columns if c.lower() not in ("scan_noise", "scan_repaired")]
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary(texts, text))

    @F.pandas_udf("noise array<struct<line_no:int,noise_kind:string>>, repaired string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(*shared.value)
        for b in batches:
            rows = []
            for t in b:
                noise, fixed = inspect(t, reader) if t else ([], t)
                rows.append(([{"line_no": i, "noise_kind": k} for i, k in noise], fixed))
            yield pd.DataFrame(rows, columns=["noise", "repaired"])

    out = texts.select(*keep, F.when(F.col(text).isNotNull(), read(F.col(text))).alias("__qf_r"))
    return out.select(*keep, F.col("__qf_r.noise").alias("scan_noise"), F.col("__qf_r.repaired").alias("scan_repaired"))
