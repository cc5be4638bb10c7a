"""Text statistics and text types: natural prose, list, table or junk.

The statistics are counts over whole texts; the words that count as common are those of the corpus. Two thresholds on
one statistic make a noisy labelling function: beyond either it votes for one or more types, between them it abstains.
What each function's votes are worth is learned by expectation-maximization on how the functions agree, over the counted
vote patterns of all texts, and every text gets the posterior over the types.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.session import written

TYPES = ("prose", "list", "table", "junk")

#: A common word makes up at least this share of all words (one a line counted): at most 500 words.
COMMON_SHARE = 0.002
_STRIP = ".,;:!?()\"'„“”«»"
_VOWELS = "aeiouy"
_ASCII = re.compile("[\x00-\x7f]+")
#: ASCII characters but those of words, letters and vowels in lower case.
_NO_WORD, _NO_LETTER, _NO_VOWEL = (bytes(b for b in range(128) if chr(b) not in keep) for keep in ("abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz", _VOWELS))
_MORE_VOWELS = "àáâãäåæèéêëìíîïòóôõöøùúûüœаеёиоуыэюя"
_MARK = re.compile(r"\s*(?:[-*•·▪◦‣–+>]|[oO](?= \w)|\(?\d{1,3}[.)\]]|\(?[a-zA-Z][.)]|\(?[ivx]{1,5}[.)]|\[[ xX]?\]|☐|☑)\s+\S")
_GAP = re.compile(r" *[\t|;] *| {2,}")
_CSV_END = re.compile(r'[,"\t|;] *[$€£(]?\d[\d,]*(?:\.\d+)?[%)]?"? *$')
_AMOUNT_END = re.compile(r'(?:[.\d]\d|%)\)?(?: ?(?:EUR|USD|€))?"? *\|? *$')
_HEX = re.compile(r"(?:\b[0-9a-f]{2} ){6,}[0-9a-f]{2}\b")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{50,}={0,2}")
_SENTENCE = re.compile(r"(?:[^\W\d_]|[€%)]|\d{3})[.!?] +[^\W\d_a-zа-яà-ÿ]")
_STRAY = re.compile(r"[#&~^§%@*_=<>{}\\](?=[^\W\d_])|(?<=[^\W\d_])[#&~^§%@*_=<>{}\\|](?=[\w\s])")

STATISTICS = (
    "word_count", "line_count", "mean_word_length", "letter_ratio", "symbol_ratio", "punctuated_line_share", "common_word_share", "marked_line_share", "divided_line_share",
    "amount_line_share", "short_line_share", "running_line_share", "unended_line_share", "sentence_share", "coded_line_share", "stray_sign_share",
    "vowel_ratio", "distinct_word_share", "words_per_line",
)


def measure(t: str, common: frozenset[str] = frozenset()) -> tuple[float, ...]:
    """The statistics of one text, in the order of STATISTICS; ratios are 0 for texts without lines or words."""
    lines = [x for x in t.split("\n") if x and not x.isspace()]
    low = t.lower()
    words = low.split()
    nl, nw = len(lines) or 1, len(words) or 1
    chars = sum(map(len, words)) or 1
    plain = low.encode("ascii", "ignore")
    alnum, letters, vowels = len(plain.translate(None, _NO_WORD)), len(plain.translate(None, _NO_LETTER)), len(plain.translate(None, _NO_VOWEL))
    if len(plain) < len(low):
        rest = _ASCII.sub("", low)
        alnum += sum(map(str.isalnum, rest))
        letters += sum(map(str.isalpha, rest))
        vowels += sum(map(_MORE_VOWELS.__contains__, rest))
    end = marked = divided = amounts = short = running = coded = unended = 0
    capitals, before = t.isupper(), "."
    long_word = max(map(len, words), default=0) >= 50
    for line in lines:
        s = line.strip()
        last = s[-1]
        short += len(line) <= 48
        end += last in ".!?"
        first = s[0]
        gaps = line.count(" ")
        if gaps >= 4 and len(s) >= 4 * gaps and ((first.islower() and gaps >= 6) or (capitals and before not in ".!?:" and len(set(s.split())) >= 4)):
            running += 1
        before = last
        if last.isalpha() and (x := s[s.rfind(" ") + 1 :]) in common and x != s:
            unended += 1
        if not first.isalpha() or first in "oO" or s[1:2] in (".", ")"):
            marked += _MARK.match(line) is not None
        cells = ("\t" in s or "|" in s or ";" in s or "  " in s) and len(_GAP.findall(s.strip("|; "))) >= 2
        if last.isdigit() or last in '%")|€RD':
            amounts += _AMOUNT_END.search(line) is not None
            cells = cells or s.count(",") >= 2 and _CSV_END.search(line) is not None
        divided += cells
        if len(s) >= 2 and len(set(s[:6])) <= 2 and len(set(s)) <= 2:
            coded += 1
        elif (long_word and _BASE64.search(s)) or (len(s) >= 20 and s[-3:-2] == " " and _HEX.search(s)):
            coded += 1
    return (
        float(len(words)), float(len(lines)), chars / nw if words else 0.0, letters / chars, max(0, chars - alnum) / chars if words else 0.0, end / nl,
        sum(w.strip(_STRIP) in common for w in words) / nw, marked / nl, divided / nl, amounts / nl, short / nl, running / nl, unended / nl,
        len(_SENTENCE.findall(t)) / nl, coded / nl, len(_STRAY.findall(t)) / nw, vowels / letters if letters else 0.0, len(set(words)) / nw if words else 0.0, nw / nl if words else 0.0,
    )


def common_words(df: DataFrame, text: str) -> frozenset[str]:
    """The words that make up at least COMMON_SHARE of all words of the corpus; a word counts once a line."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()

        def table() -> pd.DataFrame:
            words: Counter = Counter()
            for w, n in total.items():
                w = w.strip(_STRIP)
                words[w if w.isalpha() else ""] += n
            return pd.DataFrame(list(words.items()), columns=["word", "n"])

        for b in batches:
            for t in b[text]:
                if t:
                    total.update(itertools.chain.from_iterable(map(set, map(str.split, t.lower().split("\n")))))
            if len(total) > 300_000:
                yield table()
                total.clear()
        yield table()

    counts = written(df.select(text).mapInPandas(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "text-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r["word"] for r in counts.filter((F.col("word") != "") & (F.col("n") >= COMMON_SHARE * total)).collect())


def text_statistics(text: Column, common: frozenset[str]) -> Column:
    """struct of per-text statistics, null for null texts; common has at most 1 / COMMON_SHARE words.

    Counted in one pass of a batched Python function: as some twenty JVM regular expressions over the whole text the
    same statistics took many times as long.
    """

    @F.pandas_udf(", ".join(f"{n} double" for n in STATISTICS))
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t or "", common) for t in texts], columns=list(STATISTICS))

    return F.when(text.isNotNull(), measured(text))


#: (statistic, low, high, types voted for at or below low, types at or above high); between low and high the function
#: abstains, and so it does on a side without types.
FUNCTIONS = (
    ("common_word_share", 0.06, 0.33, "table junk", "prose"),
    ("running_line_share", 0.02, 0.15, "list table junk", "prose"),
    ("unended_line_share", None, 0.05, "", "prose"),
    ("sentence_share", 0.02, 0.1, "list table junk", "prose"),
    ("words_per_line", 6.2, 7.0, "list table junk", "prose"),
    ("short_line_share", 0.5, 0.8, "prose", "list table junk"),
    ("letter_ratio", 0.5, 0.75, "table junk", "prose list"),
    ("marked_line_share", None, 0.5, "", "list"),
    ("divided_line_share", None, 0.4, "", "table"),
    ("amount_line_share", None, 0.5, "", "table"),
    ("symbol_ratio", None, 0.45, "", "junk"),
    ("vowel_ratio", 0.26, None, "junk", ""),
    ("mean_word_length", 2.2, 16.0, "junk", "junk"),
    ("distinct_word_share", 0.2, None, "junk", ""),
    ("coded_line_share", None, 0.3, "", "junk"),
    ("stray_sign_share", None, 0.15, "", "junk"),
)


def outcome(s: Column, f: tuple) -> Column:
    """0 where the function abstains, 1 at or below its low threshold, 2 at or above the high one; one vote for both where they are alike."""
    name, low, high, below, above = f
    out = F.lit(0)
    if high is not None:
        out = F.when(s[name] >= high, 1 if below == above else 2).otherwise(out)
    if low is not None:
        out = F.when(s[name] <= low, 1).otherwise(out)
    return out


def majority(outcomes: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """Share of the votes each type gets by pattern; a vote for several types is divided among them.

    With counts a vote weighs as much as it is rare among all texts (the square of the logarithm of its share).
    """
    votes = np.full((len(outcomes), len(TYPES)), 1e-3)
    for j, (*_, below, above) in enumerate(FUNCTIONS):
        for o, types in ((1, below), (2, above)):
            hit = outcomes[:, j] == o
            weight = 1.0 if counts is None else np.log((counts[hit].sum() + 0.5) / (counts.sum() + 1)) ** 2
            for t in types.split():
                votes[hit, TYPES.index(t)] += weight / len(types.split())
    return votes / votes.sum(axis=1, keepdims=True)


def em(outcomes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(posterior over TYPES per pattern, probability of each outcome by function and component) of a naive Bayes mixture.

    Prose, lists and tables are a component each. Junk is whatever else there is, so every function that votes for junk
    alone starts a component of its own. The weighed majority of the votes is the start and names the components; after
    that only the agreements count: every outcome of every function, abstentions included, gets the probability with
    which the components show it.
    """
    alone = [(j, o) for j, (*_, below, above) in enumerate(FUNCTIONS) for o in sorted({o for o, types in ((1, below), (2, above)) if types == "junk"})]
    alone = [(j, o) for j, o in alone if not (o == 2 and (j, 1) in alone)]  # one where both sides are the same vote
    kinds = np.array([0, 1, 2] + [3] * len(alone))
    start = majority(outcomes, counts)
    start = np.where(start == start.max(axis=1, keepdims=True), start, 1e-4)  # the winner, so that no component starts amid another
    start /= start.sum(axis=1, keepdims=True)
    fired = np.array([outcomes[:, j] == o for j, o in alone]).T + 1e-3
    post = np.hstack([start[:, :3], start[:, 3:] * fired / fired.sum(axis=1, keepdims=True)])
    seen = [(outcomes == o).astype(float) for o in range(3)]
    theta = np.zeros((outcomes.shape[1], 3, len(kinds)))
    for _ in range(rounds):
        w = post * counts[:, None]
        mass = w.sum(axis=0)
        prior = (mass + 1) / (mass.sum() + len(kinds))
        for o in range(3):
            theta[:, o] = (seen[o].T @ w + 0.5) / (mass + 1.5)
        like = np.log(prior) + sum(x @ np.log(theta[:, o]) for o, x in enumerate(seen))
        like -= like.max(axis=1, keepdims=True)
        new = np.exp(like)
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return np.array([post[:, kinds == k].sum(axis=1) for k in range(len(TYPES))]).T, theta


def classify_texts(df: DataFrame, text: str, keep_text: bool = True) -> DataFrame:
    """Adds text_stats, text_kind and text_posterior (map type -> probability) to every row.

    Null and blank texts get null kinds and posteriors (and zero statistics where blank). Rows are neither dropped nor
    repeated; equal texts get equal kinds. Columns with the three names are replaced. There are at most 3^6 * 2^10 vote
    patterns whatever the data's size; only their counts reach the driver. Without keep_text the text column is left
    out, so that the statistics, counted once, can be kept in the shared folder between the two steps.
    """
    keep = [c for c in df.columns if c.lower() not in ("text_stats", "text_kind", "text_posterior") and (keep_text or c != text)]
    body = df[text]
    s = df.select(*[df[c] for c in keep], body.rlike(r"\S").alias("__qf_some"), text_statistics(body, common_words(df, text)).alias("text_stats"))
    code = sum((outcome(F.col("text_stats"), f) * 3**i for i, f in enumerate(FUNCTIONS)), F.lit(0))
    s = s.withColumn("__qf_votes", F.when(F.col("__qf_some"), code)).drop("__qf_some")
    if not keep_text:
        s = written(s, "text-stats")
    counted = s.filter("__qf_votes is not null").groupBy("__qf_votes").count().collect()  # at most 3^6 * 2^10 rows
    rows = []
    if counted:
        codes = np.array([r["__qf_votes"] for r in counted])
        post, _ = em(codes[:, None] // 3 ** np.arange(len(FUNCTIONS)) % 3, np.array([float(r["count"]) for r in counted]))
        rows = [(int(c), TYPES[int(p.argmax())], {t: float(x) for t, x in zip(TYPES, p)}) for c, p in zip(codes, post)]
    verdicts = df.sparkSession.createDataFrame(rows, "__qf_code int, text_kind string, text_posterior map<string,double>")
    joined = s.join(F.broadcast(verdicts), s["__qf_votes"] == verdicts["__qf_code"], "left")
    return joined.select(*keep, "text_stats", "text_kind", "text_posterior")
