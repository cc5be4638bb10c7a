"""Finding and restoring text that was decoded with a wrong character encoding.

A smoothed character n-gram model is trained on the words of clean records. For a word with foreign characters every
encode-decode chain that could have garbled it is undone, and the likeliest restoration is accepted when it beats the
word as it stands by a margin and the same chain gains as much over all words of its passage. The margin is validated on
all clean passages, each held out of the model that judges it, and on the same passages garbled in every way.
"""

from __future__ import annotations

import bisect
import codecs
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.session import written

#: Encodings a text may have had, and encodings it may have been read with.
TRUE_ENCODINGS = ("utf-8", "cp1252", "mac_roman", "cp850", "cp437", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
READ_ENCODINGS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "iso8859-15", "cp1253", "cp1254", "mac_cyrillic")
#: An n-gram is kept if it makes up at least this share of all n-grams; their table is cut at a higher share beyond GRAM_BYTES.
MIN_SHARE = 1e-7
GRAM_BYTES = 64 << 20
#: To validate the margin clean records are divided into so many parts; each is judged by the model of the others.
FOLDS = 4
#: Passages that are validated in one task: every task judges the words of its passages again.
TASK_PASSAGES = 20_000
#: A false alarm on a clean passage weighs as so many misses of garbled ones.
ALARM_WEIGHT = 1000.0
#: The margin in nats is at least this.
LEAST_MARGIN = 3.0
MARGINS = [LEAST_MARGIN + i / 2 for i in range(24)]

#: A word with at least one character outside ASCII, between blanks; digits count as one class later.
WORD = r"[^ \t\n\r\f]*[^\x00-\x7f \t\n\r\f][^ \t\n\r\f]*"
_WORD = regex.compile(WORD)
_DIGIT = regex.compile(r"\d")
_ASCII_DIGIT = regex.compile(r"[0-9]")
#: A passage: a sentence or a line.
_PASSAGE = regex.compile(r"[^\n]+?(?:[.!?…:](?= )|(?=\n)|$)")
#: Characters no clean text has: C1 controls, the replacement character, box drawing and block elements.
BROKEN = r"[\x80-\x9f�─-▟]"
_BROKEN = regex.compile(BROKEN)


def _tables(name: str) -> dict[str, int]:
    """Character -> byte of a single-byte encoding; undefined bytes pass through as the control of the same number."""
    table = {}
    for b in range(256):
        try:
            c = codecs.decode(bytes([b]), name)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    return table


_TO_BYTE = {n: _tables(n) for n in READ_ENCODINGS}
_FROM_BYTE = {n: {b: c for c, b in _tables(n).items()} for n in TRUE_ENCODINGS if n != "utf-8"}


def undone(word: str) -> Iterator[tuple[str, str]]:
    """(chain, restoration) for every way the word can have been garbled."""
    for read, table in _TO_BYTE.items():
        try:
            raw = bytes(table[c] for c in word)
        except KeyError:
            continue
        for true in TRUE_ENCODINGS:
            if true == read:
                continue
            if true == "utf-8":
                try:
                    out = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
            else:
                back = _FROM_BYTE[true]
                out = "".join(back.get(b, "\x81") for b in raw)
            if out != word and "\x81" not in out:
                yield f"{true}>{read}", out


def undo(word: str, chain: str) -> str | None:
    """The word with a chain as best_restoration names it undone, None if it can't be."""
    for step in chain.split(", ")[::-1]:
        true, read = step.split(">")
        try:
            raw = bytes(_TO_BYTE[read][c] for c in word)
            word = raw.decode("utf-8") if true == "utf-8" else "".join(_FROM_BYTE[true].get(b, "\x81") for b in raw)
        except (KeyError, UnicodeDecodeError):
            return None
    return word


def normal(word: str) -> str:
    return _DIGIT.sub("0", word).lower()


class Model:
    """Interpolated character trigrams; score is the log likelihood of a word with its ends."""

    def __init__(self, grams: dict[str, int]):
        self.grams = grams
        self.total = max(1, sum(n for g, n in grams.items() if len(g) == 1))
        self.kinds = max(1, sum(1 for g in grams if len(g) == 1))
        self.memo: dict[str, float] = {}

    def _log(self, gram: str) -> float:
        if gram not in self.memo:
            a, b, c = gram
            g = self.grams.get
            uni = (g(c, 0) + 0.01) / (self.total + 0.01 * (self.kinds + 1000))
            two, one = g(a + b, 0), g(b, 0)
            bi = (g(b + c, 0) + 4 * uni) / (one + 4)
            tri = (g(gram, 0) + 4 * bi) / (two + 4)
            self.memo[gram] = math.log(tri)
        return self.memo[gram]

    def score(self, word: str) -> float:
        w = "^^" + normal(word) + "$"
        return sum(self._log(w[i - 2 : i + 1]) for i in range(2, len(w)))


def ngrams(word: str, n: int = 1) -> Counter:
    w = "^^" + normal(word) + "$"
    c: Counter = Counter()
    for i in range(2, len(w)):
        c[w[i]] += n
        c[w[i - 1 : i + 1]] += n
        c[w[i - 2 : i + 1]] += n
    c["^"] += n
    c["^^"] += n
    return c


def best_restoration(model: Model, word: str) -> tuple[float, str, str]:
    """(gain in nats, chain, restoration) of the likeliest chain, also of two chains on end of UTF-8 kind."""
    base, best = model.score(word), (-math.inf, "", word)
    seen: set[str] = set()
    opened: set[str] = set()
    for chain, out in undone(word):
        if out not in seen:
            seen.add(out)
            gain = model.score(out) - base
            if gain > best[0]:
                best = (gain, chain, out)
        if chain.startswith("utf-8") and out not in opened and not out.isascii():
            opened.add(out)
            for chain2, out2 in undone(out):
                if chain2.startswith("utf-8"):
                    gain = model.score(out2) - base
                    if gain > best[0]:
                        best = (gain, f"{chain2}, {chain}", out2)
                    for chain3, out3 in undone(out2):
                        if chain3.startswith("utf-8") and model.score(out3) - base > best[0]:
                            best = (model.score(out3) - base, f"{chain3}, {chain2}, {chain}", out3)
    return best


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) of the words with foreign characters, digits as 0, of records without broken characters."""
    clean = docs.filter(F.col(text).isNotNull() & ~F.col(text).rlike(BROKEN))
    words = clean.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), 0)).alias("word"))
    return words.select(F.regexp_replace("word", r"\d", "0").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _gram_table(counted: DataFrame) -> dict[str, int]:
    """Summed n-grams, those of at least MIN_SHARE and within GRAM_BYTES."""
    summed = written(counted.groupBy("key").agg(F.sum("n").alias("n")), "gram-counts")
    least = max(1.0, MIN_SHARE * (summed.agg(F.sum("n")).first()[0] or 0))
    while (summed.filter(F.col("n") >= least).agg(F.sum(F.octet_length("key") + 100)).first()[0] or 0) > GRAM_BYTES:
        least *= 2
    return {r["key"]: r["n"] for r in summed.filter(F.col("n") >= least).collect()}


class Judge:
    """Verdicts on words and passages by one model; verdicts are kept by word."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, tuple[float, str, str]] = {}
        self.gains: dict[tuple[str, str], float] = {}

    def word(self, word: str) -> tuple[float, str, str]:
        if word not in self.memo:
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[word] = best_restoration(self.model, word)
        return self.memo[word]

    def chains(self, words: list[str], margin: float) -> set[str]:
        """The chains that explain a word of the passage, and the passage, better by the margin than nothing wrong."""
        named = {v[1] for w in set(words) if (v := self.word(w))[0] >= margin}
        return {c for c in named if self.gain(words, c) >= margin}

    def gain(self, words: list[str], chain: str) -> float:
        """What undoing one chain gains over all words of a passage; words it can't have garbled don't count."""
        total = 0.0
        for w in words:
            if (w, chain) not in self.gains:
                if len(self.gains) > 500_000:
                    self.gains.clear()
                out = undo(w, chain)
                self.gains[w, chain] = 0.0 if out is None or out == w else self.model.score(out) - self.model.score(w)
            total += self.gains[w, chain]
        return total

    def score(self, words: list[str]) -> float:
        """The least margin at which the passage counts as clean."""
        best: dict[str, float] = {}
        for w in set(words):
            g, chain, _ = self.word(w)
            if chain and g > best.get(chain, 0.0):
                best[chain] = g
        return max((min(g, self.gain(words, c)) for c, g in best.items()), default=-math.inf)


def train(docs: DataFrame, text: str) -> tuple[Model, float]:
    """The model of all clean records and the validated margin.

    Two rounds: words that a strict UTF-8 chain undoes are no clean words; a first model of all others finds the records
    of which a word is better explained by some chain, and the second model is trained on the records without any, so
    that no garbled word of theirs counts as clean. The margin is validated on all passages of these records: those of
    each of FOLDS parts by a model of the other parts. Passages that differ in digits only count once in a part.
    """
    spark = docs.sparkSession
    words = written(word_counts(docs, text), "words")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for w, n in zip(b["word"], b["n"]):
                if not any(chain.startswith("utf-8") for chain, _ in undone(w)):
                    total.update(ngrams(w, int(n)))
            if len(total) > 300_000:
                yield pd.DataFrame(list(total.items()), columns=["key", "n"])
                total.clear()
        yield pd.DataFrame(list(total.items()), columns=["key", "n"])

    shared = spark.sparkContext.broadcast(_gram_table(words.mapInPandas(first, "key string, n bigint")))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(Model(shared.value))
        counted: list[Counter] = [Counter() for _ in range(FOLDS)]
        passages: list[set[str]] = [set() for _ in range(FOLDS)]
        grams: dict[str, Counter] = {}

        def flushed() -> pd.DataFrame:
            rows = []
            for fold, words in enumerate(counted):
                total: Counter = Counter()
                for w, n in words.items():
                    total.update({g: k * n for g, k in grams.setdefault(w, ngrams(w)).items()})
                rows += [(g, n, fold, "gram") for g, n in total.items()] + [(p, 1, fold, "passage") for p in passages[fold]]
                words.clear()
                passages[fold].clear()
            grams.clear()
            return pd.DataFrame(rows, columns=["key", "n", "fold", "kind"])

        for b in batches:
            for t in b[text]:
                words = _WORD.findall(t)
                if any(judge.word(w)[0] >= LEAST_MARGIN for w in set(words)):
                    continue
                fold = zlib.crc32(t.encode()) % FOLDS
                counted[fold].update(words)
                for line in t.split("\n"):
                    if not line.isascii():
                        passages[fold].update(_ASCII_DIGIT.sub("0", " ".join(found)) for p in _PASSAGE.findall(line) if (found := _WORD.findall(p)))
                if sum(map(len, counted)) + sum(map(len, passages)) > 200_000:
                    yield flushed()
        yield flushed()

    clean = docs.select(text).filter(F.col(text).rlike(r"[^\x00-\x7f]") & ~F.col(text).rlike(BROKEN))
    rows = written(clean.mapInPandas(second, "key string, n bigint, fold int, kind string"), "grams")
    grams = rows.filter("kind = 'gram'")
    margin = cheapest_margin(validated(rows.filter("kind = 'passage'").select("fold", "key"), grams))
    return Model(_gram_table(grams.select("key", "n"))), margin


def validated(passages: DataFrame, grams: DataFrame) -> Counter:
    """The tally of all passages (fold, key), each judged by a model of the n-grams (key, n, fold) of the other folds."""
    spark = passages.sparkSession
    passages = written(passages.distinct(), "passages")
    most = passages.groupBy("fold").count().agg(F.max("count")).first()[0]
    if not most:
        return Counter()
    models = [spark.sparkContext.broadcast(_gram_table(grams.filter(F.col("fold") != fold).select("key", "n"))) for fold in range(FOLDS)]

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judges: dict[int, Judge] = {}
        for b in batches:
            for fold, part in b.groupby("fold"):
                if fold not in judges:
                    judges.clear()
                    judges[fold] = Judge(Model(models[fold].value))
                counts = tally(judges[fold], [k.split(" ") for k in part["key"]])
                yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["bad", "step", "n"])

    parts = math.ceil(most / TASK_PASSAGES)
    tasks = passages.withColumn("task", F.col("fold") * parts + F.pmod(F.xxhash64("key"), F.lit(parts))).repartitionByRange(FOLDS * parts, "task").sortWithinPartitions("task")
    counts = tasks.select("fold", "key").mapInPandas(judged, "bad boolean, step int, n bigint").groupBy("bad", "step").agg(F.sum("n").alias("n")).collect()  # two rows a margin
    for m in models:
        m.unpersist()
    return Counter({(r["bad"], r["step"]): r["n"] for r in counts})


def misread(word: str, k: int) -> str | None:
    """The word decoded wrongly in the k-th way, None if that is impossible."""
    true, read = TRUE_ENCODINGS[k % len(TRUE_ENCODINGS)], READ_ENCODINGS[k // len(TRUE_ENCODINGS) % len(READ_ENCODINGS)]
    try:
        bad = word.encode(true).decode(read)
    except UnicodeError:
        return None
    return None if any(x.isspace() for x in bad) else bad


def garbled(words: list[str], k: int) -> list[str] | None:
    """The words of a passage decoded wrongly in the k-th way, None if that is impossible or changes nothing."""
    bad = [misread(w, k) for w in words]
    return bad if None not in bad and bad != words else None


def tally(judge: Judge, passages: list[list[str]]) -> Counter:
    """(garbled, number of MARGINS at which it counts as garbled) -> passages, for the passages and all their garbled forms."""
    ways = range(len(TRUE_ENCODINGS) * len(READ_ENCODINGS))
    forms: dict[str, list[str | None]] = {}
    counts: Counter = Counter()
    for words in passages:
        counts[False, bisect.bisect_right(MARGINS, judge.score(words))] += 1
        if len(forms) > 5_000:
            forms.clear()
        for w in words:
            if w not in forms:
                forms[w] = [misread(w, k) for k in ways]
        for bad, n in Counter(zip(*(forms[w] for w in words))).items():
            if None not in bad and list(bad) != words:
                counts[True, bisect.bisect_right(MARGINS, judge.score(list(bad)))] += n
    return counts


def cheapest_margin(counts: Counter) -> float:
    """The margin that best tells clean passages from garbled ones, a false alarm weighing as ALARM_WEIGHT misses."""
    clean, bad = (sum(n for (kind, _), n in counts.items() if kind == k) for k in (False, True))
    if not clean or not bad:
        return LEAST_MARGIN

    def cost(i: int) -> float:
        alarms = sum(n for (kind, step), n in counts.items() if not kind and step > i)
        return ALARM_WEIGHT * alarms / clean + sum(n for (kind, step), n in counts.items() if kind and step <= i) / bad

    return MARGINS[min(range(len(MARGINS)), key=cost)]


def validated_margin(judge: Judge, passages: list[list[str]]) -> float:
    """The margin that best tells clean passages from the same passages garbled in every way."""
    return cheapest_margin(tally(judge, passages))


def likelier(model: Model, word: str, chains: set[str]) -> str:
    """The word with one of the chains of its passage undone, where that makes it likelier at all."""
    ways = [(model.score(out), out) for c in sorted(chains) if (out := undo(word, c)) is not None and out != word]
    best = max(ways, default=None)
    return best[1] if best and best[0] > model.score(word) else word


RESULT = "struct<garbled:boolean,restored:string,chains:array<string>,lost:boolean>"


def repair_encoding(docs: DataFrame, text: str) -> DataFrame:
    """Adds encoding_fix, struct(garbled, restored, chains, lost), to every record.

    garbled: at least one passage was decoded with a wrong encoding. restored is the text with every word restored
    that could be (the text itself where none was garbled), chains are the chains undone, lost tells that characters
    were replaced for good. Null and empty texts are not garbled and stay as they are. Rows are neither dropped nor
    repeated; a column named encoding_fix is replaced. The n-gram model is the only thing that goes to the workers.
    """
    model, margin = train(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((model.grams, margin))

    @F.pandas_udf(RESULT)
    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams, margin = shared.value
        judge = Judge(Model(grams))

        for texts in batches:
            rows = []
            for t in texts:
                if not t or t.isascii():
                    rows.append((False, t, [], False))
                    continue
                chains: list[str] = []

                def swap(m, chains=chains) -> str:
                    passage = m[0]
                    ok = judge.chains(_WORD.findall(passage), margin)
                    if not ok:
                        return passage
                    chains += sorted(ok)

                    def better(m) -> str:
                        g, chain, out = judge.word(m[0])
                        return out if g >= margin and chain in ok else likelier(judge.model, m[0], ok)

                    return _WORD.sub(better, passage)

                out = _PASSAGE.sub(swap, t)
                lost = "�" in out
                rows.append((bool(chains) or lost, out, sorted(set(chains)), lost))
            yield pd.DataFrame(rows, columns=["garbled", "restored", "chains", "lost"])

    keep = [c for c in docs.columns if c.lower() != "encoding_fix"]
    return docs.select(*keep, fix(F.col(text)).alias("encoding_fix"))
