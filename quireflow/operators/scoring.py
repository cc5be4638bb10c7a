"""Scores of texts, words, lines, patterns and images, and document typing by keywords."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labels with a learned example at most; their examples go to the workers.
MOST_LABELS = 10_000
#: Letter frequencies of English, common words, keyword families and validators.
LETTERS = {
    "e": 0.1202, "t": 0.091, "a": 0.0812, "o": 0.0768, "i": 0.0731, "n": 0.0695, "s": 0.0628, "h": 0.0592, "r": 0.0592, "d": 0.0432, "l": 0.0398, "c": 0.0271, "u": 0.0288, "m": 0.0261, "w": 0.0209,
    "f": 0.023, "g": 0.0203, "y": 0.0211, "p": 0.0182, "b": 0.0149, "v": 0.0111, "k": 0.0069, "j": 0.001, "x": 0.0017, "q": 0.0011, "z": 0.0007,
}
COMMON = (
    "a about above address after again all amount an and any at before below both but by can date during each email few for form from further here how in into just more most name no nor not now number "
    "of off on once only or other out own phone same should so some such than the then there through time to too total up very when where why will with year"
).split()
FAMILIES = {
    "government": "form irs tax federal state department bureau agency government treasury revenue return schedule",
    "financial": "amount total balance payment invoice bill credit debit transaction account bank interest fee charge",
    "legal": "deed property legal agreement contract party whereas covenant easement title estate plaintiff defendant",
    "medical": "patient diagnosis treatment doctor medical health prescription medication hospital clinic symptoms",
    "correspondence": "dear sincerely regards subject re: memo to: from: date: cc: attachment enclosed",
}
VALIDATORS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", "phone": r"^\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$", "date": r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$",
    "currency": r"^\$?\d{1,3}(?:,\d{3})*(?:\.\d{2})?$", "ssn": r"^\d{3}-\d{2}-\d{4}$", "zip": r"^\d{5}(?:-\d{4})?$",
}
#: Words a document of a type has, and the weights of the scores.
TYPE_WORDS = {
    "invoice": "invoice bill amount total due", "form": "form name date signature address", "receipt": "receipt paid change transaction", "letter": "dear sincerely regards letter", "report": "report analysis conclusion findings",
}
WEIGHTS = {"engine_confidence": 0.3, "text_quality": 0.25, "word_level_confidence": 0.2, "pattern_validation_score": 0.15, "structural_consistency": 0.1}
MALFORMED = (r"[a-zA-Z0-9._%+-]+[@.][a-zA-Z0-9.-]*", r"\d{3}[^\d\s]\d{3}[^\d\s]\d{4}", r"\d{1,2}[^\d\s]\d{1,2}[^\d\s]\d{2,4}")
IMAGE_WEIGHTS = {"blur": (0.25, 0.5), "noise": (0.2, 0.5), "contrast": (0.2, 0.5), "resolution": (0.15, 0.5), "skew": (0.1, 1.0), "text": (0.1, 0.5)}


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def length_score(text: Column) -> Column:
    n = F.length(F.trim(text))
    return F.when(n == 0, 0.0).when(n < 10, 0.3).when(n < 50, 0.6).when(n < 200, 0.8).otherwise(0.9)


_COMMON = frozenset(COMMON)
_LATIN = re.compile("[^a-z]")
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


def distribution(text: str) -> float:
    """Mean closeness of the letter frequencies to English, 0.5 without letters; other letters count in the total."""
    total = sum(map(str.isalpha, text))
    if not total:
        return 0.5
    low = text.lower()
    return sum(max(0.0, 1 - 10 * abs(low.count(c) / total - f)) for c, f in sorted(LETTERS.items())) / 26


def readability(text: str) -> float:
    """Mean of the share of common words, 1 or 0.5 for usual word lengths, and 1 or 0.7 for mixed case; 0 without words."""
    words = [w for w in _BLANKS.split(text) if w]
    if not words:
        return 0.0
    known = sum(_LATIN.sub("", w) in _COMMON for w in map(str.lower, words)) / len(words)
    mean = sum(map(len, words)) / len(words)
    return (known + (1.0 if 2 <= mean <= 8 else 0.5) + (1.0 if text.lower() != text and text.upper() != text else 0.7)) / 3


def consistency_score(text: Column) -> Column:
    """Mean of 1 or 0.5 for usual punctuation and a falling score for special characters."""
    n = F.length(text)
    punct = F.length(F.regexp_replace(text, r"[^.,;:!?]+", "")) / n
    special = F.length(F.regexp_replace(text, r"[a-zA-Z0-9\s.,;:!?\-()]+", "")) / n
    return F.when(n == 0, 0.0).otherwise((F.when(punct <= 0.3, 1.0).otherwise(0.5) + F.when(special < 0.1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - 5 * special))) / 2)


def text_scores(df: DataFrame, text: str, key: str) -> DataFrame:
    """key and the four scores of every text that is not null; letters and words are counted in one Arrow pass."""

    @F.pandas_udf("distribution double, readability double")
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"distribution": [distribution(t) for t in texts], "readability": [readability(t) for t in texts]})

    t = F.col(text)
    scored = df.filter(t.isNotNull()).select(key, length_score(t).alias("length_score"), consistency_score(t).alias("consistency_score"), counted(t).alias("c"))
    return scored.select(key, "length_score", F.col("c.distribution").alias("distribution_score"), F.col("c.readability").alias("readability_score"), "consistency_score")


def formatting_scores(df: DataFrame, text: str, key: str) -> DataFrame:
    """1 - deviation / mean of the lengths of the non-blank lines, not below 0, and whether blanks are 10 to 30 %."""
    t = F.col(text)
    lengths = F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.length(F.trim(x))), lambda n: n > 0)
    sums = F.aggregate(lengths, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, n: F.struct((a["s"] + n).alias("s"), (a["q"] + n * n).alias("q")))
    blanks = (F.length(t) - F.length(F.translate(t, " ", ""))) / F.length(t)
    g = df.filter(t.isNotNull()).select(key, F.size(lengths).alias("k"), sums.alias("a"), F.when(blanks.between(0.1, 0.3), 1.0).otherwise(0.7).alias("spacing")).filter("k > 0")
    mean = F.col("a.s") / F.col("k")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("a.q") / F.col("k") - mean * mean))
    return g.select(key, F.greatest(F.lit(0.0), 1 - deviation / mean).alias("line_consistency"), "spacing")


def word_scores(readings: DataFrame) -> DataFrame:
    """Mean confidence, share of valid words and 1 - deviation of a reading's words."""
    w = readings.select("result_id", F.explode("words").alias("t")).select("result_id", F.col("t.confidence").alias("c"), F.col("t.text").alias("w"))
    plain = F.regexp_replace(F.lower("w"), "[^a-z]", "")
    valid = plain.isin(COMMON) | (F.length(plain) >= 2) | F.regexp_replace("w", r"[,.$]", "").rlike(r"^\d+$")
    return w.groupBy("result_id").agg(F.count("*").alias("words"), F.avg("c").alias("mean_confidence"), F.avg(valid.cast("int")).alias("valid_share"), (1 - F.stddev_pop("c")).alias("steadiness"))


def malformed_score(text: Column) -> Column:
    """0.4 for texts with anything like a broken address, phone number or date, else 0.7."""
    return F.when(functools.reduce(lambda a, b: a | b, [text.rlike(p) for p in MALFORMED]), 0.4).otherwise(0.7)


def pattern_score(text: Column) -> Column:
    """0.9 for a text that is as a whole a valid value, else by whether it has malformed ones."""
    whole = functools.reduce(lambda a, b: a | b, [text.rlike(p) for p in VALIDATORS.values()])
    return F.when(whole, 0.9).otherwise(malformed_score(text))


def line_scores(readings: DataFrame) -> DataFrame:
    """result_id, line_confidence and line_consistency (1 - deviation, 1 for a single line) of a reading's lines."""
    lines = readings.select("result_id", F.explode("lines").alias("t")).select("result_id", F.col("t.confidence").alias("c")).filter("c is not null")
    return lines.groupBy("result_id").agg(F.avg("c").alias("line_confidence"), (1 - F.stddev_pop("c")).alias("line_consistency"))


def structure_scores(readings: DataFrame) -> DataFrame:
    """result_id, word_count_consistency of words and text, and bbox_consistency, the share of words with a box."""
    n = F.size(tokens(F.coalesce("text", F.lit(""))))
    words = F.coalesce(F.size("words"), F.lit(-1))
    have = F.greatest(words, F.lit(0))
    boxed = F.size(F.filter("words", lambda t: t["bbox"].isNotNull()))
    return readings.select(
        "result_id", F.when(n > 0, F.greatest(F.lit(0.0), 1 - F.abs(have - n) / n)).otherwise(0.0).alias("word_count_consistency"), F.when(have > 0, boxed / have).alias("bbox_consistency"),
    )


def type_consistency(text: Column, expected: Column) -> Column:
    """Share of the keywords of the expected type that a text has; 0.7 for other types, 0.5 without a text."""
    out = F.lit(0.7)
    for kind, words in TYPE_WORDS.items():
        ws = words.split()
        share = functools.reduce(lambda a, b: a + b, [F.lower(text).contains(w).cast("int") for w in ws]) / len(ws)
        out = F.when(F.lower(expected) == kind, share).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) == "", 0.5).otherwise(out)


def field_consistency(text: Column, expected: list[str]) -> Column:
    """Share of the expected fields a text names; 1 if none is expected, 0 without a text."""
    if not expected:
        return F.lit(1.0)
    share = functools.reduce(lambda a, b: a + b, [F.lower(text).contains(f.lower()).cast("int") for f in expected]) / len(expected)
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(share)


def comprehensive(scores: dict[str, Column]) -> Column:
    """Weighted mean of the scores that are known; those of consistency besides share a weight of 0.1."""
    extra = [k for k in scores if "consistency" in k and k not in WEIGHTS]
    known = functools.reduce(lambda a, b: a + b, [scores[k].isNotNull().cast("int") for k in extra], F.lit(0))
    pairs = {k: (scores[k], F.lit(w)) for k, w in WEIGHTS.items() if k in scores} | {k: (scores[k], F.when(known > 0, 0.1 / known)) for k in extra}
    top = functools.reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for c, w in pairs.values()])
    low = functools.reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in pairs.values()])
    return F.when(low > 0, top / low).otherwise(0.0)


def validate(value: Column, kind: Column) -> Column:
    """0.95 where a value fits its kind's whole pattern, 0.1 where not, 0 for unknown kinds."""
    out = F.lit(0.0)
    for k, p in VALIDATORS.items():
        out = F.when(kind == k, F.when(F.trim(value).rlike(p), 0.95).otherwise(0.1)).otherwise(out)
    return out


def overall(scores: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the scores that are not null, null if all are."""
    top = functools.reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for c, w in scores.values()])
    low = functools.reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in scores.values()])
    return F.when(low > 0, top / low)


def keyword_signatures(df: DataFrame, text: str, key: str) -> DataFrame:
    """key, family, score: (exact hits + half the partial ones) / (root of words * root of keywords), at most 1.

    A word that contains a keyword without being it is a partial hit of it. What a word scores is kept by word, so that
    a text is one look-up a word.
    """
    families = [(f, ks.split()) for f, ks in FAMILIES.items()]

    @F.pandas_udf("array<double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, tuple[float, ...] | None] = {}

        def hits(w: str) -> tuple[float, ...] | None:
            if w not in memo:
                if len(memo) > 300_000:
                    memo.clear()
                h = tuple(1.0 * (w in ks) + 0.5 * sum(k in w and k != w for k in ks) for _, ks in families)
                memo[w] = h if any(h) else None
            return memo[w]

        for texts in batches:
            out = []
            for t in texts:
                words = [w for w in _BLANKS.split(t.lower()) if w]
                sums = [0.0] * len(families)
                for h in filter(None, map(hits, words)):
                    sums = [a + b for a, b in zip(sums, h)]
                root = math.sqrt(len(words))
                out.append([min(1.0, s / (root * math.sqrt(len(ks)))) if words else 0.0 for s, (_, ks) in zip(sums, families)])
            yield pd.Series(out)

    names = F.array(*[F.lit(f) for f, _ in families])
    rows = df.filter(F.col(text).isNotNull()).select(key, F.explode(F.arrays_zip(names.alias("family"), scored(F.col(text)).alias("score"))).alias("s"))
    return rows.select(key, "s.family", "s.score")


def best_guess(candidates: DataFrame) -> DataFrame:
    """The best type of every document: the first by confidence, unless a learned one reaches 0.9 of it.

    candidates has doc, type, confidence and source (discovered or learned); ties go to the smaller type.
    """
    order = Window.partitionBy("doc").orderBy(F.desc(F.round("confidence", 9)), "type")
    ranked = candidates.withColumn("r", F.row_number().over(order)).withColumn("top", F.first("confidence").over(order))
    learned = F.when((F.col("source") == "learned") & (F.col("confidence") > 0.9 * F.col("top")), F.col("r"))
    g = ranked.withColumn("l", learned).groupBy("doc").agg(F.min("l").alias("l"), F.collect_list(F.struct("r", "type")).alias("all"))
    pick = F.filter("all", lambda x: x["r"] == F.coalesce(F.col("l"), F.lit(1)))
    return g.select("doc", F.coalesce(pick[0]["type"], F.lit("unknown_document")).alias("best_type"))


def learned_similarity(vectors: DataFrame) -> DataFrame:
    """Cosine of every vector with the first example of each label: vec_id, label, similarity.

    Every vector meets every label, as the problem asks; the examples are one row a label and go to the workers as
    one array, of at most MOST_LABELS rows.
    """
    first = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("example"))
    examples = first.limit(MOST_LABELS + 1).collect()
    if len(examples) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    names = [r["label"] for r in examples]
    matrix = np.array([r["example"] for r in examples], dtype=float).reshape(len(names), -1)
    matrix = matrix / np.sqrt((matrix**2).sum(axis=1, keepdims=True))

    @F.pandas_udf("array<double>")
    def cosines(batch: pd.Series) -> pd.Series:
        v = np.stack(batch.to_numpy()).astype(float)
        return pd.Series(list((v @ matrix.T) / np.sqrt((v**2).sum(axis=1, keepdims=True))))

    kind = dict(vectors.dtypes)["label"]
    labels = F.array(*[F.lit(n) for n in names]).cast(f"array<{kind}>")
    zipped = F.explode(F.arrays_zip(labels.alias("learned"), cosines("embedding").alias("similarity")))
    return vectors.filter("embedding is not null").select("vec_id", zipped.alias("s")).select("vec_id", "s.learned", "s.similarity")


# Images: arrays of grey values, for use inside an Arrow function over binaryFile rows


def blur_score(image: np.ndarray) -> tuple[float, bool, float]:
    """Variance of the Laplacian, whether it is blurry (below 100), and the score, variance / 500 up to 1."""
    g = np.pad(image.astype(float), 1, mode="reflect")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    v = float(lap.var())
    return v, v < 100, min(v / 500, 1.0)


def contrast_score(image: np.ndarray) -> tuple[float, float, float, bool, float]:
    """Deviation, Michelson contrast, entropy, whether it is low, and the score, deviation / 64 up to 1."""
    g = image.astype(float)
    lo, hi = float(g.min()), float(g.max())
    p = np.bincount(image.astype(np.uint8).ravel(), minlength=256) / image.size
    p = p[p > 0]
    s = float(g.std())
    return s, (hi - lo) / (hi + lo) if hi + lo else 0.0, float(-(p * np.log2(p)).sum()), s < 0.3 * 255, min(s / 64, 1.0)


def dpi_category(width: Column, height: Column) -> Column:
    dpi = (width / 8.5 + height / 11) / 2
    return F.when(dpi < 150, "low").when(dpi < 300, "medium").otherwise("high")


def image_quality(metrics: dict[str, Column]) -> Column:
    """Weighted mean of the image metrics; missing ones count as 0.5, a missing skew as 1."""
    return functools.reduce(lambda a, b: a + b, [F.coalesce(metrics.get(k, F.lit(None).cast("double")), F.lit(d)) * w for k, (w, d) in IMAGE_WEIGHTS.items()])


def noise_score(image: np.ndarray) -> tuple[float, bool, float]:
    """Deviation of the image from its median of 5 by 5, whether it is noisy (above a tenth of the range), and the score."""
    g = np.pad(image.astype(float), 2, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(g, (5, 5)).reshape(*image.shape, 25)
    d = float((image - np.median(windows, axis=-1)).std())
    return d, d > 0.1 * 255, max(0.0, 1 - d / 50)


def image_metrics(images: DataFrame, decode) -> DataFrame:
    """path, blur, noise, contrast, width, height of binaryFile rows; decode gives the grey values of a file's bytes.

    Files that can't be decoded give null metrics.
    """

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    g = decode(bytes(content))
                    rows.append((path, blur_score(g)[2], noise_score(g)[2], contrast_score(g)[4], float(g.shape[1]), float(g.shape[0])))
                except Exception:
                    rows.append((path, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "blur", "noise", "contrast", "width", "height"])

    return images.select("path", "content").mapInPandas(measured, "path string, blur double, noise double, contrast double, width double, height double")


def image_advice(blurry: Column, noisy: Column, flat: Column, dpi: Column, skew: Column, text: Column, quality: Column) -> Column:
    """struct(recommendations, steps, settings, engines) from what is known of an image; null flags count as good."""
    kept = lambda *flags: F.filter(F.array(*[F.when(c, F.lit(v) if isinstance(v, str) else v) for c, v in flags]), lambda x: x.isNotNull())
    low, skewed = dpi < 150, F.abs(skew) > 2
    advice = kept(
        (blurry, "Image appears blurry. Consider rescanning at higher quality."), (noisy, "High noise detected. Apply noise reduction preprocessing."),
        (flat, "Low contrast detected. Consider histogram equalization or gamma correction."),
        (low, F.format_string("Resolution too low for optimal OCR. Current: ~%.0f DPI, Recommended: ≥150 DPI", dpi)),
        (skewed, F.format_string("Document skew detected (%.1f°). Consider deskewing preprocessing.", skew)), (text < 0.5, "Poor text quality detected. Check for proper binarization and text clarity."),
    )
    steps = kept((noisy, "noise_reduction"), (flat, "contrast_enhancement"), (skewed, "deskewing"))
    settings = kept((blurry, "enable_image_sharpening"), (low, "use_conservative_settings"), (dpi >= 300, "use_aggressive_settings"))
    engines = F.when(quality > 0.8, "tesseract,surya,trocr,easyocr").when(quality > 0.6, "trocr,surya,tesseract,easyocr").otherwise("trocr,easyocr,surya,tesseract")
    return F.struct(advice.alias("recommendations"), steps.alias("steps"), settings.alias("settings"), engines.alias("engines"))
