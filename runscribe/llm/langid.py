"""Language ID by hierarchical discrimination.

A text is a vector of hashed character 1- to 3-grams of its letters (all of them, whatever its length).
One-versus-rest linear support vector machines choose the language family; within a family, one-versus-one
linear support vector machines vote between the closely related languages.  The machines are trained here, each
in a task of its own, on a sample of at most ``per_language`` labelled documents a language; every label is learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import set_aside, stage

DIMENSIONS = 1 << 13
#: Languages by family; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_letter: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed grams of a whole text; None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one blank behind each word
    keep[0] = True
    c = np.where(is_letter, points, 32)[keep].astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    grams = np.concatenate([one, two, three]) >> np.uint32(32 - 13)
    return np.bincount(grams, minlength=DIMENSIONS)


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge linear SVM by accelerated gradient descent; y is +-1.

    The weights stay a sum of rows of ``x``, so the descent runs over one number a row and the rows' inner products.
    """
    centre = x.mean(axis=0)
    x = x - centre
    inner = x @ x.T
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    a, bias, step = np.zeros(len(x)), 0.0, 1 / (4 + penalty)
    at, at_bias, before, before_bias = a, bias, a, bias
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (inner @ at.astype(x.dtype) + at_bias))
        pull = 2 * weight * slack * y
        a, bias = at - step * (penalty * at - pull), at_bias + step * pull.sum()
        ahead = t / (t + 3)
        at, at_bias = a + ahead * (a - before), bias + ahead * (bias - before_bias)
        before, before_bias = a, bias
    w = a @ x
    return np.r_[w, bias - centre @ w]


@dataclass
class LanguageModel:
    """``weights``: one column a machine, the bias last; families first (none if there is one only), then the pairs within them."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIMENSIONS + 1, 0), np.float32))

    @classmethod
    def of(cls, labels: list[str]) -> LanguageModel:
        """The machines that these labels ask for, not yet trained."""
        known = sorted(labels)
        of = {k: FAMILY_OF.get(k, k) for k in known}
        families = sorted(set(of.values()))
        languages = {f: [k for k in known if of[k] == f] for f in families}
        return cls(families, languages, [(a, b) for f in families for i, a in enumerate(languages[f]) for b in languages[f][i + 1 :]])

    def roles(self, per_language: int, rest_rows: int) -> list[tuple[str, int, int, float]]:
        """(language, machine, side, share): which machines a language's sample rows teach, as +1 or -1, and what share of them.

        A family's machine sees all rows of the family and about ``rest_rows`` of the others.
        """
        out, n = [], len(self.families) if len(self.families) > 1 else 0
        others = sum(map(len, self.languages.values()))
        for m, f in enumerate(self.families[:n]):
            share = min(1.0, rest_rows / max(1, per_language * (others - len(self.languages[f]))))
            out += [(k, m, 1 if g == f else -1, 1.0 if g == f else share) for g in self.families for k in self.languages[g]]
        for m, (a, b) in enumerate(self.pairs, n):
            out += [(a, m, 1, 1.0), (b, m, -1, 1.0)]
        return out

    def predict(self, counts: np.ndarray | None) -> tuple[str, float]:
        """(language, score): the score is the lowest of the logistic margins that decided, so it doesn't shrink with their number."""
        if counts is None or not self.families:
            return "und", 0.0
        at = np.flatnonzero(counts)
        margins = np.sqrt(counts[at] / counts.sum()).astype(np.float32) @ self.weights[at] + self.weights[-1]
        least, n = float("inf"), 0
        family = self.families[0]
        if len(self.families) > 1:
            n = len(self.families)
            k = int(np.argmax(margins[:n]))
            family, least = self.families[k], float(margins[k])
        votes = dict.fromkeys(self.languages[family], 0)
        strength = dict.fromkeys(self.languages[family], 0.0)
        sure = {}
        for i, (a, b) in enumerate(self.pairs, n):
            if a in votes and b in votes:
                m = float(margins[i])
                votes[a if m >= 0 else b] += 1
                strength[a], strength[b] = strength[a] + m, strength[b] - m
                sure[a, b] = m
        best = max(votes, key=lambda k: (votes[k], strength[k], k))
        for (a, b), m in sure.items():
            if best in (a, b):
                least = min(least, m if best == a else -m)
        return best, float(1 / (1 + np.exp(-4 * np.clip(least, -20, 20))))


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 3, is 1; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_language: int) -> tuple[DataFrame, list[str]]:
    """(lang, draw, grams) of at most ``per_language`` labelled documents a language that aren't held out, and the labels.

    Documents are drawn by a hash of (doc_id, text), at a rate that gives each language a few more than it needs.
    """
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rates = usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(1.2 * per_language) / F.count("*")).alias("rate"))
    rates = stage(rates.withColumnRenamed("lang", "label"), "langid-rates")  # one row a language
    draw = F.xxhash64("doc_id", "text").bitwiseAND((1 << 40) - 1) / float(1 << 40)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grams = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if (c := gram_counts(text)) is not None:
                    at = np.flatnonzero(c)
                    rows.append(i)
                    grams.append(at.astype("<u4").tobytes() + c[at].astype("<u4").tobytes())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(take), batch.column("draw").take(take), pa.array(grams, pa.binary())], ["lang", "draw", "grams"])

    drawn = usable.withColumn("draw", draw).join(rates, F.col("lang") == F.col("label")).where(F.col("draw") < F.col("rate"))
    drawn = drawn.select("lang", "text", "draw").mapInArrow(run, "lang string, draw double, grams binary")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "grams"))  # about 1.2 * per_language rows a language
    rows = stage(drawn.withColumn("place", place).where(F.col("place") <= per_language).drop("place"), "langid-sample")
    return rows, [r["lang"] for r in rows.select("lang").distinct().collect()]


def fit(docs: DataFrame, per_language: int = 250, rest_rows: int = 2000) -> LanguageModel:
    """A model of the labelled documents that aren't held out.

    A machine is trained in one task, on at most ``per_language`` documents of each language that it tells apart; a
    family's machine sees its own languages and about ``rest_rows`` documents of all others.  Only weights reach the driver.
    """
    rows, labels = sample(docs, per_language)
    model = LanguageModel.of(labels)
    roles = model.roles(per_language, rest_rows)
    if not roles:
        return model

    def train(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "draw", "grams"])
        x = np.zeros((len(rows), DIMENSIONS), np.float32)
        for i, grams in enumerate(rows["grams"]):
            at, c = np.frombuffer(grams, "<u4").reshape(2, -1)
            x[i, at] = np.sqrt(c / c.sum())
        return pd.DataFrame({"machine": [key[0]], "weights": [linear_svm(x, rows["side"].to_numpy(np.float64)).astype("<f4").tobytes()]})

    parts = rows.sparkSession.createDataFrame(roles, "label string, machine int, side int, share double")
    again = F.xxhash64("grams", "machine").bitwiseAND((1 << 40) - 1) / float(1 << 40)
    taught = rows.join(parts, F.col("lang") == F.col("label")).where(again < F.col("share")).select("machine", "side", "lang", "draw", "grams")
    trained = taught.groupBy("machine").applyInPandas(train, "machine int, weights binary").collect()
    model.weights = np.zeros((DIMENSIONS + 1, 1 + max(m for _, m, *_ in roles)), np.float32)
    for r in trained:
        model.weights[:, r["machine"]] = np.frombuffer(r["weights"], "<f4")
    return model


def predictions(rows: DataFrame, model: LanguageModel, text: str) -> DataFrame:
    """``rows`` with lang_pred and score from its column ``text``; no other column is looked at."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(gram_counts(t)) for t in batch.column(text).to_pylist()]
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score, which take the place of own columns of these names.  One pass, no shuffle.

    Only ``text`` decides.  Null text and texts without letters are ``und`` with score 0, as is everything when
    nothing was learned.
    """
    docs = docs.drop("lang_pred", "score")
    named, back = set_aside(docs, text="text")
    return predictions(named, model, "text").select(*back, "lang_pred", "score")


def identify(docs: DataFrame, per_language: int = 250) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document, by a model of the documents that aren't held out.

    A null doc_id isn't held out and isn't learned from; null labels aren't learned; repeated rows are
    predicted alike; an empty table gives no rows; extra columns are ignored.
    """
    model = fit(docs, per_language)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, per_language: int = 250, least: float = 0.02) -> DataFrame:
    """The documents, with their own columns, whose language is found with a score of at least ``least``."""
    model = fit(docs, per_language)
    named, back = set_aside(docs, text="text")
    return predictions(named, model, "text").where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*back)
