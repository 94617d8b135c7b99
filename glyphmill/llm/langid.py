"""Language identification in two steps: the language family, then one-versus-one linear SVMs within it.

Features are hashed runs of one to three bytes of the text in lower case, with all that is no letter as one space,
over the whole text; their square roots, scaled to length one. Both steps are linear support vector
machines (squared hinge loss, ridge penalty), fitted on the driver to a bounded sample of labelled rows: at
most PER_LANGUAGE of each language, those of least hash of key and text, and at most SAMPLE in all; rows that repeat
with both count once.

Results in odd cases: a null text, or one without a letter, is `und` with score 0; with nothing to learn from,
all texts are; with one language, every other text is that language; rows with null text or label aren't
learnt from; languages that no family lists are families of their own; ties go to the label that sorts
first; repeated rows are predicted alike; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.shared import append_columns, small_batches
from glyphmill.llm.words import mix

UNDETERMINED = "und"
PER_LANGUAGE, SAMPLE = 400, 8000
DIMENSIONS = 1 << 12
#: Parts in which a language's rows are ranked at first.
PARTS = 256

# Languages of each family, by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo is lb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "as bn gu hi mr ne or pa si ur",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu se",
    "sinitic": "zh",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True


def family_of(language: str) -> str:
    return FAMILY.get(language.lower().replace("_", "-").partition("-")[0], language)


def features(data: bytes) -> np.ndarray:
    """Square roots of hashed counts of one to three folded bytes, with length one (or zeros for no bytes)."""
    x = _FOLD[np.frombuffer(b" " + data + b" ", np.uint8)].astype(np.uint32)
    x = x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]
    counts = np.zeros(DIMENSIONS, np.float32)
    for run in (x, x[:-1] << 8 | x[1:] | 1 << 24, x[:-2] << 16 | x[1:-1] << 8 | x[2:] | 2 << 24) if len(x) > 2 else (x,):
        counts += np.bincount(slots(run), minlength=DIMENSIONS)
    counts = np.sqrt(counts)
    return counts / max(np.sqrt(counts @ counts), 1e-9)


def slots(run: np.ndarray) -> np.ndarray:
    return (mix(run.astype(np.uint64)) & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss, by accelerated gradient steps. y: 1 or -1."""
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1 / (2 * 2 * float(weight.sum()) + ridge)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        short = np.maximum(1 - y * (x @ ahead), 0)
        gradient = -2 * ((weight * short * y) @ x) + ridge * ahead
        new = ahead - step * gradient
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


class Model:
    """Families, languages and the machines that tell them apart."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.languages = sorted(set(labels))
        self.families = sorted({family_of(v) for v in self.languages})
        of = np.array([family_of(v) for v in labels])
        labels_ = np.array(labels)
        self.machines = [fit_svm(x, np.where(of == f, 1.0, -1.0).astype(np.float32)) for f in self.families] if len(self.families) > 1 else []
        self.duels = {}
        for f in self.families:
            within = [v for v in self.languages if family_of(v) == f]
            for a, b in combinations(within, 2):
                rows = (labels_ == a) | (labels_ == b)
                self.duels[a, b] = fit_svm(x[rows], np.where(labels_[rows] == a, 1.0, -1.0).astype(np.float32))

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        def sure(margin):
            return 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))

        margins = np.stack([x @ w[:-1] + w[-1] for w in self.machines], 1) if self.machines else np.zeros((len(x), 1))
        duels = {pair: x @ w[:-1] + w[-1] for pair, w in self.duels.items()}
        out = []
        for n in range(len(x)):
            family = self.families[int(margins[n].argmax())] if self.families else None
            within = [v for v in self.languages if family_of(v) == family]
            if not within:
                out.append((UNDETERMINED, 0.0))
                continue
            votes = dict.fromkeys(within, (0, 0.0))
            for a, b in combinations(within, 2):
                m = float(duels[a, b][n])
                for v, gain in ((a, m), (b, -m)):
                    votes[v] = (votes[v][0] + (gain > 0), votes[v][1] + gain)
            best = min(within, key=lambda v: (-votes[v][0], -votes[v][1], v))
            score = float(sure(margins[n].max())) if self.machines else 1.0
            for (a, b), m in duels.items():
                if best in (a, b):
                    score = min(score, float(sure(m[n] if best == a else -m[n])))
            out.append((best, score))
        return out


def fit(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """A model of the rows for which learn holds and text and lang are there; key only orders the sample."""
    rows = df.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull())
    identity = F.xxhash64(F.col(key), F.col(text))
    listed = rows.select(F.col(lang).alias("__lang"), identity.alias("__id")).distinct()
    order = [F.xxhash64("__id"), "__id"]
    for part in (F.pmod("__id", F.lit(PARTS)), F.lit(0)):  # a language's rows are ranked in parts first, then those that are left
        rank = F.row_number().over(Window.partitionBy("__lang", part).orderBy(*order))
        listed = listed.withColumn("__rank", rank).where(F.col("__rank") <= per_language)
    chosen = listed.orderBy("__rank", "__lang").limit(sample).select("__lang", "__id")  # at most `sample` rows
    found = rows.select(F.col(lang).alias("__lang"), identity.alias("__id"), F.col(text).alias("__text"))
    texts = found.join(F.broadcast(chosen), ["__lang", "__id"]).dropDuplicates(["__lang", "__id"])

    def kernel(column):
        made = [features(t.encode("utf-8")) for t in column.to_pylist()]
        used = [np.flatnonzero(f) for f in made]
        ends = np.cumsum([0, *map(len, used)], dtype=np.int32)
        at, value = (np.concatenate(c) if c else np.zeros(0) for c in (used, [f[u] for f, u in zip(made, used, strict=True)]))
        return [pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float32)))]

    fields = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))])
    found = append_columns(texts, ["__text"], fields, kernel).select("__id", "__lang", "at", "value").toArrow().to_pylist()  # at most `sample` rows
    found.sort(key=lambda r: (r["__lang"], r["__id"]))
    x = np.zeros((len(found), DIMENSIONS), np.float32)
    for n, r in enumerate(found):
        x[n, r["at"]] = r["value"]
    return Model(x, [r["__lang"] for r in found])


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred and score (0 to 1: the least certain step's)."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel(column):
        out = []
        texts = column.to_pylist()
        for a in range(0, len(texts), 256):
            some = texts[a : a + 256]
            out += [
                guess if t and has_letter(t) else (UNDETERMINED, 0.0)
                for t, guess in zip(some, shared.value.predict(np.stack([features((t or "").encode("utf-8")) for t in some])), strict=True)
            ]
        return [[v for v, _ in out], [s for _, s in out]]

    return append_columns(df, [text], T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]), kernel)
