"""Operator 1: language identification by error-correcting output codes.

Every language has a codeword of bits.  One binary classifier per bit, linear in
hashed character n-grams, predicts that bit from a text; the language whose
codeword loses least over the bits, each weighted by its classifier's accuracy
on training rows, is chosen.  A text whose two best codewords are close is
flagged as ambiguous.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm.common import few_rows, fold, ship, table, written

UNKNOWN = "und"
#: Rows with a language that the classifiers are fitted on, at most (about).
FIT_ROWS = 12_000
ORDERS = (2, 3)
SLOTS = 1 << 16
#: Smallest gap between the two best mean losses of an unambiguous text.
GAP = 0.1
_LETTER = re.compile(r"[^\W\d_]")
_CHUNK = 1 << 16


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1.  Up to 7 languages: the exhaustive code (every way to
    split them in two, once); above, the best of 200 random codes by the smallest
    distance of two rows."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [[1] + [1 if c >> i & 1 else -1 for i in range(n - 1)] for c in range((1 << (n - 1)) - 1)]
        return np.array(columns, dtype=float).T
    rng, bits = np.random.default_rng(0), max(15, math.ceil(10 * math.log2(n)))
    best, score = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        distance = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * bits
        if distance.min() > score:
            best, score = code, distance.min()
    return best


def _folded(text: str) -> np.ndarray:
    return np.frombuffer((" " + text.lower() + " ").encode("utf-16-le", "surrogatepass"), dtype="<u2")


def _grams(units: np.ndarray, order: int) -> np.ndarray:
    """Slots of all n-grams of one order."""
    n = len(units) - order + 1
    h = np.zeros(n, dtype=np.uint32)
    for i in range(order):
        h = h * np.uint32(0x01000193) ^ units[i : i + n]
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(16)).astype(np.int64) + (order - ORDERS[0]) * SLOTS


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # slots x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def margins(self, text: str) -> np.ndarray:
        """Mean of the n-grams' weights, per bit; the whole text counts."""
        units = _folded(text)
        total, n = np.zeros(self.weights.shape[1]), 0
        for order in ORDERS:
            for at in range(0, len(units) - order + 1, _CHUNK):
                slots = _grams(units[at : at + _CHUNK + order - 1], order)
                total += self.weights[slots].sum(axis=0, dtype=np.float64)
                n += len(slots)
        return total / max(n, 1) + self.bias

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability-like score, ambiguous."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        f = self.margins(text)
        loss = (self.trust * np.logaddexp(0, -4 * self.code * f)).sum(axis=1) / self.trust.sum()
        order = np.argsort(loss, kind="stable")
        p = np.exp(-4 * (loss - loss.min()))
        gap = loss[order[1]] - loss[order[0]] if len(order) > 1 else math.inf
        return self.languages[order[0]], float(p[order[0]] / p.sum()), bool(gap < GAP)


def fit(docs: DataFrame, bound: int = FIT_ROWS) -> Model:
    """Fit on rows of the training folds (crc32(doc_id) mod 3 not 1) with a language.

    With no such row the model knows no language and answers ``und``.
    """
    ship(docs.sparkSession)
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1))
    # Languages are counted over all rows; each is sampled on its own, so a rare one is not lost.
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    each = max(1, bound // max(1, len(languages)))
    if not languages:
        return Model([], codewords(0), np.zeros((0, 1)), np.zeros(1), np.ones(1))
    share = F.coalesce(F.create_map(*[F.lit(y) for x in languages for y in (x, min(1.0, each / sizes[x]))])[F.col("lang")], F.lit(0.0))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < share * (1 << 30)
    sample = written(train.where(drawn).select("text", "lang"), "lang-train")
    index = {x: i for i, x in enumerate(languages)}
    width = SLOTS * len(ORDERS)

    def count(batches):
        total, n = np.zeros((len(languages), width)), np.zeros(len(languages))
        for b in few_rows(batches):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if not _LETTER.search(text):
                    continue
                units = _folded(text)
                slots = np.concatenate([_grams(units, k) for k in ORDERS if len(units) >= k])
                used, times = np.unique(slots, return_counts=True)
                total[index[lang], used] += times / len(slots)  # every text weighs the same
                n[index[lang]] += 1
        for i, x in enumerate(languages):
            used = np.flatnonzero(total[i])
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([used.tolist()], pa.list_(pa.int32())), pa.array([total[i, used].tolist()], pa.list_(pa.float64())), pa.array([n[i]])], ["lang", "slots", "share", "n"])

    share, n = np.zeros((len(languages), width)), np.zeros(len(languages))
    for r in sample.coalesce(8).mapInArrow(count, "lang string, slots array<int>, share array<double>, n double").toLocalIterator():  # at most 8 rows a language
        share[index[r["lang"]], r["slots"]] += r["share"]
        n[index[r["lang"]]] += r["n"]
    profile = share / np.maximum(n, 1)[:, None]
    code = codewords(len(languages))
    weights = np.zeros((width, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]):
        one, zero = profile[code[:, b] > 0].mean(axis=0), profile[code[:, b] < 0].mean(axis=0) if (code[:, b] < 0).any() else 0.0
        smooth = 2e-6
        weights[:, b] = np.clip(np.log((one + smooth) / (zero + smooth)), -4, 4)
    # The bias puts the threshold midway between the languages of the two sides.
    centre = profile @ weights
    bias = np.array([-(centre[code[:, b] > 0, b].min() + centre[code[:, b] < 0, b].max()) / 2 if (code[:, b] < 0).any() else 0.0 for b in range(code.shape[1])])
    model = Model(languages, code, weights, bias, np.ones(code.shape[1]))

    def check(batches):
        right, seen = np.zeros(code.shape[1]), 0
        for b in few_rows(batches):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if _LETTER.search(text):
                    right += np.sign(model.margins(text)) == code[index[lang]]
                    seen += 1
        yield pa.RecordBatch.from_arrays([pa.array([right.tolist()]), pa.array([seen])], ["right", "seen"])

    rows = sample.mapInArrow(check, "right array<double>, seen long").collect()  # a row per task
    seen = max(1, sum(r["seen"] for r in rows))
    accuracy = np.clip(sum(np.array(r["right"]) for r in rows) / seen, 0.5, 0.999)
    model.trust = np.maximum(np.log(accuracy / (1 - accuracy)), 0.01)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every whole text.

    Null texts, empty texts and texts without a letter are ``und`` with score 0 and
    ambiguous.  Of languages with equal loss the first by name is chosen, and the
    text is ambiguous.  Texts of any length are read whole, in chunks.  Repeated
    rows each get a row, an empty table gives an empty result.  Other columns of
    ``docs`` are not used, so their names cannot clash.
    """
    ship(docs.sparkSession)

    def apply(batches):
        for b in few_rows(batches):
            found = [model.decide(t) for t in b.column("text").to_pylist()]
            lang, score, unsure = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
