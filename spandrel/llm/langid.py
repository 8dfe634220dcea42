"""Language ID by hierarchical discrimination.

The family of a text is predicted first, then one-versus-one linear support
vector machines separate the languages within it. Features are the square roots
of the shares of hashed byte trigrams of the whole lower-cased text, in which
everything in ASCII but letters counts as a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spandrel.llm.common import held_out, small_batches, table

DIMENSIONS = 1 << 12
#: So many different training texts of each language at most, those of the smallest hashes, fit the machines.
SAMPLE = 500
#: Families of ISO 639-1 codes. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is fy lb af yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt am",
    "indo-aryan": "hi ur bn pa mr gu ne",
    "sinitic": "zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"
_CLASS = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint32)


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"own:{lang}")


def features(text: str) -> np.ndarray:
    """Unit vector of the square roots of trigram shares."""
    b = _CLASS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) ^ (b[1:-1] << np.uint32(7))
    x = np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(20), minlength=DIMENSIONS).astype(np.float32)
    return np.sqrt(x / x.sum())


def fit_svm(x: np.ndarray, y: np.ndarray, counts: np.ndarray, cost: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights and bias (last) of a linear SVM with squared hinge loss, y in -1, 1; a row weighs its count, and classes the same."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = counts * np.where(y > 0, 0.5 / max(counts[y > 0].sum(), 1), 0.5 / max(counts[y < 0].sum(), 1))
    w = v = np.zeros(x.shape[1])
    step = 1 / (1 + 4 * cost)
    for k in range(rounds):  # Nesterov's accelerated gradient
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v * 0.01 - 2 * cost * ((weight * y * slack) @ x))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


class Model:
    """Machines between families and, within each family, between its languages."""

    def __init__(self, langs: list[str], x: np.ndarray, counts: np.ndarray) -> None:
        self.families = sorted({family(a) for a in langs})
        self.members = {f: sorted({a for a in langs if family(a) == f}) for f in self.families}
        own, kin = np.array(langs), np.array([family(a) for a in langs])
        self.between = [(a, b, self._machine(x, counts, kin == a, kin == b)) for a, b in combinations(self.families, 2)]
        self.within = {f: [(a, b, self._machine(x, counts, own == a, own == b)) for a, b in combinations(m, 2)] for f, m in self.members.items()}

    @staticmethod
    def _machine(x: np.ndarray, counts: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return fit_svm(np.vstack([x[one], x[other]]), np.concatenate([np.ones(one.sum()), -np.ones(other.sum())]), np.concatenate([counts[one], counts[other]]))

    @staticmethod
    def _vote(names: list[str], machines: list, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the winner's number, and the least certain of its duels (0.5 to 1 where it won them all)."""
        won, sure = np.zeros((len(x), len(names))), np.ones((len(x), len(names)))
        for a, b, w in machines:
            p = 1 / (1 + np.exp(-np.clip(3 * (x @ w[:-1] + w[-1]), -30, 30)))
            i, j = names.index(a), names.index(b)
            won[:, i] += (p >= 0.5) + 1e-3 * p
            won[:, j] += (p < 0.5) + 1e-3 * (1 - p)
            sure[:, i], sure[:, j] = np.minimum(sure[:, i], p), np.minimum(sure[:, j], 1 - p)
        best = won.argmax(1)
        return best, sure[np.arange(len(x)), best]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        kin, sure = self._vote(self.families, self.between, x)
        out, score = [""] * len(x), sure.copy()
        for n, f in enumerate(self.families):
            rows = np.flatnonzero(kin == n)
            if len(rows):
                best, own = self._vote(self.members[f], self.within[f], x[rows])
                for r, k, s in zip(rows, best, own, strict=True):
                    out[r] = self.members[f][k]
                    score[r] *= s
        return out, score


def fit(docs: DataFrame, learn: Column) -> Model | None:
    """A model of the rows where learn holds, with text and lang; None if there are none."""
    usable = docs.select("text", "lang").filter(learn & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = usable.withColumn("hash", F.xxhash64("text"))
    different = hashed.groupBy("lang", "hash").count()
    # Hashes are spread evenly: those of this share of a language's texts hold its smallest, with ten standard deviations to spare.
    share = different.groupBy("lang").agg(((SAMPLE + 10 * SAMPLE**0.5) / F.count("*")).alias("share"))
    near = different.join(F.broadcast(share), "lang").filter(F.col("hash") / 2.0**64 + 0.5 <= F.col("share")).drop("share")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    drawn = near.withColumn("place", place).filter(F.col("place") <= SAMPLE).drop("place")
    texts = hashed.join(F.broadcast(drawn), ["lang", "hash"]).dropDuplicates(["lang", "hash"]).select("lang", "count", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.array([features(t).astype("<f4").tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("count"), rows], ["lang", "count", "x"])

    rows = sorted((r["lang"], bytes(r["x"]), r["count"]) for r in texts.mapInArrow(work, "lang string, count long, x binary").collect())
    if not rows:
        return None
    return Model([a for a, _, _ in rows], np.stack([np.frombuffer(x, "<f4") for _, x, _ in rows]), np.array([n for *_, n in rows], float))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score (0 to 1), from text alone.

    A text that is null or has no letter (of a Unicode category L) is `und` with score 0, as is every text
    if there was nothing to learn from; with one language, it is predicted with
    score 1. Equal texts get equal answers; an empty table gives no rows;
    columns of docs named lang_pred or score are replaced.
    """
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*others).schema.add("lang_pred", "string").add("score", "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = b.column("text").to_pylist()
                known = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if known:
                    for i, lang, score in zip(known, *model.predict(np.stack([features(texts[i]) for i in known])), strict=True):
                        langs[i], scores[i] = lang, float(score)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*others, "lang_pred", "score"])

    return small_batches(docs).select(*others).mapInArrow(work, schema)


def op2_hierarchical_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(docs.withColumn("learn", ~held_out("doc_id", 3, 1)).filter("learn"), F.lit(True)))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
