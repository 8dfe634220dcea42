"""Toxicity by weak supervision.

Voters read a whole text: a fixed lexicon, lexicons learned from labelled rows
(of words, word beginnings and endings, and of beginnings that two different
words of a text share) and patterns (shouting, exclamation, and so on). Learned
lexicons are cross-fitted: each is learned twice, from one half of the labelled
rows each, and abstains on the half it was learned from. Some are weak on
purpose. A generative label model is fitted by expectation-maximisation to the
counts of vote patterns over all rows it may learn from: it estimates each
voter's accuracy, and correlations between voters as a tree in which a voter
depends on the class and on one other voter (Chow & Liu 1968). The posterior
labels of these patterns train the final linear classifier.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.common import forget, held_out, small_batches, small_enough, table, written

#: A general list of insults.
SEED = frozenset("idiot idiots moron morons stupid pathetic worthless scum trash disgusting loser losers clown dumb imbecile filth vermin freak creep hate idiota imbécil estúpido basura dummkopf abschaum widerlich ordure crétin débile".split())
#: Parts of a word that the learned lexicons look at: whole words, beginnings and endings of so many letters, and beginnings that two words share.
PARTS = (("word", 0), ("begin", 4), ("begin", 5), ("begin", 6), ("end", 5), ("twice", 5), ("twice", 6), ("twice", 7))
KINDS = tuple(f"{kind}{n or ''}" for kind, n in PARTS)
_TWICE = tuple(kind == "twice" for kind, _ in PARTS)
#: A part is learned from a half if it is in so many of its toxic texts, and at least this share of the half's labelled texts with it is toxic.
SUPPORT, PRECISION, PRECISION_TWICE = 7, 0.97, 0.75
#: Most parts of the learned lexicons held in memory (those in the most toxic texts; a join looks up the rest), and most labels that are broadcast.
LEXICON, BROADCAST_LABELS = 50_000, 2_000_000
#: Bits of the map of hashed parts.
BITS = 1 << 24
#: Training texts of the final classifier: those of the smallest hashes.
SAMPLE = 10_000
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 300_000
VOTERS = ("seed", *(f"{kind} {half}" for kind in KINDS for half in "ab"), "dense", "shout", "exclaim", "second")
_SECOND = frozenset("you your yourself tu toi vous votre te ti usted du dich dir ihr euch".split())


def parts(word: str) -> list[tuple[str, str]]:
    """The parts (kind, part) of a lower-case word that lexicons may hold."""
    found = [("word", word)]
    for name, (kind, n) in zip(KINDS[1:], PARTS[1:], strict=True):
        if len(word) > n:
            found.append((name, word[-n:] if kind == "end" else word[:n]))
    return found


def _batches(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for at in range(0, b.num_rows, 500):
        part = b.slice(at, 500)
        yield part, [t or "" for t in part.column("text").to_pylist()]


def _key(kind: str, part: str) -> bytes:
    return f"{kind} {part}".encode()


def _bitmap(lexicon: DataFrame) -> bytes:
    """A bit per hash of the rows (kind, part); of one size whatever their number."""
    hashed = F.crc32(F.concat_ws(" ", "kind", "part").cast("binary")) % BITS + 1  # the functions count from 1
    rows = lexicon.select(hashed.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    bits = bytearray(BITS // 8)
    for r in rows:
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    return bytes(bits)


class _Parts(dict):
    """Lower-case word -> its parts, or those whose bit in a bitmap is set; kept up to a bound."""

    def __init__(self, bits: bytes | None) -> None:
        super().__init__()
        self._bits = bits

    def __missing__(self, word: str) -> list[tuple[str, str]]:
        found = parts(word)
        if self._bits is not None:
            hashes = [zlib.crc32(_key(*p)) % BITS for p in found]
            found = [p for p, h in zip(found, hashes, strict=True) if self._bits[h >> 3] >> (h & 7) & 1]
        if len(self) > _CACHE:
            self.clear()
        self[word] = found
        return found


def _of_text(text: str, of: _Parts) -> dict[tuple[str, str], int]:
    """Per part of a text, how many different words have it; of the kinds that take two, those with two."""
    found = Counter(p for w in set(_WORD.findall(text.lower())) for p in of[w])
    return {p: n for p, n in found.items() if n > 1 or not p[0].startswith("twice")}


def _counted(texts: DataFrame, bits: bytes | None) -> DataFrame:
    """(kind, part, a, b): in how many texts of each half a part is; of all parts, or of those whose bit is set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = (Counter(), Counter()), _Parts(bits)

        def flush() -> pa.RecordBatch:
            keys = list(held[0].keys() | held[1].keys())
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)] + [pa.array([h[k] for k in keys], pa.int64()) for h in held]
            for h in held:
                h.clear()
            return pa.RecordBatch.from_arrays(columns, ["kind", "part", "a", "b"])

        for b in batches:
            for part, texts in _batches(b):
                for text, half in zip(texts, part.column("half").to_pylist(), strict=True):
                    held[half].update(_of_text(text, of).keys())
                if len(held[0]) + len(held[1]) > 500_000:
                    yield flush()
        yield flush()

    return texts.select("half", "text").mapInArrow(work, "kind string, part string, a long, b long").groupBy("kind", "part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def learn_lexicon(labelled: DataFrame) -> tuple[dict[str, dict[str, int]], DataFrame | None]:
    """Per kind of part, those that mark toxic texts, from rows (text, toxic, half 0 or 1); and a table of those beyond LEXICON.

    A part comes with the halves it was learned from: 1, 2, or 3 for both. Every
    part with the support is judged, over all rows. The bitmap only spares
    counting parts of clean texts that can't be candidates.
    """
    often = written(_counted(labelled.filter("toxic = 1"), None).filter((F.col("a") >= SUPPORT) | (F.col("b") >= SUPPORT)), "often")
    clean = _counted(labelled.filter("toxic = 0"), _bitmap(often)).select("kind", "part", F.col("a").alias("clean_a"), F.col("b").alias("clean_b"))
    least = F.when(F.col("kind").startswith("twice"), PRECISION_TWICE).otherwise(PRECISION)
    marks = lambda h: (F.col(h) >= SUPPORT) & (F.col(h) >= least * (F.col(h) + F.coalesce(f"clean_{h}", F.lit(0))))
    halves = F.when(marks("a"), 1).otherwise(0) + F.when(marks("b"), 2).otherwise(0)
    passed = written(often.join(clean, ["kind", "part"], "left").select("kind", "part", (F.col("a") + F.col("b")).alias("n"), halves.alias("halves")).filter("halves > 0"), "lexicon")
    forget(often)
    first = passed.orderBy(F.desc("n"), "kind", "part").limit(LEXICON).collect()
    held: dict[str, dict[str, int]] = {}
    for r in first:
        held.setdefault(r["kind"], {})[r["part"]] = r["halves"]
    rest = None
    if len(first) == LEXICON:
        place = lambda n, kind, part: F.struct((-n).alias("n"), kind.alias("kind"), part.alias("part"))
        last = place(F.lit(first[-1]["n"]), F.lit(first[-1]["kind"]), F.lit(first[-1]["part"]))
        rest = passed.filter(place(F.col("n"), F.col("kind"), F.col("part")) > last).select("kind", "part", "halves")
    return held, rest


def _rare_hits(docs: DataFrame, rest: DataFrame) -> DataFrame:
    """(key, rare): per hash of a text, how many of its words each learned lexicon's table of the rest holds, by kind and half."""
    bits = _bitmap(rest)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Parts(bits)
        for b in batches:
            for part, texts in _batches(b):
                rows = [(key, k, p, n) for key, text in zip(part.column("key").to_pylist(), texts, strict=True) for (k, p), n in _of_text(text, of).items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["key", "kind", "part", "n"])

    found = docs.select("key", "text").mapInArrow(work, "key string, kind string, part string, n long").join(rest, ["kind", "part"])
    once = found.groupBy("key", "kind", "part", "halves").agg(F.max("n").alias("n"))  # equal texts count equally
    of_kind = [F.sum(F.when((F.col("kind") == k) & (F.col("halves").bitwiseAND(h) > 0), F.col("n")).otherwise(0)) for k in KINDS for h in (1, 2)]
    return once.groupBy("key").agg(F.array(*of_kind).alias("rare"))


class _Hits(dict):
    """Word (as written) -> None, or (the word in lower case, whether it is in the fixed lexicon, shouts, is a second person, its learned parts (kind's number, part, halves)); kept up to a bound."""

    def __init__(self, lexicon: dict[str, dict[str, int]]) -> None:
        super().__init__()
        self._lexicon = lexicon

    def __missing__(self, word: str) -> tuple | None:
        low = word.lower()
        learned = tuple((KINDS.index(k), p, self._lexicon[k][p]) for k, p in parts(low) if p in self._lexicon.get(k, ()))
        flags = low in SEED, len(word) > 2 and word.isupper(), low in _SECOND
        if len(self) > _CACHE:
            self.clear()
        self[word] = found = (low, *flags, learned) if learned or any(flags) else None
        return found


def _features(text: str, hits: _Hits, half: int | None, rare: list[int] | None) -> tuple[list[float], list[int]]:
    """Features of the final classifier, and the voters' votes (1, -1, or 0 for none).

    half: that of the text if it is labelled, whose lexicons abstain; rare: the
    learned lexicons' hits not in hits.
    """
    words = _WORD.findall(text)
    seed = shouts = second = 0
    n = [[0, 0] for _ in KINDS]
    shared: dict[tuple[int, str, int], set[str]] = {}
    for (low, in_seed, shout, person, learned), c in Counter(filter(None, map(hits.__getitem__, words))).items():
        seed, shouts, second = seed + c * in_seed, shouts + c * shout, second + c * person
        for k, part, halves in learned:
            if _TWICE[k]:
                shared.setdefault((k, part, halves), set()).add(low)
            else:
                for h in (0, 1):
                    n[k][h] += c * (halves >> h & 1)
    for (k, _, halves), of in shared.items():
        if len(of) > 1:
            for h in (0, 1):
                n[k][h] += len(of) * (halves >> h & 1)
    for i, c in enumerate(rare or ()):
        n[i // 2][i % 2] += c
    allowed = [h for h in (0, 1) if h != half]
    size = max(len(words), 1)
    mean = [sum(x[h] for h in allowed) / len(allowed) for x in n]
    most = max(seed, *mean)
    rates = shouts / size, text.count("!") / size, second / size
    votes = [1 if seed else -1] + [(1 if x[h] else -1) if h in allowed else 0 for x in n for h in (0, 1)]
    votes += [1 if most / size > 0.01 and most > 1 else -1 if not most else 0]
    votes += [1 if rates[0] > 0.5 and size > 5 else 0, 1 if rates[1] > 0.3 else 0, 1 if rates[2] > 0.05 and size > 5 else 0]
    values = [float(seed > 0)] + [sum(x[h] > 0 for h in allowed) / len(allowed) for x in n] + [float(np.log1p(x)) for x in (seed, *mean)] + [min(1.0, 20 * most / size)] + [min(x, 1.0) for x in rates]
    return values, votes


def voted(docs: DataFrame, lexicon: dict[str, dict[str, int]], rest: DataFrame | None = None) -> DataFrame:
    """The columns of docs (text, half, ...) but text, with x (features) and votes; rest are parts (kind, part, halves) that lexicon lacks."""
    others = [c for c in docs.columns if c != "text"]
    schema = docs.select(*others).schema.add("x", T.ArrayType(T.FloatType())).add("votes", T.ArrayType(T.IntegerType()))
    docs = docs.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256)) if rest is not None else docs.withColumn("rare", F.lit(None).cast("array<long>"))
    if rest is not None:
        docs = docs.join(_rare_hits(docs, rest), "key", "left").drop("key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(lexicon)
        for b in batches:
            for part, texts in _batches(b):
                both = [_features(t, hits, h, r) for t, h, r in zip(texts, part.column("half").to_pylist(), part.column("rare").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array([x for x, _ in both], pa.list_(pa.float32())), pa.array([v for _, v in both], pa.list_(pa.int32()))], [*others, "x", "votes"])

    return docs.select(*others, "text", "rare").mapInArrow(work, schema)


class LabelModel:
    """P(class) and, per voter, P(vote | class, vote of its parent), fitted by EM to counted vote patterns.

    gold is a label where one is known, else -1; a known label fixes the class.
    """

    def __init__(self, votes: np.ndarray, gold: np.ndarray, counts: np.ndarray, rounds: int = 30) -> None:
        v, self.share = votes + 1, 0.1
        ones = [v[:, j] == 2 for j in range(v.shape[1])]
        lean = np.mean(np.where(votes > 0, 1.0, np.where(votes < 0, 0.0, 0.1)), 1)
        p = np.where(gold >= 0, gold, lean)
        # Labels of both classes begin the first round alone; without them, the mean of the votes does.
        begin = counts * (gold >= 0) if {0, 1} <= set(gold.tolist()) else counts
        for k in range(rounds):
            n = begin if k == 0 else counts
            w = np.stack([n * (1 - p), n * p], 1)
            self.share = (w[:, 1].sum() + 1) / (w.sum() + 2)
            self.parents = self._tree(ones, w)
            self.tables = []
            for j, up in enumerate(self.parents):
                t = np.full((2, 3, 3), 0.5)
                for y in (0, 1):
                    np.add.at(t[y], (v[:, up] if up >= 0 else np.zeros(len(v), int), v[:, j]), w[:, y])
                self.tables.append(t / t.sum(2, keepdims=True))
            p = np.where(gold >= 0, gold, self.posterior(votes))

    @staticmethod
    def _tree(ones: list[np.ndarray], w: np.ndarray) -> list[int]:
        """Each voter's parent (-1: none) in the tree of the largest mutual information given the class."""
        k, info = len(ones), {}
        for a in range(k):
            for b in range(a):
                total = 0.0
                for y in (0, 1):
                    n = max(w[:, y].sum(), 1e-9)
                    for s in (True, False):
                        for t in (True, False):
                            both = w[(ones[a] == s) & (ones[b] == t), y].sum() / n
                            alone = w[ones[a] == s, y].sum() / n * w[ones[b] == t, y].sum() / n
                            total += n / max(w.sum(), 1e-9) * (both * np.log(both / alone) if both > 0 and alone > 0 else 0.0)
                info[a, b] = info[b, a] = total
        parents, seen = [-1] * k, [0]
        while len(seen) < k:
            a, b = max(((a, b) for a in seen for b in range(k) if b not in seen), key=lambda ab: (info[ab], -ab[0], -ab[1]))
            parents[b] = a
            seen.append(b)
        return parents

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = votes + 1
        odds = np.full(len(v), np.log(self.share / (1 - self.share)))
        for j, (up, t) in enumerate(zip(self.parents, self.tables, strict=True)):
            above = v[:, up] if up >= 0 else np.zeros(len(v), int)
            odds += np.log(t[1][above, v[:, j]] / t[0][above, v[:, j]])
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit_linear(x: np.ndarray, p: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Bias and weights of a logistic regression on soft labels p."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = v = np.zeros(x.shape[1])
    step = 4 / max((x**2).sum(1).mean(), 1)
    for k in range(rounds):
        new = v - step * (x.T @ (1 / (1 + np.exp(-np.clip(x @ v, -40, 40))) - p) / len(x) + 1e-4 * v)
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def score(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """docs (doc_id, text, ...) but text, with score (0 to 1); labels (doc_id, toxic) count where learn holds.

    A null text is empty; empty texts get the score of a text without hits. A
    null label, or a label of a null doc_id, isn't used; of several labels of a
    document the largest is. Without any label, the learned lexicons are empty
    and the fixed one and the patterns decide. An empty table gives no rows.
    Columns of docs may have any names; one named score is replaced.
    """
    gold = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    gold = F.broadcast(gold) if small_enough(gold, BROADCAST_LABELS) else gold
    others = [F.col(c) for c in docs.columns if c not in ("text", "score")]
    whole = small_batches(docs).select(F.struct(*others).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col("text").cast("string").alias("text"))
    known = whole.join(gold, "id", "left").withColumn("toxic", F.when(F.col("learn"), F.col("toxic")))
    known = known.withColumn("half", F.when(F.col("toxic").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")))
    rows = written(voted(known, *learn_lexicon(known.filter("toxic IS NOT NULL").select("text", "toxic", "half"))), "votes")
    training = rows.filter("learn").select("id", "x", "votes", F.coalesce("toxic", F.lit(-1)).alias("gold"))
    patterns = training.groupBy("votes", "gold").count().collect()  # patterns of votes, not rows
    if not patterns:
        return rows.select("row.*", F.lit(0.0).alias("score"))
    patterns.sort(key=lambda r: (r["votes"], r["gold"]))
    votes = np.array([r["votes"] for r in patterns])
    model = LabelModel(votes, np.array([r["gold"] for r in patterns]), np.array([r["count"] for r in patterns], float))
    sample = training.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    w = fit_linear(np.array([r["x"] for r in sample], float), model.posterior(np.array([r["votes"] for r in sample])))
    weights = F.array(*[F.lit(float(a)) for a in w[1:]])
    dot = F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(float(w[0])), lambda a, b: a + b)
    return rows.select("row.*", (1 / (1 + F.exp(-dot))).alias("score"))


def op4_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = score(docs, labels, ~held_out("doc_id", 4, 2))
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
