"""Scores of a class-based bigram language model (Brown et al. 1992).

P(word | word before) = P(class | class before) * P(word | class).

1. Words of the training texts are counted, all of them, by a shuffle. The COMMON
   most frequent ones get numbers; texts are written as numbers once, with the
   words beyond (the tail) as they are, and everything else reads that table.
2. Every common word's neighbours are counted, one row per word. Exchange
   clustering (Martin, Liermann & Ney 1998) starts with the SEED most frequent
   words, moved one after another. Then all common words are moved in sweeps
   over that table: a word needs only its own neighbours' classes and the table
   of class pairs, so that words are moved in parallel, half of them in a sweep
   (Uszkoreit & Brants 2008). What a class's words look like counts beside what
   they stand next to (Clark 2003): words that occur once or twice would follow
   chance otherwise.
3. Every tail word goes to the class that gains the most likelihood from its own
   neighbours, by a shuffle on the word. So each word of the training texts has a
   class from its contexts, whatever its rank. Only words that were never seen,
   or never next to a common one, go by their shape alone.
4. Pairs of classes are counted over all training texts, and all texts scored.

Class transitions are smoothed by the classes' shares, emissions by half a count
for each word of the class and for one unknown word, so probabilities sum to one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.common import forget, held_out, small_batches, table, written

CLASSES, SEED, SHAPES = 64, 1024, 512
#: Sweeps of the seed words, and of all common words.
SEED_SWEEPS, SWEEPS = 6, 4
#: Weight of a word's shape against its neighbours when a class is chosen.
LOOKS = 3.0
#: Words with numbers: those held by each task, with their counts and classes.
COMMON = 131_072
#: Weight of the classes' shares in a transition, in counts.
PRIOR = 5.0
END = b"\n"
#: Besides the classes: the start of a text, no class (yet), and a neighbour in the tail.
START, NONE, TAIL = CLASSES, CLASSES + 1, CLASSES + 2
_WIDTH = CLASSES + 2
_FLUSH, _PAIRS, _CHUNK = 300_000, 6_000_000, 16_384


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8, runs without ASCII white space with A-Z in lower case, and the end."""
    found = (text or b"").lower().split()
    found.append(END)
    return found


def _utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def shape(word: str) -> int:
    """The number of a word's shape, 0 to SHAPES - 1: of its first letters, last character, length and alphabet."""
    last = word[-1]
    kind = "a" if last.isalpha() else "9" if last.isdigit() else last
    odd = next((c for c in word if c > "\x7f"), "")
    key = f"{kind} {odd} {min(len(word), 12) // 4}" if odd else f"{kind} {word[:2]} {min(len(word), 12) // 4}"
    return crc32(key.encode("utf-8", "surrogatepass")) % SHAPES


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) of column text, ends included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = _batch(word=pa.array(list(held.keys()), pa.binary()).cast(pa.string()), n=pa.array(list(held.values()), pa.int64()))
            held.clear()
            return out

        for b in batches:
            for text in _utf8(b.column("text")):
                held.update(tokens(text))
                if len(held) > _FLUSH:
                    yield flush()
        yield flush()

    return texts.select("text").mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


class _Numbers(dict):
    """Word -> number; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def coded(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(row, doc_id, learn, ids, tail) per row of docs (doc_id, learn, text): numbers as 32-bit integers, -1 for the words listed in tail."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers(numbers).__getitem__
        for whole in batches:
            for at in range(0, whole.num_rows, 300):
                b = whole.slice(at, 300)
                ids, tail = [], []
                for text in _utf8(b.column("text")):
                    words = tokens(text)
                    own = np.fromiter(map(number, words), np.int32, len(words))
                    ids.append(own.tobytes())
                    tail.append([words[i] for i in np.flatnonzero(own < 0).tolist()])
                yield _batch(row=b.column("row"), doc_id=b.column("doc_id"), learn=b.column("learn"), ids=pa.array(ids, pa.binary()), tail=pa.array(tail, pa.list_(pa.binary())).cast(pa.list_(pa.string())))

    drawn = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "learn", "text")
    return drawn.mapInArrow(work, "row long, doc_id long, learn boolean, ids binary, tail array<string>")


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys start, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(values.astype("<i4").tobytes())])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The integers of a column of _binaries, one after another, and how many are in each row."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view("<i4") if data and len(column) else np.empty(0, "<i4")
    return values, np.diff(ends) // 4


def neighbours(texts: DataFrame, size: int) -> DataFrame:
    """(word, beside, n) per common word: numbers left of it, and numbers right of it plus size + 1, with counts; size stands for the start."""
    width = size + 1

    def rows(word: np.ndarray, beside: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        ends = _runs(word)
        return _batch(word=pa.array(word[ends[:-1]], pa.int32()), beside=_binaries(beside, ends), n=_binaries(np.minimum(n, 2**31 - 1), ends))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
            held.clear()
            a, b = keys // width, keys % width
            before = a < size
            by_b = np.argsort(b, kind="stable")
            for part in (rows(a[before], b[before] + width, n[before]), rows(b[by_b], a[by_b], n[by_b])):
                for at in range(0, part.num_rows, 20_000):
                    yield part.slice(at, 20_000)

        for batch in batches:
            for text in batch.column("ids").to_pylist():
                ids = np.frombuffer(text, np.int32).astype(np.int64)
                before = np.concatenate([[size], ids[:-1]])
                held.append((before * width + ids)[(before >= 0) & (ids >= 0)])
                met += len(ids)
                if met > _PAIRS:
                    yield from flush()
                    met = 0
        yield from flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one word, which come together, as one."""
        word, beside, n = (np.empty(0, np.int64) for _ in range(3))

        def compact() -> None:
            nonlocal word, beside, n
            keys = word * (2 * width) + beside
            order = np.argsort(keys, kind="stable")
            ends = _runs(keys[order])
            n = np.add.reduceat(n[order], ends[:-1]) if len(keys) else n
            keys = keys[order][ends[:-1]]
            word, beside = keys // (2 * width), keys % (2 * width)

        for b in batches:
            own, lengths = _lists(b.column("beside"))
            word = np.concatenate([word, np.repeat(b.column("word").to_numpy().astype(np.int64), lengths)])
            beside, n = np.concatenate([beside, own]), np.concatenate([n, _lists(b.column("n"))[0]])
            if len(word) > 1_000_000:
                compact()
                done = word < word[-1]
                yield rows(word[done], beside[done], n[done])
                word, beside, n = word[~done], beside[~done], n[~done]
        compact()
        yield rows(word, beside, n)

    schema = "word int, beside binary, n binary"
    return texts.select("ids").mapInArrow(pairs, schema).repartition("word").sortWithinPartitions("word").mapInArrow(merged, schema)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SEED_SWEEPS) -> np.ndarray:
    """The class of each word, from the matrix of pair counts (its last row is the start's, which has a class of its own)."""
    n = len(pairs) - 1
    total = pairs.sum(0)[:n]
    order = np.argsort(-total, kind="stable")
    own = np.empty(n + 1, int)
    own[order] = np.arange(n) % classes
    own[n] = classes
    member = np.eye(classes + 1)[own]
    m = member.T @ pairs @ member
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not total[w]:
                break
            a = own[w]
            left, right = np.bincount(own, pairs[:, w], classes + 1)[None, :], np.bincount(own, pairs[w], classes + 1)[None, :]
            gain = gains(left, right, pairs[w, w][None], m, own[w : w + 1], classes)[0]
            b = int(gain.argmax())
            if gain[b] > gain[a] + 1e-9:
                left[0, a] -= pairs[w, w]
                right[0, a] -= pairs[w, w]
                for c, sign in ((a, -1), (b, 1)):
                    m[:, c] += sign * left[0]
                    m[c] += sign * right[0]
                    m[c, c] += sign * pairs[w, w]
                own[w] = b
                moved += 1
        if not moved:
            break
    return own[:n]


def gains(left: np.ndarray, right: np.ndarray, self_: np.ndarray, m: np.ndarray, own: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """words x classes: the log likelihood of class pairs gained by each word in each class, all others staying where they are.

    left, right: words x (classes, start): counts of the neighbours' classes; self_:
    how often the word follows itself; m: counts of class pairs, the start last;
    own: the words' classes, NONE for words that m doesn't count.
    """
    left, right = left.astype(float), right.astype(float)
    rows = np.arange(len(left))
    has = own < classes
    at = np.where(has, own, 0)
    left[rows[has], at[has]] -= self_[has]
    right[rows[has], at[has]] -= self_[has]
    self_ = np.where(has, self_, 0.0)
    gain = np.zeros((len(left), classes))
    for mine, other, cells in ((left, right, m[:, :classes]), (right, left, m[:classes].T)):
        w, c = np.nonzero(mine)
        n = mine[w, c][:, None]
        base = cells[c].astype(float)
        inside = np.flatnonzero(has[w])
        base[inside, at[w[inside]]] -= n[inside, 0]
        met = inside[at[w[inside]] == c[inside]]
        base[met] -= other[w[met], :classes]
        base[met, c[met]] -= self_[w[met]]
        each = _xlogx(base + n) - _xlogx(base)
        ends = _runs(w)
        if len(w):
            gain[w[ends[:-1]]] += np.add.reduceat(each, ends[:-1], axis=0)
    # A cell that a word meets from both sides was counted as two.
    w, c = np.nonzero(((left[:, :classes] > 0) & (right[:, :classes] > 0)) | (self_ > 0)[:, None])
    l_, r_, s_, d = left[w, c], right[w, c], self_[w], np.diag(m)[c].astype(float)
    mine = has[w] & (at[w] == c)
    d[mine] -= (l_ + r_ + s_)[mine]
    gain[w, c] += _xlogx(d + l_ + r_ + s_) - _xlogx(d + l_) - _xlogx(d + r_) + _xlogx(d)
    for mine, margin in ((left, m[:, :classes].sum(0)), (right, m[:classes].sum(1))):
        n = mine.sum(1) + self_
        sizes, of = np.unique(n, return_inverse=True)
        gain -= (_xlogx(margin + sizes[:, None]) - _xlogx(margin))[of]
        own_margin = margin[at[has]]
        gain[rows[has], at[has]] += _xlogx(own_margin + n[has]) - 2 * _xlogx(own_margin) + _xlogx(own_margin - n[has])
    return gain


def _contexts(b: pa.RecordBatch, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, counts of the classes left and right of each, and how often it follows itself."""
    word = b.column("word").to_numpy()
    beside, lengths = _lists(b.column("beside"))
    n, _ = _lists(b.column("n"))
    of, width = np.repeat(np.arange(len(word)), lengths), len(own)
    right = beside >= width
    kinds = own[beside - width * right]
    sides = np.bincount((of * 2 + right) * _WIDTH + kinds, n, len(word) * 2 * _WIDTH).reshape(-1, 2, _WIDTH)
    self_ = np.bincount(of, n * (beside == word[of]), len(word))
    return word, sides[:, 0, :NONE], sides[:, 1, :NONE], self_


def _class_pairs(table_: DataFrame, own: np.ndarray) -> np.ndarray:
    """Counts of pairs of classes of neighbouring common words, the start's last."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((_WIDTH, _WIDTH))
        for b in batches:
            word, left, _, _ = _contexts(b, own)
            np.add.at(m.T, own[word], np.pad(left, ((0, 0), (0, 1))))
        at = np.flatnonzero(m)
        yield _batch(at=pa.array(at, pa.int32()), n=pa.array(m.ravel()[at], pa.float64()))

    m = np.zeros(_WIDTH * _WIDTH)
    for r in table_.mapInArrow(work, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        m[r["at"]] = r["n"]
    return m.reshape(_WIDTH, _WIDTH)[:NONE, :NONE]


def likelihood(m: np.ndarray) -> float:
    return float(_xlogx(m).sum() - _xlogx(m.sum(0)).sum() - _xlogx(m.sum(1)).sum())


def looks(shapes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """SHAPES x CLASSES: the weighted log probability of a shape in a class, by its distinct words."""
    has = own < CLASSES
    met = np.bincount(shapes[has] * CLASSES + own[has], minlength=SHAPES * CLASSES).reshape(SHAPES, CLASSES) + 0.1
    return LOOKS * np.log(met / met.sum(0))


def common_classes(table_: DataFrame, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each common word (then the start's), and the counts of class pairs, from the table of neighbours and the words' shapes."""
    size = len(shapes)
    seeds, width = min(SEED, size), size + 1

    def seed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            beside, lengths = _lists(b.column("beside"))
            word, n = np.repeat(b.column("word").to_numpy(), lengths), _lists(b.column("n"))[0]
            kept = (beside < seeds) | (beside == size)
            yield _batch(a=pa.array(np.minimum(beside[kept], seeds), pa.int32()), b=pa.array(word[kept], pa.int32()), n=pa.array(n[kept], pa.int32()))

    found = table_.filter(F.col("word") < seeds).mapInArrow(seed_pairs, "a int, b int, n int").toArrow()
    pairs = np.zeros((seeds + 1, seeds + 1))
    pairs[found.column("a").to_numpy(), found.column("b").to_numpy()] = found.column("n").to_numpy()
    own = np.full(width, NONE, np.int16)
    own[:seeds], own[size] = exchange(pairs), START
    m, before = _class_pairs(table_, own), None
    for sweep in range(SWEEPS):

        def moves(batches: Iterator[pa.RecordBatch], own: np.ndarray = own, m: np.ndarray = m, like: np.ndarray = looks(shapes, own[:size]), sweep: int = sweep) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    word, left, right, self_ = _contexts(whole.slice(at, 500), own)
                    now, rows = own[word], np.arange(len(word))
                    gain = gains(left, right, self_, m, now) + like[shapes[word]]
                    best = gain.argmax(1)
                    stays = np.where(now == NONE, -np.inf, gain[rows, np.minimum(now, CLASSES - 1)])
                    moved = (gain[rows, best] > stays + 1e-9) & ((now == NONE) if sweep == 0 else (word % 2 == sweep % 2))
                    yield _batch(word=pa.array(word[moved], pa.int32()), own=pa.array(best[moved], pa.int16()))

        found = table_.mapInArrow(moves, "word int, own short").toArrow()
        new = own.copy()
        new[found.column("word").to_numpy()] = found.column("own").to_numpy()
        if sweep == 0:
            rest = np.flatnonzero(new == NONE)  # never next to a common word
            new[rest] = looks(shapes, new[:size])[shapes[rest]].argmax(1)
        counted = _class_pairs(table_, new)
        after = likelihood(counted) + looks(shapes, new[:size])[shapes, new[:size]].sum()
        if before is not None and after <= before:
            break
        own, m, before = new, counted, after
    return own, m


def tail_words(texts: DataFrame, own: np.ndarray, m: np.ndarray, like: np.ndarray) -> DataFrame:
    """(row, place, own, c, word) per occurrence of a tail word in the coded texts.

    place: see placed(); own: the word's class, by its neighbours in training texts
    and by its shape (like: see looks), by its shape alone where it has none; c:
    its training count; word: the word, in one of its rows alone.
    """

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = np.append(own, TAIL).astype(np.int64)  # the last, -1, is a tail word
        for whole in batches:
            for at in range(0, whole.num_rows, 300):
                b = whole.slice(at, 300)
                places, counts = [], []
                for text, learn in zip(b.column("ids").to_pylist(), b.column("learn").to_pylist(), strict=True):
                    ids = np.frombuffer(text, np.int32)
                    own_at = np.flatnonzero(ids < 0)
                    around = np.concatenate([[START], kinds[ids], [NONE]])
                    places.append(own_at << 17 | around[own_at] << 9 | around[own_at + 2] << 1 | learn)
                    counts.append(len(own_at))
                yield _batch(row=pa.array(np.repeat(b.column("row").to_numpy(), counts)), place=pa.array(np.concatenate(places), pa.int64()), word=b.column("tail").flatten())

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one word come together; whole words are worked on as many at a time as fit in a chunk."""
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            runs = pc.run_end_encode(t.column("word").combine_chunks())
            ends = np.concatenate([[0], runs.run_ends.to_numpy()])
            words = runs.values.to_pylist()
            if not last:
                ends, words = ends[:-1], words[:-1]
            rest = t.slice(int(ends[-1]))
            t = t.slice(0, int(ends[-1]))
            if not words:
                return None, rest
            of = np.repeat(np.arange(len(words)), np.diff(ends))
            place = t.column("place").to_numpy()
            learn = (place & 1).astype(bool)
            sides = [np.bincount(of[k] * NONE + x[k], minlength=len(words) * NONE).reshape(-1, NONE) for x in (place >> 9 & 255, place >> 1 & 255) for k in [learn & (x < NONE)]]
            count = np.bincount(of, learn, len(words)).astype(np.int64)
            best = (gains(*sides, np.zeros(len(words)), m, np.full(len(words), NONE)) + like[[shape(w) for w in words]]).argmax(1)
            first = np.zeros(len(of), bool)
            first[ends[:-1]] = True
            named = pc.if_else(pa.array(first), t.column("word").combine_chunks(), None)
            return _batch(row=t.column("row").combine_chunks(), place=pa.array(place), own=pa.array(best[of], pa.int32()), c=pa.array(count[of]), word=named), rest

        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, _CHUNK):
                held.append(whole.slice(at, _CHUNK))
                size += held[-1].num_rows
                if size >= _CHUNK:
                    out, rest = done(pa.Table.from_batches(held), False)
                    held, size = rest.to_batches(), rest.num_rows
                    if out:
                        yield out
        if held:
            out, _ = done(pa.Table.from_batches(held), True)
            if out:
                yield out

    met = texts.select("row", "learn", "ids", "tail").filter(F.size("tail") > 0).mapInArrow(occurrences, "row long, place long, word string")
    return met.repartition("word").sortWithinPartitions(F.xxhash64("word"), "word").mapInArrow(assigned, "row long, place long, own int, c long, word string")


def placed(tail: DataFrame) -> DataFrame:
    """Tail words with what place holds: at, the position; before and after, the neighbours' classes, TAIL for tail words, NONE beyond the text; learn."""
    part = lambda bit: F.shiftright("place", bit).bitwiseAND(255).cast("int")
    return tail.select("row", "own", "c", "word", F.shiftright("place", 17).alias("at"), part(9).alias("before"), part(1).alias("after"), (F.col("place").bitwiseAND(1) == 1).alias("learn"))


class Fitted(NamedTuple):
    """What scoring needs: the common words' numbers, counts (log10 of c + 0.5) and classes, and of the classes the transitions and emission totals (log10)."""

    words: list[str]
    half: np.ndarray
    own: np.ndarray
    transition: np.ndarray
    total: np.ndarray
    n_all: int
    v_all: int
    texts: DataFrame
    tail: DataFrame
    tail_pairs: DataFrame


def _common_counts(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    found = counts.orderBy(F.desc("c"), "word").limit(COMMON).toArrow()
    return found.column("word").to_pylist(), found.column("c").to_numpy().astype(float)


def _tail_statistics(tail: DataFrame, tail_pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of class pairs with a tail word in them, and the tail's tokens and distinct words by class, in training texts."""
    met = tail.filter("learn").groupBy("before", "own", "after").agg(F.count("*").alias("n")).persist()  # of a bounded number
    left = met.filter(F.col("before") < NONE).select(F.col("before").alias("a"), F.col("own").alias("b"), "n")
    right = met.filter(F.col("after") < NONE).select(F.col("own").alias("a"), F.col("after").alias("b"), "n")
    both = tail_pairs.filter("learn").groupBy("a", "b").agg(F.count("*").alias("n"))
    m, n, v = np.zeros((NONE, NONE)), np.zeros(CLASSES), np.zeros(CLASSES)
    for r in left.union(right).union(both).groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        m[r["a"], r["b"]] = r["n"]
    for r in met.groupBy("own").agg(F.sum("n").alias("n")).collect():
        n[r["own"]] = r["n"]
    for r in tail.filter("word IS NOT NULL AND c > 0").groupBy("own").count().collect():
        v[r["own"]] = r["count"]
    met.unpersist()
    return m, n, v


def transitions(m: np.ndarray, n: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of P(class | class before), the start's row last, and of the classes' emission totals, from pair counts, tokens and distinct words."""
    share = (n + 0.5) / (n + 0.5).sum()
    m = m[:, :CLASSES]
    return np.log10((m + PRIOR * share) / (m.sum(1, keepdims=True) + PRIOR)), np.log10(n + 0.5 * (v + 1))


def fit(docs: DataFrame) -> Fitted:
    """The model of the rows of docs (doc_id, learn, text) with learn, and all rows' texts coded for scoring."""
    counts = written(count_words(docs.filter("learn")), "words")
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words, count = _common_counts(counts)
    forget(counts)
    texts = written(coded(docs, {w.encode(): i for i, w in enumerate(words)}), "coded")
    table_ = written(neighbours(texts.filter("learn"), len(words)), "neighbours")
    shapes = np.array([shape(w) for w in words], int)
    own, m = common_classes(table_, shapes)
    forget(table_)
    like = looks(shapes, own[:-1])
    size = np.log(np.bincount(own[:-1], minlength=CLASSES) + 0.1)
    tail = placed(written(tail_words(texts, own, m, like + size), "tail"))
    one = tail.filter(F.col("after") == TAIL).select("row", "at", "learn", F.col("own").alias("a"))
    two = tail.filter(F.col("before") == TAIL).select("row", (F.col("at") - 1).alias("at"), F.col("own").alias("b"))
    tail_pairs = written(one.join(two, ["row", "at"]).select("row", "learn", "a", "b"), "tail_pairs")

    more, n, v = _tail_statistics(tail, tail_pairs)
    n += np.bincount(own[:-1], count, CLASSES)
    v += np.bincount(own[:-1], minlength=CLASSES)
    transition, total = transitions(m + more, n, v)
    return Fitted(words, np.log10(count + 0.5), own, transition, total, n_all, v_all, texts, tail, tail_pairs)


def scores(docs: DataFrame, learn: str) -> DataFrame:
    """(row, doc_id, n_tokens, n_known, train_tokens, base_score, score) per row of docs (doc_id, text, and a flag named by learn).

    A null text is empty and has the end alone. Rows with equal or null ids are
    scored each by itself. If there is nothing to learn from, every token is
    unknown. An empty table gives no rows; other columns aren't read.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce(F.col(learn), F.lit(False)).alias("learn"), F.col("text").cast("string"))
    model = fit(docs)
    below = np.log10(model.n_all + 0.5 * (model.v_all + 1))
    half, own, transition, total = model.half, model.own, model.transition, model.total
    schema = "row long, doc_id long, n_tokens long, n_known long, base double, score double"

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, known, base, score = [], [], [], []
            for text in b.column("ids").to_pylist():
                ids = np.frombuffer(text, np.int32)
                met = np.concatenate([[True], ids >= 0])
                kinds = np.concatenate([[START], own[ids]])
                both = met[1:] & met[:-1]
                now = kinds[1:][met[1:]]
                emitted = half[ids[met[1:]]].sum()
                n.append(len(ids))
                known.append(len(now))
                base.append(emitted - below * len(ids))
                score.append(transition[kinds[:-1][both], kinds[1:][both]].sum() + emitted - total[now].sum())
            yield _batch(row=b.column("row"), doc_id=b.column("doc_id"), n_tokens=pa.array(n, pa.int64()), n_known=pa.array(known, pa.int64()), base=pa.array(base, pa.float64()), score=pa.array(score, pa.float64()))

    at = lambda values, i: F.element_at(F.lit(values), i + 1)
    padded = np.zeros((TAIL + 1, TAIL + 1))  # a missing neighbour adds nothing; pairs in the tail are added apart
    padded[:NONE, :CLASSES] = transition
    padded, emitted, kind, zero = padded.ravel(), F.log10(F.col("c") + 0.5), F.col("own"), F.lit(0).cast("long")
    around = at(padded, F.col("before") * (TAIL + 1) + kind) + at(padded, kind * (TAIL + 1) + F.col("after"))
    alone = F.lit(None).cast("long").alias("doc_id"), zero.alias("n_tokens")
    rare = model.tail.select("row", *alone, (F.col("c") > 0).cast("long").alias("n_known"), emitted.alias("base"), (emitted - at(total, kind) + around).alias("score"))
    between = model.tail_pairs.select("row", *alone, zero.alias("n_known"), F.lit(0.0).alias("base"), at(padded, F.col("a") * (TAIL + 1) + F.col("b")).alias("score"))

    parts = model.texts.select("row", "doc_id", "ids").mapInArrow(common, schema)
    return parts.unionByName(rare).unionByName(between).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.lit(model.n_all).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"),
        F.sum("score").alias("score"),
    )


def op1_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out("doc_id", 5, 1)).alias("learn"))
    found = scores(docs, "learn")
    return found.select("doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
