"""The numbered queries on the smallest tables, against SQL, brute force, round trips or held-out accuracy."""

import hashlib
import struct
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spandrel.llm import packing, queries
from spandrel.llm.common import table
from tests.conftest import SMALL
from tests.llm import brute
from tests.oracle import same

MEDIUM = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    same(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SMALL)


def documents(spark, sf_dir=SMALL):
    return [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]


def test_op1_base_scores_and_gain(spark):
    want = brute.unigram(documents(spark))
    got = queries.QUERIES["op1_brown_class_lm"](spark, SMALL).collect()
    assert len(got) == len(want)
    for r in got:
        held, n, known, train, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize(("common", "seeds"), [(10**6, 100), (400, 50), (1, 1)])
def test_op1_scores_by_plain_counting(spark, monkeypatch, common, seeds):
    """Given each word's class, the scores are those of a class bigram counted in plain Python; all words have classes of their own."""
    import math
    import random
    from collections import Counter

    from spandrel.llm import brown

    monkeypatch.setattr(brown, "COMMON", common)
    monkeypatch.setattr(brown, "SEED", seeds)
    monkeypatch.setattr(brown, "fit", lambda docs, fit=brown.fit: models.append(fit(docs)) or models[0])
    models: list = []
    learn = table(spark, SMALL, "documents").select("doc_id", "text", (F.col("doc_id") % 3 != 1).alias("learn"))
    got = {r["doc_id"]: r["score"] for r in brown.scores(learn, "learn").collect()}
    kinds = {w: int(k) for w, k in zip(models[0].words, models[0].own, strict=False)}
    kinds |= {r["word"]: r["own"] for r in models[0].tail.filter("word IS NOT NULL").select("word", "own").collect()}
    texts = {i: [*brute.words(t), "\n"] for i, t in documents(spark)}
    trained = {i: w for i, w in texts.items() if i % 3 != 1}
    count = Counter(w for t in trained.values() for w in t)
    assert set(count) <= set(kinds) and set(kinds.values()) <= set(range(brown.CLASSES))

    def pairs(of):
        return Counter((a, b) for t in trained.values() for a, b in zip(["start", *[of[w] for w in t]], [of[w] for w in t]))

    m, before = pairs(kinds), Counter()
    for (a, _), n in m.items():
        before[a] += n
    n, v = Counter(), Counter(kinds[w] for w in count)
    for w, c in count.items():
        n[kinds[w]] += c
    whole = sum(n[k] + 0.5 for k in range(brown.CLASSES))
    for i, t in texts.items():
        score = 0.0
        for a, w in zip(["start", *[kinds[w] for w in t]], t):
            b = kinds[w]
            score += math.log10((m[a, b] + brown.PRIOR * (n[b] + 0.5) / whole) / (before[a] + brown.PRIOR))
            score += math.log10((count[w] + 0.5) / (n[b] + 0.5 * (v[b] + 1)))
        assert got[i] == pytest.approx(score)

    def worth(m):
        left, right = Counter(), Counter()
        for (a, b), c in m.items():
            left[a] += c
            right[b] += c
        return sum(c * math.log(c / left[a] / right[b]) for (a, b), c in m.items())

    others = list(kinds)
    random.Random(1).shuffle(others)
    assert worth(m) > worth(pairs(dict(zip(others, kinds.values(), strict=True))))


def test_op2_held_out_accuracy(spark):
    got = queries.QUERIES["op2_hierarchical_langid"](spark, MEDIUM)
    r = got.filter("held_out").join(table(spark, MEDIUM, "documents").select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.97 and 0 <= r[1] and r[2] <= 1


def test_op4_held_out_quality(spark):
    got = queries.QUERIES["op4_weak_supervision_toxicity"](spark, "/root/testdata/sf0.1")
    met = got.filter("held_out").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").collect()
    hit = sum(r["toxic"] == r["predicted"] == 1 for r in met)
    assert hit >= 0.9 * sum(r["toxic"] for r in met) and hit >= 0.95 * sum(r["predicted"] for r in met)


def test_op6_matches_all_pairs(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op6_setsketch_neardup"](spark, SMALL).collect()}
    assert got == brute.near(documents(spark))


def test_op7_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(table(spark, SMALL, "documents")).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc, text in documents(spark):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[doc], key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in own) == struct.pack(f"<{len(ids)}I", *ids)
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        size = sum(r["length"] for r in own)
        padding += 0 if size & (size - 1) == 0 else 2048 - size
    assert padding < 0.01 * 2048 * len(sequences)


def test_op9_base_spans(spark):
    texts = dict(documents(spark, MEDIUM))
    for r in queries.QUERIES["op9_weak_supervision_pii"](spark, MEDIUM).collect():
        want = brute.private(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in brute.KINDS] == [sum(x.startswith(k) for x in want) for k in brute.KINDS]
        assert set(want) - {""} <= set(r["spans"].split(","))


def test_op10_articles(spark):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in table(spark, SMALL, "pages").collect()}
    for r in queries.QUERIES["op10_text_density"](spark, SMALL).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])


def test_op10_densities_decide(spark, monkeypatch):
    """On the pages as they are: constant densities lose a third of the articles, inverted ones all."""
    from spandrel.llm import extraction

    pages = [r["html"] for r in table(spark, MEDIUM, "pages").collect()]
    wanted = [extraction.main_text(h) for h in pages]
    share = lambda: sum(extraction.main_text(h) == w for h, w in zip(pages, wanted, strict=True)) / len(pages)
    own = extraction._densities
    for change, most in ((lambda d: float(d > 0), 0.75), (lambda d: d and 1 / (1 + d), 0.01)):
        monkeypatch.setattr(extraction, "_densities", lambda *a, f=change: (*([f(d) for d in part] for part in own(*a)[:2]), *own(*a)[2:]))
        assert share() < most


def test_op10_needs_no_names(spark, monkeypatch):
    """The same pages with divs for all sectioning elements and without classes: densities still find the articles, constant ones don't."""
    import re

    from spandrel.llm import extraction

    pages = [r["html"] for r in table(spark, MEDIUM, "pages").collect()]
    bare = [re.sub(r"<(/?)(nav|footer|article)\b", r"<\1div", h.replace(' class="ad"', "")) for h in pages]
    wanted = [extraction.main_text(h) for h in pages]
    share = lambda: sum(extraction.main_text(h) == w for h, w in zip(bare, wanted, strict=True)) / len(pages)
    assert share() > 0.93
    own = extraction._densities
    monkeypatch.setattr(extraction, "_densities", lambda *a: ([float(d > 0) for d in own(*a)[0]], *own(*a)[1:]))
    assert share() < 0.75
