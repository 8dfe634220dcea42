"""Operators on small fixtures: search, register, checks, chunks, references, streams."""

import math

import pytest
from pyspark.sql import functions as F

from spandrel.functions import text
from spandrel.operators import chunking, merge, metrics, parties, references, register, search, validation
from spandrel.sources import pages
from spandrel.streaming import increments
from tests.conftest import rows


def test_bm25_golden(spark):
    c = spark.createDataFrame([(0, ["anbud", "pris", "pris", "pris"]), (1, ["anbud", "leverans"]), (2, ["kontroll", "leverans", "ränta"])], "chunk int, terms array<string>")
    counts, corpus = search.term_counts(c), search.corpus(c)
    index = search.term_index(counts)
    assert tuple(corpus.first()) == (3, 3.0)
    assert rows(index, "id", "term", "chunk_count") == [(0, "anbud", 2), (1, "kontroll", 1), (2, "leverans", 2), (3, "pris", 1), (4, "ränta", 1)]
    weight = {(r["chunk"], r["term"]): r["weight"] for r in search.postings(counts, corpus).collect()}
    assert weight[0, "pris"] == pytest.approx(math.log(1 + 2.5 / 1.5) * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 4 / 3)))
    assert [r["chunk"] for r in search.text_candidates(search.postings(counts, corpus), ["leverans", "leverans", "saknas"], 5).orderBy("rank").collect()] == [1, 2]


def test_fusion_golden(spark):
    hashes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a"), (5, "c")], "chunk int, section_hash string")
    ranking = lambda *keys: spark.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], "chunk int, rank int")
    v = search.section_ranking(ranking(1, 4, 2, 3), hashes)
    assert [(r["section_hash"], r["rank"]) for r in v.orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    fused = search.fuse(v, search.section_ranking(ranking(5, 4), hashes)).orderBy(F.desc("score"), "chunk").collect()
    assert [(r["section_hash"], r["chunk"]) for r in fused] == [("a", 1), ("c", 5), ("b", 2)]
    assert fused[0]["score"] == pytest.approx(1 / 61 + 1 / 62) and fused[1]["score"] == pytest.approx(1 / 63 + 1 / 61)


def test_scope_filter_unknown_agreement_matches_no_shared_file(spark):
    s = spark.createDataFrame([(1, ["P"], ["A1"], "t"), (2, ["P"], [], "t"), (3, ["Q"], [], None)], "id int, procurement_numbers array<string>, agreement_numbers array<string>, document_type string")
    ids = lambda **f: [r[0] for r in s.filter(search.scope_filter(**f)).select("id").orderBy("id").collect()]
    assert ids(agreement="A1", agreement_procurement="P") == [1, 2]
    assert ids(agreement="A1") == [1] and ids(agreement="A9", agreement_procurement=None) == []
    assert ids(document_type="t", procurement="P") == [1, 2]


def test_metrics_golden(spark):
    ranking = spark.createDataFrame([("q", 1, "x"), ("q", 2, "a"), ("q", 3, "c")], "question string, rank int, key string")
    required = spark.createDataFrame([("q", 1, "a"), ("q", 1, "b"), ("q", 2, "z")], "question string, source_id int, key string")
    m = metrics.ranking_metrics(ranking, required).first()
    assert (m["recall"], m["all_hit"], m["reciprocal_rank"]) == (0.5, False, 0.5)
    assert m["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs=1e-8)


def test_search_finds_other_forms_of_a_word(spark):
    c = spark.createDataFrame([(0, "Avtalet gäller till 2025-08-19."), (1, "Avtalens viten"), (2, "Det ska vara en leverantör, 6.21.9"), (3, "cafe\u0301"), (4, None)], "chunk int, text string").select("chunk", text.analysed(F.col("text")).alias("terms"))
    assert c.filter("chunk = 0").first()["terms"] == ["avtalet", "gäller", "2025-08-19"] and c.filter("chunk = 4").first()["terms"] == []
    wanted = search.query_terms("Vilka avtal har viten? AVTALET café 6.21.9")
    assert wanted == ["avtal", "vit", "café", "6.21.9"]
    found = {r["chunk"]: r["term"] for r in search.query_postings(c, wanted).filter("term <> 'vit'").collect()}
    assert found == {0: "avtal", 1: "avtal", 2: "6.21.9", 3: "café"}
    whole = search.postings(search.stems(search.term_counts(c)), search.corpus(c)).filter(F.col("term").isin(wanted))
    assert rows(whole) == rows(search.query_postings(c, wanted))


def test_native_stems_are_those_of_the_plain_algorithm(spark):
    import itertools

    heads = ["avtal", "leverantör", "löst", "full", "fast", "by", "häst", "iet", "kvit", "kod", "x", "ö", "strykt", "möjlig", "vänlig"]
    tails = ["", *text.ENDINGS, "et", "s", "ts", "ks", "fullt", "löst", "lig", "els", "ig", "gt", "dd", "alitet", "paket"]
    terms = sorted({a + b for a, b in itertools.product(heads, tails)} | {"iso27001", "6.21"})
    got = spark.createDataFrame([(t,) for t in terms], "term string").select("term", text.stemmed(F.col("term")).alias("stem")).collect()
    assert {r["term"]: r["stem"] for r in got} == {t: text.stem(t) if t.isalpha() else t for t in terms}


def test_questions_in_blocks(spark, monkeypatch):
    q, c = spark.range(10).toDF("q"), spark.range(7).toDF("c")
    whole = rows(search.in_blocks(q, c, "q"), "q", "c")
    monkeypatch.setattr(search, "QUESTIONS", 3)
    assert rows(search.in_blocks(q, c, "q"), "q", "c") == whole and len(whole) == 70


def test_bootstrap_is_numpy_s(spark):
    import hashlib

    import numpy as np

    a, b = [0.1, 0.5, 0.9, 0.4], [0.3, 0.4, 1.0, 0.9]
    pairs = spark.createDataFrame([("c", i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "comparison string, question int, a double, b double")
    d = np.array(b) - np.array(a)
    u = np.array([[int(hashlib.md5(f"0:{q}:{r}".encode()).hexdigest()[:8], 16) / 2**32 for q in range(4)] for r in range(500)])
    w = np.searchsorted(metrics._POISSON, u.ravel(), side="right").reshape(u.shape)
    met = w.sum(1) > 0
    low, high = np.percentile((w * d).sum(1)[met] / w.sum(1)[met], [2.5, 97.5])
    r = metrics.paired_bootstrap(pairs, ["comparison"], 500).first()
    assert (r["mean"], r["low"], r["high"]) == pytest.approx((d.mean(), low, high))


def register_fixture(spark):
    raw = [
        (1, "23.3-1-2020-001".replace("-1-", "-10-"), "AB One (f.d. Zero AB)", "5560804212", "IT", "Nord / Kiruna", "2020-01-01", "2024-12-31", ""),
        (2, "23.3-10-2020-001", "AB One", "5560804212", "IT", "Nord / Kiruna", "2020-02-01", "2025-12-31", "2026-12-31"),
        (3, "23.3-10-2020-001", "AB Two", "556914-7720", "IT", "Syd", "2020-01-01", "2024-12-31", ""),
        (4, "23.3-7702-20:002", "Fi Oy", "FI01148912", "IT", "Syd", "2020-01-01", "2023-12-31", ""),
        (5, "bad", "X", "5560804212", "IT", "Syd", "2020-01-01", "2023-12-31", ""),
        (6, "23.3-10-2020-003", " ", "5560804212", "IT", "Syd", "2020-01-01", "2023-12-31", ""),
        (7, "23.3-10-2020-003", "X", "5560804212", "IT", "Syd", "2020-01-01", "2023-02-30", ""),
    ]
    return spark.createDataFrame(raw, "source_row int, agreement string, supplier string, org string, area string, sub_area string, valid_from string, valid_to string, max_extension_to string")


def test_register(spark):
    good, bad = register.normalize(register_fixture(spark))
    assert rows(bad) == [(5, "agreement has an unknown format"), (6, "supplier is empty"), (7, "valid_to has an unknown format")]
    assert rows(register.conflicts(good)) == [(2, "repeated", 1), (3, "org_number", 1)]
    assert rows(register.foreign_org_numbers(good)) == [("FI01148912", 4, "Fi Oy")]
    t = register.tables(good)
    assert rows(t["sub_area"], "path", "level", "parent_path") == [("Nord / Kiruna", 2, "Nord"), ("Nord", 1, None), ("Syd", 1, None)] or t["sub_area"].count() == 3
    assert rows(t["agreement"], "agreement_number", "org_number") == [("23.3-10-2020-001", "556080-4212"), ("23.3-7702-20:002", "FI01148912")]
    found = register.search(t, supplier="zero")
    assert {r["agreement_number"] for r in found.collect()} == {"23.3-10-2020-001"}
    assert register.search(t, agreement="23.3.7702-2020-02").count() == 1
    assert register.search(t, area="it", sub_area="kiruna / nord").count() == 1
    assert register.search(t, supplier="100%").count() == 0
    assert register.search(t, area="IT", valid_on="2024-06-01").count() == 2
    assert register.search_page(register.search(t, area="IT"), 1, 1).first()["total"] == 3
    with pytest.raises(ValueError):
        register.search(t, valid_on="2024-06-01")


def test_quarantine_fails_closed(spark):
    indexed = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 0), ("d", 0)], "sha256 string, section_position long")
    found = spark.createDataFrame([("x", "quarantine", "s", "a", 1), ("x", "quarantine", "s", "b", None), ("x", "quarantine", "ok", "c", None), ("x", "note", "s", "c", 0)], "check string, severity string, subject string, sha256 string, section_position long")
    accepted = spark.createDataFrame([("x:c:ok", "seen")], "key string, reason string")
    held = validation.quarantine(validation.accept(found, accepted))
    assert rows(validation.visible(indexed, indexed.filter("sha256 <> 'd'"), held)) == [("a", 0), ("c", 0)]


def test_latest_wording(spark):
    cited = spark.createDataFrame([(1, "a", 3), (2, "a", 3), (2, "m", 0)], "draft int, sha256 string, section_position long")
    amended = spark.createDataFrame([("a", None, "m", 0), ("z", 1, "m", 0)], "target_sha256 string, target_section_position long, sha256 string, section_position long")
    assert rows(validation.latest_wording(cited, amended)) == [(1, "a", 3)]


def test_citations(spark):
    sections = spark.createDataFrame([("a", 0, "Leverantören ska betala vite om 5 procent."), ("a", 1, "Kort.")], "sha256 string, section_position long, text string")
    drafts = spark.createDataFrame([(1, 1, "a", 0, "”ska betala  VITE om”"), (1, 2, "a", 0, "ska inte betala vite"), (1, 3, "a", 0, "vite"), (1, 4, "a", 1, "Kort."), (1, 5, "a", 9, "x")], "draft int, id int, sha256 string, section_position long, quote string")
    assert rows(validation.citations(drafts, sections)) == [(1, 2, "not_verbatim"), (1, 3, "too_short"), (1, 5, "no_section")]


def test_furniture(spark):
    blocks = [("d", 10 * p + i, "text", p, t) for p in range(1, 5) for i, t in enumerate(["Running Title", f"Body {p} a", f"Body {p} b", f"Body {p} c", f"Body {p} d", f"Body {p} e", f"Sida {p}/4"])]
    df = spark.createDataFrame(blocks, "doc string, position int, kind string, page int, text string")
    left = {r["text"] for r in chunking.body_blocks(df).collect()}
    assert "Running Title" not in left and not any("Sida" in t for t in left) and "Body 2 c" in left


def test_pieces():
    long = "A sentence of some words. " * 120
    got = chunking.pieces("Short one.\n\nShort two.\n\n" + long)
    assert all(len(p) <= chunking.MAX_CHUNK for p in got) and got[0].startswith("Short one.\n\nShort two.")
    assert " ".join(" ".join(got).split()) == " ".join(("Short one. Short two. " + long).split())
    assert chunking.pieces("x" * 4000) == ["x" * 1500, "x" * 1500, "x" * 1000]


def test_outline_and_tree(spark):
    lines = ["1 Inledning ..... 3", "2 Villkor ....... 4", "1 Inledning", "text here", "1.1 Syfte", "2 Villkor", "7 st skruvar levereras;", "2.1 Vite", "2.2 Pris"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], "doc string, position long, text string")
    found = chunking.outline(df)
    assert [r["number"] for r in found.orderBy("position").collect()] == ["1", "1.1", "2", "2.1", "2.2"]
    tree = {r["number"]: (r["parent"], r["path"]) for r in chunking.section_tree(found).collect()}
    assert tree["2.1"] == (5, ["Villkor", "Vite"]) and tree["1"][0] is None
    assert chunking.contents_missing(df, found).count() == 0


def test_references(spark):
    said = [
        ("d", 0, "1.1", "Syfte", "Se avsnitt 2.3 och bilaga 4. Detta avsnitt ersätter avsnitt 9.9. Jämför avsnitt 7.1, 7.2 och 2.3 samt fråga 12."),
        ("d", 1, "2.3", "Vite", "Enligt lagen (2016:1145) 3 kap. gäller allmänna villkor. Se avsnitt Vite vid försening. Läs avsnitt 4.1 i Kravkatalogen, och bilaga Prislista. Avsnitt xx.x saknas."),
        ("d", 2, "2.4", "Vite vid försening", None),
        ("k", 0, "4.1", "Krav", ""),
        ("q", 0, "12", "Svar", ""),
    ]
    sections = spark.createDataFrame(said, "doc string, position int, number string, title string, text string")
    pages = [("p", "d", "Huvuddokument", None, "main"), ("p", "e", "Bilaga 4", "4", None), ("p", "f", "Allmänna villkor 2", None, None), ("p", "g", "Allmänna villkor 3", None, None), ("p", "k", "Kravkatalogen", None, None), ("p", "q", "Frågor", None, "question_log"), ("p", "r", "Bilaga 7 - Prislista", "7", None)]
    files = spark.createDataFrame(pages, "page string, doc string, title string, annex string, document_type string")
    resolved = references.resolve(references.mentions(sections), sections, files)
    where = {(r["kind"], r["key"]): (r["rule"], r["target_doc"], r["target_position"]) for r in resolved.collect()}
    assert where["title", "vite vid försening"] == ("R4", "d", 2) and where["section", "4.1"] == ("R1x", "k", 0)
    assert where["annex_name", "prislista"] == ("R5", "r", None) and where["question", "12"] == ("RQ", "q", 0)
    assert {k for kind, k in where if kind == "section"} == {"2.3", "9.9", "7.1", "7.2", "4.1"} and ("placeholder", "xx.x") in where
    got = {(r["kind"], r["key"]): (r["status"], r["rule"], r["target_doc"], r["replaces"]) for r in references.resolve(references.mentions(sections), sections, files).collect()}
    assert got["section", "2.3"] == ("resolved", "R1", "d", False)
    assert got["annex", "4"][:3] == ("resolved", "R3", "e")
    assert got["section", "9.9"] == ("unresolved", None, None, True)
    assert got["document", "allmänna villkor"][:2] == ("ambiguous", "R2")
    assert ("law", "2016:1145") in got and ("section", "3") not in got


def test_dates(spark):
    df = spark.createDataFrame([("d", 0, "Gäller 2024-01-01 – 2025-12-31, signerat 3 mars 2024, fel 2024-02-30.")], "doc string, position int, text string")
    r = df.filter("position = 0").select(references.dates_in(F.col("text")), references.period_in(F.col("text"))).first()
    assert [str(x) for x in r[0]] == ["2024-01-01", "2025-12-31", "2024-03-03"] and str(r[1]["end"]) == "2025-12-31"


def test_longest_prefix(spark):
    p = spark.createDataFrame([("d", "Vite vid försening ska"), ("d", "Viten")], "doc string, phrase string")
    t = spark.createDataFrame([("d", "Vite"), ("d", "Vite vid försening")], "doc string, title string")
    assert rows(references.longest_prefix(p, t, ["doc"]), "phrase", "title") == [("Vite vid försening ska", "Vite vid försening")]


def test_pages(spark):
    html = '<h1>IT  <b>drift</b></h1><a href="/x?v=1">x</a><a href="/x#t">y</a><h2 class="fakta-rubrik">Avtalsperiod</h2><p>2024-2025</p><div class="tbl-label">Avtal</div><div class="tbl-row"><a href="a.pdf">A</a></div><div class="tbl-row"><a href="b.pdf">B</a></div>'
    df = spark.createDataFrame([(1, "https://s.se/p/i", html)], "page_id int, url string, html string")
    assert rows(pages.links(df), "url")[0] == ("https://s.se/p/a.pdf",) and pages.links(df, "/x").count() == 1
    r = pages.agreement_pages(df).first()
    assert r["title"] == "IT drift" and r["facts"] == {"Avtalsperiod": "2024-2025"}
    assert [tuple(d) for d in r["documents"]] == [("Avtal", "A", "a.pdf"), ("Avtal", "B", "b.pdf")]


def test_insert_missing_keeps_stored(spark):
    s, n = spark.createDataFrame([(1, "old")], "k int, v string"), spark.createDataFrame([(1, "new"), (2, "b"), (2, "a")], "k int, v string")
    assert rows(merge.insert_missing(s, n, ["k"])) == [(1, "old"), (2, "a")]
    assert rows(merge.upsert(s, n.filter("v <> 'b'"), ["k"])) == [(1, "new"), (2, "a")]


def test_stream_merge(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(part, "k int, v string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k int, v string").parquet(source)
        increments.merged_into(stream, target, ["k"], str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.schema("k int, v string").option("recursiveFileLookup", True).parquet(target)) == [(1, "a"), (2, "b"), (3, "c")]


def test_register_file_over_several_splits(spark, tmp_path):
    from spandrel.sources import files

    path = tmp_path / "register.tsv"
    body = [f"23.3-{100 + i}-2021-001\tFirm {i} AB\t5566778899\tIT\tNord\t2021-01-01\t2024-01-01\t" for i in range(200)]
    path.write_text("\n".join(["A register", "\t".join(files.HEADER), *body[:100], "", *body[100:]]) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            title, raw = files.register_rows(spark, str(path))
            got = {r["source_row"]: r["agreement"] for r in raw.collect()}
            assert title == "A register" and len(got) == 200 and got[3] == "23.3-100-2021-001" and got[102] == "23.3-199-2021-001" and got[104] == "23.3-200-2021-001" and max(got) == 203
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    path.write_text("no\nheader\n", encoding="utf-8")
    with pytest.raises(ValueError, match="header"):
        files.register_rows(spark, str(path))


def test_accepted_findings_are_strict(spark, tmp_path):
    from spandrel.sources import files

    path = tmp_path / "accepted.toml"
    one = '[[accepted]]\nkey = "a:b:c"\nreason = "seen"\nreviewer = "N"\n'
    path.write_text(one, encoding="utf-8")
    assert rows(files.accepted_findings(spark, str(path))) == [("a:b:c", "seen", "N")]
    for bad in (one + one, one.replace('"seen"', '" "'), one + 'more = "x"\n', "[other]\na = 1\n"):
        path.write_text(bad, encoding="utf-8")
        with pytest.raises(ValueError):
            files.accepted_findings(spark, str(path))


def test_lookups_and_spellings(spark):
    from spandrel.operators import catalog

    agreements = spark.createDataFrame([("23.3.10-21:01", "23.3.10-21"), ("23.3-10-2021-002", "23.3-10-2021"), ("23.3-7777-2020-001", "23.3-7777-2020")], "agreement_number string, procurement_number string")
    assert catalog.spellings({"agreement": agreements}, "23.3-10-2021-001") == ["23.3.10-21:01"]
    assert catalog.spellings({"agreement": agreements}, "23.3-10-21") == ["23.3-10-2021", "23.3.10-21"]
    assert catalog.spellings({"agreement": agreements}, "23.3-10-2021-099") == ["23.3-10-2021", "23.3.10-21"]
    assert catalog.spellings({"agreement": agreements}, "23.3-1-2001-001") == []
    scope = spark.createDataFrame([("IT", "P1")], "framework_area string, procurement_number string")
    with pytest.raises(KeyError, match="food"):
        catalog.procurements_for_areas(scope, ["it", "food"])


def test_parties(spark):
    clause = "mellan Staten, organisationsnummer 202100-0829, nedan Staten, och {}, organisationsnummer {} nedan Leverantören."
    df = spark.createDataFrame(
        [
            ("a", 0, "text", "Avtal " + clause.format("Firma\nEtt AB", "556914-7720, med säte i Lund,")),
            ("b", 0, "text", "Avtal Mellan Byn, Org nr: 212000–4321, (nedan Byn), och Två AB,"),
            ("b", 1, "page_header", "mellan X, organisationsnummer"),
            ("b", 2, "text", "organisationsnummer 55691-4 nedan kallad ”Säljaren” " + clause.format("Tre AB", "XXXXXX-XXXX")),
            ("c", 0, "text", "avtal mellan Ett, organisationsnummer 1, nedan X"),
            ("c", 1, "text", None),
            ("c", 2, "text", "och Två, organisationsnummer 556914-7720, nedan Y"),
        ],
        "doc string, position int, kind string, text string",
    )
    got = rows(parties.find_parties(df), "doc", "position", "kind", "rule", "value", "name")
    assert got == [
        ("a", 0, "party", "E1", "556914-7720", "Firma Ett AB"),
        ("b", 0, "party", "E1-customer", "212000-4321", "Byn"),
        ("b", 2, "party", "E1", "55691-4", "Två AB"),
        ("b", 2, "placeholder", "E1", "party", "Tre AB"),
    ]
    assert parties.find_parties(df.filter("false")).count() == 0


def test_stems_are_counted_within_rows(spark):
    said = [(1, ["avtal", "avtalet", "vite"]), (2, ["viten", "2.1", "vite"]), (2, ["vite", "vite", "x"]), (2, ["vite"]), (3, []), (4, None), (5, [None, "avtalen"])]
    c = spark.createDataFrame(said, "chunk long, terms array<string>")
    for some in (c, c.filter("chunk <> 2")):
        counts = search.stem_counts(some)
        want = search.stems(search.term_counts(some))
        assert counts.dtypes == want.select(*counts.columns).dtypes and rows(counts) == rows(want, *counts.columns)
    plan = search.stem_counts(c.filter("chunk <> 2"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_postings_with_a_vocabulary_send_no_posting(spark):
    c = spark.createDataFrame([(1, ["avtal", "vite"]), (2, ["vite", "vite", "x"]), (3, [])], "chunk long, terms array<string>")
    counts = search.stem_counts(c)
    words = search.vocabulary(counts)
    assert rows(search.corpus_of(c, words)) == rows(search.corpus(c)) == [(3, 5 / 3)]
    got = search.postings(counts, search.corpus_of(c, words), vocabulary_=words)
    assert rows(got) == rows(search.postings(search.stems(search.term_counts(c)), search.corpus(c)))
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(search.corpus_of(c.filter("false"), search.vocabulary(search.stem_counts(c.filter("false"))))) == rows(search.corpus(c.filter("false")))


def test_query_postings_analyse_texts_once(spark):
    c = spark.createDataFrame([(1, "Avtal om vite"), (2, None)], "chunk long, text string").select("chunk", text.analysed(F.col("text")).alias("terms"))
    plan = search.query_postings(c, ["vit"])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_org_numbers_meet_in_one_pass(spark):
    facts = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", None), (None, "3")], "sha256 string, value string")
    suppliers = spark.createDataFrame([("a", "2"), ("a", "9"), ("b", None), (None, "3")], "sha256 string, org_number string")
    got = validation.org_numbers(facts, suppliers)
    assert rows(got, "sha256", "subject") == sorted([("a", "1"), ("b", None), (None, "3")], key=repr)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_citations_are_formed_once(spark):
    drafts = spark.createDataFrame([(1, 1, "a", 1, "Vite  ska\tbetalas –  alltid")], "draft long, id int, sha256 string, section_position long, quote string")
    sections = spark.createDataFrame([("a", 1, " Vite ska betalas - alltid\n\n")], "sha256 string, section_position long, text string")
    got = validation.citations(drafts, sections)
    assert rows(got) == []
    assert got._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 2


def test_visible_documents_find_once(spark):
    from spandrel.plans import registry
    from tests.conftest import SMALL

    assert "c_custkey" not in registry.QUERIES["visible_documents"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
