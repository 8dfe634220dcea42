"""Personal data by weak supervision, in DataFrame operations alone.

Patterns give candidate spans: the four base kinds (email, ip, card, phone),
which always stay, and loose ones, most of which are wrong: every assignment may
be a secret, every run of grouped digits a local phone or an account number,
every two capitalised words a name. Six labelers vote on every candidate: its
strict format, a gazetteer, the words before it that speak for it, those that
speak against it, a check of its digits or letters, and whether it stands alone.
Votes are counted per kind and pattern of votes, a table whose size doesn't
depend on the input; expectation-maximisation on it estimates how reliable each
labeler is and how often each kind is right, and its posteriors train the final
span classifier, a logistic regression over kind and votes. A loose candidate is
a span if the classifier says so and no base span overlaps it.

Offsets are in code points. A text is read once; its candidates and their votes
go to a table in the shared folder, from which votes are counted and spans chosen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.common import table, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "local_phone", "ssn", "iban", "account", "name")
#: First names of the gazetteer.
NAMES = (
    "James John Robert Michael William David Richard Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Betty Sandra Ashley Dorothy Kimberly Emily Donna Michelle Carol Amanda Laura Emma Olivia "
    "Hans Peter Klaus Wolfgang Jürgen Stefan Andreas Uwe Sabine Ursula Monika Petra Anna Heike Katrin Lukas Felix "
    "Pierre Jean Marie Jacques Michel Philippe Nicolas Sophie Isabelle Nathalie Catherine Camille Julien Louis Claire "
    "Juan Carlos Luis José Antonio Manuel Francisco Javier Miguel Carmen María Maria Ana Isabel Dolores Pilar Teresa Lucía Elena"
).split()
_NAMES = "|".join(NAMES)
_TITLES = r"Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora"
_WORD = r"\p{Lu}\p{Ll}{1,20}+"
_KEYS = r"password|passwd|passwort|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth"
#: A pattern starts where a run of its characters starts, or where the last match ended: what it would find from elsewhere, it finds from there.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\b[A-Za-z][A-Za-z0-9_-]{1,40}+\x20?[=:]\x20?\"?[A-Za-z0-9/+_.!#$%-]{8,}+\"?",
    "local_phone": r"(?<![0-9+(./-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[./-])[0-9]{2,5}(?:[\x20./-][0-9]{2,5}){0,3}+(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?\b",
    "account": r"(?<![0-9A-Za-z_+./-])[0-9]{2,}+(?:[\x20-][0-9]{2,}+)*+(?![0-9A-Za-z_./-])",
    "name": rf"(?:(?:{_TITLES})\x20)?+(?<!\p{{L}}){_WORD}(?:\x20{_WORD}){{1,2}}",
}
_FORMAT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "ip": r"^[1-9][0-9]{0,2}(\.[0-9]{1,3}){3}$",
    "card": r"^[0-9]{14,19}$|^[0-9]{4}([ -][0-9]{4}){3}$",
    "phone": r"^\+[0-9]{1,3}[ -]?(\([0-9]{2,4}\)|[0-9]{2,4})([ -]?[0-9]{2,4}){2,3}$",
    "secret": r"^(AKIA|ASIA)[0-9A-Z]{16}$|[=:] ?\"[^\"]{16,}\"$|[=:] ?(?=[^ ]*[0-9])(?=[^ ]*[A-Za-z])[A-Za-z0-9/+_-]{16,}$",
    "local_phone": r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$|^0[0-9]{1,4}[ /-][0-9]{3,5}([ -][0-9]{2,5}){0,2}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^(DE[0-9]{20}|FR[0-9]{2}[0-9A-Z]{23}|ES[0-9]{22}|GB[0-9]{2}[A-Z]{4}[0-9]{14}|IT[0-9]{2}[A-Z][0-9A-Z]{22}|SE[0-9]{22}|CH[0-9]{19}|AT[0-9]{18}|NL[0-9]{2}[A-Z]{4}[0-9]{10})$",
    "account": r"^[0-9]{4}([ -][0-9]{4}){1,4}$|^[0-9]{8,10}$",
    "name": rf"^({_TITLES}) ",
}
_GAZETTEER = {
    "email": r"\.(com|org|net|edu|gov|info|io|de|fr|es|it|uk|se|eu)$",
    "ip": r"^(?!0|127\.|255\.|224\.)",
    "card": r"^(3[47]|4|5[1-5]|2[2-7]|6)",
    "phone": r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": rf"^(?:AKIA|ASIA)[0-9A-Z]{{16}}$|(?i:^[a-z0-9_-]*(?:{_KEYS})[a-z0-9_-]* ?[=:])",
    "local_phone": r"^\(?[2-9][0-8][0-9]\)?[ .-]|^0[1-9]",
    "ssn": r"^[0-8]",
    "iban": r"^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IT|NL|NO|PL|SE)",
    "account": r"^(3[47]|4|5[1-5]|6)[0-9]{2}",
    "name": rf"^(?:(?:{_TITLES}) )?(?:{_NAMES}) ",
}
_CONTEXT = {
    "email": r"(?i)(e-?mail|mail|contact|write|address|@)",
    "ip": r"(?i)\b(ip|host|server|address|from)\b",
    "card": r"(?i)\b(card|visa|credit|account|payment|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(tel|phone|call|mobile|fax|telefon|téléphone|teléfono)\b",
    "secret": r"(?i)(key|secret|login|credential|auth|export|config|env)",
    "local_phone": r"(?i)\b(tel|phone|call|mobile|fax|telefon|téléphone|teléfono)\b",
    "ssn": r"(?i)\b(ssn|social|security)\b",
    "iban": r"(?i)\b(iban|account|konto|cuenta|compte|bank)\b",
    "account": r"(?i)\b(account|card|passport|konto|kontonummer|cuenta|compte|customer|patient|licen[cs]e no)\b",
    "name": r"(?i)\b(name|dear|by|author|contact|signed|regards|sincerely|called)\b",
}
_AGAINST = {
    "account": r"(?i)\b(orders?|invoice|isbn|version|no|nr|page|section|tracking|serial|product|about|over|total|year|population|of|the|and)[.:#]?\x20*$",
    "local_phone": r"(?i)\b(version|on|date|dated|since|until|between|in|score|ratio|page|pages|isbn|section)[.:]?\x20*$",
    "name": r"(?i)\b(the|in|of|at|from|near|a|an|to)\x20$",
    "secret": r"(?i)(https?|see|note|e\.g\.)\x20*$",
}
_AGAINST_ANY = r"(?i)\b(version|license|licence|section|chapter|page|figure|isbn|article|vol)\.?\x20?$"
#: Texts of a candidate that speak against it.
_UNLIKE = {
    "local_phone": r"^(19|20)[0-9]{2}[./-]|[./-](19|20)[0-9]{2}$|^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$",
    "secret": r"^(?i:https?|ftp|mailto|e-?mail|note|title|subject|date|name|url|doi|abstract|keywords|color|colour|style|class|type|id|version|see|about|re)\x20?[=:]",
    "name": r"\b(The|This|That|These|United|New|North|South|East|West|Saint|San|Los|Las|University|Street|River|Lake|Monday|January|In|On|At|And|But|It|He|She|We|You|They|For|From|With|To|Of|As|By|If|When)\b",
}
LABELERS = ("format", "gazetteer", "context", "against", "check", "alone")
#: Characters before a candidate that the context labelers read.
REACH = 30
#: Candidates that are appended to one array before the next is begun.
_PART = 500


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when((F.length(digits) - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.substring(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def _valid(kind: str, txt: Column) -> Column:
    """Whether a match of a base pattern counts; looser kinds are left to the classifier."""
    if kind == "ip":
        # A part of over three digits is at most 255 only with leading zeros.
        return F.forall(F.split(txt, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(r"^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(txt))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(_digits(txt))).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def iban_valid(txt: Column) -> Column:
    """Whether an account number passes the check by 97."""
    plain = F.replace(txt, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    code = lambda ch: F.when(ch.between("0", "9"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
    rest = F.aggregate(F.split(turned, "(?!^)"), F.lit(0), lambda a, ch: (a * F.when(ch.between("0", "9"), 10).otherwise(100) + code(ch)) % 97)
    return rest == 1


def _check(kind: str, txt: Column) -> Column:
    """1, -1 or 0: what the digits or letters of a candidate say."""
    n = F.length(_digits(txt))
    if kind == "card":
        return F.lit(1)
    if kind == "account":
        return F.when((n >= 8) & (n <= 19) & (F.size(F.array_distinct(F.split(_digits(txt), "(?!^)"))) > 2), F.when((n >= 14) & ~luhn(_digits(txt)), -1).otherwise(0)).otherwise(-1)
    if kind in ("phone", "local_phone"):
        return F.when((n >= (10 if kind == "phone" else 9)) & (n <= 13), 1).otherwise(-1)
    if kind == "secret":
        value = F.regexp_extract(txt, r"[=:]\x20?\"?([^\"]+)\"?$", 1)
        value = F.when(value == "", txt).otherwise(value)
        return F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(r"^[0-9.]+[A-Za-z]{1,3}$"), 1).otherwise(-1)
    if kind == "iban":
        return F.when(iban_valid(txt), 1).otherwise(-1)
    return F.lit(0)


def _votes(kind: str, txt: Column, before: Column, after: Column) -> Column:
    """The labelers' votes on a candidate: 1 for, -1 against, 0 none."""
    against = before.rlike(_AGAINST_ANY)
    if kind in _AGAINST:
        against = against | before.rlike(_AGAINST[kind])
    if kind in _UNLIKE:
        against = against | txt.rlike(_UNLIKE[kind])
    alone = (before == "") | before.rlike(r"[\s(\[\"',;:]$")
    return F.array(
        F.when(txt.rlike(_FORMAT[kind]), 1).otherwise(-1),
        F.when(txt.rlike(_GAZETTEER[kind]), 1).otherwise(-1),
        F.when(before.rlike(_CONTEXT[kind]), 1).otherwise(0),
        F.when(against, -1).otherwise(0),
        _check(kind, txt),
        F.when(alone & ((after == "") | after.rlike(r"[\s)\]\"',;:.!?]")), 1).otherwise(-1),
    )


_CANDIDATE = "struct<start:int,kind:int,end:int,votes:array<int>>"


def _found(kind: str) -> Column:
    """array<struct<start, kind, end, votes>> of one kind in column text, leftmost and not overlapping.

    The text between two matches is what the labelers read around them. Matches
    are gathered in parts, so that their number costs no more than in proportion.
    """
    pattern = F.lit(PATTERNS[kind])
    gaps, found = F.split("text", pattern, -1), F.regexp_extract_all("text", pattern, F.lit(0))
    none = F.array().cast(f"array<{_CANDIDATE}>")
    nothing = F.lit(None).cast("struct<start:int,end:int,txt:string,before:string>")

    def step(a: Column, x: Column) -> Column:
        last, start = a["last"], a["at"] + F.length(x["gap"])
        made = F.struct(last["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), last["end"].alias("end"), _votes(kind, last["txt"], last["before"], F.left(x["gap"], F.lit(1))).alias("votes"))
        good = last.isNotNull() & _valid(kind, last["txt"])
        full = F.size(a["part"]) >= _PART
        begun = F.when(full, none).otherwise(a["part"])
        return F.struct(
            (start + F.coalesce(F.length(x["txt"]), F.lit(0))).alias("at"),
            F.when(good, F.concat(begun, F.array(made))).otherwise(begun).alias("part"),
            F.when(full, F.concat(a["parts"], F.array(a["part"]))).otherwise(a["parts"]).alias("parts"),
            F.when(x["txt"].isNotNull(), F.struct(start.alias("start"), (start + F.length(x["txt"])).alias("end"), x["txt"].alias("txt"), F.right(x["gap"], F.lit(REACH)).alias("before"))).otherwise(nothing).alias("last"),
        )

    begin = F.struct(F.lit(0).alias("at"), none.alias("part"), F.array().cast(f"array<array<{_CANDIDATE}>>").alias("parts"), nothing.alias("last"))
    placed = F.aggregate(F.arrays_zip(gaps.alias("gap"), found.alias("txt")), begin, step, lambda a: F.flatten(F.concat(a["parts"], F.array(a["part"]))))
    digit = F.col("digit")
    sign = {
        "email": F.col("text").contains("@"),
        "phone": F.col("text").contains("+") & digit,
        "ip": digit & F.col("text").rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": digit & F.col("text").rlike(r"(?:[0-9][\x20-]?+){14}"),
        "account": digit & F.col("text").rlike(r"(?:[0-9][\x20-]?+){8}"),
        "local_phone": digit & F.col("text").rlike(r"[0-9][)./-]\x20?[0-9]"),
        "ssn": digit & F.col("text").rlike(r"[0-9]-[0-9]{2}-[0-9]"),
        "iban": digit & F.col("text").rlike(r"\b[A-Z]{2}[0-9]{2}"),
        "secret": F.col("text").rlike(r"AKIA|ASIA|[A-Za-z0-9_-]\x20?[=:]\x20?\"?[A-Za-z0-9/+_.!#$%-]{8}"),
        "name": F.col("text").rlike(rf"{_WORD}\x20{_WORD}"),
    }
    return F.when(sign[kind], placed).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, in a struct row, and base and loose: arrays of struct<start, kind, end, votes>, by start and kind."""
    others = [c for c in docs.columns if c != "text"]
    text = docs.select(F.struct(*others).alias("row") if others else F.struct(F.lit(0)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digit", F.col("text").rlike("[0-9]"))
    drawn = text.select("row", F.array_sort(F.concat(*[_found(k) for k in BASE])).alias("base"), F.array_sort(F.concat(*[_found(k) for k in KINDS[len(BASE) :]])).alias("loose"))
    free = F.filter("loose", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return drawn.withColumn("loose", F.when(F.size("base") > 0, free).otherwise(F.col("loose")))


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> tuple[dict, dict]:
    """EM over (kind, votes, count): P(vote | class) per labeler, and the share of true candidates per kind.

    A labeler starts, and is held by pseudo-counts of a tenth of the votes, at
    being right more often than not.
    """
    total = sum(n for *_, n in counts)
    hold = max(4.0, total / 10)
    prior = {(j, y, v): hold * (0.6 if (v > 0) == y and v else 0.1 if v else 0.3) for j in range(len(LABELERS)) for y in (False, True) for v in (-1, 0, 1)}
    theta = {k: w / sum(prior[k[0], k[1], v] for v in (-1, 0, 1)) for k, w in prior.items()}
    share = {kind: 0.5 for kind, *_ in counts}
    for _ in range(rounds):
        soft, weight = dict(prior), {(kind, y): 1.0 for kind in share for y in (False, True)}
        for kind, votes, n in counts:
            p = posterior(votes, theta, share[kind])
            for y, part in ((True, p), (False, 1 - p)):
                weight[kind, y] += n * part
                for j, v in enumerate(votes):
                    soft[j, y, v] += n * part
        theta = {k: w / sum(soft[k[0], k[1], v] for v in (-1, 0, 1)) for k, w in soft.items()}
        share = {kind: weight[kind, True] / (weight[kind, True] + weight[kind, False]) for kind in share}
    return theta, share


def posterior(votes: tuple[int, ...], theta: dict, share: float) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(theta[j, True, v] / theta[j, False, v]) for j, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def span_classifier(counts: list[tuple[int, tuple[int, ...], int]], steps: int = 600) -> list[float]:
    """Weights (bias, one per vote, one per kind) of a logistic regression on the posteriors; kinds weigh the same."""
    theta, share = reliabilities(counts)
    width = 1 + len(LABELERS) + len(KINDS)
    of_kind: dict[int, int] = {}
    for kind, _, n in counts:
        of_kind[kind] = of_kind.get(kind, 0) + n
    weights = [0.0] * width
    rows = [([1.0, *map(float, votes), *(float(kind == k) for k in range(len(KINDS)))], posterior(votes, theta, share[kind]), n / of_kind[kind] / len(of_kind)) for kind, votes, n in counts]
    for _ in range(steps):
        slope = [0.001 * w for w in weights]
        for x, p, n in rows:
            error = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(a * b for a, b in zip(weights, x, strict=True)))))) - p
            for i, value in enumerate(x):
                slope[i] += n * error * value
        weights = [w - 1.0 * s for w, s in zip(weights, slope, strict=True)]
    return weights


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of docs: row, a struct of its columns but text, and base and spans, arrays of struct<start, kind, end> by start and kind.

    A null or empty text has no spans; equal rows each have their own; an empty
    table gives no rows; the docs' columns may have any names.
    """
    drawn = written(candidates(docs), "candidates")
    both = drawn.select(F.explode(F.concat("base", "loose")).alias("x"))
    counts = [(r["kind"], tuple(r["votes"]), r["count"]) for r in both.groupBy("x.kind", "x.votes").count().collect()]  # at most kinds x 3 ** labelers
    chosen = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    if counts:
        w = span_classifier(sorted(counts))
        score = lambda x: F.lit(w[0]) + sum((x["votes"][j] * F.lit(w[1 + j]) for j in range(len(LABELERS))), F.lit(0.0)) + F.element_at(F.array(*[F.lit(v) for v in w[1 + len(LABELERS) :]]), x["kind"] + 1)
        chosen = plain(F.filter("loose", lambda x: score(x) > 0))
    return drawn.select("row", plain(F.col("base")).alias("base"), F.array_sort(F.concat(plain(F.col("base")), chosen)).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span of column text replaced by its kind in angle brackets; overlapping spans become one.

    A null text stays null.
    """
    found = personal_data(docs.select(F.struct(*docs.columns).alias("whole"), "text"))
    text = F.col("row.whole.text")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    # Pieces are listed, in parts, and joined once.
    empty, parts = F.array().cast("array<string>"), F.array().cast("array<array<string>>")

    def step(a: Column, x: Column) -> Column:
        full, new = F.size(a["part"]) >= _PART, x["start"] >= a["upto"]
        begun = F.when(full, empty).otherwise(a["part"])
        piece = F.array(F.substring(text, a["upto"] + 1, x["start"] - a["upto"]), F.element_at(names, x["kind"] + 1))
        return F.struct(F.greatest(a["upto"], x["end"]).alias("upto"), F.when(new, F.concat(begun, piece)).otherwise(begun).alias("part"), F.when(full, F.concat(a["parts"], F.array(a["part"]))).otherwise(a["parts"]).alias("parts"))

    begin = F.struct(F.lit(0).alias("upto"), empty.alias("part"), parts.alias("parts"))
    out = F.aggregate("spans", begin, step, lambda a: F.concat(F.array_join(F.flatten(F.concat(a["parts"], F.array(a["part"]))), ""), F.substring(text, a["upto"] + 1, F.length(text) - a["upto"])))
    plain = [F.col(f"row.whole.{c}").alias(c) for c in docs.columns]
    new_text = F.when(F.size("spans") > 0, out).otherwise(text).alias("text")
    return found.select(*[new_text if c == "text" else x for c, x in zip(docs.columns, plain, strict=True)])


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("row.doc_id", *[count(k) for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
