"""Text functions: tokens, stems, hashes, normal forms, quotes and excerpts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The Swedish stop words of PostgreSQL 17, and two auxiliary verbs.
STOP_WORDS = """
och det att i en jag hon som han på den med var sig för så till är men ett om hade de av
icke mig du henne då sin nu har inte hans honom skulle hennes där min man ej vid kunde
något från ut när efter upp vi dem vara vad över än dig kan sina här ha mot alla under
någon eller allt mycket sedan ju denna själv detta åt utan varit hur ingen mitt ni bli
blev oss din dessa några deras blir mina samma vilken er sådan vår blivit dess inom
mellan sådant varför varje vilka ditt vem vilket sitta sådana vart dina vars vårt våra
ert era vilkas ska skall
""".split()  # noqa: SIM905
# Tokens, tried in this order; all but the last begin with a digit.
TOKEN = (
    r"(?U)(?=\d)(?:23\.\d[-–.]\d{2,7}[-–]\d{2,4}(?:[-–:]\d{2,3}(?:-[a-z])?)?(?![\p{L}\p{N}])|9\d-\d{1,6}-(?:19|20)\d{2}(?![\p{L}\p{N}])"
    r"|\d{4}-\d{2}-\d{2}(?![\p{L}\p{N}])|\d{6}-\d{4}(?![\p{L}\p{N}])|\d+(?:\.\d+)+)|[\p{L}\p{N}]+"
)
#: Letters that two code points can spell: only texts with combining marks need composing.
_MARKS = r"[̀-ͯ]"


@F.pandas_udf(T.StringType())
def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def _nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _where(needed: Column, text: Column, form: Callable[[Column], Column]) -> Column:
    """form(text) where needed, else text. Spark evaluates a Python function for all rows, so that the others are passed as nulls."""
    return F.when(needed, form(F.when(needed, text))).otherwise(text)


def nfc(text: Column) -> Column:
    return _where(text.rlike(_MARKS), text, _nfc)


def words(text: Column) -> Column:
    """array<string>: identifiers, dates and section numbers whole, and runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def plain_words(text: Column) -> Column:
    """array<string>: runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def without_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(STOP_WORDS))


def analysed(text: Column) -> Column:
    """array<string>: what a search index counts of a text, but for stems: composed, in lower case, without stop words. Null gives none."""
    return without_stop_words(words(nfc(F.coalesce(text, F.lit("")))))


# The Swedish Snowball stemmer (https://snowballstem.org/algorithms/swedish/stemmer.html).
VOWELS = "aeiouyäåö"
S_ENDING = "bcdfghjklmnoprtvy"
ENDINGS = sorted(
    "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split(), key=len, reverse=True
)


# Stems after which "et" stays.
KEEP_ET = tuple("h iet uit fab cit dit alit ilit mit nit pit rit sit tit ivit kvit xit kom rak pak stak".split())


def _ends_in_et(word: str, region: int) -> bool:
    """Whether a word ends in the article "et", after a consonant and a vowel somewhere before."""
    head = word[:-2]
    return word.endswith("et") and len(head) >= region and head[-1] not in VOWELS and any(c in VOWELS for c in head[:-1]) and not head.endswith(KEEP_ET)


def stem(word: str) -> str:
    """The stem of a lower-case word of letters."""
    first = next((i for i in range(1, len(word)) if word[i] not in VOWELS and word[i - 1] in VOWELS), None)
    if first is None:
        return word
    region = max(first + 1, 3)
    ending = next((e for e in ENDINGS if word.endswith(e) and len(word) - len(e) >= region), None)
    plural = word.endswith("s") and len(word) > region and len(word) > 1 and word[-2] in S_ENDING
    if ending:
        word = word[: -len(ending)]
    elif _ends_in_et(word, region):
        word = word[:-2]
    elif plural:
        word = word[:-1]
    if word[-2:] in ("dd", "gd", "nn", "dt", "gt", "kt", "tt") and len(word) - 2 >= region:
        word = word[:-1]
    for old, new in (("fullt", "full"), ("löst", "lös"), ("lig", ""), ("els", ""), ("ig", "")):
        if word.endswith(old) and len(word) - len(old) >= region:
            return word[: -len(old)] + new
    return word


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def stemmed(term: Column) -> Column:
    """Stems of words of letters, as stem(); other tokens as they are. Dear enough to be applied to distinct terms."""
    v, not_v = f"[{VOWELS}]", f"[^{VOWELS}]"
    less = lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    ends = lambda w, pattern: F.length(F.regexp_extract(w, f"(?:{pattern})$", 0))

    def from_region(region: Column) -> Column:
        after = lambda w: F.substring(w, region + 1, F.length(w))

        def first(rest: Column) -> Column:
            head = less(term, 2)
            article = rest.endswith("et") & head.rlike(f"{v}.*{not_v}$") & ~head.rlike(f"(?:{'|'.join(KEEP_ET)})$")
            plural = rest.endswith("s") & term.rlike(f"[{S_ENDING}]s$")
            return _let(ends(rest, "|".join(ENDINGS)), lambda n: F.when(n > 0, less(term, n)).when(article, head).when(plural, less(term, 1)).otherwise(term))

        def third(word: Column) -> Column:
            return _let(after(word), lambda rest: F.when(rest.rlike("(?:fullt|löst)$"), less(word, 1)).otherwise(less(word, ends(rest, "lig|els|ig"))))

        one = _let(after(term), first)
        return _let(_let(one, lambda w: F.when(after(w).rlike("(?:dd|gd|nn|[dgkt]t)$"), less(w, 1)).otherwise(w)), third)

    until = F.length(F.regexp_extract(term, f"^{not_v}*{v}+{not_v}", 0))
    return F.when(term.rlike(r"^\p{L}+$"), _let(until, lambda n: F.when(n > 0, _let(F.greatest(n, F.lit(3)), from_region)).otherwise(term))).otherwise(term)


def section_hash(text: Column, number: Column) -> Column:
    """sha256 of a section without its own number and with white space collapsed, so that copies share it."""
    rest = F.substr(text, F.length(number) + 1)
    own = number.isNotNull() & (number != "") & text.startswith(number) & rest.rlike(r"^\.?(\s|$)")
    body = F.when(own, F.regexp_replace(rest, r"^\.(?=\s|$)", "")).otherwise(text)
    return F.sha2(F.trim(F.regexp_replace(body, r"(?U)\s+", " ")), 256)


def embedded_text(header: Column, text: Column) -> Column:
    return F.concat(header, F.lit("\n\n"), text)


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


# Quote marks and dashes, and what they are compared as.
_FROM, _TO = "“”„«»‘’‚‹›‐‑‒–—−", "\"\"\"\"\"'''''------"


def quote_form(text: Column, compose: bool = False) -> Column:
    """The form in which quotes are compared: ASCII quote marks and dashes, no soft hyphens, single spaces, lower case.

    compose also applies Unicode's NFKC, where a text has characters that need it.
    """
    if compose:
        text = _where(text.rlike(r"[^\x00-\xFF]|[ ª²-¾]"), text, _nfkc)
    # Characters are translated one by one, and blanks written anew, only where there is something to change.
    plain = _let(F.regexp_replace(text, "­\\s*", ""), lambda t: F.when(t.rlike(f"[{_FROM}]"), F.translate(t, _FROM, _TO)).otherwise(t))
    return F.lower(F.trim(F.regexp_replace(plain, r"(?U)\s{2,}|[^\S ]", " ")))


def trim_quote(quote: Column) -> Column:
    edge = "(?:[\\s\"'“”„«»‘’‚‹›…]|\\.\\.\\.)+"
    return F.regexp_replace(quote, f"^{edge}|{edge}$", "")


def markers(text: Column) -> Column:
    """array<int>: the distinct source numbers that a text refers to, as [1] or [1, 2], in order."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([0-9]+(?:\s*,\s*[0-9]+)*)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda n: n.cast("int"))))))


def letters_and_digits(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def title_form(title: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.lower(title), r"[ .:]+$", ""))


# Words for company forms, which supplier names are compared without.
COMPANY_FORMS = "ab aktiebolag hb kb as a/s aps oy ltd limited inc gmbh publ filial sverige sweden".split()


def company_form(name: Column) -> Column:
    """A supplier name in lower case, without punctuation and company forms."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(name, r"[().,&]", " ")), r"\s+"), lambda w: (w != "") & ~w.isin(COMPANY_FORMS))
    return F.array_join(parts, " ")


def dotted(number: Column) -> Column:
    """array<int> of a dotted number: "6.21.4" -> [6, 21, 4]."""
    return F.transform(F.split(F.regexp_replace(number, r"\.$", ""), r"\."), lambda x: x.cast("int"))


def context_header(agreement: Column, document: Column, path: Column) -> Column:
    return F.concat_ws(" › ", agreement, document, path)


def excerpt(text: Column, start: Column, end: Column, size: int = 400) -> Column:
    """At most about `size` characters around [start, end) (0-based), cut between words, with ellipses."""
    room = F.greatest(F.lit(size) - (end - start), F.lit(0))
    low, high = F.greatest(start - F.floor(room / 2), F.lit(0)).cast("int"), F.least(end + F.floor(room / 2), F.length(text)).cast("int")
    part = F.substring(text, low + 1, high - low)
    part = F.when(low > 0, F.concat(F.lit("… "), F.regexp_replace(part, r"^\S*\s", ""))).otherwise(part)
    return F.when(high < F.length(text), F.concat(F.regexp_replace(part, r"\s\S*\z", ""), F.lit(" …"))).otherwise(part)


# Swedish number words.
_ONES = "noll en två tre fyra fem sex sju åtta nio tio elva tolv tretton fjorton femton sexton sjutton arton nitton".split()
_TENS = "tjugo trettio fyrtio femtio sextio sjuttio åttio nittio".split()


def number_words() -> dict[str, int]:
    found = {w: i for i, w in enumerate(_ONES) if i} | {"ett": 1}
    for i, ten in enumerate(_TENS):
        found[ten] = 20 + 10 * i
        found |= {ten + w: 20 + 10 * i + j for j, w in enumerate(_ONES[:10]) if j} | {ten + "ett": 21 + 10 * i}
    return found


def number_of(word: Column) -> Column:
    """1 to 99 from digits or a Swedish number word; null for anything else."""
    known = F.create_map(*[x for w, n in number_words().items() for x in (F.lit(w), F.lit(n))])
    return F.coalesce(word.try_cast("int"), F.element_at(known, F.lower(word)))
