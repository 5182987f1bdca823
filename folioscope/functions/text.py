"""Text functions as Column expressions. Nothing here runs Python on the executors.

Patterns are Java's; (?U) makes classes like \\w take all of Unicode.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L

_JOINT = "\u0001"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use refers to it, inside
    lambdas above all, where it would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def explode_once(df: DataFrame, items: str, *more: str | Column) -> DataFrame:
    """more, and a row for each element of the array items under its name. A plain
    explode() has the array computed twice, as arrays that are empty are filtered out
    before it; here their rows are dropped behind it."""
    return df.select(*more, F.posexplode_outer(items).alias("_at", items)).filter("_at is not null").drop("_at")


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("int")


def alternation(terms: Iterable[str]) -> str:
    """Terms as a pattern, longest first; signs are taken literally."""
    return "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))


def words(text: Column, pattern: str = L.WORD_PATTERN) -> Column:
    return extract_all(text, pattern)


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085  ]", -1)


def squeeze(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column, abbreviations: Iterable[str] = L.ABBREVIATIONS) -> Column:
    """Sentences end at . ! ? before white space and a capital, digit, quote or
    bracket, but not behind an abbreviation."""
    pieces = F.split(text, r"""(?U)(?<=[.!?])\s+(?=["'(A-Z0-9])""", -1)
    pieces = F.filter(F.transform(pieces, strip), lambda p: p != "")
    last = list(abbreviations)

    def joined(found: Column) -> Column:
        def lead(p: Column, i: Column) -> Column:
            before = F.lower(F.regexp_extract(F.get(found, i - 1), r"(?U)(\S+)$", 1))
            return F.concat(F.when(i == 0, "").when(before.isin(*last), " ").otherwise(_JOINT), p)

        return F.array_join(F.transform(found, lead), "")

    return F.filter(F.split(let(pieces, joined), _JOINT, -1), lambda s: s != "")


def ambiguous_terms(text: Column, terms: Iterable[str] = L.AMBIGUOUS_TERMS) -> Column:
    found = extract_all(text, rf"(?iU)(?<![\w-])(?:{alternation(terms)})(?![\w-])")
    return F.transform(found, F.lower)


def count_passive(text: Column, pattern: str = L.PASSIVE_PATTERN) -> Column:
    return count(text, "(?iU)" + pattern)


def starts_with_verb(text: Column, verbs: Iterable[str] = L.IMPERATIVES) -> Column:
    return F.lower(F.regexp_extract(text, r"[A-Za-z']+", 0)).isin(*verbs)


def count_nominalizations(text: Column, suffixes: Iterable[str] = L.NOMINAL_SUFFIXES) -> Column:
    ends = F.transform(extract_all(F.lower(text), "[a-z]{6,}"), lambda w: reduce(lambda a, s: a | w.endswith(s), suffixes, F.lit(False)))
    return F.size(F.filter(ends, lambda e: e))


def modal_counts(text: Column, modals: Iterable[str] = L.MODALS) -> Column:
    """A struct with a count for each modal, named by the modal."""
    return F.struct(*[count(text, rf"(?iU)\b{re.escape(m)}\b").alias(m) for m in modals])


def syllables(word: Column) -> Column:
    """Runs of vowels, without a final e, at least one."""
    w = F.lower(word)
    n = F.regexp_count(w, F.lit("[aeiouy]+")).cast("int")
    return F.greatest(F.lit(1), n - F.when((n > 1) & w.endswith("e"), 1).otherwise(0))


def total_syllables(words_: Column) -> Column:
    return F.aggregate(words_, F.lit(0), lambda a, w: a + syllables(w))


def flesch_kincaid(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """0 without words; not clamped."""
    grade = 0.39 * n_words / F.greatest(n_sentences, F.lit(1)) + 11.8 * n_syllables / n_words - 15.59
    return F.when(n_words > 0, grade).otherwise(0.0)


def gunning_fog(n_words: Column, n_sentences: Column, n_complex: Column) -> Column:
    return F.when(n_words > 0, 0.4 * (n_words / F.greatest(n_sentences, F.lit(1)) + 100.0 * n_complex / n_words)).otherwise(0.0)


def coleman_liau(n_words: Column, n_sentences: Column, n_letters: Column) -> Column:
    return F.when(n_words > 0, 5.88 * n_letters / n_words - 29.6 * n_sentences / n_words - 15.8).otherwise(0.0)


def sentence_count(text: Column, found: Column | None = None) -> Column:
    """Sentences, or final marks if there are more, at least one."""
    marks = F.regexp_count(text, F.lit(r"(?U)[.!?](?=\s|$)")).cast("int")
    return F.greatest(F.size(sentences(text) if found is None else found), marks, F.lit(1))


def cross_references(text: Column, own: Column, pattern: str = L.DOCUMENT_ID_PATTERN) -> Column:
    return F.array_distinct(F.array_remove(extract_all(text, pattern), own))


def shingles(words_: Column, size: int = 5) -> Column:
    """The set of runs of size words, which hold no white space; a shorter text is one
    run, none has none. Runs are looked ahead for in the joined words: lambdas over
    slices cost several times that."""
    run = rf"(?<!\S)(?=(\S++(?: \S++){{{size - 1}}}))"

    def runs(low: Column) -> Column:
        short = F.when(low != "", F.array(low)).otherwise(F.array().cast("array<string>"))
        return let(extract_all(low, run, 1), lambda found: F.when(F.size(found) > 0, found).otherwise(short))

    return F.array_distinct(let(F.lower(F.array_join(words_, " ")), runs))


def heading_style(headings: Column) -> Column:
    """numbered_plain, roman, allcaps, markdown, or none without headings."""
    return let(F.transform(headings, strip), _style_of)


def _style_of(h: Column) -> Column:
    n = F.size(h)
    steps = F.size(F.filter(h, lambda x: x.rlike(r"(?iU)^step\s+\d+\s*:")))
    roman = F.size(F.filter(h, lambda x: x.rlike(r"(?U)^\(?[IVXLC]+[\).\s]")))
    caps = F.size(F.filter(h, is_upper))
    return (
        F.when(n == 0, "none")
        .when(steps >= n * 0.4, "numbered_plain")
        .when(roman >= n * 0.4, "roman")
        .when(caps >= n * 0.5, "allcaps")
        .otherwise("markdown")
    )


def is_upper(text: Column, letters: int = 4) -> Column:
    return (text == F.upper(text)) & (F.regexp_count(text, F.lit(r"\p{L}")) >= letters)


def overdue(next_review: Column, as_of: str) -> Column:
    """Whether an ISO date lies before as_of; false for anything else."""
    return F.coalesce(F.try_to_date(next_review, "yyyy-M-d") < F.to_date(F.lit(as_of)), F.lit(False))


def _decomposed() -> tuple[str, str]:
    """Characters of all scripts that are a letter or sign with marks, or another form of
    one, and what is left of them: by the rule of compatibility decomposition."""
    pairs = []
    for k in range(0x80, 0x10000):
        left = "" if 0xD800 <= k < 0xE000 else "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(c))
        if len(left) == 1 and left != chr(k):
            pairs.append((chr(k), left))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _decomposed()


def strip_accents(text: Column) -> Column:
    """Letters without their accents, in lower case, in any script."""
    return F.lower(F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{M}+", ""))


def canonical_unit(unit: Column) -> Column:
    u = F.lower(unit)
    return F.when(u.startswith("min"), "min").when(u.isin("degrees", "grados", "°"), "deg").otherwise(u)


def values_with_units(text: Column) -> Column:
    """Array of (value, unit): numbers with a point or comma before %, ml, minutes
    or degrees."""
    pattern = r"(?iU)(\d+(?:[.,]\d+)?)\s*(%|ml|minutes|minutos|min|degrees|grados|°)"
    numbers, units = extract_all(text, pattern, 1), extract_all(text, pattern, 2)
    return F.zip_with(
        numbers,
        units,
        lambda v, u: F.struct(F.round(F.translate(v, ",", ".").cast("double"), 3).alias("value"), canonical_unit(u).alias("unit")),
    )


def safety_headings(headings: Column, keys: Iterable[str] = L.SAFETY_WORDS) -> Column:
    found = F.filter(headings, lambda h: strip_accents(h).rlike("|".join(keys)))
    return F.transform(found, lambda h: strip(F.regexp_replace(h, r"^\s*\d+(?:\.\d+)*\.?\s*", "")))


def plain_language(text: Column) -> Column:
    """Operator-facing wording: no emphasis, no "the operator will", no future passive."""
    s = squeeze(F.regexp_replace(text, r"\*\*(.*?)\*\*", "$1"))
    for pattern, put in ((r"^The operator will\s+", ""), (r"^The operator\s+", ""), (r"\bwill be\b", "is"), (r"\bshall be\b", "must be")):
        s = F.regexp_replace(s, pattern, put)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2**31 - 1))


def cloze(sentence: Column, answer: Column) -> Column:
    """The first occurrence of answer becomes a blank."""
    at = F.instr(sentence, answer)
    return F.when(at > 0, F.overlay(sentence, F.lit("_____"), at, F.length(answer))).otherwise(sentence)


def strip_numbering(heading: Column) -> Column:
    return strip(F.regexp_replace(heading, r"^\s*(?:\d+(?:\.\d+)*\.?|[IVXL]{1,6}\.)\s+", ""))


def short_id(id_: Column, prefix: str = "SOP-") -> Column:
    return F.replace(id_, F.lit(prefix), F.lit(""))


def masked_key(text: Column, id_pattern: str = L.DOCUMENT_ID_PATTERN) -> Column:
    """A line's recurring form: ids as <id>, digits as #, white space squeezed."""
    return F.lower(F.regexp_replace(F.regexp_replace(squeeze(text), id_pattern, "<ID>"), r"\d+", "#"))


# Names of months.
_MONTHS = {
    "jan": 1, "january": 1, "ene": 1, "enero": 1, "feb": 2, "february": 2, "febrero": 2, "mar": 3, "march": 3, "marzo": 3, "apr": 4, "april": 4,
    "abr": 4, "abril": 4, "may": 5, "mayo": 5, "jun": 6, "june": 6, "junio": 6, "jul": 7, "july": 7, "julio": 7, "aug": 8, "august": 8, "ago": 8,
    "agosto": 8, "sep": 9, "sept": 9, "september": 9, "septiembre": 9, "setiembre": 9, "oct": 10, "october": 10, "octubre": 10, "nov": 11,
    "november": 11, "noviembre": 11, "dec": 12, "december": 12, "dic": 12, "diciembre": 12,
}


def parse_date(text: Column) -> Column:
    """A struct (iso, note): ISO, "5 March 2024", "March 5, 2024", "5 de marzo de
    2024" and d/m/y, where an ambiguous day and month is read as day first and noted."""
    s = squeeze(text)
    months = F.create_map(*[F.lit(x) for pair in _MONTHS.items() for x in pair])

    def number(name: Column) -> Column:
        return F.try_element_at(months, F.lower(name))

    def made(year: Column, month: Column, day: Column) -> Column:
        return F.date_format(F.try_to_date(F.format_string("%s-%s-%s", year, month.cast("string"), day), "yyyy-M-d"), "yyyy-MM-dd")

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(s, pattern, k)

    iso, dmy = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{1,2})[ -]([A-Za-z]{3,})\.?[ -](\d{4})$"
    mdy, es = r"^([A-Za-z]{3,})\.? (\d{1,2}),? (\d{4})$", r"(?i)^(\d{1,2}) de ([a-z]+) de (\d{4})$"
    slash = r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4})$"
    a, b = part(slash, 1).try_cast("int"), part(slash, 2).try_cast("int")
    found = (
        F.when(s.rlike(iso), made(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(s.rlike(dmy), made(part(dmy, 3), number(part(dmy, 2)), part(dmy, 1)))
        .when(s.rlike(mdy), made(part(mdy, 3), number(part(mdy, 1)), part(mdy, 2)))
        .when(s.rlike(es), made(part(es, 3), number(part(es, 2)), part(es, 1)))
        .when(s.rlike(slash), made(part(slash, 3), b, a.cast("string")))
    )
    found = F.when(s.rlike(slash) & (b > 12), made(part(slash, 3), a, b.cast("string"))).otherwise(found)
    note = F.when(s.rlike(slash) & (a <= 12) & (b <= 12) & (a != b), "day and month are ambiguous; read as day first")
    return F.struct(found.alias("iso"), note.alias("note"))


def sniff_language(text: Column, first: int = 800, least: int = 8) -> Column:
    """es, en or an empty string, from frequent words among the first words."""

    def told(low: Column) -> Column:
        n = {lang: _hits(low, marks) for lang, marks in L.LANGUAGE_MARKS.items()}
        return F.when((n["es"] >= least) & (n["es"] > 1.5 * n["en"]), "es").when(n["en"] >= least, "en").otherwise("")

    return let(F.slice(F.transform(words(text), F.lower), 1, first), told)


def _hits(low: Column, marks: Iterable[str]) -> Column:
    return F.size(F.filter(low, lambda w: w.isin(*marks)))


def sentence_case_join(parts: Column, separator: str = ", ", empty: str = "none") -> Column:
    return F.when(F.size(parts) > 0, F.array_join(parts, separator)).otherwise(empty)
