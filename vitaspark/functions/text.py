"""Text columns: tokens, cleaning, quality, truncation, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import extract_all, let
from .lexicon import REDACTED

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case word tokens in order."""
    return extract_all(F.lower(text), TOKEN)


def phrase_key(text: Column) -> Column:
    """Tokens joined by one blank, the form phrases are compared in."""
    return F.array_join(tokens(text), " ")


# A word edge for any script; also right for terms that begin or end with a sign (c++, .net).
EDGE_BEFORE = r"(?<![\p{L}\p{N}_])"
EDGE_AFTER = r"(?![\p{L}\p{N}_])"


def _escape(term: str) -> str:
    return "".join("\\" + c if c in r".+*?()[]{}|^$\-#" else c for c in term)


def word_terms(text: Column, terms: list[str], ignore_case: bool = True) -> Column:
    """Terms found as whole words, in list order, from one scan of the text."""
    folded = [t.lower() for t in terms] if ignore_case else terms
    longest_first = sorted(folded, key=len, reverse=True)
    pattern = EDGE_BEFORE + "(" + "|".join(_escape(t) for t in longest_first) + ")" + EDGE_AFTER
    found = F.array_distinct(extract_all(F.lower(text) if ignore_case else text, pattern, 1))
    chosen = F.array(*[F.lit(t) for t in terms])
    return let(found, lambda f: F.filter(chosen, lambda t: F.array_contains(f, F.lower(t) if ignore_case else t)))


def substring_terms(text: Column, terms: list[str]) -> Column:
    """Terms contained anywhere in the lower-cased text, in list order, without repeats."""
    chosen = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])
    return let(F.lower(text), lambda low: F.filter(chosen, lambda t: F.contains(low, t)))


def title_case(text: Column) -> Column:
    """Upper-case first letter of every word, also after a hyphen."""
    return F.array_join(F.transform(F.split(text, "-"), lambda p: F.initcap(p)), "-")


def lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda s: F.trim(F.regexp_replace(s, r"[\t\r]", " ")))


def redact(text: Column, full_name: Column, email: Column, phone: Column, linkedin: Column, address: Column) -> Column:
    """Replace personal values longer than three characters, name parts and address parts included."""
    parts = F.filter(F.split(full_name, r"\s+"), lambda p: p != "")
    first = F.get(parts, F.lit(0))
    last = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 1))
    pieces = F.coalesce(F.transform(F.split(address, ","), lambda p: F.trim(p)), F.array().cast("array<string>"))
    known = F.array_compact(F.concat(F.array(full_name, first, last, email, phone, linkedin, address), pieces))
    long = F.filter(known, lambda p: F.length(p) > 3)
    return F.aggregate(long, text, lambda acc, p: F.replace(acc, p, F.lit(REDACTED)))


# Words a usable document has, and the thresholds of the quality score.
QUALITY_WORDS = ["experience", "education", "skill", "project", "work", "job", "resume"]
EMAIL = r"[\w\.-]+@[\w\.-]+\.\w+"
PHONE = r"[\+\(]?[0-9][0-9\-\(\) ]{8,}[0-9]"


def quality_issues(text: Column) -> Column:
    """Issue points of extracted text; more than three mean it is problematic."""
    size = F.length(text)
    printable = F.length(F.regexp_replace(text, r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]", "")) / F.greatest(size, F.lit(1))
    lowered = F.lower(text)
    words = sum((F.contains(lowered, F.lit(w)).cast("int") for w in QUALITY_WORDS), F.lit(0))
    newlines = size - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        F.when(size < 500, 3).otherwise(0) + F.when(newlines < 10, 2).otherwise(0) + F.when(printable < 0.9, 2).otherwise(0)
        + F.when(words < 3, 2).otherwise(0) + F.when(text.rlike(EMAIL), 0).otherwise(1) + F.when(text.rlike(PHONE), 0).otherwise(1)
    )


NOT_PRINTABLE = r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ \n\r\t]]"
# Lines that document converters leave behind.
CONVERTER_LINES = [
    r"(?is)Evaluation Warning.*?document\..*?\n", r"(?i)Microsoft Word.*?Document.*?\n", r"(?i)Normal\.dot.*?\n",
    r"(?i)MSWordDoc.*?\n", r"(?i)MSWorksWPDoc.*?\n", r"(?i)objCh.*?\n",
]


def clean_converted(text: Column) -> Column:
    """Text of a converted document without control characters and converter lines."""
    out = F.regexp_replace(text, NOT_PRINTABLE, " ")
    out = F.regexp_replace(out, r" {2,}", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"\A\s*\n", "")
    for pattern in CONVERTER_LINES:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+\n", "\n"), r"\n\s+", "\n")
    return F.regexp_replace(out, r"\A\s+|\s+\z", "")


def clean_resume(text: Column) -> Column:
    """Collapsed blanks and newlines, no blanks at line edges."""
    out = F.regexp_replace(F.regexp_replace(text, r" {2,}", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, r"[^\S\n]+\n", "\n"), r"\n[^\S\n]+", "\n")


def clean_for_model(text: Column, limit: int = 30_000) -> Column:
    """One sentence per paragraph; cut at ``limit`` with a note."""
    out = F.regexp_replace(text, r"\s+", " ")
    out = F.regexp_replace(out, r"([.!?])\s+", "$1\n")
    out = F.regexp_replace(out, NOT_PRINTABLE, "")
    out = F.replace(F.replace(out, F.lit("\n\n"), F.lit("\n")), F.lit("\n"), F.lit("\n\n"))
    return cut(out, limit, "\n\n[... Text truncated due to length ...]\n")


def cut(text: Column, limit: int, note: str = "") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(note))).otherwise(text)


def first_words(text: Column, n: int = 512) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


def budget_chars(prompt_chars: Column, max_tokens: int = 8000, chars_per_token: int = 4) -> Column:
    """Characters left for the text once the prompt is counted."""
    return F.floor((max_tokens - prompt_chars / chars_per_token) * chars_per_token).cast("int")
