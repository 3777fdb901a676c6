"""Extraction rules on written fixtures; all persons are invented."""

import pytest
from pyspark.sql import functions as F

from vitaspark.functions import text as X
from vitaspark.operators import extract as E
from vitaspark.operators import salvage as SV

TEXT = """Asha Rao
12 Park Street, Pune, Maharashtra 411001
Email: asha.rao@mail.example
Phone: +91 9812345678
linkedin.com/in/asharao

SUMMARY
Having 6+ years of experience in data platforms and reporting.

SKILLS: Python, C++, Apache Spark

EXPERIENCE
Senior Data Engineer at Acme Corp, 2015 - 2019
Project Manager, managed team of 9 at Globex Inc

EDUCATION
B.Tech Computer Science 2014
Delhi University, New Delhi

CERTIFICATIONS
AWS Certified Developer
Best performer award 2019
PMP
"""


def one(spark, make, text=TEXT):
    return spark.createDataFrame([(text,)], "t STRING").select(make(F.col("t")).alias("v")).first()["v"]


def test_contacts(spark):
    assert one(spark, E.person_name) == "Asha Rao"
    assert one(spark, E.best_phone) == "+91 9812345678"
    assert one(spark, E.linkedin_url) == "https://www.linkedin.com/in/asharao/"
    assert "411001" in one(spark, E.address)
    assert "411001" in one(spark, E.careful_address)
    assert one(spark, lambda t: E.best_email(t, F.lit("Asha Rao"))) == "asha.rao@mail.example"


def test_email_with_blank(spark):
    text = "mail: other@site.org and asha 200@site.org"
    assert one(spark, lambda t: E.best_email(t, F.lit("Asha Rao")), text) == "asha200@site.org"


def test_skills_with_signs(spark):
    assert one(spark, E.legacy_skills) == ["python", "c++", "aws", "apache spark"]
    assert one(spark, E.post_skills) == ["Aws", "C++", "Python"]
    assert one(spark, E.legacy_skills, "Skills: knitting, chess; a\n\nrest") == ["knitting", "chess"]


def test_profile(spark):
    assert one(spark, lambda t: E.experience_years(t, 2025)) == 6.0
    assert one(spark, E.positions) == ["Senior Data Engineer", "Developer", "Project Manager"]
    assert one(spark, E.summary).startswith("Having 6+ years of experience")
    assert [(e["degree"], e["school"], e["year"]) for e in one(spark, E.full_education)] == [
        ("B.Tech Computer Science", "Delhi University, New Delhi", "2014")
    ]
    assert one(spark, E.certifications) == ["AWS Certified Developer", "PMP"]


def test_manager_needs_evidence(spark):
    assert one(spark, E.positions, "Product Manager wanted for sales") == []


@pytest.mark.parametrize(
    ("text", "years"),
    [("5+ years of experience", 5.0), ("3-5 years experience", 3.0), ("1-2 years of hands-on experience", 0.0), ("", 0.0)],
)
def test_required_years(spark, text, years):
    assert one(spark, E.required_years, text) == years


def test_job_title(spark):
    assert one(spark, E.job_title, "Job Title: Data Engineer\nx") == "Job Title"
    assert one(spark, lambda t: E.job_title(t, True), "Job Title: Data Engineer\nx") == "Data Engineer"
    assert one(spark, E.job_title, "\nData Engineer") == "Not specified"


def test_date_ranges(spark):
    text = "Clerk 2010 - 2012, Clerk 2015 to present"
    assert one(spark, lambda t: E.years_from_positions(t, 2020), text) == 7.0


def test_sections(spark):
    kinds = [s["kind"] for s in one(spark, E.sections)]
    assert {"summary", "skills", "experience", "education", "certification"} <= set(kinds)
    assert "## EDUCATION\nB.Tech" in one(spark, E.sectioned)
    long = TEXT + "word " * 2000
    short = one(spark, lambda t: E.priority_text(t, F.lit("LEAD\n\n")), long)
    assert short.startswith("LEAD") and "## EXPERIENCE" in short and len(short) < len(long)


def test_redaction_is_complete(spark):
    address = "12 Park Street, Pune, Maharashtra 411001"
    out = one(spark, lambda t: X.redact(t, F.lit("Asha Rao"), F.lit("asha.rao@mail.example"), F.lit("+91 9812345678"), F.lit(None).cast("string"), F.lit(address)))
    for item in ["Asha Rao", "Asha", "asha.rao@mail.example", "+91 9812345678", "12 Park Street", "Pune"]:
        assert item not in out
    assert "[REDACTED]" in out and "Delhi University" in out


@pytest.mark.parametrize(
    ("response", "method"),
    [
        ('text ```json\n{"a":1,"b":2,"c":3,"d":4}\n``` end', "fenced"), ('{"a":1,"b":2,"c":3,"d":[1,2,],}', "whole"),
        ('x {"a":{"b":1}} y {"z":1,"q":2,"r":3}', "braces"), ('{"a": "1", "b": 2, "c": [1], "d": 4, "e": "x', "fields"), ('{"a": "1", "b": 2, "c": [1], "d": "x', "none"), ("nothing", "none"), ('"a": 1', "none"),
    ],
)
def test_salvage(spark, response, method):
    assert one(spark, SV.salvage, response)["method"] == method


def test_salvage_picks_most_keys(spark):
    assert one(spark, lambda t: SV.n_keys(SV.salvage(t)["json"]), 'x {"a":1} y {"z":1,"q":2,"r":3}') == 3


def test_cleaning(spark):
    assert one(spark, X.clean_converted, "a\x01b  c\n\n\n\nNormal.dot junk\nend ") == "a b c\nend"
    assert one(spark, lambda t: X.cut(t, 3, "..."), "abcdef") == "abc..."
    assert one(spark, X.quality_issues, "short") == 9


def test_any_word_finds_what_the_whole_list_finds():
    import re

    for words in (E.PLACE_WORDS, E.TECH_WORDS, E.ADDRESS_CUES, [w.lower() for w in E.DEGREE_WORDS], ["x", "xi", "ax", "b.c", "b+"]):
        short, texts = re.compile(E._any_word(words)), [*words, *[w[:-1] for w in words], *[w[1:] + " " + w[:2] for w in words], "", "zz"]
        assert [bool(short.search(t)) for t in texts] == [any(w in t for w in words) for t in texts]
        assert len(E._any_word(words)) < len("|".join(words)) + 40


def test_education_sentences_of_a_long_text_without_grades(spark):
    """A form that needs a grade is not searched for where none stands: its search goes over the whole rest from every start."""
    import time

    text = "no section\n" + ("X " + "Abc def ghi " * 25 + "12 \n") * 60 + "B.Tech in Physics from Delhi University 2014"
    began = time.time()
    found = one(spark, lambda t: E.full_education(t), text)
    assert [(e.degree, e.school, e.year) for e in found] == [("B.Tech in Physics", "Delhi University", "2014")]
    assert time.time() - began < 20


def test_windows_of_many_mentions(spark):
    """Each mention's window stands where the mention does, also behind thousands of others and wide characters."""
    text = "é MBA 2001 " + "x" * 300 + " MBA Delhi University 1999 " + "MBA, " * 400 + "y" * 200 + " MBA 2015"
    found = [e for e in one(spark, E.windowed_education, text) if e.degree == "MBA"]
    assert len(found) == 403 and [e.k for e in found] == list(range(1, 404))
    assert [(e.institution, e.year) for e in (found[0], found[1], found[-1])] == [("Unknown Institution", 2001), ("Delhi University", 1999), ("Unknown Institution", 2015)]


def test_titles_after_a_company_suffix(spark):
    """A suffix before any blank rules a title out; texts without one keep theirs."""
    assert one(spark, E.positions, "Acme Inc\n Data Engineer") == []
    assert one(spark, E.positions, "Acme Income Data Engineer") == ["Data Engineer"]


def test_job_text_cues_behind_plain_words(spark):
    for t, want in (("Analyzed the  root cause", True), ("resolve tickets", True), ("12 Park Street 411001", False), ("block 5, worked on it", True), ("drive 12", False), ("pin 700101 xx", False), ("", False)):
        assert one(spark, E.is_job_text, t) is want, t
