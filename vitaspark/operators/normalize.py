"""Normalise stored model responses into records, and project records.

A response field may be a scalar, a list or an object, so responses are read
as VARIANT and every field is resolved by type inside the expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import blank_to_null, empty_strings, extract, first_of, first_wins, joined, once
from ..functions.lexicon import EMBEDDING_DIM, MONTHS, PLACEHOLDER, PLACEHOLDER_NAMES
from ..functions.vectors import fit_length

SCALARS = ["resume_id", "full_name", "name", "email", "phone_number", "address", "linkedin", "linkedin_url", "summary"]
LISTS = ["skills", "positions", "certifications", "industries"]
METADATA = ["processing_time", "opensearch_success", "s3_key", "file_type", "original_filename"]
# Fields the document store keeps, and the essential ones of a complete record.
KEPT_FIELDS = [
    "summary", "total_experience", "skills", "positions", "companies", "education", "certifications",
    "achievements", "industries", "projects",
]
ESSENTIAL = ["name", "email", "phone_number", "linkedin_url", "summary", "companies", "skills", "education", "total_years_experience"]


def read(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, "$." + path, kind)


def shape(v: Column, path: str) -> Column:
    """OBJECT, ARRAY or a scalar type name of a field; NULL when missing."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, "$." + path, "variant")), r"^[A-Z]+", 0)


def scalar(v: Column, field: str) -> Column:
    """Scalar text; an object gives its ``text``, ``values`` or ``value`` member."""
    kind = shape(v, field)
    member = F.coalesce(read(v, field + ".text"), read(v, field + ".values"), read(v, field + ".value"))
    return F.when(kind == "OBJECT", member).when(kind != "ARRAY", read(v, field))


def number(v: Column, field: str) -> Column:
    """A number, or the first number inside a text, else 0."""
    text = read(v, field)
    return F.coalesce(text.try_cast("double"), F.regexp_extract(text, r"(\d+\.?\d*)", 1).try_cast("double"), F.lit(0.0))


def string_list(v: Column, field: str) -> Column:
    """List or comma text to strings without blanks, one-character items and case-only repeats."""
    kind = shape(v, field)
    items = (
        F.when(kind == "ARRAY", read(v, field, "array<string>"))
        .when(kind == "OBJECT", read(v, field + ".values", "array<string>"))
        .when(kind.isNotNull() & (kind != "VOID"), F.transform(F.split(read(v, field), ","), lambda s: F.trim(s)))
    )
    return first_wins(F.filter(F.coalesce(items, empty_strings()), lambda s: F.coalesce(F.length(s), F.lit(0)) > 1))


def technologies(v: Column) -> Column:
    kind = shape(v, "technologies")
    return F.coalesce(
        F.when(kind == "ARRAY", read(v, "technologies", "array<string>"))
        .when(kind == "STRING", F.transform(F.split(read(v, "technologies"), ","), lambda s: F.trim(s))),
        empty_strings(),
    )


def standard_duration(text: Column) -> Column:
    """``MM/YYYY-MM/YYYY`` from the first and last ``month year`` found, else unchanged."""
    pattern = F.lit(r"(\w+)\s+(\d{4})")
    words, years = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])

    def month(word: Column, default: str) -> Column:
        return F.coalesce(F.try_element_at(table, F.substring(F.lower(word), 1, 3)), F.lit(default))

    last = F.size(words) - 1
    rebuilt = F.concat(
        month(F.get(words, F.lit(0)), "01"), F.lit("/"), F.get(years, F.lit(0)), F.lit("-"),
        month(F.get(words, last), "12"), F.lit("/"), F.get(years, last),
    )
    return F.when(text.rlike(r"^\d{2}/\d{4}-\d{2}/\d{4}"), text).when(F.size(words) >= 2, rebuilt).otherwise(text)


def _objects(v: Column, field: str) -> Column:
    items = F.when(shape(v, field) == "ARRAY", read(v, field, "array<variant>"))
    return F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda e: F.schema_of_variant(e).startswith("OBJECT"))


def companies(v: Column) -> Column:
    """Named companies, first of a name kept, latest first year first."""
    items = F.transform(
        _objects(v, "companies"),
        lambda e: F.struct(
            read(e, "name").alias("name"), read(e, "role").alias("role"), read(e, "description").alias("description"),
            standard_duration(read(e, "duration")).alias("duration"), technologies(e).alias("technologies"),
        ),
    )
    kept = first_wins(F.filter(items, lambda c: F.coalesce(c["name"], F.lit("")) != ""), lambda c: F.lower(c["name"]))
    return latest_first(kept)


def latest_first(items: Column) -> Column:
    """Stable order by the first four-digit year of the duration, missing last."""
    keyed = F.transform(
        items,
        lambda c, i: F.struct(
            (-F.coalesce(F.regexp_extract(c["duration"], r"(\d{4})", 1).try_cast("int"), F.lit(0))).alias("y"),
            i.alias("i"), c.alias("c"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["c"])


def education(v: Column) -> Column:
    """Entries with a degree; repeats of degree and institution dropped; year as int."""
    items = F.transform(
        _objects(v, "education"),
        lambda e: F.struct(
            read(e, "degree").alias("degree"), read(e, "institution").alias("institution"),
            F.when(shape(e, "year").isNotNull(), F.coalesce(
                read(e, "year", "int"), F.regexp_extract(read(e, "year"), r"(\d{4})", 1).try_cast("int"), F.lit(0)
            )).alias("year"),
        ),
    )
    poor = lambda e: e["degree"].isin("me", "Me", "be", "Be") & F.coalesce(e["institution"] == "Unknown Institution", F.lit(False))
    good = F.filter(items, lambda e: (F.coalesce(e["degree"], F.lit("")) != "") & ~poor(e))
    return first_wins(good, lambda e: F.concat(e["degree"], F.lit("-"), F.coalesce(e["institution"], F.lit(""))))


def achievements(v: Column) -> Column:
    return F.transform(
        _objects(v, "achievements"),
        lambda e: F.struct(*[read(e, f).alias(f) for f in ("type", "description", "metrics")]),
    )


def projects(v: Column) -> Column:
    return F.transform(
        _objects(v, "projects"),
        lambda e: F.struct(
            *[read(e, f).alias(f) for f in ("name", "description", "role", "metrics")],
            technologies(e).alias("technologies"),
            F.coalesce(F.regexp_extract(read(e, "duration_months"), r"(\d+)", 1).try_cast("int"), F.lit(0)).alias("duration_months"),
        ),
    )


def normalize_responses(df: DataFrame, response: str = "response", keep: list[str] | None = None) -> DataFrame:
    """One normalised record per stored response; a broken response gives defaults."""
    parsed = once(df, "__v", F.try_parse_json(response))
    v = F.col("__v")
    full = blank_to_null(scalar(v, "full_name"))
    full = F.when(~full.isin(*PLACEHOLDER_NAMES), full)
    name = blank_to_null(scalar(v, "name"))
    linkedin, url = blank_to_null(scalar(v, "linkedin")), blank_to_null(scalar(v, "linkedin_url"))
    plain = {f: scalar(v, f) for f in SCALARS}
    plain |= {
        "full_name": F.coalesce(full, name), "name": F.coalesce(full, name),
        "linkedin": F.coalesce(linkedin, url), "linkedin_url": F.coalesce(linkedin, url),
    }
    columns = [c.alias(f) for f, c in plain.items() if f not in (keep or [])]
    columns += [number(v, "total_experience").alias("total_experience")]
    columns += [string_list(v, f).alias(f) for f in LISTS]
    columns += [companies(v).alias("companies"), education(v).alias("education")]
    columns += [projects(v).alias("projects"), achievements(v).alias("achievements")]
    columns += [read(v, f).alias(f) for f in METADATA]
    return parsed.select(*(keep or []), *columns)


def index_document(records: DataFrame) -> DataFrame:
    """PII-free index row: lower-case skills, nameless entries dropped, vector of fixed length."""
    named = lambda c: F.coalesce(c["name"], F.lit("")) != ""
    columns = {
        "summary": F.coalesce("summary", F.lit("")),
        "skills": F.transform("skills", F.lower),
        "companies": F.filter("companies", named),
        "projects": F.filter("projects", lambda p: named(p) | (F.coalesce(p["description"], F.lit("")) != "")),
        "achievements": F.filter("achievements", lambda a: F.coalesce(a["description"], F.lit("")) != ""),
    }
    if "resume_embedding" in records.columns:
        columns["resume_embedding"] = fit_length(F.col("resume_embedding"), EMBEDDING_DIM)
    kept = ["resume_id", *KEPT_FIELDS, *[c for c in ("resume_embedding", "created_dt", "updated_dt") if c in records.columns]]
    return records.withColumns(columns).select(*kept)


def without_pii(records: DataFrame) -> DataFrame:
    return records.select("resume_id", *KEPT_FIELDS)


def _export_value(column: Column, kind: str) -> Column:
    if kind == "string":
        return F.coalesce(F.nullif(column, F.lit("")), F.lit(PLACEHOLDER))
    if kind == "double":
        return column.cast("decimal(20,4)")
    if kind == "array<string>":
        filled = F.transform(column, lambda s: F.coalesce(F.nullif(s, F.lit("")), F.lit(PLACEHOLDER)))
        return F.when(F.coalesce(F.size(column), F.lit(0)) > 0, filled).otherwise(F.array(F.lit(PLACEHOLDER)))
    return column


def for_export(records: DataFrame) -> DataFrame:
    """Placeholders for empty values and decimals for doubles; only at the sink."""
    return records.select(*[_export_value(F.col(c), k).alias(c) for c, k in records.dtypes])


def parallel_arrays(records: DataFrame) -> DataFrame:
    """Nested entries as parallel name arrays, blanks dropped."""
    def take(source: str, field: str) -> Column:
        return F.filter(F.transform(source, lambda x: x[field]), lambda s: F.coalesce(s, F.lit("")) != "")

    return records.select(
        "resume_id", take("companies", "name").alias("company_names"), take("companies", "role").alias("roles"),
        take("companies", "description").alias("company_descriptions"),
        take("education", "institution").alias("institutions"), take("education", "degree").alias("degrees"),
    )


def rename_legacy(df: DataFrame) -> DataFrame:
    """Older field names to current ones, missing values to defaults."""
    renamed = df.withColumnsRenamed({
        "full_name": "name", "phone": "phone_number", "linkedin": "linkedin_url", "total_experience": "total_years_experience",
    })
    out = {}
    for field in ("name", "email", "phone_number", "address", "linkedin_url", "summary"):
        out[field] = F.coalesce(F.col(field), F.lit(PLACEHOLDER)) if field in renamed.columns else F.lit(PLACEHOLDER)
    for field in ("skills", "positions"):
        out[field] = F.coalesce(F.col(field), empty_strings()) if field in renamed.columns else empty_strings()
    years = F.col("total_years_experience") if "total_years_experience" in renamed.columns else F.lit(None)
    out["total_years_experience"] = F.coalesce(years.cast("double"), F.lit(0.0))
    return renamed.withColumns(out)


def flatten_skill_groups(groups: Column) -> Column:
    """``{category: [skills]}`` to one list."""
    return F.flatten(F.map_values(groups))


def search_metadata(records: DataFrame) -> DataFrame:
    return records.select(
        "resume_id", F.array_join("skills", ", ").alias("skills"), F.col("positions").alias("position_titles"),
        F.transform("companies", lambda c: c["name"]).alias("companies"), "industries",
        F.coalesce("total_experience", F.lit(0.0)).alias("years_experience"),
    )


def nested_export(records: DataFrame) -> DataFrame:
    """Canonical nested form: contact, education, experience, skills, projects, metadata."""
    return records.select(
        "resume_id",
        F.struct(
            F.col("name"), "email", F.col("phone_number").alias("phone"), "address", F.col("linkedin_url").alias("linkedin")
        ).alias("contact"),
        "summary", "education", F.col("companies").alias("experience"),
        F.transform("skills", lambda s: F.struct(s.alias("name"))).alias("skills"), "projects", "certifications",
        F.struct("file_type", F.col("original_filename").alias("source_file"), "total_experience").alias("metadata"),
    )


# Skill names guessed for records without skills, and word cues of the other guesses.
GUESSED_SKILLS = [
    "java", "python", "c++", "javascript", "html", "css", "sql", "cloud", "aws", "azure", "spring", "react", "angular",
    "node", "devops", "git", "jenkins", "docker", "kubernetes", "agile", "scrum", "machine learning", "data science", "analytics",
]
DEFAULT_SKILLS = ["Technical skills", "Problem Solving", "Communication"]
INDUSTRY_CUES = [
    (["finance", "bank", "investment"], ["Finance", "Banking"]),
    (["health", "medical", "pharma"], ["Healthcare", "Pharmaceuticals"]),
]
SOFTWARE_CUES = ["java", "python", "javascript", "react", "angular"]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(s) for s in values])


def _any_inside(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def fill_mandatory(records: DataFrame) -> DataFrame:
    """Opt-in guesses for incomplete records; ``synthetic`` marks rows that got any."""
    everything = F.lower(F.to_json(F.struct(*records.columns)))
    guessed = F.transform(
        F.slice(F.filter(_strings(GUESSED_SKILLS), lambda s: F.contains(everything, s)), 1, 10), F.initcap
    )
    skills = F.when(F.size("skills") > 0, F.col("skills")).otherwise(
        F.when(F.size(guessed) > 0, guessed).otherwise(_strings(DEFAULT_SKILLS))
    )
    positions = F.when(F.size("positions") > 0, F.col("positions")).otherwise(F.array(
        F.when(_any_inside(everything, ["engineer", "developer"]), F.lit("Software Engineer"))
        .when(_any_inside(everything, ["analyst"]), F.lit("Business Analyst"))
        .when(_any_inside(everything, ["manager"]), F.lit("Project Manager"))
        .otherwise(F.lit("Professional"))
    ))
    guess = F.when(_any_inside(F.lower(F.array_join(skills, ",")), SOFTWARE_CUES), _strings(["Information Technology", "Software Development"]))
    for words, names in INDUSTRY_CUES:
        guess = guess.when(_any_inside(everything, words), _strings(names))
    industries = F.when(F.size("industries") > 0, F.col("industries")).otherwise(
        guess.otherwise(_strings(["Technology", "Business Services"]))
    )
    years = F.col("total_experience").cast("string")
    held = F.when(F.size("skills") > 0, F.array_join(F.slice("skills", 1, 5), ", ")).otherwise(F.lit("various skills"))
    where = F.array_join(F.slice(F.transform("companies", lambda c: c["name"]), 1, 2), ", ")
    what = F.array_join(F.slice("positions", 1, 2), ", ")
    lead = F.concat(F.lit("Professional with "), years, F.lit(" years of experience"))
    sentence = (
        F.when((where != "") & (what != ""), F.concat(lead, F.lit(" as "), what, F.lit(" at "), where, F.lit(", specializing in "), held, F.lit(".")))
        .when(what != "", F.concat(lead, F.lit(" as "), what, F.lit(", with expertise in "), held, F.lit(".")))
        .when(where != "", F.concat(lead, F.lit(" at "), where, F.lit(", with skills in "), held, F.lit(".")))
        .otherwise(F.concat(F.lit("Professional with expertise in "), held, F.lit(" looking to leverage technical skills in a challenging role.")))
    )
    has_summary = ~F.coalesce(F.col("summary"), F.lit("")).isin("", PLACEHOLDER)
    complete = has_summary & (F.size("skills") > 0) & (F.size("positions") > 0) & (F.size("industries") > 0)
    return records.withColumns({
        "summary": F.when(has_summary, F.col("summary")).otherwise(sentence),
        "skills": skills, "positions": positions, "industries": industries, "synthetic": ~complete,
    })


def missing_fields(records: DataFrame) -> Column:
    """Names of essential fields that are empty or placeholders, in fixed order."""
    kinds = dict(records.dtypes)
    checks = []
    for field in ESSENTIAL:
        column = "total_experience" if field == "total_years_experience" and field not in kinds else field
        if kinds[column].startswith("array"):
            empty = F.coalesce(F.size(column), F.lit(0)) <= 0
        elif kinds[column] == "double":
            empty = F.coalesce(F.col(column), F.lit(0.0)) == 0
        else:
            empty = F.coalesce(F.col(column), F.lit("")).isin("", PLACEHOLDER)
        checks.append(F.when(empty, F.lit(field)))
    return F.array_compact(F.array(*checks))


def completeness(records: DataFrame) -> DataFrame:
    missing = F.col("__missing")
    needed = ["name", "email", "phone_number", "linkedin_url", "companies", "education", "skills"]
    return once(records, "__missing", missing_fields(records)).withColumn("missing_fields", F.when(F.size(missing) > 0, F.array_join(missing, ", ")).otherwise(F.lit("None"))).withColumn(
        "is_valid", ~F.arrays_overlap(missing, _strings(needed))
    ).drop("__missing")


def filename_metadata(filename: Column) -> tuple[Column, Column]:
    """(name, years) of ``Naukri_<Name>[<y>y_<m>m]``."""
    pattern = r"Naukri_([A-Za-z]+)\[(\d+)y_(\d+)m\]"
    years = extract(filename, pattern, 2).cast("double") + extract(filename, pattern, 3).cast("double") / 12
    return extract(filename, pattern, 1), years


def name_from_filename(filename: Column) -> Column:
    """Text before the first underscore, else the name without its extension."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    return F.when(F.contains(filename, F.lit("_")), F.split_part(filename, F.lit("_"), F.lit(1))).otherwise(stem)


def _texts(column: str) -> Column:
    return F.coalesce(F.array_join(column, ", "), F.lit(""))


def standard_text(df: DataFrame) -> Column:
    """Six labelled lines for embedding; jobs add required and nice-to-have skills."""
    cols = df.columns

    def have(name: str, value: Column) -> list[Column]:
        return [value] if name in cols else []

    skills = [F.nullif(_texts(c), F.lit("")) for c in ("skills", "required_skills", "nice_to_have_skills") if c in cols]
    titles = have("positions", F.nullif(_texts("positions"), F.lit(""))) + have("job_title", F.nullif(F.col("job_title"), F.lit("")))
    years = F.col("total_experience") if "total_experience" in cols else F.col("required_experience")
    study: Column = F.col("required_education") if "required_education" in cols else F.lit("")
    if "education" in cols:
        study = F.array_join(F.filter(F.transform(
            "education", lambda e: F.concat_ws(" from ", F.nullif(e["degree"], F.lit("")), F.nullif(e["institution"], F.lit("")))
        ), lambda s: s != ""), ", ")
    tech = F.array_join(F.flatten(F.transform("companies", lambda c: c["technologies"])), ", ") if "companies" in cols else F.lit("")
    summary = F.coalesce(F.col("summary"), F.lit("")) if "summary" in cols else F.lit("")
    parts = [
        ("SKILLS", F.concat_ws(", ", *skills)), ("EXPERIENCE", F.concat(years.cast("string"), F.lit(" years"))),
        ("POSITIONS", F.concat_ws(", ", *titles)), ("EDUCATION", study), ("TECHNOLOGIES", tech), ("SUMMARY", summary),
    ]
    return F.concat(*[x for label, value in parts for x in (F.lit(f"\n{label}: "), F.coalesce(value, F.lit("")))], F.lit("\n"))


def short_text(df: DataFrame) -> Column:
    """Four labelled lines, the request-profile variant."""
    cols = df.columns
    skills = [F.nullif(_texts(c), F.lit("")) for c in ("skills", "required_skills") if c in cols]
    years = F.col("total_experience") if "total_experience" in cols else F.col("required_experience")
    title = F.coalesce(F.col("job_title"), F.lit("")) if "job_title" in cols else F.lit("")
    summary = F.coalesce(F.col("summary"), F.lit("")) if "summary" in cols else F.lit("")
    return F.concat(
        F.lit("Skills: "), F.concat_ws(", ", *skills), F.lit("\nExperience: "), years.cast("string"), F.lit(" years"),
        F.lit("\nPosition: "), title, F.lit("\nSummary: "), summary,
    )


def sectioned_text() -> Column:
    """Long sectioned text of a record without personal data; empty sections vanish."""
    def value(c: Column, default: str = "Not specified") -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))

    def listed(label: str, column: str) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.lit(label + ": "), F.array_join(column, ", ")))

    def lines(items: Column, render) -> Column:
        return F.when(F.size(items) > 0, F.array_join(F.transform(items, render), "\n"))

    company = lambda c: F.concat_ws(
        "\n", F.concat(F.lit("\n### "), value(c["name"])), F.concat(F.lit("Duration: "), value(c["duration"])),
        F.concat(F.lit("Role: "), value(c["role"])), F.concat(F.lit("Technologies: "), F.array_join(c["technologies"], ", ")),
        F.concat(F.lit("Key Contributions: "), value(c["description"])),
    )
    project = lambda p: F.concat_ws(
        "\n", F.concat(F.lit("\n### "), value(p["name"])), F.concat(F.lit("Duration: "), p["duration_months"].cast("string"), F.lit(" months")),
        F.concat(F.lit("Role: "), value(p["role"])), F.concat(F.lit("Technologies: "), F.array_join(p["technologies"], ", ")),
        F.concat(F.lit("Achievement: "), value(p["metrics"])), F.concat(F.lit("Description: "), value(p["description"])),
    )
    study = lambda e: F.concat(
        F.lit("\n- "), value(e["degree"]), F.lit(" from "), value(e["institution"]), F.lit(" ("),
        F.when(F.coalesce(e["year"], F.lit(0)) != 0, e["year"].cast("string")).otherwise(F.lit("Year not specified")), F.lit(")"),
    )
    award = lambda a: F.concat(F.lit("- "), value(a["description"]), F.lit(" ["), value(a["type"]), F.lit("] ("), value(a["metrics"]), F.lit(")"))
    return F.concat_ws(
        "\n", F.lit("# PROFESSIONAL PROFILE"), F.lit("\n## PROFESSIONAL SUMMARY"), value(F.col("summary"), "No summary available"),
        F.lit("\n## EXPERIENCE OVERVIEW"), F.concat(F.lit("Total Experience: "), F.col("total_experience").cast("string"), F.lit(" years")),
        listed("Positions Held", "positions"), F.lit("\n## TECHNICAL COMPETENCIES"), listed("Skills", "skills"),
        listed("Certifications", "certifications"), listed("Industries", "industries"),
        F.lit("\n## PROFESSIONAL EXPERIENCE DETAILS"), lines(F.col("companies"), company),
        F.when(F.size("projects") > 0, F.lit("\n## KEY PROJECTS")), lines(F.col("projects"), project),
        F.lit("\n## EDUCATION & ACHIEVEMENTS"), lines(F.col("education"), study),
        F.when(F.size("achievements") > 0, F.lit("\n### Notable Achievements:")), lines(F.col("achievements"), award),
    )


def paired_text() -> Column:
    """Older embedding text: the i-th position at the i-th company."""
    n = F.least(F.size("positions"), F.size("companies"))
    jobs = F.transform(
        F.slice("positions", F.lit(1), n),
        lambda p, i: F.concat(F.lit("Experience: "), p, F.lit(" at "), F.get("companies", i)["name"]),
    )
    study = F.transform("education", lambda e: F.concat(
        F.lit("Education: "), e["degree"], F.lit(" from "), F.coalesce(e["institution"], F.lit("")), F.lit(" "),
        F.when(F.coalesce(e["year"], F.lit(0)) != 0, F.concat(F.lit("("), e["year"].cast("string"), F.lit(")"))).otherwise(F.lit("")),
    ))
    work = F.transform("projects", lambda p: F.concat(
        F.lit("Project: "), F.coalesce(p["name"], F.lit("")), F.lit(": "), F.coalesce(p["description"], F.lit(""))
    ))
    labelled = lambda label, c: F.when(~F.coalesce(c, F.lit("")).isin("", PLACEHOLDER), F.concat(F.lit(label), c))
    head = F.array_compact(F.array(labelled("Name: ", F.col("name")), labelled("Summary: ", F.col("summary"))))
    tail = F.array_compact(F.array(F.when(F.size("certifications") > 0, F.concat(F.lit("Certifications: "), _texts("certifications")))))
    return F.array_join(F.concat(head, jobs, study, work, tail), "\n")


def narrative(df: DataFrame) -> Column:
    """Candidate block for analysis: skills (ten, then a count), positions, education."""
    study = F.array_join(F.filter(F.transform(
        "education", lambda e: F.concat(F.coalesce(e["degree"], F.lit("")), F.lit(" from "), F.coalesce(e["institution"], F.lit("")))
    ), lambda s: s != " from "), "; ")
    return F.concat(
        F.lit("Skills: "), joined(F.col("skills"), 10), F.lit("\nExperience: "), F.col("total_experience").cast("string"),
        F.lit(" years\nPositions: "), _texts("positions"), F.lit("\nEducation: "), study,
    )


def job_text() -> Column:
    """Vacancy fields rendered as a job description; lists become bullets."""
    bullets = lambda c: F.array_join(F.transform(c, lambda s: F.concat(F.lit("- "), F.trim(s))), "\n")
    return F.concat(
        F.lit("Job Title: "), F.col("title"), F.lit("\n\nRequired Skills:\n"), bullets("skills"),
        F.lit("\n\nExperience: "), F.col("experience").cast("string"), F.lit("+ years\n\nResponsibilities:\n"),
        bullets("responsibilities"), F.lit("\n\nQualifications:\n"), bullets("qualifications"),
        F.lit("\n\nAdditional Information:\n"), F.coalesce("additional_info", F.lit("")), F.lit("\n"),
    )


def merge_job_info(pattern_info: DataFrame, model_info: DataFrame) -> DataFrame:
    """Model value where it says something, else the pattern value; keyed by jd_id."""
    m = model_info.select("jd_id", *[F.col(c).alias("__m_" + c) for c in model_info.columns if c != "jd_id"])
    joined_info = pattern_info.join(m, "jd_id", "left")
    kinds = dict(pattern_info.dtypes)

    def choose(name: str) -> Column:
        other = F.col("__m_" + name)
        if kinds[name].startswith("array"):
            said = F.coalesce(F.size(other), F.lit(0)) > 0
        elif kinds[name] == "string":
            said = F.coalesce(other, F.lit("")) != ""
        else:
            said = F.coalesce(other, F.lit(0)) != 0
        return F.when(said, other).otherwise(F.col(name)).alias(name)

    return joined_info.select("jd_id", *[
        choose(c) if "__m_" + c in joined_info.columns else F.col(c) for c in pattern_info.columns if c != "jd_id"
    ])


def work_keys(df: DataFrame, text: str = "text", size: int = 10, method: str = "hybrid") -> DataFrame:
    """Keys under which repeated work is shared: text, folded text, query with size and method."""
    folded = F.regexp_replace(F.lower(F.trim(F.col(text))), r"\s+", " ")
    return df.withColumns({
        "text_md5": F.md5(F.col(text)), "folded_md5": F.md5(folded),
        "query_md5": F.md5(F.concat(F.col(text), F.lit(f":{size}:{method}"))),
    })


def distinct_work(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per distinct text; join results back on ``text_md5``. Copies meet
    in a hash aggregate that combines before the shuffle."""
    return df.select(F.md5(F.col(text)).alias("text_md5"), F.col(text)).groupBy("text_md5").agg(F.first(text).alias(text))
