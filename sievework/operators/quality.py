"""Document quality of profiles: every feature is a column, so the whole analysis is a projection without a shuffle.

Lines are split once and folded once. Signals that only a page layout has (columns, tables, fonts, scans) count as clean; the number
of pages is estimated from the words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Weights of the subscores in the overall score.
WEIGHTS = {"ats_readability": 0.15, "formatting_layout": 0.15, "section_structure": 0.15, "bullet_quality": 0.15, "typography": 0.10, "grammar_spelling": 0.15, "consistency": 0.10, "contact_information": 0.05}
#: Names of the sections and the patterns that show them, in order.
SECTIONS = {
    "Contact Information": r"\b(email|phone|linkedin|github|portfolio|contact)\b|[\w.-]+@[\w.-]+\.\w+",
    "Work Experience / History": r"\b(experience|work experience|employment history|work history|professional experience|career history)\b",
    "Skills & Competencies": r"\b(skills|technical skills|core competencies|technologies|key skills|proficiencies)\b",
    "Education & Qualifications": r"\b(education|academic background|qualifications|degrees?|university|college|bachelor|master|phd)\b",
    "Summary / Objective": r"\b(professional summary|executive summary|career summary|summary|objective|career objective|about me)\b",
    "Projects / Certifications": r"\b(projects|key projects|certifications|certificates|licenses|achievements|publications)\b",
}
#: Each match of a section's pattern holds one of these, whatever its case.
HELD = {
    "Contact Information": ["email", "phone", "linkedin", "github", "portfolio", "contact", "@"],
    "Work Experience / History": ["experience", "employment history", "work history", "career history"],
    "Skills & Competencies": ["skills", "core competencies", "technologies", "proficiencies"],
    "Education & Qualifications": ["education", "academic background", "qualifications", "degree", "university", "college", "bachelor", "master", "phd"],
    "Summary / Objective": ["summary", "objective", "about me"],
    "Projects / Certifications": ["projects", "certifications", "certificates", "licenses", "achievements", "publications"],
}
#: Contact patterns, bullet marks, numbers that tell a result, date styles.
EMAIL, PHONE = r"[\w.-]+@[\w.-]+\.\w+", r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
LINKEDIN, GITHUB = r"linkedin\.com/in/|linkedin:\s*@?[\w-]+", r"github\.com/|github:\s*@?[\w-]+"
BULLETS = "•-*–—▪▫►✓"
METRIC = r"\b\d+(\.\d+)?%|\$\d+[\d,]*(\.\d+)?[kmbKMB]?|\b\d+[\d,]*\s*(users|clients|candidates|requests|queries|downloads|revenue|savings|dollars|percent|growth)"
DATES = {"MM/YYYY": r"\b(0[1-9]|1[0-2])/\d{4}\b", "Month YYYY": r"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}\b", "YYYY - YYYY": r"\b\d{4}\s*[-–—]\s*\d{4}\b"}
#: Strong verbs.
VERBS = """accelerated accomplished achieved acquired adapted administered advised analyzed architected automated built centralized
championed collaborated constructed coordinated crafted created decreased delivered deployed designed developed directed eliminated
enabled engineered established executed expanded facilitated formulated founded generated guided implemented improved increased
initiated innovated inspected integrated introduced launched lead led managed maximized mentored migrated minimized modernized
negotiated optimized orchestrated overhauled oversaw partnered pioneered planned produced programmed promoted reduced reengineered
resolved restructured revamped scaled simplified spearheaded standardized streamlined strengthened supervised surpassed trained
transformed unified upgraded validated yielded""".split()
#: Misspellings and what is meant; verbs of the present and their past.
TYPOS = {
    "seperate": "separate", "definately": "definitely", "managment": "management", "implemeted": "implemented", "responsibilites": "responsibilities",
    "responsiblities": "responsibilities", "databse": "database", "developement": "development", "experiance": "experience", "experince": "experience",
    "knowlege": "knowledge", "achived": "achieved", "maintainance": "maintenance", "tehnical": "technical", "enviornment": "environment",
    "enviroment": "environment", "reponsible": "responsible", "commited": "committed", "succesful": "successful", "oppurtunity": "opportunity",
    "calender": "calendar", "refering": "referring",
}
PAST = {
    "develop": "developed", "create": "created", "manage": "managed", "build": "built", "design": "designed", "implement": "implemented",
    "lead": "led", "test": "tested", "write": "wrote", "maintain": "maintained", "analyze": "analyzed", "coordinate": "coordinated",
    "configure": "configured", "optimize": "optimized", "engineer": "engineered", "spearhead": "spearheaded",
}
#: What opens and what closes the experience section.
OPENS, CLOSES = ["experience", "employment", "work history"], ["education", "skills", "certifications", "projects"]
FEW_WORDS = 5


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lines(text: Column) -> Column:
    """Stripped lines without the blank ones."""
    return F.filter(F.transform(F.split(_text(text), "\n"), C.strip), lambda x: x != "")


def _map(of: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in of.items() for x in kv))


def _names(conditions: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))


def contact(text: Column) -> dict[str, Column]:
    t = _text(text)
    return {"has_email": t.contains("@") & t.rlike(f"(?U){EMAIL}"), "has_phone": t.rlike(f"(?U){PHONE}"), "has_linkedin": t.rlike(f"(?iU){LINKEDIN}"), "has_github": t.rlike(f"(?iU){GITHUB}")}


def _holds(text: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, (text.contains(w) for w in words))


def _missing(detected: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, SECTIONS)), detected)


def sections(text: Column) -> tuple[Column, Column]:
    """detected and missing section names, in order. A pattern is looked for only where a word of it stands."""
    t = _text(text)
    # the four letters beyond ASCII that patterns without case take for letters of ASCII: dotted I, dotless i, long s, the Kelvin sign
    low = F.lower(F.translate(t, "\u0130\u0131\u017f\u212a", "iisk"))
    detected = C.let(low, lambda x: _names({n: _holds(x, HELD[n]) & t.rlike(f"(?iU){p}") for n, p in SECTIONS.items()}))
    return detected, _missing(detected)


def _is_bullet(line: Column) -> Column:
    return F.lit(BULLETS).contains(F.substring(line, 1, 1)) | line.rlike(r"(?U)^\d+\.\s+")


def bullets(lined: Column) -> dict[str, Column]:
    """From the lines: how many are bullets, their marks in order of appearance, and bullets of more than 45 words."""
    found = F.filter(lined, _is_bullet)
    marks = F.array_distinct(F.filter(F.transform(lined, lambda x: F.substring(x, 1, 1)), lambda c: F.lit(BULLETS).contains(c)))
    return {"bullets": F.size(found), "bullet_symbols": marks, "long_bullets": F.size(F.filter(found, lambda x: C.word_count(x) > 45))}


def action_verbs(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(_text(text)), F.lit(r"(?U)\b[a-z]{4,}\b"), 0)
    return F.sort_array(F.array_intersect(F.array(*map(F.lit, VERBS)), found))


def metrics(text: Column) -> Column:
    """Percentages, amounts and counts of users, clients and the like."""
    return F.regexp_count(_text(text), F.lit(f"(?U){METRIC}"))


def long_paragraphs(text: Column, most: int = 65) -> Column:
    blocks = F.transform(F.split(_text(text), "\n\n"), C.strip)
    return F.size(F.filter(blocks, lambda p: (C.word_count(p) > most) & ~F.lit(BULLETS).contains(F.substring(p, 1, 1))))


def typos(text: Column, most: int = 4) -> Column:
    """The first known misspellings, as word and suggestion; a repeated one counts each time."""
    known = _map(TYPOS)
    words = C.words(F.regexp_replace(F.lower(_text(text)), r"(?U)[^\w\s]+", ""))
    hits = F.slice(F.filter(words, lambda w: w.isin(*TYPOS)), 1, most)
    return F.transform(hits, lambda w: F.struct(w.alias("word"), F.element_at(known, w).alias("suggested")))


def repeated_words(text: Column) -> Column:
    """Words that stand twice in a row, each as it is written first."""
    return F.regexp_extract_all(_text(text), F.lit(r"(?iU)\b([a-zA-Z]{2,})\s+\1\b"), 1)


def tense(lined: Column) -> Column:
    """Lines of the experience section that begin with a verb of the present: current, suggested; in order of place.

    A line that names the section opens it, a line that names another closes it; only such lines and those that begin with a verb are folded.
    """
    kind = "struct<open:boolean,found:array<struct<current:string,suggested:string>>>"
    past = _map(PAST)

    def seen(line: Column) -> Column:
        # the first word behind marks and numbers
        first = F.lower(F.regexp_extract(line, r"(?U)^[•\-*▪▫►✓\d.]*+\s*+(\S+)", 1))
        turn = C.let(F.lower(line), lambda low: F.when(_holds(low, OPENS), True).when(_holds(low, CLOSES), False))
        return F.struct(line.alias("line"), turn.alias("turn"), F.element_at(past, first).alias("verb"), F.length(first).alias("skip"))

    def step(state: Column, x: Column) -> Column:
        inside = F.coalesce(x["turn"], state["open"])
        bare = C.strip(F.regexp_replace(x["line"], r"(?U)^[•\-*▪▫►✓\d.]+\s*", ""))

        def hit(bare: Column) -> Column:
            short = F.concat(F.substring(bare, 1, 45), F.when(F.length(bare) > 45, "...").otherwise(""))
            rest = F.substr(short, x["skip"] + 2)
            return F.array(F.struct(short.alias("current"), C.strip(F.concat(F.initcap(x["verb"]), F.lit(" "), rest)).alias("suggested")))

        more = F.when(inside & x["verb"].isNotNull(), F.concat(state["found"], C.let(bare, hit))).otherwise(state["found"])
        return F.struct(inside.alias("open"), more.alias("found")).cast(kind)

    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<current:string,suggested:string>>").alias("found")).cast(kind)
    told = F.filter(F.transform(lined, seen), lambda x: x["turn"].isNotNull() | x["verb"].isNotNull())
    return F.aggregate(told, start, step, lambda s: s["found"])


def grammar(repeated: Column, tenses: Column) -> Column:
    """Up to four issues (current, suggested): all repeated words first; tense adds at least one, and stops at three of both."""
    twice = F.transform(repeated, lambda w: F.struct(F.concat(w, F.lit(" "), w).alias("current"), w.alias("suggested")))
    return F.slice(F.concat(twice, F.slice(tenses, F.lit(1), F.greatest(F.lit(1), 3 - F.size(repeated)))), 1, 4)


def date_formats(text: Column) -> Column:
    return _names({n: _text(text).rlike(f"(?U){p}") for n, p in DATES.items()})


def pages(words: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(words / 400, 0).cast("int"))


def _between(x: Column, low: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(100), x))


def _less(condition: Column, n: int) -> Column:
    return F.when(condition, -n).otherwise(0)


def _more(condition: Column, n: int) -> Column:
    return F.when(condition, n).otherwise(0)


def subscores() -> dict[str, Column]:
    """From the features: eight numbers up to 100."""
    c = F.col
    mixed = F.size("bullet_symbols") > 1
    length = F.when(c("words") < 150, -45).when((c("words") < 300) | (c("words") > 1500), -20).otherwise(0)
    dense = F.when(c("long_paragraphs") > 2, -15).when(c("long_paragraphs") == 1, -5).otherwise(0)
    listed = F.when(c("bullets") >= 8, 15).when(c("bullets") == 0, -25).otherwise(0)
    points = {"Contact Information": 15, "Work Experience / History": 25, "Skills & Competencies": 25, "Education & Qualifications": 15, "Summary / Objective": 10}
    there = F.lit(40)
    for name, n in points.items():
        there = there + _more(F.array_contains("detected", name), n)
    base = F.when(c("bullets") == 0, 25).when(c("bullets") < 4, 55).when(c("bullets") >= 8, 95).otherwise(80)
    return {
        "ats_readability": _between(85 + length + dense + listed, 10),
        "formatting_layout": _between(90 + _less(c("pages") > 2, 15), 15),
        "section_structure": _between(there, 15),
        "bullet_quality": _between(base + _less(mixed, 15) + _less(c("long_bullets") > 2, 10), 20),
        "typography": F.lit(90),
        "grammar_spelling": _between(92 - 12 * F.size("spelling") - 10 * F.size("grammar"), 20),
        "consistency": _between(88 + _less(mixed, 15) + _less(F.size("dates") > 1, 15), 25),
        "contact_information": _between(60 + _more(c("has_email"), 20) + _more(c("has_phone"), 15) + _more(c("has_linkedin") | c("has_github"), 5), 20),
    }


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A+").when(score >= 80, "A").when(score >= 70, "B").when(score >= 60, "C").otherwise("Needs Improvement")


def analyse(df: DataFrame, text: str) -> DataFrame:
    """Adds the features, the eight subscores, overall, grade and `is_ats_friendly`; texts of fewer than five words have 0 and `F`."""
    t = F.col(text)
    out = df.withColumn("lines", lines(t))
    lined = F.col("lines")
    out = out.withColumns({**contact(t), **bullets(lined), "detected": sections(t)[0], "verbs": action_verbs(t), "metric_count": metrics(t), "long_paragraphs": long_paragraphs(t), "spelling": typos(t), "grammar": grammar(repeated_words(t), tense(lined)), "dates": date_formats(t), "words": C.word_count(t)}).drop("lines")
    out = out.withColumn("missing", _missing(F.col("detected"))).withColumn("pages", pages(F.col("words"))).withColumn("readable", F.col("words") >= FEW_WORDS)
    out = out.withColumns({k: F.when(F.col("readable"), v).otherwise(0) for k, v in subscores().items()})
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("overall", F.when(F.col("readable"), F.greatest(F.lit(10), F.least(F.lit(100), F.bround(F.round(total, 6), 0).cast("int")))).otherwise(0))
    return out.withColumn("grade", F.when(F.col("readable"), grade(F.col("overall"))).otherwise("F")).withColumn("is_ats_friendly", F.col("overall") >= 70)


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _issue(severity: str | Column, problem: str | Column, evidence: Column, advice: Column) -> Column:
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(column(severity).alias("severity"), column(problem).alias("problem"), evidence.alias("evidence"), advice.alias("recommendation"))


def _one(condition: Column, issue: Column) -> Column:
    return F.when(condition, F.array(issue)).otherwise(F.array().cast("array<struct<severity:string,problem:string,evidence:string,recommendation:string>>"))


def feedback() -> tuple[Column, Column, Column]:
    """From the features: issues (severity, problem, evidence, recommendation), good practices and general recommendations, each in the
    order of the rules."""
    c = F.col
    mixed, many_dates, long = F.size("bullet_symbols") > 1, F.size("dates") > 1, c("pages") > 2
    heavy = ("Work Experience / History", "Skills & Competencies")
    # fixed values: severities and texts of the rules
    issues = F.concat(
        _one(mixed, _issue("warning", "Inconsistent bullet styles", _say(F.size("bullet_symbols"), " different bullet styles detected (", F.array_join(F.transform("bullet_symbols", lambda s: _say("'", s, "'")), ", "), ")."), _say("Use one consistent bullet character (e.g. •) throughout the entire resume."))),
        _one(~mixed & (c("bullets") == 0), _issue("warning", "Missing bullet points", _say("Zero bullet characters detected; responsibilities appear as dense paragraphs."), _say("Convert paragraph blocks into 1-2 line action-oriented bullet points."))),
        _one(many_dates, _issue("warning", "Inconsistent date formatting", _say("Multiple date syntax styles detected (", F.array_join("dates", ", "), ")."), _say("Standardize all work experience dates to one format (e.g. 'MM/YYYY - MM/YYYY' or 'Month YYYY - Present')."))),
        F.transform("grammar", lambda g: _issue("warning", "Possible grammar/tense issue", _say('Current: "', g["current"], '"'), _say('Suggested: "', g["suggested"], '"'))),
        F.transform("spelling", lambda s: _issue("warning", "Spelling mistake detected", _say('Found "', s["word"], '" in resume text.'), _say('Correct "', s["word"], '" to "', s["suggested"], '".'))),
        _one(~c("has_email"), _issue("critical", "Missing contact email", _say("No valid email address found in document header or body."), _say("Add your primary email address prominently at the top of your resume."))),
        _one(~c("has_phone"), _issue("info", "Missing phone number", _say("No telephone number detected."), _say("Include a standard phone number with country/area code."))),
        _one(long, _issue("warning", "Excessive document length", _say("Document length is ", c("pages"), " pages."), _say("Condense older or less relevant responsibilities to fit within 1-2 pages."))),
        F.transform("missing", lambda s: _issue(F.when(s.isin(*heavy), "warning").otherwise("info"), _say("Missing standard section: ", s), _say("Could not detect a clear heading for '", s, "'."), _say("Add a distinct, clearly capitalized section heading for '", s, "'."))),
    )
    empty = F.array(_issue("critical", "Unreadable or Empty Document Text", _say("No extractable text layers found in uploaded file."), _say("Save and export your resume as a clean, text-based PDF or DOCX file directly from Google Docs or MS Word.")))
    good = F.array_compact(
        F.array(
            _say("Resume text is selectable and machine-readable"),
            _say("Single-column flow detected — optimal for linear ATS scanning engines"),
            _say("No problematic tables detected"),
            F.when(~mixed & (c("bullets") >= 6), _say("Consistent bullet points utilized (", c("bullets"), " bullets found)")),
            F.when(~many_dates, _say("Experience dates are clearly structured")),
            F.when(F.size("grammar") == 0, _say("No obvious grammar issues detected")),
            F.when(F.size("spelling") == 0, _say("No obvious spelling errors detected")),
            F.when(c("has_email"), _say("Contact information is machine-readable and contains valid email")),
            F.when(~long, _say("Ideal document length (", c("pages"), " page", F.when(c("pages") > 1, "s").otherwise(""), ")")),
            F.when(F.array_contains("detected", heavy[0]), _say("Standard work experience section clearly detected")),
            F.when(F.array_contains("detected", heavy[1]), _say("Standard technical skills section clearly detected")),
        )
    )
    single = lambda condition, text: F.when(condition, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    general = F.concat(
        single(mixed, "Standardize on a single bullet point character (e.g., •) across all sections."),
        single(~mixed & (c("bullets") == 0), "Convert dense paragraphs into concise, action-oriented bullet points."),
        single(many_dates, "Standardize date formats across all experience entries."),
        F.transform("grammar", lambda g: _say('Revise grammar: Change "', g["current"], '" to "', g["suggested"], '".')),
        F.transform("spelling", lambda s: _say('Correct spelling of "', s["word"], '" to "', s["suggested"], '".')),
        single(~c("has_email"), "Ensure your primary email address is prominently visible at the top of page 1."),
        single(long, "Trim older responsibilities to condense document length to 1-2 pages."),
        F.transform("missing", lambda s: _say("Add a distinct section heading for '", s, "'.")),
    )
    again = F.array(F.lit("Re-upload a selectable text-based PDF or DOCX file."))
    return F.when(c("readable"), issues).otherwise(empty), F.when(c("readable"), good).otherwise(F.array().cast("array<string>")), F.when(c("readable"), general).otherwise(again)


def issues(analysed: DataFrame, key: str) -> DataFrame:
    """(key, ord, severity, problem, evidence, recommendation): one row per issue, in the order of the rules."""
    return analysed.select(key, F.posexplode(feedback()[0]).alias("p", "i")).select(key, (F.col("p") + 1).alias("ord"), "i.*")


def good_practices(analysed: DataFrame, key: str) -> DataFrame:
    return analysed.select(key, feedback()[1].alias("good"))
