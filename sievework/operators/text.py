"""Cleaning and per-document functions: column expressions over one text column, no shuffle."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import columns as C

#: Typographic characters and what they become.
TYPOGRAPHY = [("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), (" ", " "), ("﻿", ""), ("•", " "), ("…", "...")]

#: Masks of contact data.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b"
PHONE = r"\(?\b[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"
#: The first e-mail, phone number and all links of a text.
FIRST_EMAIL, FIRST_PHONE, URL = r"[\w.+-]+@[\w-]+\.[\w.-]+", r"[+]?[\d\s()-]{10,15}", r"https?://[^\s)\]>]+"
#: Headers that extraction repeats.
HEADERS = "SKILLS|EXPERIENCE|EDUCATION|PROJECTS|SUMMARY|OBJECTIVE|CERTIFICATIONS"
#: Artifacts of extraction and what they become, in order.
ARTIFACTS = [
    (r"[•·▪▸►▶◆★☆○●]{3,}", " "),
    (r"\r\n", "\n"),
    (r"\r", "\n"),
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""),
    (r"[-_=]{5,}", " "),
    (r"([~`!@$%^&*()+={}\[\]|\\:;\"'<>,.?/])\1{4,}", "$1"),
    (r"[ \t]{2,}", " "),
    (r"\n{3,}", "\n\n"),
]


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def without_accents(text: Column) -> Column:
    """NFKD without combining marks; ASCII rows skip the UDF by a null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.regexp_replace(F.coalesce(_nfkd(F.when(~ascii_only, text)), text), r"\p{Mn}", "")


def unicode_clean(text: Column, compose: bool = True) -> Column:
    """NFC, then plain typography. The UDF sees rows outside ASCII only in effect: ASCII rows skip it by a null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    out = F.coalesce(_nfc(F.when(~ascii_only, text)), text) if compose else text
    singles = [(a, b) for a, b in TYPOGRAPHY if len(b) == 1]
    out = F.translate(out, "".join(a for a, _ in singles), "".join(b for _, b in singles))
    for a, b in TYPOGRAPHY:
        if len(b) != 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def remove_artifacts(text: Column) -> Column:
    """Repeated headers once, then runs of bullets, line ends, control characters, rules, runs of marks, blanks and empty lines."""
    out = F.regexp_replace(text, rf"(?iU)({HEADERS})(\s*+(?:[:\-•]\s*+)?\1)+", "$1")
    for pattern, by in ARTIFACTS:
        out = F.regexp_replace(out, pattern, by)
    return out


def mask_contacts(text: Column) -> Column:
    """Boundaries are those of Unicode words."""
    return F.regexp_replace(F.regexp_replace(text, f"(?U){EMAIL}", "[EMAIL]"), f"(?U){PHONE}", "[PHONE]")


def flag(text: Column, min_chars: int = 100) -> Column:
    n = F.length(F.trim(text))
    return F.when(n == 0, "empty").when(n < min_chars, "short").otherwise("ok")


def clean(df: DataFrame, text: str, compose: bool = True, mask: bool = False, min_chars: int = 100, drop_flagged: bool = False) -> DataFrame:
    """The cleaning pipeline in one projection: adds `_text_clean_flag`, replaces the text."""
    t = F.coalesce(F.when(F.col(text) != "nan", F.col(text)), F.lit(""))
    t = remove_artifacts(unicode_clean(t, compose))
    if mask:
        t = mask_contacts(t)
    out = df.withColumn(text, F.regexp_replace(t, C.OUTER_SPACE, "")).withColumn("_text_clean_flag", flag(F.col(text), min_chars))
    return out.where("_text_clean_flag = 'ok'") if drop_flagged else out


def compat_clean(text: Column) -> Column:
    """NFKD, without C0 and C1 controls, single blanks, at most one empty line."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    out = F.coalesce(_nfkd(F.when(~ascii_only, text)), text)
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def match_key(text: Column) -> Column:
    """Lower case, letters, digits and `_ . + #` only, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s.+#]", " "), r"\s+", " "))


def first_match(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", found)


def email(text: Column) -> Column:
    # a match can only begin where a run of its characters does
    return F.lower(first_match(text, rf"(?U)(?<![\w.+-]){FIRST_EMAIL}"))


def phone(text: Column) -> Column:
    """The first 10 to 15 characters of digits, blanks, brackets and dashes, without blanks at the ends."""
    return C.strip(first_match(text, f"(?U){FIRST_PHONE}"))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){URL}"), 0)


def snippet(text: Column, n: int) -> Column:
    return F.array_join(F.slice(C.words(text), 1, n), " ")


def windows(df: DataFrame, key: str, text: str, size: int = 240, stride: int = 160) -> DataFrame:
    """Sliding word windows: key, chunk, chunk_text."""
    w = df.select(key, C.words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - size) / stride).cast("int")))
    return w.select(key, "w", F.explode(starts).alias("chunk")).select(key, "chunk", F.array_join(F.slice("w", F.col("chunk") * stride + 1, F.lit(size)), " ").alias("chunk_text"))


def _chunks(size: int) -> Callable[[pa.Array], pa.Array]:
    gap, word = re.compile("\n[ \\t-\\r]*\n"), re.compile(f"[^{C.WHITE}]+")

    def of(text: str) -> list[str]:
        done, parts, length = [], [], 0

        def close() -> None:
            nonlocal parts, length
            if parts:
                done.append("".join(parts))
            parts, length = [], 0

        def add(piece: str, glue: str) -> None:
            nonlocal length
            if length + len(piece) + 1 > size:
                close()
            elif parts:
                parts.append(glue)
                length += 1
            parts.append(piece)
            length += len(piece)

        for p in gap.split(text):
            p = p.strip(" ")
            if len(p) > size:
                # starts anew, word by word; its last part stays open for the next paragraph
                close()
                for m in word.finditer(p):
                    add(m[0], " ")
            elif p:
                add(p, "\n")
        close()
        return done

    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        parts = [pa.array([of(t) if t else [] for t in texts.slice(start, C.TEXTS).to_pylist()], kind) for start in range(0, len(texts), C.TEXTS)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


def paragraphs(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """Paragraph-greedy chunks of at most `size` characters; long paragraphs are split at words, the tail carried on; every chunk
    begins with the last `overlap` characters of its predecessor. One pass over each text, by Arrow batch, no shuffle."""
    chunks = F.arrow_udf(_chunks(size), ArrayType(StringType()))(F.col(text))
    rows = df.select(key, chunks.alias("chunks")).select(key, "chunks", F.posexplode("chunks").alias("chunk", "body"))
    tail = F.when(F.col("chunk") > 0, F.expr(f"right(chunks[chunk - 1], {overlap})"))
    return rows.select(key, "chunk", F.when(tail.isNotNull(), F.concat(tail, F.lit(" "), F.col("body"))).otherwise(F.col("body")).alias("chunk_text"))


#: Sections and the words that open them.
SECTIONS = {
    "skills": ["skills", "technical skills", "technologies", "competencies", "core competencies", "tools"],
    "experience": ["experience", "work experience", "employment", "professional experience", "work history"],
    "education": ["education", "academic background", "qualifications", "academics"],
    "projects": ["projects", "personal projects", "academic projects", "key projects"],
}


def sections(text: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """A map of section to text: a line that starts with a synonym, or holds one before a colon, opens its section and is dropped; lines
    before the first are `general`; a later section of the same name replaces the earlier one, unless no line follows its header. The order
    of `synonyms` decides between several. No shuffle; lines are looked at once and joined once, so the work grows with the text."""
    synonyms = synonyms or SECTIONS
    spans = "map<string,struct<first:int,stop:int>>"

    def opens(low: Column, names: list[str]) -> Column:
        words = "|".join(f"\\Q{w.lower()}\\E" for n in names for w in synonyms[n])
        return low.rlike(f"^(?:{words})") | (low.contains(":") & low.rlike(f"(?:{words}):"))

    def head(line: Column) -> Column:
        def of(low: Column) -> Column:
            out = F.lit(None).cast("string")
            for name in reversed(list(synonyms)):
                out = F.when(opens(low, [name]), F.lit(name)).otherwise(out)
            return F.when(opens(low, list(synonyms)), out)

        return C.let(C.strip(F.lower(line)), of)

    def last(heads: Column, lines: Column) -> Column:
        """The lines, from and to, of each name's last section that has any."""
        ranges = F.transform(heads, lambda x, i: F.struct(x["name"].alias("name"), (x["at"] + 1).alias("first"), F.coalesce(F.get(heads, i + 1)["at"], F.size(lines)).alias("stop")))
        put = lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["name"]), F.create_map(x["name"], F.struct(x["first"].alias("first"), x["stop"].alias("stop")))).cast(spans)
        return F.aggregate(F.filter(ranges, lambda x: x["stop"] > x["first"]), F.create_map().cast(spans), put)

    def found(lines: Column) -> Column:
        headed = F.filter(F.transform(lines, lambda x, i: F.struct(head(x).alias("name"), i.alias("at"))), lambda x: x["name"].isNotNull())
        ranges = C.let(F.concat(F.array(F.struct(F.lit("general").alias("name"), F.lit(-1).alias("at"))), headed), lambda heads: last(heads, lines))
        return F.transform_values(ranges, lambda k, v: C.strip(F.array_join(F.slice(lines, v["first"] + 1, v["stop"] - v["first"]), "\n")))

    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\R\z", "")
    return C.let(F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\R", -1)), found)


#: Words of titles; what opens and what ends each field.
TITLES = ["director", "manager", "engineer", "specialist", "analyst", "consultant", "officer", "coordinator", "instructor", "teacher", "attorney", "chef", "nurse", "artist"]
FIELDS = {
    "skills": (r"skills|core competencies|expertise|technical skills", r"experience|employment|work history|education"),
    "education": (r"education|academic background|degree", r"experience|employment|skills|certifications"),
    "experience": (r"experience|work history|employment history", r"education|skills|certifications"),
}


def profile_fields(text: Column) -> dict[str, Column]:
    """title: the first of the first six lines with a title word, else the first line; skills: six of up to eight items of three or more
    characters; education: two lines, 150 characters; experience: three lines, 250 characters. Each has a default."""
    t = F.coalesce(text, F.lit(""))
    body = {n: F.regexp_extract(t, rf"(?isU)(?:{a})[\s:]+(.*?)(?:{b}|\z)", 1) for n, (a, b) in FIELDS.items()}
    stripped = lambda x, by: F.transform(F.split(x, by), C.strip)
    full = lambda x: F.filter(stripped(x, "\n"), lambda v: v != "")
    lines = full(t)
    titled = F.get(F.filter(F.slice(lines, 1, 6), lambda x: F.lower(x).rlike("|".join(TITLES))), 0)
    skills = F.slice(F.filter(stripped(C.strip(body["skills"]), r"[,•\n|;]+"), lambda v: F.length(v) > 2), 1, 6)
    joined = lambda n, k, most: F.substring(F.array_join(F.slice(full(body[n]), 1, k), " | "), 1, most)
    or_else = lambda x, default: F.when(x == "", default).otherwise(x)
    return {
        "title": F.coalesce(titled, F.get(lines, 0), F.lit("Unknown")),
        "skills": or_else(F.array_join(skills, ", "), "Demonstrated domain skills in resume body"),
        "education": or_else(joined("education", 2, 150), "Not explicitly stated"),
        "experience": or_else(joined("experience", 3, 250), "Experienced professional"),
    }
