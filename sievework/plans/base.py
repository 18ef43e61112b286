"""How a plan module registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Profiles are texts of documents in which frequent words stand for headings, bullets, skills, dates and contact data.
PROFILE_WORDS = [
    (" with ", "\nWork Experience\n• Develop "),
    (" for ", "\nSkills: python, docker, "),
    (" was ", "\nEducation: bachelor degree\n"),
    (" that ", "\nProjects\nmachine learning "),
    (" on ", " 3 years of experience with sql "),
    (" are ", " developed databse, cut 25% "),
    (" pour ", "\nExperience\n- manage "),
    (" dans ", "\nSkills\npython, kubernetes, java\n"),
    (" sur ", " data scientist, 1,200 users "),
    (" mit ", "\nEmployment History\n* Lead 12 users "),
    (" für ", "\nSkills: sql, machine learning\n"),
    (" von ", "\nEducation\nmaster of science, 2 yrs\n"),
    (" con ", "\nExperience: 7+ yrs\n"),
    (" para ", "\nTechnical Skills: c++, node.js, golang, "),
    (" por ", "\nProjects\nsoftware engineer 01/2020 "),
    (" ist ", " Jan 2021 data analyst seperate "),
    (" una ", " 2019 - 2021 in in "),
    (" est ", " me@site.org linkedin.com/in/me "),
    (" des ", " responsibilities, degree "),
    (" es ", " 555-123-4567 manage "),
]


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with profile-like texts."""
    text = F.col("text")
    for a, b in PROFILE_WORDS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "documents").withColumn("text", text)


def _profile_sql() -> str:
    text = "text"
    for a, b in PROFILE_WORDS:
        quoted = b.replace("\n", "' || chr(10) || '")
        text = f"replace({text}, '{a}', '{quoted}')"
    return f"profiles AS (SELECT doc_id, lang, source, {text} AS text FROM documents)"


#: A common table expression with the same.
PROFILES = _profile_sql()


def registrar(queries: dict, oracle: dict) -> Callable:
    """`@query(name, sql)` over a function of (spark, sf_dir); without sql the query has no oracle."""

    def query(name: str, sql: str | None = None) -> Callable:
        def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
            queries[name] = f
            if sql is not None:
                oracle[name] = sql
            return f

        return add

    return query
