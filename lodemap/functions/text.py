"""Column expressions over text: all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the keyword operators pass over.
STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might shall can need must
and or but if then else when where how what which who whom this that these those
i me my we our you your he she it they them its his her their
in on at to for of with by from as into through during before after above below up down out off over under between
not no nor so too very just also than each every all both few more most other some such only own same
implement add create update remove fix build phase step task plan feature new existing
system application app project code file module use using used make ensure support enable
based level type data set get handle process
post put delete patch request response endpoint status service server client route routes api
url uri http https method body header headers
change changes needs work works current first next last user users account accounts
per via req res min max now later added
""".split()
#: Words that the comparison of requirements passes over.
REQUIREMENT_STOP_WORDS = "the a an is are can with and or in to for of by on at from user system must should".split()


def half_up(x: Column, places: int) -> Column:
    """Round half up on the binary value: floor(x * 10^n + 0.5) / 10^n."""
    p = 10**places
    return F.floor(x * p + 0.5) / p


def loc(text: Column) -> Column:
    """Lines, a trailing line break included."""
    return F.size(F.split(text, "\n"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def snake_case(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "(?<!^)([A-Z])", "_$1"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


#: The branch markers whose occurrences add to a source's complexity.
BRANCHES = (r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"&&", r"\|\|", r"\?")
PYTHON_BRANCHES = (r"\belif\b", r"\bexcept\b")


def complexity(text: Column, language: Column | None = None) -> Column:
    """1 plus the branch markers; Python sources count two more kinds."""
    score = F.lit(1)
    for b in BRANCHES:
        score = score + F.regexp_count(text, F.lit(b))
    if language is not None:
        more = F.lit(0)
        for b in PYTHON_BRANCHES:
            more = more + F.regexp_count(text, F.lit(b))
        score = score + F.when(language == "python", more).otherwise(0)
    return score


def word_set(text: Column) -> Column:
    """Distinct lower-case words, punctuation taken out."""
    clean = F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s]", "")
    return F.array_distinct(F.filter(F.split(clean, r"\s+"), lambda t: t != ""))


def keyword_set(text: Column, stop: list[str] | None = None) -> Column:
    words = F.filter(F.split(F.lower(text), "[^a-z0-9_-]+"), lambda t: (F.length(t) > 1) & ~t.isin(stop or STOP_WORDS))
    return F.array_distinct(words)


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(both_empty)).otherwise(common / union)


def signature(params: Column, most: int = 200) -> Column:
    return F.when(F.length(params) > most, F.concat(F.substring(params, 1, most), F.lit("..."))).otherwise(params)


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)
