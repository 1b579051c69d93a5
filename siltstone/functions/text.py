"""Text functions as column expressions.

Semantics that differ from Spark's defaults are kept here in one place: white space is Unicode
white space, an empty string is "missing" like null, and a term is matched as a substring.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_SPECIFIED = "Not Specified"
CELL = " | "
#: What a field name keeps of a label; all else becomes one underscore.
NAME_PART = "[a-z0-9]+"
#: Words that end a phrase.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been before both but by can could do does during each for from had has have he her his how i if in into is it its "
    "may might more most no nor not of on or other our over she should so some such than that the their them then there these they this those through to under until up very "
    "was we were what when where which while who will with would you your".split()
)
#: White space of all kinds, inside a character class.
BLANK = r"\s\x{1C}-\x{1F}\x{85}\p{Z}"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_label(c: Column) -> Column:
    return F.lower(strip(c))


def missing(c: Column) -> Column:
    """Null or empty; white space alone counts as text."""
    return F.coalesce(c, F.lit("")) == ""


def sentences(c: Column) -> Column:
    """Split after a full stop, exclamation or question mark that white space follows."""
    return F.split(c, r"(?U)(?<=[.!?])\s+", -1)


def matching(sents: Column, term: Column) -> Column:
    """The sentences whose lower-cased form contains the term as given."""
    return F.filter(sents, lambda s: F.contains(F.lower(s), term))


def joined_matches(text: Column, term: Column) -> Column:
    return F.array_join(matching(sentences(text), term), CELL)


def slug(c: Column) -> Column:
    """Field name of a label; see :func:`siltstone.schemas.slug`."""
    s = F.array_join(F.regexp_extract_all(F.lower(c), F.lit(f"({NAME_PART})")), "_")
    return F.when(s == "", "concept").otherwise(s)


def collection_slug(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit(" "), F.lit("_")))


def doi_url(c: Column) -> Column:
    """A bare DOI as a URL; urls and "Not Specified" stay; missing becomes "Not Specified"."""
    return F.when(missing(c), NOT_SPECIFIED).when((c == NOT_SPECIFIED) | F.startswith(c, F.lit("http")), c).otherwise(F.concat(F.lit("https://doi.org/"), c))


def cell(value: Column, quote: Column) -> Column:
    """``value | quote``, either alone, or empty."""
    return F.concat_ws(CELL, F.nullif(value, F.lit("")), F.nullif(quote, F.lit("")))


def prefer(*texts: Column) -> Column:
    """The first text that is not missing, else empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def author_names(authors: Column) -> Column:
    """Last names of ``array<struct<lastName>>`` joined by "; ", blanks left out."""
    names = F.transform(authors, lambda a: a["lastName"])
    return F.array_join(F.filter(names, lambda n: ~missing(n)), "; ")


def bullets(labels: Column) -> Column:
    return F.array_join(F.transform(labels, lambda x: F.concat(F.lit("- "), x)), "\n")


OPENING, ABSTRACT = "How the text begins:", "Its abstract:"


def context_block(title: Column, doi: Column, authors: Column, full_text: Column, abstract: Column, opening: int = 2000) -> Column:
    """What a structured extractor is given of one paper; parts that are missing are left out."""
    part = lambda head, c: F.when(~missing(c), F.concat(F.lit(head), c))
    start = F.substring(full_text, 1, opening)
    return F.concat_ws(
        "\n", F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))), F.when(~missing(doi), F.concat(F.lit("DOI (from metadata): "), doi_url(doi))),
        part("Authors (from metadata): ", author_names(authors)), part(f"\n{OPENING}\n", start), part(f"\n{ABSTRACT}\n", abstract),
    )


def tag_text(tags: Column, prefix: str = "mds:") -> Column:
    """``mds:a, mds:b``; empty without tags."""
    return F.coalesce(F.array_join(F.transform(tags, lambda t: F.concat(F.lit(prefix), t)), ", "), F.lit(""))


def primary_tag(text: Column, prefix: str = "mds:") -> Column:
    return F.lower(strip(F.split_part(F.replace(F.coalesce(text, F.lit("")), F.lit(prefix), F.lit("")), F.lit(","), F.lit(1))))


def file_stem_slug(path: Column) -> Column:
    """``.../concepts_topic-user-v1-date.csv`` -> ``topic``."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), "concepts_", "")
    return F.split_part(stem, F.lit("-"), F.lit(1))


def round_exact(c: Column, digits: int = 4) -> Column:
    """Rounds the exact binary value, half to even, as the tables' authors did; the SQL functions round
    the decimal rendering and differ in the last digit. An Arrow UDF."""

    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda v: round(float(v), digits), na_action="ignore").astype("float64")

    return of(c)


def title_case(c: Column) -> Column:
    """A slug as a title: each run of letters has its first one upper-cased, also after a digit or a mark
    (``initcap`` looks at spaces only)."""
    runs = F.split(F.replace(c, F.lit("_"), F.lit(" ")), r"(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def elapsed(seconds: Column) -> Column:
    """Whole seconds as ``2m 05s``, or ``42s`` below a minute."""
    minutes, rest = F.floor(seconds / 60), (seconds % 60).cast("int")
    return F.when(minutes > 0, F.format_string("%dm %02ds", minutes, rest)).otherwise(F.format_string("%ds", rest))


def word_runs(text: Column) -> Column:
    """Runs of words between stop words and marks, lower-cased, in order, repeats included; some may be empty. A
    word begins with a letter or digit and goes on with these, hyphens and underscores.

    A few replacements over the whole text, in which a bar stands for a break, keep it in generated code.
    """
    by_letter: dict[str, list[str]] = {}
    for w in sorted(STOP_WORDS, reverse=True):
        by_letter.setdefault(w[0], []).append(w[1:])
    stop = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items()))
    s = F.concat(F.lit(" "), F.lower(text))
    s = F.regexp_replace(s, rf"[^\p{{L}}\p{{N}}_{BLANK}-]+", "|")
    s = F.regexp_replace(s, rf"[{BLANK}|][_-]*(?:{stop})(?![^{BLANK}|])", "|")
    s = F.regexp_replace(s, rf"[{BLANK}][{BLANK}_-]+|[{BLANK}&&[^ ]]", " ")
    return F.split(F.trim(s), r" ?\|[ |_-]*")


def spaced_words(text: Column) -> Column:
    """Lower-cased text with each run of marks as a bar between blanks: split at white space, without leading hyphens and
    underscores, and with stop words as bars, its words are those of :func:`word_runs`, the bars its breaks."""
    return F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_{BLANK}-]+", " | ")


def noun_phrases(text: Column, least_words: int = 1, longer_than: int = 4) -> Column:
    """:func:`word_runs` that are long enough, each once: an approximation of noun chunks without their determiners
    and pronouns."""
    fine = lambda p: (F.length(p) > longer_than) & (F.lit(True) if least_words < 2 else F.size(F.split(p, " ")) >= least_words)
    return F.array_distinct(F.filter(word_runs(text), fine))


def group_columns(n: Column, low: int = 3, high: int = 8) -> Column:
    """Columns of a grid of n nodes, about 3:2."""
    best = F.rint(F.sqrt(n * 1.5))
    return F.when(n <= low, F.greatest(n, F.lit(1))).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), best))).cast("int")
