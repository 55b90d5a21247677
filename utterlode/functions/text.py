"""Scalar functions and predicates on utterances, as columns.

Patterns use ``(?U)`` so that classes are Unicode ones. Only ``normalize_key`` of texts beyond ASCII needs Python: Spark
has neither NFKC nor case folding.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed as x


#: White space as Python has it: the Unicode property, and the four separators of ASCII.
SPACE, INK = r"[\s\x1C-\x1F]", r"[^\s\x1C-\x1F]"
NOISE = r"\A[\p{P}\p{S}\p{Z}]+|[\p{P}\p{S}\p{Z}]+\z"


@F.pandas_udf(StringType())
def _normalize_any(text: pd.Series) -> pd.Series:
    import unicodedata

    import regex

    noise = regex.compile(r"\A[\p{P}\p{S}\p{Z}]+|[\p{P}\p{S}\p{Z}]+\Z")

    def key(value: str | None) -> str | None:
        return None if value is None else noise.sub("", " ".join(unicodedata.normalize("NFKC", value).casefold().split()))

    return text.map(key)


def normalize_key(c: Column | str) -> Column:
    """NFKC and case folding, white space collapsed, punctuation, symbols and separators stripped at both ends.

    ASCII texts stay in the JVM; the others alone reach a Python worker.
    """
    c = F.col(c) if isinstance(c, str) else c
    ascii_only = c.rlike(r"\A\p{ASCII}*\z")
    return F.when(ascii_only, F.regexp_replace(F.lower(collapse(c)), NOISE, "")).otherwise(_normalize_any(F.when(~ascii_only, c)))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), rf"(?U){SPACE}+", " ")


def mask_params(c: Column, path: str, number: str) -> Column:
    """Paths, then numbers, become tokens; a text that would only hold tokens stays as it is."""
    masked = F.regexp_replace(F.regexp_replace(c, rf"(?U){INK}*/{INK}*", path), r"(?U)\d+(?:[.:\-]\d+)*", number)
    bare = lambda m: F.replace(F.replace(m, F.lit(number), F.lit("")), F.lit(path), F.lit(""))
    # masked as an element, so that it is worked out once
    return F.transform(F.array(masked), lambda m: F.when(bare(m).rlike(r"[\p{L}\p{N}]"), m).otherwise(c))[0]


def match_key(c: Column) -> Column:
    return mask_params(c, x.PATH_TOKEN, x.NUMBER_TOKEN)


def shown(c: Column) -> Column:
    return mask_params(c, x.PATH_SHOWN, x.NUMBER_SHOWN)


def clip(c: Column, limit: int) -> Column:
    """One line of at most ``limit`` characters, the last an ellipsis if cut."""
    line = collapse(c)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.substring(line, 1, limit - 1), F.lit("…")))


def bigrams(c: Column) -> Column:
    """Distinct character bigrams; a text of one character is its own."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.array_distinct(pairs)


def char_grams(c: Column, least: int, most: int) -> Column:
    """All character n-grams of lengths ``least`` to ``most``, repeats kept."""
    def of(n: int) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
        return F.when(F.length(c) >= n, all_).otherwise(F.array().cast("array<string>"))

    grams = [of(n) for n in range(least, most + 1)]
    return F.concat(*grams)


def digest(c: Column, chars: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, chars)


def utterance_id(session: Column, entry: Column) -> Column:
    return digest(F.concat(session, F.lit(":"), entry), 16)


def project_key(path: Column) -> Column:
    """The first folder of a relative path, or the file's stem."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, parts[0]).otherwise(F.regexp_replace(path, r"(?<=.)\.[^.]*\z", ""))


def day_span(first: Column, last: Column) -> Column:
    """Days between two ISO timestamps; 0 if either is not a date."""
    day = lambda c: F.when(F.substring(c, 1, 10).rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))
    return F.coalesce(F.datediff(day(last), day(first)), F.lit(0))


def display_cwd(c: Column) -> Column:
    return F.regexp_replace(c, r"\A/(?:Users|home)/[^/]+", "~")


def cell(c: Column) -> Column:
    return F.replace(collapse(c), F.lit("|"), F.lit("\\|"))


def contains_any(c: Column, markers: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(m) for m in markers])


def whole_word(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike(rf"(?U)\b(?:{'|'.join(words)})\b")


def is_slash_command(c: Column) -> Column:
    return strip(c).rlike(rf"(?Us)\A/[A-Za-z][\w-]*(?:{SPACE}.*)?\z")


def is_confirm_key(c: Column) -> Column:
    return c.isin(*x.CONFIRM_KEYS) | c.rlike(r"\A[a-z0-9]\z")


def is_correction_key(c: Column) -> Column:
    return contains_any(c, x.CORRECTION_MARKERS)


def is_bare_path(c: Column) -> Column:
    return strip(c).rlike(rf"(?U)\A(?:/|~/){INK}*\z")


def classify_kind(text: Column, key: Column, correction: Column) -> Column:
    """The first rule that fits names the kind (G1)."""
    template = F.regexp_replace(text, rf"(?U)\A{SPACE}+", "").startswith("<skill") | (F.length(key) > x.TEMPLATE_CHARS)
    workflow = whole_word(key, x.WORKFLOW_WORDS) | contains_any(key, x.WORKFLOW_MARKERS)
    return (
        F.when(template, "template").when(correction, "constraint").when(whole_word(key, x.TOOL_WORDS), "tooling")
        .when(workflow, "workflow").when(contains_any(key, x.PREFERENCE_MARKERS), "preference").otherwise("other")
    )


def display_label(text: Column, kind: Column) -> Column:
    skill = F.regexp_extract(text, r'(?U)<skill\s+name="([^"]+)"', 1)
    lines = F.filter(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085  ]"), lambda line: line.rlike(r"(?U)\S"))
    title = F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), text), r"\A[# ]+", "")
    template = F.when(skill != "", F.concat(F.lit("skill: "), skill)).otherwise(clip(title, x.LABEL_CHARS))
    return F.when(kind == "template", template).otherwise(clip(shown(text), x.LABEL_CHARS))


def destination(kind: Column, confidence: Column) -> Column:
    out = F.lit("observe")
    for (k, c), dest in x.DESTINATIONS.items():
        out = F.when((kind == k) & (confidence == c), dest).otherwise(out)
    return out


def review_section(kind: Column, confidence: Column) -> Column:
    return F.when(kind == "template", "template").when(confidence == "medium", "medium").otherwise(kind)


def normalize_vector(v: Column) -> Column:
    """L2 norm 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double")))
    # the norm as an element, so that it is taken once and not for each component
    return F.transform(F.array(F.when(norm == 0, F.lit(1.0)).otherwise(norm)), lambda n: F.transform(v, lambda c: c.cast("double") / n))[0]
