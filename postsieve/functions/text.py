"""Text functions as Spark columns; only NFKC and case folding leave the JVM (Arrow batches)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Unicode white space as Python's str.isspace has it, and word characters as its \w has them.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
WORD = r"\p{L}\p{N}_"
#: Digits by property that are not decimal digits (superscripts, circled and so on).
OTHER_DIGITS = "²³¹፩-፱᧚⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
VARIATION = re.compile("[︎️]")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


@F.pandas_udf(StringType())
def normalise(s: pd.Series) -> pd.Series:
    """NFKC without emoji variation selectors."""
    return s.map(lambda t: t if t is None or t.isascii() else VARIATION.sub("", unicodedata.normalize("NFKC", t)), na_action="ignore")


def normalised(text: str) -> str:
    return VARIATION.sub("", unicodedata.normalize("NFKC", text))


@F.pandas_udf(StructType([StructField("norm", StringType()), StructField("folded", StringType())]))
def normalise_fold(s: pd.Series) -> pd.DataFrame:
    """Normalised text and its case-folded form, in one trip to Python."""
    norm = s.map(normalised, na_action="ignore")
    return pd.DataFrame({"norm": norm, "folded": norm.map(str.casefold, na_action="ignore")})


def with_forms(posts: DataFrame, text: str = "text") -> DataFrame:
    """Adds norm, folded and probe (folded with dotless i as i, for substrings); a null text counts as empty.

    ASCII texts are their own norm and fold to lower case, so only the others are sent to Python.
    """
    t = F.coalesce(text, F.lit(""))
    d = posts.withColumn("_text", t).withColumn("_far", F.when(~t.rlike(r"^[\x00-\x7F]*+$"), t)).withColumn("_t", normalise_fold("_far"))
    d = d.withColumns({"norm": F.coalesce("_t.norm", "_text"), "folded": F.coalesce("_t.folded", F.lower("_text"))})
    return d.withColumn("probe", F.replace("folded", F.lit("ı"), F.lit("i"))).drop("_text", "_far", "_t")


def bounded(pattern: str) -> str:
    """A Java pattern in which \\b at both ends is a Unicode word boundary, for searches that only ask whether it occurs."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return rf"(?iU)(?:^|[^{WORD}]){inner}(?:$|[^{WORD}])"


def term_pattern(term: str) -> str:
    """Java pattern of a case-folded term: bounded, each space or hyphen of it may be any run of separators."""
    parts = re.split(r"[ \-]", term)
    gap = rf"[{SPACE}_\-]*"
    return rf"(?iU)(?:^|[^{WORD}]){gap.join(re.escape(p) for p in parts)}(?:$|[^{WORD}])"


def longest_piece(term: str) -> str:
    """A substring that every match of the term's pattern holds."""
    return max(re.split(r"[ \-]", term), key=len).replace("ı", "i")


def has_word_char(term: str) -> bool:
    return any(c.isalnum() for c in term)


def digits_only(text: Column) -> Column:
    return text.rlike(rf"^[\p{{Nd}}{OTHER_DIGITS}]+$")


def share_of(text: Column, char_class: str) -> Column:
    """Share of the characters of a class, by length in code points; null for an empty text."""
    n = F.char_length(text)
    return F.try_divide((n - F.char_length(F.regexp_replace(text, char_class, ""))).cast("double"), n.cast("double"))


def content_hash(text: Column) -> Column:
    return F.sha1(F.encode(text, "UTF-8"))


def has_symbol(text: Column) -> Column:
    return text.rlike(r"\p{So}")


def _split(pattern: str) -> list[str]:
    """Alternatives at the top level of a pattern."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c in "([") - (c in ")]")
        if c == "|" and depth == 0:
            out.append(pattern[at:i])
            at = i + 1
    return [*out, pattern[at:]]


_PIECE = re.compile(r"(?P<group>\((?P<inner>[^()]*)\))|(?P<other>\[[^\]]*\]|\\.)|(?P<word>[a-z]+)|.")


def _probe_set(alternative: str) -> list[str] | None:
    """Literals of which every match of the alternative holds at least one."""
    best: list[str] | None = None
    for m in _PIECE.finditer(alternative):
        optional = alternative[m.end() : m.end() + 1] in ("?", "*")
        found = None
        if m["word"]:
            found = [m["word"][:-1] if optional else m["word"]]
        elif m["group"] and not optional:
            found = probes(m["inner"])
        if found and min(map(len, found)) > 1 and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found
    return best


def probes(pattern: str) -> list[str] | None:
    """Lower-case literals of which every match of a rule holds at least one; None if there are none.

    They are sought in the case-folded text first, as most texts hold no one of them.
    """
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    while inner.startswith("(") and _closes_at(inner) == len(inner) - 1:
        inner = inner[1:-1]
    sets = [_probe_set(a) for a in _split(inner)]
    return None if any(s is None for s in sets) else [x for s in sets for x in s]


def _closes_at(pattern: str) -> int:
    depth = 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if depth == 0:
            return i
    return -1
