"""Regular expressions for searches: the linear-time dialect, whatever runs it.

A pattern is compiled once on the driver by Arrow's matcher, which takes just this
dialect and refuses what is not in it. Patterns that Java runs alike stay
expressions of Spark. Those it doesn't - a repeated group, in which Java's matcher
recurses until a long text ends the executor, and flags inside a pattern, which
mean other things there - go through one vectorised Arrow function, whose time is
linear in the text.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .literals import required_texts

# '.' takes any character, '\n' is the only line end, case folding is Unicode's.
_FLAGS = "(?sdu)"

# ASCII meaning of escapes that Java reads more widely.
_ESCAPES = {
    r"\b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))",
    r"\B": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))",
    r"\s": r"[\t\n\f\r ]",
    r"\S": r"[^\t\n\f\r ]",
    r"\v": r"\x0B",
}

# Named character classes and their Java names.
_NAMED_CLASSES = {
    "alnum": "Alnum",
    "alpha": "Alpha",
    "ascii": "ASCII",
    "blank": "Blank",
    "cntrl": "Cntrl",
    "digit": "Digit",
    "graph": "Graph",
    "lower": "Lower",
    "print": "Print",
    "punct": "Punct",
    "space": "Space",
    "upper": "Upper",
    "xdigit": "XDigit",
}

_TOKEN = re.compile(
    r"\\."  # escaped character
    r"|\[\^?\]?(?:\\.|\[:\^?\w+:\]|[^\]\\])*\]"  # character class
    r"|\(\?(?:P?<[A-Za-z]\w*>|[A-Za-z-]+[:)]|<?[=!>])"  # group opening
    r"|[*+?}][+]"  # possessive quantifier
    r"|.",
    re.S,
)
_BACK_REFERENCE = re.compile(r"\\[1-9k]")
_LOOK_AROUND = re.compile(r"\(\?(?:=|!|<=|<!|>)")
_PLAIN = re.compile(r"[A-Za-z0-9_ ,:;/@%&=~'\"<>#!-]*")


def java_pattern(pattern: str, anchored: bool = False) -> str:
    """The Java form of `pattern`; raises ValueError for what needs backtracking."""
    multi_line = re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    parts = []
    for token in _TOKEN.findall(pattern):
        if _BACK_REFERENCE.match(token) or _LOOK_AROUND.match(token):
            raise ValueError(f"look-around and back-references are not supported: {pattern!r}")
        if len(token) == 2 and token[0] in "*+?}" and token[1] == "+":
            raise ValueError(f"possessive quantifiers are not supported: {pattern!r}")
        if token == "$" and not multi_line:
            token = r"\z"  # the end of the text, not the place before a last '\n'
        elif token.startswith("(?P<"):
            token = "(?<" + token[4:]
        elif len(token) > 1 and token[0] == "[":
            token = _java_class(token)
        parts.append(_ESCAPES.get(token, token))
    body = "".join(parts)
    return _FLAGS + (rf"\A(?:{body})\z" if anchored else body)


def _java_class(token: str) -> str:
    """A character class in which '[' and '&&' mean themselves."""
    def named(found: re.Match) -> str:
        negated, name = found.groups()
        if name == "word":
            return r"\W" if negated else r"\w"
        return rf"\{'P' if negated else 'p'}{{{_NAMED_CLASSES[name]}}}"

    opening = re.match(r"\[\^?\]?", token).group()
    inner = token[len(opening) : -1]
    pieces = re.split(r"(\\.|\[:\^?\w+:\])", inner, flags=re.S)
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            pieces[i] = piece.replace("[", r"\[").replace("&&", r"&\&")
        elif piece.startswith("[:"):
            pieces[i] = re.sub(r"\[:(\^?)(\w+):\]", named, piece)
    return opening.replace("]", r"\]") + "".join(pieces) + "]"


def runs_alike(pattern: str) -> bool:
    """Whether Java gives the same answers for the pattern, and safely on any text."""
    tokens = _TOKEN.findall(pattern)
    for before, token in zip(["", *tokens], tokens):
        if before == ")" and token in ("*", "+", "{"):
            return False
        if token.startswith("(?") and re.fullmatch(r"\(\?[A-Za-z-]+[:)]", token):
            return False
    return True


def arrow_match(text: Column, pattern: str, anchored: bool = False) -> Column:
    """Whether the text holds the pattern, by Arrow's linear-time matcher."""
    expression = _arrow_pattern(pattern, anchored)

    @F.arrow_udf("boolean")
    def matches(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, expression)

    return matches(text)


def _arrow_pattern(pattern: str, anchored: bool = False) -> str:
    body = "".join(
        "(?P<" + token[3:] if re.fullmatch(r"\(\?<[A-Za-z]\w*>", token) else token
        for token in _TOKEN.findall(pattern)
    )
    return rf"(?s)\A(?:{body})\z" if anchored else f"(?s){body}"


def _check_dialect(pattern: str) -> None:
    try:
        pc.match_substring_regex(pa.array(["x"]), _arrow_pattern(pattern))
    except pa.ArrowInvalid as error:
        raise ValueError(f"invalid regular expression: {pattern!r}") from error


def check_pattern(spark: SparkSession, pattern: str, anchored: bool = False) -> str:
    """Compile on the driver, so that a bad pattern fails before any task runs."""
    compiled = java_pattern(pattern, anchored)
    _check_dialect(pattern)
    try:
        spark.sql("SELECT 'x' RLIKE :p AS ok", args={"p": compiled}).collect()
    except Exception as error:
        if "PATTERN" in str(error):
            raise ValueError(f"invalid regular expression: {pattern!r}") from error
        raise
    return compiled


def full_match(spark: SparkSession, text: Column, pattern: str) -> Column:
    """`text` matches `pattern` from end to end.

    The shapes that need no regex engine become comparisons, which Spark
    pushes into the Parquet scan.
    """
    if pattern == ".*":
        return text.isNotNull()
    if pattern == ".+":
        return text != ""
    if pattern.endswith(".*") and _PLAIN.fullmatch(pattern[:-2]):
        return text.startswith(pattern[:-2])
    options = pattern.split("|")
    if all(_PLAIN.fullmatch(option) for option in options):
        return text == pattern if len(options) == 1 else text.isin(options)
    compiled = check_pattern(spark, pattern, anchored=True)
    return text.rlike(compiled) if runs_alike(pattern) else arrow_match(text, pattern, anchored=True)


def search_match(spark: SparkSession, text: Column, pattern: str) -> Column:
    """`pattern` occurs somewhere in `text`.

    Texts that the pattern needs are looked for first; only where they stand is the
    matcher run (and only those texts are handed to Arrow).
    """
    if _PLAIN.fullmatch(pattern):
        return text.contains(pattern)
    compiled = check_pattern(spark, pattern)
    tests = [reduce(Column.__or__, map(text.contains, texts)) for texts in required_texts(pattern)]
    first = reduce(Column.__and__, tests) if tests else None
    if runs_alike(pattern):
        found = text.rlike(compiled)
    else:
        found = arrow_match(text if first is None else F.when(first, text), pattern)
    return found if first is None else first & found


def valid_trace_id_col(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-f]{32}\z")


def is_valid_trace_id(text: str) -> bool:
    return re.fullmatch(r"[0-9a-f]{32}", text) is not None
