"""Text patterns: literal or regular-expression match, and file-name globs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from logspark.session import ship_package

# A pattern holding one of these is a regular expression.
REGEX_CHARACTERS = "$()*+.?[\\]^{|}"

# POSIX classes and their Java spelling (used inside brackets).
POSIX_CLASSES = {
    "alnum": r"\p{Alnum}",
    "alpha": r"\p{Alpha}",
    "ascii": r"\p{ASCII}",
    "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}",
    "graph": r"\p{Graph}",
    "lower": r"\p{Lower}",
    "print": r"\p{Print}",
    "punct": r"\p{Punct}",
    "space": r"\p{Space}",
    "upper": r"\p{Upper}",
    "word": r"\w",
    "xdigit": r"\p{XDigit}",
}


def is_regex(pattern: str) -> bool:
    return any(c in REGEX_CHARACTERS for c in pattern)


# Pieces whose spelling or meaning differs between the two regex dialects.
_PIECES = re.compile(
    r"""
      (?P<posix>\[:(?P<neg>\^?)(?P<name>\w+):\])
    | (?P<named>\(\?P<(?!=))
    | (?P<flags>\(\?[a-z]*U[a-zA-Z-]*[:)])
    | (?P<look>\(\?(?:<?[=!]|>))
    | (?P<possessive>(?:[*+?]|\{[0-9,]+\})\+)
    | (?P<escape>\\(?s:.))
    | (?P<open>\[\^?\]?)
    | (?P<close>\])
    | (?P<and>&&)
    | (?P<dollar>\$)
    """,
    re.VERBOSE,
)


def java_regex(pattern: str) -> str:
    """Spell an RE2 pattern for Spark's ``rlike``.

    Translated: POSIX classes, ``(?P<name>``, ``$`` (end of text only, unless the
    pattern turns on multi-line mode), and characters that are special only inside
    Java brackets. Ungreedy mode and ``\\C`` have no Java form and are refused, and so is
    what RE2 does not have: look-around, atomic groups, possessive repeats, back-references.
    """
    multi_line = re.search(r"\(\?[a-z]*m", pattern) is not None
    inside = False

    def spell(piece: re.Match) -> str:
        nonlocal inside
        text, kind = piece.group(), piece.lastgroup
        if kind == "escape":
            if text in (r"\C", r"\k") or (text[1].isdigit() and text[1] != "0"):
                raise ValueError(f"pattern not supported: {pattern!r}")
            return text
        if piece.group("posix") and inside:
            java = POSIX_CLASSES.get(piece.group("name"))
            if java is None:
                raise ValueError(f"unknown character class in {pattern!r}")
            return f"[^{java}]" if piece.group("neg") else java
        if piece.group("posix") or kind == "open":
            if inside:
                return text.replace("[", r"\[").replace("^]", "^\\]")
            inside = True
            if piece.group("posix"):  # "[:word:]" outside brackets is a plain set
                inside = False
                return text
            return text[:-1] + r"\]" if text.endswith("]") else text
        if kind == "close":
            inside = False
            return text
        if kind == "and":
            return r"&\&" if inside else text
        if kind == "dollar":
            return text if inside or multi_line else r"\z"
        if kind == "named":
            return text if inside else "(?<"
        if inside:
            return text
        raise ValueError(f"pattern not supported: {pattern!r}")

    return "(?d)" + _PIECES.sub(spell, pattern)


def matches(text: Column, pattern: str) -> Column:
    """True where the text contains the pattern (literal or regular expression)."""
    if is_regex(pattern):
        return text.rlike(java_regex(pattern))
    return F.contains(text, F.lit(pattern))


# Literals up to which each is an expression of its own; more become an automaton, so that
# neither the plan nor the work for a character grows with the list.
FEW_PATTERNS = 16
# Bytes of literals that one automaton is built from; it takes some 50 times as much memory.
AUTOMATON_BYTES = 4 << 20


def matches_any(text: Column, patterns: str | Iterable[str]) -> Column:
    """True where at least one pattern matches; no pattern matches nothing.

    Few literals are looked for one by one. Many go to Aho-Corasick automata, which pass over
    a text once whatever their number; they are built once in each Python worker from a
    broadcast list of bounded size, a further list for each :data:`AUTOMATON_BYTES`. Many
    regular expressions become one alternation.
    """
    patterns = [patterns] if isinstance(patterns, str) else list(dict.fromkeys(patterns))
    literals = [p for p in patterns if not is_regex(p)]
    regexes = [p for p in patterns if is_regex(p)]
    if len(literals) > FEW_PATTERNS:
        found = [_contains_any(text, part) for part in _parts(shortest_only(literals), AUTOMATON_BYTES)]
    else:
        found = [F.contains(text, F.lit(p)) for p in literals]
    # Group names would clash in one expression.
    single = [p for p in regexes if "(?P<" in p or len(regexes) <= FEW_PATTERNS]
    joined = [java_regex(p) for p in regexes if p not in single]
    found += [text.rlike(java_regex(p)) for p in single]
    if joined:
        found.append(text.rlike("|".join(f"(?:{p})" for p in joined)))
    return reduce(lambda a, b: a | b, found, F.lit(False))


def shortest_only(literals: Iterable[str]) -> list[str]:
    """Without literals that begin with another one: where they stand, it stands as well."""
    kept: list[str] = []
    for literal in sorted(literals):
        if not kept or not literal.startswith(kept[-1]):
            kept.append(literal)
    return kept


def _parts(literals: list[str], most: int) -> list[list[str]]:
    """The list in pieces of about ``most`` bytes."""
    parts, size = [[]], 0
    for literal in literals:
        size += len(literal.encode())
        if parts[-1] and size > most:
            parts.append([])
            size = len(literal.encode())
        parts[-1].append(literal)
    return parts


_automata: dict[str, object] = {}


def _automaton(key: str, literals: list[str]):
    """The automaton of a list, built once in each worker."""
    found = _automata.get(key)
    if found is None:
        import ahocorasick

        found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for literal in literals:
            found.add_word(literal)
        found.make_automaton()
        if len(_automata) >= 8:
            _automata.clear()
        _automata[key] = found
    return found


def _contains_any(text: Column, literals: list[str]) -> Column:
    if literals[0] == "":  # sorted: the empty text stands everywhere
        return F.when(text.isNotNull(), True)
    spark = SparkSession.active()
    ship_package(spark)
    sent = spark.sparkContext.broadcast(literals)
    key = uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = _automaton(key, sent.value).iter
        for batch in texts:
            yield batch.map(lambda t: next(search(t), None) is not None, na_action="ignore").astype("boolean")

    return found(text)


def glob_regex(glob: str) -> str:
    """Anchored regex of a shell file-name pattern (``*``, ``?``, ``[a-z]``, ``\\x``)."""
    token = re.compile(r"\*|\?|\[(\^?)((?:\\.|[^\]\\])+)\]|\\(.)|([^*?\[\\])", re.DOTALL)
    out, at = [], 0
    while at < len(glob):
        piece = token.match(glob, at)
        if piece is None:
            raise ValueError(f"invalid glob: {glob!r}")
        negated, members, escaped, plain = piece.groups()
        if members is not None:
            safe = re.sub(r"(?<!\\)([\[&~^])", r"\\\1", members)
            out.append(f"[{negated}{safe}]")
        elif escaped or plain:
            out.append(re.escape(escaped or plain))
        else:
            out.append("[^/]*" if piece.group() == "*" else "[^/]")
        at = piece.end()
    regex = "^(?:" + "".join(out) + r")\z"
    try:
        re.compile(regex.replace(r"\z", r"\Z"))
    except re.error as e:
        raise ValueError(f"invalid glob: {glob!r}") from e
    return regex


@cache
def _compiled_glob(glob: str) -> re.Pattern:
    return re.compile(glob_regex(glob).replace(r"\z", r"\Z"), re.DOTALL)


def glob_matches(name: str, glob: str) -> bool:
    """The same match for a name known on the Python side."""
    return _compiled_glob(glob).match(name) is not None


def glob_matches_any(name: Column, globs: Iterable[str]) -> Column:
    """True where a base name matches at least one glob; no glob matches nothing."""
    regexes = [glob_regex(g) for g in globs]
    # One search for all; this is asked of every line.
    return name.rlike("|".join(regexes)) if regexes else F.lit(False)
