"""The tag query language: text to terms, terms to a column.

A query is a list of clauses that all must hold. A clause is one term, or two joined by
"or". Parsing makes plain values that know nothing of Spark; condition() turns them into
one boolean column with SQL's three-valued logic, so a row whose term is null is dropped
whether or not the term is negated.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.text import has_tag, wildcard_pattern

#: The numeric prefixes, the names of ratings, and the orders.
NUMERIC = {"score": "score", "favcount": "fav_count", "width": "image_width", "height": "image_height", "id": "id"}
RATING_NAMES = {"general": "g", "sensitive": "s", "questionable": "q", "explicit": "e"}
ORDERS = {
    "id": ("id", False), "id_asc": ("id", False), "id_desc": ("id", True),
    "score": ("score", True), "score_desc": ("score", True), "score_asc": ("score", False),
    "favcount": ("fav_count", True), "favcount_desc": ("fav_count", True), "favcount_asc": ("fav_count", False),
    "created_at": ("created_at", True), "created_at_desc": ("created_at", True), "created_at_asc": ("created_at", False),
    "date": ("created_at", True), "date_desc": ("created_at", True), "date_asc": ("created_at", False),
    "random": ("random", False),
}
PIXIV_ID = r"pixiv\.net\/artworks\/(\d+)"


@dataclass(frozen=True)
class Range:
    """Bounds of a number; both absent is always true."""

    low: int | None = None
    high: int | None = None

    def holds(self, c: Column) -> Column:
        tests = [c >= self.low] * (self.low is not None) + [c <= self.high] * (self.high is not None)
        return reduce(Column.__and__, tests, F.lit(True))


def number_range(text: str) -> Range:
    """">=5", "<=5", ">5", "<5", "2..5", "2..", "..5", "..", or "5"; ValueError for no integer."""
    signed = re.match(r"([<>]=?)(.*)$", text, re.S)
    if signed:
        sign, n = signed[1], int(signed[2])
        return Range(low=n + (sign == ">")) if sign[0] == ">" else Range(high=n - (sign == "<"))
    if ".." in text:
        low, high = text.split("..")[:2]
        return Range(int(low) if low else None, int(high) if high else None)
    return Range(int(text), int(text))


@dataclass(frozen=True)
class Term:
    """One test: kind is number, rating, source, pixiv, tag or wildcard."""

    kind: str
    name: str = ""
    value: object = None
    negated: bool = False

    def column(self) -> Column:
        return getattr(self, f"_{self.kind}")()

    def _sign(self, c: Column) -> Column:
        return ~c if self.negated else c

    def _number(self) -> Column:
        return self._sign(self.value.holds(F.col(self.name)))

    def _rating(self) -> Column:
        return self._sign(F.col("rating").isin(list(self.value)))

    def _known(self, c: Column) -> Column:
        """A test on a URL: a post without one passes neither the test nor its negation."""
        return ~F.coalesce(c, F.lit(True)) if self.negated else F.coalesce(c, F.lit(False))

    def _source(self) -> Column:
        url = F.col("file_url")
        if self.name == "none":
            return self._known(url.isNull())
        return self._known(url.rlike(self.value) if self.name == "pattern" else F.startswith(url, F.lit(self.value)))

    def _pixiv(self) -> Column:
        url = F.col("file_url")
        if self.name == "id":
            number = F.nullif(F.regexp_extract(url, PIXIV_ID, 1), F.lit("")).try_cast("long")
            return self._known(self.value.holds(number))
        return self._known(url.rlike(self.value))

    def _tag(self) -> Column:
        return self._sign(has_tag(F.col("tag_string"), self.value))

    def _wildcard(self) -> Column:
        padded = F.concat(F.lit(" "), F.coalesce("tag_string", F.lit("")), F.lit(" "))
        return self._sign(padded.rlike(self.value))


def parse_term(token: str, *, safe_rating: bool = False) -> Term:
    negated = token.startswith("-")
    token = token[negated:]
    name, colon, value = token.partition(":")
    if safe_rating and token.lower() == "rating:safe":
        name, value = "rating", "g,s"
    if colon and name in NUMERIC:
        return Term("number", NUMERIC[name], number_range(value), negated)
    if colon and name == "rating":
        return Term("rating", value=tuple(RATING_NAMES.get(v, v) for v in value.split(",")), negated=negated)
    if colon and name == "source":
        return _source_term(value, negated)
    if colon and name == "pixiv":
        return _pixiv_term(value, negated)
    if "*" in token:
        return Term("wildcard", token, r"(^|\s)" + wildcard_pattern(token, r"\S*") + r"($|\s)", negated)
    return Term("tag", value=token, negated=negated)


def _source_term(value: str, negated: bool) -> Term:
    quoted = value.startswith('"') and value.endswith('"')
    if value == "none":
        return Term("source", "none", negated=negated)
    if quoted or "*" in value:
        return Term("source", "pattern", wildcard_pattern(value[1:-1] if quoted else value, ".*"), negated)
    return Term("source", "prefix", value, negated)


def _pixiv_term(value: str, negated: bool) -> Term:
    if value == "any":
        return Term("pixiv", "pattern", r"pixiv\.net\/artworks\/\d+", negated)
    if value.isdigit() or ".." in value:
        return Term("pixiv", "id", number_range(value), negated)
    return Term("pixiv", "pattern", f"pixiv.net/artworks/{value}", negated)


@dataclass(frozen=True)
class Query:
    """clauses: each a term or two alternatives. order: (column, descending) if the text gives one."""

    clauses: tuple[tuple[Term, ...], ...] = ()
    order: tuple[str, bool] | None = None

    def condition(self, tested: Callable[[Term], Column | None] = lambda term: None) -> Column:
        """All clauses as one column; ``tested`` may give a term's test in another form."""
        parts = []
        for clause in self.clauses:
            own = [(t, tested(t)) for t in clause]
            parts.append(reduce(Column.__or__, [t.column() if test is None else test for t, test in own]))
        return reduce(Column.__and__, parts, F.lit(True))


def parse(text: str, *, safe_rating: bool = False) -> Query:
    """Order tokens are taken out first; of several, the last known one counts. An "or"
    between two tokens joins exactly these two; any other "or" in its place is skipped."""
    order, words = None, []
    for token in text.split():
        bare = token.lower().removeprefix("-")
        if bare.startswith("order:"):
            order = ORDERS.get(bare.removeprefix("order:"), order)
        else:
            words.append(token)
    clauses, left = [], words[::-1]
    while left:
        token = left.pop()
        if len(left) >= 2 and left[-1].lower() == "or":
            left.pop()
            pair = token, left.pop()
            clauses.append(tuple(parse_term(t, safe_rating=safe_rating) for t in pair))
        elif token.lower() != "or":
            clauses.append((parse_term(token, safe_rating=safe_rating),))
    return Query(tuple(clauses), order)


def plain_condition(text: str) -> Column:
    """The simple language of comparisons without this parser: every tag must be in the list."""
    wanted = text.replace(",", " ").lower().split()
    tests = [F.coalesce(F.array_contains(F.split("tag_string", " "), t), F.lit(False)) for t in wanted]
    return reduce(Column.__and__, tests, F.lit(True))


def tag_list(text: str) -> list[str]:
    """Tags between commas, spaces and line feeds, in lower case, each once."""
    return list(dict.fromkeys(t for t in re.split(r"[,\n ]+", text.lower()) if t))


def replace_word(text: str, cursor: int, tag: str) -> str:
    """The text with the word before the cursor replaced by the tag and a space; a leading - or ~ stays."""
    before, after = text[:cursor], text[cursor:]
    start = max(before.rfind(c) for c in " \n\t") + 1
    sign = before[start : start + 1] if before[start : start + 1] in ("-", "~") else ""
    return f"{before[:start]}{sign}{tag} {after}"


def append_tag(text: str, tag: str) -> str:
    """The query with the tag and a space after it."""
    return f"{text.strip()} {tag} ".lstrip()
