"""Full-text search over turns: a positional index, match expressions, and a LIKE search for what is no expression.

The index has one row per token occurrence: (token, *keys, field, pos). A search reads only the postings of its own
tokens, decides phrases by neighbouring positions in one field, and caps the matching keys before any text is read.

A match expression is built of phrases: bare words, ``"quoted words"`` and words joined by ``+``, each optionally with ``*``
for a prefix of its last token, ``^`` for a field's start, and ``query :`` or ``response :`` for one field. Phrases
side by side must all match; ``AND``, ``OR``, ``NOT`` (capitals, binary, NOT binding tightest) and parentheses combine
them. Anything else, NEAR groups included, is no expression: it is searched as a LIKE pattern as it stands.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import words
from corpusflow.operators.windows import cap_per_group

FIELDS = ("query", "response")
_LEXEMES = re.compile(r'\s+|("(?:[^"]|"")*")|([\w\x1a]+)|([()*+:^])')
_TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool = False
    start: bool = False
    field: str | None = None


class MatchError(ValueError):
    """The text is no match expression."""


def _lexemes(text: str) -> list[tuple[str, str]]:
    """(kind, text) of every lexeme: "text" for words and quoted strings, otherwise the sign or operator itself."""
    found, at = [], 0
    while at < len(text):
        hit = _LEXEMES.match(text, at)
        if hit is None:
            raise MatchError(f"unexpected {text[at]!r}")
        quoted, word, sign = hit.groups()
        if quoted is not None:
            found.append(("text", quoted[1:-1].replace('""', '"')))
        elif word is not None:
            found.append((word if word in ("AND", "OR", "NOT") else "text", word))
        elif sign is not None:
            found.append((sign, sign))
        at = hit.end()
    return found


class _Reader:
    """Reads lexemes into a tree of Phrase and (operator, left, right)."""

    def __init__(self, text: str) -> None:
        self.left = _lexemes(text)[::-1]

    def peek(self, back: int = 1) -> str:
        return self.left[-back][0] if len(self.left) >= back else "end"

    def take(self, kind: str) -> str:
        if self.peek() != kind:
            raise MatchError(f"{kind} expected")
        return self.left.pop()[1]

    def chain(self, operator: str, part):
        tree = part()
        while self.peek() == operator:
            self.take(operator)
            tree = (operator, tree, part())
        return tree

    def whole(self):
        return self.chain("OR", lambda: self.chain("AND", lambda: self.chain("NOT", self.phrases)))

    def phrases(self):
        if self.peek() == "(":
            self.take("(")
            tree = self.whole()
            self.take(")")
            return tree
        tree = self.phrase()
        while self.peek() in ("text", "^"):
            tree = ("AND", tree, self.phrase())
        return tree

    def phrase(self) -> Phrase:
        field = None
        if self.peek(2) == ":":
            field = self.take("text").lower()
            self.take(":")
            if field not in FIELDS:
                raise MatchError(f"no field {field}")
        start = self.peek() == "^" and bool(self.take("^"))
        texts = [self.take("text")]
        if texts == ["NEAR"] and self.peek() == "(":
            raise MatchError("NEAR groups are not supported")
        while self.peek() == "+":
            self.take("+")
            texts.append(self.take("text"))
        prefix = self.peek() == "*" and bool(self.take("*"))
        tokens = tuple(t for text in texts for t in _TOKEN.findall(text.lower()))
        return Phrase(tokens, prefix, start, field)


def parse_match(text: str):
    """The expression's tree, None if it holds no token; MatchError if it is no expression. Phrases without tokens drop out."""
    if not text.strip():
        return None
    reader = _Reader(text)
    tree = reader.whole()
    if reader.left:
        raise MatchError(f"unexpected {reader.left[-1][1]!r}")
    return _without_empty(tree)


def _without_empty(tree):
    if isinstance(tree, Phrase):
        return tree if tree.tokens else None
    operator, left, right = tree[0], _without_empty(tree[1]), _without_empty(tree[2])
    if left is None:
        return None if operator == "NOT" else right
    return left if right is None else (operator, left, right)


def phrases_of(tree) -> list[Phrase]:
    """The different phrases of a tree, in order."""
    if isinstance(tree, Phrase):
        return [tree]
    return list(dict.fromkeys(phrases_of(tree[1]) + phrases_of(tree[2])))


def _holds(tree, found: dict[Phrase, Column]) -> Column:
    if isinstance(tree, Phrase):
        return found[tree]
    left, right = _holds(tree[1], found), _holds(tree[2], found)
    return {"AND": left & right, "OR": left | right, "NOT": left & ~right}[tree[0]]


def build_postings(turns: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Positional index: one row (token, *keys, field, pos) per token occurrence. Nothing is shuffled."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), words(F.coalesce(f, F.lit(""))).alias("words")) for f in FIELDS])
    each = turns.select(*keys, F.inline(fields))
    return each.select(F.posexplode("words").alias("pos", "token"), *keys, "field").select("token", *keys, "field", "pos")


def match_keys(postings: DataFrame, trees: dict[str, object], keys: Sequence[str] = ("id",)) -> DataFrame:
    """Keys of the turns that each named expression matches: (search, *keys).

    The tokens stand in the plan, so they reach the scan of a stored index and the postings meet no join. A phrase
    is found where all its tokens stand at the same distance from its start, in one field.
    """
    keys = list(keys)
    leaves = list(dict.fromkeys(p for tree in trees.values() for p in phrases_of(tree)))
    covers = lambda p, i: F.col("token").startswith(p.tokens[i]) if p.prefix and i == len(p.tokens) - 1 else F.col("token") == p.tokens[i]
    wanted = dict.fromkeys((replace(p, field=None, start=False), i) for p in leaves for i in range(len(p.tokens)))
    any_of = reduce(Column.__or__, [covers(p, i) for p, i in wanted])
    parts = []
    for number, p in enumerate(leaves):
        for i in range(len(p.tokens)):
            fits = covers(p, i)
            if p.field:
                fits &= F.col("field") == p.field
            if p.start:
                fits &= F.col("pos") == i
            parts.append(F.when(fits, F.struct(F.lit(number).alias("leaf"), (F.col("pos") - i).alias("start"))))
    size = F.element_at(F.array(*[F.lit(len(p.tokens)) for p in leaves]), F.col("leaf") + 1)
    whole = (
        postings.where(any_of).select(*keys, "field", F.inline(F.array_compact(F.array(*parts))))
        .groupBy(*keys, "field", "leaf", "start").agg(F.count("*").alias("_n")).where(F.col("_n") == size)
        .groupBy(*keys).agg(F.collect_set("leaf").alias("_leaves"))  # at most the phrases of all searches
    )
    found = {p: F.array_contains("_leaves", number) for number, p in enumerate(leaves)}
    names = F.array_compact(F.array(*[F.when(_holds(tree, found), F.lit(name)) for name, tree in trees.items()]))
    return whole.select(F.explode(names).alias("search"), *keys)


def search_turns(
    turns: DataFrame, postings: DataFrame, searches: dict[str, str], n: int = 20, keys: Sequence[str] = ("id",)
) -> DataFrame:
    """Newest n turns per named search: (search, *keys, query, response). Blank searches find nothing.

    Matching keys are capped first, at most n a search, so only these turns' texts are read; the join's small side
    is bounded by that. Searches that are no match expression compare their text as a LIKE pattern.
    """
    keys = list(keys)
    trees, patterns = {}, {}
    for name, text in searches.items():
        try:
            tree = parse_match(text)
            if tree is not None:
                trees[name] = tree
        except MatchError:
            patterns[name] = f"%{text}%"
    newest = [F.col(k).desc() for k in keys]
    out = [turns.where("false").select(F.lit("").alias("search"), *keys, *FIELDS)]
    if trees:
        hits = cap_per_group(match_keys(postings, trees, keys), ["search"], newest, n)
        held = turns.join(F.broadcast(hits) if n else hits, keys)
        out.append(held.select("search", *keys, *FIELDS))
    if patterns:
        like = {name: F.coalesce(F.col("query").ilike(p), F.lit(False)) | F.coalesce(F.col("response").ilike(p), F.lit(False)) for name, p in patterns.items()}
        names = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in like.items()]))
        matched = turns.where(reduce(Column.__or__, like.values())).select(F.explode(names).alias("search"), *keys, *FIELDS)
        out.append(cap_per_group(matched, ["search"], newest, n).select("search", *keys, *FIELDS))
    return reduce(DataFrame.union, out[1:] or out)
