"""HTML to text. Parsing tag soup has no built-in expression, so the parser runs in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.fixed_values import BLOCK_TAGS, MUTED_TAGS


class _Tokens(HTMLParser):
    """Flat (kind, value) token list. It is fed and never closed: a cut-off trailing entity is dropped."""

    def __init__(self, markup: str) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.feed(markup)

    def handle_starttag(self, tag, attrs):
        self.found.append(("open", tag))

    def handle_endtag(self, tag):
        self.found.append(("close", tag))

    def handle_data(self, data):
        self.found.append(("text", data))


def _tokens(markup: str) -> list[tuple[str, str]]:
    try:
        return _Tokens(markup).found
    except Exception:  # markup the parser rejects yields no text and must not fail the job
        return []


def all_text(markup: str) -> str:
    return "".join(value for kind, value in _tokens(markup) if kind == "text")


def article_text(markup: str) -> str:
    inside = muted = 0
    kept: list[str] = []
    for kind, value in _tokens(markup):
        step = 1 if kind == "open" else -1
        if kind == "text":
            if inside and not muted:
                kept.append(value)
        elif value == "article":
            inside = max(inside + step, 0)
        elif inside and value in MUTED_TAGS:
            muted = max(muted + step, 0)
        elif kind == "open" and inside and not muted and value in BLOCK_TAGS:
            kept.append("\n")
    joined = re.sub("[ \t]+", " ", "".join(kept))
    return re.sub(r"\n\s*\n+", "\n\n", joined).strip()


def _over(series: pd.Series, convert) -> pd.Series:
    return series.map(convert, na_action="ignore")


def _text_udf(convert, doc: str):
    def run(markup: pd.Series) -> pd.Series:
        return _over(markup, convert)

    run.__doc__ = doc
    # Catalyst copies a deterministic Python function into pushed-down filters and so parses every page twice
    return F.pandas_udf(run, T.StringType()).asNondeterministic()


def _each_text(markups: pd.Series) -> pd.Series:
    return _over(markups, lambda some: [None if x is None else all_text(x) for x in some])


html_strip = _text_udf(all_text, "All text nodes, script and style text included.")
extract_article = _text_udf(article_text, "Readable text inside <article>, one line per block element.")
#: html_strip of every element of an array
html_strip_each = F.pandas_udf(_each_text, T.ArrayType(T.StringType())).asNondeterministic()
