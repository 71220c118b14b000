"""Text that needs a scanner: JSON objects inside prose and shell words. Arrow-batched Python."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_object(text: str | None, accept=lambda o: True) -> str:
    """The first JSON object in text, scanned from each opening brace, that is accepted; '' if there is none."""
    decoder, at = json.JSONDecoder(), -1
    text = text or ""
    while (at := text.find("{", at + 1)) >= 0:
        try:
            found, end = decoder.raw_decode(text, at)
        except ValueError:
            continue
        if isinstance(found, dict) and accept(found):
            return text[at:end]
    return ""


@F.pandas_udf(T.StringType())
def extract_json(s: pd.Series) -> pd.Series:
    return s.map(first_object)


@F.pandas_udf(T.StringType())
def extract_classification(s: pd.Series) -> pd.Series:
    return s.map(lambda x: first_object(x, lambda o: bool(o.get("classification"))))


@F.pandas_udf(T.StringType())
def extract_plan(s: pd.Series) -> pd.Series:
    return s.map(lambda x: first_object(x, lambda o: isinstance(o.get("plan"), list) and len(o["plan"]) > 0))


_PARTS = re.compile(r"""(?P<blank>[ \t\n]+)|"(?P<double>(?:\\.|[^"\\])*)"|'(?P<single>(?:\\.|[^'\\])*)'|\\(?P<escaped>.)|(?P<plain>[^ \t\n"'\\]+)|(?P<last>\\\Z)""", re.S)


def shell_words(line: str | None) -> list[str] | None:
    """Words of a command line: both kinds of quotes hold escapes, an empty quoted word is no word, a trailing backslash
    counts for nothing; None for an open quote."""
    words, word, at = [], "", 0
    line = line or ""
    while at < len(line):
        m = _PARTS.match(line, at)
        if m is None:
            return None
        at = m.end()
        if m["blank"] is not None:
            words, word = words + [word] * (word != ""), ""
        elif m["double"] is not None or m["single"] is not None:
            word += re.sub(r"(?s)\\(.)", r"\1", m["double"] if m["double"] is not None else m["single"])
        else:
            word += m["escaped"] or m["plain"] or ""
    return words + [word] * (word != "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def shlex_split(s: pd.Series) -> pd.Series:
    return s.map(shell_words)
