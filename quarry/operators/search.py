"""Ranked full-text search: positional postings, a query language of phrases, NEAR groups and column filters, and BM25.

Text is cut at everything but letters, digits and private characters, folded to lower case, and Latin letters lose
their mark; a fold table, made from the Unicode database, is applied as one column expression, and to queries alike.
One pass over the postings of a query's terms finds all phrases: each posting votes for where a phrase would begin, and
a phrase is where all of its words agree. Stored postings lie by term, and come with the best that each block of
documents can score for a term, so a ranked query reads the blocks that can still reach the result.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75
NEAR_TOKENS = 10
#: Buckets that stored postings are dealt to, documents in a block, and blocks that are scored before others are judged.
BUCKETS, BLOCK_DOCS, FIRST_BLOCKS = 64, 1024, 16
_PASS = (" AND ", " OR ", " NOT ", "*", '"')
_TERM = r"[\p{L}\p{N}\p{Co}]+"


@functools.cache
def fold_table() -> tuple[dict[str, str], str]:
    """(letter to folded letter, marks that vanish): simple case folding, and an ASCII letter for one that is it with a
    single mark. The marks are those that such letters have."""
    fold, marks = {}, set()
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if unicodedata.category(c)[0] not in "LN":
            continue
        low = c.casefold()
        apart = unicodedata.normalize("NFD", low)
        if len(apart) == 2 and apart[0].isascii() and apart[0].isalpha() and unicodedata.category(apart[1]) == "Mn":
            low = apart[0]
            marks.add(apart[1])
        elif len(low) != 1:
            low = c.lower() if len(c.lower()) == 1 else c
        if low != c:
            fold[c] = low
    return fold, "".join(sorted(marks))


def folded(s: Column) -> Column:
    fold, marks = fold_table()
    return F.translate(F.coalesce(s, F.lit("")), "".join(fold) + marks, "".join(fold.values()))


def terms(s: Column) -> Column:
    return F.regexp_extract_all(folded(s), F.lit(_TERM), F.lit(0))


def words(s: str) -> tuple[str, ...]:
    """As terms(), of a query's own text."""
    fold, marks = fold_table()
    cut = "".join(fold.get(c, c) if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in s if c not in marks)
    return tuple(cut.split())


def postings(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, len, col, position, term) of every term of the columns; len: the document's terms, of all columns."""
    each = docs.select(F.col(id_col).alias("id"), F.array(*[terms(F.col(c)) for c in columns]).alias("t"))
    each = each.withColumn("len", F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + F.size(x)))
    return each.select("id", "len", F.posexplode("t").alias("col", "own")).select("id", "len", "col", F.posexplode("own").alias("position", "term"))


def lengths(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, len) of every document, those without terms included."""
    return docs.select(F.col(id_col).alias("id"), sum((F.size(terms(F.col(c))) for c in columns), F.lit(0)).cast("long").alias("len"))


@dataclass(frozen=True)
class Phrase:
    """Consecutive terms; the last may be a prefix, the first may have to begin its column. columns: None for all."""

    words: tuple[str, ...]
    prefix: bool = False
    columns: frozenset[int] | None = None
    first: bool = False


@dataclass(frozen=True)
class Near:
    """Phrases in one column, with at most so many terms between the end of any and the beginning of the last."""

    phrases: tuple[Phrase, ...]
    distance: int = NEAR_TOKENS


@dataclass(frozen=True)
class Op:
    kind: str
    left: object
    right: object


def sanitised(query: str) -> str:
    """Queries with operators pass; others become quoted words joined by OR."""
    if any(mark in query for mark in _PASS):
        return query
    return " OR ".join('"' + w.replace('"', "") + '"' for w in query.split() if w.replace('"', ""))


def _filtered(tree, columns: frozenset[int]):
    """tree within the columns."""
    if tree is None:
        return None
    if isinstance(tree, Op):
        return Op(tree.kind, _filtered(tree.left, columns), _filtered(tree.right, columns))
    if isinstance(tree, Near):
        return Near(tuple(_filtered(p, columns) for p in tree.phrases), tree.distance)
    return replace(tree, columns=columns if tree.columns is None else tree.columns & columns)


class _Parser:
    """expr: OR binds loosest, then AND, then NOT; neighbours without an operator are ANDed and bind tightest."""

    def __init__(self, query: str, columns: list[str]):
        self.tokens = re.findall(r'"(?:[^"]|"")*"|[(){}:,+*^-]|[^\s(){}:,+*^"-]+', query)
        self.columns, self.at = [c.lower() for c in columns], 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self, token: str) -> bool:
        hit = self.peek() == token
        self.at += hit
        return hit

    def string(self) -> str:
        t = self.peek()
        self.at += 1
        return t[1:-1].replace('""', '"') if t[:1] == '"' else t

    def level(self, operators: tuple[str, ...] = ("OR", "AND", "NOT")):
        if not operators:
            return self.neighbours()
        out = self.level(operators[1:])
        while self.take(operators[0]):
            other = self.level(operators[1:])
            if operators[0] == "NOT":
                out = out if other is None or out is None else Op("NOT", out, other)
            else:
                out = other if out is None else out if other is None else Op(operators[0], out, other)
        return out

    def neighbours(self):
        out = None
        while (t := self.peek()) and t not in ("OR", "AND", "NOT", ")"):
            one = self.filtered()
            out = one if out is None else out if one is None else Op("AND", out, one)
        return out

    def columns_named(self) -> frozenset[int] | None:
        """A column filter, if one comes next."""
        start, out = self.at, self.take("-")
        names = []
        if self.take("{"):
            while self.peek() and not self.take("}"):
                names.append(self.string().lower())
        elif self.peek() and self.peek() not in "(){}:,+*^-":
            names.append(self.string().lower())
        if names and self.take(":"):
            unknown = set(names) - set(self.columns)
            if unknown:
                raise ValueError(f"no such column: {sorted(unknown)[0]}")
            hit = frozenset(i for i, c in enumerate(self.columns) if c in names)
            return frozenset(range(len(self.columns))) - hit if out else hit
        self.at = start
        return None

    def filtered(self):
        named = self.columns_named()
        if self.take("("):
            out = self.level()
            self.take(")")
        elif self.peek() == "NEAR" and self.peek(1) == "(":
            out = self.near()
        else:
            out = self.phrase()
        return out if named is None else _filtered(out, named)

    def near(self):
        self.at += 2
        found, distance = [], NEAR_TOKENS
        while self.peek() and not self.take(")"):
            if self.take(","):
                distance = int(self.string())
            elif (p := self.phrase()) is not None:
                found.append(p)
        return None if not found else found[0] if len(found) == 1 else Near(tuple(found), distance)

    def phrase(self):
        first, own = self.take("^"), ()
        while True:
            t = self.peek()
            if not t or (t in "(){}:,+*^-" and t):
                self.at += bool(t) and t not in ")"
                break
            own += words(self.string())
            if not self.take("+"):
                break
        prefix = self.take("*")
        return Phrase(own, prefix, None, first) if own else None


def parse(query: str, columns: list[str] | tuple[str, ...] = ()):
    """A tree of phrases and NEAR groups; None for a query without terms."""
    parser = _Parser(query, list(columns))
    out = parser.level()
    while parser.peek():  # what follows an unmatched bracket
        parser.at += 1
        more = parser.level()
        out = more if out is None else out if more is None else Op("AND", out, more)
    return out


def leaves(tree) -> list:
    """Phrases and NEAR groups of a tree, in order, each as often as it stands there."""
    if tree is None:
        return []
    return leaves(tree.left) + leaves(tree.right) if isinstance(tree, Op) else [tree]


def _phrases(tree) -> list[Phrase]:
    return list(dict.fromkeys(p for x in leaves(tree) for p in (x.phrases if isinstance(x, Near) else (x,))))


def wanted(tree) -> list[tuple[str, bool]]:
    """The terms of a tree, each with whether it is a prefix."""
    return sorted({(w, p.prefix and i == len(p.words) - 1) for p in _phrases(tree) for i, w in enumerate(p.words)})


def _matches(term: Column, asked: list[tuple[str, bool]]) -> Column:
    exact = [w for w, prefix in asked if not prefix]
    out = term.isin(*exact) if exact else F.lit(False)
    for w, prefix in asked:
        out = out | term.startswith(w) if prefix else out
    return out


def occurrences(posts: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """(p, id, len, col, start): where each phrase occurs, in one pass: a posting that is word i of a phrase votes for a
    beginning i terms before it, and all words have to vote."""
    votes = []
    for k, p in enumerate(phrases):
        for i, w in enumerate(p.words):
            hit = F.col("term").startswith(w) if p.prefix and i == len(p.words) - 1 else F.col("term") == w
            if p.columns is not None:
                hit = hit & (F.col("col").isin(*p.columns) if p.columns else F.lit(False))
            if p.first:
                hit = hit & (F.col("position") == i)
            votes.append(F.when(hit, F.struct(F.lit(k).alias("p"), F.lit(i).alias("i"))))
    cast = posts.select("id", "len", "col", "position", F.explode(F.array_compact(F.array(*votes))).alias("v"))
    rows = cast.select("id", "len", "col", "v.p", "v.i", (F.col("position") - F.col("v.i")).alias("start"))
    if all(len(p.words) == 1 for p in phrases):
        return rows.drop("i")
    need = F.element_at(F.lit([len(p.words) for p in phrases]), F.col("p") + 1)
    return rows.groupBy("p", "id", "len", "col", "start").agg(F.count_distinct("i").alias("n")).filter(F.col("n") == need).drop("n")


def near_matches(starts: list[list[int]], sizes: list[int], distance: int) -> list[int]:
    """Of how many of each phrase's beginnings (ascending) a walk over all lists makes a match: while any lies further
    before the largest than allowed it moves on; at a match all are counted, and the one whose next is the smallest moves
    on. The walk ends when one that is to move has no next."""
    at, hit = [0] * len(starts), [set() for _ in starts]
    while all(i < len(s) for i, s in zip(at, starts)):
        most = max(s[i] for i, s in zip(at, starts))
        late = [k for k, (i, s) in enumerate(zip(at, starts)) if s[i] < most - sizes[k] - distance]
        if late:
            for k in late:
                while at[k] < len(starts[k]) and starts[k][at[k]] < most - sizes[k] - distance:
                    at[k] += 1
            continue
        for k, (i, s) in enumerate(zip(at, starts)):
            hit[k].add(s[i])
        follow = [s[i + 1] if i + 1 < len(s) else float("inf") for i, s in zip(at, starts)]
        at[follow.index(min(follow))] += 1
    return [len(h) for h in hit]


def _near(lists: Column, near: Near) -> Column:
    sizes, distance = [len(p.words) for p in near.phrases], near.distance

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def count(s: pd.Series) -> pd.Series:
        return pd.Series([near_matches([list(x) for x in one], sizes, distance) for one in s])

    return count(lists)


def _weight(idf: float, f: Column, length: Column, average: float) -> Column:
    return F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(average)))


def _idf(n: int, df: int) -> float:
    import math

    raw = math.log((n - df + 0.5) / (df + 0.5))
    return raw if raw > 0 else 1e-6


def ranked(posts: DataFrame, tree, n: int, average: float, df: dict[Phrase, int] | None = None) -> DataFrame:
    """(id, score) of the documents that hold the tree, by BM25 over n documents of an average length; the best score
    is the least. posts: (id, len, col, position, term) of the tree's terms. df: documents that hold each phrase, where
    that is known; else it is counted, one number a phrase."""
    phrases, nears = _phrases(tree), list(dict.fromkeys(x for x in leaves(tree) if isinstance(x, Near)))
    found = occurrences(posts, phrases)
    if df is None:
        counts = dict(found.groupBy("p").agg(F.count_distinct("id")).collect())
        df = {p: counts.get(k, 0) for k, p in enumerate(phrases)}
    at = F.shiftleft(F.col("col").cast("long"), 32) + F.col("start")
    lists = {k: F.array_sort(F.collect_list(F.when(F.col("p") == k, at))).alias(f"at{k}") for x in nears for k in map(phrases.index, x.phrases)}
    per = found.groupBy("id", "len").agg(*[F.count_if(F.col("p") == k).alias(f"f{k}") for k in range(len(phrases))], *lists.values())
    for j, x in enumerate(nears):
        per = per.withColumn(f"near{j}", _near(F.array(*[f"at{phrases.index(p)}" for p in x.phrases]), x))

    def holds(t) -> Column:
        if isinstance(t, Phrase):
            return F.col(f"f{phrases.index(t)}") > 0
        if isinstance(t, Near):
            return F.col(f"near{nears.index(t)}")[0] > 0
        a, b = holds(t.left), holds(t.right)
        return a & b if t.kind == "AND" else a | b if t.kind == "OR" else a & ~b

    def score(t, alive: Column) -> Column:
        """What the phrases of t add where t holds and counts; the right side of NOT never does."""
        alive = alive & holds(t)
        if isinstance(t, Op):
            return score(t.left, alive) + (score(t.right, alive) if t.kind != "NOT" else F.lit(0.0))
        parts = [(t, F.col(f"f{phrases.index(t)}"))] if isinstance(t, Phrase) else [(p, F.col(f"near{nears.index(t)}")[i]) for i, p in enumerate(t.phrases)]
        return sum((F.when(alive & (f > 0), _weight(_idf(n, df[p]), f, F.col("len"), average)).otherwise(0.0) for p, f in parts), F.lit(0.0))

    return per.filter(holds(tree)).select("id", (-score(tree, F.lit(True))).alias("score"))


def search(docs: DataFrame, query: str, id_col: str, columns: list[str], limit: int | None = 20) -> DataFrame:
    """(id, score), the best (least) first: BM25 over all columns together, ties by id. Cuts all documents."""
    tree = parse(sanitised(query), columns)
    size = lengths(docs, id_col, columns)
    if tree is None:
        return size.filter(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    n, average = size.agg(F.count("*"), F.avg("len")).first()
    out = ranked(postings(docs, id_col, columns).filter(_matches(F.col("term"), wanted(tree))), tree, n, average or 1.0)
    return out.orderBy("score", "id").limit(limit) if limit is not None else out


# --- stored postings ---


def _bucket(head: Column) -> Column:
    """By the first two letters, so that a prefix of two finds all its terms in one bucket."""
    return F.pmod(F.xxhash64(F.substring(head, 1, 2)), F.lit(BUCKETS)).cast("int")


def indexed(docs: DataFrame, id_col: str, columns: list[str], blocks: int) -> DataFrame:
    """(bucket, term, block, id, len, places): a row for each term of a document. places: (col, position)."""
    rows = postings(docs, id_col, columns).groupBy("id", "len", "term").agg(F.array_sort(F.collect_list(F.struct("col", "position"))).alias("places"))
    return rows.select(_bucket(F.col("term")).alias("bucket"), "term", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "len", "places")


def block_bounds(index: DataFrame) -> DataFrame:
    """(bucket, term, block, n, most, least): documents, most occurrences in one and least length of a term's block."""
    return index.groupBy("bucket", "term", "block").agg(F.count("*").alias("n"), F.max(F.size("places")).alias("most"), F.min("len").alias("least"))


def _of_terms(table: DataFrame, tree) -> DataFrame:
    """The rows of a tree's terms; the conditions reach the files."""
    asked = wanted(tree)
    heads = sorted({w[:2] for w, prefix in asked if not prefix or len(w) >= 2})
    rows = table.filter(_matches(F.col("term"), asked))
    if all(not prefix or len(w) >= 2 for w, prefix in asked):
        numbers = [r[0] for r in table.sparkSession.createDataFrame([(h,) for h in heads], "h string").select(_bucket(F.col("h"))).distinct().collect()]
        rows = rows.filter(F.col("bucket").isin(*numbers))
    return rows


def _posts(index: DataFrame) -> DataFrame:
    return index.select("id", "len", "term", F.explode("places").alias("x")).select("id", "len", "x.col", "x.position", "term")


def search_stored(index: DataFrame, bounds: DataFrame, n: int, average: float, query: str, columns: list[str], limit: int | None = 20, seen: Callable[[int, int], None] | None = None) -> DataFrame:
    """As search(), from indexed() and block_bounds(), of n documents of an average length. Only rows of the query's
    terms are read. A query of single terms joined by OR is scored on the blocks with the highest bounds first; of the
    others only those are read whose bound reaches the last place found. seen: is told blocks scored and blocks there."""
    tree = parse(sanitised(query), columns)
    if tree is None:
        return index.filter(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    own, every = _of_terms(index, tree), leaves(tree)
    plain = all(isinstance(x, Phrase) and len(x.words) == 1 and not x.prefix and x.columns is None and not x.first for x in every)
    if not plain or limit is None or not _only_or(tree):
        out = ranked(_posts(own), tree, n, average)
        return out.orderBy("score", "id").limit(limit) if limit is not None else out
    rows = _of_terms(bounds, tree)
    counts = {r[0]: r[1] for r in rows.groupBy("term").agg(F.sum("n")).collect()}
    df = {x: counts.get(x.words[0], 0) for x in every}
    best = sum((F.when(F.col("term") == x.words[0], _weight(_idf(n, df[x]), F.col("most"), F.col("least"), average)).otherwise(0.0) for x in every), F.lit(0.0))
    tops = rows.groupBy("block").agg(F.sum(best).alias("bound"))
    first = [r[0] for r in tops.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()]
    found = ranked(_posts(own.filter(F.col("block").isin(*first))), tree, n, average, df).orderBy("score", "id").limit(limit).collect()
    last = -found[-1].score if len(found) == limit else 0.0
    rest = tops.filter((F.col("bound") >= last - 1e-9) & ~F.col("block").isin(*first))
    if seen is not None:
        seen(len(first) + rest.count(), tops.count())
    more = ranked(_posts(own.join(rest.select("block"), "block", "left_semi")), tree, n, average, df)
    kind = more.schema
    return more.unionByName(index.sparkSession.createDataFrame([(r.id, r.score) for r in found], kind)).orderBy("score", "id").limit(limit)


def _only_or(tree) -> bool:
    return not isinstance(tree, Op) or (tree.kind == "OR" and _only_or(tree.left) and _only_or(tree.right))
