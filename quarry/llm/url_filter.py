"""URL filters with DataFrame functions only: domain and path rules, then logistic regression on hashed character
n-grams of host and path, trained from a small labelled URL table.

Training is full-batch gradient descent from zero on the logistic loss, inside one aggregate() over the array of
weights. A round scores each labelled row by its own buckets, then moves each bucket by the rows that have it, so it
takes time linear in the features. Buckets alike in all rows learn as one; rows and weights are bounded by the labelled
table and by the number of buckets.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.frames import unused

BUCKETS = 8192
SIZES = (3, 4, 5)
ROUNDS = 400
RATE = 0.3

#: (host, path, verdict). A rule holds for its host and all hosts below it, where the path begins with its path.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: Parts of the labelled table: names of plain sites and words of junk sites.
PLAIN = (
    "garden kitchen library weather history science museum travel football music recipe school village river mountain journal letters market nature painter "
    "theatre heather northern thunder brother rather winter station nation edition reading singing hearing another teaching rotation shelter leather "
    "restore interest breath author orchard eastern heritage tradition attention stone harbour lantern"
).split()
JUNK = "casino pills spam cheap poker win loan free ads replica jackpot xxx bets adult farm bonus escort slots tracker payday".split()
#: Frequent letter groups of English, of which names of plain sites are made up; and what either sort of name has around it.
GROUPS = "th he in er an re on at en nd ti es or te ed is it al ar st to nt ng se ha le ble tion ing sh ea ther".split()
AFTER = ("x", "24", "now", "online", "best", "zone", "go", "info")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked): URLs put together from the lists by a rule, more than two plain ones to a junk one. Names come
    alone, in pairs and with an addition, and plain ones also as letter groups in a row; additions, paths and domains
    occur under both labels, so that they tell nothing."""
    rows = []
    tops, fronts, langs = ("example.com", "example.net", "example.org"), ("", "www.", "blog.", "m."), ("en", "fr", "de", "es")

    def add(name: str, label: int, i: int, j: int) -> None:
        rows.append((f"http://{fronts[(i + j) % 4]}{name}.{tops[(i + 2 * j) % 3]}/{langs[(i + j) % 4]}/{37 * i + 11 * j}", label))

    for label, names in ((0, PLAIN), (1, JUNK)):
        for i, name in enumerate(names):
            for j in range(4):
                add(f"{name}-{names[(i + 7 + 3 * j) % len(names)]}" if (i + j) % 2 else name, label, i, j)
            for j in range(2 + 2 * label):
                add(f"{name}-{AFTER[(i + 3 * j) % len(AFTER)]}", label, i, j)
    n = len(GROUPS)
    for i in range(n):
        for j in range(4):
            add(GROUPS[i] + GROUPS[(5 * i + 7 * j) % n] + (GROUPS[(3 * i + 11 * j + 1) % n] if j % 2 else ""), 0, i, j)
    return spark.createDataFrame(rows, "url string, blocked int")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ngrams(host: Column, path: Column, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS) -> Column:
    """Buckets of the n-grams of host and path between marks, digits alike and repeats included; in time linear in the
    length."""
    marked = F.translate(F.concat(F.lit("^"), host, path, F.lit("$")), "123456789", "000000000")
    chars = F.regexp_extract_all(marked, F.lit("(?s)."), F.lit(0))

    def of(n: int) -> Column:
        grams = chars
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(chars, F.lit(k + 1), F.greatest(F.size(chars) - k, F.lit(0))), lambda a, b: F.concat(a, b))
        return F.transform(F.filter(grams, lambda g: g.isNotNull()), lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int"))

    return F.concat(*[of(n) for n in sizes])


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", buckets: int = BUCKETS, rounds: int = ROUNDS, rate: float = RATE, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(bucket, weight) of a small labelled table; at most buckets + 1 rows, bucket -1 is the bias. Features are counts
    over their Euclidean norm. Rows with a null label are left out; an empty table gives no weights."""
    host, path = host_and_path(F.col(url_col))
    base = labelled.filter(F.col(label_col).isNotNull()).select(F.struct(F.col(label_col).cast("double").alias("y"), F.col(url_col).isNull().alias("none"), F.coalesce(url_col, F.lit("")).alias("url")).alias("row"), host.alias("h"), path.alias("p"))
    rows = base.groupBy("row", "h", "p").agg(F.count("*").alias("times"))
    grams = rows.select("row", "times", F.explode(F.concat(ngrams(F.col("h"), F.col("p"), sizes, buckets), F.array(F.lit(-1)))).alias("bucket")).groupBy("row", "times", F.col("bucket").alias("at")).agg(F.count("*").cast("double").alias("n"))
    lines = grams.groupBy("row", "times").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("g"))
    norm = F.sqrt(F.aggregate("g", F.lit(0.0), lambda s, c: s + c.n * c.n))
    lines = lines.withColumn("norm", norm).select("row", "times", F.transform("g", lambda c: F.struct(c["at"].alias("at"), (c.n / F.col("norm")).alias("x"))).alias("line"))
    whole = lines.agg(F.array_sort(F.collect_list(F.struct("row", "times", "line"))).alias("m"))
    rows = whole.select(F.posexplode("m").alias("i", "r"))
    cells = rows.select("i", F.explode("r.line").alias("c")).groupBy(F.col("c.at").alias("bucket")).agg(F.array_sort(F.collect_list(F.struct(F.col("i").alias("at"), F.col("c.x").alias("x")))).alias("rows"))
    # buckets that the same rows have as often learn the same weight, so they are one group that counts once for each
    groups = cells.groupBy("rows").agg(F.array_sort(F.collect_list("bucket")).alias("buckets")).agg(F.array_sort(F.collect_list(F.struct("buckets", "rows"))).alias("groups"))
    lines = groups.select(F.posexplode("groups").alias("g", "c")).select("g", F.size("c.buckets").alias("n"), F.explode("c.rows").alias("p")).groupBy(F.col("p.at").alias("i")).agg(F.array_sort(F.collect_list(F.struct(F.col("g").alias("at"), (F.col("n") * F.col("p.x")).alias("x")))).alias("line"))
    lines = lines.join(rows.select("i", (F.lit(rate) * F.col("r.times")).alias("rate"), F.col("r.row.y").alias("y")), "i").agg(F.array_sort(F.collect_list(F.struct("i", "rate", "y", "line"))).alias("lines"))
    both = groups.unionByName(lines, allowMissingColumns=True).agg(F.first("groups", True).alias("groups"), F.first("lines", True).alias("lines"))

    def bound(value: Column, body: Callable[[Column], Column]) -> Column:
        """body over a value that is computed once: an array of one binds it to a name."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def opened(c: Column) -> Column:
        """A copy whose fields are read without decoding its binary form each time."""
        return F.transform(c, lambda p: F.struct(p["at"].alias("at"), p["x"].alias("x")))

    def learned(lines: Column, by: Column) -> Column:
        def total(cells: Column, start: Column, of: Column) -> Column:
            return F.aggregate(cells, start, lambda s, c: s + c["x"] * F.get(of, c["at"]))

        def step(w: Column, _: Column) -> Column:
            errors = F.transform(lines, lambda r: r["rate"] * (r["y"] - 1 / (1 + F.exp(-total(r["line"], F.lit(0.0), w)))))
            return bound(errors, lambda e: F.zip_with(by, w, lambda cells, old: total(cells, old, e)))

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.transform(by, lambda c: F.lit(0.0)), step)

    by_row = F.transform("lines", lambda r: F.struct(r["rate"].alias("rate"), r["y"].alias("y"), opened(r["line"]).alias("line")))
    by_group = F.transform("groups", lambda g: opened(g["rows"]))
    weights = both.select("groups", bound(by_row, lambda lines: bound(by_group, lambda by: learned(lines, by))).alias("w"))
    found = weights.select(F.explode(F.arrays_zip(F.col("groups.buckets").alias("buckets"), F.col("w").alias("w"))).alias("p")).select(F.explode("p.buckets").alias("bucket"), F.col("p.w").alias("weight"))
    return found.filter("weight <> 0")


def with_verdicts(pages: DataFrame, weights: DataFrame, rules=RULES, url_col: str = "url", buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """pages with host, path, rule, score and verdict instead of columns so named.

    The longest rule that fits wins (of equally long ones the later); without one, a score of 0.5 or more blocks.
    A null URL, or one without ://, has an empty host and path, fits no rule and is judged by its score like any other.
    Rules and weights are bounded (weights by buckets + 1), so both travel as literals.
    """
    learned = {r["bucket"]: r["weight"] for r in weights.collect()}
    table = F.lit([float(learned.get(b, 0.0)) for b in range(-1, buckets)])
    host, path = host_and_path(F.col(url_col))
    own_host, own_path, of_grams, own_score = unused(pages, "own_host", "own_path", "of_grams", "own_score")
    out = pages.withColumns({own_host: host, own_path: path})
    h, p = F.col(own_host), F.col(own_path)
    grams = F.concat(ngrams(h, p, sizes, buckets), F.array(F.lit(-1)))
    counted = F.aggregate(F.array_sort(grams), F.struct(F.lit(-2).alias("b"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("dot")), lambda a, g: F.struct(
        g.alias("b"), F.when(a.b == g, a.run + 1).otherwise(F.lit(1.0)).alias("run"), (a.sq + F.when(a.b == g, 2 * a.run + 1).otherwise(F.lit(1.0))).alias("sq"), (a.dot + F.element_at(table, g + 2)).alias("dot")))
    out = out.withColumn(of_grams, counted).withColumn(own_score, 1 / (1 + F.exp(-F.col(f"{of_grams}.dot") / F.sqrt(f"{of_grams}.sq"))))
    fits = [F.when(((h == rh) | h.endswith("." + rh)) & p.startswith(rp), F.struct(F.lit(len(rh + rp)).alias("n"), F.lit(i).alias("i"), F.lit(rh + rp).alias("rule"), F.lit(v).alias("verdict"))) for i, (rh, rp, v) in enumerate(rules)]
    best = F.greatest(*fits) if len(fits) > 1 else reduce(lambda a, b: a, fits, None)
    rule = best["rule"] if best is not None else F.lit(None).cast("string")
    verdict = best["verdict"] if best is not None else F.lit(None).cast("string")
    by_score = F.when(F.col(own_score) >= 0.5, "block").otherwise("allow")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    return out.select(*[F.col(f"`{c}`") for c in kept], h.alias("host"), p.alias("path"), rule.alias("rule"), F.col(own_score).alias("score"), F.coalesce(verdict, by_score).alias("verdict"))
