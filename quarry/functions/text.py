"""Column functions over descriptions, names and results. All run inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words that a task's name leaves out.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "for", "in", "on", "at", "to", "of", "with", "that", "this", "from", "into", "by", "is", "it",
    "be", "as", "do", "need", "needed", "should", "implement", "add", "create", "make", "update", "fix", "new", "clear",
)

_TRIM = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z"


def ascii_lower(s: Column) -> Column:
    """Only A-Z change: lower() would also map letters beyond ASCII into it."""
    return F.translate(s, UPPER, LOWER)


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, _TRIM, "")


def tokens(s: Column) -> Column:
    """Runs of ASCII letters and digits of three or more, lower-cased, in order and with repeats."""
    # a token is ASCII, so lower() maps nothing else into it; translate() would look up each character of the text
    return F.transform(F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit("[A-Za-z0-9]{3,}"), F.lit(0)), F.lower)


def token_overlap(existing: Column, new: Column) -> Column:
    """Share of existing's tokens, repeats counted, that new has; 0 if either has none. Arguments are token arrays."""
    return F.when((F.size(existing) == 0) | (F.size(new) == 0), F.lit(0.0)).otherwise(F.size(F.filter(existing, lambda t: F.array_contains(new, t))) / F.size(existing))


def consecutive(items: Column, n: int, between: str = "") -> Column:
    """Each n consecutive items of an array of strings, joined. Shifted copies are zipped, so that no lambda holds an
    expression over the whole array, which would be evaluated anew for each item."""
    out = items
    for k in range(1, n):
        shifted = F.slice(items, F.lit(k + 1), F.greatest(F.size(items) - k, F.lit(0)))
        out = F.zip_with(out, shifted, lambda a, b: F.concat(a, F.lit(between), b))
    return F.filter(out, lambda x: x.isNotNull())


def char_ngrams(s: Column, n: int = 3) -> Column:
    """The set of n-byte windows over lower-cased text, each run of other characters one blank, a blank at both ends."""
    flat = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", " "))
    chars = F.split(F.concat(F.lit(" "), flat, F.lit(" ")), "")
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.array_distinct(consecutive(chars, n)))


def trigram_codes(s: Column) -> Column:
    """char_ngrams() of three bytes as numbers, one for one: sets of integers intersect much faster."""
    byte = lambda g, i: F.ascii(F.substring(g, i, 1))
    return F.transform(char_ngrams(s, 3), lambda g: byte(g, 1) * 65536 + byte(g, 2) * 256 + byte(g, 3))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def pair_cosine(a: Column, b: Column) -> Column:
    """Cosine of TF-IDF vectors of two token arrays whose corpus is just them: a term of both has an inverse document
    frequency of 1, a term of one ln(3 / 2) + 1. 0 if either is empty."""
    share = lambda x, w: F.size(F.filter(w, lambda t: t == x)) / F.size(w)
    alone = 1 + math.log(1.5)
    total = lambda items, f: F.aggregate(items, F.lit(0.0), lambda s, x: s + f(x))
    square = lambda w, other: total(F.array_distinct(w), lambda x: F.pow(share(x, w) * F.when(F.array_contains(other, x), 1.0).otherwise(alone), F.lit(2)))
    dot = total(F.array_intersect(a, b), lambda x: share(x, a) * share(x, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(dot / F.sqrt(square(a, b) * square(b, a)))


def shingles(words: Column, n: int = 2) -> Column:
    """The set of n consecutive tokens joined by a blank; fewer tokens are themselves the set."""
    return F.array_distinct(F.when(F.size(words) < n, words).otherwise(consecutive(words, n, " ")))


def fields(s: Column) -> Column:
    """Words between white space, empty ones left out."""
    return F.filter(F.split(F.coalesce(s, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def task_name(description: Column) -> Column:
    words = F.filter(F.transform(fields(ascii_lower(description)), lambda w: F.regexp_replace(w, "[^a-z0-9]+", "")), lambda w: w != "")
    kept = F.slice(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)), 1, 4)
    chosen = F.when(F.size(kept) > 0, kept).otherwise(F.slice(words, 1, 3))
    return F.regexp_replace(F.substring(F.array_join(chosen, "-"), 1, 40), r"^-+|-+\z", "")


def slug(s: Column, limit: int = 40) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(ascii_lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", "-"), 1, limit), r"^-+|-+\z", "")


def cap(s: Column, limit: int, marker: str = "…") -> Column:
    """Cut to limit characters with a marker where longer."""
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit(marker))).otherwise(s)


def result_summary(result: Column, limit: int = 120) -> Column:
    """First line with something on it, without heading and bullet marks."""
    lines = F.filter(F.transform(F.split(F.coalesce(result, F.lit("")), "\n"), trimmed), lambda x: (x != "") & (x != "---"))
    bare = F.filter(F.transform(lines, lambda x: trimmed(F.regexp_replace(x, r"^[#*\- \t]+", ""))), lambda x: x != "")
    return cap(F.coalesce(F.try_element_at(bare, F.lit(1)), F.lit("")), limit)


def one_line(s: Column, limit: int = 200) -> Column:
    return cap(F.regexp_replace(trimmed(F.translate(F.coalesce(s, F.lit("")), "\n\r\t", "   ")), " {2,}", " "), limit)


def short_age(seconds: Column) -> Column:
    s = seconds.cast("long")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d")))
    )


def _one_decimal(n: Column, unit: int) -> Column:
    """n / unit with one decimal, rounded by the exact value of the quotient as a double, and to even where that is a
    tie: format_string() would round its shortest decimal form."""
    tenth = unit // 10
    low, rest = F.floor(n / tenth), n % tenth
    exact = (n / unit * F.lit(2.0**52)).cast("long").cast("decimal(20,0)") * F.lit(unit).cast("decimal(10,0)") - n.cast("decimal(16,0)") * F.lit(1 << 52).cast("decimal(17,0)")
    up = F.when(rest * 2 != tenth, rest * 2 > tenth).when(exact != 0, exact > 0).otherwise(low % 2 == 1)
    tenths = low + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def short_tokens(n: Column) -> Column:
    n = n.cast("long")
    return (
        F.when(n < 1000, n.cast("string")).when(n < 10_000, F.concat(_one_decimal(n, 1000), F.lit("k")))
        .when(n < 1_000_000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k"))).when(n < 2_000_000_000, F.concat(_one_decimal(n, 1_000_000), F.lit("M")))
        .otherwise(F.format_string("%.1fM", n / 1_000_000))
    )


def step_line(description: Column, verb: Column, target: Column, symbols: Column, acceptance: Column) -> Column:
    """A step's own description, or one put together from its parts."""
    some = lambda c: F.coalesce(c, F.lit(""))
    made = F.concat(
        F.when(some(verb) != "", F.concat(F.translate(F.substring(verb, 1, 1), LOWER, UPPER), F.substr(verb, F.lit(2)), F.lit(" "))).otherwise(""),
        some(target),
        F.when(F.coalesce(F.size(symbols), F.lit(0)) > 0, F.concat(F.lit(" ("), F.array_join(symbols, ", "), F.lit(")"))).otherwise(""),
        F.when(some(acceptance) != "", F.concat(F.lit(" — "), acceptance)).otherwise(""),
    )
    return F.when(some(description) != "", description).otherwise(trimmed(made))


def _numbered(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x, F.lit("\n"))), "")


def _labelled(label: str, items: Column) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, ", "), F.lit("\n"))).otherwise("")


def _listed(label: str, lines: Column) -> Column:
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.concat(F.lit(f"{label}:\n"), _numbered(lines))).otherwise("")


def _told(label: str, s: Column) -> Column:
    return F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit(f"{label}: "), s, F.lit("\n"))).otherwise("")


def plan_text(classification: Column, reason: Column, files: Column, symbols: Column, plan: Column) -> Column:
    """A classification and its plan, an array of lines, as text; parts that are empty or null have no line."""
    head = F.concat(F.lit("Classification: "), F.coalesce(classification, F.lit("")), F.lit("\nReason: "), F.coalesce(reason, F.lit("")), F.lit("\n"))
    return F.concat(head, _labelled("Files", files), _labelled("Symbols", symbols), _listed("Plan", plan))


def pipeline_text(classification: Column, reason: Column, confidence: Column, questions: Column, reject_reason: Column, files: Column, symbols: Column, steps: Column, classify_error: Column, plan_error: Column) -> Column:
    """The whole result of a classification as text. questions: null or empty where none is open; steps: an array of
    (verb, target_file, symbols, acceptance, depends_on, description)."""
    after = lambda s: F.when(F.coalesce(F.size(s["depends_on"]), F.lit(0)) > 0, F.concat(F.lit("  [after ["), F.array_join(F.transform(s["depends_on"], lambda d: d.cast("string")), " "), F.lit("]]"))).otherwise("")
    lines = F.transform(steps, lambda s: F.concat(step_line(s["description"], s["verb"], s["target_file"], s["symbols"], s["acceptance"]), after(s)))
    sure = F.when(F.coalesce(confidence, F.lit(0.0)) > 0, F.format_string("Confidence: %.2f\n", confidence.cast("double"))).otherwise("")
    head = F.concat(F.lit("Classification: "), F.coalesce(classification, F.lit("")), F.lit("\nReason: "), F.coalesce(reason, F.lit("")), F.lit("\n"))
    return F.concat(head, sure, _listed("Clarifying questions", questions), _told("Reject reason", reject_reason), _labelled("Files", files), _labelled("Symbols", symbols), _listed("Plan", lines), _told("Classify error", classify_error), _told("Plan error", plan_error))


def with_model(command: Column, model: Column) -> Column:
    """command with the value of its first --model replaced, or the flag and value at its end; no model changes nothing."""
    at = F.instr(command, "--model ")
    head, rest = F.substr(command, F.lit(1), at + 7), F.substr(command, at + 8)
    replaced = F.concat(head, model, F.regexp_replace(rest, r"\A[^ \t]*", ""))
    return F.when(F.coalesce(model, F.lit("")) == "", command).when(at > 0, replaced).otherwise(F.concat(trimmed(command), F.lit(" --model "), model))


def with_model_first(words: Column, model: Column) -> Column:
    """The words of a command joined, with the model's flag after the first; words with blanks are quoted. The flag is
    -m for gemini and --model for others. Without words there is nothing, without a model no flag."""
    base = F.regexp_extract(F.try_element_at(words, F.lit(1)), r"([^/]*)\z", 1)
    flag = F.when(base == "gemini", "-m").otherwise("--model")
    every = F.concat(F.slice(words, 1, 1), F.array(flag, model), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))))
    plain = (F.size(words) <= 0) | (F.coalesce(model, F.lit("")) == "")
    quoted = lambda w: F.when(w.rlike("[ \t]"), F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(w)
    return F.array_join(F.transform(F.when(plain, words).otherwise(every), quoted), " ")


def setting(value: Column, allowed: tuple[str, ...] | None = None, default: str = "") -> Column:
    """A setting that is one of those allowed, or where none are named an identifier; the default otherwise."""
    good = value.isin(*allowed) if allowed else is_identifier(value)
    return F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.lit(default))


def after_colon(s: Column) -> Column:
    at = F.instr(s, ":")
    return F.when(at > 0, trimmed(F.substr(s, at + 1))).otherwise(F.lit(""))


def clarified(original: Column, answers: Column) -> Column:
    """original with a bullet for each answered question; answers: array of (question, answer)."""
    given = F.filter(F.coalesce(answers, F.array().cast("array<struct<question:string,answer:string>>")), lambda x: F.coalesce(x["answer"], F.lit("")) != "")
    bullets = F.array_join(F.transform(given, lambda x: F.concat(F.lit("- "), x["question"], F.lit(": "), x["answer"], F.lit("\n"))), "")
    return F.when(F.size(given) == 0, original).otherwise(F.concat(original, F.lit("\n\nClarifications:\n"), bullets))


def task_id(s: Column) -> Column:
    """Digits only and above 0, else null."""
    return F.when(s.rlike(r"\A[0-9]+\z"), F.try_to_number(F.substring(F.lpad(s, 18, "0"), 1, 18), F.lit("999999999999999999")).cast("long")).otherwise(F.lit(None).cast("long"))


def is_session_id(s: Column) -> Column:
    return s.rlike(r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z")


def truthy(s: Column, default: bool) -> Column:
    low = ascii_lower(trimmed(F.coalesce(s, F.lit(""))))
    return F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off"), False).otherwise(F.lit(default))


def quoted_strings(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit('"([^"]*)"'), F.lit(1))


def is_identifier(s: Column) -> Column:
    return s.rlike(r"\A[A-Za-z0-9_./\-]{1,100}\z")


def match_query(words: Column) -> Column:
    """Tokens as quoted terms joined by OR."""
    return F.array_join(F.transform(words, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def symbol_id(path: Column, name: Column, kind: Column, signature: Column) -> Column:
    """The first 24 hex digits of SHA-256 over the parts with a zero character between; nulls count as empty."""
    parts = [F.coalesce(c, F.lit("")) for c in (path, name, kind, signature)]
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 24)


def suggestion_score(given: Column, known: Column) -> Column:
    """Three times the common prefix less the edit distance."""
    prefix = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.length(given), F.length(known)), F.lit(1))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, i: F.struct((a.n + F.when(a.on & (F.substr(given, i, F.lit(1)) == F.substr(known, i, F.lit(1))) & (F.length(given) >= i) & (F.length(known) >= i), 1).otherwise(0)).alias("n"), (a.on & (F.substr(given, i, F.lit(1)) == F.substr(known, i, F.lit(1)))).alias("on")),
        lambda a: a.n,
    )
    return 3 * prefix - F.levenshtein(given, known)
