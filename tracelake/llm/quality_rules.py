"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Column over a document's text, words and lines that is true for a document to reject. A
bounded sample is used for one thing: to estimate what a rule costs, beyond splitting the text, and how
many rows it rejects. The rules then run in the order of rejections per cost inside one CASE expression,
so a row that one rule rejects never reaches the dearer ones. Words and lines are split once, below the
CASE. The order changes the time, never the verdict: that is the OR of all rules.

The sample is SAMPLE_ROWS rows of at most SAMPLE_BYTES each, taken partition after partition until there are
enough, so its size does not depend on the table's. The cost of a rule is what the characters, words and lines of the
sample make of fixed unit costs: times of such short runs would be those of the machine's moment, and no two
estimates would agree.

Null text counts as empty: no words, every statistic 0. Text of white space only is the same. Very long
texts are judged whole. An empty table gives no rows; its rules keep the order of their names. Repeated rows
are judged one by one. Extra columns stay as they are; statistics that would clash with one replace it in
judge(), keep() adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm._shared import cut, unused

WHITE = " \t\n\x0b\f\r"
WHITE_RUN = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample on which costs and selectivities are estimated; verdicts never depend on it.
SAMPLE_ROWS = 400
SAMPLE_BYTES = 1 << 16

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_RUN))


#: Up to so many distinct repeated windows, membership is tested value by value; beyond, by sorting.
FEW = 16


def _covered(windows: Column) -> Column:
    """Words in windows of three whose hash is found twice or more; windows holds one hash per start."""

    def by_sorting(all_windows: Column) -> Column:
        pairs = F.array_sort(F.transform(all_windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            twins = F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(twins, lambda x: x["i"]))

        return _let(pairs, repeated)

    def by_value(twice: Column) -> Column:
        marked = F.transform(windows, lambda h, i: F.when(F.array_contains(twice, h), i))
        return F.filter(marked, lambda i: i.isNotNull())

    def count(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")),
            lambda a: a["n"],
        )

    def twice(ordered: Column) -> Column:
        return F.array_distinct(F.filter(ordered, lambda h, k: h == F.get(ordered, k - 1)))

    def choose(repeated: Column) -> Column:
        return count(F.when(F.size(repeated) <= FEW, by_value(repeated)).otherwise(by_sorting(windows)))

    return _let(_let(F.sort_array(windows), twice), choose)


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")


def _windows(words: Column) -> Column:
    """One 64-bit hash for each three consecutive words."""

    def chained(h: Column) -> Column:
        n = F.size(h)
        two = F.zip_with(h, F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
        return F.slice(F.zip_with(two, F.slice(h, F.lit(3), n), lambda a, b: F.xxhash64(a, b)), F.lit(1), n - 2)

    return F.when(F.size(words) >= 3, _let(F.transform(words, lambda w: F.xxhash64(w)), chained))


def n_repeat_words(words: Column) -> Column:
    return _let(
        _windows(words),
        lambda w: F.when(w.isNull() | (F.size(F.array_distinct(w)) == F.size(w)), F.lit(0)).otherwise(_covered(w)),
    ).cast("long")


def with_statistics(docs: DataFrame, text: str = "text", parts: tuple[str, str] | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; ``parts`` names two columns of
    words and lines that stay, too."""
    body = text_of(text)
    w, lines = parts or unused(docs.columns, "__w", "__l")
    counted = docs.withColumn("n_words", F.lit(0).cast("long")).withColumns({w: _words(body), lines: _lines(body)})
    out = counted.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": word_chars(F.col(w)),
        "n_symbols": n_symbols(body),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": n_repeat_words(F.col(w)),
    })
    return out if parts else out.drop(w, lines)


def base_failed(words: Column, repeats: Column) -> Column:
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def method_rules(body: Column, words: Column, lines: Column, chars: Column | None = None, symbols: Column | None = None, dup_lines: Column | None = None) -> dict[str, Column]:
    """The rules beyond the base, of a text, its words and its lines. Statistics that the caller has already
    are used; the others are computed inside the rule, so that a skipped rule costs nothing."""
    n, m = F.size(words), F.size(lines)
    chars = word_chars(words) if chars is None else chars
    symbols = n_symbols(body) if symbols is None else symbols
    dup_lines = m - F.size(F.array_distinct(lines)) if dup_lines is None else dup_lines
    return {
        "symbols": 10 * symbols > n,
        "word_length": (2 * chars < 5 * n) | (chars > 15 * n),
        "duplicate_lines": 10 * dup_lines > 4 * m,
        "digits": 3 * (F.length(body) - F.length(F.regexp_replace(body, "[0-9]+", ""))) > F.length(body),
        "bullets": 10 * F.size(F.filter(lines, lambda s: F.ltrim(s).rlike("^[-*\u2022]"))) > 9 * m,
    }


def base_rules(words: Column) -> dict[str, Column]:
    return {
        "too_short": F.size(words) < MIN_WORDS,
        "repeats": 100 * n_repeat_words(words) > MAX_REPEAT_PERCENT * F.size(words),
    }


def all_rules(body: Column, words: Column, lines: Column) -> dict[str, Column]:
    return {**base_rules(words), **method_rules(body, words, lines)}


#: What a rule costs beyond splitting the text, in nanoseconds a character, a word and a line of its
#: document, as timed once on one core; every rule costs EACH besides. A rule without an entry counts as OTHER.
COSTS = {
    "too_short": (0, 0, 0), "bullets": (0, 0, 300), "duplicate_lines": (0, 0, 540), "word_length": (0, 75, 0),
    "digits": (22, 0, 0), "symbols": (30, 0, 0), "repeats": (0, 1900, 0),
}
OTHER, EACH = (30, 0, 0), 20


def estimate(docs: DataFrame, rules=all_rules, rows: int = SAMPLE_ROWS, text: str = "text") -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds a row) on at most ``rows`` rows, best rejections per cost first. One job over the
    sample counts what each rule hits, and the characters, words and lines that it would look at."""
    small = docs.select(text_of(text).alias("t")).filter(F.octet_length("t") <= SAMPLE_BYTES)
    texts = [(r.t,) for r in small.take(rows)]
    # As a table, not as a literal: plans keep the text of literals.
    sample = cut(docs.sparkSession.createDataFrame(texts, "t string").coalesce(1), "sample")
    split = sample.select("t", _words(F.col("t")).alias("w"), _lines(F.col("t")).alias("l"))
    made = rules(F.col("t"), F.col("w"), F.col("l"))
    sizes = [F.coalesce(F.sum(F.length("t")), F.lit(0)), F.coalesce(F.sum(F.size("w")), F.lit(0)), F.coalesce(F.sum(F.size("l")), F.lit(0))]
    n, *counted = split.agg(F.count("*"), *sizes, *(F.count_if(F.coalesce(hit, F.lit(False))) for hit in made.values())).first()
    if not n:
        return sorted((name, 0.0, 0.0) for name in made)
    units, hits = counted[:3], counted[3:]
    cost = {name: (EACH + sum(c * u for c, u in zip(COSTS.get(name, OTHER), units)) / n) * 1e-9 for name in made}
    found = [(name, h / n, cost[name]) for name, h in zip(made, hits)]
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2], x[0]))


def in_order(rules: list[Column]) -> Column:
    """True where no rule hits (null: no hit); a CASE expression stops at the first that does."""
    verdict = None
    for rule in rules:
        hit = F.coalesce(rule, F.lit(False))
        verdict = F.when(hit, F.lit(False)) if verdict is None else verdict.when(hit, F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def cascade(docs: DataFrame, rules=all_rules, rows: int = SAMPLE_ROWS, text: str = "text") -> Column:
    """True for the rows that no rule rejects; the best rejections per cost come first."""
    order = [name for name, _, _ in estimate(docs, rules, rows, text)]
    body = text_of(text)

    def verdict(p: Column) -> Column:
        made = rules(body, p["w"], p["l"])
        return in_order([made[name] for name in order])

    return _let(F.struct(_words(body).alias("w"), _lines(body).alias("l")), verdict)


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five statistics, base_failed, and kept: not base_failed and no rule of the cascade hit."""
    w, lines = unused(docs.columns, "__w", "__l")
    out = with_statistics(docs, text, parts=(w, lines)).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    ready = method_rules(text_of(text), F.col(w), F.col(lines), F.col("word_chars"), F.col("n_symbols"), F.col("n_dup_lines"))
    order = [name for name, _, _ in estimate(docs, method_rules, text=text)]
    return out.withColumn("kept", in_order([F.col("base_failed"), *(ready[name] for name in order)])).drop(w, lines)


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that pass the base rules and the method's, all in one cascade."""
    return docs.filter(cascade(docs, text=text))
