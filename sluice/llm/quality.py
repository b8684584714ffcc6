"""Quality by weak supervision, in DataFrame functions only.

Base counts come from whole texts. Rules over ratios of these counts vote good (1), bad (-1) or abstain (0).
Expectation-maximisation over the counts of vote patterns (at most 3 ** rules rows, whatever the corpus)
estimates the share of good documents and how accurate each rule's bad and good votes are; abstaining says
nothing. A prior as heavy as the votes themselves holds the accuracies and the share, for rules that fire apart
from all others have nobody to confirm them. The posterior probability of good replaces all-must-pass filtering.

A null or empty text has no words: every rule abstains and base_failed is true. Null and repeated doc_ids
are rows of their own. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut

#: A rule's name, its ratio (numerator, denominator), bounds beyond which it votes bad, and bounds within which it votes good.
Rule = tuple[str, str, str, float, float, float, float]
RULES: list[Rule] = [
    ("symbols", "n_symbols", "n_words", -1, 0.2, 1, 0),
    ("exclamations", "n_exclamations", "n_words", -1, 0.2, 1, 0),
    ("upper_case", "n_upper", "word_chars", -1, 0.4, 1, 0),
    ("repeated_words", "n_repeat_words", "n_words", -1, 0.4, 1, 0),
    ("repeated_lines", "n_dup_lines", "n_lines", -1, 0.4, 1, 0),
    ("word_length", "word_chars", "n_words", 2.0, 14.0, 1, 0),
    ("sentence_ends", "n_stops", "n_words", -1, 0.7, 0.02, 0.3),
]
ROUNDS = 15
#: Accuracies of bad and of good votes before any are seen.
PRIOR = {-1: 0.9, 1: 0.95}
#: Share of good documents before any vote is seen.
SHARE = 0.9
ODDS_SQL = f"ln((sum(c * q) + {SHARE} * (sum(c) + 1)) / (sum(c) - sum(c * q) + {1 - SHARE} * (sum(c) + 1)))"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Java escapes of the white space of the word contract.
SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though the body names it often."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in the array.

    Windows are hashed and sorted with their places; equal neighbours recur. Each recurring window
    covers up to the next one's start.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")),
    )

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)))
        return _let(F.array_sort(F.transform(again, lambda x: x["p"])), lambda at: F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), p + 3) - p)), F.lit(0).cast("long"), lambda a, b: a + b))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(F.sort_array(windows), covered))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = " \t\n\x0b\f\r"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: _without(x, spaces) > 0)
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    return rows.select(
        "doc_id",
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        *(n.cast("long").alias(a) for a, n in (
            ("word_chars", _without(F.col("text"), spaces)),
            ("n_symbols", F.length("text") - _without(F.col("text"), "#*$%&|<>")),
            ("n_exclamations", F.length("text") - _without(F.col("text"), "!")),
            ("n_upper", F.length("text") - _without(F.col("text"), UPPER)),
            ("n_stops", F.length("text") - _without(F.col("text"), ".!?")),
        )),
    ).select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_exclamations", "n_upper", "n_stops")


def vote(rule: Rule) -> Column:
    _, above, below, bad_low, bad_high, good_low, good_high = rule
    ratio = F.col(above) / F.when(F.col(below) > 0, F.col(below))
    return F.when(ratio.isNull(), 0).when((ratio < bad_low) | (ratio > bad_high), -1).when((ratio >= good_low) & (ratio <= good_high), 1).otherwise(0)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Log odds of good before any vote, and those each rule's vote adds.

    It starts from: good with 0.9 unless a rule votes bad, else with 0.2.
    """
    k = len(patterns[0][0]) if patterns else 0
    weights = [0.2 if -1 in p else 0.9 for p, _ in patterns]
    odds, adds = 0.0, [{-1: 0.0, 0: 0.0, 1: 0.0} for _ in range(k)]
    for _ in range(rounds if patterns else 0):
        total = sum(c for _, c in patterns)
        good = sum(c * q for (_, c), q in zip(patterns, weights))
        odds = math.log((good + SHARE * (total + 1)) / (total - good + (1 - SHARE) * (total + 1)))
        for j in range(k):
            for v in (-1, 1):
                votes = sum(c for p, c in patterns if p[j] == v)
                right = sum(c * (q if v == 1 else 1 - q) for (p, c), q in zip(patterns, weights) if p[j] == v)
                accuracy = (right + PRIOR[v] * (votes + 1)) / (2 * votes + 1)
                adds[j][v] = v * max(0.0, math.log(accuracy / (1 - accuracy)) - v * odds)
        weights = [1 / (1 + math.exp(-max(-700.0, min(700.0, odds + sum(adds[j][v] for j, v in enumerate(p)))))) for p, _ in patterns]
    return odds, adds


def quality(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior."""
    names = [f"vote_{r[0]}" for r in rules]
    counts = cut(base_counts(docs), "quality")
    voted = counts.withColumns({n: vote(r) for n, r in zip(names, rules)})
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().collect())
    odds, adds = estimate(patterns)
    total = F.lit(odds)
    for n, add in zip(names, adds):
        total = total + F.when(F.col(n) == 1, add[1]).when(F.col(n) == -1, add[-1]).otherwise(add[0])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (total >= 0)).alias("kept"), (1 / (1 + F.exp(-total))).alias("posterior"),
    )


def quality_sql(rules: list[Rule] = RULES) -> str:
    """The query's rows in DuckDB SQL, from its own counts of the words and windows."""
    spaces = r"[ \t\n\x0b\f\r]"
    votes = ", ".join(
        f"CASE WHEN {d} = 0 THEN 0 WHEN {a} / {d} < {bl} OR {a} / {d} > {bh} THEN -1 WHEN {a} / {d} >= {gl} AND {a} / {d} <= {gh} THEN 1 ELSE 0 END"
        for _, a, d, bl, bh, gl, gh in rules
    )
    k = len(rules)

    def add(j: int, v: int) -> str:
        votes = f"sum(CASE WHEN v[{j}] = {v} THEN c ELSE 0 END)"
        right = f"sum(CASE WHEN v[{j}] = {v} THEN c * {'q' if v == 1 else '(1 - q)'} ELSE 0 END)"
        accuracy = f"(({right} + {PRIOR[v]} * ({votes} + 1)) / (2 * {votes} + 1))"
        odds = ODDS_SQL
        return f"{v} * greatest(0, ln({accuracy} / (1 - {accuracy})) - {v} * {odds})"

    adds = ", ".join(f"[{add(j, -1)}, 0, {add(j, 1)}]" for j in range(1, k + 1))
    points = " + ".join(f"adds[{j}][v[{j}] + 2]" for j in range(1, k + 1))
    return f"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, list_filter(string_split_regex(t, '{spaces}+'), lambda x: x <> '') AS ws FROM d),
    g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
    h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
    u AS (SELECT r, count(DISTINCT i + o) AS n FROM h, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY r),
    l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) AS ls FROM d),
    f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{spaces}', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(regexp_replace(t, '!', '', 'g')) AS n_exclamations,
        length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[.!?]', '', 'g')) AS n_stops,
        len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(u.n, 0) AS n_repeat_words
        FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN u USING (r)),
    p AS (SELECT *, [{votes}] AS v FROM f),
    s AS (SELECT v, count(*)::DOUBLE AS c FROM p GROUP BY v),
    em AS (
        SELECT 0 AS step, 0::DOUBLE AS odds, NULL::DOUBLE[][] AS adds
        UNION ALL
        SELECT step + 1, {ODDS_SQL}, [{adds}] FROM (
            SELECT step, v, c, CASE WHEN step = 0 THEN CASE WHEN list_contains(v, -1) THEN 0.2 ELSE 0.9 END
                ELSE 1 / (1 + exp(-greatest(-700, least(700, odds + {points})))) END::DOUBLE AS q FROM em, s WHERE step < {ROUNDS}
        ) GROUP BY step
    ),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM p)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
        NOT base_failed AND odds + {points} >= 0 AS kept FROM b, (SELECT odds, adds FROM em WHERE step = {ROUNDS})
    """
