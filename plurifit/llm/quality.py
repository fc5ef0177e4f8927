"""Quality rules whose cutoffs carry a guarantee: few good documents are rejected in every stratum.

Every signal is a ratio, and a rule rejects a document whose ratio is above a cutoff. The labelled good documents of a stratum are
the holdout. If a rule would reject k of n of them, the exact binomial tail P(Bin(n, risk) <= k) is the evidence against
"this rule rejects more than ``risk`` of the good ones". Per stratum and signal the cutoffs are tested from the mildest to the
strictest and the walk stops at the first that fails, so no cutoff pays for the others; the level is divided by the
number of (stratum, signal) walks (Bonferroni). The risk of a stratum is shared out equally over its signals, so that all its rules together stay
below it. A stratum with too few labels gets no rule and rejects nothing.

Built-in functions only; whole texts; no shuffle of texts. A null or empty text has no words and fails the base rule. Null keys are kept and have no
labels. A null stratum is a stratum of its own. A key labelled more than once is good if all labels say so; null labels are ignored.
Repeated rows are judged, and counted in the holdout, each. Empty tables give an empty result or no rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORD_PATTERN

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RISK = 0.06
LEVEL = 0.05
BROADCAST_STRATA = 10_000
#: signal: numerator, denominator, and cutoffs per mille from the mildest to the strictest
SIGNALS: dict[str, tuple[str, str, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "word_chars", (500, 300, 200, 150, 100, 70, 50, 30)),
    "dup_lines": ("n_dup_lines", "n_words", (200, 150, 100, 70, 50, 40, 30, 20)),
    "repeats": ("n_repeat_words", "n_words", (190, 150, 120, 100, 80, 60, 50, 40)),
    "upper": ("n_upper", "word_chars", (900, 800, 700, 600, 500, 400, 300, 200)),
    "marks": ("n_marks", "n_words", (1500, 1000, 800, 600, 500, 400, 300, 200)),
    "word_length": ("word_chars", "n_words", (40000, 30000, 25000, 20000, 17000, 15000, 13000, 12000)),
}


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more. Hashes only rule out texts without any repeat; the rest is compared as text."""
    n = F.size(words)
    places = F.sequence(F.lit(1), n - 4)
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words, i, F.lit(5))))
    windows = F.array_sort(F.transform(places, lambda i: F.struct(F.array_join(F.slice(words, i, F.lit(5)), " ").alias("w"), i.alias("i"))))

    def twice(sorted_windows: Column) -> Column:
        last = F.size(sorted_windows)
        at = F.filter(
            F.sequence(F.lit(1), last),
            lambda k: ((k > 1) & (F.get(sorted_windows, k - 2)["w"] == F.get(sorted_windows, k - 1)["w"]))
            | ((k < last) & (F.get(sorted_windows, k)["w"] == F.get(sorted_windows, k - 1)["w"])),
        )
        return F.array_sort(F.transform(at, lambda k: F.get(sorted_windows, k - 1)["i"]))

    def covered(starts: Column) -> Column:
        steps = F.zip_with(F.slice(starts, F.lit(2), F.size(starts)), F.slice(starts, F.lit(1), F.size(starts) - 1), lambda b, a: F.least(F.lit(5), b - a))
        return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(5), lambda s, x: s + x))

    # one-element arrays name a value inside a single expression
    exact = F.get(F.transform(F.array(windows), lambda w: F.get(F.transform(F.array(twice(w)), covered), F.lit(0))), F.lit(0))
    some = F.get(F.transform(F.array(hashes), lambda h: F.size(F.array_distinct(h)) < F.size(h)), F.lit(0))
    return F.when(n < 6, F.lit(0)).when(some, exact).otherwise(F.lit(0))


def signals(df: DataFrame, key: str, text: str, stratum: str | None) -> DataFrame:
    """(key, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks) of every whole text."""
    texts = df.select(
        F.col(key), (F.col(stratum).cast("string") if stratum else F.lit("all")).alias("stratum"), F.coalesce(F.col(text), F.lit("")).alias("_text_")
    )
    t = F.col("_text_")
    cut = texts.withColumn("_words_", F.regexp_extract_all(t, F.lit(WORD_PATTERN), F.lit(0))).withColumn(
        "_lines_", F.filter(F.split(t, "\n"), lambda line: _without(line, SEPARATORS) > 0)
    )
    words, lines = F.col("_words_"), F.col("_lines_")
    made = {
        "n_words": F.size(words), "word_chars": _without(t, SEPARATORS), "n_symbols": F.char_length(t) - _without(t, SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": _repeat_words(words),
        "n_upper": F.char_length(t) - _without(t, UPPER), "n_marks": F.char_length(t) - _without(t, "!"),
    }
    return cut.select(key, "stratum", *[c.cast("long").alias(name) for name, c in made.items()])


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed from the largest term down. Above the mean it is at least one half and given as 1."""
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    top = F.aggregate(steps, F.lit(0.0), lambda s, i: s + F.ln((n - k + i) / i)) + k * F.ln(F.lit(p)) + (n - k) * F.ln(F.lit(1 - p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * ((k - i + 1) / (n - k + i)) * F.lit((1 - p) / p)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(top) * F.aggregate(steps, start, add, lambda s: s["total"]))


def _above(signal: str, cutoff: int | Column) -> Column:
    top, bottom, _ = SIGNALS[signal]
    return F.col(top) * 1000 > F.lit(cutoff) * F.col(bottom) if isinstance(cutoff, int) else F.col(top) * 1000 > cutoff * F.col(bottom)


def cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per stratum with labels: the strictest safe cutoff of each signal (null: none)."""
    good = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("_good_")).filter("_good_ = 1").select(key)
    held = measured.filter(~base_failed()).join(good, key)
    hits = [F.sum(_above(s, c).cast("long")).alias(f"{s}_{i}") for s, (_, _, cs) in SIGNALS.items() for i, c in enumerate(cs)]
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *hits)
    walks = counts.agg((F.count(F.lit(1)) * len(SIGNALS)).alias("walks"))
    share = risk / len(SIGNALS)
    chosen = []
    for s, (_, _, cs) in SIGNALS.items():
        tails = F.array(*[binomial_tail(F.col(f"{s}_{i}"), F.col("n"), share) for i in range(len(cs))])
        safe = F.transform(tails, lambda p: p <= F.lit(level) / F.col("walks"))
        first_bad = F.coalesce(F.array_position(safe, F.lit(False)), F.lit(0).cast("long"))
        passed = F.when(first_bad == 0, F.lit(len(cs)).cast("long")).otherwise(first_bad - 1)
        chosen.append(F.when(passed > 0, F.get(F.array(*map(F.lit, cs)), (passed - 1).cast("int"))).cast("long").alias(f"{s}_cut"))
    one = F.lit(1).alias("one")
    return counts.select("*", one).join(F.broadcast(walks.select("*", one)), "one").select("stratum", "n", *chosen)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def judge(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str | None = "lang", label: str = "quality",
    risk: float = RISK, level: float = LEVEL,
) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by) of every text."""
    measured = materialise(signals(df, key, text, stratum), "quality")
    rules = materialise(cutoffs(measured, labels, key, label, risk, level), "quality-rules")
    rules = rules.select(F.col("stratum").alias("_stratum_"), *[f"{s}_cut" for s in SIGNALS])
    if rules.count() <= BROADCAST_STRATA:
        rules = F.broadcast(rules)
    joined = measured.join(rules, F.col("stratum").eqNullSafe(F.col("_stratum_")), "left")
    fired = F.array_compact(F.array(*[F.when(F.coalesce(_above(s, F.col(f"{s}_cut")), F.lit(False)), F.lit(s)) for s in SIGNALS]))
    return joined.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & (F.size(fired) == 0)).alias("kept"), F.array_join(fired, ",").alias("rejected_by"),
    )


def oracle(table: str = "documents", risk: float = RISK, level: float = LEVEL) -> str:
    """The same rows in DuckDB SQL."""
    sep = "'[^ \\x09-\\x0D]+'"
    hits = ", ".join(f"sum(({top} * 1000 > {c} * {bottom})::int) AS {s}_{i}" for s, (top, bottom, cs) in SIGNALS.items() for i, c in enumerate(cs))
    share = risk / len(SIGNALS)

    def tail(k: str) -> str:
        return (
            f"CASE WHEN {k} > n * {share!r} THEN 1.0 ELSE list_sum(list_transform(range(0, {k}::bigint + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) "
            f"+ j * ln({share!r}) + (n - j) * ln(1 - {share!r})))) END"
        )

    cuts = []
    for s, (_, _, cs) in SIGNALS.items():
        safe = "[" + ", ".join(f"({tail(f'{s}_{i}')}) <= {level!r} / walks" for i in range(len(cs))) + "]"
        cuts.append(f"{list(cs)}[coalesce(list_position({safe}, false) - 1, {len(cs)})::int] AS {s}_cut")
    fired = ", ".join(f"CASE WHEN {top} * 1000 > {s}_cut * {bottom} THEN '{s}' END" for s, (top, bottom, _) in SIGNALS.items())
    no_sep = "regexp_replace(t, '[ \\x09-\\x0D]', '', 'g')"
    return f"""
WITH texts AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS t, row_number() OVER () AS r FROM {table}),
cut AS (SELECT *, regexp_extract_all(t, {sep}) AS words,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {sep})) AS lines FROM texts),
windows AS (SELECT r, i, list_slice(words, i, i + 4) AS w FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM cut WHERE len(words) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
measured AS (SELECT doc_id, stratum, len(words)::bigint AS n_words, length({no_sep})::bigint AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
        coalesce(repeats.n, 0)::bigint AS n_repeat_words, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint AS n_upper,
        (length(t) - length(replace(t, '!', '')))::bigint AS n_marks FROM cut LEFT JOIN repeats USING (r)),
judged AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM measured),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
counts AS (SELECT stratum, count(*) AS n, {hits} FROM judged JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY stratum),
rules AS (SELECT stratum AS rule_stratum, {", ".join(cuts)} FROM counts, (SELECT count(*) * {len(SIGNALS)} AS walks FROM counts)),
fired AS (SELECT *, list_filter([{fired}], lambda x: x IS NOT NULL) AS f FROM judged LEFT JOIN rules ON stratum IS NOT DISTINCT FROM rule_stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(f) = 0 AS kept,
       array_to_string(f, ',') AS rejected_by FROM fired"""
