"""Secrets: fixed patterns, and a battery of randomness tests with false-discovery control.

Candidates are runs of 20 or more characters of the widest key alphabet. Each is read in the smallest encoding that holds it
(digits, hex, base32, letters and digits, base64) and tested against "every symbol is equally likely and independent": chi-squared over the
alphabet, runs above and below its middle, and lag-one serial correlation. The worst of the three, as a normal deviate, says how far
from random a run is.

Ordinary text read the same way gives the null: every distinct text lends all its letters, cut into consecutive stretches of each of a few
lengths, so a candidate is compared with text of its own length. Base spans and candidates are cut out first, and no stretch crosses one. The share of null runs that look at least as random is its p-value, and Benjamini-Hochberg over
all candidates of the table decides which are added. Counts of the null and of the candidates are kept per length
class and deviate, a table of bounded size.

Built-in functions only; whole texts. Null or empty texts have no spans; null keys are kept; repeated rows are judged each; an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import broadcast_if_small
from ..session import materialise
from .common import text_of

# The kinds in the order in which they are listed, and their patterns.
KINDS = ("assign", "access", "hex")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is long enough is the same match as with "+": both patterns take whole runs.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LENGTHS = (20, 24, 32, 40, 48, 64, 96)
DISCOVERY_RATE = 0.05
MOST_DEVIATE = 400
BROADCAST_DIGESTS = 500_000


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(text: Column, pattern: str, kind: str, value_group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern: lengths of what lies between matches, added up, give the places in code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    parts = F.arrays_zip(whole.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>").alias("spans"))

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + F.char_length(p["gap"])
        end = begin + F.coalesce(F.char_length(p["m"]), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), p["v"].alias("value"))
        held = p["m"].isNotNull() & (F.char_length(p["v"]) >= least)
        return F.struct(end.alias("at"), F.when(held, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(parts, start, step, lambda s: s["spans"])


EMPTY = "array<struct<start:int,end:int,kind:string,value:string>>"


def with_spans(df: DataFrame, text: Column) -> DataFrame:
    """``base`` spans in order of start and kind, and ``runs``: candidates that touch none of them."""
    none = F.array().cast(EMPTY)
    named = _let(F.lower(text), lambda low: reduce(or_, [low.contains(word) for word in KEYWORDS]))  # lowered once, not for each word
    out = df.withColumn("_assign_", F.when(named, _matches(text, ASSIGN, "assign", 2, 6)).otherwise(none))
    out = out.withColumn("_access_", F.when(text.contains("AKIA"), _matches(text, ACCESS, "access")).otherwise(none))
    out = out.withColumn("_hex_", F.when(text.rlike(HEX), _matches(text, HEX, "hex")).otherwise(none))
    out = out.withColumn("_runs_", F.when(text.rlike(RUN), _matches(text, RUN, "random")).otherwise(none))
    ordered = F.array_sort(F.transform(
        F.concat("_assign_", "_access_", "_hex_"),
        lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
    ))
    out = out.withColumn("base", ordered)
    free = F.filter("_runs_", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return out.withColumn("runs", free)


def _normal_of_chi(chi: Column, freedom: Column) -> Column:
    """Wilson-Hilferty: a chi-squared value as a normal deviate."""
    share = 2.0 / (9.0 * freedom)
    return (F.pow(chi / freedom, F.lit(1.0 / 3.0)) - (1.0 - share)) / F.sqrt(share)


def encoding_kinds(bare: Column) -> dict[int, Column]:
    """Size of an encoding → whether it holds the run, smallest first."""
    patterns = {10: "^[0-9]*$", 16: "^([0-9a-f]*|[0-9A-F]*)$", 32: "^[A-Z2-7]*$", 62: "^[A-Za-z0-9]*$"}
    return {size: bare.rlike(pattern) for size, pattern in patterns.items()}


def encoding_size(bare: Column) -> Column:
    """Symbols of the smallest encoding that holds the run."""
    kinds = encoding_kinds(bare)
    return F.when(kinds[10], 10).when(kinds[16], 16).when(kinds[32], 32).when(kinds[62], 62).otherwise(64)


def _codes(bare: Column, size: Column) -> Column:
    """Place of every symbol in its alphabet."""
    symbols = F.split(F.when(size == 16, F.lower(bare)).otherwise(bare), "")
    return _let(F.when(size == 32, F.lit(BASE32)).otherwise(F.lit(ALPHABET)), lambda alphabet: F.transform(symbols, lambda c: F.instr(alphabet, c) - 1))


def _worst(v: Column, size: Column, high: Column, sums: Column, variance: Column) -> Column:
    n, ups, mean = sums["n"], sums["ups"], sums["mean"]
    places = F.sequence(F.lit(1), F.size(v) - 1)
    squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda s, c: s + F.pow((F.size(v) - F.size(F.array_remove(v, c))).cast("double"), F.lit(2.0)))
    chi = _normal_of_chi(squares * size / n - n, size - 1.0)
    changes = F.aggregate(places, F.lit(0.0), lambda s, i: s + (F.get(high, i) != F.get(high, i - 1)).cast("double"))
    lag = F.aggregate(places, F.lit(0.0), lambda s, i: s + (F.get(v, i) - mean) * (F.get(v, i - 1) - mean)) / variance
    expected = 2.0 * ups * (n - ups) / n
    runs = F.abs(changes - expected) / F.sqrt(F.greatest(expected * (expected - 1.0) / (n - 1.0), F.lit(0.25)))
    serial = F.abs(lag + 1.0 / n) * F.sqrt(n)
    # a lopsided split leaves the runs test nothing to see; it is as far from random as its share
    lopsided = F.abs(ups * 2.0 - n) / F.sqrt(n)
    return F.least(F.round(F.greatest(chi, runs, serial, lopsided) * 10), F.lit(float(MOST_DEVIATE))).cast("int")


def deviate(run: Column) -> Column:
    """Worst deviate of the three tests, in tenths, at most ``MOST_DEVIATE``. Higher is less random; null with under 8 symbols.

    Every value that a later step reads more than once is bound first, so it is computed once.
    """

    def sums(v: Column, high: Column) -> Column:
        n = F.size(v).cast("double")
        return F.struct(
            n.alias("n"), F.size(F.array_remove(high, False)).cast("double").alias("ups"),
            (F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n).alias("mean"),
        )

    def tests(v: Column, size: Column) -> Column:
        return _let(F.transform(v, lambda x: x * 2 >= size), lambda high: _let(sums(v, high), lambda s: _let(
            F.greatest(F.aggregate(v, F.lit(0.0), lambda t, x: t + (x - s["mean"]) * (x - s["mean"])), F.lit(1e-9)),
            lambda variance: _worst(v, size, high, s, variance),
        )))

    def of_bare(bare: Column) -> Column:
        return _let(encoding_size(bare), lambda size: _let(_codes(bare, size), lambda v: F.when(F.size(v) >= 8, tests(v, size))))

    return _let(F.regexp_replace(run, "[=_-]", ""), of_bare)


def length_class(length: Column) -> Column:
    """The largest class that is not longer than the run."""
    found = F.lit(LENGTHS[0])
    for n in LENGTHS[1:]:
        found = F.when(length >= n, n).otherwise(found)
    return found


def ordinary_parts(text: Column) -> Column:
    """Letters and digits of what lies between base spans and candidates, one string for each gap."""
    spans = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))),
        F.transform("runs", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))),
    ))
    ends = F.concat(spans, F.array(F.struct(F.char_length(text).alias("start"), F.char_length(text).alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, span: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, F.greatest(span["start"] - s["at"], F.lit(0)))
        part = F.array_join(F.regexp_extract_all(gap, F.lit("[A-Za-z0-9+/]+"), F.lit(0)), "")  # taking out what stays is cheaper than replacing the rest
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), F.concat(s["parts"], F.array(part)).alias("parts"))

    return F.filter(F.aggregate(ends, start, step, lambda s: s["parts"]), lambda part: F.length(part) >= LENGTHS[0])


def null_runs(texts: DataFrame) -> DataFrame:
    """(class, run): every consecutive stretch of each class in the ``parts`` of every distinct text.

    ``texts`` has (digest, place, parts); of rows of one digest the one with the least place counts. One select for each class, so a filter on the
    class leaves the others uncut.
    """
    least = texts.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    once = texts.join(broadcast_if_small(least, BROADCAST_DIGESTS), "digest", "left").filter("first IS NULL OR place = first")

    def stretches(n: int) -> DataFrame:
        cut = F.flatten(F.transform("parts", lambda p: F.regexp_extract_all(p, F.lit(f".{{{n}}}"), F.lit(0))))
        return once.select(F.lit(n).alias("class"), F.explode(cut).alias("run"))

    return reduce(DataFrame.unionByName, map(stretches, LENGTHS))


def _tenths(value: Column) -> Column:
    return F.least(F.round(value * 10), F.lit(float(MOST_DEVIATE))).cast("int")


#: Encoding → the symbols below the middle of its alphabet, as a class of a pattern.
LOW = {10: "0-4", 16: "0-7", 32: "A-P", 62: "0-9a-u", 64: "0-9a-v"}


def _found(run: Column, pattern: str) -> Column:
    """Matches of a pattern in which ``%`` stands for the low symbols of the smallest encoding that holds the run."""
    kinds, of = encoding_kinds(run), {size: pattern.replace("%", low) for size, low in LOW.items()}
    chosen = F.when(kinds[10], of[10]).when(kinds[16], of[16]).when(kinds[32], of[32]).when(kinds[62], of[62]).otherwise(of[64])
    return F.size(F.regexp_extract_all(run, chosen, F.lit(0)))


def lopsided(run: Column) -> Column:
    """What the share of symbols above the middle of the alphabet adds to the deviate of a stretch: never more than the whole deviate."""
    n = F.length(run).cast("double")
    return _tenths(F.abs(_found(run, "[^%]") * 2.0 - n) / F.sqrt(n))


def _times(run: Column, symbol: Column) -> Column:
    return F.length(run) - F.length(F.replace(run, symbol, F.lit("")))


def uneven(run: Column) -> Column:
    """What the chi-squared test adds to the deviate of a stretch."""
    n = F.length(run)
    # symbols are counted in the string itself: an array would be copied for each of them
    squares = F.aggregate(F.array_distinct(F.split(run, "")), F.lit(0.0), lambda s, c: s + F.pow(_times(run, c).cast("double"), F.lit(2.0)))

    # bound first: a filter would work out the encoding anew at every mention
    return _let(encoding_size(run), lambda size: _tenths(_normal_of_chi(squares * size / n - n, size - 1.0)))


def most_squares(n: int, limit: int) -> float:
    """No sum of squared counts beyond this has an ``uneven`` within the limit, in the two widest encodings."""

    def most(size: int) -> float:
        share = 2.0 / (9.0 * (size - 1))
        return ((size - 1) * (1.0 - share + (limit + 0.5) / 10 * share**0.5) ** 3 + n) * n / size

    return max(most(62), most(64)) + 1.0


def plainly_uneven(run: Column, most: Column) -> Column:
    """Whether the counts of a few symbols alone bring the sum of squares beyond ``most``: each of the others adds its count or more.

    Symbols that are frequent in many languages find most of such stretches; no other is found. Only the two widest encodings hold g-z.
    """
    # (c - 1/2)^2 - 1/4 is c^2 - c with the count worked out once
    known = reduce(add, [F.pow(_times(run, F.lit(c)) - 0.5, F.lit(2.0)) - 0.25 for c in "etaoinsh"])
    return (known + F.length(run) > most) & run.rlike("[g-z]")


def stretch_deviate(run: Column) -> Column:
    """``deviate`` of a stretch of letters and digits, at least 8, without the chi-squared test: what runs, serial correlation and lopsidedness give."""
    n = F.length(run).cast("double")
    ups = _found(run, "[^%]").cast("double")
    changes = (_found(run, "[^%]+") + _found(run, "[%]+") - 1).cast("double")  # one between any two stretches of a side

    def runs(s: Column) -> Column:
        expected = 2.0 * s["ups"] * (n - s["ups"]) / n
        return F.abs(s["changes"] - expected) / F.sqrt(F.greatest(expected * (expected - 1.0) / (n - 1.0), F.lit(0.25)))

    def serial(away: Column) -> Column:
        variance = F.greatest(F.aggregate(away, F.lit(0.0), lambda s, x: s + x * x), F.lit(1e-9))
        lag = F.aggregate(F.sequence(F.lit(1), F.size(away) - 1), F.lit(0.0), lambda s, i: s + F.get(away, i) * F.get(away, i - 1)) / variance
        return F.abs(lag + 1.0 / n) * F.sqrt(n)

    def from_mean(v: Column) -> Column:
        return _let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n, lambda mean: F.transform(v, lambda x: x - mean))

    correlated = _let(encoding_size(run), lambda size: _let(_codes(run, size), lambda v: _let(from_mean(v), serial)))
    return F.greatest(_tenths(_let(F.struct(ups.alias("ups"), changes.alias("changes")), runs)), _tenths(correlated), lopsided(run))


def null_counts(stretches: DataFrame, candidates: DataFrame, rate: float = DISCOVERY_RATE) -> DataFrame:
    """(class, deviate, nulls) from all stretches (class, run), exact wherever it decides on a candidate; no rows for classes without one.

    A p-value above ``rate`` is never a discovery, whatever its size, so the null is counted exactly only up to a deviate per class at
    which the share of the null passes ``rate`` (or up to the largest deviate of a candidate). The deviate is the worst of several parts,
    so stretches with one part beyond that limit are beyond it, and the costly parts are computed for the others alone. The limit is guessed
    from the counts of the cheapest part and raised until it holds; all other stretches are counted one above it.
    """
    spark, schema = stretches.sparkSession, "class int, deviate int, nulls long"
    most = {r["class"]: r["most"] for r in candidates.groupBy("class").agg(F.max("deviate").alias("most")).collect()}  # at most one row for each class
    if not most:
        return spark.createDataFrame([], schema)
    runs = stretches.filter(F.col("class").isin(sorted(most)))
    cheap: dict[int, dict[int, int]] = {c: {} for c in most}
    for r in runs.groupBy("class", lopsided(F.col("run")).alias("least")).count().collect():  # at most MOST_DEVIATE + 1 for each class
        cheap[r["class"]][r["least"]] = r["count"]
    total = {c: sum(counts.values()) for c, counts in cheap.items()}

    def limit_at(c: int, share: float) -> int:
        seen = 0
        for d in range(most[c]):
            seen += cheap[c].get(d, 0)
            if seen >= share * total[c] and seen:
                return d
        return most[c]

    share, open_ = 6 * rate, {c for c in most if total[c]}
    out = [(c, most[c] + 1, 0) for c in most if not total[c]]
    while open_:
        limit = {c: limit_at(c, share) for c in open_}
        at_most = F.coalesce(*[F.when(F.col("class") == c, d) for c, d in limit.items()])
        squares = F.coalesce(*[F.when(F.col("class") == c, most_squares(c, d)) for c, d in limit.items()])
        near = runs.filter(F.col("class").isin(sorted(open_))).filter(lopsided(F.col("run")) <= at_most).filter(~plainly_uneven(F.col("run"), squares))
        # exploded, so that it is not worked out in the filter and again after it
        near = near.select("class", "run", F.explode(F.array(uneven(F.col("run")))).alias("uneven")).filter(F.col("uneven") <= at_most)
        counted: dict[int, dict[int, int]] = {c: {} for c in open_}
        for r in near.select("class", F.greatest("uneven", stretch_deviate(F.col("run"))).alias("deviate")).groupBy("class", "deviate").count().collect():  # as above
            if r["deviate"] <= limit[r["class"]]:
                counted[r["class"]][r["deviate"]] = r["count"]
        for c in sorted(open_):
            inside = sum(counted[c].values())
            if limit[c] >= most[c] or (inside + 1) / (total[c] + 1) > rate:
                out += [(c, d, n) for d, n in counted[c].items()] + [(c, limit[c] + 1, total[c] - inside)]
                open_.discard(c)
        share *= 2
    return spark.createDataFrame(out, schema)


def discoveries(null: DataFrame, found: DataFrame, rate: float = DISCOVERY_RATE) -> DataFrame:
    """(class, most): candidates of a class with a deviate of at most ``most`` are discoveries.

    ``null`` holds the stretches (class, run), or their deviates (class, deviate).

    Works on counts per class and deviate only, so its windows see a bounded number of rows.
    """
    null = null_counts(null, found, rate) if "run" in null.columns else null.withColumn("nulls", F.lit(1))
    counts = null.groupBy("class", "deviate").agg(F.sum("nulls").alias("nulls")).withColumn("hits", F.lit(0).cast("long")).unionByName(
        found.groupBy("class", "deviate").agg(F.count(F.lit(1)).alias("hits")).withColumn("nulls", F.lit(0).cast("long"))
    ).groupBy("class", "deviate").agg(F.sum("nulls").alias("nulls"), F.sum("hits").alias("hits"))
    by_class = Window.partitionBy("class")
    upto = by_class.orderBy("deviate").rowsBetween(Window.unboundedPreceding, 0)
    p = (F.sum("nulls").over(upto) + 1) / (F.sum("nulls").over(by_class) + 1)
    ranked = counts.select("class", "deviate", "hits", p.alias("p")).filter("hits > 0")
    by_p = Window.orderBy("p").rangeBetween(Window.unboundedPreceding, 0)
    tested = ranked.select("class", "deviate", "p", F.sum("hits").over(by_p).alias("rank"), F.sum("hits").over(Window.partitionBy()).alias("all"))
    passed = tested.withColumn("limit", F.max(F.when(F.col("p") <= rate * F.col("rank") / F.col("all"), F.col("p"))).over(Window.partitionBy()))
    return passed.filter(F.col("p") <= F.col("limit")).groupBy("class").agg(F.max("deviate").alias("most"))


def find(df: DataFrame, key: str = "doc_id", text: str = "text", rate: float = DISCOVERY_RATE) -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every text.

    Counts and digest of the three kinds are of the patterns; ``spans`` holds all, added ones as kind ``random``.
    """
    read = df.select(F.col(key), text_of(text).alias("_text_"))
    value = F.col("_text_")
    spotted = with_spans(read, value).select(
        key, "base",
        F.transform("runs", lambda r: F.struct(
            r["start"].alias("start"), r["end"].alias("end"), length_class(r["end"] - r["start"]).alias("class"), deviate(r["value"]).alias("deviate")
        )).alias("runs"),
        F.sha2(value, 256).alias("digest"), F.monotonically_increasing_id().alias("place"), ordinary_parts(value).alias("parts"),
    )
    spotted = materialise(spotted, "secrets")
    texts = spotted.select("digest", "place", "parts")
    candidates = spotted.filter(F.size("runs") > 0).select(F.explode("runs").alias("r")).select("r.class", "r.deviate").filter(F.col("deviate").isNotNull())
    chosen = discoveries(null_runs(texts), candidates, rate)
    # one row: at most one entry for each of the fixed length classes
    limits = materialise(chosen.agg(F.map_from_entries(F.collect_list(F.struct("class", "most"))).alias("limits")).withColumn("one", F.lit(1)), "secrets-limits")
    judged = spotted.drop("digest", "place", "parts").withColumn("one", F.lit(1)).join(F.broadcast(limits), "one", "left")
    added = F.filter("runs", lambda r: F.coalesce(r["deviate"] <= F.element_at("limits", r["class"]), F.lit(False)))

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("base", lambda b: b["kind"] == kind))

    every = F.array_sort(F.concat(
        F.col("base"), F.transform(added, lambda r: F.struct(r["start"].alias("start"), F.lit(len(KINDS) + 1).cast("long").alias("rank"), r["end"].alias("end"), F.lit("random").alias("kind")))
    ))
    return judged.select(
        key, *[of_kind(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.size(added).cast("long").alias("n_random"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"),
    )
