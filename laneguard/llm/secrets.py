"""Secret scans: fixed patterns, and a battery of randomness tests for strings that no pattern knows.

DataFrame functions only. Every whole text is split at the matches of a pattern; the running lengths of the parts give
the spans, in code points. Candidate strings get an inferred encoding; a chi-squared test of uniform use of its
alphabet, a runs test and a test of serial correlation give p-values for "drawn at random", joined by Fisher's rule.
Within each encoding and length band the Benjamini-Hochberg step-up rule decides which strings are called *not*
random; these go. What is reported is controlled by a second step-up rule per stratum, over p-values for "an ordinary
string": letters follow one another as in the words of this table, and classes of characters change as seldom as in
names. If a string has the probability q under that law and u when its characters are drawn evenly, then q/u is such a
p-value (by Markov's inequality the chance of a ratio so small is at most q/u). So the expected share of ordinary
strings among the reported ones is at most ``false_share``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laneguard.session import materialize

# fixed patterns of the base scan, in the order in which kinds are listed; the last two with their least lengths
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ASSIGN_VALUE = 8
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
# parts of a candidate that lie inside one alphabet; "=" belongs to a part only as padding at the end of the candidate
PARTS = ("[A-Za-z0-9+/]+(?:=+$)?", "[A-Za-z0-9_-]+(?:=+$)?", "[A-Za-z0-9]+(?:=+$)?")
PART_CHARS = 20
KINDS = ("assign", "access", "hex", "random")
BANDS = 16
BINS = 2048
"""P-values are counted in so many bins of equal width of -ln p up to ``LOWEST`` before they are ranked."""
LOWEST = 64.0
# alphabets in their usual order
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


# letters that follow one another are counted in words of four or more letters; this weight of even use is added
WORD = "[A-Za-z][a-z]{3,}"
EVEN_WEIGHT = 13.0
# probability that the next character of an ordinary string is of a class, by the class before it: lower-case letter,
# upper-case letter, digit, other (a documented parameter; each row sums to 1)
CLASSES = ("lower", "upper", "digit", "other")
CHANGES = ((0.84, 0.07, 0.03, 0.06), (0.60, 0.32, 0.03, 0.05), (0.12, 0.06, 0.60, 0.22), (0.50, 0.20, 0.25, 0.05))
LETTERS = "abcdefghijklmnopqrstuvwxyz"
OTHERS = 4
"""Characters of the class other: ``+ / _ -``."""

SPAN = "array<struct<s:int,e:int,m:string>>"
RUN = 512


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _spans(text: Column, pattern: str) -> Column:
    """Matches as ``array<struct<s, e, m>>``: start, end (exclusive), matched string.

    The start of a match is the length of all that was cut before it. Lengths are summed in runs of ``RUN`` matches,
    so that the work stays small for texts with very many matches.
    """
    empty = F.array().cast(SPAN)

    def placed(state: Column, x: Column) -> Column:
        start = state["at"] + x["g"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("out"))

    def shifted(run: Column, base: Column) -> Column:
        return F.transform(run["out"], lambda x: F.struct((x["s"] + base).alias("s"), (x["e"] + base).alias("e"), x["m"].alias("m")))

    def of_parts(parts: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int"))
        by_run = F.transform(numbers, lambda j: F.aggregate(F.slice(parts, j * RUN + 1, F.lit(RUN)), F.struct(F.lit(0).alias("at"), empty.alias("out")), placed))
        return _let(by_run, lambda runs: F.flatten(F.transform(runs, lambda r, j: _let(
            F.aggregate(F.slice(runs, 1, j), F.lit(0), lambda t, y: t + y["at"]), lambda base: shifted(r, base)))))

    def of_found(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda x: F.length(x))
        return _let(F.arrays_zip(gaps.alias("g"), found.alias("m")), of_parts)

    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of_found)).otherwise(empty)


def _encoding(m: Column) -> Column:
    """The narrowest alphabet that a string uses; null where there is none."""
    body = F.rtrim(m, F.lit("="))
    return (F.when(body.rlike("^[0-9]+$"), "digits").when(body.rlike("^[0-9a-f]+$"), "hex").when(body.rlike("^[0-9A-F]+$"), "HEX").when(body.rlike("^[A-Z2-7]+$"), "base32")
            .when(body.rlike("^[a-z0-9]+$"), "lower36").when(body.rlike("^[A-Za-z0-9+/]+$"), "base64").when(body.rlike("^[A-Za-z0-9_-]+$"), "base64url"))


def _parts(candidate: Column) -> Column:
    """The parts of a candidate span that are long enough to test, in one or another alphabet, each once."""
    inside = F.array_distinct(F.concat(*[_spans(candidate["m"], p) for p in PARTS]))
    inside = F.filter(inside, lambda x: F.length(x["m"]) >= PART_CHARS)
    return F.transform(inside, lambda x: F.struct((x["s"] + candidate["s"]).alias("s"), (x["e"] + candidate["s"]).alias("e"), x["m"].alias("m")))


def _upper_tail(z: Column) -> Column:
    """Upper tail of the standard normal law, by the rational approximation with an error below 7.5e-8."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def randomness(candidates: DataFrame) -> DataFrame:
    """Adds ``encoding``, ``n``, ``p_uniform``, ``p_runs``, ``p_serial`` and ``nlp`` (-ln of Fisher's joint p-value) to rows
    with a string ``m``; rows without an inferred encoding go."""
    c = candidates.withColumn("encoding", _encoding(F.col("m"))).filter(F.col("encoding").isNotNull())
    alphabet = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])
    c = c.withColumn("alphabet", alphabet[F.col("encoding")]).withColumn("chars", F.filter(F.split(F.rtrim("m", F.lit("=")), ""), lambda x: x != ""))
    c = c.withColumn("n", F.size("chars").cast("double")).withColumn("k", F.length("alphabet").cast("double"))
    c = c.withColumn("v", F.transform("chars", lambda x: F.instr(F.col("alphabet"), x).cast("double")))
    add = lambda t, x: t + x
    total = lambda xs: F.aggregate(xs, F.lit(0.0), add)
    c = c.withColumn("squares", total(F.transform(F.array_distinct("v"), lambda x: F.pow(F.size(F.filter("v", lambda y: y == x)).cast("double"), F.lit(2.0)))))
    c = c.withColumn("df", F.col("k") - 1).withColumn("chi2", F.col("squares") * F.col("k") / F.col("n") - F.col("n"))
    bend = 2 / (9 * F.col("df"))
    c = c.withColumn("p_uniform", _upper_tail((F.pow(F.greatest(F.col("chi2"), F.lit(0.0)) / F.col("df"), F.lit(1 / 3)) - (1 - bend)) / F.sqrt(bend)))
    c = c.withColumn("pairs", F.arrays_zip(F.slice("v", 1, F.size("v") - 1).alias("x"), F.slice("v", 2, F.size("v") - 1).alias("y")))
    c = c.withColumn("high", F.size(F.filter("v", lambda x: x > F.col("k") / 2)).cast("double")).withColumn("low", F.col("n") - F.col("high"))
    half = F.col("k") / 2
    c = c.withColumn("runs", 1.0 + F.size(F.filter("pairs", lambda p: (p["x"] > half) != (p["y"] > half))))
    c = c.withColumn("mu", 2 * F.col("high") * F.col("low") / F.col("n") + 1)
    c = c.withColumn("var", (F.col("mu") - 1) * (F.col("mu") - 2) / (F.col("n") - 1))
    one_side = F.exp(-(F.col("n") - 1) * 0.6931471805599453)
    c = c.withColumn("p_runs", F.when(F.col("var") > 0, 2 * _upper_tail(F.abs(F.col("runs") - F.col("mu")) / F.sqrt(F.when(F.col("var") > 0, F.col("var")).otherwise(1.0)))).otherwise(one_side))
    c = c.withColumn("mean", total(F.col("v")) / F.col("n"))
    c = c.withColumn("spread", total(F.transform("v", lambda x: (x - F.col("mean")) * (x - F.col("mean")))))
    lagged = total(F.transform("pairs", lambda p: (p["x"] - F.col("mean")) * (p["y"] - F.col("mean"))))
    r = lagged / F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0)
    c = c.withColumn("p_serial", F.when(F.col("spread") > 0, 2 * _upper_tail(F.abs(r + 1 / F.col("n")) * F.sqrt("n"))).otherwise(one_side))
    joint = -sum(F.log(F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(1e-300))) for p in ("p_uniform", "p_runs", "p_serial"))
    c = c.withColumn("x", joint).withColumn("nlp", F.greatest(F.col("x") - F.log(1 + F.col("x") + F.col("x") * F.col("x") / 2), F.lit(0.0)))
    return c.drop("alphabet", "chars", "v", "pairs", "squares", "df", "chi2", "k", "high", "low", "runs", "mu", "var", "mean", "spread", "x")


def letter_costs(docs: DataFrame, text_col: str = "text") -> list[float]:
    """-ln of the probability of a letter after a letter (index 26 * first + second), from all words of all texts.

    Words are counted before their pairs are, and pairs map-side; the 676 counts are all that reaches the driver. Runs of
    random characters hardly hold four lower-case letters in a row, so secrets do not blur the counts.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("c"))
    pair = F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")
    counts = [[0] * 26 for _ in range(26)]
    for r in words.select(F.explode(pair).alias("p"), "c").groupBy("p").agg(F.sum("c").alias("c")).collect():
        counts[LETTERS.index(r["p"][0])][LETTERS.index(r["p"][1])] = r["c"]
    return [-math.log((n + EVEN_WEIGHT / 26) / (sum(row) + EVEN_WEIGHT)) for row in counts for n in row]


def ordinary_bins(tested: DataFrame, costs: list[float]) -> DataFrame:
    """Adds ``ordinary_bin``: -ln of the p-value for an ordinary string, in bins as ``bin``."""
    body = F.rtrim("m", F.lit("="))
    table = F.array(*[F.lit(x) for x in costs])
    changes = F.array(*[F.lit(-math.log(x)) for row in CHANGES for x in row])
    sizes = F.create_map(*[x for k, v in ALPHABETS.items() for x in (F.lit(k), F.lit(math.log(len(v))))])
    kind = lambda x: F.when((x >= 97) & (x <= 122), 0).when((x >= 65) & (x <= 90), 1).when((x >= 48) & (x <= 57), 2).otherwise(3)
    letter = lambda x: F.when((x >= 97) & (x <= 122), x - 97).otherwise(x - 65)
    codes = F.transform(F.filter(F.split(body, ""), lambda x: x != ""), lambda x: F.ascii(x))
    chars = F.transform(codes, lambda x: F.struct(kind(x).alias("k"), F.when(kind(x) <= 1, letter(x)).alias("l")))
    t = tested.withColumn("chars", chars)
    alone = lambda x: F.when(x["k"] <= 1, math.log(26)).when(x["k"] == 2, math.log(10)).otherwise(math.log(OTHERS))
    # a letter is foretold by the letter before it, but not across a change from lower to upper case
    follows = lambda x, y: x["l"].isNotNull() & y["l"].isNotNull() & ~((x["k"] == 0) & (y["k"] == 1))
    step = lambda x, y: F.get(changes, x["k"] * 4 + y["k"]) + F.when(follows(x, y), F.get(table, x["l"] * 26 + y["l"])).otherwise(alone(y))
    pairs = F.zip_with(F.slice("chars", 1, F.size("chars") - 1), F.slice("chars", 2, F.size("chars") - 1), step)
    first = math.log(len(CLASSES)) + alone(F.get("chars", F.lit(0)))
    gain = F.aggregate(pairs, first, lambda a, x: a + x) - F.col("n") * sizes[F.col("encoding")]
    binned = F.floor(F.greatest(F.least(gain, F.lit(LOWEST)), F.lit(0.0)) * (BINS / LOWEST))
    return t.withColumn("ordinary_bin", F.least(binned, F.lit(BINS - 1)).cast("int")).drop("chars")


def step_up(tested: DataFrame, column: str, false_share: float) -> DataFrame:
    """``encoding, band, cut``: the step-up rule per stratum rejects the null for strings whose ``column`` is ``cut`` or higher."""
    counts = tested.groupBy("encoding", "band", F.col(column).alias("bin")).agg(F.count("*").alias("c"))
    stratum = Window.partitionBy("encoding", "band")
    counts = counts.withColumn("m", F.sum("c").over(stratum)).withColumn("rank", F.sum("c").over(stratum.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    ok = F.exp(-F.col("bin") * (LOWEST / BINS)) * F.col("m") <= F.lit(false_share) * F.col("rank")
    return counts.groupBy("encoding", "band").agg(F.coalesce(F.min(F.when(ok, F.col("bin"))), F.lit(BINS)).alias("cut"))


def scan_secrets(docs: DataFrame, false_share: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random``.

    A span is the whole match. Random strings are looked for in runs of 20 or more letters, digits and ``+/_=-``: what
    lies between ``=``, and in there also what lies between ``+/``, between ``_-`` and between any of these, is tested
    where it has 20 or more characters and no base span touches it. Of overlapping random strings the longest is
    reported, of equally long ones the first. Null and empty texts have no spans (empty ``spans``, the digest of no
    bytes); rows with null ids and repeated rows are scanned like any other; an empty table gives no rows. Only the id and
    text columns are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_VALUE
    bare = lambda kind, spans, k: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))
    base = F.array_sort(F.concat(bare("assign", F.filter(_spans(text, ASSIGN), value), 0), bare("access", _spans(text, ACCESS), 1), bare("hex", _spans(text, HEX), 2)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(F.monotonically_increasing_id().alias("rid"), "doc_id", base.alias("base"), _spans(text, CANDIDATE).alias("cand"))
    rows = materialize(rows, "secret-rows")
    meets = lambda x, y: (x["s"] < y["e"]) & (y["s"] < x["e"])
    near = F.transform("cand", lambda c: F.struct(c.alias("c"), F.filter("base", lambda b: meets(b, c)).alias("b")))
    found = rows.filter(F.size("cand") > 0).select("rid", F.explode(near).alias("x")).select("rid", F.col("x.b").alias("base"), F.col("x.c").alias("cand")).select("rid", "base", F.col("cand.s").alias("run"), F.explode(_parts(F.col("cand"))).alias("x"))
    found = found.filter(~F.exists("base", lambda b: meets(b, F.col("x")))).select("rid", "x.s", "x.e", "x.m", "run")
    tested = randomness(found).withColumn("band", F.least(F.floor(2 * F.log2(F.col("n") / 16)), F.lit(BANDS)).cast("int"))
    tested = tested.withColumn("bin", F.least(F.floor(F.col("nlp") * (BINS / LOWEST)), F.lit(BINS - 1)).cast("int"))
    tested = materialize(ordinary_bins(tested, letter_costs(docs, text_col)).select("rid", "run", "s", "e", "encoding", "band", "bin", "ordinary_bin"), "secret-tested")
    kept = tested.join(step_up(tested, "bin", false_share), ["encoding", "band"]).filter(F.col("bin") < F.col("cut")).drop("cut")
    kept = kept.join(step_up(tested, "ordinary_bin", false_share), ["encoding", "band"]).filter(F.col("ordinary_bin") >= F.col("cut"))
    # parts of one run may overlap
    better = lambda x, y: (y["e"] - y["s"] > x["e"] - x["s"]) | ((y["e"] - y["s"] == x["e"] - x["s"]) & (y["s"] < x["s"]))
    kept = kept.groupBy("rid", "run").agg(F.collect_list(F.struct("s", "e")).alias("all"))
    kept = kept.select("rid", F.explode(F.filter("all", lambda x: ~F.exists("all", lambda y: meets(x, y) & better(x, y)))).alias("x")).select("rid", "x.s", "x.e")
    kept = kept.groupBy("rid").agg(F.collect_list(F.struct("s", F.lit(3).alias("k"), "e", F.lit("random").alias("kind"))).alias("more"))
    none = F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")
    out = rows.join(kept, "rid", "left").withColumn("more", F.coalesce("more", none))
    n_of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    return out.select("doc_id", n_of("assign").alias("n_assign"), n_of("access").alias("n_access"), n_of("hex").alias("n_hex"),
                      F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"), line(F.array_sort(F.concat("base", "more"))).alias("spans"),
                      F.size("more").cast("long").alias("n_random"))
