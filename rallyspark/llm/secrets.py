"""Secret scans: three base patterns, then a battery of randomness tests over unexplained tokens.

All of it is DataFrame expressions. Offsets count code points. A pattern's spans come from the pieces between its matches
(``split``) and the matches (``regexp_extract_all``): running sums of their lengths give the places.

The battery takes every token of 20 or more characters that no base span touches, infers an encoding from its characters (hex,
base32, base64; of the rest lower36 and upper36 with letters of one case and digits, else mixed) and computes three statistics, each standardised under the ordinary-token null for that length and encoding:
chi-squared distance from a uniform alphabet, runs of one character class, and lag-one serial correlation of the codes. Their
combined p-value enters a Benjamini-Hochberg step by length class and encoding; tokens below the threshold are added as spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Tokens of the battery.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Alphabet of each encoding; a character's code is its place.
HEX_CODES = "0123456789abcdef"
BASE32_CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64_CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
ALPHABETS = {"hex": HEX_CODES, "base32": BASE32_CODES, "base64": BASE64_CODES, "lower36": "abcdefghijklmnopqrstuvwxyz0123456789", "upper36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "mixed": BASE64_CODES}
#: Ordinary tokens under the null: chance that two characters agree, that neighbours differ in class, and their serial correlation.
NULL_AGREE = {"hex": 0.10, "base32": 0.075, "base64": 0.06, "lower36": 0.065, "upper36": 0.065, "mixed": 0.06}
NULL_SWITCH = {"hex": 0.12, "base32": 0.12, "base64": 0.3, "lower36": 0.12, "upper36": 0.12, "mixed": 0.3}
NULL_SERIAL = 0.35
#: Length classes of the false-discovery control, and its rate.
LENGTHS = (32, 48)
RATE = 0.01
_BINS = 400


def _running(lengths: Column) -> Column:
    """Sums before each element, by blocks of 256 so that texts with many matches stay cheap."""
    block = 256
    zero = F.array().cast("array<int>")

    def sums(xs: Column) -> Column:
        start = F.struct(zero.alias("out"), F.lit(0).alias("sum"))
        return F.aggregate(xs, start, lambda a, x: F.struct(F.concat(a["out"], F.array(a["sum"])).alias("out"), (a["sum"] + x).alias("sum")), lambda a: a["out"])

    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, block))
    return F.when(F.size(lengths) <= block, sums(lengths)).otherwise(F.flatten(F.zip_with(blocks, sums(F.transform(blocks, total)), lambda xs, base: F.transform(sums(xs), lambda x: x + base))))


def _found(text: Column, pattern: str, head: str | None = None) -> Column:
    """array<struct<start, end, hit>> of a pattern's matches, leftmost and non-overlapping."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x)), hits, lambda gap, hit: F.struct(F.coalesce(gap, F.lit(0)).alias("gap"), hit.alias("hit"), F.coalesce(F.char_length(hit), F.lit(0)).alias("n")))
    steps = F.filter(steps, lambda s: s["hit"].isNotNull())
    at = _running(F.transform(steps, lambda s: s["gap"] + s["n"]))
    spans = F.zip_with(steps, at, lambda s, base: F.struct((base + s["gap"]).alias("start"), (base + s["gap"] + s["n"]).alias("end"), s["hit"].alias("hit")))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.when(text.rlike(head or pattern), spans).otherwise(none)


def _kind(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``assign``, ``access``, ``hex`` (spans with their text) and ``base`` (all of them by start, then kind)."""
    t = F.coalesce(F.col(text), F.lit(""))
    value = lambda s: F.char_length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 12
    out = docs.withColumns({"assign": F.filter(_found(t, ASSIGN, ASSIGN_HEAD), value), "access": _found(t, ACCESS), "hex": _found(t, HEX)})
    return out.withColumn("base", F.array_sort(F.concat(_kind(F.col("assign"), "assign", 0), _kind(F.col("access"), "access", 1), _kind(F.col("hex"), "hex", 2))))


def _normal_below(z: Column) -> Column:
    """Standard normal distribution function, by a rational form of the tail with a relative error below 0.3 % at any distance."""
    x = F.abs(z)
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) / (0.661 * x + 0.339 * F.sqrt(x * x + 5.51))
    return F.when(z < 0, tail).otherwise(1 - tail)


def _battery(token: Column, encoding: Column) -> Column:
    """P-value of an ordinary token looking as random as this one."""
    of = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), encoding)
    k, alphabet = of({e: float(len(a)) for e, a in ALPHABETS.items()}), of(ALPHABETS)
    folded = F.when(encoding == "hex", F.lower(token)).when(encoding.isin("base64", "mixed"), F.translate(token, "-_", "+/")).otherwise(token)
    codes = F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1)
    n = F.char_length(token).cast("double")
    # chi-squared: sum of squared counts is the number of ordered pairs that agree
    counts = F.transform(F.array_distinct(codes), lambda a: F.size(F.filter(codes, lambda c: c == a)).cast("double"))
    chi = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c) * k / n - n
    shift = n * of({e: len(a) * NULL_AGREE[e] - 1 for e, a in ALPHABETS.items()})
    z_chi = (chi - (k - 1 + shift)) / F.sqrt(2 * (k - 1 + 2 * shift))
    # runs: neighbours of different class (digit, upper, lower, other)
    classes = F.translate(F.translate(F.translate(token, "0123456789", "0" * 10), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 26), "abcdefghijklmnopqrstuvwxyz", "a" * 26)
    switches = F.char_length(F.regexp_replace(classes, "(.)(?=\\1)", "")) - 1
    null = of(NULL_SWITCH)
    z_runs = (null * (n - 1) - switches) / F.sqrt(n * null * (1 - null))
    # serial correlation of neighbouring codes
    mean = F.aggregate(codes, F.lit(0.0), lambda s, c: s + c) / n
    dev = F.transform(codes, lambda c: c - mean)
    power = F.aggregate(dev, F.lit(0.0), lambda s, d: s + d * d)
    lag = F.aggregate(F.zip_with(dev, F.slice(dev, 2, F.greatest(F.size(dev) - 1, F.lit(0))), lambda a, b: a * F.coalesce(b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    z_serial = (F.abs(F.coalesce(lag / F.nullif(power, F.lit(0.0)), F.lit(1.0))) - NULL_SERIAL) * F.sqrt(n)
    return _normal_below((z_chi + z_runs + z_serial) / math.sqrt(3))


def random_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``tokens``: array<struct<start, end, encoding, stratum, p>> of tokens outside the base spans (needs ``base``)."""
    t = F.coalesce(F.col(text), F.lit(""))
    has = lambda x, p: x.rlike(p)
    encoding = lambda x: (
        F.when(has(x, r"^([0-9a-f]+|[0-9A-F]+)$") & has(x, "[a-fA-F]") & has(x, "[0-9]"), "hex")
        .when(has(x, r"^[A-Z2-7]+$") & has(x, "[0-9]") & has(x, "[A-Z]"), "base32")
        .when(has(x, "[0-9]") & has(x, "[a-z]") & has(x, "[A-Z]"), "base64")
        .when(has(x, "^[a-z0-9]+$"), "lower36").when(has(x, "^[A-Z0-9]+$"), "upper36").otherwise("mixed")
    )
    found = F.filter(_found(t, TOKEN), lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    named = F.transform(found, lambda s: F.struct(s["start"], s["end"], s["hit"], encoding(s["hit"]).alias("encoding")))
    size = lambda s: F.when(s["end"] - s["start"] < LENGTHS[0], 0).when(s["end"] - s["start"] < LENGTHS[1], 1).otherwise(2)
    scored = F.transform(named, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(s["encoding"], F.lit("/"), size(s).cast("string")).alias("stratum"), _battery(s["hit"], s["encoding"]).alias("p")))
    return docs.withColumn("tokens", scored)


def thresholds(scanned: DataFrame, rate: float = RATE) -> dict[str, float]:
    """Benjamini-Hochberg p-value limit of each stratum, from a histogram of at most 18 strata by 400 bins.

    A bin's upper edge stands for its p-values, so the limits err on the strict side.
    """
    edge = F.least(F.floor(-F.log10(F.greatest(F.col("t.p"), F.lit(1e-20))) * (_BINS / 20)), F.lit(_BINS - 1)).cast("int")
    counts = scanned.select(F.explode("tokens").alias("t")).groupBy(F.col("t.stratum").alias("stratum"), edge.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins: dict[str, dict[int, int]] = {}
    for stratum, b, n in counts.collect():  # bounded: 18 * 400 rows
        bins.setdefault(stratum, {})[b] = n
    out = {}
    for stratum, by in bins.items():
        total, below, limit = sum(by.values()), 0, 0.0
        for b in sorted(by, reverse=True):
            below += by[b]
            upper = 10 ** (-b * 20 / _BINS)
            if upper <= rate * below / total:
                limit = upper
        out[stratum] = limit
    return out


def scan(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """Add ``assign``, ``access``, ``hex``, ``base`` and ``spans`` (start, rank, end, kind) to every row.

    Null and empty texts have no spans. Repeated rows count as often as they occur. Two passes: the first only counts p-values.
    """
    scanned = random_tokens(base_spans(docs, text), text)
    limits = thresholds(scanned, rate)
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.create_map(F.lit(""), F.lit(0.0))
    added = F.transform(F.filter("tokens", lambda s: s["p"] <= F.coalesce(F.element_at(limit, s["stratum"]), F.lit(0.0))), lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end"), F.lit("random").alias("kind")))
    return scanned.withColumn("spans", F.array_sort(F.concat("base", added))).drop("tokens")


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace the union of every row's ``spans`` by ``mark``; null texts stay null."""
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))

    def grow(a: Column, x: Column) -> Column:
        meets = (a["e"] >= 0) & (x["start"] <= a["e"])
        done = F.when(meets | (a["e"] < 0), a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["s"].alias("start"), a["e"].alias("end")))))
        return F.struct(done.alias("done"), F.when(meets, a["s"]).otherwise(x["start"]).alias("s"), F.when(meets, F.greatest(a["e"], x["end"])).otherwise(x["end"]).alias("e"))

    merged = F.aggregate("spans", start, grow, lambda a: F.concat(a["done"], F.array(F.struct(a["s"].alias("start"), a["e"].alias("end")))))
    ends = F.concat(F.array(F.lit(0)), F.transform(merged, lambda m: m["end"]))
    starts = F.concat(F.transform(merged, lambda m: m["start"]), F.array(F.char_length(text)))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text), a + 1, b - a))
    return docs.withColumn(text, F.when(F.size("spans") > 0, F.array_join(pieces, mark)).otherwise(F.col(text)))


def redacted(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """All rows of ``docs`` with their own columns, secrets replaced; a column ``size``, if there is one, counts the text as it now is.

    The row travels as one struct, so columns named like those of ``scan`` keep their values.
    """
    clean = redact(scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text)), text), text)
    value = lambda c: F.col(text) if c == text else F.char_length(text).cast(dict(docs.dtypes)[c]) if c == size else F.col(f"_row.`{c}`")
    return clean.select(*[value(c).alias(c) for c in docs.columns])
