"""Secret scan: fixed patterns, and a battery of randomness tests for tokens of unknown format.

A long token gets the smallest encoding that holds its characters (hex, base 32, base 64). Under the hypothesis that it is a random
string of that encoding, three tests give p-values: chi-squared for uniform use of the alphabet, the number of runs above
and below the alphabet's middle, and the serial correlation of neighbouring characters. A weighted Benjamini-Hochberg step over a
document's tokens (weights in proportion to length: a long token gives its tests more power) bounds the share of
random strings among the tokens it dismisses; tokens it cannot dismiss are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import documents, with_columns
from sessionloom.llm.spans import apart, kept, listed, spans

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: A token that the battery tests: 24 characters or more, or 16 to 23 with a letter and a digit.
TOKEN = (
    r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{24,}+|(?=[0-9+/_-]*[A-Za-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,23}+)(?![A-Za-z0-9+/_-])"
)
#: Share of random strings among dismissed tokens.
RATE = 0.01
_SIXTEEN = "0123456789abcdef"
_THIRTY_TWO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_SIXTY_FOUR = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def above(z: Column) -> Column:
    """Upper tail of the standard normal distribution (logistic form, error under 0.0002)."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def battery(codes: Column, size: int, cells: int) -> Column:
    """Smallest of the three p-values, times three."""
    n = F.size(codes).cast("double")
    expected = n / cells
    counts = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda k: F.size(F.filter(codes, lambda c: F.floor(c * cells / size) == k)))
    chi = F.aggregate(counts, F.lit(0.0), lambda t, o: t + (o - expected) * (o - expected) / expected)
    df = cells - 1.0
    p_chi = above((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5)
    left, right = F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1)
    high = F.size(F.filter(codes, lambda c: c >= size // 2)).cast("double")
    changes = F.aggregate(F.zip_with(left, right, lambda a, b: ((a >= size // 2) != (b >= size // 2)).cast("double")), F.lit(0.0), lambda t, x: t + x)
    mean = 2 * high * (n - high) / n
    deviation = F.sqrt(F.greatest(mean * (mean - 1) / (n - 1), F.lit(1e-9)))
    p_runs = F.when((high == 0) | (high == n), 0.0).otherwise(2 * above(F.abs(changes - mean) / deviation))
    centre = F.aggregate(codes, F.lit(0.0), lambda t, c: t + c) / n
    spread = F.aggregate(codes, F.lit(0.0), lambda t, c: t + (c - centre) * (c - centre))
    shared = F.aggregate(F.zip_with(left, right, lambda a, b: (a - centre) * (b - centre)), F.lit(0.0), lambda t, x: t + x)
    p_serial = F.when(spread == 0, 0.0).otherwise(2 * above(F.abs(shared / spread * F.sqrt(n))))
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))


def few_changes(value: Column) -> Column:
    """p-value of so few changes between small letters, capitals, digits and signs in a random base 64 string: words change seldom."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "+"), "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    changes = F.regexp_count(kinds, F.lit(r"(?<=a)[^a]|(?<=A)[^A]|(?<=0)[^0]|(?<=\+)[^+]"))
    share, pairs = 1 - (2 * 26**2 + 10**2 + 2**2) / 64**2, F.char_length(value) - 1
    return above((share * pairs - changes) / F.sqrt(share * (1 - share) * pairs))


def randomness(value: Column) -> Column:
    """p-value of a token under the hypothesis that it is random in its encoding."""

    def codes(text: Column, alphabet: str) -> Column:
        return F.transform(F.split(text, ""), lambda c: F.call_function("locate", c, F.lit(alphabet)) - 1)

    wide = F.translate(value, "-_", "+/")
    return (
        F.when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), battery(codes(F.lower(value), _SIXTEEN), 16, 16))
        .when(value.rlike("^[A-Z2-7]+$") & value.rlike("[2-7]"), battery(codes(value, _THIRTY_TWO), 32, 8))
        .when(F.char_length(value) < 24, F.least(4 / 3 * battery(codes(wide, _SIXTY_FOUR), 64, 8), 4 * few_changes(value)))
        .otherwise(battery(codes(wide, _SIXTY_FOUR), 64, 8))
    )


def undismissed(tokens: Column) -> Column:
    """Of spans with a field ``p``, those that the length-weighted Benjamini-Hochberg step does not dismiss."""
    total = F.aggregate(tokens, F.lit(0.0), lambda t, s: t + (s["end"] - s["start"]))
    m = F.size(tokens)
    weighted = F.transform(tokens, lambda s: s["p"] * total / (m * (s["end"] - s["start"])))
    ranked = F.array_sort(weighted)
    passed = F.filter(F.transform(ranked, lambda p, i: F.when(p <= (i + 1) * RATE / m, p)), lambda p: p.isNotNull())
    cut = F.coalesce(F.array_max(passed), F.lit(-1.0))
    return F.filter(tokens, lambda s: s["p"] * total / (m * (s["end"] - s["start"])) > cut)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``secrets`` (base spans by start, then kind) and ``random_tokens`` (spans the battery adds).

    Spans are (kind, start, end, value), in code points, end exclusive. A null or empty text has none. An added token overlaps no
    base span. Columns of those names are replaced; repeated rows give repeated spans.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    assign = kept(spans(body, ASSIGN, 0), lambda v: F.char_length(F.regexp_extract(v, ASSIGN, 2)) >= 6)
    access = kept(spans(body, ACCESS, 1), lambda v: F.char_length(v) >= 20)
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    found = with_columns(df, secrets=F.array_sort(F.concat(assign, access, spans(body, HEX, 2)), order), __tokens=spans(body, TOKEN, 3))
    loose = F.filter("__tokens", lambda s: apart(s, F.col("secrets")))
    tested = F.transform(loose, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), randomness(s["value"]).alias("p")))
    found = with_columns(found, __tokens=F.when(F.size("__tokens") > 0, tested))
    extra = F.coalesce(undismissed(F.col("__tokens")), F.array().cast("array<struct<kind:int,start:int,end:int,value:string,p:double>>"))
    return with_columns(found, random_tokens=extra).drop("__tokens")


def op3_randomness_battery(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: counts, a digest of the base spans, and all spans."""
    found = scan(documents(spark, folder).select("doc_id", "text")).drop("text")
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    every = F.array_sort(F.concat(bare(F.col("secrets")), bare(F.col("random_tokens"))))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("secrets"), KINDS), 256).alias("base_sha256"), listed(every, KINDS).alias("spans"),
    )
