"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds.

Fixed patterns with checks give the base spans. High-recall generators propose every chain that could be an address or a number,
overlapping each other; gradient-boosted trees learn from the base spans, in their own form and in others that the patterns miss, what
such data looks like: from the shape of a span, its checksum and the characters and words around it but not from the exact patterns.
Counter-examples are only candidates that pass no kind's check or that are named as codes; all others may be what the patterns missed
and teach nothing. Per kind, the threshold is the highest score that ``RECALL`` of the base spans outside the learning sample reach.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import documents, with_columns
from sessionloom.llm.spans import SPAN, apart, digits_of, kept, listed, luhn, spans
from sessionloom.session import materialise

KINDS = ["email", "ip", "card", "phone"]
# The same matches as the plain patterns: a run is entered at its start only, and repeats give nothing back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators: what could be an address, and what could be a number, whatever its checks.
LIKE_ADDRESS = r"(?<![^\s<>,;:\"'|])[A-Za-z0-9._%+-]{1,64}\s?(?:@|\(at\)|\[at\]|＠)\s?[A-Za-z0-9.-]{2,128}"
LIKE_DOTTED = r"(?<![A-Za-z0-9.])[0-9]{1,5}(?:[.,:][0-9]{1,5}){2,7}(?![A-Za-z0-9])"
LIKE_NUMBER = r"(?<![A-Za-z0-9.+(-])[+(]{0,2}[0-9](?:[\x20()./-]{0,2}[0-9]){6,23}(?![A-Za-z0-9])"
LIKE_CODE = r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{7,40}(?![A-Za-z0-9])"
GENERATORS = {0: [LIKE_ADDRESS], 1: [LIKE_DOTTED], 2: [LIKE_CODE], 3: [LIKE_NUMBER]}
#: Candidates the trees learn from at most (those with the smallest hash), and trees.
FIT_SPANS = 20_000
TREES, DEPTH = 10, 4
#: Share of the base spans outside the learning sample, in all their forms, that a kind's threshold must let through, and its score's cells.
RECALL = 0.95
CELLS = 200
#: Words that name a code, and numbers with separators that are dates, spans of years or decimals.
CODE_BEFORE = r"(?i)(?<![a-z])(id|version|v|hash|commit|token|key|secret|isbn)[\s.:=\"']*$"
DATED = (
    r"^(?:(?:19|20)[0-9]{2}([-/.])[01]?[0-9]\1[0-3]?[0-9](?![0-9])|[0-3]?[0-9]([-/.])[0-3]?[0-9]\2(?:19|20)[0-9]{2}(?![0-9])"
    r"|(?:19|20)[0-9]{2}\x20?[-/]\x20?(?:19|20)[0-9]{2}$|(?![0-9]{3}\.[0-9]{4}$)[0-9]+\.[0-9]+$)"
)

_CANDIDATE = "array<struct<kind:int,start:int,end:int,value:string,before:string,after:string>>"


def base_spans(text: Column) -> list[Column]:
    """Spans of the fixed patterns that pass their checks, one array per kind."""
    part = lambda v: F.transform(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    low = lambda p: (F.char_length(p) <= 2) | ((F.char_length(p) == 3) & (p <= "255"))
    length = lambda v: F.char_length(digits_of(v))
    return [
        spans(text, EMAIL, 0),
        kept(spans(text, IP, 1), lambda v: F.forall(part(v), low)),
        kept(spans(text, CARD, 2), lambda v: F.when(length(v).between(16, 19), luhn(digits_of(v))).otherwise(False)),
        kept(spans(text, PHONE, 3), lambda v: length(v).between(8, 15)),
    ]


def _as_card(found: Column) -> Column:
    """Numbers too long for a telephone count as cards."""
    kind = lambda s: F.when(F.char_length(digits_of(s["value"])) > 15, 2).otherwise(s["kind"])
    return F.transform(found, lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def candidates(text: Column, base: Column) -> Column:
    """Base spans and generated ones, each once, with the 24 characters on either side."""
    every = F.array_distinct(F.concat(base, *[_as_card(spans(text, p, k)) if k == 3 else spans(text, p, k) for k, ps in GENERATORS.items() for p in ps]))
    return F.transform(every, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        F.substr(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))).alias("before"),
        F.substr(text, s["end"] + 1, F.lit(24)).alias("after"),
    ))


def features(value: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context numbers of a candidate."""
    digits = F.char_length(digits_of(value))
    size = F.char_length(value)
    last = F.substring(F.trim(before), -1, 1)
    return {
        "size": size,
        "digits": digits,
        "digit_share": digits / size,
        "groups": F.regexp_count(value, F.lit("[0-9]+")),
        "longest_group": F.array_max(F.transform(F.split(value, "[^0-9]+"), lambda g: F.char_length(g))),
        "dots": F.regexp_count(value, F.lit(r"\.")),
        "blanks": F.regexp_count(value, F.lit(r"\s")),
        "brackets": F.regexp_count(value, F.lit(r"[()\[\]]")),
        "letters": F.regexp_count(value, F.lit("[A-Za-z]")),
        "upper": F.regexp_count(value, F.lit("[A-Z]")),
        "at_sign": F.regexp_count(value, F.lit("@|＠|at")),
        "ends_in_word": value.rlike(r"\.[A-Za-z]{2,}[.-]*$").cast("int"),
        "after_blank": F.coalesce(before.rlike(r"(^|\s)$").cast("int"), F.lit(1)),
        "before_blank": F.coalesce(after.rlike(r"^(\s|$)").cast("int"), F.lit(1)),
        "quoted": F.coalesce(last.isin('"', "'", "=", "#", "/"), F.lit(False)).cast("int"),
        "named": before.rlike(r"(?i)(tel|phone|fax|call|mail|contact|card|visa|iban|ip|host|addr)\w*[\s.:=]*$").cast("int"),
        "in_code": before.rlike(CODE_BEFORE).cast("int"),
        "checksum": F.when(digits.between(13, 19), luhn(digits_of(value))).otherwise(False).cast("int"),
        "highest_part": F.array_max(F.transform(F.split(value, "[^0-9]+"), lambda g: F.when(F.char_length(g) <= 5, g.try_cast("int")).otherwise(99999))),
        "after_digit": before.rlike(r"[0-9][^\s]?$").cast("int"),
    }


def possible(value: Column) -> list[Column]:
    """Whether a candidate passes the checks of each kind, whatever pattern it has."""
    digits = F.char_length(digits_of(value))
    plain = ~value.rlike(r"[^0-9\x20()./+-]")
    parts = F.split(value, "[.,:]")
    four = (F.size(parts) == 4) & F.forall(parts, lambda p: (F.char_length(p) <= 5) & (p.try_cast("int") <= 255)) & value.contains(".")
    telephone = plain & digits.between(7, 15) & ~value.rlike(DATED) & ~value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    return [
        value.rlike(r"(@|\(at\)|\[at\]|＠).*\.[A-Za-z]{2,}[.-]*$"),
        F.coalesce(four, F.lit(False)),
        plain & F.when(digits.between(13, 19), luhn(digits_of(value))).otherwise(False),
        telephone,
    ]


def forms(kind: Column, value: Column) -> Column:
    """A base span as it is and in forms that the patterns miss: other signs for @, other separators, no plus or no country before a number."""
    spelt = [F.replace(value, F.lit("@"), F.lit(a)) for a in (" (at) ", "[at]", "＠", " @ ")]
    four = F.regexp_replace(digits_of(value), "([0-9]{4})(?=[0-9])", "$1 ")
    grouped = [F.replace(four, F.lit(" "), F.lit(g)) for g in ("", ".", " - ", "/")]
    country = r"^\+[0-9]{1,3}(?=[\x20.(-])[\x20.-]*"
    national = [F.regexp_replace(value, r"^\+", ""), F.regexp_replace(value, country, ""), F.regexp_replace(value, country + "(?=[1-9])", "0")]
    split = [F.regexp_replace(F.regexp_replace(n, r"^\(", ""), r"[\x20().-]+", g) for n in national for g in ("-", ".", " ")]
    every = F.when(kind == 0, F.array(value, *spelt)).when(kind == 2, F.array(value, *grouped)).when(kind == 3, F.array(value, *national, *split)).otherwise(F.array(value))
    return F.array_distinct(F.filter(every, lambda v: (kind != 3) | F.char_length(digits_of(v)).between(7, 15)))


def _scored(rows: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Scores of the rows (``kind``, ``value``, ``before``, ``after``) that are ``open``, and thresholds by kind.

    Rows have a ``label``: 1 for base spans, 0 for counter-examples, null for all others. None without base spans; without
    counter-examples nothing speaks against any row, and all score alike.
    """
    named = {n: c.cast("double") for n, c in features(F.col("value"), F.col("before"), F.col("after")).items()}
    vector = VectorAssembler(inputCols=["f_" + n for n in named], outputCol="features", handleInvalid="keep")
    draw = F.xxhash64("value", "before", "after")
    labelled = rows.where("label IS NOT NULL").select("kind", "value", "before", "after", "label", draw.alias("draw"))
    learn = labelled.where("pmod(draw, 4) <> 0").orderBy("draw", "value", "kind").limit(FIT_SPANS)
    # each base span as it is and in two of its other forms
    own = F.filter(forms(F.col("kind"), F.col("value")), lambda v: v != F.col("value"))
    turn = F.pmod(F.shiftright("draw", 2), F.greatest(F.size("own"), F.lit(1)).cast("long")).cast("int")
    turned = F.concat(F.slice("own", turn + 1, F.size("own")), F.slice("own", F.lit(1), turn))
    shown = F.when(F.col("label") == 1, F.concat(F.array("value"), F.slice(turned, 1, 2))).otherwise(F.array("value"))
    learn = learn.withColumn("own", own).select("before", "after", "label", F.explode(shown).alias("value"))
    learn = materialise(learn.select(*[c.alias("f_" + n) for n, c in named.items()], F.col("label").cast("double").alias("label")), "pii-learn")
    seen = {r[0] for r in learn.select("label").distinct().collect()}
    if 1.0 not in seen and labelled.where("label = 1").isEmpty():
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3, maxBins=32).fit(vector.transform(learn)) if len(seen) == 2 else None

    def score(df: DataFrame) -> DataFrame:
        if model is None:
            return df.withColumn("score", F.lit(1.0))
        ready = vector.transform(df.select("*", *[c.alias("f_" + n) for n, c in named.items()]))
        return model.transform(ready).withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "score")

    cell = F.least(F.floor(F.col("score") * CELLS), F.lit(CELLS - 1))
    base = labelled.where("label = 1").select("kind", "before", "after", "draw", F.explode(forms(F.col("kind"), F.col("value"))).alias("value"))
    counts = score(base).groupBy("kind", cell.alias("cell")).agg(F.count_if(F.pmod("draw", F.lit(4)) == 0).alias("held"), F.count("*").alias("n"))
    whole, down = Window.partitionBy("kind"), Window.partitionBy("kind").orderBy(F.desc("cell"))  # at most CELLS rows of a kind
    # a kind without base spans outside the sample is judged by those in it
    counts = counts.withColumn("n", F.when(F.sum("held").over(whole) > 0, F.col("held")).otherwise(F.col("n")))
    upto = counts.withColumn("all", F.sum("n").over(whole)).withColumn("n", F.sum("n").over(down))
    cuts = upto.where(F.col("n") >= RECALL * F.col("all")).groupBy(F.col("kind").alias("cut_kind")).agg((F.max("cell") / CELLS).alias("cut"))
    return score(rows.where("open").select("kind", "value", "before", "after")), cuts


def scan(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key`` columns of every row of ``df`` with ``pii`` (base spans by kind, then start) and ``more_pii`` (added spans).

    Spans are (kind, start, end, value), in code points, end exclusive; an added span overlaps no base span and no added span
    of a higher score. A null or empty text has none. Rows that agree in ``key`` and text are alike in their spans and all returned.
    A kind without base spans has nothing to be learnt from and nothing is added to it.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = with_columns(df.select(*[F.col(f"`{k}`") for k in key], body.alias("__body")), __mark=F.xxhash64("__body"))
    found = with_columns(found, pii=F.concat(*base_spans(F.col("__body"))))
    found = materialise(with_columns(found, __candidates=candidates(F.col("__body"), F.col("pii"))).drop("__body"), "pii-spans")
    each = found.select("__mark", "pii", F.explode("__candidates").alias("c")).select(
        "__mark", "c.*", F.exists("pii", lambda s: (s["start"] == F.col("c.start")) & (s["end"] == F.col("c.end")) ).alias("positive"),
        apart(F.col("c"), F.col("pii")).alias("free"),
    )
    # a candidate that overlaps a base span without being it tells nothing either way
    each = each.where("positive OR free")
    checks = possible(F.col("value"))
    fits = F.array(*checks)
    code = F.coalesce(F.col("before").rlike(CODE_BEFORE), F.lit(False))
    counter = code | ~F.exists(fits, lambda f: f)
    each = each.withColumn("label", F.when(F.col("positive"), 1).when(counter, 0)).withColumn("open", ~F.col("positive") & ~code & fits[F.col("kind")])
    none = F.array().cast(SPAN)
    result = _scored(each)
    if result is None:
        return found.select(*[F.col(f"`{k}`") for k in key], "pii", none.alias("more_pii"))
    scored, cuts = result
    cuts = materialise(cuts, "pii-cuts")
    accepted = scored.join(F.broadcast(cuts), (F.col("kind") == F.col("cut_kind")) & (F.col("score") >= F.col("cut")))
    accepted = accepted.select("kind", "value", "before", "after", "score").distinct()
    places = each.where("open").join(accepted, ["kind", "value", "before", "after"])
    added = places.groupBy("__mark").agg(F.collect_set(F.struct("score", "start", "end", "kind", "value")).alias("more"))
    better = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"]) & (F.struct(a["score"], a["start"], a["kind"]) < F.struct(b["score"], b["start"], b["kind"]))
    added = materialise(added.select("__mark", F.filter("more", lambda a: ~F.exists("more", lambda b: better(a, b))).alias("more")), "pii-added")
    spanned = F.transform("more", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return found.join(added, "__mark", "left").select(*[F.col(f"`{k}`") for k in key], "pii", F.coalesce(spanned, none).alias("more_pii"))


def redact(text: Column, found: Column, names: list[str] = KINDS) -> Column:
    """Text with every span replaced by its kind in angle brackets; of overlapping spans the earlier stands for both."""
    kinds = F.array(*[F.lit(f"<{n}>") for n in names])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(held: Column, s: Column) -> Column:
        gap = F.substr(text, held["at"] + 1, F.greatest(s["start"] - held["at"], F.lit(0)))
        new = F.when(s["start"] >= held["at"], F.concat(held["out"], gap, F.element_at(kinds, s["kind"] + 1))).otherwise(held["out"])
        return F.struct(F.greatest(held["at"], s["end"]).alias("at"), new.alias("out"))

    return F.aggregate(ordered, start, step, lambda h: F.concat(h["out"], F.substr(text, h["at"] + 1, F.greatest(F.char_length(text) - h["at"], F.lit(0)))))


def op2_candidate_boosting(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document: counts, a digest of the base spans, and all spans."""
    found = scan(documents(spark, folder), ["doc_id"])
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    bare = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    every = F.array_sort(F.concat(bare(F.col("pii")), bare(F.col("more_pii"))))
    return found.select(
        "doc_id", *[count(i).alias("n_" + k) for i, k in enumerate(KINDS)],
        F.sha2(listed(F.col("pii"), KINDS), 256).alias("base_sha256"), listed(every, KINDS).alias("spans"),
    )
