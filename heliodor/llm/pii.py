"""Operator 8: personal data by bootstrapped contextual extraction.

Base entities (e-mail, IP, card, phone) are found by patterns. Candidates are tokens with
a digit or an at sign, and runs of such tokens that begin with a digit, parted by single blanks;
those that meet a base entity are the seeds. A candidate's lexical patterns are the one and
the two words before it (in the `CONTEXT` code points that end where it begins, the candidate before
included) with its shape (digits and letters by one sign a run, and how many digits). Spark scores the
bipartite graph of patterns and instances: seeds have 1; a pattern's confidence is the
mean score of its distinct instances; a pattern with at least `MIN_SEEDS` instances
of a score of `CONFIDENT` or more and a confidence as high is taken, and its instances get its
confidence. So instances that were found take in patterns in the next round;
rounds go on until none is added. Candidates under a pattern that was taken become spans of kind `id`.
They never overlap base spans, and base spans always stay.

A candidate has at least `MIN_DIGITS` digits or an at sign: shorter numbers are counts, years and
list numbers, which identify nobody whatever stands before them.

Scale: texts are read once and never shuffled; spans and candidates go to a
table in the shared folder. Patterns and instances are aggregated with partial
aggregates, so a very common pattern or value is summed before it moves. The work on a text is in
proportion to its length and its matches.

The base patterns use possessive loops and look-behinds that find the same
matches as the plain patterns in linear time without recursion, so very long
runs of letters, digits or dots are safe.

Defined cases: null text is empty and has no span; of equal candidates all are
taken; repeated rows of a doc_id, and rows without one, each have their own spans; extra columns are
ignored (mask keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliodor.llm.common import bounded, documents, drop, let, numbered, running, table

KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: kind -> pattern without groups, and a sign that a text must hold to be searched.
BASE = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", None),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
}
#: A token with a digit or an at sign, and the tokens behind it that begin with a digit.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [(]?[0-9]\S*+)*+"
#: Signs around a candidate that are not part of it.
BEFORE, BEHIND = "([{<\"'", ".,;:!?)]}>\"'"
MIN_SEEDS, CONFIDENT, MIN_DIGITS, CONTEXT = 4, 0.6, 4, 40


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes Luhn's test."""
    value = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, value(i)).otherwise(2 * value(i) - F.when(value(i) > 4, 9).otherwise(0)))
    return total % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.when(q == "", 0).otherwise(F.substring(q, 1, 4).cast("int")) <= 255)))
    if kind == "card":
        return _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda x: _passes(kind, x["match"])


def _span(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<match, gap, start, end>> of the leftmost matches that don't overlap; code points, end exclusive.

    gap is the text between the match before and this one. Starts are sums of the
    lengths of what stands before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        def with_gaps(g: Column) -> Column:
            lengths = F.zip_with(g, m, lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0)))
            ends = running(lengths, lambda a, b: a + b, F.lit(0))
            return let(ends, lambda e: F.transform(m, lambda x, i: F.struct(x.alias("match"), F.get(g, i).alias("gap"), (F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"))))

        return let(F.split(text, pattern, -1), with_gaps)

    empty = F.array().cast("array<struct<match:string,gap:string,start:int,end:int>>")
    return let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(empty))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> in the order of KINDS, then start."""
    parts = []
    for kind, (pattern, sign) in BASE.items():
        worth = F.contains(text, F.lit(sign)) if sign else F.rlike(text, F.lit("[0-9][0-9 -]{14}"))
        good = F.filter(matches(text, pattern), _test(kind))
        spans = F.transform(good, _span(kind))
        parts.append(F.when(worth, spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    return F.concat(*parts)


_CANDIDATES = "array<struct<value:string,patterns:array<string>,start:int,end:int>>"


def candidates(text: Column) -> Column:
    """array<struct<value, patterns, start, end>>: what may identify somebody, and its lexical patterns (none without a word before it)."""

    def one(x: Column, before: Column) -> Column:
        inner = F.ltrim(x["match"], F.lit(BEFORE))
        left = F.lower(F.concat(F.coalesce(before["match"], F.lit("")), x["gap"]))
        said = F.filter(F.split(F.regexp_replace(F.substring(left, -CONTEXT, CONTEXT), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")
        value = F.rtrim(inner, F.lit(BEHIND))
        shape = F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), r"\p{L}+", "a")
        shape = F.when(F.length(shape) <= 40, shape).otherwise(F.hex(F.xxhash64(shape)))
        kind = F.concat(shape, F.lit("|"), F.ceil(F.sqrt(F.length(_digits(value)))).cast("string"))
        patterns = let(said, lambda w: F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda n: F.size(w) >= n), lambda n: F.concat(F.array_join(F.slice(w, -n, n), " "), F.lit("|"), kind)))
        start = x["start"] + F.length(x["match"]) - F.length(inner)
        return F.struct(value.alias("value"), patterns.alias("patterns"), start.alias("start"), (start + F.length(value)).alias("end"))

    found = let(matches(text, CANDIDATE), lambda m: F.transform(m, lambda x, i: one(x, F.get(m, i - 1))))
    return F.filter(found, lambda c: (F.length(_digits(c["value"])) >= MIN_DIGITS) | F.contains(c["value"], F.lit("@")))


def scan(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, base, cands of every row, in a table."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))
    cands = F.when(F.rlike("text", F.lit("[0-9@]")), candidates(F.col("text"))).otherwise(F.array().cast(_CANDIDATES))
    return table(rows.select(F.expr("uuid()").alias("row_id"), "doc_id", "base", cands.alias("cands")), "pii")


def _placed(scanned: DataFrame) -> DataFrame:
    """row_id, value, patterns, start, end, seed (whether it meets a base span) of each candidate, in a table.

    A row's spans are walked in order of their places, and back."""
    each = scanned.where(F.size("cands") > 0).select("row_id", F.explode("cands").alias("c")).select("row_id", "c.*", F.lit(None).cast("int").alias("b0"), F.lit(None).cast("int").alias("b1"))
    base = scanned.where((F.size("cands") > 0) & (F.size("base") > 0)).select("row_id", F.explode("base").alias("b"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("value", "string"), ("patterns", "array<string>"))]
    both = each.unionByName(base.select("row_id", *none, F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.col("b.start").alias("b0"), F.col("b.end").alias("b1")))
    # Two growing frames: a shrinking one would be computed anew for each row.
    up = Window.partitionBy("row_id").orderBy("start", F.col("b0").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row_id").orderBy(F.col("start").desc()).rowsBetween(Window.unboundedPreceding, 0)
    before, behind = F.max("b1").over(up), F.min("b0").over(down)
    seed = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(behind < F.col("end"), F.lit(False))
    return table(both.withColumn("seed", seed).where("value IS NOT NULL").select("row_id", "value", "patterns", "start", "end", "seed"), "candidates")


def bootstrap(scanned: DataFrame) -> DataFrame:
    """row_id, start, end of the candidates that high-confidence patterns discover."""
    each = _placed(scanned)
    edges = table(each.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max(F.col("seed").cast("double")).alias("score")), "edges")
    taken = -1
    while True:
        sure = F.sum((F.col("score") >= CONFIDENT).cast("long"))
        patterns = edges.groupBy("pattern").agg(F.avg("score").alias("confidence"), sure.alias("sure")).where((F.col("sure") >= MIN_SEEDS) & (F.col("confidence") >= CONFIDENT)).select("pattern", "confidence")
        patterns = table(patterns, "patterns")
        now = patterns.count()
        if now == taken:
            break
        taken = now
        reached = edges.join(patterns, "pattern").groupBy("value").agg(F.max("confidence").alias("reached"))
        before, edges = edges, table(edges.join(reached, "value", "left").select("pattern", "value", F.greatest("score", F.coalesce("reached", F.lit(0.0))).alias("score")), "edges")
        drop(before, patterns)
    new = each.where(~F.col("seed")).select("row_id", "start", "end", F.explode("patterns").alias("pattern"))
    return new.join(patterns.select("pattern"), "pattern", "left_semi").select("row_id", "start", "end").distinct()


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and all: array<struct<kind, start, end>>, of every row of docs."""
    scanned = scan(docs)
    new = bootstrap(scanned).groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct(F.lit("id").alias("kind"), "start", "end"))).alias("new"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return scanned.join(new, "row_id", "left").select("doc_id", "base", F.concat("base", F.coalesce("new", none)).alias("all"))


#: Code points of a text that mask cuts at once.
_CUT = 4096


def _masked(text: Column, spans: Column) -> Column:
    """text with each of the sorted spans (start, end, kind; at least one) replaced; a span that begins before all before it have ended goes with them."""

    def replaced(s: Column, ends: Column, cuts: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            k = F.shiftright(a, 12)
            held = F.array_join(F.slice(cuts, k + 1, F.shiftright(b, 12) - k + 1), "")
            return F.substring(held, a - k * _CUT + 1, b - a)

        def one(x: Column, i: Column) -> Column:
            at = F.when(i == 0, 0).otherwise(F.get(ends, i - 1))
            return F.when(x["start"] >= at, F.concat(between(at, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))

        return F.concat(F.array_join(F.transform(s, one), ""), between(F.element_at(ends, -1), F.length(text)))

    cuts = F.transform(F.sequence(F.lit(0), F.shiftright(F.length(text), 12)), lambda k: F.substring(text, k * _CUT + 1, F.lit(_CUT)))
    ends = lambda s: running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
    return let(spans, lambda s: let(ends(s), lambda e: let(cuts, lambda c: replaced(s, e, c))))


def mask(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets. Other columns stay; rows without a doc_id, and rows that repeat one, are masked by their own spans."""
    rows = numbered(docs, "__row")
    rows = docs.withColumn("__row", F.col("doc_id")) if rows is None else rows
    spans = find(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), F.array_sort(F.transform("all", lambda s: F.struct(s["start"], s["end"], s["kind"]))).alias("__spans")).where(F.size("__spans") > 0)
    joined = rows.join(bounded(spans, units=F.size("__spans") + 1), "__row", "left")
    return joined.withColumn("text", F.when(F.col("__spans").isNotNull(), _masked(F.col("text"), F.col("__spans"))).otherwise(F.col("text"))).select(*docs.columns)


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _said(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_said("base"), 256).alias("base_sha256"), _said("all").alias("spans"))
