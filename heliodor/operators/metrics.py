"""Evaluation metrics of answers, retrieved lists and judge replies."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from heliodor.functions.scalars import f1, let, ratio
from heliodor.functions.text import normalize_answer, porter
from heliodor.operators.search import vector_score


def _doubles(names: tuple[str, ...]) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


def exact_match(answer: Column, truth: Column) -> Column:
    return (normalize_answer(answer) == normalize_answer(truth)).cast("double")


def covered_match(answer: Column, truth: Column) -> Column:
    return F.contains(normalize_answer(answer), normalize_answer(truth)).cast("double")


def ngrams(tokens: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    return let(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))).otherwise(none))


def _place(ordered: Column, value: Column, after: bool) -> Column:
    """How many values of a sorted array are less than value (or, with after, not greater), by bisection."""
    fits = lambda x: x <= value if after else x < value
    steps = F.array(*[F.lit(1 << b) for b in range(27, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= F.size(ordered)) & fits(F.get(ordered, low + step - 1)), low + step).otherwise(low))


def clipped_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays: the counts of what both hold, from both in order."""
    count = lambda xs, x: _place(xs, x, True) - _place(xs, x, False)
    both = lambda p: F.aggregate(F.array_intersect(p["a"], p["b"]), F.lit(0), lambda s, x: s + F.least(count(p["a"], x), count(p["b"], x)))
    return let(F.struct(F.sort_array(a).alias("a"), F.sort_array(b).alias("b")), both)


def rouge_n(tokens: Column, truth: Column, n: int) -> Column:
    """struct<precision, recall, f1> of n-grams, unstemmed unless the tokens are stems."""

    def scored(g: Column) -> Column:
        hit = clipped_overlap(g["a"], g["b"]).cast("double")
        p, r = ratio(hit, F.size(g["a"])), ratio(hit, F.size(g["b"]))
        return let(F.struct(p.alias("p"), r.alias("r")), lambda x: F.struct(x["p"].alias("precision"), x["r"].alias("recall"), f1(x["p"], x["r"]).alias("f1")))

    return let(F.struct(ngrams(tokens, n).alias("a"), ngrams(truth, n).alias("b")), scored)


#: Stems of the words that a task met last.
_stem = lru_cache(50_000)(porter)


def rouge_tokens(text: str, stem: bool = True) -> list[str]:
    # words of more than 64 letters are not kept
    return [(_stem if len(t) <= 64 else porter)(t) if stem and len(t) > 3 else t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a row of the table is the bits of one number, whose zeros are where it grows (Hyyrö 2004)."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if met := at.get(y):
            both = row & met
            row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def _prf(hit: float, n: int, m: int) -> tuple[float, float, float]:
    p, r = hit / n if n else 0.0, hit / m if m else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def rouge_scores(answer: str, truth: str, stem: bool = True) -> dict[str, float]:
    a, b = rouge_tokens(answer, stem), rouge_tokens(truth, stem)
    out = {}
    for n in (1, 2):
        x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
        out |= dict(zip((f"rouge{n}_p", f"rouge{n}_r", f"rouge{n}_f1"), _prf(sum((x & y).values()), sum(x.values()), sum(y.values())), strict=True))
    out |= dict(zip(("rougeL_p", "rougeL_r", "rougeL_f1"), _prf(lcs(a, b), len(a), len(b)), strict=True))
    return out | {"score": (out["rouge1_f1"] + out["rouge2_f1"] + out["rougeL_f1"]) / 3}


_ROUGE = ("rouge1_p", "rouge1_r", "rouge1_f1", "rouge2_p", "rouge2_r", "rouge2_f1", "rougeL_p", "rougeL_r", "rougeL_f1", "score")


@F.pandas_udf(_doubles(_ROUGE))
def rouge(answer: pd.Series, truth: pd.Series) -> pd.DataFrame:
    """ROUGE-1, -2 and -L with stemming, and the mean of their F1."""
    return pd.DataFrame([rouge_scores(a or "", t or "") for a, t in zip(answer, truth, strict=True)], columns=list(_ROUGE))


_PUNCT = re.compile(r"([^\w\s.,']|(?<=\D)[.,](?=\s|$)|(?<=\d)[.,](?=\s|$)|[.,](?!\d))")


def bleu_tokens(text: str) -> list[str]:
    """Treebank-like tokens: punctuation apart, contractions split."""
    text = re.sub(r"(?i)('s|'re|'ve|'ll|'m|'d|n't)\b", r" \1", text)
    return _PUNCT.sub(r" \1 ", text).split()


def bleu_scores(answer: str, truth: str, epsilon: float = 0.1) -> dict[str, float]:
    a, b = bleu_tokens(answer), bleu_tokens(truth)
    fractions = []
    for n in range(1, 5):
        x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
        fractions.append((sum((x & y).values()), max(1, sum(x.values()))))
    if not fractions[0][0]:
        return {"bleu": 0.0, **{f"bleu_{n}": 0.0 for n in range(1, 5)}}
    brevity = 1.0 if len(a) > len(b) else math.exp(1 - len(b) / len(a))
    p = [(h or epsilon) / n for h, n in fractions]
    return {"bleu": brevity * math.exp(sum(map(math.log, p)) / 4), **{f"bleu_{n}": brevity * p[n - 1] for n in range(1, 5)}}


_BLEU = ("bleu", "bleu_1", "bleu_2", "bleu_3", "bleu_4")


@F.pandas_udf(_doubles(_BLEU))
def bleu(answer: pd.Series, truth: pd.Series) -> pd.DataFrame:
    """BLEU-4 with uniform weights and smoothed zero counts, and each order alone."""
    return pd.DataFrame([bleu_scores(a or "", t or "") for a, t in zip(answer, truth, strict=True)], columns=list(_BLEU))


def clean_list(items: Column) -> Column:
    """Stripped, non-empty, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def list_prf(truth: Column, found: Column) -> Column:
    """struct<precision, recall, f1> of two lists as sets; zeros where either is empty."""
    t, p = F.array_distinct(F.coalesce(truth, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))
    hit = F.size(F.array_intersect(t, p)).cast("double")
    precision, recall = ratio(hit, F.size(p)), ratio(hit, F.size(t))
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"))


def list_prf_if_known(truth: Column, found: Column) -> Column:
    """list_prf(), null for a row without a truth."""
    return F.when(F.size(F.coalesce(truth, F.array().cast("array<string>"))) > 0, list_prf(truth, found))


def list_batch(rows: DataFrame, skip: str = "empty") -> DataFrame:
    """n, precision, recall, f1: means over rows (truth, found). skip: `empty` leaves out empty truths, `null` nulls alone."""
    kept = rows.where(F.col("truth").isNotNull() & (F.size("truth") > 0)) if skip == "empty" else rows.where(F.col("truth").isNotNull())
    return kept.select(list_prf(F.col("truth"), F.col("found")).alias("m")).agg(F.count("*").alias("n"), *[F.coalesce(F.avg(f"m.{c}"), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


def sources(chunks: Column) -> Column:
    """Distinct sources of array<struct<source_id, file_path, file_id>>."""
    each = F.flatten(F.transform(chunks, lambda c: F.array(c["source_id"], c["file_path"], c["file_id"])))
    return clean_list(each)


def reciprocal_rank(truth: Column, found: Column) -> Column:
    """1 / place of the first relevant item, 0 if none."""
    hits = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(truth, x), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, 1.0 / F.array_min(hits)).otherwise(0.0)


def judge_reply(reply: Column) -> Column:
    """struct<pred, score> of a judge's reply: a JSON object, else `pred:` and `score:` in the text."""
    text = F.trim(F.coalesce(reply, F.lit("")))
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = F.from_json(found, "pred string, score string, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    number = F.coalesce(parsed["score"], F.lit("0")).try_cast("double").cast("int")
    good = (found != "") & parsed["_bad"].isNull() & number.isNotNull()
    yes = F.lower(F.regexp_extract(text, r'(?i)"?pred"?\s*:\s*"?\b(yes|no)\b"?', 1))
    digits = F.regexp_extract(text, r'(?i)"?score"?\s*:\s*(\d+)', 1)
    limit = lambda c: F.greatest(F.lit(0), F.least(F.lit(5), c))
    pred = F.when(good, F.when(F.lower(parsed["pred"]).isin("yes", "no"), F.lower(parsed["pred"])).otherwise("no")).otherwise(F.when(yes != "", yes).otherwise("no"))
    score = F.when(good, limit(number)).otherwise(F.when(digits != "", limit(F.substring(digits, 1, 6).cast("int"))).otherwise(0))
    return F.struct(pred.alias("pred"), score.alias("score"))


def judge_rationale(reply: Column) -> Column:
    return F.coalesce(F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "$.rationale"), F.lit(""))


def judge_status(answer: Column, truth: Column, reply: Column) -> Column:
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return F.when(blank(truth), "missing_ground_truth").when(blank(answer), "missing_answer").when(reply.isNull(), "no_reply").otherwise("ok")


#: Tokens of a block of the products of token vectors: a block has so many scores squared.
TOKEN_BLOCK = 1024


def _unit(lists: pa.Array) -> np.ndarray:
    """The vectors of one list as rows of length 1; zero vectors stay."""
    n = len(lists)
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def greedy_match(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Means of the best cosine that each row of a finds in b, and each of b in a: products of blocks, whose running maxima are all that is kept."""
    if not len(a) or not len(b):
        return 0.0, 0.0
    of_a, of_b = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
    for i in range(0, len(a), TOKEN_BLOCK):
        for j in range(0, len(b), TOKEN_BLOCK):
            block = a[i : i + TOKEN_BLOCK] @ b[j : j + TOKEN_BLOCK].T
            np.maximum(of_a[i : i + TOKEN_BLOCK], block.max(1), out=of_a[i : i + TOKEN_BLOCK])
            np.maximum(of_b[j : j + TOKEN_BLOCK], block.max(0), out=of_b[j : j + TOKEN_BLOCK])
    return float(of_a.mean()), float(of_b.mean())


@F.arrow_udf(_doubles(("precision", "recall")))
def _token_match(a: pa.Array, b: pa.Array) -> pa.Array:
    found = [greedy_match(_unit(x.values), _unit(y.values)) if x.is_valid and y.is_valid else (0.0, 0.0) for x, y in zip(a, b, strict=True)]
    return pa.array([{"precision": p, "recall": r} for p, r in found], pa.struct([("precision", pa.float64()), ("recall", pa.float64())]))


def token_similarity(answer: Column, truth: Column) -> Column:
    """struct<precision, recall, f1> by greedy cosine of token vectors (array<array<double>>); zeros where a side has none."""
    return let(_token_match(answer, truth), lambda m: F.struct(m["precision"].alias("precision"), m["recall"].alias("recall"), f1(m["precision"], m["recall"]).alias("f1")))


def bert_score(pairs: DataFrame) -> DataFrame:
    """pair_id, precision, recall, f1 by greedy cosine of token vectors: pairs has pair_id, a (array<array<double>>), b."""
    vectors = lambda c: F.col(c).cast("array<array<double>>")
    return pairs.select("pair_id", token_similarity(vectors("a"), vectors("b")).alias("m")).select("pair_id", "m.*")


def semantic_similarity(answer: Column, truth: Column) -> Column:
    """Cosine of two embeddings; 0 where one is missing or zero."""
    return F.coalesce(vector_score(answer, truth), F.lit(0.0))


# Metric sets by mode, and each metric as an expression of its columns.
METRIC_SETS = {
    "simple": ("exact_match", "covered_exact_match"),
    "lexical": ("exact_match", "covered_exact_match", "rouge", "bleu"),
    "semantic": ("semantic_similarity", "bert_score"),
    "llm": ("llm_judge",),
    "all": ("exact_match", "covered_exact_match", "rouge", "bleu", "semantic_similarity", "bert_score", "retrieval", "file_list", "llm_judge"),
}
REGISTRY = {
    "exact_match": lambda r: exact_match(r["answer"], r["truth"]),
    "covered_exact_match": lambda r: covered_match(r["answer"], r["truth"]),
    "rouge": lambda r: rouge(r["answer"], r["truth"])["score"],
    "bleu": lambda r: bleu(r["answer"], r["truth"])["bleu"],
    "semantic_similarity": lambda r: semantic_similarity(r["answer_vector"], r["truth_vector"]),
    "bert_score": lambda r: token_similarity(r["answer_tokens"], r["truth_tokens"])["f1"],
    "retrieval": lambda r: list_prf(r["expected"], r["found"])["f1"],
    "file_list": lambda r: list_prf(r["expected"], r["found"])["f1"],
    "llm_judge": lambda r: judge_reply(r["reply"])["score"].cast("double"),
}
_NEEDS = {
    "semantic_similarity": ("answer_vector", "truth_vector"),
    "bert_score": ("answer_tokens", "truth_tokens"),
    "retrieval": ("expected", "found"),
    "file_list": ("expected", "found"),
    "llm_judge": ("reply",),
}
#: What a metric's row lacks, by its columns; a vector pair may also differ in length.
_LACKS = {"truth": "missing_ground_truth", "answer": "missing_answer", "reply": "no_reply", "expected": "missing_ground_truth", "found": "missing_answer"}
JUDGED = ("llm_judge",)


def _failure(rows: DataFrame, metric: str) -> Column:
    """The message of a row that the metric cannot score, null where it can."""
    out = F.lit(None).cast("string")
    needs = _NEEDS.get(metric, ("answer", "truth"))
    if metric == "semantic_similarity":
        a, b = rows[needs[0]], rows[needs[1]]
        out = F.when(F.size(a) != F.size(b), F.concat(F.lit("vectors of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" numbers")))
    for c in reversed(needs):
        kind = dict(rows.dtypes)[c]
        blank = rows[c].isNull() if kind != "string" or metric in ("retrieval", "file_list") else F.coalesce(F.trim(rows[c]) == "", F.lit(True))
        out = F.when(blank, _LACKS.get(c, f"missing_{c}")).otherwise(out)
    return out


def evaluate(rows: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """rows with a map<string, double> of scores, and `errors`, a map<string, string>: a metric that fails for a row scores 0 there and says why.

    Metrics that are unknown or lack their columns are skipped. All metrics are expressions of one projection, so rows are read once."""
    known = [m for m in metrics if m in REGISTRY and set(_NEEDS.get(m, ("answer", "truth"))) <= set(rows.columns)]
    if not known:
        return rows.select("*", F.lit(None).cast("map<string,double>").alias("scores"), F.lit(None).cast("map<string,string>").alias("errors"))
    failed = rows.select("*", *[_failure(rows, m).alias(f"__e_{m}") for m in known])
    # a metric is computed where it does not fail; try_* would hide what the message says
    scored = failed.select("*", *[F.when(F.col(f"__e_{m}").isNull(), REGISTRY[m](failed)).otherwise(0.0).alias(f"__{m}") for m in known])
    scores = F.create_map(*[x for m in known for x in (F.lit(m), F.coalesce(F.col(f"__{m}"), F.lit(0.0)))])
    errors = F.map_filter(F.create_map(*[x for m in known for x in (F.lit(m), F.col(f"__e_{m}"))]), lambda _, e: e.isNotNull())
    return scored.select(*rows.columns, scores.alias("scores"), errors.alias("errors"))


def structured(evaluated: DataFrame) -> DataFrame:
    """evaluated with its scores parted: `judge` (score and passed, of the judge's reply) and `simple_metrics`, the others; null where there are none."""
    simple = F.map_filter("scores", lambda k, _: ~k.isin(*JUDGED))
    judge = F.when(F.map_contains_key("scores", JUDGED[0]), F.struct(F.col("scores")[JUDGED[0]].alias("score"), (judge_reply(F.col("reply"))["pred"] == "yes").alias("passed"), F.col("errors")[JUDGED[0]].alias("error"))) if "reply" in evaluated.columns else F.lit(None)
    return evaluated.withColumn("judge", judge).withColumn("simple_metrics", F.when(F.size(simple) > 0, simple)).drop("scores")


def evaluate_to(rows: DataFrame, metrics: tuple[str, ...], path: str) -> dict:
    """Write structured evaluations of rows as JSON and give their summary: of each metric the number of rows, mean, least, greatest and failures.

    The summary is observed while the rows are written, so they are read once."""
    known = [m for m in metrics if m in REGISTRY and set(_NEEDS.get(m, ("answer", "truth"))) <= set(rows.columns)]
    observed = Observation("evaluation")
    score = lambda m: F.col("scores")[m]
    parts = [F.count(F.lit(1)).alias("n")]
    for m in known:
        parts += [F.avg(score(m)).alias(f"{m}_mean"), F.min(score(m)).alias(f"{m}_min"), F.max(score(m)).alias(f"{m}_max"), F.count_if(F.map_contains_key("errors", m)).alias(f"{m}_failed")]
    structured(evaluate(rows, metrics).observe(observed, *parts)).write.mode("overwrite").json(path)
    told = observed.get
    return {"n": told["n"], "metrics": {m: {k: told[f"{m}_{k}"] for k in ("mean", "min", "max", "failed")} for m in known}}


def evaluate_file(spark: SparkSession, source: str, schema: str, metrics: tuple[str, ...], path: str) -> dict:
    """evaluate_to() of a result file: a JSON list, an object with `results` or `data`, or a line for each."""
    from heliodor.sources import results

    return evaluate_to(results(spark, source, schema), metrics, path)
