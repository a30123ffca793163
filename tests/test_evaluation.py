"""Evaluations with errors as values, token similarity in blocks, and records of either payload shape."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliodor.operators import metrics, records

SCHEMA = "query_id long, answer string, truth string, reply string, answer_vector array<double>, truth_vector array<double>"
ROWS = [
    (1, "The cat.", "cat", '{"pred": "yes", "score": 4, "rationale": "x"}', [1.0, 0.0], [1.0, 1.0]),
    (2, "a dog ran", "dog", None, [1.0], [1.0, 2.0]),
    (3, None, "cat", "pred: no, score: 2", None, [1.0, 0.0]),
    (4, "x", " ", "", [0.0, 0.0], [1.0, 0.0]),
]
ALL = ("exact_match", "covered_exact_match", "rouge", "bleu", "semantic_similarity", "llm_judge", "unknown", "bert_score")


def test_a_failing_metric_gives_zero_and_its_message(spark):
    got = {r.query_id: r for r in metrics.evaluate(spark.createDataFrame(ROWS, SCHEMA), ALL).collect()}
    assert got[1].errors == {} and got[1].scores["exact_match"] == 1.0 and abs(got[1].scores["semantic_similarity"] - 0.5**0.5) < 1e-9 and got[1].scores["llm_judge"] == 4.0
    assert got[2].errors == {"semantic_similarity": "vectors of 1 and 2 numbers", "llm_judge": "no_reply"} and got[2].scores["covered_exact_match"] == 1.0
    assert got[3].errors["rouge"] == "missing_answer" and got[3].errors["semantic_similarity"] == "missing_answer_vector" and got[3].scores["rouge"] == 0.0
    assert got[4].errors["exact_match"] == "missing_ground_truth" and "semantic_similarity" not in got[4].errors and got[4].scores["semantic_similarity"] == 0.0
    assert set(got[1].scores) == set(ALL) - {"unknown", "bert_score"}
    assert metrics.evaluate(spark.createDataFrame(ROWS, SCHEMA), ("unknown",)).first().scores is None


def test_judge_and_simple_metrics_apart(spark):
    got = {r.query_id: r for r in metrics.structured(metrics.evaluate(spark.createDataFrame(ROWS, SCHEMA), ALL)).collect()}
    assert got[1].judge.asDict() == {"score": 4.0, "passed": True, "error": None} and "llm_judge" not in got[1].simple_metrics
    assert got[2].judge.asDict() == {"score": 0.0, "passed": False, "error": "no_reply"} and got[3].judge.score == 2.0


def test_one_scan_and_its_summary(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    plan = metrics.evaluate(rows, ALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    told = metrics.evaluate_to(rows, ("exact_match", "llm_judge"), str(tmp_path / "out"))
    assert told == {"n": 4, "metrics": {"exact_match": {"mean": 0.25, "min": 0.0, "max": 1.0, "failed": 2}, "llm_judge": {"mean": 1.5, "min": 0.0, "max": 4.0, "failed": 2}}}
    assert spark.read.json(str(tmp_path / "out")).count() == 4


@pytest.mark.parametrize("shape", [lambda r: json.dumps(r), lambda r: json.dumps({"results": r}), lambda r: "\n".join(map(json.dumps, r))])
def test_result_files(spark, tmp_path, shape):
    (tmp_path / "in.json").write_text(shape([{"query_id": "a", "answer": "Cat", "truth": "the cat"}, {"query_id": "b", "answer": "dog", "truth": "cat"}]))
    told = metrics.evaluate_file(spark, str(tmp_path / "in.json"), "query_id string, answer string, truth string", ("exact_match",), str(tmp_path / "out"))
    assert told == {"n": 2, "metrics": {"exact_match": {"mean": 0.5, "min": 0.0, "max": 1.0, "failed": 0}}}


def test_token_similarity_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((130, 8)), rng.standard_normal((77, 8))
    a[3] = 0
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = unit(a) @ unit(b).T
    p, r = s.max(1).mean(), s.max(0).mean()
    monkeypatch.setattr(metrics, "TOKEN_BLOCK", 16)
    assert np.allclose(metrics.greedy_match(unit(a), unit(b)), (p, r))
    rows = [(1, a.tolist(), b.tolist()), (2, [], b.tolist()), (3, None, b.tolist())]
    got = {x.pair_id: x for x in metrics.bert_score(spark.createDataFrame(rows, "pair_id long, a array<array<double>>, b array<array<double>>")).collect()}
    assert abs(got[1].precision - p) < 1e-12 and abs(got[1].recall - r) < 1e-12 and abs(got[1].f1 - 2 * p * r / (p + r)) < 1e-12
    assert got[2][1:] == got[3][1:] == (0.0, 0.0, 0.0)


def test_many_tokens_in_bounded_memory():
    import resource

    x = np.random.default_rng(2).standard_normal((20_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    p, r = metrics.greedy_match(x, x[::-1])
    assert abs(p - 1) < 1e-9 and abs(r - 1) < 1e-9
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB; all scores at once would be 3.2 GB


def test_records_of_both_shapes(spark):
    nested = {"chunk": "hello", "metadata": {"file_info": {"file_id": "f1"}, "segment_info": {"page_numbers": [2, 3]}, "start": "00:01", "vendor": 1}, "vendor": {"k": 1}}
    flat = {"text": "flat", "file_name": "a.pdf", "path": "", "full_path": "x/a.pdf", "extension": ".pdf", "page_num": 3, "tags": [1, None]}
    payloads = [(1, 7, 0.5, 2, json.dumps(nested)), (1, 8, 0.9, 1, json.dumps(flat)), (1, 9, None, 3, "no json"), (1, 10, 0.1, 4, json.dumps(flat | {"metadata": {}, "kind": "image", "extension": None})), (2, 1, 0.1, 1, None)]
    hits = spark.createDataFrame(random.Random(1).sample(payloads, len(payloads)), "query_id long, id long, score double, rank int, payload string")
    got = {r.query_id: r for r in records.result_records(hits, spark.createDataFrame([(1,), (2,), (3,)], "query_id long")).collect()}
    one = [c.asDict(True) for c in got[1].retrieved_chunks]
    assert [(c["rank"], c["id"], c["content"], c["score"]) for c in one] == [(1, 8, "flat", 0.9), (2, 7, "hello", 0.5), (3, 9, "", 0.0), (4, 10, "flat", 0.1)]
    assert one[0]["metadata"]["file_info"] == {"file_id": "unknown", "file_path": "x/a.pdf", "file_name": "a.pdf", "file_type": "pdf"}
    assert one[0]["metadata"]["segment_info"]["page_numbers"] == [3] and one[0]["metadata"]["extra"] == {"tags": "[1,null]"}
    assert one[1]["metadata"]["extra"] == {"start": '"00:01"', "vendor": "1"} and one[1]["metadata"]["segment_info"]["page_numbers"] == [2, 3] and one[1]["metadata"]["chunk_meta"]["char_count"] == 5
    assert one[3]["metadata"]["file_info"]["file_type"] == "image" and one[3]["metadata"]["chunk_meta"]["type"] == "image"
    assert got[1].retrieved_file_list == ["x/a.pdf", "f1", "unknown"] and got[2].retrieved_file_list == ["unknown"] and got[3].retrieved_chunks == []


def test_long_common_subsequences():
    import time

    rng = random.Random(7)
    for _ in range(300):
        a, b = ([str(rng.randrange(6)) for _ in range(rng.randrange(80))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next_row(row, x, b)
        assert metrics.lcs(a, b) == metrics.lcs(b, a) == row[-1]
    a, b = ([str(rng.randrange(300)) for _ in range(6000)] for _ in range(2))
    begin = time.process_time()
    metrics.lcs(a, b)
    assert time.process_time() - begin < 1  # cell by cell, 36 million steps took over 2 s


def _next_row(row, x, b):
    out = [0]
    for j, y in enumerate(b, 1):
        out.append(row[j - 1] + 1 if x == y else max(row[j], out[-1]))
    return out
