"""Operator 6 against all pairs."""

import random

import numpy as np
import pytest

pytest.importorskip("heliodor.llm")
from heliodor.llm import neardup  # noqa: E402
from tests.llm.helpers import by_id, frame, saved  # noqa: E402


def brute(texts, words=2):
    sets = {}
    for doc, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[doc] = {tuple(w[i : i + words]) for i in range(max(len(w) - words, 0) + 1)} if w else set()
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def wide_brute(texts, width):
    sets = {}
    for doc, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[doc] = {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(ids := sorted(sets)):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def near_corpus(n=160, seed=1):
    rnd = random.Random(seed)
    words = [f"W{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randrange(1, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 1 + len(w) // 8)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(x.lower() if rnd.random() < 0.5 else x for x in w), None))
    return rows + [(n, "", None), (n + 1, None, None), (n + 2, " ", None), (n + 3, "one", None), (n + 4, "ONE", None)]


def test_components(spark, tmp_path, tiny):
    docs = frame(spark, near_corpus()).unionByName(spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "lang"))
    got = by_id(neardup.op6_near_duplicates(spark, saved(spark, tmp_path, documents=docs)))
    want = brute({r.doc_id: r.text for r in docs.collect()})
    assert {d: (g["n_shingles"], g["component_id"], g["kept"]) for d, g in got.items()} == want
    assert len({w[1] for w in want.values()}) < len(want) - 40


def test_blocks_lose_no_link(spark):
    rows = near_corpus(90, 4)
    docs = frame(spark, rows)
    family = spark.createDataFrame([(r[0], 0) for r in rows if r[1] and r[1].strip()], "node long, label long")
    for block in (10, 1000):
        label = {r.node: r.label for r in neardup.components(neardup.links(docs, family, block)).collect()}
        want = {d: c for d, (n, c, _) in brute({r[0]: r[1] for r in rows}).items() if n}
        assert {d: label.get(d, d) for d in want} == want


def test_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)], "a long, b long")
    label = {r.node: r.label for r in neardup.components(edges).collect()}
    assert all(label[i] == 0 for i in range(61)) and label[102] == 100


def test_minhash_miss_probability():
    p = 1 - (1 - (1 - 0.8**neardup.WIDTH) ** neardup.TUPLES) ** 2
    assert p < 3e-4
    assert len(np.unique(neardup._SEEDS)) == 2 * neardup.TUPLES * neardup.WIDTH


def test_empty_and_repeated(spark, tmp_path):
    assert neardup.op6_near_duplicates(spark, saved(spark, tmp_path / "n", documents=frame(spark, []))).count() == 0
    rows = [(1, "a b c d", None), (1, "a b c d", None), (None, "a b c d", None), (2, "A B C D", None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.op6_near_duplicates(spark, saved(spark, tmp_path / "r", documents=frame(spark, rows))).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, False)]


def test_pipeline_stage_takes_five_words(spark, tiny):
    import corpus_pipeline

    short = [(n, " ".join("abcdef"[:k]), None) for n, k in enumerate([1, 2, 3, 4, 5, 6, 4, 3, 2], 5000)]
    docs = frame(spark, near_corpus() + short).unionByName(spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "lang"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = wide_brute(texts, 5)
    got = by_id(neardup.near_duplicates(docs, 5))
    assert {d: (g["n_shingles"], g["component_id"], g["kept"]) for d, g in got.items()} == want
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, tiny).collect()}
    assert kept == {d for d, w in want.items() if w[2]}
    assert len(kept) > sum(w[2] for w in brute(texts).values()) + 5


def test_repeated_ids_keep_all_links(spark):
    a, b, c = ("alpha one two three four five", "beta six seven eight nine ten", "gamma p q r s t")
    rows = [(5, a, None), (5, b, None), (7, b, None), (3, c, None), (8, a + " x", None), (8, "", None), (9, a, None), (6, "other words", None), (6, "words of another", None), (None, a, None), (12, c, None)]
    for parts in (1, 3):
        got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows).repartition(parts)).collect()), key=str)
        want = [(5, 5, True), (5, 5, True), (7, 5, False), (3, 3, True), (8, 5, False), (8, 8, True), (9, 5, False), (6, 6, True), (6, 6, True), (None, None, False), (12, 3, False)]
        assert got == sorted(want, key=str)
