"""Operators 4 and 9 against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("heliodor.llm")
from heliodor.llm import common, seeds, substring, suffix  # noqa: E402
from tests.llm.helpers import by_id, frame, saved  # noqa: E402


def brute_bytes(texts, length):
    count = {}
    for b in texts.values():
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = {}
    for doc, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def brute_words(texts, window):
    split = {d: t.split() for d, t in texts.items()}
    first = {}
    for doc in sorted(split):
        w = split[doc]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), doc)
    out = {}
    for doc, w in split.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out[doc] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 8))) for _ in range(200)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 200))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(base) for _ in range(rnd.randrange(3))] + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(60)))]
        text = list(rnd.choice([" ", "\n", "  "]).join(parts))
        for _ in range(rnd.randrange(6)):
            if text:
                text[rnd.randrange(len(text))] = rnd.choice("xyz ")
        rows.append((i, "".join(text), None))
    return rows + [(n, "", None), (n + 1, None, None), (n + 2, "q" * 900, None), (n + 3, "ab" * 300 + "c", None), (n + 4, "one two " * 60, None), (n + 5, "one two " * 60, None), (n + 6, base[0], None)]


def test_suffixes(spark, tmp_path):
    rows = corpus()
    got = by_id(suffix.op4_suffix_dedup(spark, saved(spark, tmp_path, documents=frame(spark, rows))))
    want = brute_bytes({d: (t or "").encode() for d, t, _ in rows}, 200)
    assert {d: (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) for d, g in got.items()} == want
    assert sum(w[1] for w in want.values()) > 5000


def test_suffixes_short(spark):
    rows = corpus(5, 80)
    got = by_id(suffix.remove_repeats(frame(spark, rows), 40, 12, keep_bytes=True))
    want = brute_bytes({d: (t or "").encode() for d, t, _ in rows}, 40)
    assert {d: (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) for d, g in got.items()} == want
    assert all(hashlib.sha256(g["kept"]).hexdigest() == g["kept_sha256"] for g in got.values())


@pytest.mark.parametrize("window, gram", [(13, 6), (5, 3), (4, 4)])
def test_words(spark, window, gram):
    rows = corpus(7)
    got = by_id(substring.remove_repeats(frame(spark, rows), window, gram, keep_text=True))
    want = brute_words({d: (t or "").encode() for d, t, _ in rows}, window)
    assert {d: (g["n_words"], g["n_removed"], g["kept_sha256"]) for d, g in got.items()} == want


def test_multikey_order():
    rnd = np.random.default_rng(1)
    rows = rnd.integers(0, 3, (500, 20), dtype=np.uint8)
    rows[100:200] = rows[0:100]
    order = suffix.multikey_order(rows)
    said = [bytes(rows[i]) for i in order]
    assert said == sorted(said) and sorted(order.tolist()) == list(range(500))


def test_anchors_are_of_the_window_alone():
    rnd = np.random.default_rng(2)
    grams = rnd.integers(0, 2**63, 4000, dtype=np.uint64)
    whole = seeds.anchors(grams, 9)
    assert (seeds.anchors(grams[1000:], 9) + 1000 == whole[1000:]).all()
    assert all(grams[a] >> 24 == min(grams[i : i + 9] >> np.uint64(24)) for i, a in enumerate(whole.tolist()))


def test_empty_and_repeated_rows(spark, tmp_path):
    none = saved(spark, tmp_path / "none", documents=frame(spark, []))
    assert suffix.op4_suffix_dedup(spark, none).count() == 0 and substring.op9_substring_dedup(spark, none).count() == 0
    text = " ".join(map(str, range(200)))
    twice = saved(spark, tmp_path / "twice", documents=frame(spark, [(1, text, None), (1, text, None), (None, text, None), (2, text, None)]))
    assert [r.n_removed for r in suffix.op4_suffix_dedup(spark, twice).where("doc_id IS NOT NULL").collect()] == [len(text)] * 3
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring.op9_substring_dedup(spark, twice).collect()) == [(0, 0), (1, 0), (1, 0), (2, 200)]


def test_strings_shared_with_a_row_without_an_id(spark):
    import random

    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    shared, twice = word(200), word(230)
    rows = [(1, word(300) + shared + word(300), None), (None, word(50) + shared + word(70), None), (None, twice + word(40), None), (None, word(95) + twice, None), (2, word(400), None)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix.remove_repeats(frame(spark, rows).repartition(2)).collect()}
    assert got[1, 800] == 200 and got[2, 400] == 0
    assert all(n == 0 for (doc, _), n in got.items() if doc is None) and len(got) == 5


def test_a_worker_hashes_a_bounded_part_of_a_batch(monkeypatch):
    """Blocks of 8 MB of text took some 400 MB of a worker."""

    class Given(Exception):
        pass

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            raise Given(run)

    with pytest.raises(Given) as got:
        substring.find_repeats(Docs())
    for table in ("_up", "_down"):
        monkeypatch.setattr(common.PartHashes, table, np.ones(1, np.uint64))
    text = " ".join(map(str, range(12_000)))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(240)), "text": pa.array([text] * 240)})
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in got.value.args[0]([batch])) > 240 * 1000
        assert tracemalloc.get_traced_memory()[1] < 150e6
    finally:
        tracemalloc.stop()
