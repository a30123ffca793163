"""Chunks that know their place, and the segments they reach into."""

import random
import re

import pytest
from pyspark.sql import functions as F

from heliodor.operators import chunking


def text_of(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(rnd.randrange(1, 25))) + rnd.choice([".", "! ", "?\n", "。"])
    kinds = {
        "para": lambda: " ".join(sentence() for _ in range(rnd.randrange(1, 12))),
        "head": lambda: "#" * rnd.randrange(1, 4) + " " + word(),
        "list": lambda: "\n".join(f"{rnd.choice(['-', '*', '1.'])} {word()}" for _ in range(rnd.randrange(1, 9))),
        "code": lambda: "```\n" + "\n\n".join(word() for _ in range(rnd.randrange(1, 80))) + "\n```",
        "table": lambda: "\n".join(f"| {word()} | {word()} |" for _ in range(rnd.randrange(1, 60))),
        "long": lambda: word() * rnd.randrange(1, 400),
    }
    return rnd.choice(["", "  \n"]) + rnd.choice(["\n\n", "\n \n\n"]).join(kinds[rnd.choice(list(kinds))]() for _ in range(rnd.randrange(1, 14))) + rnd.choice(["", "\n\n"])


@pytest.mark.parametrize("spans, options", [(chunking.semantic_spans, {}), (chunking.semantic_spans, {"max_chars": 120, "min_chars": 40}), (chunking.semantic_spans, {"max_chars": 300, "token_limit": 60}), (chunking.recursive_spans, {"max_chars": 90}), (chunking.recursive_spans, {})])
def test_spans_cover_the_text_in_order(spans, options):
    for seed in range(60):
        text = text_of(seed)
        found = spans(text, **options)
        assert all(0 <= a < b <= len(text) and text[a:b] == text[a:b].strip() for a, b in found)
        assert all(b <= c for (_, b), (c, _) in zip(found, found[1:], strict=False))
        assert re.sub(r"\s", "", "".join(text[a:b] for a, b in found)) == re.sub(r"\s", "", text)
        assert all(b - a <= options.get("max_chars", 1000) for a, b in found)
        if limit := options.get("token_limit"):
            assert all(chunking.estimate(text[a:b]) <= limit for a, b in found)
    assert spans("") == [] and spans(" \n ") == []


def test_overlap_reaches_back():
    text = "\n\n".join(f"Sentence number {i} is here. Another one {i} follows it." for i in range(40))
    plain, lapped = (chunking.semantic_spans(text, 300, 100, n) for n in (0, 60))
    assert len(lapped) >= len(plain) and all(c < b and text[c] in "AS" for (_, b), (c, _) in zip(lapped, lapped[1:], strict=False))
    back = chunking.recursive_spans(text, 300, 1, 25)
    assert all(c == b - 25 for (_, b), (c, _) in zip(back, back[1:], strict=False))


def test_small_blocks_join_and_large_ones_part():
    text = "# one\n\ntiny\n\n# two\n\n" + "words here. " * 60 + "\n\nend"
    found = chunking.semantic_split(text, 400, 100)
    assert found[0] == "# one\n\ntiny" and all(len(c) <= 400 for c in found) and found[-1].endswith("end")
    assert chunking.semantic_spans("- a\n\n- b\n\nplain", 9, 1) == [(0, 8), (10, 15)]
    assert [k for k, _, _ in chunking.block_spans("x\n| a | b |\n|---|---|\ny\n\n```\nz\n```\n", 0, 39)] == ["text", "table", "text", "code"]


@pytest.mark.parametrize("bin_size", [7, 4096])
def test_interval_join(spark, bin_size):
    rnd = random.Random(4)
    segments, chunks = [], []
    for f in range(4):
        at = 0
        for i in range(30):
            size = rnd.choice([0, 1, 5, 40])
            segments.append((f, i, at, at + size, i // 3 if f else None, float(i) if i % 2 else None, None))
            at += size + 1
        chunks += [(f, k, a, min(a + rnd.randrange(0, 60), at)) for k, a in enumerate(range(0, at, 13))]
    got = chunking.with_provenance(spark.createDataFrame(chunks, "file_id long, chunk_index long, start long, end long"), spark.createDataFrame(segments, "file_id long, seg_idx long, start long, end long, page long, start_time double, end_time double"), bin_size)
    for r in got.collect():
        met = [s for s in segments if s[0] == r.file_id and s[2] < s[3] and r.start < r.end and s[2] < r.end and r.start < s[3]]
        if not met:
            assert r.page_numbers is None
        else:
            assert r.page_numbers == sorted({s[4] for s in met if s[4] is not None})
            assert [t.start for t in r.time_ranges] == [s[5] for s in met if s[5] is not None]


def test_files_and_long_segments(spark):
    segments = spark.createDataFrame([(1, 0, " head "), (1, 1, None), (1, 2, "tail"), (2, 0, "word. " * 80)], "file_id long, seg_idx int, text string")
    got = {(r.file_id, r.chunk_index): r for r in chunking.file_chunks(segments, 200).collect()}
    assert got[1, 0].content == "head\n\ntail" and got[1, 0].end == 10 and len([k for k in got if k[0] == 2]) >= 3
    assert chunking.file_chunks(segments).count() == 2
    typed = segments.withColumn("file_type", F.lit("txt")).withColumn("summary", F.lit(None).cast("string"))
    routed = chunking.route(typed, {"txt": {"method": "segment", "max_chars": 200}}).collect()
    assert {r.method for r in routed if r.file_id == 2} == {"recursive"} and all(len(r.content) <= 200 for r in routed)
    assert [r.content.strip() for r in sorted(routed, key=lambda r: r.chunk_index) if r.file_id == 1] == ["head", "tail"]
    placed = {r.seg_idx: (r.start, r.end) for r in chunking.placed_segments(segments.where("file_id = 1")).collect()}
    assert placed == {0: (0, 6), 1: (7, 7), 2: (8, 12)}
