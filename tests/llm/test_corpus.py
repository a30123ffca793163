"""Operators 1, 3 and 5 and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("heliodor.llm")
P = pytest.importorskip("public_tokenizers")
from heliodor.llm import bpe, langid, tokenfile  # noqa: E402
from heliodor.llm.common import Memo, text_buffer  # noqa: E402
from tests.llm.helpers import HARD, by_id, frame, saved  # noqa: E402
from tests.llm.test_native import plain_contamination, plain_spans  # noqa: E402
from tests.llm.test_neardup import brute  # noqa: E402

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.encoder(RANKS, P.PATTERN).ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(11)
    fixed = [t or "" for _, t, _ in HARD] + ["'s", "'", "'l", "'re'll \n's '", "''s", "'s's abc'dx 've've", "  's x   ", "th" * 3000, "日本語テキスト" * 50, " " * 500, "\n\n\n  x"]
    signs = [rnd.choice([" '\n\tstremdlvx1. é", "abeth ", "eth"]) for _ in range(800)]
    return fixed + ["".join(rnd.choice(s) for _ in range(rnd.randrange(60))) for s in signs] + ["".join(rnd.choice("eth") for _ in range(20000))]


def test_bpe_is_tiktoken(reference):
    texts = odd_texts()
    coder = bpe.encoder(RANKS, P.PATTERN)
    flat, cuts = coder.encode(*text_buffer(pa.array(texts, pa.string())))
    for t, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True):
        ids = flat[a:b]
        assert ids.tolist() == reference.encode_ordinary(t), t[:80]
        assert coder.decode(ids.tolist()) == t.encode()


def test_bpe_forgets_alike(reference, monkeypatch):
    coder = bpe.encoder(RANKS, P.PATTERN)
    monkeypatch.setattr(coder, "memo", Memo(2, 5))
    for text in ["alpha beta gamma delta", "epsilon zeta eta theta iota", "alpha beta kappa alpha beta"]:
        assert coder.encode(*text_buffer(pa.array([text])))[0].tolist() == reference.encode_ordinary(text)


def test_bpe_query(spark, tmp_path, reference):
    docs = frame(spark)
    got = by_id(bpe.op5_byte_bpe(spark, saved(spark, tmp_path, documents=docs)))
    for row in docs.collect():
        ids = reference.encode_ordinary(row.text or "")
        mine = got[row.doc_id]
        assert mine["n_tokens"] == len(ids) and mine["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256((row.text or "").encode()).hexdigest()


def test_rank_queue():
    queue = bpe.RankQueue(50256)
    rnd = random.Random(2)
    pushed = [rnd.randrange(50256) for _ in range(500)]
    for i, r in enumerate(pushed):
        queue.push(r, np.array([i]))
    seen = []
    while (x := queue.pop()) is not None:
        seen += [x[0]] * len(x[1])
    assert seen == sorted(pushed)


def test_blocks_round_trip():
    rnd = np.random.default_rng(1)
    blocks = [rnd.integers(0, 65536, 50), np.zeros(300, int), rnd.integers(0, 5, 4096), np.array([65535] * 3 + [0]), rnd.integers(40000, 49408, 700), np.array([7]), np.tile(np.arange(20), 30)]
    coded = tokenfile.encode_blocks(blocks)
    back = tokenfile.decode_blocks(coded, [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
    assert len(coded[1]) < 30 and len(coded[6]) < 300
    alone = tokenfile.decode_blocks([coded[2]], [4096])
    assert (alone[0] == blocks[2]).all() and tokenfile.encode_blocks([blocks[2]])[0] == coded[2]
    assert tokenfile.encode_blocks([]) == []


def test_no_few_segments_are_coded_alone():
    for n in range(70):
        held = list(tokenfile.lockstep(iter([10] * n), 80, int))
        assert sum(held, []) == [10] * n and all(sum(h) <= 80 for h in held)
        assert len(held) < 2 or min(map(sum, held)) >= 40
    assert list(tokenfile.lockstep([500, 1, 90], 80, int)) == [[500], [1, 90]]


@pytest.mark.parametrize("most", [1, 3, 7])
def test_files_of_many_lockstep_groups(spark, tmp_path, most, monkeypatch):
    docs = frame(spark)
    want = by_id(tokenfile.op1_token_files(spark, saved(spark, tmp_path, documents=docs)))
    monkeypatch.setattr(tokenfile, "SEGMENT", 100)
    monkeypatch.setattr(tokenfile, "LOCKSTEP", 100 * most)
    assert by_id(tokenfile.op1_token_files(spark, str(tmp_path))) == want


def test_carries_are_settled():
    writer = tokenfile._Writer(3, 8)
    words = writer.words.reshape(3, -1)
    words[0, :4], words[1, :4], words[2, :4] = [1, 65535, 65535, 65537], [2, 65536, 7, 9], [1, 2, 3, 4]
    writer.at += 4
    got = [w.tolist()[:4] for w in writer.close()]
    assert got == [[2, 0, 0, 1], [3, 0, 7, 9], [1, 2, 3, 4]]


def test_checksum_guards_a_block():
    data = tokenfile.pack_segments([([1, None], np.array([2, 3]), np.array([5, 6, 7, 8, 9]))])[0]
    ids, n, tokens = tokenfile.unpack_segments([data])[0]
    assert ids == [1, None] and n.tolist() == [2, 3] and tokens.tolist() == [5, 6, 7, 8, 9]
    with pytest.raises(ValueError, match="checksum"):
        tokenfile.unpack_segments([data[:-8] + bytes([data[-8] ^ 255]) + data[-7:]])
    far = np.array([70000, tokenfile.MOST_ID, 0, 65535, 65536, 70000])
    assert tokenfile.unpack_segments(tokenfile.pack_segments([([1], np.array([6]), far)]))[0][2].tolist() == far.tolist()
    with pytest.raises(ValueError, match=str(tokenfile.MOST_ID)):
        tokenfile.pack_segments([([1], np.array([1]), np.array([tokenfile.MOST_ID + 1]))])


@pytest.mark.parametrize("segment", [1 << 20, 700])
def test_token_files(spark, tmp_path, tiny, segment, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    monkeypatch.setattr(tokenfile, "SEGMENT", segment)
    docs = frame(spark, [*HARD, (50, "<|endoftext|> it's A B c \x1cx\x85y é ΑΣ", None)])
    got = by_id(tokenfile.op1_token_files(spark, saved(spark, tmp_path, documents=docs)))
    start = 0
    for row in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2]
        assert got[row.doc_id] == {"doc_id": row.doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)


def test_language(spark, tmp_path):
    got = by_id(langid.op3_language_id(spark, "/root/testdata/sf0.01"))
    rows = by_id(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for doc, g in got.items():
        assert g["held_out"] == (zlib.crc32(str(doc).encode()) % 5 == 0) and 0 <= g["score"] <= 1
    held = [d for d in got if got[d]["held_out"]]
    assert sum(got[d]["lang_pred"] == rows[d]["lang"] for d in held) >= 0.95 * len(held)
    wrong = [d for d in held if got[d]["lang_pred"] != rows[d]["lang"]]
    assert sum(got[d]["rejected"] for d in held) <= 0.03 * len(held) and sum(got[d]["rejected"] for d in wrong) >= 0.3 * len(wrong)


def test_language_odd(spark, tmp_path):
    docs = frame(spark, [(0, None, "en"), (1, "12 34 !", "en"), (2, "", None), (3, "the house and the garden", "en"), (4, "das Haus und der Garten", "de"), (6, "das Haus und der Garten", None)])
    got = by_id(langid.op3_language_id(spark, saved(spark, tmp_path / "a", documents=docs)))
    assert [got[d]["lang_pred"] for d in (0, 1, 2)] == ["und"] * 3 and got[6]["lang_pred"] == "de" and got[0]["rejected"]
    none = langid.op3_language_id(spark, saved(spark, tmp_path / "b", documents=frame(spark, [(1, "text here", None)])))
    assert none.first().lang_pred == "und"


def test_language_of_long_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text IS NOT NULL")
    parts = docs.where(langid.held_out(docs.doc_id)).select("lang", "text").collect()
    rows = []
    for i, lang in enumerate(sorted({r.lang for r in parts if r.lang})):
        text = "\n".join(r.text for r in parts if r.lang == lang)
        text *= -(-2_000_000 // len(text))
        rows += [(2 * i, text[:30_000], lang), (2 * i + 1, text[:2_000_000], lang)]
    got = by_id(langid.predict(frame(spark, rows).repartition(2), langid.fit(docs)))
    assert len(rows) == 8
    assert all(got[d]["lang_pred"] == lang and not got[d]["rejected"] for d, _, lang in rows)
    assert all(got[d + 1]["score"] > 0.5 * got[d]["score"] for d in range(0, 8, 2))


def test_empty(spark, tmp_path):
    path = saved(spark, tmp_path, documents=frame(spark, []))
    assert [f(spark, path).count() for f in (tokenfile.op1_token_files, langid.op3_language_id, bpe.op5_byte_bpe)] == [0, 0, 0]


def test_pipeline(spark, tmp_path, reference):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]
    judged = by_id(langid.op3_language_id(spark, source))
    rows = {r.doc_id: r.text for r in docs.collect() if not judged[r.doc_id]["rejected"]}
    rows = {d: rows[d] for d, (_, _, kept) in brute(rows, words=corpus_pipeline.SHINGLE_WORDS).items() if kept}
    rows = {d: rows[d] for d, x in plain_contamination(rows.items(), items).items() if not x[1]}
    want = {}
    for doc, text in rows.items():
        spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in plain_spans(text)))
        out, at = "", 0
        for a, b, kind in spans:
            if a >= at:
                out += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        want[doc] = reference.encode_ordinary(out + text[at:])
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, source).collect()}
    assert {d: i for d, i in got.items()} == want
    assert re.match("language", corpus_pipeline.STAGES[0][0])


def test_pipeline_judges_rows_without_an_id(spark, tmp_path):
    import corpus_pipeline

    item = "a passage of the benchmark that holds more than ten words in a row"
    path = saved(spark, tmp_path, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    texts = [(None, "write to a.b@c.org now"), (None, f"before {item} after"), (None, "a text of its own kind"), (3, "a text of its own kind"), (5, "first words of five"), (5, "mail x@y.org for other words"), (5, f"again {item} again"), (5, "first words of five"), (7, "seven")]
    docs = frame(spark, [(d, t, len(t)) for d, t in texts], "doc_id long, text string, n_chars long")
    for k, stage in enumerate([corpus_pipeline.near_duplicates, corpus_pipeline.decontaminate, corpus_pipeline.personal_data]):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    left = [(None, "write to [EMAIL] now"), (3, "a text of its own kind"), (5, "first words of five"), (5, "mail [EMAIL] for other words"), (7, "seven")]
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in docs.collect()), key=str) == sorted(((d, t, len(t)) for d, t in left), key=str)


def test_pipeline_with_clashing_columns_and_no_rows(spark, tmp_path):
    import corpus_pipeline

    item = spark.createDataFrame([(1, "some words of a benchmark")], "item_id long, text string")
    labelled = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden are here", "en"), ("das Haus und der Garten sind hier", "de")] * 6)] + [(20, None, None), (21, "12 34", None)]
    names = ("score", "lang_pred", "rejected", "row", "kept", "contaminated", "spans", "base", "n_hit", "component_id")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    for k, rows in enumerate(([], labelled)):
        docs = spark.createDataFrame([(*r, "s", 1, *["x"] * len(names)) for r in rows], schema)
        path = saved(spark, tmp_path / str(k), documents=docs, benchmark=item)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}-{i}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{i}")
            assert i == 4 or docs.columns == columns
        assert docs.count() == (2 if rows else 0)
