"""Words whose polynomial hashes modulo 2**64 are equal, and rows that repeat a doc_id with another text."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("heliodor.llm")
P = pytest.importorskip("public_tokenizers")
from heliodor.llm import bpe, neardup, substring, suffix, tokenfile  # noqa: E402
from heliodor.llm.common import text_buffer  # noqa: E402
from tests.llm.helpers import by_id, frame, saved  # noqa: E402
from tests.llm.test_substrings import brute_bytes, brute_words  # noqa: E402


def twins(n):
    """A Thue-Morse word over two letters, and its complement."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module", params=[1024, 2048, 4096])
def pair(request):
    return twins(request.param)


def test_byte_bpe(pair):
    import tiktoken

    ranks = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.encoder(ranks, P.PATTERN).ranks, special_tokens={})
    coder = bpe.encoder(ranks, P.PATTERN)
    flat, cuts = coder.encode(*text_buffer(pa.array(list(pair))))
    for text, a, b in zip(pair, cuts[:-1], cuts[1:], strict=True):
        assert flat[a:b].tolist() == library.encode_ordinary(text) and coder.decode(flat[a:b].tolist()) == text.encode()


def test_token_files(spark, tmp_path, pair):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = frame(spark, [(1, pair[0], None), (2, pair[1], None)])
    got = by_id(tokenfile.op1_token_files(spark, saved(spark, tmp_path, documents=docs)))
    for doc, text in zip((1, 2), pair, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert got[doc]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_near_duplicates(spark, pair):
    x, y = pair
    docs = frame(spark, [(1, f"{x} one two", None), (2, f"{y} one two", None), (3, f"{x} one two", None)])
    assert {d: r["component_id"] for d, r in by_id(neardup.near_duplicates(docs)).items()} == {1: 1, 2: 2, 3: 1}


def test_substrings(spark, pair):
    tail = " ".join(f"w{i}" for i in range(12))
    texts = {1: f"{pair[0]} {tail}", 2: f"{pair[1]} {tail}", 3: f"{pair[1]} {tail} end"}
    got = by_id(substring.remove_repeats(frame(spark, [(d, t, None) for d, t in texts.items()])))
    want = brute_words({d: t.encode() for d, t in texts.items()}, 13)
    assert {d: (g["n_words"], g["n_removed"], g["kept_sha256"]) for d, g in got.items()} == want and want[2][1] == 0 and want[3][1] == 13


def test_repeated_ids_with_other_texts(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    shared = word(300)
    texts = [(1, word(900) + shared), (1, "x" * 16), (2, word(50) + shared + word(9)), (1, word(3) + shared), (None, shared), (None, "y"), (2, None)]
    want = brute_bytes({k: (t or "").encode() for k, (_, t) in enumerate(texts)}, 200)
    kept = brute_bytes({k: t.encode() for k, (d, t) in enumerate(texts) if d is None}, 10**6)  # compared, but itself kept
    want |= kept
    got = suffix.remove_repeats(frame(spark, [(d, t, None) for d, t in texts]).repartition(3)).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(str((texts[k][0], *w)) for k, w in want.items())


def test_byte_rows_of_a_repeated_id(spark, tmp_path):
    path = saved(spark, tmp_path, documents=frame(spark, [(1, "one", None), (1, "two words", None), (None, "three", None)]))
    got = bpe.op5_byte_bpe(spark, path).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256(t).hexdigest() for t in (b"one", b"two words", b"three"))


def test_pairs_of_a_lower_rank_are_looked_up_where_there_are_some(tmp_path, monkeypatch):
    """Ranks in any order, against a plain version; each merge looks up one pair more only if its token can sink."""
    import base64
    import itertools

    rng = np.random.default_rng(3)
    tokens = [bytes([b]) for b in range(256)] + ["".join(t).encode() for n in (2, 3, 4) for t in itertools.product("abc", repeat=n)]
    for mixed in (True, False):
        order = tokens[:256] + ([tokens[256 + i] for i in rng.permutation(len(tokens) - 256)] if mixed else tokens[256:])
        path = tmp_path / f"{mixed}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(order)))
        coder = bpe.BytePairEncoder(str(path), P.PATTERN)

        def plain(word, ranks=coder.ranks):
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 1:
                rank, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
                if rank == 1 << 30:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            return [ranks[p] for p in parts]

        words = [bytes(rng.choice(list(b"abcd"), rng.integers(1, 40)).tolist()) for _ in range(400)]
        calls, look = [], bpe.BytePairEncoder.pair_rank
        monkeypatch.setattr(bpe.BytePairEncoder, "pair_rank", lambda self, a, b: calls.append(1) or look(self, a, b))
        ids, count = coder.encode_pieces(words)
        monkeypatch.undo()
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [plain(w) for w in words]
        if not mixed:
            assert len(calls) <= 120  # 349 when each merge looked up both neighbours
