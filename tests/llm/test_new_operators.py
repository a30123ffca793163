"""Operators 11, 12 and 13 against brute force and the library."""

import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest

pytest.importorskip("heliodor.llm")
P = pytest.importorskip("public_tokenizers")
from heliodor.llm import audit, manifest, pieces  # noqa: E402
from tests.llm.helpers import HARD, saved  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("place", "group", "members", "digest", "path", "step", "parent", "part", "same", "a", "e", "f", "n", "good", "first", "block", "ids", "bucket")


def rows_of(seed=5, n=90):
    rnd = random.Random(seed)
    words = [rnd.choice(["lorem", "Ipsum", "DOLOR", "x#y", "é", "amet", "10%"]) + str(rnd.randrange(300)) for _ in range(400)]
    rows = [(i, t, lang, "web", len(t or "")) for i, t, lang in HARD]
    for i in range(20, 20 + n):
        text = rnd.choice([" ", "\n"]).join(rnd.choice(words[: rnd.choice([20, 400])]) for _ in range(rnd.randrange(320)))
        rows.append((i, rnd.choice([text, text, text.lower(), rows[rnd.randrange(len(rows))][1]]), rnd.choice(["en", "en", "de", "", None]), rnd.choice(["a", None]), rnd.choice([None, 7])))
    return rows + [(None, rows[-1][1], "en", None, 1), (None, None, None, None, None), (25, "again", "en", "s", 3), (25, rows[30][1], "en", "s", 3), (25, "again", "en", "s", 3)]


def clashing(spark, rows):
    names = ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], f"{SCHEMA}, {names}")


# Operator 11


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """The root over nodes, and for each node its path: (left, right) siblings of each level."""
    paths, own, width = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(width) > 1:
        runs = [width[i : i + 2] for i in range(0, len(width), 2)]
        for k, at in enumerate(own):
            run = runs[at // 2]
            paths[k].append(("".join(run[: at % 2]), "".join(run[at % 2 + 1 :])))
            own[k] = at // 2
        width = [h(*run) for run in runs]
    return width[0], paths


def plain_manifest(rows):
    def leaf(row, more=0):
        doc, text, lang, source, n = row
        values = [doc, source, lang, n + more if n is not None else None, text]
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = plain_tree([leaf(r) for r in groups[g]])
    root, above = plain_tree([trees[g][0] for g in order]) if rows else (None, [])
    out = []
    for g, up in zip(order, above, strict=True):
        for row, path in zip(groups[g], trees[g][1], strict=True):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = leaf(row, int(tampered))
            for left, right in path + up:
                folded = h(left, folded, right)
            proof = h(*(left + right for left, right in path + up))
            out.append((row[0], leaf(row), trees[g][0], root, proof, folded, folded == root))
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 90])
def test_manifest(spark, tmp_path, n):
    rows = rows_of(n=90)[-n:] if n else []
    got = manifest.op11_merkle_manifest(spark, saved(spark, tmp_path, documents=clashing(spark, rows).repartition(3)))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_manifest(rows)))


def test_manifest_finds_any_change(spark):
    rows = rows_of()
    whole = manifest.manifest(spark.createDataFrame(rows, SCHEMA)).first().root
    for k, other in ((3, (3, "One", "en", "web", 3)), (20, (*rows[20][:3], "-", rows[20][4]))):
        assert manifest.manifest(spark.createDataFrame([*rows[:k], other, *rows[k + 1 :]], SCHEMA)).first().root != whole
    assert manifest.manifest(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).first().root == whole


def test_ranks_of_one_group_and_equal_rows(spark):
    from heliodor.llm.common import table

    rows = table(spark.range(500).selectExpr("'g' AS g", "if(id < 300, 7, id) AS v").repartition(7), "test-ranks")
    got = manifest.ranked(rows, ["g"], ["v"]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(500)) and {r.members for r in got} == {500}
    assert [r.v for r in got] == sorted(r.v for r in got)


# Operator 12


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for doc, text, *_ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    parts = {}
    for doc, text, lang, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        flags = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc is not None and doc > least[text],
        }
        parts.setdefault(lang or "", []).append(({k for k, v in flags.items() if v}, doc in good, doc in toxic))
    out, shapley = {}, {}
    for part, docs in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                failing = sum(f in d[0] for d in docs)
                out[part, order, step] = (len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark, tmp_path):
    rows = rows_of()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 110, 3)] + [(30, None, None), (30, 1, None), (None, 1, 1), (5000, 1, 1)]
    path = saved(spark, tmp_path, documents=clashing(spark, rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = audit.op12_filter_audit(spark, path)
    assert dict(got.dtypes)["step"] == "int" and {k for c, k in got.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in names) for r in got.collect()} == plain_audit(rows, labels)


def test_audit_of_nothing_and_of_copies(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = saved(spark, tmp_path / "none", documents=spark.createDataFrame([], SCHEMA), labels=labels)
    assert audit.op12_filter_audit(spark, none).count() == 0
    copies = [(i, "same text", "en", None, None) for i in range(50)]
    got = audit.op12_filter_audit(spark, saved(spark, tmp_path / "copies", documents=spark.createDataFrame(copies, SCHEMA), labels=labels)).where("filter_order = 'EABCD'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.redundant) for r in got] == [(1, 49, 0), (0, 1, 49), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


# Operator 13


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def odd_texts():
    rnd = random.Random(4)
    signs = [" '\n\tstremdlvx1. é▁", "abeth ", "eth  ", "日本🎉 a", "\x00 é́"]
    fixed = [t or "" for _, t, _ in HARD] + [" ", "   ", " a", "a  b ", "▁x▁▁ y", "日本語 テキスト😀", "<s>x</s><0x41><unk>", " " * 100 + "x" + " " * 37, "th" * 4000, "x" * 65, "é" * 64]
    return fixed + ["".join(rnd.choice(rnd.choice(signs)) for _ in range(rnd.randrange(120))) for _ in range(800)]


def test_pieces_are_the_librarys(library):
    own, texts = pieces.model(P.path("piece_bpe_32k.model")), odd_texts()
    chunks, sizes = pieces.chunks_of(pa.array(texts))
    chunks = chunks.to_pylist()
    flat, begin = own.segment_all(chunks), 0
    assert flat == [own.segment(c.decode().replace(" ", pieces.MARKER)) for c in chunks]
    for text, n in zip(texts, sizes.tolist(), strict=True):
        ids = [i for k in flat[begin : begin + n] for i in k]
        begin += n
        assert ids == library.encode(text) and own.decode(ids) == library.decode(ids), text[:80]


def test_pieces_query(spark, tmp_path, library, monkeypatch):
    texts = [*odd_texts()[:120], None, "a" * 300_000, "word " * 100_000, ("Müller " * 9 + "\n") * 20_000]
    rows = [(None if i % 40 == 3 else i - i % 2, t, None, None, None) for i, t in enumerate(texts)]
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 3000)
    path = saved(spark, tmp_path, documents=clashing(spark, rows).repartition(3))
    got = pieces.op13_sentencepiece(spark, path)
    want = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "")
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    kept = pieces.encode_documents(spark.read.parquet(f"{path}/documents.parquet"), P.path("piece_bpe_32k.model"), keep_ids=True)
    assert sorted(r.ids for r in kept.collect()) == sorted(library.encode(t or "") for t in texts)
    assert pieces.op13_sentencepiece(spark, saved(spark, tmp_path / "none", documents=spark.createDataFrame([], SCHEMA))).count() == 0


def test_pieces_of_rows_that_change_are_an_error(spark):
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    moving = texts.selectExpr("doc_id", "concat(text, ' ', uuid()) AS text")
    with pytest.raises(Exception, match="other rows|IndexError|KeyError"):
        pieces.encode_documents(moving.selectExpr("doc_id", "concat(text, cast(reflect('java.lang.System', 'nanoTime') AS string)) AS text"), P.path("piece_bpe_32k.model")).collect()
