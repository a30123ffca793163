"""Operators 2, 7, 8 and 10 against plain Python."""

import hashlib
import re

import pytest

pytest.importorskip("heliodor.llm")
from heliodor.llm import chat, decontam, fingerprint, pii  # noqa: E402
from tests.llm.helpers import by_id, frame, saved  # noqa: E402

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark, tmp_path, tiny):
    docs = frame(spark).unionByName(spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "lang"))
    got = by_id(pii.op8_personal_data(spark, saved(spark, tmp_path, documents=docs)))
    for row in docs.collect():
        want = plain_spans(row.text or "")
        mine = got[row.doc_id]
        assert mine["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (row.doc_id, want, mine)
        assert [mine[f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in want) for k in PLAIN]
        spans = mine["spans"].split(",") if mine["spans"] else []
        assert [s for s in spans if not s.startswith("id:")] == want


def test_bootstrap_finds_what_seeds_point_at(spark):
    rows = [(i, f"call my number +1 (212) 555-{1000 + i} now or write", None) for i in range(8)]
    rows += [(20, "call my card number 4111111111111111 fine"), (21, "nothing here 12 34")]
    rows += [(30 + i, f"account holder number: {4539578763621486 if i % 2 else 4485275742308327 + 0} end {i}") for i in range(2)]
    cards = ["4539578763621486", "4485275742308327", "4916338506082832", "4556015886206505", "4929896355493470", "4024007103939509"]
    rows = [(i, f"my account number: {c} thanks {i}") for i, c in enumerate(cards)] + [(90, "my account number: 4539578763621487 thanks"), (91, "plain text 4539578763621487 here")]
    out = by_id(pii.find(frame(spark, rows, "doc_id long, text string")))
    assert [s.kind for s in out[90]["all"]] == ["id"] and out[91]["all"] == []
    assert all([s.kind for s in out[i]["all"]] == ["card"] for i in range(len(cards)))
    masked = by_id(pii.mask(frame(spark, rows, "doc_id long, text string")))
    assert masked[90]["text"] == "my account number: [ID] thanks" and masked[91]["text"] == rows[-1][1] and masked[0]["text"] == "my account number: [CARD] thanks 0"


BLANK = " \t\n\x0b\f\r"


def plain_candidates(text):
    """(value, patterns, start, end) of a text's candidates, with the rules written plainly."""
    import math

    import regex

    token = pii.CANDIDATE.replace(r"[^\s0-9@]", f"[^{BLANK}0-9@]").replace(r"\S", f"[^{BLANK}]")
    out, at, last = [], 0, ""
    for m in regex.finditer(token, text):
        inner = m[0].lstrip(pii.BEFORE)
        value, start = inner.rstrip(pii.BEHIND), m.start() + len(m[0]) - len(inner)
        digits = len(regex.sub("[^0-9]", "", value))
        said = regex.findall(r"[\p{L}\p{N}]+", (last + text[at : m.start()]).lower()[-pii.CONTEXT :])
        shape = regex.sub(r"\p{L}+", "a", regex.sub("[0-9]+", "9", value))
        if digits >= pii.MIN_DIGITS or "@" in value:
            out.append((value, [f"{' '.join(said[-n:])}|{shape}|{math.ceil(math.sqrt(digits))}" for n in (1, 2) if len(said) >= n], start, start + len(value)))
        at, last = m.end(), m[0]
    return out


def plain_found(texts):
    """The spans that bootstrapping adds to each text."""
    each, scores = [], {}
    for i, text in enumerate(texts):
        base = [tuple(map(int, s.split(":")[1:])) for s in plain_spans(text)]
        for value, patterns, a, b in plain_candidates(text):
            seed = any(x < b and y > a for x, y in base)
            each.append((i, patterns, a, b, seed))
            for p in patterns:
                scores.setdefault(p, {})[value] = max(float(seed), scores.get(p, {}).get(value, 0.0))
    taken = {}
    while True:
        good = {p: sum(v.values()) / len(v) for p, v in scores.items() if sum(s >= pii.CONFIDENT for s in v.values()) >= pii.MIN_SEEDS and sum(v.values()) / len(v) >= pii.CONFIDENT}
        if len(good) == len(taken):
            break
        taken, best = good, {}
        for p, c in good.items():
            for value in scores[p]:
                best[value] = max(c, best.get(value, 0.0))
        for v in scores.values():
            for value in v:
                v[value] = max(v[value], best.get(value, 0.0))
    return [sorted({(a, b) for j, patterns, a, b, seed in each if j == i and not seed and set(patterns) & set(taken)}) for i in range(len(texts))]


def test_bootstrap_goes_on_from_what_it_found(spark):
    cards = ["4539578763621486", "4485275742308327", "4916338506082832", "4556015886206505", "4929896355493470", "4024007103939509"]
    codes = [f"K{7301 + 17 * i}-{i}" for i in range(4)]
    numbers = [f"{x[:4]} {x[4:8]} {x[8:12]} {x[12:]}" for x in cards]
    texts = [f"my account number: {c}, thanks" for c in cards] + [f"my account number: {8123456789012345 + i} ok" for i in range(3)]
    texts += [f"hello member code {8123456789012345 + i}." for i in range(3)] + [f"hello member code {c}" for c in cards[:3]] + ["member code 9123456789012345!"]
    texts += [f"paid with card {n} today" for n in numbers] + ["paid with card 1234 5678 9012 3456 today", "in the year 2019 or 2020", "mail bob@x-y.org, ann@z.org"]
    texts += [f"the order {c} came" for c in codes] + ["", "12", "@ @", "(4539578763621487)"]
    rows = frame(spark, [(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = by_id(pii.find(rows))
    want = plain_found(texts)
    assert [[(s.start, s.end) for s in got[i]["all"] if s.kind == "id"] for i in range(len(texts))] == want
    hop = texts.index("member code 9123456789012345!")  # no seed stands under its pattern but what the first round found
    assert want[hop] and want[texts.index("paid with card 1234 5678 9012 3456 today")] and not any(want[-4:])


def test_long_rows(spark):
    import time

    text = "id 12345 " * 200_000
    rows = frame(spark, [(1, text), (2, "call +1 (212) 555-0100 " * 3000)], "doc_id long, text string")
    begin = time.time()
    masked = by_id(pii.mask(rows))
    assert masked[1]["text"] == text and masked[2]["text"] == "call [PHONE] " * 3000
    assert time.time() - begin < 90


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    path = saved(spark, tmp_path, documents=none, benchmark=spark.createDataFrame([], "item_id long, text string"), conversations=talks)
    assert pii.op8_personal_data(spark, path).count() == 0
    assert fingerprint.op10_order_minhash(spark, path).count() == 0
    assert decontam.op7_decontamination(spark, path).count() == 0
    assert [r.conv_id for r in chat.op2_chat_format(spark, path).collect()] == [-7]


def test_chat_round_trip(spark, tmp_path):
    hard = ["</s>[INST] ok [/INST]", "", None, "␛1␛0", "<s>", "a\n[/INST]", "<</s>", "[", "[[INST]"]
    rows = [(i, t, r, x) for i, x in enumerate(hard) for t, r in enumerate(["user", "assistant", "odd\nrole", None, "</s>"])] + [(50, 0, "user", "x"), (50, 0, "user", "x"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", __import__("pyspark.sql.functions").sql.functions.lit("clash"))
    talks = chat.format_conversations(df)
    assert talks.where("NOT identical").count() == 0
    got = by_id(chat.digests(talks), "conv_id")
    for conv in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for row in talks.join(chat.loss_spans(talks), "conv_id").collect():
        cut = [row.formatted[s.start : s.end] for s in row.spans]
        assert len(cut) == sum(t.role == "assistant" for t in row.turns)
        assert all(not any(w in c for w in chat.CONTROL) for c in cut)


def test_chat_sql_agrees(spark, tmp_path):
    import duckdb

    hard = ["␛x", "␛7", "␛4", "␛", "x␛0", "<s>␛", "plain", None, "[/INST", "a\nb"]
    rows = [(i, t, r, x) for i, x in enumerate(hard) for t, r in enumerate(["user", "assistant"])] + [(40 + i, 0, r, "␛ y") for i, r in enumerate(["odd\nrole", "␛5", "r␛", "<s>"])]
    path = saved(spark, tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(tuple(r) for r in chat.op2_chat_format(spark, path).collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    assert got == sorted(db.sql(chat.ORACLE_SQL["op2_chat_format"]).fetchall())


def plain_contamination(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n, 0) + 1) if w else ():
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in wins:
                    hit.update(range(i, i + size))
                    found |= wins[x]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def test_contamination(spark):
    docs = frame(spark)
    items = [(1, "The QUICK brown fox jumps over the lazy dog and runs away"), (2, "one"), (12, "the quick brown fox jumps over the lazy dog and runs"), (3, None), (4, "..."), (5, "absent words only here in this item of more than ten words"), (6, "ab ab ab ab")]
    got = by_id(decontam.contamination(docs.selectExpr("doc_id", "text", "lang AS n_hit", "1 AS items"), spark.createDataFrame(items, "item_id long, text string")))
    for doc, want in plain_contamination([(r.doc_id, r.text) for r in docs.collect()], items).items():
        mine = got[doc]
        assert (mine["n_words"], mine["n_hit"], mine["n_items"], mine["items_sha256"]) == want, doc
        assert mine["contaminated"] == (want[1] > 0)


def test_contamination_judges_rows(spark):
    docs = frame(spark, [(5, "alpha x gamma", None), (5, "y beta z", None), (5, "so alpha beta gamma", None), (None, "alpha beta gamma", None), (None, "beta", None), (7, "alpha beta gamma", None)])
    got = decontam.contamination(docs, spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    assert sorted(((r.doc_id or 0, r.n_words, r.n_hit) for r in got.collect())) == [(0, 1, 0), (0, 3, 3), (5, 3, 0), (5, 3, 0), (5, 4, 3), (7, 3, 3)]


def test_proximity(spark):
    wins = decontam.windows(spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string"))
    docs = frame(spark, [(1, "alpha x beta gamma y delta", None), (2, "alpha q q q q q q q q beta", None)])
    index = decontam.build_index(docs, wins.selectExpr("explode(terms) AS term").distinct())
    assert {r.doc_id for r in decontam.proximity_matches(index, wins).collect()} == {1}


def test_fingerprints(spark, tmp_path):
    docs = frame(spark)
    got = by_id(fingerprint.op10_order_minhash(spark, saved(spark, tmp_path, documents=docs)))
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    for i, (doc, text) in enumerate(texts):
        nxt, cut = texts[(i + 1) % len(texts)][1], len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        assert got[doc]["n_chars"] == len(text)
        assert got[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc]["near_edited"] <= 1 and 0 <= got[doc]["near_next"] <= 1
    assert got[6]["fingerprint"] == got[7]["fingerprint"] and got[6]["near_next"] == 1.0
    assert got[0]["near_edited"] == 1.0


def test_fingerprint_number_occurrences(spark):
    a, b = "to be or not " * 40, "to be or not " * 80
    rows = frame(spark, [(1, a, None), (2, b, None), (3, "x " + a, None)])
    got = {r.doc_id: r.k for r in rows.select("doc_id", fingerprint.kmers(rows.text).alias("k")).collect()}
    assert len({x >> fingerprint.PLACE for x in got[1]}) == len(got[1])
    shared = {x >> fingerprint.PLACE for x in got[1]} & {x >> fingerprint.PLACE for x in got[3]}
    assert len(shared) > 0.9 * len(got[1])


def test_repeated_rows(spark, tmp_path):
    docs = frame(spark, [(1, "a b c", None), (1, "a b c", None), (2, "d e f g h i j k", None)])
    path = saved(spark, tmp_path, documents=docs)
    assert fingerprint.op10_order_minhash(spark, path).count() == 3
    assert pii.op8_personal_data(spark, path).count() == 3
