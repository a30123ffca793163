"""Catalogue queries against their SQL, and operators on small cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from heliodor import catalog, plans, sources, streaming
from heliodor.functions import scalars, text
from heliodor.operators import chunking, metrics, rank, search, store, trajectory
from heliodor.plans.providers import FunctionGenerator, HashingEmbedder, OverlapReranker, ReplayGenerator, TemplateGenerator

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str([str(x) for x in v]) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tiny, con, name):
    got = catalog.QUERIES[name](spark, tiny)
    if name in catalog.ORACLE_SQL:
        got, want = got.toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert got.count() > 0


def one(spark, **columns):
    return lambda c: spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(c).first()[0]


@pytest.mark.parametrize("given, want", [("01:02", 62.0), ("01:00:05", 3605.0), ("7.5", 7.5), ("x", None)])
def test_time_value(spark, given, want):
    assert one(spark, t=given)(scalars.time_value(F.col("t"))) == want


def test_golden_scalars(spark):
    value = one(spark, a=".\\a\\b.txt", b="../.x", c="ab_1 c, 你好", d="7/11/2025", e='The  Quick, brown-fox!', q="Q2 of FY2023 versus in 2021", s='What is the "net" revenue AND cost?')
    assert value(scalars.normalize_path(F.col("a"))) == "a/b.txt" and value(scalars.normalize_path(F.col("b"))) == "x"
    assert value(scalars.token_count(F.col("c"))) == 4
    assert str(value(scalars.parse_date(F.col("d")))) == "2025-11-07 00:00:00"
    assert value(text.normalize_answer(F.col("e"))) == "quick brownfox"
    assert value(text.years(F.col("q"))) == [2021, 2023] and value(text.quarter(F.col("q"))) == "Q2"
    assert value(text.fts_query(F.col("s"))) == '"net" OR "revenue" OR "cost?"'
    assert value(scalars.human_size(F.lit(1023))) == "1023 B" and value(scalars.human_size(F.lit(1536))) == "1.50 KB"
    assert [value(text.is_reasoning(F.lit(s))) for s in ("Thus 3 + 4 is 7.", "The file is here.", "Some text.")] == [True, False, True]


def test_golden_metrics(spark):
    value = one(spark, x=1)
    lists = lambda a, b: tuple(value(metrics.list_prf(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>"))))
    assert lists(["f1", "f2"], ["f1", "f3"]) == (0.5, 0.5, 0.5) and lists([], ["a"]) == (0, 0, 0) == lists(["a"], [])
    batch = spark.createDataFrame([(["a"], ["a"]), ([], ["x"])], "truth array<string>, found array<string>")
    assert tuple(metrics.list_batch(batch, "empty").select("n", "f1").first()) == (1, 1.0) and tuple(metrics.list_batch(batch, "null").select("n", "f1").first()) == (2, 0.5)
    judge = lambda s: tuple(value(metrics.judge_reply(F.lit(s))))
    assert judge('ok {"pred":"YES","score":9}') == ("yes", 5) and judge("pred: no, score: 2") == ("no", 2) and judge("") == ("no", 0)
    verdict = lambda xs: value(rank.verdict(F.array(*map(F.lit, xs)).cast("array<double>"), 0.5, -0.5))
    assert [verdict(x) for x in ([0.6, -1.0], [-0.6, -0.9], [0.1], [])] == ["correct", "incorrect", "ambiguous", "incorrect"]
    assert metrics.rouge_scores("the cats sat", "the cat sat")["score"] == pytest.approx(1.0)
    assert metrics.bleu_scores("the cat sat on the mat", "the cat sat on the mat")["bleu"] == pytest.approx(1.0) and metrics.bleu_scores("x", "y")["bleu"] == 0
    assert metrics.lcs(list("abcbdab"), list("bdcaba")) == 4


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("happy", "happi"), ("adjustment", "adjust"), ("probate", "probat"), ("controll", "control"), ("agreed", "agre")])
def test_porter(word, want):
    assert text.porter(word) == want


def test_rrf(spark):
    hits = lambda ids: spark.createDataFrame([(1, x, 1.0, i + 1) for i, x in enumerate(ids)], "query_id long, id string, score double, rank int")
    fused = rank.rrf([hits(["a", "b"]), hits(["b", "c"])], 10).orderBy("rank").collect()
    assert [r.id for r in fused] == ["b", "a", "c"] and fused[0].score == pytest.approx(1 / 62 + 1 / 61)
    assert [r.id for r in rank.rrf([hits(["a"]), hits(["b"])], 10).orderBy("rank").collect()] == ["a", "b"]


def test_chunking(spark):
    value = one(spark, t="1\n2\n3\n4\n5")
    assert value(chunking.lines(F.col("t"), 2, 1)) == ["1\n2", "2\n3", "3\n4", "4\n5", "5"]
    prose = "\n\n".join(f"Paragraph {i} has a few words. " * 8 for i in range(12)) + "\n\n```\ncode " + "x\n" * 30 + "```\n| a | b |\n|---|---|\n| 1 | 2 |"
    made = chunking.semantic_split(prose, 500, 100)
    assert all(len(c) <= 500 for c in made) and "".join("".join(made).split()) == "".join(prose.split())
    assert all(chunking.estimate(c) <= 40 for c in chunking.semantic_split(prose, 500, 100, token_limit=40))
    cut = chunking.recursive_split("word " * 1000, 100)
    assert all(len(c) <= 100 for c in cut) and sum(c.count("word") for c in cut) == 1000
    assert chunking.cross_segments(["aa", "bb", "cc"], 5) == [(0, 1, "aa\nbb"), (2, 2, "cc")]
    assert chunking.json_split('{"a": 1, "b": 2}', 1) == ['{\n  "a": 1\n}', '{\n  "b": 2\n}'] and chunking.json_split("no\njson", line_size=1) == ["no", "json"]
    assert chunking.overrides("a=1, b=2") == {"a": "1", "b": "2"} == chunking.overrides('{"a": 1, "b": 2}')


def test_actions():
    assert trajectory.action_of('<tool>{"name":"terminal","arguments":{"command":"ls \\"{\\" x"}}</tool>') == ("terminal", 'ls "{" x')
    assert trajectory.action_of("<tool>{'name': 'terminal', 'arguments': {'command': 'ls'}}")[1] == "ls"
    assert trajectory.action_of('<answer>a</answer><tool>{"command":"x"}</tool>') == ("answer", "a")
    assert trajectory.action_of('<tool>{"name":"shell","arguments":{"command":"x"}}</tool>')[0] == "error"
    assert trajectory.normalize("return_txt my file.txt") == 'return_txt "my file.txt"' and trajectory.normalize("return_txt a | wc") == "return_txt a | wc"
    assert trajectory.normalize("return_img my doc.pdf --page 2") == 'return_img "my doc.pdf" --page 2'
    assert trajectory.policy_error("list_files | head") and trajectory.policy_error("return_txt a --page 1") and trajectory.policy_error("grep x a.pdf") and trajectory.policy_error("return_txt 'a") and not trajectory.policy_error("return_txt a.txt")
    assert trajectory.touched("return_txt 'a b.txt'") == ["a b.txt"] and trajectory.touched("cat -n x/y.md z.csv http://a/b | wc") == ["x/y.md", "z.csv"]


def test_filter_language(spark):
    df = spark.createDataFrame([("a AND b", 1), ("c", 2)], "name string, label int")
    assert [r.label for r in df.where(search.metadata_filter("name == 'a AND b' AND label in [1, 2]")).collect()] == [1]
    with pytest.raises(ValueError):
        search.metadata_filter("name > 3")


def test_point_store(spark, tmp_path):
    points = store.PointStore(spark, str(tmp_path), store.collection_name("base", "x"))
    df = lambda rows: spark.createDataFrame(rows, "id long, v string, n int")
    points.upsert(df([(1, "a", 0), (2, "b", 0), (2, "bb", 1)]), order="n")
    points.upsert(df([(2, "c", 5), (3, "d", 0)]))
    points.upsert(df([(2, "c", 5), (3, "d", 0)]))
    assert {r.id: r.v for r in points.read().collect()} == {1: "a", 2: "c", 3: "d"}
    assert {r.id for r in points.existing(df([(1, "", 0), (9, "", 0)])).collect()} == {1}
    points.delete(ids=df([(1, "", 0)]))
    points.delete(where=F.col("v") == "d")
    assert [r.id for r in points.read().collect()] == [2] and points.scroll(F.col("n") == 5).count() == 1


def corpus(spark, generator=None, rerank=True):
    chunks = [(1, "the cat sat on the mat", 10, 0, 0), (2, "a dog ran in the park", 10, 0, 1), (3, "stock prices fell today", 11, 0, 0), (4, "the cat and the dog", 11, 1, 1), (5, "rain fell in the park today", 12, 0, 0)]
    df = spark.createDataFrame(chunks, "id long, text string, file_id long, page int, chunk_index int")
    return plans.Corpus(df, HashingEmbedder(64), OverlapReranker() if rerank else None, generator or TemplateGenerator({"grade": lambda p: F.lit("Document 1: score=0.9\nDocument 2: score=0.1"), "thought": lambda p: F.lit("The dog. So the answer is: dog."), "decompose": lambda p: F.lit("1. cat mat\n2. dog park"), "classify": lambda p: F.when(F.contains(p, F.lit("cat")), "A").otherwise("C"), "react": lambda p: F.when(F.contains(p, F.lit("Source")), "Action: finish[done]").otherwise("Action: search[dog park]")}))


@pytest.mark.parametrize("name", sorted(k for k, v in plans.PLANS.items() if v))
def test_plans(spark, name):
    asked = spark.createDataFrame([(1, "cat mat"), (2, "dog park")], "query_id long, question string")
    hits = plans.PLANS[name](asked, corpus(spark)).collect()
    assert {h.query_id for h in hits} == {1, 2}
    for q in (1, 2):
        mine = sorted((h for h in hits if h.query_id == q), key=lambda h: h.rank)
        assert [h.rank for h in mine] == list(range(1, len(mine) + 1)) and len({h.id for h in mine}) == len(mine)


def test_answers(spark):
    asked = spark.createDataFrame([(1, "cat mat"), (2, "dog park")], "query_id long, question string")
    out = {r.query_id: r.answer for r in plans.run(asked, corpus(spark), "hybrid", pages=2).collect()}
    assert all("Context" in out[q] for q in out) and len(out) == 2
    assert {r.answer for r in plans.run(asked, corpus(spark), "none").collect()} == {plans.NO_CONTEXT}
    assert {(r.answer, r.turns) for r in plans.react(asked, corpus(spark)).collect()} == {("done", 2)}
    replies = spark.createDataFrame([(1, "answer", 0, "yes")], "query_id long, stage string, step int, reply string")
    got = {r.query_id: r.answer for r in plans.run(asked, corpus(spark, ReplayGenerator(replies)), "standard").collect()}
    assert got == {1: "yes", 2: None}
    assert {r.reply for r in FunctionGenerator(lambda ps: [p.upper() for p in ps]).reply(asked, "x", 0, F.col("question")).collect()} == {"CAT MAT", "DOG PARK"}


def test_sources(spark, tmp_path):
    gold = tmp_path / "gold"
    gold.mkdir()
    (gold / "a.json").write_text('{"file_info": {"file_id": "f1", "file_path": "x/a.pdf"}, "segments": [{"content": "s", "page": 2}]}')
    (gold / "b.json").write_text('{"content": "plain"}')
    (gold / "c.json").write_text('{"segments": [{"page": 1}]}')
    files, rejects = sources.gold_json(spark, str(gold))
    assert {r.file_type for r in files.collect()} == {"pdf", "json"} and rejects.count() == 1
    (tmp_path / "list.txt").write_text("# no\na.txt\n\n b.md \n")
    assert [r.path for r in sources.path_list(spark, str(tmp_path / "list.txt")).orderBy("place").collect()] == ["a.txt", "b.md"]
    (tmp_path / "q.json").write_text('{"questions": [{"id": "7", "question": "who"}, {"query": "what"}, {"question": " "}]}')
    (tmp_path / "q.txt").write_text('plain one\n{"qid": "9", "prompt": "json one"}\n')
    (tmp_path / "m.json").write_text('{"a": "first", "b": "second"}')
    ask = lambda n: {(r.query_id, r.question) for r in sources.questions(spark, str(tmp_path / n)).collect()}
    assert ask("q.json") == {("7", "who"), ("2", "what")} and ask("q.txt") == {("1", "plain one"), ("9", "json one")} and ask("m.json") == {("a", "first"), ("b", "second")}
    (tmp_path / "meta.csv").write_text("FilePath,FileType,creation_date,modification_date\n.\\a\\b.txt,txt,7/11/2025,2025/12/01\nd,folder,1/1/2020,\n")
    assert sorted(str(r.ts.date()) for r in sources.file_meta(spark, str(tmp_path / "meta.csv")).collect()) == ["2025-11-07", "2025-12-01"]
    assert {r["name"] for r in sources.known_files(spark, str(tmp_path)).collect()} == {"list.txt", "q.json", "q.txt", "m.json", "meta.csv"}
    log = spark.createDataFrame([("1", None, "a", "old"), ("1", None, "b", "new"), (None, "2", "a", "x")], "id string, query_id string, file_name string, v string")
    assert {r.v for r in sources.aggregate_log(log).collect()} == {"new", "x"}


def test_streaming_equals_batch(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    source = tmp_path / "in"
    events.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    counted = streaming.tumbling(streaming.with_watermark(stream), "1 day", "event_type")
    q = counted.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = streaming.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "event_type")
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("daily")) == key(batch)


def test_incremental_index(spark, tmp_path):
    source = tmp_path / "files"
    docs = lambda rows: spark.createDataFrame(rows, "file_id string, text string")
    chunk = lambda df: df.select(scalars.md5_id(F.col("file_id"), F.col("text")).alias("id"), F.col("text").alias("content"))
    points = store.PointStore(spark, str(tmp_path), "points")
    for part in ([("a", "x"), ("b", "y")], [("b", "y"), ("c", "z")]):
        docs(part).write.mode("append").json(str(source))
        stream = spark.readStream.schema("file_id string, text string").json(str(source))
        q = streaming.index_batches(stream, points, chunk, str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.content for r in points.read().collect()) == ["x", "y", "z"]


def test_lsh_recall(spark, tiny):
    exact = {(r.query_id, r.id) for r in catalog.QUERIES["dense_topk_cosine"](spark, tiny).collect()}
    found = {(r.query_id, r.id) for r in catalog.QUERIES["ann_topk_lsh"](spark, tiny).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_string_metrics_see_documents(spark, tiny):
    from heliodor.operators import metrics
    from heliodor.queries import strings

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    items = {r.item_id: r.text or "" for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()}
    rouge, bleu, stems = ({r.doc_id: r for r in f(spark, tiny).collect()} for f in (strings.rouge_stemmed, strings.bleu4, strings.porter_stems))
    assert set(rouge) == set(bleu) == {d for d in docs if d % len(items) in items} and set(stems) == set(docs)
    for d in rouge:
        a, b = (metrics.rouge_tokens(t) for t in (docs[d], items[d % len(items)]))
        best = {-1: 0}  # the longest common subsequence that ends in each place of b
        for x in a:
            seen = 0
            for j, y in enumerate(b):
                here = best.get(j, 0)
                if x == y:
                    best[j] = max(here, seen + 1)
                seen = max(seen, here)
        assert abs(rouge[d].rougeL_r - (max(best.values()) / len(b) if b else 0.0)) < 1e-9
        assert 0 <= bleu[d].bleu <= 1
