"""The longest alias of a text, by automata, against a search for each alias."""

import random
import re

from heliodor.operators import dictionary


def plain(text, entries):
    low = text.lower()
    spaced = " " + re.sub("[^a-z&]+", " ", low) + " "
    hits = [(-len(a), place, a, code) for a, code, place in entries if a and (f" {a} " in spaced if len(a) <= 3 else a in low)]
    return min(hits)[2:] if hits else (None, None)


def test_longest_alias(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abc &") for _ in range(n))
    entries = list({(a := word(rnd.randrange(1, 7)).strip()): (a, f"C{i}", rnd.randrange(4)) for i in range(120)}.values()) + [("3m", "MMM", 0), ("", "NONE", 0)]
    texts = [(i, rnd.choice([str.upper, str.lower])(word(rnd.randrange(30)) + rnd.choice(["", "3M", ", b, ", "1a2"]))) for i in range(300)] + [(300, None), (301, "")]
    rows = spark.createDataFrame(texts, "id long, q string").repartition(3)
    held = spark.createDataFrame(entries, "alias string, code string, place long")
    want = {i: plain(t or "", entries) for i, t in texts}
    for bound in (1000, 50):  # one automaton, and several
        monkeypatch.setattr(dictionary, "ENTRIES", bound)
        assert {r.id: (r.alias, r.code) for r in dictionary.match_aliases(rows, "q", held).collect()} == want
    plan = dictionary.match_aliases(rows, "q", held)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" not in plan


def test_large_dictionary(spark):
    entries = spark.range(100_000).selectExpr("concat('name ', id) AS alias", "concat('N', id) AS code", "id AS place")
    rows = spark.range(2000).selectExpr("id", "concat('what did Name ', id * 37, ' sell?') AS q")
    got = {r.id: r.code for r in dictionary.match_aliases(rows, "q", entries).collect()}
    assert got == {i: f"N{i * 37}" for i in range(2000)}


def test_company_dictionary(spark):
    files = spark.createDataFrame([("JOHNSON_JOHNSON_2022.pdf",), ("johnson_johnson_2023.pdf",), ("MCDONALDS_8K_dated-2023-02-13.pdf",), ("notes.txt",), ("BESTBUY_2019.pdf",)], "name string")
    got = {r.alias: r.code for r in dictionary.company_dictionary(files).collect()}
    assert {"johnson_johnson", "johnsonjohnson", "johnson johnson", "mcdonalds", "bestbuy", "j&j", "amex"} <= got.keys()
    assert got["johnson johnson"] == got["j&j"] == "JOHNSON_JOHNSON" and got["mcdonald's"] == "MCDONALDS" and "notes" not in got
    asked = spark.createDataFrame([(1, "What did J&J earn?"), (2, "Johnson Johnson in 2022"), (3, "AMEX revenue"), (4, "nobody")], "id long, q string")
    assert {r.id: r.code for r in dictionary.match_aliases(asked, "q", dictionary.company_dictionary(files)).collect()} == {1: "JOHNSON_JOHNSON", 2: "JOHNSON_JOHNSON", 3: "AMERICANEXPRESS", 4: None}


def test_known_names(spark):
    files = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("b.pdf",)], "name string")
    replies = spark.createDataFrame([(1, 'so: ["b.pdf", "x.pdf", "a.pdf", "b.pdf"]'), (2, "none"), (3, None)], "query_id long, reply string")
    assert [(r.query_id, r.name) for r in dictionary.known_names(replies, files).orderBy("place").collect()] == [(1, "b.pdf"), (1, "a.pdf")]
