"""Scalar, text and answer-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliodor import sources
from heliodor.functions import scalars, text
from heliodor.operators import dictionary, metrics, rank
from heliodor.queries import load, query
from heliodor.queries.stemming import stems_sql

_NORM = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS normalized FROM documents")
def answer_normalize(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_answer(F.col("text"))).alias("normalized"))


def _pairs(spark, sf_dir):
    """Each document with the benchmark item of its number."""
    docs, items = load(spark, sf_dir, "documents", "benchmark")
    n = items.agg(F.count("*").alias("n"))
    return docs.crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n")).join(items.withColumnRenamed("text", "truth"), "item_id").select("doc_id", F.col("text").alias("answer"), "truth")


_PAIRS = "pairs AS (SELECT doc_id, d.text AS answer, b.text AS truth FROM documents d, (SELECT count(*) AS n FROM benchmark) c JOIN benchmark b ON b.item_id = d.doc_id % c.n)"


def _cut_pairs(spark, sf_dir):
    """The same pairs, but every tenth document's truth is cut out of it, and every thirtieth's is all of it with more signs."""
    d = F.col("doc_id")
    cut = F.when(d % 30 == 0, F.concat(F.lit("The "), "answer", F.lit(" !"))).when(d % 10 == 0, F.substring("answer", 1, 40)).otherwise(F.col("truth"))
    return _pairs(spark, sf_dir).withColumn("truth", cut)


_CUT = f"""{_PAIRS.replace('pairs AS', 'whole AS')}, pairs AS (SELECT doc_id, answer, CASE WHEN doc_id % 30 = 0 THEN 'The ' || answer || ' !' WHEN doc_id % 10 = 0 THEN left(answer, 40) ELSE truth END AS truth FROM whole)"""


@query(f"WITH {_CUT} SELECT doc_id, CAST({_NORM.format('answer')} = {_NORM.format('truth')} AS DOUBLE) AS score FROM pairs")
def exact_match(spark, sf_dir):
    return _cut_pairs(spark, sf_dir).select("doc_id", metrics.exact_match(F.col("answer"), F.col("truth")).alias("score"))


@query(f"WITH {_CUT} SELECT doc_id, CAST(contains({_NORM.format('answer')}, {_NORM.format('truth')}) AS DOUBLE) AS score FROM pairs")
def covered_exact_match(spark, sf_dir):
    return _cut_pairs(spark, sf_dir).select("doc_id", metrics.covered_match(F.col("answer"), F.col("truth")).alias("score"))


def _rouge_sql(n: int) -> str:
    gram = lambda w: f"list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"
    return f"""WITH {_PAIRS}, w AS (SELECT doc_id, {_WORDS.format('answer')} AS a, {_WORDS.format('truth')} AS b FROM pairs),
g AS (SELECT doc_id, {gram('a')} AS x, {gram('b')} AS y FROM w),
cx AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(x) AS t FROM g) GROUP BY ALL), cy AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(y) AS t FROM g) GROUP BY ALL),
h AS (SELECT doc_id, CAST(sum(least(cx.n, cy.n)) AS DOUBLE) AS h FROM cx JOIN cy USING (doc_id, t) GROUP BY doc_id),
p AS (SELECT g.doc_id, CASE WHEN len(x) = 0 THEN 0.0 ELSE coalesce(h, 0.0) / len(x) END AS p, CASE WHEN len(y) = 0 THEN 0.0 ELSE coalesce(h, 0.0) / len(y) END AS r FROM g LEFT JOIN h USING (doc_id))
SELECT doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM p"""


def _rouge(spark, sf_dir, n):
    # All in the row: no gram is shuffled.
    scored = _pairs(spark, sf_dir).select("doc_id", metrics.rouge_n(text.words(F.col("answer")), text.words(F.col("truth")), n).alias("m"))
    return scored.select("doc_id", *(F.round(f"m.{c}", 6).alias(c) for c in ("precision", "recall", "f1")))


@query(_rouge_sql(1))
def rouge1(spark, sf_dir):
    return _rouge(spark, sf_dir, 1)


@query(_rouge_sql(2))
def rouge2(spark, sf_dir):
    return _rouge(spark, sf_dir, 2)


@query()
def rouge_stemmed(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", metrics.rouge(F.col("answer"), F.col("truth")).alias("m")).select("doc_id", "m.*")


@query()
def bleu4(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", metrics.bleu(F.col("answer"), F.col("truth")).alias("m")).select("doc_id", "m.*")


@query(f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM d), {stems_sql('u', 4)},
s AS (SELECT doc_id, list(stem ORDER BY pos) AS stems FROM u JOIN stemmed USING (w) GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string(stems, ' '), '') AS stems FROM d LEFT JOIN s USING (doc_id)""")
def porter_stems(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(text.stems(text.words(F.col("text"))), " ").alias("stems"))


_FTS = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '\\b([aA][nN][dD]|[oO][rR]|[nN][oO][tT]|[nN][eE][aA][rR])\\b', ' ', 'g'), '[\"*+(){{}}^~:-]', ' ', 'g'), '\\s+'), lambda t: t <> '' AND lower(t) NOT IN ({0}))".format(", ".join(f"'{w}'" for w in text.STOP_WORDS))


@query(f"SELECT item_id, array_to_string(list_transform({_FTS}, lambda t: chr(34) || t || chr(34)), ' OR ') AS q FROM benchmark")
def fts_query_sanitize(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", text.fts_query(F.col("text")).alias("q"))


_ASK = "'What was revenue in ' || (2000 + o_orderkey % 25) || CASE WHEN o_orderkey % 3 = 0 THEN ' and Q' || (1 + o_orderkey % 4) || ' of FY' || (2010 + o_orderkey % 9) ELSE ' versus fiscal year ' || (2015 + o_orderkey % 7) END"


@query(f"""WITH a AS (SELECT o_orderkey, {_ASK} AS q FROM orders),
y AS (SELECT o_orderkey, q, list_concat(list_concat(regexp_extract_all(q, '(?i)Q([1-4])\\s+(?:of\\s+)?FY\\s*(\\d{{4}})', 2), regexp_extract_all(q, '(?i)(?:FY|fiscal\\s+year)\\s*(\\d{{4}})', 1)), regexp_extract_all(q, '(?i)(?:in|for|during|as\\s+of|from|between)\\s+(\\d{{4}})', 1)) AS y FROM a)
SELECT o_orderkey, array_to_string(list_sort(list_distinct(y)), ',') AS years, CASE WHEN regexp_matches(q, 'Q[1-4] of FY') THEN 'Q' || regexp_extract(q, 'Q([1-4]) of FY', 1) END AS quarter FROM y""")
def year_quarter_extract(spark, sf_dir):
    asked = load(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ASK).alias("q"))
    return asked.select("o_orderkey", F.array_join(F.transform(text.years(F.col("q")), lambda y: y.cast("string")), ",").alias("years"), text.quarter(F.col("q")).alias("quarter"))


@query("""WITH w AS (SELECT DISTINCT lower(regexp_extract(p_name, '^(\\S+)', 1)) AS alias FROM part WHERE p_name <> ''),
m AS (SELECT p_partkey, alias, row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, alias) AS n FROM part, w
WHERE CASE WHEN length(alias) <= 3 THEN contains(' ' || regexp_replace(lower(p_name), '[^a-z&]+', ' ', 'g') || ' ', ' ' || alias || ' ') ELSE contains(lower(p_name), alias) END)
SELECT p_partkey, alias FROM m WHERE n = 1""")
def alias_longest_match(spark, sf_dir):
    parts = load(spark, sf_dir, "part")
    alias = parts.where("p_name <> ''").select(F.lower(F.regexp_extract("p_name", r"^(\S+)", 1)).alias("alias")).distinct()
    found = dictionary.match_aliases(parts.select("p_partkey", "p_name"), "p_name", alias.select("alias", F.col("alias").alias("code"), F.lit(0).alias("place")))
    return found.where("alias IS NOT NULL").select("p_partkey", "alias")


@query("""WITH f AS (SELECT DISTINCT upper(p_brand || '_' || split_part(p_name, ' ', 1)) AS code FROM part), n AS (SELECT lower(code) AS a, code FROM f UNION SELECT lower(replace(code, '_', '')), code FROM f UNION SELECT lower(replace(code, '_', ' ')), code FROM f),
d AS (SELECT a AS alias, min(code) AS code FROM n GROUP BY a), q AS (SELECT o_orderkey, 'Sales of ' || p_brand || CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '_' END || upper(split_part(p_name, ' ', 1)) || ' in 2020' AS q FROM orders JOIN part ON p_partkey = 1 + o_orderkey % (SELECT count(*) FROM part)),
u AS (SELECT DISTINCT q FROM q), m AS (SELECT q, alias, code, row_number() OVER (PARTITION BY q ORDER BY length(alias) DESC, alias) AS n FROM u JOIN d ON contains(lower(q), alias))
SELECT o_orderkey, alias, code FROM q JOIN m USING (q) WHERE n = 1""")
def company_match(spark, sf_dir):
    """The company that a question names, by a dictionary of the files' names."""
    parts, orders = load(spark, sf_dir, "part", "orders")
    maker = F.concat("p_brand", F.lit("_"), F.split("p_name", " ")[0])
    known = dictionary.company_dictionary(parts.select(F.concat(maker, F.lit("_2020.pdf")).alias("name")), {}).withColumn("place", F.lit(0))
    n = parts.agg(F.count("*").alias("n"))
    asked = orders.crossJoin(F.broadcast(n)).join(parts.select("p_partkey", "p_brand", F.upper(F.split("p_name", " ")[0]).alias("first")), F.col("p_partkey") == 1 + F.col("o_orderkey") % F.col("n"))
    asked = asked.select("o_orderkey", F.concat(F.lit("Sales of "), "p_brand", F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise("_"), "first", F.lit(" in 2020")).alias("q"))
    return dictionary.match_aliases(asked, "q", known).where("alias IS NOT NULL").select("o_orderkey", "alias", "code")


@query("SELECT page_id, md5(url) AS file_id, sha1(url || ':' || page_id) AS row_id, regexp_extract(url, '([^/]+)$', 1) AS base FROM pages")
def stable_file_id(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", scalars.md5_id(F.col("url")).alias("file_id"), scalars.sha1_id(F.col("url"), F.col("page_id").cast("string")).alias("row_id"), scalars.basename(F.col("url")).alias("base"))


_PATH = "'Dir' || (doc_id % 7) || '/sub/' || source || '.' || CASE doc_id % 9 WHEN 0 THEN 'PDF' WHEN 1 THEN 'txt' WHEN 2 THEN 'mp3' WHEN 3 THEN 'tar' WHEN 4 THEN 'Jpeg' WHEN 5 THEN 'xml' WHEN 6 THEN 'db' WHEN 7 THEN 'mkv' ELSE 'yaml' END"


@query(f"""WITH p AS (SELECT doc_id, {_PATH} AS path FROM documents), e AS (SELECT doc_id, path, lower(regexp_extract(path, '\\.([^.]+)$', 1)) AS ext FROM p)
SELECT doc_id, ext, regexp_extract(path, '([^/]+)\\.[^.]+$', 1) AS stem, CASE ext WHEN 'db' THEN 'sqlite' WHEN 'tar' THEN 'unknown' WHEN 'yaml' THEN 'unknown' ELSE ext END AS file_type,
CASE WHEN ext IN ('txt', 'xml', 'yaml') THEN 'Text' WHEN ext = 'pdf' THEN 'Documents' WHEN ext = 'jpeg' THEN 'Images' WHEN ext = 'mp3' THEN 'Audio' WHEN ext = 'mkv' THEN 'Video' END AS modality, regexp_extract(path, '^([^/]+)', 1) AS top FROM e""")
def file_type_modality(spark, sf_dir):
    p = load(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("path"))
    path = F.col("path")
    return p.select("doc_id", scalars.suffix(path).alias("ext"), scalars.stem(path).alias("stem"), scalars.file_type(path).alias("file_type"), scalars.modality(scalars.suffix(path)).alias("modality"), scalars.top_folder(path).alias("top"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, length(html) AS n, CASE WHEN length(html) < 1024 THEN length(html) || ' B' WHEN length(html) < 1048576 THEN printf('%.2f KB', length(html) / 1024) ELSE printf('%.2f MB', length(html) / 1048576) END AS size FROM pages""")
def human_size(spark, sf_dir):
    n = F.length("html").cast("long")
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), n.alias("n"), scalars.human_size(n).alias("size"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '([A-Za-z0-9_]+|[一-鿿])', 1)) AS BIGINT) AS n FROM documents")
def token_count(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", scalars.token_count(F.col("text")).alias("n"))


_TIME = "CASE event_id % 5 WHEN 0 THEN (event_id % 60) || ':' || lpad(CAST(event_id % 59 AS VARCHAR), 2, '0') WHEN 1 THEN '01:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':05' WHEN 2 THEN CAST(event_id AS VARCHAR) || '.5' WHEN 3 THEN 'x' || event_id ELSE NULL END"


@query(f"""WITH t AS (SELECT event_id, {_TIME} AS t FROM events), p AS (SELECT *, string_split(t, ':') AS s FROM t)
SELECT event_id, CASE WHEN TRY_CAST(t AS DOUBLE) IS NOT NULL THEN CAST(t AS DOUBLE) WHEN regexp_full_match(t, '\\d+:\\d+') THEN CAST(s[1] AS DOUBLE) * 60 + CAST(s[2] AS DOUBLE) WHEN regexp_full_match(t, '\\d+:\\d+:\\d+') THEN CAST(s[1] AS DOUBLE) * 3600 + CAST(s[2] AS DOUBLE) * 60 + CAST(s[3] AS DOUBLE) END AS seconds FROM p""")
def time_values(spark, sf_dir):
    t = load(spark, sf_dir, "events").select("event_id", F.expr(_TIME.replace("VARCHAR", "STRING")).alias("t"))
    return t.select("event_id", scalars.time_value(F.col("t")).alias("seconds"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE NULL END AS parsed, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp FROM orders")
def date_parse(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "d/M/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy/M/d")).otherwise("soon")
    return o.select("o_orderkey", F.date_format(scalars.parse_date(said), "yyyy-MM-dd").alias("parsed"), scalars.stamp(F.col("o_orderdate")).alias("stamp"))


@query("""SELECT conv_id, turn, CASE WHEN length(trim(regexp_extract(trim(text), '^([^.!?]+[.!?])', 1))) > 0 THEN trim(regexp_extract(trim(text), '^([^.!?]+[.!?])', 1)) ELSE left(trim(text), 200) END AS first,
regexp_matches(trim(lower(text)), '^(thus|so|therefore|hence|consequently|as a result|in conclusion|this means|that means)') OR regexp_matches(text, '\\d+\\s*[+\\-*/]\\s*\\d+') AS reasoning FROM conversations""")
def sentence_tests(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", text.first_sentence(F.col("text")).alias("first"), text.is_reasoning(F.col("text")).alias("reasoning"))


@query("""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) >= 5) AS s FROM documents)
SELECT doc_id, CAST((len(s) + 1) // 2 AS INTEGER) AS n, md5(array_to_string(list_transform(range(1, len(s) + 1, 2), lambda i: array_to_string(s[i:i + 1], ' ')), '|')) AS strips FROM s""")
def strip_decompose(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", text.sentence_pairs(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("strips"))


@query("SELECT o_orderkey, substring(CASE WHEN trim(regexp_replace(lower(o_orderpriority || ' ' || o_orderstatus || '!'), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'q' ELSE trim(regexp_replace(lower(o_orderpriority || ' ' || o_orderstatus || '!'), '[^a-z0-9]+', '_', 'g'), '_') END, 1, 60) AS slug, CASE WHEN length(o_orderpriority) > 5 THEN left(o_orderpriority, 5) || '...' ELSE o_orderpriority END AS cut FROM orders")
def slugs(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", scalars.slugify(F.concat("o_orderpriority", F.lit(" "), "o_orderstatus", F.lit("!"))).alias("slug"), scalars.truncate(F.col("o_orderpriority"), 5).alias("cut"))


@query("SELECT * FROM (SELECT source || '/' || (doc_id % 50) || '.txt' AS path, count(*) AS n FROM documents GROUP BY 1) WHERE regexp_full_match(path, 'src1[^/]*/[^/]\\.txt')")
def glob_listing(spark, sf_dir):
    paths = load(spark, sf_dir, "documents").groupBy(F.concat("source", F.lit("/"), (F.col("doc_id") % 50).cast("string"), F.lit(".txt")).alias("path")).agg(F.count("*").alias("n"))
    return paths.where(sources.glob_filter(F.col("path"), "src1*/?.txt"))


_REPLY = "CASE doc_id % 4 WHEN 0 THEN 'ok {\"pred\":\"YES\",\"score\":' || (doc_id % 9) || '}' WHEN 1 THEN 'pred: no, score: ' || (doc_id % 7) WHEN 2 THEN '' ELSE '{\"pred\": \"maybe\", \"score\": 2}' END"


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'yes' ELSE 'no' END AS pred, CAST(CASE doc_id % 4 WHEN 0 THEN least(doc_id % 9, 5) WHEN 1 THEN least(doc_id % 7, 5) WHEN 2 THEN 0 ELSE 2 END AS INTEGER) AS score FROM documents""")
def judge_parse(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", metrics.judge_reply(F.expr(_REPLY)).alias("j")).select("doc_id", "j.*")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE least(1.0, (doc_id % 15) / 10.0) END AS grade FROM documents""")
def grade_parse(spark, sf_dir):
    reply = F.concat(F.lit("Document 1: score=0.1, reason=x\nDocument 2: score="), F.round((F.col("doc_id") % 15) / 10.0, 1).cast("string"), F.lit(", reason=y"))
    return load(spark, sf_dir, "documents").select("doc_id", rank.grade_from_reply(reply, F.when(F.col("doc_id") % 3 == 0, 3).otherwise(2)).alias("grade"))
