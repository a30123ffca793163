"""Chunking and store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliodor.operators import chunking, store
from heliodor.queries import load, query

_LINES = "string_split(text, chr(10))"
_WINDOWS = f"SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(array_to_string({_LINES}[3 * i + 1:3 * i + 4], chr(10))) AS content FROM documents, unnest(range(0, (len({_LINES}) - 1) // 3 + 1)) AS t(i)"


def _chunks(df, key, column):
    return df.select(key, F.posexplode(column).alias("chunk_index", "content")).select(key, "chunk_index", F.md5("content").alias("content"))


@query(_WINDOWS)
def chunk_lines(spark, sf_dir):
    return _chunks(load(spark, sf_dir, "documents"), "doc_id", chunking.lines(F.col("text"), 4, 1))


def _islands(table: str, key: str, test: str, fallback: str) -> str:
    return f"""WITH l AS (SELECT {key} AS id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS n FROM {table}),
m AS (SELECT *, sum(CASE WHEN n = 1 OR {test} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS island, bool_or({test}) OVER (PARTITION BY id) AS has, sum(CASE WHEN {test} AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS more FROM l)
SELECT id AS {key}, CAST({fallback} AS INTEGER) AS chunk_index, md5(string_agg(line, chr(10) ORDER BY n)) AS content FROM m GROUP BY 1, 2"""


@query(_islands("documents", "doc_id", "starts_with(trim(line), '|')", "CASE WHEN has THEN island - 1 ELSE (n - 1) // 50 END"))
def chunk_blocks(spark, sf_dir):
    return _chunks(load(spark, sf_dir, "documents"), "doc_id", chunking.blocks(F.col("text"), "|"))


_CODE = "replace(text, '. ', '.' || chr(10) || 'def ')"


@query(_islands(f"(SELECT doc_id, {_CODE} AS text FROM documents)", "doc_id", "regexp_matches(line, '^\\s*(async\\s+def|def|class)\\s')", "CASE WHEN more > 0 THEN island - 1 ELSE (n - 1) // 50 END"))
def chunk_code(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\ndef ")).alias("text"))
    return _chunks(docs, "doc_id", chunking.code(F.col("text")))


@query("""WITH e AS (SELECT doc_id, 'From: ' || source || chr(10) || 'Lang: ' || lang AS head, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, CAST(0 AS INTEGER) AS chunk_index, md5(head) AS content FROM e UNION ALL SELECT doc_id, CAST(i + 1 AS INTEGER), md5(array_to_string(l[5 * i + 1:5 * i + 5], chr(10))) FROM e, unnest(range(0, (len(l) - 1) // 5 + 1)) AS t(i)""")
def chunk_email(spark, sf_dir):
    mail = F.concat(F.lit("From: "), "source", F.lit("\nLang: "), "lang", F.lit("\n\n"), "text")
    return _chunks(load(spark, sf_dir, "documents").select("doc_id", mail.alias("text")), "doc_id", chunking.email(F.col("text"), 5))


@query("""WITH e AS (SELECT conv_id, turn, 'BEGIN:VEVENT' || chr(10) || 'SUMMARY:' || role || chr(10) || replace(text, chr(10), ' ') || chr(10) || 'END:VEVENT' AS ev, role, text FROM conversations)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS chunk_index, md5('SUMMARY: ' || role || chr(10) || ev) AS content FROM e""")
def chunk_ics(spark, sf_dir):
    event = F.concat(F.lit("BEGIN:VEVENT\nSUMMARY:"), "role", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\nEND:VEVENT"))
    talks = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", event.alias("e")))), lambda s: s["e"]), "\n").alias("text"))
    return _chunks(talks, "conv_id", chunking.ics(F.col("text")))


@query("SELECT conv_id, md5(string_agg(trim(text), chr(10) || chr(10) ORDER BY turn, trim(text))) AS content FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def chunk_file_concat(spark, sf_dir):
    segments = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_idx"), "text")
    return chunking.whole_file(segments).select(F.col("file_id").alias("conv_id"), F.md5("text").alias("content"))


@query()
def chunk_semantic(spark, sf_dir):
    return chunking.packed(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "semantic", max_chars=1000, min_chars=200)


@query()
def chunk_recursive(spark, sf_dir):
    return chunking.packed(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "recursive", max_chars=1000, min_chars=20)


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
f(conv_id, i, n, first, cur, out_first, out_last, out) AS (
  SELECT conv_id, -1, n, 0, '', NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM t WHERE i = 0
  UNION ALL
  SELECT f.conv_id, t.i, f.n, CASE WHEN f.cur <> '' AND length(f.cur) + length(t.text) > 2000 THEN t.i ELSE f.first END,
    CASE WHEN f.cur = '' OR length(f.cur) + length(t.text) > 2000 THEN t.text ELSE f.cur || chr(10) || t.text END,
    CASE WHEN f.cur <> '' AND length(f.cur) + length(t.text) > 2000 THEN f.first END, t.i - 1, CASE WHEN f.cur <> '' AND length(f.cur) + length(t.text) > 2000 THEN f.cur END
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1),
c AS (SELECT conv_id, out_first AS first, out_last AS last, out AS content FROM f WHERE out IS NOT NULL UNION ALL SELECT conv_id, first, n - 1, cur FROM f WHERE i = n - 1 AND cur <> '')
SELECT conv_id AS file_id, row_number() OVER (PARTITION BY conv_id ORDER BY first) - 1 AS chunk_index, first, last, content FROM c""")
def chunk_cross_segment(spark, sf_dir):
    return chunking.packed_segments(load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_idx"), "text"))


_PLACED = """t AS (SELECT conv_id AS file_id, turn AS seg_idx, coalesce(text, '') AS text, turn // 4 AS page, turn * 1.5 AS start_time FROM conversations),
p AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY file_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM t),
s AS (SELECT *, a + length(text) AS b FROM p), n AS (SELECT file_id, max(b) AS n FROM s GROUP BY file_id),
c AS (SELECT file_id, chunk_index, chunk_index * 300 AS a, least(chunk_index * 300 + 350, n) AS b FROM n, unnest(range(0, (n + 299) // 300)) AS u(chunk_index))"""


@query(f"""WITH {_PLACED} SELECT file_id, chunk_index, c.a AS start, c.b AS "end", array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, array_to_string(list(start_time ORDER BY s.a), ',') AS times
FROM c JOIN s USING (file_id) WHERE c.a < s.b AND s.a < c.b GROUP BY ALL""")
def chunk_pages(spark, sf_dir):
    """Pages and times of overlapping chunks of 350 signs, by the binned range join with the turns they reach into."""
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_idx"), "text", F.expr("turn div 4").alias("page"), (F.col("turn") * 1.5).cast("double").alias("start_time"), F.lit(None).cast("double").alias("end_time"))
    segments = chunking.placed_segments(turns)
    size = segments.groupBy("file_id").agg(F.max("end").alias("n"))
    each = size.withColumn("chunk_index", F.explode(F.expr("CASE WHEN n > 0 THEN sequence(0L, (n - 1) div 300) ELSE array() END")))
    chunks = each.select("file_id", "chunk_index", (F.col("chunk_index") * 300).alias("start"), F.least(F.col("chunk_index") * 300 + 350, "n").alias("end"))
    found = chunking.with_provenance(chunks, segments, 512).where("page_numbers IS NOT NULL")
    return found.select("file_id", "chunk_index", "start", "end", F.array_join(F.transform("page_numbers", lambda x: x.cast("string")), ",").alias("pages"), F.array_join(F.transform("time_ranges", lambda x: x["start"].cast("string")), ",").alias("times"))


@query("SELECT doc_id AS id, true AS gives_back FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def chunk_offsets(spark, sf_dir):
    """For each document with text, whether the text from start to end gives back each chunk, of both methods, and the chunks leave out white space alone."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    out = None
    for method in ("semantic", "recursive"):
        made = chunking.packed(docs, method, max_chars=1000, min_chars=1).join(docs, "id")
        same = F.substring(F.col("text"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")) == F.col("content")
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda s: s["content"]), "")
        each = made.groupBy("id").agg((F.bool_and(same) & (F.md5(bare(whole)) == F.md5(bare(F.first("text"))))).alias("ok"))
        out = each if out is None else out.unionByName(each)
    return out.groupBy("id").agg(F.bool_and("ok").alias("gives_back"))


@query()
def chunk_router(spark, sf_dir):
    segments = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.when(F.col("conv_id") % 2 == 0, "txt").otherwise("md").alias("file_type"), F.col("turn").cast("int").alias("seg_idx"), "text", F.lit(None).cast("string").alias("summary"))
    return chunking.route(segments, {"txt": {"method": "line", "size": 20}, "md": {"method": "semantic"}})


@query("SELECT doc_id, md5(source || ':' || doc_id || ':' || md5(text)) AS chunk_id FROM documents")
def chunk_ids_md5(spark, sf_dir):
    from heliodor.functions.scalars import md5_id

    return load(spark, sf_dir, "documents").select("doc_id", md5_id(F.col("source"), F.col("doc_id").cast("string"), F.md5("text")).alias("chunk_id"))


@query("SELECT doc_id, CASE WHEN len(l) > 0 THEN round(least(len(list_filter(l, lambda x: regexp_matches(x, '^\\s*([-*+]|\\d+\\.)\\s+'))) / len(l), 1.0), 6) ELSE 0.0 END AS density FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)")
def list_density(spark, sf_dir):
    from heliodor.functions.text import list_density as density

    return load(spark, sf_dir, "documents").select("doc_id", F.round(density(F.col("text")), 6).alias("density"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def existing_ids_semi(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents", "labels")
    return docs.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_ids_anti(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents", "labels")
    return docs.join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("""WITH o AS (SELECT doc_id, 0 AS version, md5(text) AS h, 0 AS fresh FROM documents), n AS (SELECT doc_id, 1 + doc_id % 3 AS version, 'v' || (quality + toxic) AS h, 1 AS fresh FROM labels UNION ALL SELECT doc_id, 0, 'old', 1 FROM labels)
SELECT doc_id, CAST(version AS BIGINT) AS version, h FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fresh DESC, version DESC) AS n FROM (SELECT * FROM o UNION ALL SELECT * FROM n)) WHERE n = 1""")
def upsert_last_wins(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents", "labels")
    old = docs.select("doc_id", F.lit(0).cast("long").alias("version"), F.md5("text").alias("h"))
    new = labels.select("doc_id", (1 + F.col("doc_id") % 3).alias("version"), F.concat(F.lit("v"), (F.col("quality") + F.col("toxic")).cast("string")).alias("h"))
    return store.upsert_rows(old, new.unionByName(labels.select("doc_id", F.lit(0).cast("long").alias("version"), F.lit("old").alias("h"))), "doc_id", "version")
