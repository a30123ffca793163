"""Retrieval plans over batches of queries.

All take queries (query_id, question) and a Corpus and return hits (query_id, id, score, rank).
Loops are over steps, bounded, and advance all unfinished queries at once; each
step's state is checkpointed in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliodor.functions import text
from heliodor.functions.scalars import truncate
from heliodor.operators import rank, search
from heliodor.operators.textindex import TextIndex
from heliodor.plans.providers import HashingEmbedder, OverlapReranker, TemplateGenerator, query_text
from heliodor.storage import cut

NO_CONTEXT = "No relevant information was found."


@dataclass
class Corpus:
    """Chunks (id, text, file_id, page, chunk_index) with their vectors, the models that a plan may ask, and a stored full-text index if there is one."""

    chunks: DataFrame
    embedder: HashingEmbedder = field(default_factory=HashingEmbedder)
    reranker: OverlapReranker | None = None
    generator: object = field(default_factory=TemplateGenerator)
    index: TextIndex | None = None

    def points(self) -> DataFrame:
        return self.chunks if "vector" in self.chunks.columns else self.chunks.withColumn("vector", self.embedder.embed(F.col("text")))

    def dense(self, queries: DataFrame, k: int, column: str = "question") -> DataFrame:
        asked = queries.select("query_id", self.embedder.embed(query_text(F.col(column))).alias("vector"))
        return search.dense_topk(self.points(), asked, k)

    def bm25(self, queries: DataFrame, k: int, files: DataFrame | None = None, column: str = "question") -> DataFrame:
        if self.index is not None:
            kept = F.array_join(text.fts_tokens(F.col(column)), " ")
            return self.index.search(queries.select("query_id", kept.alias("text")), k, files)
        docs = self.chunks.select("id", text.words(F.col("text")).alias("tokens"))
        asked = queries.select("query_id", F.flatten(F.transform(text.fts_tokens(F.col(column)), text.words)).alias("tokens"))
        return search.bm25_topk(docs, asked, k, files)

    def rerank(self, queries: DataFrame, hits: DataFrame, k: int) -> DataFrame:
        """The k best by the reranker, or by their own score without one."""
        if self.reranker is None:
            return hits.where(F.col("rank") <= k)
        met = hits.join(self.chunks.select("id", "text"), "id").join(queries.select("query_id", "question"), "query_id")
        return rank.rerank(met, F.round(self.reranker.score(F.col("question"), F.col("text")), 6), k).select("query_id", "id", "score", "rank")


#: Cuts the lineage of a step.
_save = cut


def vector_search(queries: DataFrame, corpus: Corpus, k: int = 20, rerank_k: int = 5) -> DataFrame:
    hits = corpus.dense(queries, k)
    return corpus.rerank(queries, hits, rerank_k) if corpus.reranker else hits


def standard(queries: DataFrame, corpus: Corpus, k: int = 20, rerank_k: int = 5) -> DataFrame:
    return corpus.rerank(queries, corpus.dense(queries, k), rerank_k)


def hybrid(queries: DataFrame, corpus: Corpus, k: int = 100, rerank_k: int = 5, files: DataFrame | None = None) -> DataFrame:
    """Dense and full-text hits fused; files (query_id, id) restrict a query that has any."""
    lists = [corpus.dense(queries, k), corpus.bm25(queries, k)]
    if files is not None:
        named = files.select("query_id").distinct().withColumn("__named", F.lit(True))
        lists = [x.join(files.withColumn("__in", F.lit(True)), ["query_id", "id"], "left").join(named, "query_id", "left").where("__named IS NULL OR __in").drop("__in", "__named") for x in lists]
    return corpus.rerank(queries, rank.rrf(lists, k), rerank_k)


def simple(queries: DataFrame, corpus: Corpus, k: int = 10) -> DataFrame:
    """Dense hits, fused with the index's inner products where there is one, of max(10 k, 100) candidates each; the k best after reranking."""
    wide = max(10 * k, 100)
    lists = [corpus.dense(queries, wide)]
    if corpus.index is not None:
        lists.append(corpus.index.search(queries.select("query_id", F.col("question").alias("text")), wide, model="product", digits=6))
    hits = rank.rrf(lists, wide) if len(lists) > 1 else lists[0]
    return corpus.rerank(queries, hits, k)


def hyde(queries: DataFrame, corpus: Corpus, n: int = 4, k: int = 20, rerank_k: int = 5) -> DataFrame:
    """Search by the mean of the query's vector and those of n hypothetical documents."""
    vectors = queries.select("query_id", corpus.embedder.embed(query_text(F.col("question"))).alias("vector"))
    for i in range(n):
        made = corpus.generator.reply(queries, "hypothesis", i, F.concat(F.lit(f"Write passage {i} that answers: "), F.col("question")))
        vectors = vectors.unionByName(made.select("query_id", corpus.embedder.embed(F.col("reply")).alias("vector")))
    means = search.mean_vector(vectors.where("vector IS NOT NULL"), "query_id")
    return corpus.rerank(queries, search.dense_topk(corpus.points(), means, k), rerank_k)


def _graded(queries: DataFrame, corpus: Corpus, hits: DataFrame, step: int, threshold: float, cut: int) -> DataFrame:
    """Hits with the grade that the generator's reply gives each."""
    passages = hits.join(corpus.chunks.select("id", "text"), "id")
    listed = passages.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: F.concat(F.lit("Document "), s["rank"].cast("string"), F.lit(": "), truncate(s["text"], cut))), "\n").alias("context"))
    asked = queries.join(listed, "query_id")
    replies = corpus.generator.reply(asked, "grade", step, F.concat_ws("\n", F.lit("Grade each document from 0 to 1 as `Document i: score=x`."), "question", "context"))
    met = hits.join(replies.select("query_id", "reply"), "query_id")
    grade = F.when(F.col("reply").isNotNull(), rank.grade_from_reply(F.col("reply"), F.col("rank")))
    return rank.grade(met.withColumn("grade", grade).drop("reply"), threshold)


def _rewritten(queries: DataFrame, corpus: Corpus, step: int) -> DataFrame:
    replies = corpus.generator.reply(queries, "rewrite", step, F.concat(F.lit("Rewrite the query to find better documents: "), F.col("question")))
    new = text.strip_rewrite_prefix(F.col("reply"))
    return replies.withColumn("question", F.when(new != "", new).otherwise(F.col("question"))).drop("reply")


def self_reflective(queries: DataFrame, corpus: Corpus, k: int = 20, steps: int = 2, threshold: float = 0.5, rerank_k: int = 5) -> DataFrame:
    """Retrieve and grade; queries without a relevant hit are rewritten and asked again. What never finds one keeps its first 5."""
    active, found, last = queries, None, None
    for step in range(steps):
        graded = _save(_graded(active, corpus, corpus.dense(active, k), step, threshold, 500))
        good = graded.where("is_relevant")
        found = good if found is None else found.unionByName(good)
        last = graded if last is None else last.join(graded.select("query_id").distinct(), "query_id", "left_anti").unionByName(graded)
        active = _save(_rewritten(queries.join(active.join(good.select("query_id").distinct(), "query_id", "left_anti").select("query_id"), "query_id", "left_semi"), corpus, step))
        if not active.limit(1).count():
            break
    rest = last.join(found.select("query_id").distinct(), "query_id", "left_anti").where("rank <= 5")
    return search.top_ranked(found.select("query_id", "id", "score").unionByName(rest.select("query_id", "id", "score")), rerank_k)


def graded(queries: DataFrame, corpus: Corpus, k: int = 20, rewrites: int = 2, threshold: float = 0.5, rerank_k: int = 5) -> DataFrame:
    """Routing first: greetings and thanks retrieve nothing; the rest as self_reflective with rewrites + 1 attempts."""
    return self_reflective(queries.where(text.needs_retrieval(F.col("question"))), corpus, k, rewrites + 1, threshold, rerank_k)


def corrective(queries: DataFrame, corpus: Corpus, k: int = 20, upper: float = 0.5, lower: float = -0.5, rerank_k: int = 5) -> DataFrame:
    """By the verdict on the hits: keep them, retrieve again with a rewritten query, or both one after the other."""
    first = _save(corpus.rerank(queries, corpus.dense(queries, k), k).join(corpus.chunks.select("id", "text"), "id").join(queries, "query_id"))
    scored = first.withColumn("confidence", 2 * OverlapReranker().score(F.col("question"), F.col("text")) - 1)
    verdicts = scored.groupBy("query_id").agg(F.collect_list("confidence").alias("s")).select("query_id", rank.verdict(F.col("s"), upper, lower).alias("verdict"))
    tagged = queries.join(verdicts, "query_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("incorrect")))
    again = corpus.dense(_rewritten(tagged.where("verdict <> 'correct'"), corpus, 0), k)
    kept = scored.join(tagged.where("verdict <> 'incorrect'").select("query_id"), "query_id", "left_semi").where(F.col("confidence") >= lower)
    merged = rank.append_dedup([kept.select("query_id", "id", "rank"), again.select("query_id", "id", "rank")])
    scores = kept.select("query_id", "id", "score").unionByName(again.select("query_id", "id", "score")).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return merged.where(F.col("place") <= rerank_k).join(scores, ["query_id", "id"]).select("query_id", "id", "score", F.col("place").alias("rank"))


def interleaved(queries: DataFrame, corpus: Corpus, k: int = 6, steps: int = 10, cap: int = 15) -> DataFrame:
    """Retrieve, add a sentence of reasoning, and ask with the last sentence that isn't reasoning, until an answer or the caps."""
    active = queries.withColumn("ask", F.col("question"))
    found = None
    for step in range(steps):
        hits = corpus.dense(active, k, "ask").withColumn("step", F.lit(step))
        found = _save(hits if found is None else found.unionByName(hits))
        replies = corpus.generator.reply(active, "thought", step, F.concat(F.lit("Think one sentence on: "), F.col("question")))
        said = text.first_sentence(F.coalesce("reply", F.lit("")))
        full = rank.accumulate_unique(found, cap).groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= cap).select("query_id")
        nxt = replies.withColumn("said", said).where((F.col("said") != "") & text.answer_found(F.col("said")).isNull())
        nxt = nxt.withColumn("ask", F.when(text.is_reasoning(F.col("said")), F.col("question")).otherwise(F.col("said"))).drop("reply", "said")
        active = _save(nxt.join(full, "query_id", "left_anti"))
        if not active.limit(1).count():
            break
    return rank.accumulate_unique(found, cap).select("query_id", "id", "score", F.col("place").alias("rank"))


def decomposed(queries: DataFrame, corpus: Corpus, k: int = 20, most: int = 4, rerank_k: int = 5) -> DataFrame:
    """Sub-questions in turn, each with the last answer's begin; hits keep their best score."""
    split = corpus.generator.reply(queries, "decompose", 0, F.concat(F.lit("Split into numbered sub-questions: "), F.col("question")))
    subs = text.numbered_list(F.col("reply"), most)
    state = _save(split.withColumn("subs", F.when(F.size(subs) > 0, subs).otherwise(F.array("question"))).withColumn("last", F.lit("")).drop("reply"))
    found = None
    for step in range(most):
        active = state.where(F.size("subs") > step).withColumn("ask", F.trim(F.concat_ws(" ", F.get("subs", F.lit(step)), F.substring("last", 1, 80))))
        hits = corpus.dense(active, k, "ask").withColumn("step", F.lit(step))
        found = hits if found is None else found.unionByName(hits)
        replies = corpus.generator.reply(active, "answer", step, F.concat(F.lit("Answer: "), F.col("ask")))
        state = state.drop("last").join(replies.select("query_id", F.col("reply").alias("last")), "query_id", "left").withColumn("last", F.coalesce("last", F.lit("")))
    best = search.top_ranked(rank.accumulate_max(found).select("query_id", "id", "score"), k)
    return corpus.rerank(queries, best, rerank_k)


def adaptive(queries: DataFrame, corpus: Corpus, k: int = 20, rerank_k: int = 5) -> DataFrame:
    """A plan by complexity: A dense alone, B with reranking (the default), C in steps."""
    replies = corpus.generator.reply(queries, "classify", 0, F.concat(F.lit("Classify as A, B or C: "), F.col("question")))
    tagged = _save(replies.withColumn("level", text.complexity(F.coalesce("reply", F.lit("")))).drop("reply"))
    of = lambda level: tagged.where(F.col("level") == level).drop("level")
    parts = [corpus.dense(of("A"), rerank_k), standard(of("B"), corpus, k, rerank_k), interleaved(of("C"), corpus, 6, 3, 15)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


PLANS = {"simple": simple, "vector": vector_search, "standard": standard, "hybrid": hybrid, "hyde": hyde, "self": self_reflective, "graded": graded, "corrective": corrective, "interleaved": interleaved, "decomposed": decomposed, "adaptive": adaptive, "none": None}


def contexts(hits: DataFrame, chunks: DataFrame, most: int = 10, titled: bool = False) -> DataFrame:
    """query_id, context: `[i] (Source: file)` and text of the first hits, or with titled `Doc i(Title: file) text`."""
    met = hits.where(F.col("rank") <= most).join(chunks.select("id", "text", "file_id"), "id")
    begin, middle, end = ("Doc ", "(Title: ", ") ") if titled else ("[", "] (Source: ", ")\n")
    line = lambda s: F.concat(F.lit(begin), s["rank"].cast("string"), F.lit(middle), s["file_id"].cast("string"), F.lit(end), s["text"])
    return met.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_id", "text"))), line), "\n\n").alias("context"))


def answer(queries: DataFrame, hits: DataFrame, corpus: Corpus, template: str = "Context:\n{context}\n\nQuestion: {question}") -> DataFrame:
    """query_id, question, answer; queries without a hit get a fixed answer."""
    asked = queries.join(contexts(hits, corpus.chunks), "query_id", "left")
    prompt = F.replace(F.replace(F.lit(template), F.lit("{context}"), F.coalesce("context", F.lit(""))), F.lit("{question}"), F.col("question"))
    replies = corpus.generator.reply(asked, "answer", 0, prompt)
    return replies.select("query_id", "question", F.when(F.col("context").isNull(), F.lit(NO_CONTEXT)).otherwise(F.col("reply")).alias("answer"))


def run(queries: DataFrame, corpus: Corpus, plan: str = "standard", pages: int = 0, profile: DataFrame | None = None) -> DataFrame:
    """query_id, question, answer by a plan: with pages, hits grow to their pages; a profile (query_id, text) goes before the context."""
    hits = PLANS[plan](queries, corpus) if PLANS[plan] else queries.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    chunks = corpus.chunks.select("id", "text", "file_id")
    if pages:
        grown = rank.expand_pages(hits, corpus.chunks, pages)
        hits = grown.select("query_id", F.xxhash64("query_id", "file_id", "page").alias("id"), "score", "rank")
        chunks = grown.select(F.xxhash64("query_id", "file_id", "page").alias("id"), "text", "file_id")
    if profile is not None:
        hits = hits.withColumn("rank", F.col("rank") + 1).unionByName(profile.select("query_id", F.xxhash64("query_id", "text").alias("id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank")))
        chunks = chunks.unionByName(profile.select(F.xxhash64("query_id", "text").alias("id"), "text", F.lit(0).cast(chunks.schema["file_id"].dataType).alias("file_id")))
    return answer(queries, hits, Corpus(chunks, corpus.embedder, corpus.reranker, corpus.generator))


def last_action(reply: Column) -> Column:
    """struct<action, argument> of the last `Action: search[..]` or `finish[..]` of a reply."""
    kinds = F.regexp_extract_all(reply, F.lit(r"(?i)Action:\s*(search|finish)\[(.*?)\]"), F.lit(1))
    args = F.regexp_extract_all(reply, F.lit(r"(?i)Action:\s*(search|finish)\[(.*?)\]"), F.lit(2))
    return F.when(F.size(kinds) > 0, F.struct(F.lower(F.element_at(kinds, -1)).alias("action"), F.trim(F.element_at(args, -1)).alias("argument")))


def react(queries: DataFrame, corpus: Corpus, turns: int = 5, k: int = 5, parse: Callable[[Column], Column] = last_action, nudge: str = "Use Action: search[..] or finish[..].", titled: bool = False) -> DataFrame:
    """query_id, answer, turns of a search-or-finish loop; a malformed reply is asked again, the cap ends it without an answer."""
    state = queries.withColumn("trace", F.col("question")).withColumn("answer", F.lit(None).cast("string")).withColumn("turns", F.lit(0))
    for step in range(turns):
        replies = corpus.generator.reply(state.where("answer IS NULL"), "react", step, F.col("trace")).withColumn("act", parse(F.coalesce("reply", F.lit(""))))
        replies = _save(replies.withColumn("answer", F.when(F.col("act.action") == "finish", F.col("act.argument"))))
        asked = replies.where("act.action = 'search'").select("query_id", F.col("act.argument").alias("question"))
        seen = contexts(corpus.dense(asked, k), corpus.chunks, titled=titled)
        told = F.when(F.col("act").isNull(), nudge).otherwise(F.coalesce("context", F.lit("")))
        after = replies.join(seen, "query_id", "left").withColumn("trace", F.concat_ws("\n", "trace", "reply", told)).withColumn("turns", F.lit(step + 1)).select(*state.columns)
        state = _save(state.where("answer IS NOT NULL").unionByName(after))
        if not state.where("answer IS NULL").limit(1).count():
            break
    return state.select("query_id", "answer", "turns")


def tagged_action(reply: Column) -> Column:
    """struct<action, argument> of `<answer>` or `<search>` tags."""
    answer_, asked = F.regexp_extract(reply, r"(?is)<answer>(.*?)</answer>", 1), F.regexp_extract(reply, r"(?is)<search>(.*?)</search>", 1)
    return F.when(answer_ != "", F.struct(F.lit("finish").alias("action"), F.trim(answer_).alias("argument"))).when(asked != "", F.struct(F.lit("search").alias("action"), F.trim(asked).alias("argument")))


def tagged_loop(queries: DataFrame, corpus: Corpus, turns: int = 10, k: int = 3) -> DataFrame:
    """react() with `<search>` and `<answer>` tags, and passages as titled documents."""
    return react(queries, corpus, turns, k, tagged_action, "Use <search>..</search> or <answer>..</answer>.", True)


def index(segments: DataFrame, store, chunk, embedder: HashingEmbedder) -> None:
    """Chunk segments, embed the chunks that the store doesn't have, and add them."""
    fresh = store.missing(chunk(segments))
    store.upsert(fresh.withColumn("vector", embedder.embed(F.col("content"))))


def numbered(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))
