"""Payloads of stored points and records of results, from JSON of either shape, with the keys that nothing knows kept.

A payload is a VARIANT: its keys are read by path, so one plan takes the nested and the flat
shape, and what is left over is a map from key to JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliodor.functions.scalars import let

# The keys of a flat payload that have a place in the record.
FLAT = ("chunk", "text", "metadata", "extension", "file_id", "path", "full_path", "file_name", "kind", "page_num", "_rc_chunk_index", "char_count", "token_count")
# The keys of a nested payload, and of its metadata, that have a place.
NESTED, METADATA = ("chunk", "text", "metadata"), ("file_info", "segment_info", "chunk_meta")
_RANGES = "array<struct<start:double,end:double>>"


def variant(json: Column) -> Column:
    """Text as a VARIANT; text that is no JSON object is an empty one."""
    parsed = F.try_parse_json(json)
    return F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), parsed).otherwise(F.parse_json(F.lit("{}")))


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _some(*values: Column) -> Column:
    """The first of the texts that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def _rest(v: Column, known: tuple[str, ...]) -> Column:
    """The keys of an object that are not known, as map<string, string> of JSON."""
    each = F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.transform_values(F.map_filter(each, lambda k, _: ~k.isin(*known)), lambda _, x: F.coalesce(F.to_json(x), F.lit("null")))


def project(payload: Column) -> Column:
    """struct<content, file_info, segment_info, chunk_meta, extra> of a VARIANT payload, nested (`chunk`, `metadata`) or flat."""

    def of(v: Column) -> Column:
        content = F.coalesce(_some(_at(v, "$.chunk"), _at(v, "$.text")), F.lit(""))
        filled = F.coalesce(F.size(F.try_variant_get(v, "$.metadata", "map<string,variant>")) > 0, F.lit(False))
        pick = lambda nested, flat: F.when(filled, nested).otherwise(flat)
        text = lambda c, default: F.coalesce(c, F.lit(default))
        extension = F.regexp_replace(text(_at(v, "$.extension"), ""), r"^\.+", "")
        file_info = F.struct(
            text(pick(_at(v, "$.metadata.file_info.file_id"), _at(v, "$.file_id")), "unknown").alias("file_id"),
            text(pick(_at(v, "$.metadata.file_info.file_path"), _some(_at(v, "$.path"), _at(v, "$.full_path"))), "").alias("file_path"),
            text(pick(_at(v, "$.metadata.file_info.file_name"), _at(v, "$.file_name")), "").alias("file_name"),
            text(pick(_at(v, "$.metadata.file_info.file_type"), _some(extension, _at(v, "$.kind"))), "text").alias("file_type"),
        )
        nothing = lambda kind: F.array().cast(kind)
        page = _at(v, "$.page_num", "bigint")
        segment_info = F.struct(
            F.coalesce(pick(_at(v, "$.metadata.segment_info.segment_indices", "array<bigint>"), nothing("array<bigint>")), nothing("array<bigint>")).alias("segment_indices"),
            F.coalesce(pick(_at(v, "$.metadata.segment_info.page_numbers", "array<bigint>"), F.when(page.isNotNull(), F.array(page))), nothing("array<bigint>")).alias("page_numbers"),
            F.coalesce(pick(_at(v, "$.metadata.segment_info.time_ranges", _RANGES), nothing(_RANGES)), nothing(_RANGES)).alias("time_ranges"),
        )
        has_meta = _at(v, "$.metadata.chunk_meta", "variant").isNotNull()
        size = F.length(content).cast("long")
        chunk_meta = F.struct(
            text(pick(_at(v, "$.metadata.chunk_meta.type"), _some(_at(v, "$.kind"))), "content").alias("type"),
            F.coalesce(pick(_at(v, "$.metadata.chunk_meta.chunk_index", "bigint"), _at(v, "$._rc_chunk_index", "bigint")), F.lit(0)).cast("long").alias("chunk_index"),
            F.coalesce(pick(F.when(has_meta, _at(v, "$.metadata.chunk_meta.char_count", "bigint")).otherwise(size), _at(v, "$.char_count", "bigint")), F.lit(0)).cast("long").alias("char_count"),
            F.coalesce(pick(_at(v, "$.metadata.chunk_meta.token_count", "bigint"), _at(v, "$.token_count", "bigint")), F.lit(0)).cast("long").alias("token_count"),
        )
        inner = _rest(F.try_variant_get(v, "$.metadata", "variant"), METADATA)
        outer = pick(_rest(v, NESTED), _rest(v, FLAT))
        # a key that stands both inside and outside is the inner one's
        extra = pick(F.map_concat(F.map_filter(outer, lambda k, _: ~F.map_contains_key(inner, k)), inner), outer)
        return F.struct(content.alias("content"), file_info.alias("file_info"), segment_info.alias("segment_info"), chunk_meta.alias("chunk_meta"), extra.alias("extra"))

    return let(payload, of)


def result_records(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query_id, retrieved_chunks (rank from 1, id, content, score, metadata) and retrieved_file_list of hits (query_id, id, score, rank, payload as JSON text).

    A file is named by its path, else its name, else its id, once, where it is first seen. queries (query_id, ...): a record for each, without hits too."""
    each = hits.select("query_id", "rank", "id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), project(variant(F.col("payload"))).alias("p"))
    chunk = F.struct("rank", "id", F.col("p.content").alias("content"), "score", F.struct("p.file_info", "p.segment_info", "p.chunk_meta", "p.extra").alias("metadata"))
    earlier = lambda a, b: (a["rank"] < b["rank"]) | ((a["rank"] == b["rank"]) & (a["id"] < b["id"]))
    in_order = lambda a, b: F.when(earlier(a, b), -1).when(earlier(b, a), 1).otherwise(0)  # noqa: E731  maps have no order of their own
    made = each.groupBy("query_id").agg(F.array_sort(F.collect_list(chunk), in_order).alias("c"))  # a query's top k
    numbered = F.transform("c", lambda x, i: F.struct((i + 1).alias("rank"), x["id"].alias("id"), x["content"].alias("content"), x["score"].alias("score"), x["metadata"].alias("metadata")))
    info = lambda x: x["metadata"]["file_info"]
    named = F.transform("c", lambda x: _some(info(x)["file_path"], info(x)["file_name"], info(x)["file_id"]))
    out = made.select("query_id", numbered.alias("retrieved_chunks"), F.array_distinct(F.filter(named, lambda n: n.isNotNull())).alias("retrieved_file_list"))
    if queries is None:
        return out
    kinds = dict(out.dtypes)
    empty = lambda c: F.coalesce(c, F.array().cast(kinds[c])).alias(c)
    return queries.join(out, "query_id", "left").select(*queries.columns, empty("retrieved_chunks"), empty("retrieved_file_list"))
