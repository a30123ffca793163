"""A dictionary of names and their aliases, and the longest alias that a text holds.

Aliases are put into automata once, on each worker, and a text is read once by each, however many
aliases there are. One automaton holds a bounded number of them; a larger dictionary is
dealt to several by a hash, and the best of their finds is taken.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from heliodor.functions.text import ALIASES, company_code

#: Aliases of one automaton, at most (some 300 bytes each on a worker, 60 in the broadcast).
ENTRIES = 200_000
#: Automata that a worker keeps.
KEPT = 8
#: Fixed value: aliases of so many signs at most need neighbours that are no letters.
SHORT = 3
_FOUND = StructType([StructField("size", LongType()), StructField("place", LongType()), StructField("alias", StringType()), StructField("code", StringType())])


def company_dictionary(files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """alias, code, place: of each file's name the company code as it is, without underscores and with spaces for them, then fixed aliases, which replace equal ones."""
    base = F.regexp_replace("name", r"\.[^.]*$", "")
    codes = files.select(F.upper(company_code(base)).alias("code")).where("code IS NOT NULL").distinct()
    forms = F.array(F.lower("code"), F.lower(F.replace("code", F.lit("_"), F.lit(""))), F.lower(F.replace("code", F.lit("_"), F.lit(" "))))
    own = codes.select("code", F.explode(F.array_distinct(forms)).alias("alias")).groupBy("alias").agg(F.min("code").alias("code"))
    spark = files.sparkSession
    given = spark.createDataFrame([(a.lower(), c, i) for i, (a, c) in enumerate((ALIASES if aliases is None else aliases).items())], "alias string, code string, nth long")
    met = own.withColumnRenamed("code", "own").join(given, "alias", "full_outer")
    order = F.coalesce(F.col("nth") + F.lit(1 << 62), F.pmod(F.xxhash64("alias"), F.lit(1 << 62)))
    return met.select("alias", F.coalesce("code", "own").alias("code"), order.alias("place"))


class _Automata:
    """For long aliases one automaton over the lower-cased text, and for short ones one over its letters, spaced."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        import ahocorasick

        self.long, self.short = ahocorasick.Automaton(), ahocorasick.Automaton()
        for alias, code, place in rows:
            if len(alias) > SHORT:
                self.long.add_word(alias, (len(alias), -place, alias, code))
            elif alias:
                self.short.add_word(f" {alias} ", (len(alias), -place, alias, code))
        for one in (self.long, self.short):
            if len(one):
                one.make_automaton()

    def best(self, text: str, spaced: str):
        """The longest alias, and of equals the first by place, then by name."""
        found = None
        for one, given in ((self.long, text), (self.short, spaced)):
            if len(one):
                for _, hit in one.iter(given):
                    if found is None or hit[:2] > found[:2] or (hit[:2] == found[:2] and hit[2] < found[2]):
                        found = hit
        return found


_HELD: dict[str, _Automata] = {}


def longest_alias(text: Column, entries: DataFrame) -> Column:
    """struct<size, place, alias, code> of the longest alias of entries (alias, code, place) that the text holds; of equal lengths the least place, then the first by name."""
    rows = [tuple(r) for r in entries.select(F.lower("alias"), "code", F.col("place").cast("long")).where("alias IS NOT NULL").collect()]  # ENTRIES at most
    held, name = entries.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array, spaced: pa.Array) -> pa.Array:
        if name not in _HELD:
            if len(_HELD) >= KEPT:
                _HELD.clear()
            _HELD[name] = _Automata(held.value)
        own = _HELD[name]
        hits = [own.best(t, s) if t is not None else None for t, s in zip(texts.to_pylist(), spaced.to_pylist(), strict=True)]
        return pa.array([h and {"size": h[0], "place": -h[1], "alias": h[2], "code": h[3]} for h in hits], pa.struct([("size", pa.int64()), ("place", pa.int64()), ("alias", pa.string()), ("code", pa.string())]))

    lower = F.lower(text)
    return find(lower, F.concat(F.lit(" "), F.regexp_replace(lower, "[^a-z&]+", " "), F.lit(" ")))


def match_aliases(rows: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """rows with alias and code: of the longest alias that the column's text holds, null if there is none."""
    total = entries.count()
    shards = -(-total // ENTRIES) or 1
    finds = [longest_alias(F.col(column), entries.where(F.pmod(F.xxhash64("alias"), F.lit(shards)) == k) if shards > 1 else entries) for k in range(shards)]
    out = rows.select("*", *[f.alias(f"__f{k}") for k, f in enumerate(finds)])
    # the greatest size, then the least place, then the least name
    best = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"__f{k}.size")).alias("a"), F.col(f"__f{k}.place").alias("b"), F.col(f"__f{k}.alias").alias("alias"), F.col(f"__f{k}.code").alias("code")) for k in range(shards)]), lambda s: s["alias"].isNotNull()))
    return out.withColumn("__best", F.get(best, 0)).select(*rows.columns, F.col("__best.alias").alias("alias"), F.col("__best.code").alias("code"))


def known_names(replies: DataFrame, files: DataFrame) -> DataFrame:
    """query_id, name, in the reply's order (place): the names in a model's JSON list that files (name) has; each once."""
    from heliodor.functions.text import selected_names

    each = replies.select("query_id", F.posexplode(selected_names(F.col("reply"))).alias("place", "name"))
    first = each.groupBy("query_id", "name").agg(F.min("place").alias("place"))
    return first.join(files.select("name").distinct(), "name", "left_semi").select("query_id", "name", "place")
