"""Operator 3: language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled texts. A
text gets the language whose dictionary compresses it to the fewest bytes; the
gap to the second language, as a share of the largest size, is the score, and a
text with a score under `margin` is rejected.

A text is compressed in pieces of `PIECE` bytes, each of which begins anew from the
dictionary, and its size is their sum: a long text would otherwise soon be its own
dictionary, and the score would fall with its length.

Dictionaries and texts are compressed as their lower-cased runs of letters, so that
shouting, markup and numbers do not decide.

Fitting reads a bounded sample: of each language the `per_lang` documents with
the lowest hash of doc_id that are not held out, cut at `dict_bytes`. Nothing
else is bounded, and all pieces of a text are compressed.

Defined cases: a text that is null or has no letter is `und` with score 0 and
is rejected; equal sizes go to the language first in byte order, with score 0;
rows without a language are not learned from; with no labelled row at all every
text is `und`. Extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliodor.llm.common import documents, slices, tidy

#: Bounds of the sample that dictionaries are made of, and zstandard's level.
PER_LANG, DICT_BYTES, LEVEL = 400, 110 << 10, 9
#: Bytes of letters that are compressed from the dictionary at a time.
PIECE = 8 << 10
#: Bytes of text that a worker holds as strings at a time (a longer text alone).
SLICE = 1 << 20
#: Texts whose score is lower are rejected.
MARGIN = 0.01
#: The most languages that a model can have; more is an error, so that the model's size is bounded.
MOST_LANGS = 500


_LETTERS = re.compile(r"[^\W\d_]+")


def letters_of(text: str) -> bytes:
    return " ".join(_LETTERS.findall(text.lower())).encode()


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Language -> dictionary content, from the rows of docs that have doc_id, text and lang."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("lang", "doc_id").withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_lang)
    # A sample of at most per_lang rows a language: its size is bounded whatever docs holds.
    texts = rows.join(F.broadcast(chosen.select("lang", "doc_id").distinct()), ["lang", "doc_id"])
    # A dictionary holds dict_bytes, so no more of one sampled text is of use.
    texts = texts.select("lang", "doc_id", F.substring("text", 1, 2 * dict_bytes).alias("part"))
    ranked = texts.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_lang)
    before = Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("before", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)))
    out: dict[str, list] = {}
    for lang, n, part in ranked.where(F.col("before") < 4 * dict_bytes).select("lang", "n", "part").collect():
        out.setdefault(lang, []).append((n, letters_of(part)))
    if len(out) > MOST_LANGS:
        raise ValueError(f"{len(out)} languages; a model has {MOST_LANGS} at most")
    return {lang: b"\n".join(p for _, p in sorted(parts))[:dict_bytes] for lang, parts in sorted(out.items())}


def predict(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN, keep: list[str] | None = None, accepted: bool = False) -> DataFrame:
    """The columns `keep` of docs (doc_id by default), then lang_pred, score and rejected; with accepted, of the rows that are not rejected the columns `keep` alone."""
    keep = ["doc_id"] if keep is None else keep
    content = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    if not accepted:
        schema = schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches):
        import zstandard

        langs = list(content.value)
        made = [zstandard.ZstdCompressionDict(content.value[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in langs]
        for d in made:
            d.precompute_compress(level=LEVEL)
        packers = [zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False) for d in made]
        for batch in (part for whole in batches for part in slices(whole, SLICE)):
            text = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_pylist()
            best, score = [], []
            for t, has in zip(text.to_pylist(), letters, strict=True):
                if not has or not langs:
                    best.append("und")
                    score.append(0.0)
                    continue
                content_of = letters_of(t)
                pieces = [content_of[i : i + PIECE] for i in range(0, len(content_of), PIECE)]
                sizes = [sum(len(p.compress(x)) for x in pieces) for p in packers]
                low = min(sizes)
                at = sizes.index(low)
                second = min((s for i, s in enumerate(sizes) if i != at), default=max(low, 1) * 2)
                best.append(langs[at])
                score.append((second - low) / max(second, 1))
            rejected = [s < margin or b == "und" for b, s in zip(best, score, strict=True)]
            if accepted:
                yield batch.select(keep).filter(pa.array([not r for r in rejected], pa.bool_()))
                continue
            found = (pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], [*keep, "lang_pred", "score", "rejected"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(tidy(run), schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
