"""Chunking: files' segments to chunks.

Methods whose pieces follow from lines or patterns are array expressions. Those that
pack greedily (semantic, recursive, cross-segment, json) run one text at a time in Arrow batches.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliodor.functions.scalars import let, time_value

# What starts a block of Python or shell code.
CODE_START = {"py": r"^\s*(async\s+def|def|class)\s", "sh": r"^\s*(function\s+\w+|\w+\s*\(\)\s*\{?)"}
COLUMNAR = ("line", "block", "code", "email", "ics", "segment")
PACKED = ("json", "semantic", "recursive")


def lines(text: Column, size: int, overlap: int = 0, header: int = 0) -> Column:
    """Windows of `size` lines with `overlap`; trailing partial windows stay. The first `header` lines go before each later window."""

    def windows(each: Column) -> Column:
        def window(i: Column) -> Column:
            body = F.slice(each, i + 1, F.lit(size))
            return F.array_join(F.when(i > 0, F.concat(F.slice(each, 1, header), body)).otherwise(body) if header else body, "\n")

        return F.transform(F.sequence(F.lit(0), F.size(each) - 1, F.lit(max(1, size - overlap))), window)

    return let(F.split(text, "\n"), windows)


def islands(text: Column, starts: Column) -> Column:
    """Blocks of lines, each beginning at a line that `starts` (a lambda over a line) holds for."""

    def parted(each: Column) -> Column:
        place = F.filter(F.transform(each, lambda x, i: F.when((i == 0) | starts(x), i)), lambda i: i.isNotNull())
        return let(place, lambda p: F.transform(p, lambda i, n: F.array_join(F.slice(each, i + 1, F.coalesce(F.get(p, n + 1), F.size(each)) - i), "\n")))

    return let(F.split(text, "\n"), parted)


def grouped(pieces: Column, size: int) -> Column:
    """Runs of `size` pieces, joined by line breaks."""
    return let(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(size)), lambda i: F.array_join(F.slice(p, i, F.lit(size)), "\n")))


def blocks(text: Column, delimiter: str, size: int = 1, line_size: int = 50, overlap: int = 0) -> Column:
    """Blocks that a line starting with the delimiter begins, `size` to a chunk; without one, by lines."""
    each = islands(text, lambda x: F.startswith(F.trim(x), F.lit(delimiter)))
    has = F.exists(F.split(text, "\n"), lambda x: F.startswith(F.trim(x), F.lit(delimiter)))
    return F.when(has, grouped(each, size)).otherwise(lines(text, line_size, overlap))


def code(text: Column, language: str = "py", size: int = 1, line_size: int = 50, overlap: int = 0) -> Column:
    each = islands(text, lambda x: F.rlike(x, F.lit(CODE_START[language])))
    return F.when(F.size(each) > 1, grouped(each, size)).otherwise(lines(text, line_size, overlap))


def email(text: Column, size: int = 50, overlap: int = 0) -> Column:
    """The header, then the body by lines."""
    parts = F.split(text, "\n\n", 2)
    return F.when(F.size(parts) > 1, F.concat(F.array(parts[0]), lines(F.get(parts, F.lit(1)), size, overlap))).otherwise(lines(text, size, overlap))


def ics(text: Column) -> Column:
    """Each event, headed by its summary; the whole text if there is none."""
    events = F.regexp_extract_all(text, F.lit(r"(?s)(BEGIN:VEVENT.*?END:VEVENT)"), F.lit(1))

    def headed(e: Column) -> Column:
        summary = F.regexp_extract(e, r"(?m)^SUMMARY:(.*)$", 1)
        return F.when(summary == "", e).otherwise(F.concat(F.lit("SUMMARY: "), F.trim(summary), F.lit("\n"), e))

    return F.when(F.size(events) > 0, F.transform(events, headed)).otherwise(F.array(text))


def whole_file(segments: DataFrame) -> DataFrame:
    """file_id, text: stripped non-empty segments (file_id, seg_idx, text) joined by blank lines."""
    good = segments.withColumn("text", F.trim("text")).where("text <> ''")
    return good.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda s: s["text"]), "\n\n").alias("text"))


def file_chunks(segments: DataFrame, max_chars: int | None = None) -> DataFrame:
    """file_id, chunk_index, content, start, end: whole files (file_id long), those over max_chars split by the semantic method."""
    files = whole_file(segments)
    long = F.length("text") > max_chars if max_chars else F.lit(False)
    short = files.where(~long).select("file_id", F.lit(0).cast("long").alias("chunk_index"), F.col("text").alias("content"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"))
    return short.unionByName(packed(files.where(long).withColumnRenamed("file_id", "id"), "semantic", max_chars=max_chars).withColumnRenamed("id", "file_id")) if max_chars else short


def provenance(segment: Column) -> Column:
    """struct<start, end, page> of a segment (start, end, start_time, end_time, page_number, page)."""
    return F.struct(F.coalesce(time_value(segment["start"]), segment["start_time"]).alias("start"), F.coalesce(time_value(segment["end"]), segment["end_time"]).alias("end"), F.coalesce(segment["page_number"], segment["page"]).alias("page"))


def embed_text(content: Column, file_info: Column | None = None, segment_info: Column | None = None) -> Column:
    parts = [F.to_json(F.struct(c.alias(n))) for n, c in (("file_info", file_info), ("segment_info", segment_info)) if c is not None]
    return F.concat_ws("\n\n", *parts, content)


def coerce_content(df: DataFrame) -> DataFrame:
    """Chunks (file_id, chunk_index, chunk_id, content): null content becomes empty with a placeholder id."""
    empty = F.md5(F.concat_ws(":", "file_id", F.lit("empty"), F.col("chunk_index").cast("string")))
    return df.withColumn("chunk_id", F.when(F.col("content").isNull(), empty).otherwise(F.col("chunk_id"))).withColumn("content", F.coalesce("content", F.lit("")))


def overrides(given: str) -> dict[str, str]:
    """`k=v,k2=v2` or a JSON object."""
    given = (given or "").strip()
    if not given:
        return {}
    if given.startswith("{"):
        return {str(k): str(v) for k, v in json.loads(given).items()}
    return dict(tuple(p.strip() for p in part.split("=", 1)) for part in given.split(",") if "=" in part)


# Sequential methods, of one text.

_FENCE = re.compile(r"```.*?```|\[TABLE\].*?\[/TABLE\]", re.S)
_LIST = re.compile(r"^\s*([-*+]|\d+\.)\s+")
_SENTENCE = re.compile(r"[^.!?。！？；]*[.!?。！？；]+[\s\n]*|[^.!?。！？；]+$", re.S)


def estimate(text: str) -> int:
    cjk = len(re.findall("[一-鿿]", text))
    return max(int((len(text) - cjk) / 2.7) + cjk, int(len(text.split()) * 1.2))


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without white space at its ends."""
    while a < b and text[a].isspace():
        a += 1
    while a < b and text[b - 1].isspace():
        b -= 1
    return a, b


def section_spans(text: str, least: int = 300) -> list[tuple[int, int]]:
    """Spans from each header line to the next; a short preamble goes to the first."""
    heads = [m.start() for m in re.finditer(r"^#+\s+.*$", text, re.M)]
    if not heads:
        return [(0, len(text))]
    if text[: heads[0]].strip():
        heads = [0, *heads] if heads[0] > least else [0, *heads[1:]]
    return list(zip(heads, [*heads[1:], len(text)], strict=True))


def _paragraphs(text: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """Paragraphs of a stretch without code, tables cut out of it line by line; consecutive list paragraphs are one."""
    stretches: list[tuple[str, int, int]] = []
    at = a
    while at < b:
        end = text.find("\n", at, b) + 1 or b
        line = text[at:end].strip()
        inside = bool(stretches) and stretches[-1][0] == "table"
        table = (line.startswith("|") and line.count("|") > 1) or (inside and "---" in line and "|" in line)
        kind = "table" if table else "text"
        stretches[-1:] = [(kind, stretches[-1][1], end)] if stretches and stretches[-1][0] == kind else [*stretches[-1:], (kind, at, end)]
        at = end
    out: list[tuple[str, int, int]] = []
    for kind, x, y in stretches:
        if kind == "table":
            out.append((kind, x, y))
            continue
        edges = [x, *(e for m in re.compile(r"\n\s*\n").finditer(text, x, y) for e in m.span()), y]
        for p, q in zip(edges[::2], edges[1::2], strict=True):
            if text[p:q].strip():
                kind = "list" if _LIST.match(text[p:q]) else "text"
                if kind == "list" and out and out[-1][0] == "list":
                    out[-1] = ("list", out[-1][1], q)
                else:
                    out.append((kind, p, q))
    return out


def block_spans(text: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fenced code, tables, lists and paragraphs of a span."""
    out, at = [], a
    for m in _FENCE.finditer(text, a, b):
        out += [*_paragraphs(text, at, m.start()), ("table" if m[0].startswith("[") else "code", *m.span())]
        at = m.end()
    return [(kind, *_trimmed(text, x, y)) for kind, x, y in out + _paragraphs(text, at, b)]


def _cut(text: str, a: int, most: int, least: int) -> int:
    """Where to cut a span from a that is too long: after a line break, else a bar, else a space, else hard."""
    for sign in ("\n", "|", " "):
        at = text.rfind(sign, a, a + most) + 1
        if at >= a + max(least, 1):
            return at
    return a + most


def _by_length(text: str, a: int, b: int, most: int, least: int) -> list[tuple[int, int]]:
    cuts = [a]
    while b - cuts[-1] > most:
        cuts.append(_cut(text, cuts[-1], most, least))
    out = [s for s in (_trimmed(text, x, y) for x, y in zip(cuts, [*cuts[1:], b], strict=True)) if s[0] < s[1]]
    if len(out) > 1 and out[-1][1] - out[-1][0] < least and out[-1][1] - out[-2][0] <= most:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def _parts_of(kind: str, text: str, a: int, b: int, most: int, least: int) -> list[tuple[int, int]]:
    """A block that is too long: runs of its paragraphs (code, tables) or sentences, cut by length where need be."""
    if kind in ("code", "table"):
        edges = [a, *(m.end() for m in re.compile(r"\n\s*\n").finditer(text, a, b)), b]
    else:
        edges = [a, *(a + m.end() for m in _SENTENCE.finditer(text[a:b]))]
    runs, begin = [], a
    for x, y in zip(edges, edges[1:], strict=False):
        if x > begin and y - begin > most and x - begin >= least:
            runs.append((begin, x))
            begin = x
    runs = [_trimmed(text, *r) for r in [*runs, (begin, b)]]
    return [s for x, y in runs if x < y for s in ([(x, y)] if y - x <= most else _by_length(text, x, y, most, least))]


def _lead(text: str, a: int, b: int, n: int) -> int:
    """Where the overlap with a chunk begins: after a sentence's end in its last n signs, else after their first space."""
    begin = max(a, b - n)
    m = re.compile(r"[.!?。！？；]+[\s\n]+").search(text, begin, b)
    if m and m.end() < b:
        return m.end()
    space = text.find(" ", begin, b)
    return space + 1 if 0 <= space < begin + (b - begin) / 2 else begin


def _packed_spans(text: str, blocks: list[tuple[str, int, int]], most: int, least: int, overlap: int) -> list[tuple[int, int]]:
    """Blocks folded into chunks: `open_` is the chunk that still grows, or None."""
    done: list[tuple[int, int]] = []
    open_: tuple[int, int] | None = None
    for kind, a, b in blocks:
        if b - a > most:
            done += ([open_] if open_ else []) + _parts_of(kind, text, a, b, most, least)
            open_ = None
        elif open_ is None:
            open_ = (a, b)
        elif b - open_[0] <= most:
            open_ = (open_[0], b)
        elif open_[1] - open_[0] >= least:
            done.append(open_)
            open_ = (_lead(text, *open_, overlap) if overlap else a, b)
        else:  # too short to stand alone: it takes as much of the block as fits
            at = _cut(text, a, open_[0] + most - a, 1) if open_[0] + most > a else a
            done.append(_trimmed(text, open_[0], at))
            a, b = _trimmed(text, at, b)
            open_ = (a, b) if a < b else None
    done += [open_] if open_ else []
    out: list[tuple[int, int]] = []
    for a, b in done:
        if out and min(b - a, out[-1][1] - out[-1][0]) < least and b - out[-1][0] <= most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def semantic_spans(text: str, max_chars: int = 1000, min_chars: int = 200, overlap: int = 0, token_limit: int | None = None, by_section: bool = True) -> list[tuple[int, int]]:
    """(start, end) of structure-aware chunks: blocks are packed up to max_chars, large ones are split, small neighbours merged."""
    out = [s for x, y in (section_spans(text) if by_section else [(0, len(text))]) for s in _packed_spans(text, block_spans(text, x, y), max_chars, min_chars, overlap)]
    return [p for s in out for p in _within_tokens(text, *s, token_limit)] if token_limit else out


def _within_tokens(text: str, a: int, b: int, limit: int) -> list[tuple[int, int]]:
    out = []
    while estimate(text[a:b]) > limit:
        low, high = 1, b - a
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if estimate(text[a : a + mid]) <= limit else (low, mid - 1)
        at = _cut(text, a, low, low // 2)
        out.append((a, at))
        a = at
    return [s for s in (_trimmed(text, *s) for s in [*out, (a, b)]) if s[0] < s[1]]


def recursive_spans(text: str, max_chars: int = 1000, min_chars: int = 1, overlap: int = 0) -> list[tuple[int, int]]:
    """(start, end) of chunks: paragraphs, then lines, sentences, words and signs, until each piece fits; neighbours are merged as far as they fit."""

    def split(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if b - a <= max_chars:
            return [(a, b)]
        if level == 4:
            return [(i, min(i + max_chars, b)) for i in range(a, b, max_chars)]
        cuts = [m.start() for m in re.compile((r"(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?])(?=\s)", r"(?<=\s)")[level]).finditer(text, a, b) if a < m.start() < b]
        out: list[tuple[int, int]] = []
        for x, y in (s for p, q in zip([a, *cuts], [*cuts, b], strict=True) for s in split(p, q, level + 1)):
            if out and y - out[-1][0] <= max_chars:
                out[-1] = (out[-1][0], y)
            else:
                out.append((x, y))
        return out

    out = [_trimmed(text, *s) for s in split(0, len(text), 0)]
    whole = _trimmed(text, 0, len(text))
    out = [s for s in out if s[1] - s[0] >= max(min_chars, 1)] or [s for s in [whole] if s[1] - s[0] >= max(min_chars, 1)]
    return [(max(out[i - 1][0], out[i - 1][1] - overlap), b) if i and overlap else (a, b) for i, (a, b) in enumerate(out)]


def json_split(text: str, size: int = 10, overlap: int = 0, line_size: int = 50) -> list[str]:
    """Items of an array or object, `size` to a chunk; text that is no JSON by lines."""
    try:
        value = json.loads(text)
    except ValueError:
        each = text.split("\n")
        return ["\n".join(each[i : i + line_size]) for i in range(0, len(each), max(1, line_size - overlap))]
    step = max(1, size - overlap)
    if isinstance(value, list):
        return [json.dumps(value[i : i + size], ensure_ascii=False, indent=2) for i in range(0, len(value), step)]
    if isinstance(value, dict):
        items = list(value.items())
        return [json.dumps(dict(items[i : i + size]), ensure_ascii=False, indent=2) for i in range(0, len(items), step)]
    return [str(value)]


def cross_segments(texts: list[str], max_chars: int = 2000, min_chars: int = 1) -> list[tuple[int, int, str]]:
    """(first, last, text): segments gathered until the next would exceed max_chars."""
    out, cur, first = [], "", 0
    for i, t in enumerate(texts):
        if cur and len(cur) + len(t) > max_chars:
            if len(cur) >= min_chars:
                out.append((first, i - 1, cur))
            cur, first = "", i
        cur = f"{cur}\n{t}" if cur else t
    return [*out, (first, len(texts) - 1, cur)] if cur and len(cur) >= min_chars else out


def semantic_split(text: str, *options, **named) -> list[str]:
    return [text[a:b] for a, b in semantic_spans(text, *options, **named)]


def recursive_split(text: str, *options, **named) -> list[str]:
    return [text[a:b] for a, b in recursive_spans(text, *options, **named)]


_SPANS = {"semantic": semantic_spans, "recursive": recursive_spans}


def packed(df: DataFrame, method: str, **options) -> DataFrame:
    """id, chunk_index, content, start, end of the texts of df (id, text), by a method that packs one text at a time.

    content is the text from sign start (from 0) up to sign end; chunks of json are written anew and have no place."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                t = t or ""
                if method == "json":
                    rows += [(i, n, c, None, None) for n, c in enumerate(json_split(t, **options))]
                else:
                    rows += [(i, n, t[a:b], a, b) for n, (a, b) in enumerate(_SPANS[method](t, **options))]
            yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], pa.string() if c == "content" else pa.int64()) for k, c in enumerate(("id", "chunk_index", "content", "start", "end"))})

    if method not in (*_SPANS, "json"):
        raise ValueError(f"no method {method}")
    return df.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, chunk_index long, content string, start long, end long")


def placed_segments(segments: DataFrame, separator: str = "\n") -> DataFrame:
    """Segments (file_id, seg_idx, text, and more) with their place (start, end) in their file's text, in which a separator stands between them."""
    before = Window.partitionBy("file_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce("text", F.lit("")))
    start = F.coalesce(F.sum(size + len(separator)).over(before), F.lit(0))
    return segments.withColumn("start", start).withColumn("end", start + size)


def overlapping(chunks: DataFrame, segments: DataFrame, bin_size: int = 4096) -> DataFrame:
    """Pairs of chunks (file_id, chunk_index, start, end) and segments (file_id, start, end, and more) that share a sign.

    A binned range join: both sides go to the bins of `bin_size` signs that they reach into, and a pair is given in the first bin it shares, once."""
    bins = lambda a, b: F.sequence(F.floor(F.col(a) / bin_size), F.floor((F.col(b) - 1) / bin_size))
    left = chunks.where("end > start").withColumn("__bin", F.explode(bins("start", "end")))
    right = segments.where("end > start").withColumnsRenamed({"start": "seg_start", "end": "seg_end"}).withColumn("__bin", F.explode(bins("seg_start", "seg_end")))
    met = left.join(right, ["file_id", "__bin"]).where((F.col("start") < F.col("seg_end")) & (F.col("seg_start") < F.col("end")))
    return met.where(F.col("__bin") == F.floor(F.greatest("start", "seg_start") / bin_size)).drop("__bin")


def with_provenance(chunks: DataFrame, segments: DataFrame, bin_size: int = 4096) -> DataFrame:
    """chunks with page_numbers, sorted and distinct, and time_ranges, in the segments' order, of the segments (with page, start_time, end_time) that they reach into."""
    met = overlapping(chunks.select("file_id", "chunk_index", "start", "end"), segments.select("file_id", "start", "end", "page", "start_time", "end_time"), bin_size)
    timed = F.when(F.col("start_time").isNotNull() | F.col("end_time").isNotNull(), F.struct("seg_start", "start_time", "end_time"))
    ranges = F.transform(F.array_sort(F.collect_list(timed)), lambda t: F.struct(t["start_time"].alias("start"), t["end_time"].alias("end")))
    found = met.groupBy("file_id", "chunk_index").agg(F.array_sort(F.collect_set("page")).alias("page_numbers"), ranges.alias("time_ranges"))
    return chunks.join(found, ["file_id", "chunk_index"], "left")


def packed_segments(df: DataFrame, max_chars: int = 2000, min_chars: int = 1) -> DataFrame:
    """file_id, chunk_index, first, last, content: cross-segment chunks of df (file_id, seg_idx, text)."""
    files = df.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]).alias("texts"))

    def run(batches):
        for batch in batches:
            rows = [(f, n, *c) for f, texts in zip(batch.column("file_id").to_pylist(), batch.column("texts").to_pylist(), strict=True) for n, c in enumerate(cross_segments(texts, max_chars, min_chars))]
            yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], pa.string() if c == "content" else pa.int64()) for i, c in enumerate(("file_id", "chunk_index", "first", "last", "content"))})

    return files.mapInArrow(run, "file_id long, chunk_index long, first long, last long, content string")


def chunk_column(method: str, text: Column, **options) -> Column:
    """array<string> of chunks by a columnar method."""
    return {"line": lines, "block": blocks, "code": code, "email": email, "ics": ics, "segment": lambda t: F.array(t)}[method](text, **options)


def route(segments: DataFrame, configs: dict[str, dict], default: dict | None = None, min_chars: int = 0) -> DataFrame:
    """file_id, chunk_index, seg_idx, method, content of segments (file_id, file_type, seg_idx, text, summary).

    Each file type has its method and options; a summary is a chunk of its own before the others (seg_idx -1)."""
    default = default or {"method": "semantic"}
    parts: list[DataFrame] = []

    def placed(out: list[DataFrame], mine: DataFrame, method: str, options: dict) -> None:
        if method in COLUMNAR:
            out.append(mine.select("file_id", "seg_idx", F.lit(method).alias("method"), F.posexplode(chunk_column(method, F.col("text"), **options)).alias("local", "content")))
        else:
            keyed = mine.withColumn("id", F.xxhash64("file_id", "seg_idx"))
            made = packed(keyed, method, **options).select("id", F.col("chunk_index").cast("int").alias("local"), "content")
            out.append(keyed.select("id", "file_id", "seg_idx", F.lit(method).alias("method")).join(made, "id").drop("id"))

    named = {t: c for t, c in configs.items()}
    for kind, config in [*named.items(), (None, default)]:
        mine = segments.where(F.col("file_type") == kind) if kind else segments.where(~F.coalesce(F.col("file_type").isin(*named) if named else F.lit(False), F.lit(False)))
        options = dict(config)
        method = options.pop("method")
        if method == "segment" and "max_chars" in options:  # a segment is a chunk as it is, a longer one goes to the recursive method
            most = options.pop("max_chars")
            long = F.length("text") > most
            placed(parts, mine.where(long), "recursive", {"max_chars": most})
            mine = mine.where(~F.coalesce(long, F.lit(False)))
        placed(parts, mine, method, options)
    summary = segments.where("summary IS NOT NULL AND summary <> ''").select("file_id", F.lit(-1).alias("seg_idx"), F.lit("summary").alias("method"), F.lit(0).alias("local"), F.col("summary").alias("content")).distinct()
    every = summary
    for p in parts:
        every = every.unionByName(p.select("file_id", F.col("seg_idx").cast("int").alias("seg_idx"), "method", "local", "content"))
    every = every.where(F.length(F.trim("content")) >= max(1, min_chars))
    w = Window.partitionBy("file_id").orderBy("seg_idx", "local")
    return every.withColumn("chunk_index", (F.row_number().over(w) - 1).cast("long")).select("file_id", "chunk_index", "seg_idx", "method", "content")
