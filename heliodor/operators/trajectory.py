"""Agent logs: reply parsing, command rules, step windows, budgets."""

from __future__ import annotations

import ast
import json
import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Commands of the agents' shell, their signs of composition, suffixes of paths.
RETURN_COMMANDS = ("return_txt", "return_img", "return_ori", "return_metadata")
COMPOSED = r"(?<!\\)(\|\||&&|\|&|[|;<>])"
PATH_SUFFIX = r"\.(txt|md|json|jsonl|csv|log|ics|eml|ipynb|py|sh|pdf|docx?|pptx?|xlsx|png|jpe?g|gif|bmp|webp|mp3|wav|mp4|mkv|mov|avi|webm|sqlite|db|xml|ya?ml)$"
OUTPUT_CHARS, TPM_BUDGET, TPM_WAIT, WINDOW_S = 12_000, 9_500, 8_500, 60


def tag_block(text: Column, tag: str) -> Column:
    """What a tag encloses; to the next tag or the end where it isn't closed; empty without one."""
    closed = F.regexp_extract(text, f"(?is)<{tag}>(.*?)</{tag}>", 1)
    open_ = F.regexp_extract(text, f"(?is)<{tag}>(.*?)(?:</?(?:think|tool|answer|end)\\b|$)", 1)
    return F.when(F.rlike(text, F.lit(f"(?is)<{tag}>.*</{tag}>")), closed).otherwise(open_)


def first_json_of(text: str) -> str:
    start, depth, quoted, escaped = text.find("{"), 0, False, False
    if start < 0:
        return ""
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = (escaped or c != '"'), (not escaped and c == "\\")
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return ""


def relaxed(text: str):
    """JSON, else a Python literal; {} if neither."""
    text = text.replace("\\|", "|")
    for read in (json.loads, ast.literal_eval):
        try:
            return read(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
    return {}


@F.pandas_udf(StringType())
def first_json(text: pd.Series) -> pd.Series:
    """The first balanced JSON object of a text."""
    return text.map(lambda t: first_json_of(t or ""))


def _between(text: str, tag: str) -> tuple[int, str]:
    m = re.search(f"<{tag}>", text, re.I)
    if not m:
        return -1, ""
    end = re.search(f"</{tag}>", text[m.end() :], re.I) or re.search(r"</?(think|tool|answer|end)\b", text[m.end() :], re.I)
    return m.start(), text[m.end() : m.end() + end.start()] if end else text[m.end() :]


def action_of(text: str) -> tuple[str, str]:
    """(action, argument): terminal with a command, answer with a text, or error with a reason."""
    (tool_at, tool), (answer_at, answer) = _between(text, "tool"), _between(text, "answer")
    use_tool, use_answer = bool(tool.strip()), bool(answer.strip())
    if use_tool and use_answer:
        use_tool, use_answer = tool_at < answer_at, tool_at >= answer_at
    if use_answer:
        return "answer", answer.strip()
    found = relaxed(first_json_of(tool if use_tool else text))
    if not isinstance(found, dict) or not found:
        return "error", "no tool or answer"
    name = found.get("name") or found.get("tool") or ""
    args = found.get("arguments") or found.get("args") or {}
    if use_tool and name and name != "terminal":
        return "error", "not the terminal"
    if not isinstance(args, dict) or "command" not in args:
        args = found if "command" in found else {}
    if not use_tool and "command" not in found and name != "terminal":
        return "error", "no tool or answer"
    command = str(args.get("command") or "").strip()
    return ("terminal", command) if command else ("error", "empty command")


@F.pandas_udf(StructType([StructField("action", StringType()), StructField("argument", StringType())]))
def action(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([action_of(t or "") for t in text], columns=["action", "argument"])


def composed(command: Column) -> Column:
    return F.rlike(F.trim(command), F.lit(COMPOSED))


def normalize(command: str) -> str:
    """Quote a path with a space or an ampersand that isn't quoted."""
    command = command.strip()
    if not command or re.search(COMPOSED, command) or '"' in command or "'" in command:
        return command
    try:
        head, *rest = shlex.split(command)
    except ValueError:
        return command
    tail: list[str] = []
    if head == "return_img" and "--page" in rest:
        at = rest.index("--page")
        rest, tail = rest[:at], rest[at:]
    elif head not in (*RETURN_COMMANDS, "list_files") or (head == "return_ori" and len(rest) != 1):
        return command
    path = " ".join(rest)
    return " ".join([head, f'"{path}"', *tail]) if " " in path or "&" in path else command


def policy_error(command: str) -> str | None:
    """Why a command is refused; None if it isn't."""
    try:
        parts = shlex.split(command)
    except ValueError:
        return "unbalanced quotes"
    if not parts:
        return "empty command"
    head = parts[0]
    if head == "list_files" and re.search(COMPOSED, command):
        return "list_files can't be piped"
    if re.search(r"base64\s+-d|<<|\bpython3?\s+-c\b", command) and len(command) > 400:
        return "inline blob"
    if head == "return_txt" and "--page" in parts:
        return "return_txt has no --page"
    if head in RETURN_COMMANDS and not re.search(COMPOSED, command):
        plain = [p for p in parts[1:] if not p.startswith("--")]
        if not plain:
            return f"{head} needs a path"
        if head in ("return_txt", "return_metadata", "return_ori") and len(plain) > 1:
            return f"{head} takes one path"
    if head in ("grep", "rg") and any(p.lower().endswith(".pdf") for p in parts[1:]):
        return "grep can't read pdf"
    return None


def touched(command: str) -> list[str]:
    """Files that a command names, in order, each once."""
    try:
        parts = shlex.split(command)
    except ValueError:
        return []
    if not parts:
        return []
    if parts[0] in RETURN_COMMANDS:
        return parts[1:2]
    paths = [p for p in parts[1:] if not p.startswith("-") and "://" not in p and not re.fullmatch(r"[|;<>&]+", p) and ("/" in p or re.search(PATH_SUFFIX, p, re.I))]
    return list(dict.fromkeys(paths))


@F.pandas_udf(StructType([StructField("normalized", StringType()), StructField("error", StringType()), StructField("files", ArrayType(StringType()))]))
def command_facts(command: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(normalize(c or ""), policy_error(c or ""), touched(c or "")) for c in command], columns=["normalized", "error", "files"])


def streaks(steps: DataFrame, notice_at: int = 4) -> DataFrame:
    """Steps (session, step, pattern, matched) with the run of the same pattern without a match, and whether it is to be noticed."""
    w = Window.partitionBy("session").orderBy("step")
    changed = F.coalesce((F.lag("pattern").over(w) != F.col("pattern")) | F.lag("matched").over(w) | F.col("matched"), F.lit(True))
    runs = steps.withColumn("run", F.sum(changed.cast("int")).over(w))
    streak = F.when(~F.col("matched"), F.row_number().over(Window.partitionBy("session", "run").orderBy("step"))).otherwise(0)
    return runs.withColumn("streak", streak).withColumn("notice", F.col("streak") >= notice_at).drop("run")


def step_log(results: DataFrame) -> DataFrame:
    """session, step, command, output of a map of steps, outputs truncated."""
    each = results.select("session", F.explode("steps").alias("step", "s"))
    cut = F.when(F.length("s.output") > OUTPUT_CHARS, F.substring("s.output", 1, OUTPUT_CHARS)).otherwise(F.col("s.output"))
    return each.select("session", "step", "s.command", cut.alias("output"))


def token_windows(steps: DataFrame, budget: int = TPM_BUDGET, wait_at: int = TPM_WAIT, seconds: int = WINDOW_S) -> DataFrame:
    """Steps (session, step, at seconds, tokens) with the tokens of the last seconds, and whether the next one must wait."""
    w = Window.partitionBy("session").orderBy("at").rangeBetween(-seconds, 0)
    nxt = F.lead("tokens").over(Window.partitionBy("session").orderBy("at", "step"))
    out = steps.withColumn("used", F.sum("tokens").over(w)).withColumn("next", nxt)
    return out.withColumn("wait", F.coalesce(F.col("used") + F.col("next") > min(budget, wait_at), F.lit(False))).drop("next")


def compact_history(messages: DataFrame, threshold: int) -> DataFrame:
    """Messages (session, place, tokens): the first and the newest that stay under the threshold."""
    newer = Window.partitionBy("session").orderBy(F.col("place").desc())
    head = F.first("tokens").over(Window.partitionBy("session").orderBy("place"))
    out = messages.withColumn("head", head).withColumn("after", F.sum("tokens").over(newer)).withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy("place")))
    newest = F.row_number().over(newer) == 1
    return out.withColumn("newest", newest).where((F.col("n") == 1) | F.col("newest") | (F.col("after") + F.col("head") <= threshold)).select(*messages.columns)


def output_budget(used: Column, threshold: int, reserve: int, cap: int) -> Column:
    """Characters that the next output may have."""
    left = F.lit(threshold) - used - reserve
    return F.when(left <= 64, F.least(F.lit(cap), F.lit(800))).otherwise(F.greatest(F.lit(800), F.least(F.lit(cap), (left * 3.8).cast("int"))))


def fit_slices(items: DataFrame, budget: int) -> DataFrame:
    """Items (session, place, size) with the chunk that greedy packing under the budget puts them in, its number of chunks and has_more."""
    each = items.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("place", "size"))).alias("items"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<place:bigint,chunk:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = (a["used"] > 0) & (a["used"] + x["size"] > budget)
        chunk = a["chunk"] + new.cast("int")
        used = F.when(new, x["size"]).otherwise(a["used"] + x["size"]).cast("long")
        return F.struct(chunk.alias("chunk"), used.alias("used"), F.concat(a["out"], F.array(F.struct(x["place"].cast("long").alias("place"), chunk.alias("chunk")))).alias("out"))

    done = each.select("session", F.aggregate("items", start, step).alias("a"))
    return done.select("session", (F.col("a.chunk") + 1).alias("total"), F.explode("a.out").alias("o")).select("session", "o.place", "o.chunk", "total", (F.col("o.chunk") < F.col("total") - 1).alias("has_more"))


def compact_output(text: Column, budget: int = OUTPUT_CHARS) -> Column:
    """Long base64 runs become their length; then the text is cut to the budget."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/=]{513,}"), F.lit(0))
    short = F.aggregate(runs, text, lambda a, r: F.replace(a, r, F.concat(F.lit("<base64:"), F.length(r).cast("string"), F.lit(" chars>"))))
    return F.when(F.length(short) > budget, F.concat(F.substring(short, 1, budget), F.lit("..."))).otherwise(short)


def page_sessions(steps: DataFrame, chunks: DataFrame) -> DataFrame:
    """Steps (session, step, command) with the chunk that each repetition of a command is answered with; null and complete after the last.

    chunks: command, chunk, content. Steps may also have `fresh`, that the command was run anew: its payload starts again at
    the first chunk; and `small`, that the payload has no chunks: the command's pages end, and nothing is complete until it is fresh again."""
    fresh = F.coalesce("fresh", F.lit(False)) if "fresh" in steps.columns else F.lit(False)
    small = fresh & F.coalesce("small", F.lit(False)) if "small" in steps.columns else F.lit(False)
    own = Window.partitionBy("session", "command")
    run = Window.partitionBy("session", "command", "__run")
    placed = steps.withColumn("__fresh", fresh).withColumn("__small", small).withColumn("__run", F.sum(F.col("__fresh").cast("int")).over(own.orderBy("step")))
    turned = placed.withColumn("__none", F.max("__small").over(run)).withColumn("chunk", F.when(~F.col("__none"), F.row_number().over(run.orderBy("step")) - 1))
    met = turned.join(chunks, ["command", "chunk"], "left")
    return met.select("session", "step", "command", "chunk", "content", (F.col("content").isNull() & ~F.col("__none")).alias("complete"))


def allowed(steps: DataFrame, flags: DataFrame) -> DataFrame:
    """Steps (session, config, command) with whether the config (config, command, enabled) lets the command run; all others may."""
    head = F.split(F.trim("command"), r"\s+")[0]
    return steps.withColumn("head", head).join(flags.withColumnRenamed("command", "head"), ["config", "head"], "left").withColumn("allowed", F.coalesce("enabled", F.lit(True))).drop("head", "enabled")


def backoff(attempt: Column, base: float = 1.0, cap: float = 60.0, salt: str = "") -> Column:
    """Seconds before a retry: doubled up to the cap, with up to a quarter of jitter from a hash."""
    jitter = F.pmod(F.xxhash64(attempt, F.lit(salt)), F.lit(1000)) / 4000
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt)) * (1 + jitter)
