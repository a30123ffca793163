"""Operator 2: chat formatting with a grammar round trip.

A conversation is rendered as one string; a deterministic parser reads it back,
and the recovered turns are compared with the source. Turns that do not come
back alike are escaped and the conversation is rendered and parsed again: those turns that hold
control strings, then all, until it is identical; a conversation that never is would be an error. All of it is built-in expressions, so a conversation is
rendered, parsed and checked inside one projection.

The grammar:

    conversation := turn*
    turn         := "<s>" [ "[INST]" ] role "\\n" text [ "[/INST]" ] "</s>"

where user turns carry the instruction marks. Inside roles and texts a control
string, or the escape sign itself, is written as the escape sign and a digit.
A marker can't arise from the end of a text and the begin of a marker, because
every control string starts with a sign that no other place of a marker has.

Defined cases: null text and null role are empty; rows of one conversation go by
turn, then role, then text, so repeated rows keep a defined order; null conv_id
is a conversation of its own; an empty table gives no rows. Extra columns are
ignored. A conversation is one value by its nature (one digest of all its
turns), so a conversation must fit in memory; nothing else must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.llm.common import let, running

ESC = "␛"
#: Control strings; what stands for them is ESC and their place here, and ESC and 0 for ESC.
CONTROL = ("</s>", "<s>", "[INST]", "[/INST]")
ASSISTANT, USER = "assistant", "user"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit(ESC), F.lit(f"{ESC}0"))
    if role:  # a line break ends a role
        c = F.replace(c, F.lit("\n"), F.lit(f"{ESC}{len(CONTROL) + 1}"))
    for i, word in enumerate(CONTROL, 1):
        c = F.replace(c, F.lit(word), F.lit(f"{ESC}{i}"))
    return c


def unescape(c: Column, role: bool = False) -> Column:
    if role:
        c = F.replace(c, F.lit(f"{ESC}{len(CONTROL) + 1}"), F.lit("\n"))
    for i, word in enumerate(CONTROL, 1):
        c = F.replace(c, F.lit(f"{ESC}{i}"), F.lit(word))
    return F.replace(c, F.lit(f"{ESC}0"), F.lit(ESC))


def render(turns: Column, escaped: Column) -> Column:
    """One string of an array<struct<role, text>>; escaped: array<boolean>, which turns to escape."""

    def one(t: Column, i: Column) -> Column:
        e = F.get(escaped, i)
        role, text = (F.when(e, escape(t[x], x == "role")).otherwise(t[x]) for x in ("role", "text"))
        user = t["role"] == USER
        return F.concat(F.lit("<s>"), F.when(user, "[INST]").otherwise(""), role, F.lit("\n"), text, F.when(user, "[/INST]").otherwise(""), F.lit("</s>"))

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation, by the grammar alone; a part that breaks it is null."""

    def clean(x: Column) -> Column:
        bad = F.lit(False)
        for word in CONTROL:
            bad = bad | F.contains(x, F.lit(word))
        return F.when(~bad, x)

    pieces = F.filter(F.split(formatted, "</s>"), lambda p: p != "")

    def one(p: Column) -> Column:
        body = F.substring(p, F.lit(4), F.length(p))
        user = F.startswith(body, F.lit("[INST]"))
        body = F.when(user, F.substring(body, F.lit(7), F.length(body) - 13)).otherwise(body)
        return let(body, lambda b: F.struct(unescape(clean(F.substring_index(b, "\n", 1)), True).alias("role"), unescape(clean(F.substring(b, F.instr(b, "\n") + 1, F.length(b)))).alias("text")))

    return F.transform(pieces, one)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns (as in the source), formatted, parsed, identical: the round trip of each conversation."""
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    talks = clean.groupBy("conv_id").agg(turns.alias("turns"))

    def trial(escaped: Column) -> Column:
        return let(render(F.col("turns"), escaped), lambda f: F.struct(f.alias("formatted"), parse(f).alias("parsed")))

    raw = trial(F.transform("turns", lambda t: F.lit(False)))
    # Where the raw text parses to the same turns nothing needs an escape. Else the
    # turns that hold a control string or the escape sign are escaped: all others parse as they are.
    conflict = F.transform("turns", lambda t: (escape(t["text"]) != t["text"]) | (escape(t["role"], True) != t["role"]))
    same = lambda x: x["parsed"] == F.col("turns")
    last = let(trial(F.transform("turns", lambda t: F.lit(True))), lambda x: F.when(same(x), x).otherwise(F.raise_error(F.lit("a conversation does not come back alike"))))
    best = let(raw, lambda a: F.when(same(a), a).otherwise(let(trial(conflict), lambda b: F.when(same(b), b).otherwise(last))))
    out = talks.withColumn("best", best).select("conv_id", "turns", "best.formatted", "best.parsed")
    return out.withColumn("identical", F.col("parsed") == F.col("turns"))


def digests(talks: DataFrame) -> DataFrame:
    """The digest columns, from the turns that the parser read back."""
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("parsed", lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "")
    return talks.withColumn("loss", loss).select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def loss_spans(talks: DataFrame) -> DataFrame:
    """conv_id and spans array<struct<start, end>>: code points of formatted under the loss mask (assistant texts as rendered)."""
    pieces = F.filter(F.split("formatted", "</s>"), lambda p: p != "")
    none = F.array().cast("array<int>")
    ends = let(pieces, lambda q: F.when(F.size(q) > 0, F.transform(running(F.transform(q, F.length), lambda a, b: a + b, F.lit(0)), lambda n, i: n + 4 * i)).otherwise(none))
    head = f"<s>{ASSISTANT}\n"
    spans = F.filter(F.transform(F.arrays_zip(pieces.alias("piece"), ends.alias("end")), lambda z: F.when(F.startswith(z["piece"], F.lit(head)), F.struct((z["end"] - F.length(z["piece"]) + len(head)).alias("start"), z["end"].alias("end")))), lambda s: s.isNotNull())
    return talks.select("conv_id", spans.alias("spans"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, '{USER}', '{hard}'), (-7L, 1L, '{ASSISTANT}', '{hard}') AS t(conv_id, turn, role, text)")
    return digests(format_conversations(rows.unionByName(extra)))


ORACLE_SQL = {
    "op2_chat_format": f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
    SELECT *, regexp_matches(text, '</s>|<s>|\\[INST\\]|\\[/INST\\]|{ESC}') AS held, regexp_matches(role, '</s>|<s>|\\[INST\\]|\\[/INST\\]|{ESC}|\\n') AS role_held,
        regexp_matches(text, '</s>|<s>|\\[INST\\]|\\[/INST\\]|{ESC}[0-4]') OR regexp_matches(role, '</s>|<s>|\\[INST\\]|\\[/INST\\]|{ESC}[0-5]|\\n') AS conflict
    FROM rows
), judged AS (
    SELECT *, (held OR role_held) AND bool_or(conflict) OVER (PARTITION BY conv_id) AS escaped FROM marked
), sized AS (
    SELECT *, CASE WHEN escaped THEN replace(replace(replace(replace(replace(text, '{ESC}', '{ESC}0'), '</s>', '{ESC}1'), '<s>', '{ESC}2'), '[INST]', '{ESC}3'), '[/INST]', '{ESC}4') ELSE text END AS written,
        CASE WHEN escaped THEN replace(replace(replace(replace(replace(replace(role, '{ESC}', '{ESC}0'), chr(10), '{ESC}5'), '</s>', '{ESC}1'), '<s>', '{ESC}2'), '[INST]', '{ESC}3'), '[/INST]', '{ESC}4') ELSE role END AS written_role
    FROM judged
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(written_role) + length(written) + 8 + CASE WHEN role = 'user' THEN 13 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
}
