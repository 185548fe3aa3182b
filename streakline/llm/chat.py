r"""Chat formatting whose output a deterministic parser reads back to the same turns.

Grammar: a user turn is ``[INST] text [/INST]``, an assistant turn ``<s> text </s>``,
any other role ``[ROLE:name] text [/ROLE]``; turns follow each other without
anything between. Conversations are rendered raw, reparsed, and compared with their
source. Where they differ, or where a text holds a control string, their texts are
escaped: a control string is written with one more backslash after its first character
(``</s>`` as ``<\/s>``, ``<\/s>`` as ``<\\/s>``), which the parser takes away again.
Whether a conversation is escaped is part of the output (``escaped``), so a reader
knows how to parse. One that would still differ fails the job; it cannot occur, as
escaped content holds no control string.

Turns are ordered by turn, then role, then text (null first), so ties and repeated
rows have one result. A null role or text is the empty string, a null ``conv_id`` a
conversation of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streakline.llm.common import table

#: What follows the first character of a control string.
TAIL = r"(/?INST\]|/?s>|/ROLE\]|ROLE:)"
#: Right after a turn's closing mark.
TURN_END = r"(?<= \[/INST\]| </s>| \[/ROLE\])"
TURN = r"(?s)^(?:\[INST\] (.*) \[/INST\]|<s> (.*) </s>|\[ROLE:([^\]]*)\] (.*) \[/ROLE\])$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + TAIL, "$1$2$3")


def escape_role(role: Column) -> Column:
    """Role names end at ``]``; percent-encode it and the escape character."""
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("]"), F.lit("%5D"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%5D"), F.lit("]")), F.lit("%25"), F.lit("%"))


def render_turn(role: Column, text: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s> "), text, F.lit(" </s>")))
        .otherwise(
            F.concat(F.lit("[ROLE:"), escape_role(role), F.lit("] "), text, F.lit(" [/ROLE]"))
        )
    )


def render(turns: Column, escaped: Column) -> Column:
    """The formatted text of an array of (role, text)."""
    return F.array_join(
        F.transform(
            turns,
            lambda t: render_turn(
                t["role"], F.when(escaped, escape(t["text"])).otherwise(t["text"])
            ),
        ),
        "",
    )


def pieces(formatted: Column) -> Column:
    """The rendered turns of a formatted text."""
    return F.filter(F.split(formatted, TURN_END), lambda p: p != "")


def parse_turn(piece: Column, escaped: Column) -> Column:
    part = lambda group: F.regexp_extract(piece, TURN, group)
    role = (
        F.when(piece.startswith("[INST] "), "user")
        .when(piece.startswith("<s> "), "assistant")
        .otherwise(unescape_role(part(3)))
    )
    text = F.concat(part(1), part(2), part(4))
    return F.struct(
        role.alias("role"), F.when(escaped, unescape(text)).otherwise(text).alias("text")
    )


def parse(formatted: Column, escaped: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    return F.transform(pieces(formatted), lambda p: parse_turn(p, escaped))


def loss_spans(formatted: Column) -> Column:
    """(start, length) in code points of the assistant texts, still escaped."""
    parts = pieces(formatted)
    lengths = F.transform(parts, F.length)
    with_start = F.aggregate(
        F.arrays_zip(parts.alias("piece"), lengths.alias("n")),
        F.struct(
            F.lit(0).alias("at"),
            F.array().cast("array<struct<start:int,length:int>>").alias("spans"),
        ),
        lambda acc, p: F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.when(
                p["piece"].startswith("<s> "),
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + 4).alias("start"), (p["n"] - 9).alias("length")
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return with_start["spans"]


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, escaped, loss_spans) of ``conversations`` (conv_id, turn, role, text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = conversations.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.struct("turn", text("role").alias("role"), text("text").alias("text")))
            ),
            lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")),
        ).alias("source")
    )
    raw = source.withColumn("raw", render(F.col("source"), F.lit(False)))
    tried = raw.withColumn(
        "escaped",
        F.exists("source", lambda t: F.regexp_like(t["text"], F.lit(r"[<\[]\\*" + TAIL)))
        | (parse(F.col("raw"), F.lit(False)) != F.col("source")),
    )
    rendered = tried.withColumn(
        "formatted",
        F.when(F.col("escaped"), render(F.col("source"), F.lit(True))).otherwise(F.col("raw")),
    )
    same = ~F.col("escaped") | (parse(F.col("formatted"), F.lit(True)) == F.col("source"))
    return rendered.select(
        "conv_id",
        F.when(same, F.col("formatted"))
        .otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")))
        .alias("formatted"),
        "escaped",
    ).withColumn("loss_spans", loss_spans(F.col("formatted")))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text) from the output of ``format_conversations``."""
    return formatted.select(
        "conv_id",
        "formatted",
        parse(F.col("formatted"), F.col("escaped")).alias("turns"),
        F.array_join(
            F.transform(
                "loss_spans",
                lambda s: F.when(
                    F.col("escaped"),
                    unescape(F.substring("formatted", s["start"] + 1, s["length"])),
                ).otherwise(F.substring("formatted", s["start"] + 1, s["length"])),
            ),
            "",
        ).alias("loss_text"),
    )


def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    extra = spark.sql(
        """select * from values
        (-1L, 0L, 'user', '</s>[INST] ok [/INST]'),
        (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)"""
    )
    both = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    digest = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read_back(format_conversations(both)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked as (
  select *,
    case when role = 'user' then 15 when role = 'assistant' then 9
      else 16 + length(replace(replace(role, '%', '%25'), ']', '%5D')) end as marks,
    len(regexp_extract_all(text, '[<\[]\\*(?:/?INST\]|/?s>|/ROLE\]|ROLE:)')) as escapes
  from turns
), joined as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as all_text,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss_text,
    sum(length(text) + marks + escapes) as formatted_chars
  from marked group by conv_id
)
select conv_id, n_turns, sha256(all_text) as turns_sha256, length(loss_text) as loss_chars,
  sha256(loss_text) as loss_sha256,
  cast(formatted_chars as bigint) as formatted_chars
from joined
"""

QUERIES = {"op9_chat": op9_chat}
ORACLES = {"op9_chat": SQL}
