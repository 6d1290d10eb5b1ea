"""Chat formatting by grammar round trip, in DataFrame functions only.

A conversation is rendered as

    <|im_start|>ROLE\\n TEXT <|im_end|>\\n        (without the blanks)

for each turn. The rendered string is parsed again by a deterministic grammar
(an opening mark starts a turn anywhere, the first ``<|im_end|>`` after it ends
it, the role is all up to the first line feed) and the turns it yields are compared
with the source. A conversation that does not come back identical has the turns
that hold control characters escaped, and is rendered and parsed again, until
it does. The escape maps ``~`` to ``~t``, ``<`` to ``~l`` and, in roles, a line
feed to ``~n``; escaped turns open with ``<|im_start|~|>`` instead, so that the
parser knows which to unescape. An escaped turn holds no ``<``, so the second
rendering always parses back; a conversation that didn't would end the query (raise_error).

The loss mask is a list of spans: where in the rendered string the text of each
assistant turn stands. Opening mark, role, closing mark and the other turns are
outside.

Defined results: null texts and roles count as empty strings; turns are in the
order of turn (null first), then role, then text, repeated rows all kept; rows
with a null conv_id form one conversation; texts may be of any length; extra columns
are ignored; an empty table gives no rows. A conversation is the unit of formatting, so its turns meet
in one row; its length bounds memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ESCAPED, END = "<|im_start|>", "<|im_start|~|>", "<|im_end|>"
CLOSE = END + "\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~"), F.lit("~t")), F.lit("<"), F.lit("~l")), F.lit("\n"), F.lit("~n"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~n"), F.lit("\n")), F.lit("~l"), F.lit("<")), F.lit("~t"), F.lit("~"))


def _turn(escaped: Column, role: Column, text: Column) -> Column:
    plain = F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))
    return F.when(escaped, F.concat(F.lit(ESCAPED), escape(role), F.lit("\n"), escape(text), F.lit(CLOSE))).otherwise(plain)


def render(turns: Column, escaped: Column) -> Column:
    """turns: array of (role, text); escaped: whether turns with a control character are escaped."""
    conflict = lambda t: F.concat(t["role"], F.lit(" "), t["text"]).contains("<") | t["role"].contains("\n")
    return F.array_join(F.transform(turns, lambda t: _turn(escaped & conflict(t), t["role"], t["text"])), "")


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation: array of (role, text)."""
    # Each turn's opening mark splits off; what precedes the first one is empty.
    pieces = F.split(formatted, r"(?=<\|im_start\|(?:~\|)?>)")
    pieces = F.filter(pieces, lambda p: p != "")

    def turn(piece: Column) -> Column:
        marked = piece.startswith(ESCAPED)
        body = F.when(marked, F.substr(piece, F.lit(len(ESCAPED) + 1))).otherwise(F.substr(piece, F.lit(len(OPEN) + 1)))
        body = F.substring_index(body, END, 1)
        role, text = F.substring_index(body, "\n", 1), F.substr(body, F.instr(body, "\n") + F.lit(1))
        text = F.when(F.instr(body, "\n") > 0, text).otherwise(F.lit(""))
        return F.struct(F.when(marked, unescape(role)).otherwise(role).alias("role"), F.when(marked, unescape(text)).otherwise(text).alias("text"))

    return F.transform(pieces, turn)


def loss_spans(formatted: Column) -> Column:
    """Where the texts of assistant turns stand in a rendered conversation: array of (start, length, escaped), start from 0 in characters."""
    pieces = F.filter(F.split(formatted, r"(?=<\|im_start\|(?:~\|)?>)"), lambda p: p != "")

    def step(s: Column, piece: Column) -> Column:
        marked = piece.startswith(ESCAPED)
        opening = F.when(marked, len(ESCAPED)).otherwise(len(OPEN))
        # The role and its line feed; no assistant's role has more of them, escaped or not.
        head = opening + F.lit(len("assistant\n"))
        body = F.substring_index(F.substr(piece, opening + 1), END, 1)
        span = F.struct((s["at"] + head).alias("start"), (F.length(body) - len("assistant\n")).alias("length"), marked.alias("escaped"))
        spans = F.when(body.startswith("assistant\n"), F.concat(s["spans"], F.array(span))).otherwise(s["spans"])
        return F.struct((s["at"] + F.length(piece)).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,escaped:boolean>>").alias("spans"))
    return F.aggregate(pieces, start, step, lambda s: s["spans"])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, escaped, turns (array of role, text as parsed back from formatted), loss_spans (see there)."""
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("rows"))
    source = source.select("conv_id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    first = source.withColumn("plain", render(F.col("source"), F.lit(False)))
    first = first.withColumn("back", parse(F.col("plain")))
    tried = first.withColumn("escaped", F.col("back") != F.col("source"))
    out = tried.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), F.lit(True))).otherwise(F.col("plain")))
    out = out.withColumn("turns", F.when(F.col("escaped"), parse(F.col("formatted"))).otherwise(F.col("back")))
    # What can't be read back is never returned.
    same = F.col("turns") == F.col("source")
    out = out.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("conversation does not read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string")))
    return out.select("conv_id", "formatted", "escaped", "turns", loss_spans(F.col("formatted")).alias("loss_spans"))


def training_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask: formatted cut at the spans and unescaped, in order."""

    def cut(x: Column) -> Column:
        text = F.substr(formatted, x["start"] + 1, x["length"])
        return F.when(x["escaped"], unescape(text)).otherwise(text)

    return F.array_join(F.transform(spans, cut), "")


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of format_conversations()'s result."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    d = formatted.withColumn("loss", training_text(F.col("formatted"), F.col("loss_spans")))
    return d.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
