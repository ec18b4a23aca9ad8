"""Chat formatting (10), native: rendering that is proved by parsing it again.

A turn is rendered as ``### role: text`` and closed by ``</turn>`` on a line of its own. The grammar is deterministic:
the output is cut at the closing lines, each piece starts with ``### ``, its role ends at the first ``: ``, the rest is
the text; one backslash before a control string (``###`` or ``</turn>``, itself perhaps after more backslashes) is then
taken away. A conversation is first rendered as it stands. If parsing does not give back exactly the source's turns, its
conflicting content is escaped by one more backslash before every control string, and it is rendered and parsed again;
a conversation that still differed would fail the query. Texts without conflicts thus stay as they are.

Everything is SQL expressions on one row per conversation. The loss mask is the list of the spans (start and length in
code points) of the assistant texts in the output; the loss text is read from the output through these spans.

Defined results: null texts and roles are empty; turns are ordered by turn (null first), then role and text, and
repeated rows are kept; rows without conv_id are one conversation of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BETWEEN, CLOSE = "### ", ": ", "\n</turn>\n"
CONTROL = r"(###|</turn>)"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """One more backslash before each control string."""
    return F.regexp_replace(text, r"(\\*)" + CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    """One backslash fewer before each control string that has any."""
    return F.regexp_replace(text, r"\\(\\*)" + CONTROL, "$1$2")


def escape_role(role: Column) -> Column:
    """A role must not hold the sign that ends it: ``\\`` and ``:`` become ``\\b`` and ``\\c``."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\c"), F.lit(":")), F.lit("\\b"), F.lit("\\"))


def render(turns: Column, escaped: bool) -> Column:
    """The output of an array of (role, text)."""
    e = escape if escaped else (lambda c: c)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), e(escape_role(t["role"])), F.lit(BETWEEN), e(t["text"]), F.lit(CLOSE))), "")


def pieces(output: Column) -> Column:
    """The output's turns as they stand, without closing lines."""
    cut = F.split(output, r"\n</turn>\n")
    return F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))


def parse(output: Column) -> Column:
    """The array of (role, text) that the grammar reads from an output."""

    def turn(piece: Column) -> Column:
        role_end = F.instr(piece, BETWEEN)
        role = F.substring(piece, F.lit(len(OPEN) + 1), role_end - (len(OPEN) + 1))
        text = F.substring(piece, role_end + len(BETWEEN), F.length(piece))
        ok = F.startswith(piece, F.lit(OPEN)) & (role_end > len(OPEN))
        return F.struct(F.when(ok, unescape_role(unescape(role))).alias("role"), F.when(ok, unescape(text)).alias("text"))

    return F.transform(pieces(output), turn)


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (role, text), output, escaped, parsed (read back from the output)."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").cast("bigint").alias("turn"), s("role").alias("role"), s("text").alias("text")).alias("t"))
    one = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    one = one.withColumn("turns", F.transform(_nulls_first("t"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).drop("t")
    raw = one.withColumn("plain", render(F.col("turns"), escaped=False))
    kept = raw.withColumn("escaped", ~F.coalesce(parse(F.col("plain")) == F.col("turns"), F.lit(False)))
    out = kept.withColumn("output", F.when(F.col("escaped"), render(F.col("turns"), escaped=True)).otherwise(F.col("plain"))).drop("plain")
    out = out.withColumn("parsed", parse(F.col("output")))
    same = F.coalesce(F.col("parsed") == F.col("turns"), F.lit(False))
    return out.withColumn("parsed", F.when(same, F.col("parsed")).otherwise(F.raise_error(F.lit("a conversation cannot be read back from its output")).cast("array<struct<role:string,text:string>>")))


def _nulls_first(name: str) -> Column:
    """array_sort puts null fields first already; kept apart so that the order is stated in one place."""
    return F.col(name)


def loss_spans(output: Column, role: str = ASSISTANT) -> Column:
    """Spans (start from 0, length) of the texts of a role in an output, in code points."""
    cut = pieces(output)

    def step(acc: Column, piece: Column) -> Column:
        role_end = F.instr(piece, BETWEEN)
        name = unescape_role(unescape(F.substring(piece, F.lit(len(OPEN) + 1), role_end - (len(OPEN) + 1))))
        at = acc["at"]
        span = F.struct((at + role_end + len(BETWEEN) - 1).alias("start"), (F.length(piece) - role_end - len(BETWEEN) + 1).alias("length"))
        spans = F.when(name == role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((at + F.length(piece) + len(CLOSE)).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(cut, zero, step, lambda a: a["spans"])


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, all read back from the output."""
    spans = loss_spans(F.col("output"))
    loss = F.array_join(F.transform(F.col("spans"), lambda s: unescape(F.substring(F.col("output"), s["start"] + 1, s["length"]))), "")
    return (
        formatted.withColumn("spans", spans)
        .withColumn("loss", loss)
        .select(
            "conv_id",
            F.size("parsed").cast("bigint").alias("n_turns"),
            F.sha2(F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("bigint").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("output").cast("bigint").alias("formatted_chars"),
        )
    )
