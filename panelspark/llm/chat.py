"""Chat formatting by relational means: the turns of a conversation are collected as structs and sorted, adjacent turns
of one role are merged into blocks by array expressions, and the blocks are concatenated.

Template::

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT ...]<|im_end|>\\n

Control strings cannot occur inside a text: a backslash is doubled and ``<|`` becomes ``<\\|``; a newline inside a
role becomes ``<|im_nl|>``. ``unescape`` undoes this exactly.

Defined cases: null text and null role are empty strings; turns are ordered by (turn, role, text) with null turns
first, so repeated turns and repeated rows stay and keep a fixed order; a null conversation id is one conversation;
an empty table gives no rows; other columns of the input are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "<|im_nl|>"
STRETCH = 512  # array elements summed at once
END_RE, SEP_RE = r"<\|im_end\|>\n", r"<\|im_sep\|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def starts_of(sizes: Column) -> Column:
    """The sums of all elements before each one. Sums of stretches of ``STRETCH`` come first, so that a very long array takes
    no quadratic time."""
    stretches = F.sequence(F.lit(0), F.greatest(F.floor((F.size(sizes) - 1) / STRETCH), F.lit(0)).cast("int"))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    before = lambda x: F.transform(x, lambda _, i: total(F.slice(x, F.lit(1), i)))
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  a lambda's variable is worked out once
    parts = F.transform(stretches, lambda c: F.slice(sizes, c * STRETCH + 1, STRETCH))
    add = lambda part, base: F.transform(before(part), lambda v: base + v)
    return once(parts, lambda ps: F.flatten(F.zip_with(ps, once(F.transform(ps, total), before), add)))


def format_chat(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans, n_blocks``.

    ``loss_spans`` are (start, length) in code points of ``formatted``, from 0, one for each text of a loss role.
    One shuffle, by conversation, and one aggregation; all else are expressions on the sorted array of its turns. A
    conversation is one row of the result, so its turns meet in one task whatever the way."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select("conv_id", said.alias("said")).groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("turns"))

    def piece(turn: Column, at: Column) -> Column:
        """What a turn adds: the end of the block before it and the head of its own where the role changes, else a separator."""
        before = F.get(F.col("turns"), at - 1)["role"]
        name = F.replace(escape(turn["role"]), F.lit("\n"), F.lit(NEWLINE))
        opens = F.when(at == 0, True).otherwise(before != turn["role"])
        head = F.when(at == 0, F.concat(F.lit(START), name, F.lit("\n"))).when(opens, F.concat(F.lit(END + START), name, F.lit("\n")))
        return F.struct(
            F.coalesce(head, F.lit(SEP)).alias("head"), escape(turn["text"]).alias("body"), turn["role"].isin(*loss_roles).alias("in_loss"), opens.alias("opens"))

    rows = rows.select("conv_id", F.transform("turns", piece).alias("pieces"))
    sizes = F.transform("pieces", lambda p: (F.length(p["head"]) + F.length(p["body"])).cast("long"))
    rows = rows.select("conv_id", "pieces", sizes.alias("sizes")).select("conv_id", "pieces", starts_of(F.col("sizes")).alias("starts"))
    span = lambda p, start: F.struct(
        p["in_loss"].alias("in_loss"), (start + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("length"))
    spans = F.filter(F.zip_with("pieces", "starts", span), lambda s: s["in_loss"])
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    return rows.select(
        "conv_id", F.concat(text, F.lit(END)).alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
        F.size(F.filter("pieces", lambda p: p["opens"])).cast("long").alias("n_blocks"))


def read_turns(formatted: Column) -> Column:
    """The turns read back from a formatted conversation: array of (role, text)."""
    blocks = F.filter(F.split(formatted, END_RE, -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        line = F.position(F.lit("\n"), block)
        role = F.substring(block, F.lit(len(START) + 1), line - len(START) - 1)
        role = unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))
        texts = F.split(F.substr(block, line + 1), SEP_RE, -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(
            spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
        ),
        "",
    )


def chat_digest(chats: DataFrame) -> DataFrame:
    """Digest of ``format_chat``'s rows, everything read back from the formatted text and its loss mask."""
    turns = read_turns(F.col("formatted"))
    read = chats.select(
        "conv_id", "n_blocks", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("n_blocks").cast("long").alias("n_blocks"),
    )
