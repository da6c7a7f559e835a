"""Chat formatting: turns to one training text with a loss mask, and back.

Native: DataFrame functions only.

The template writes each run of adjacent turns of one role as

    ### ROLE:\\n TEXT [<turn/> TEXT ...] </turn>\\n

where control strings inside texts are escaped, so that reading back gives every turn again. A backslash becomes
\\s, ### becomes \\h, </turn> becomes \\e and <turn/> becomes \\m; in roles, a line feed becomes \\l as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END, NEXT = "###", "</turn>", "<turn/>"
#: In the order of escaping; unescaping goes backwards.
ESCAPES = [("\\", "\\s"), (HEAD, "\\h"), (END, "\\e"), (NEXT, "\\m")]
#: Elements and characters that are taken at a time.
BLOCK, CHARS = 256, 4096


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in [*ESCAPES, *([("\n", "\\l")] if role else [])]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, code in reversed([*ESCAPES, *([("\n", "\\l")] if role else [])]):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The column, worked out once for each row: as a generator's output it isn't put into lambdas that read it, where it
    would be worked out again for each element."""
    return df.withColumn(name, F.explode(F.array(value)))


def with_prefix_sums(df: DataFrame, lengths: str, name: str) -> DataFrame:
    """A column with the sum of what stands before each element of an array of longs, in blocks of BLOCK: a block costs its
    square, and blocks cost the square of their number, so an array of n elements costs about n * BLOCK / 2 additions."""
    n = F.size(lengths)
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    df = _held(df, "_of_block", F.transform(blocks, lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))))
    df = _held(df, "_before", F.transform("_of_block", lambda x, b: _sum(F.slice("_of_block", F.lit(1), b))))
    in_block = lambda i: F.floor(i / BLOCK).cast("int")
    df = _held(df, name, F.transform(lengths, lambda x, i: F.get("_before", in_block(i)) + _sum(F.slice(lengths, in_block(i) * BLOCK + 1, i % BLOCK))))
    return df.drop("_of_block", "_before")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) for each conversation; spans are (start, length) in code points of `formatted`.

    Rows are sorted by turn (null first), then role and text, so ties and repeated rows have a defined order; repeated
    rows are turns of their own. A null role or text counts as empty, a null conv_id is a conversation. Adjacent turns
    of one role are merged under one header. The mask covers each assistant text, without template strings.
    An empty table gives an empty result. A conversation is one text, so it has to fit in one row.
    """
    t = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    t = _held(t.groupBy("conv_id").agg(F.collect_list("t").alias("t")), "ts", F.sort_array("t")).drop("t")
    n = F.size("ts")
    first = lambda i: (i == 0) | (F.get("ts", i - 1)["role"] != F.get("ts", i)["role"])
    last = lambda i: (i == n - 1) | (F.get("ts", i + 1)["role"] != F.get("ts", i)["role"])
    t = _held(t, "turns", F.transform("ts", lambda x, i: F.struct(
        x["role"].alias("role"),
        F.when(first(i), F.concat(F.lit(f"{HEAD} "), escape(x["role"], True), F.lit(":\n"))).otherwise(F.lit(NEXT)).alias("head"),
        escape(x["text"]).alias("body"),
        F.when(last(i), F.lit(f"{END}\n")).otherwise(F.lit("")).alias("tail"),
        first(i).alias("opens"),
    ))).drop("ts").withColumnRenamed("turns", "ts")
    # Runs of one role: from each opening turn up to the next.
    t = _held(t, "opens", F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("ts", i)["opens"]))
    runs = F.transform("opens", lambda o, k: F.slice("ts", o + 1, F.coalesce(F.get("opens", k + 1), n) - o))
    merged = F.transform(runs, lambda r: F.array_join(F.transform(r, lambda x: F.concat(x["head"], x["body"], x["tail"])), ""))
    t = _held(t, "lengths", F.transform("ts", lambda x: F.length(x["head"]) + F.length(x["body"]) + F.length(x["tail"])).cast("array<bigint>"))
    t = with_prefix_sums(t, "lengths", "starts")
    spans = F.filter(
        F.zip_with("ts", "starts", lambda x, s: F.struct(
            (s + F.length(x["head"])).alias("start"), F.length(x["body"]).cast("long").alias("length"), x["role"].alias("role"))),
        lambda x: x["role"] == loss_role,
    )
    return t.select(
        "conv_id", F.array_join(merged, "").alias("formatted"),
        F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: Column | str) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    formatted = F.col(formatted) if isinstance(formatted, str) else formatted
    blocks = F.split(formatted, f"{END}\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)  # after the last end mark stands nothing
    turned = F.transform(blocks, lambda b: F.struct(
        unescape(F.substring_index(b.substr(F.lit(len(HEAD) + 2), F.length(b)), ":\n", 1), True).alias("role"),
        F.split(b.substr(F.lit(len(HEAD) + 2) + F.length(F.substring_index(b.substr(F.lit(len(HEAD) + 2), F.length(b)), ":\n", 1)) + 2, F.length(b)), NEXT, -1).alias("texts"),
    ))
    return F.flatten(F.transform(turned, lambda t: F.transform(t["texts"], lambda x: F.struct(t["role"].alias("role"), unescape(x).alias("text")))))


def with_loss(df: DataFrame, formatted: str, spans: str, name: str) -> DataFrame:
    """A column with all text under the mask, unescaped. Code points are found by counting from a string's start, so the
    text is cut into blocks first, in two steps, and a span looks only into the blocks that it lies in."""
    def cut(df: DataFrame, into: str, of: str, chars: int, times: int) -> DataFrame:
        count = F.greatest(F.lit(1), F.ceil(F.length(formatted) / chars).cast("int"))
        start = (lambda i: F.substring(formatted, i * chars + 1, F.lit(chars))) if not of else (lambda i: F.substring(F.get(of, F.floor(i / times).cast("int")), i % times * chars + 1, F.lit(chars)))
        return _held(df, into, F.transform(F.sequence(F.lit(0), count - 1), start))

    df = cut(cut(df, "_large", "", 64 * CHARS, 1), "_small", "_large", CHARS, 64)
    at = lambda s: F.floor(s["start"] / CHARS).cast("int")
    upto = lambda s: F.floor((s["start"] + s["length"]) / CHARS).cast("int")
    within = lambda s: F.substring(F.array_join(F.slice("_small", at(s) + 1, upto(s) - at(s) + 1), ""), (s["start"] % CHARS + 1).cast("int"), s["length"].cast("int"))
    return _held(df, name, F.array_join(F.transform(spans, lambda s: unescape(within(s))), "")).drop("_large", "_small")


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from the output of format_conversations()."""
    d = with_loss(_held(formatted, "turns", read_back("formatted")), "formatted", "loss_spans", "loss")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
