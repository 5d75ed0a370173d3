r"""Chat formatting with typed content parts.

A conversation is a row per turn whose content is a list of typed parts.  A visitor flattens the parts,
in order: text as it is but for escaped control characters, image, audio and document parts as
placeholders, with the attachment's reference and the tokens it will expand to on record.  The
template is `<s>[ROLE]content[/ROLE]</s>` a turn, user turns under the role INST.  Inside texts every
`<` and `[` is followed by a backslash and every backslash is doubled, so no control string can appear
there and the text can be read back.  The loss mask lists the character ranges of assistant contents.
Everything is DataFrame operations.

A conversation is one output string, so its turns meet in one row; nothing else gathers a group.

Defined results: null texts and roles are empty; a null turn sorts first; ties go by role, then content;
repeated rows stay; rows of a null conv_id are one conversation; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, with_running

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
#: An image costs a token per patch of this edge, audio so many a second, a document so many a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("[\\"), F.lit("[")), F.lit("<\\"), F.lit("<"))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def role_tag(role: Column) -> Column:
    """Text between the brackets; free of `]` and `/`, and INST only for the user."""
    coded = role
    for plain, code in (("%", "%25"), ("]", "%5D"), ("/", "%2F")):
        coded = F.replace(coded, F.lit(plain), F.lit(code))
    return F.when(role == "user", "INST").when(role == "INST", "%49NST").otherwise(escape(coded))


def role_read(tag: Column) -> Column:
    coded = unescape(tag)
    for plain, code in (("/", "%2F"), ("]", "%5D"), ("%", "%25")):
        coded = F.replace(coded, F.lit(code), F.lit(plain))
    return F.when(tag == "INST", "user").when(tag == "%49NST", "INST").otherwise(coded)


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder expands to; 0 for text."""
    n = lambda c, d: F.coalesce(part[c], F.lit(d))
    image = F.greatest(F.lit(1), F.ceil(n("width", PATCH) / PATCH) * F.ceil(n("height", PATCH) / PATCH))
    audio = F.greatest(F.lit(1), F.ceil(n("seconds", 0.0) * AUDIO_RATE))
    pages = F.greatest(F.lit(1), n("pages", 1)) * PAGE_TOKENS
    kind = part["type"]
    return F.when(kind == "image", image).when(kind == "audio", audio).when(kind == "document", pages).otherwise(0).cast("long")


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")).isin("image", "audio", "document")


def visit(part: Column) -> Column:
    """A part's place in the flattened content."""
    return F.when(is_attachment(part), F.concat(F.lit("<"), part["type"], F.lit(">"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def text_part(text: Column) -> Column:
    """A column of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))).cast(f"array<{PART}>")


def format_chat(turns: DataFrame) -> DataFrame:
    """turns: (conv_id, turn, role, parts array<PART>).

    Gives (conv_id, formatted, loss array<struct<start, length>>, attachments array<struct<turn, place,
    type, ref, tokens>>, expanded_tokens): ranges are in characters of `formatted`, and expanded_tokens
    is what all placeholders stand for.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    content = lambda t: F.array_join(F.transform(t["parts"], visit), "")
    convs = convs.withColumn("own", F.transform("turns", lambda t: F.struct(F.concat(F.lit("<s>["), role_tag(t["role"]), F.lit("]")).alias("open"), content(t).alias("content"), F.concat(F.lit("[/"), role_tag(t["role"]), F.lit("]</s>")).alias("close"), (t["role"] == "assistant").alias("learn"))))
    size = lambda t: (F.char_length(t["open"]) + F.char_length(t["content"]) + F.char_length(t["close"])).cast("long")
    convs = with_running(convs.withColumn("sizes", F.transform("own", size)), at="sizes")
    ranges = F.filter(F.zip_with("own", "at", lambda t, a: F.struct(t["learn"].alias("learn"), (a + F.char_length(t["open"])).alias("start"), F.char_length(t["content"]).cast("long").alias("length"))), lambda x: x["learn"])
    held = F.flatten(F.transform("turns", lambda t, i: F.transform(F.filter(t["parts"], is_attachment), lambda p, k: F.struct(i.alias("turn"), k.alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))))
    return convs.select(
        "conv_id",
        F.array_join(F.flatten(F.transform("own", lambda t: F.array(t["open"], t["content"], t["close"]))), "").alias("formatted"),
        F.transform(ranges, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"),
        held.alias("attachments"),
        F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, placeholders as they stand."""
    whole = F.filter(F.split(formatted, "</s>"), lambda x: x != "")
    tag = lambda x: F.regexp_extract(x, r"^<s>\[([^\]]*)\]", 1)
    inner = lambda x: F.substr(x, F.char_length(tag(x)) + 6, F.char_length(x) - 2 * F.char_length(tag(x)) - 8)
    return F.transform(whole, lambda x: F.struct(role_read(tag(x)).alias("role"), unescape(inner(x)).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda r: unescape(F.substr(formatted, (r["start"] + 1).cast("int"), r["length"].cast("int")))), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: digests read back from every formatted conversation and from a probe of control strings."""
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = said.unionByName(probe).withColumn("parts", text_part(F.col("text")))
    done = format_chat(turns).withColumn("turns", read_back(F.col("formatted"))).withColumn("learnt", loss_text(F.col("formatted"), F.col("loss")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: The columns that do not depend on the template.
ORACLE_COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"]
