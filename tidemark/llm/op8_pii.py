"""Personal data: fixed patterns and bootstrapped contextual extraction.

Fixed patterns find e-mail addresses, IP addresses, payment cards and phone numbers in whole texts.
These are the seeds.  Words around seeds, and the seeds' character shapes, are lexical patterns; words
with a digit that no seed covers are the candidates.  Patterns and instances form a graph: a pattern is
worth the share of its instances that are believed, an instance is believed by the patterns that it
shows, and believed instances raise patterns that no seed showed; rounds go on until the scores have
settled.  Candidates that well-supported patterns carry over the threshold become spans of their kind.
Everything is DataFrame operations.

Positions are in code points, ends exclusive.  The patterns are written so that the engine's regular
expressions neither recurse nor rescan a run of characters, whatever a text's length.

Defined results: a null text is empty; a null doc_id is kept; repeated rows are judged each; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_ascii, table, with_running

KINDS = ["email", "ip", "card", "phone"]
#: Fixed patterns: kind -> (regular expression, what a text must hold to be searched).
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
_WS, _NOT_WS = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_CANDIDATE = rf"(?<!{_NOT_WS})(?=[^\x20\x09-\x0D0-9]*+[0-9]){_NOT_WS}++"
#: Seeds or believed instances a pattern needs; share of a pattern's instances that must be such; least score of a
#: new span; least characters of a candidate; change of all scores at which they have settled.
SUPPORT, CONFIDENCE, BELIEF, SHORTEST, SETTLED = 5, 0.9, 0.9, 6, 1e-6
SPAN = "struct<start: bigint, end: bigint, kind: string>"
_HIT = "array<struct<start: bigint, end: bigint, word: string, left: string, right: string>>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def with_hits(rows: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds, for each name, the leftmost non-overlapping matches of its pattern in `text`, in order:
    array<struct<start, end, word, left, right>>.  patterns: name -> (pattern, rows to search).

    Matches and the gaps between them give the positions; each step is a projection of its own, so
    that a text is searched once for its matches and, if it has any, once for its gaps.
    """
    own, word = list(patterns), "array<string>"
    rows = rows.withColumns({f"_m_{n}": F.when(where, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(_none(word)) for n, (p, where) in patterns.items()})
    rows = rows.withColumns({f"_g_{n}": F.when(F.size(f"_m_{n}") > 0, F.split("text", p, -1)).otherwise(_none(word)) for n, (p, _) in patterns.items()})
    size = lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long")
    rows = rows.withColumns({f"_s_{n}": F.zip_with(F.slice(f"_g_{n}", F.lit(1), F.size(f"_m_{n}")), f"_m_{n}", size) for n in own})
    rows = with_running(rows, **{f"_r_{n}": f"_s_{n}" for n in own})

    def made(n):
        gaps, run, sizes = F.col(f"_g_{n}"), F.col(f"_r_{n}"), F.col(f"_s_{n}")

        def one(m, i):
            end = F.get(run, i) + F.get(sizes, i)
            left = F.regexp_extract(F.get(gaps, i), rf"(?<!{_NOT_WS})({_NOT_WS}++){_WS}*+$", 1)
            right = F.regexp_extract(F.get(gaps, i + 1), rf"^{_WS}*+({_NOT_WS}++)", 1)
            return F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("word"), left.alias("left"), right.alias("right"))

        read = run.isNull() | sizes.isNull() | (F.size(run) + F.size(sizes) == 0)
        return F.when(read, _none(_HIT)).otherwise(F.transform(f"_m_{n}", one).cast(_HIT))

    rows = rows.withColumns({n: made(n) for n in own})
    return rows.drop(*(f"_{x}_{n}" for x in "mgsr" for n in own))


def luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substr(digits, F.char_length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, d).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, word: Column) -> Column:
    digits = F.regexp_replace(word, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        parts = F.transform(F.split(word, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def order(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("r"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _passes(kind: str):
    return lambda h: passes(kind, h["word"])


def _span(kind: str):
    return lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.lit(kind).alias("kind"))


def _seed(kind: str):
    return lambda h: F.struct(h["word"].alias("word"), h["left"].alias("left"), h["right"].alias("right"), F.lit(kind).alias("kind"))


def find(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, d and k (the row's key), base array<SPAN>, and seeds and candidates with context."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, text.alias("text"))
    rows = rows.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "k": F.xxhash64("text", F.col("doc_id").isNull()), "digit": F.rlike("text", F.lit("[0-9]"))})
    where = {kind: F.contains("text", F.lit(mark)) if mark else F.lit(True) for kind, (_, mark) in PATTERNS.items()}
    where = {kind: w if kind == "email" else w & F.col("digit") for kind, w in where.items()}
    rows = with_hits(rows, {kind: (PATTERNS[kind][0], where[kind]) for kind in KINDS} | {"candidates": (_CANDIDATE, F.col("digit"))})
    rows = rows.withColumns({kind: F.filter(kind, _passes(kind)) for kind in KINDS})
    base = F.concat(*(F.transform(kind, _span(kind)) for kind in KINDS))
    seeds = F.concat(*(F.transform(kind, _seed(kind)) for kind in KINDS))
    rows = rows.withColumns({"base": order(base), "seeds": seeds})
    long = F.filter("candidates", lambda h: F.char_length(h["word"]) >= SHORTEST)
    free = F.filter(long, lambda h: ~F.exists("base", lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"])))
    return rows.select(*keep, "d", "k", "base", "seeds", free.alias("candidates"))


def shape(word: Column) -> Column:
    """Character classes: letters as one a, short digit runs as one 9, long ones by their length."""
    s = F.regexp_replace(F.regexp_replace(word, r"\p{L}+", "a"), "[0-9]", "9")
    return F.regexp_replace(s, "(?<!9)9{1,3}(?!9)", "9")


def _shown(rows: DataFrame) -> DataFrame:
    """(instance, pattern) for rows of (word, left, right, ...)."""
    shows = F.array(
        F.concat(F.lit("L "), lower_ascii(F.col("left"))),
        F.concat(F.lit("R "), lower_ascii(F.col("right"))),
        F.concat(F.lit("S "), shape(F.col("word"))),
    )
    return rows.withColumn("instance", F.xxhash64("word")).withColumn("pattern", F.explode(shows)).filter("length(pattern) > 2").withColumn("pattern", F.xxhash64("pattern"))


def bootstrap(found: DataFrame) -> DataFrame:
    """(instance, kind, belief) of candidates believed to be personal data.  found: rows of find().

    Seeds and believed instances raise patterns, confident patterns raise instances, until neither grows and the scores
    have settled.  Scores never fall from round to round, so this ends.
    """
    seeds = _shown(found.select(F.explode("seeds").alias("s")).select("s.*"))
    seeds = cut(seeds.groupBy("kind", "pattern", "instance").agg(F.count("*").alias("n")))
    free = _shown(found.select(F.explode("candidates").alias("c")).select("c.word", "c.left", "c.right"))
    free = cut(free.groupBy("pattern", "instance").agg(F.count("*").alias("n")))
    every = cut(free.groupBy("pattern").agg(F.sum("n").alias("all")))
    own = seeds.select("kind", "pattern", F.lit(1).alias("support"), F.col("n").alias("seen"), F.lit(0.0).alias("good"))
    belief, before = None, None
    while True:
        raised = own
        if belief is not None:
            held = free.join(belief, "instance").select("kind", "pattern", (F.col("belief") >= BELIEF).cast("int").alias("support"), F.lit(0).cast("long").alias("seen"), (F.col("n") * F.col("belief")).alias("good"))
            raised = own.unionByName(held)
        strong = raised.groupBy("kind", "pattern").agg(F.sum("support").alias("support"), F.sum("seen").alias("seen"), F.sum("good").alias("good")).filter(F.col("support") >= SUPPORT)
        worth = strong.join(every, "pattern").select("kind", "pattern", ((F.col("seen") + F.col("good")) / (F.col("seen") + F.col("all"))).alias("worth")).filter(F.col("worth") >= CONFIDENCE)
        doubt = F.product(1 - F.least("worth", F.lit(0.999)))
        belief = cut(free.join(worth, "pattern").groupBy("kind", "instance").agg((1 - doubt).alias("belief")))
        state = belief.agg(F.count("*"), F.count(F.when(F.col("belief") >= BELIEF, 1)), F.coalesce(F.sum("belief"), F.lit(0.0))).first()
        if before is not None and state[:2] == before[:2] and abs(state[2] - before[2]) <= SETTLED * max(1.0, state[2]):
            break
        before = state
    best = belief.filter(F.col("belief") >= BELIEF).groupBy("instance").agg(F.max_by("kind", F.struct("belief", "kind")).alias("kind"), F.max("belief").alias("belief"))
    return best.select("instance", "kind", "belief")


def extract(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns (doc_id at least), base and all spans: array<SPAN> in order."""
    keep = keep or ("doc_id",)
    found = cut(find(docs, *keep))
    new = found.select("d", "k", F.explode("candidates").alias("c")).withColumn("instance", F.xxhash64("c.word")).join(bootstrap(found), "instance")
    new = new.groupBy("d", "k").agg(F.collect_set(F.struct("c.start", "c.end", "kind")).alias("new"))
    done = found.select(*keep, "d", "k", "base").join(new, ["d", "k"], "left")
    added = F.coalesce(F.col("new").cast(f"array<{SPAN}>"), _none(f"array<{SPAN}>"))
    return done.select(*keep, "base", order(F.concat("base", added)).alias("spans"), "d", "k")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; all columns stay.

    Overlapping spans become one, named for the first of them.
    """
    cols = docs.columns
    rows = docs.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn("_k", F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()))
    spans = extract(docs, "doc_id").filter(F.size("spans") > 0).groupBy("d", "k").agg(F.first("spans").alias("_spans"))
    done = rows.join(spans, (rows._d == spans.d) & (rows._k == spans.k), "left")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<gap: string, kind: string>>").alias("out"))

    def step(acc, s):
        gap = F.substr("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.concat(acc["out"], F.array(F.struct(gap.alias("gap"), s["kind"].alias("kind"))))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, new).otherwise(acc["out"]).alias("out"))

    done = done.withColumn("_w", F.aggregate("_spans", zero, step))
    walked = F.col("_w")
    tail = lambda w: F.substr("text", (w["at"] + 1).cast("int"), F.lit(2147483647))
    cleaned = F.concat(F.array_join(F.transform(walked["out"], lambda x: F.concat(x["gap"], F.lit("["), F.upper(x["kind"]), F.lit("]"))), ""), tail(walked))
    return done.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cleaned)).select(*cols)


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: counts, digest and spans of every document."""
    done = extract(table(spark, sf_dir, "documents"), "doc_id")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return done.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


__all__ = ["bootstrap", "extract", "find", "query", "redact"]
