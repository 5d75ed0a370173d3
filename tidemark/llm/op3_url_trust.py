"""URL filters by link-graph propagation.

Rules decide urls that they fit.  Hosts of allowed and blocked urls seed two walks over the host graph
of links that name a host (absolute or protocol-relative): personalised PageRank carries trust along links from trusted hosts, its reverse
carries distrust from blocked hosts back to those that link to them.  A host whose distrust outweighs
its trust is blocked, all others are allowed.  Everything is DataFrame operations.

Defined results: a null url, or one without `://`, has an empty host and path; such rows fit no rule and
belong to no host, so they are allowed; a null html has no links; a null page_id is kept; repeated rows
are judged each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_ascii, table

#: (rule as printed, host, path, verdict)
RULES = [
    ("org/", "org", "/", "allow"),
    ("example.org/es/", "example.org", "/es/", "block"),
    ("example.org/en/1", "example.org", "/en/1", "block"),
    ("com/fr/", "com", "/fr/", "allow"),
    ("com/de/", "com", "/de/", "block"),
]
#: Damping; rounds that the check SQL unrolls (the walks have no such limit); largest relative change of a
#: host's score at which the walks end; blocked from this multiple of the trust on.
DAMPING, ROUNDS, SETTLED, OUTWEIGH = 0.85, 20, 1e-6, 2.0
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def split_url(url):
    """Host and path of a url column."""
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)


def rule_of(host, path, rules=RULES):
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for text, h, p, v in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): each host's shares of its links to other hosts, adding up to 1."""
    host, _ = split_url(F.col("url"))
    found = F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(1)))
    links = pages.filter(F.contains("html", F.lit("//"))).select(host.alias("src"), F.explode(found).alias("dst"))
    links = links.select("src", lower_ascii(F.col("dst")).alias("dst")).filter("src <> '' and src <> dst")
    counted = links.groupBy("src", "dst").count()
    return counted.join(counted.groupBy("src").agg(F.sum("count").alias("all")), "src").select("src", "dst", (F.col("count") / F.col("all")).alias("w"))


def walk(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, score): personalised PageRank.  edges (src, dst, w), seeds (host, seed) adding up to 1.

    Rounds go on until every score has settled, so all hosts that a seed reaches have one.
    """
    rest = 1.0 - damping
    base = seeds.select("host", (F.col("seed") * rest).alias("base"))
    score = base.select("host", F.col("base").alias("score"))
    while True:
        passed = edges.join(score, edges.src == score.host).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("w") * damping).alias("in"))
        new = base.join(passed, "host", "full").select("host", (F.coalesce("base", F.lit(0.0)) + F.coalesce("in", F.lit(0.0))).alias("score"))
        new = cut(new)
        moved = new.join(score.withColumnRenamed("score", "old"), "host", "left").agg(F.max(F.try_divide(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))), "score"))).first()[0]
        score = new
        if (moved or 0.0) < SETTLED:
            return score


def host_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """(host, trust, distrust, verdict) of every host that has a score."""
    host, path = split_url(F.col("url"))
    _, said = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select(host.alias("host"), path.alias("path")).filter("host <> ''").withColumn("said", said)
    seeds = cut(urls.filter("said is not null").groupBy("host").agg(F.sum((F.col("said") == "allow").cast("long")).alias("good"), F.sum((F.col("said") == "block").cast("long")).alias("bad")))
    total = seeds.agg(F.sum("good"), F.sum("bad")).first()
    edges = cut(host_edges(pages))
    linked = bool(edges.limit(1).count())

    def scores(column, all_, links):
        own = seeds.filter(F.col(column) > 0).select("host", (F.col(column) / F.lit(float(all_ or 1))).alias("seed"))
        return walk(links, own) if linked and all_ else own.select("host", (F.col("seed") * (1 - DAMPING)).alias("score"))

    back = edges.groupBy("dst").agg(F.sum("w").alias("all"))
    reverse = edges.join(back, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") / F.col("all")).alias("w"))
    trust = scores("good", total[0], edges).withColumnRenamed("score", "trust")
    distrust = scores("bad", total[1], reverse).withColumnRenamed("score", "distrust")
    both = trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    blocked = (F.col("distrust") > 0) & (F.col("distrust") >= F.col("trust") * OUTWEIGH)
    return both.withColumn("verdict", F.when(blocked, "block").otherwise("allow"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row."""
    host, path = split_url(F.col("url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "said": said})
    done = urls.join(host_verdicts(pages, rules).withColumnRenamed("verdict", "own"), "host", "left")
    return done.select("page_id", "host", "path", "rule", F.coalesce("said", "own", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: rule and verdict of every page."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
