"""Quality rules: fixed base limits and a learned decision list.

Statistics of every whole text are counted once.  Sequential covering grows conjunctions of
thresholds on labelled statistics by information gain, prunes them on held-out labels, and stops when
a rule is no longer precise; the ordered rules become one conditional Spark expression.  The fit reads
at most FIT_ROWS labelled documents (those of the smallest id hash); everything else covers all rows.

Defined results: a null text has no words (base_failed); a null doc_id is kept and unlabelled;
repeated rows are judged each; labels that contradict each other count as they come; without usable
labels the list is empty and only the base limits decide; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ship, table

#: Bound of the labelled sample; least precision and cover of a rule; conditions in a rule; rules.
FIT_ROWS, PRECISION, COVER, CONDITIONS, RULES = 20_000, 0.97, 8, 4, 16
MIN_WORDS, REPEAT_PERCENT = 50, 50

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct", "longest"]
_SPACE, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def _keep(chars: bytes) -> bytes:
    return bytes(i for i in range(256) if i not in chars)


_UPPER, _LETTER = _keep(bytes(range(65, 91))), _keep(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT, _MARK = _keep(b"0123456789"), _keep(b"!?|/\\{}[]=~^@_+\"")


def repeat_words(words: list) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    seen, many = set(), set()
    for w in windows:
        (many if w in seen else seen).add(w)
    count = end = 0
    for i, w in enumerate(windows):
        if w in many:
            count += i + 3 - max(end, i)
            end = i + 3
    return count


def measure(text: str | None) -> tuple:
    """STATS of one whole text."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(raw.translate(None, _UPPER)),
        len(raw.translate(None, _LETTER)),
        len(raw.translate(None, _DIGIT)),
        len(raw.translate(None, _MARK)),
        len(set(words)),
        max(map(len, words), default=0),
    )


def _measure_beside(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            part = b.slice(lo, 1024)
            cols = np.array([measure(t) for t in part.column("text").to_pylist()], np.int64).reshape(-1, len(STATS))
            stats = pa.StructArray.from_arrays(list(map(pa.array, cols.T.copy())), STATS)
            yield pa.RecordBatch.from_arrays([*part.columns, stats], [*part.schema.names, "_stats"])


def _measure(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            part = b.slice(lo, 1024)
            cols = np.array([measure(t) for t in part.column("text").to_pylist()], np.int64).reshape(-1, len(STATS))
            keep = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *map(pa.array, cols.T.copy())], [*keep, *STATS])


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and STATS of each row's text."""
    ship(docs.sparkSession)
    keep = [c for c in keep if c != "text"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{s} long" for s in STATS])
    return docs.select(*keep, "text").mapInArrow(lean(_measure), schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def _ratio(a: str, b: str) -> tuple:
    return f"{a} / {b}", lambda c: c[a] / np.maximum(c[b], 1), F.col(a) / F.greatest(F.col(b), F.lit(1))


#: What the rules may test: name, on arrays, as a Spark expression.
def features() -> list[tuple]:
    plain = [(s, lambda c, s=s: c[s].astype(float), F.col(s).cast("double")) for s in ("n_words", "longest")]
    pairs = [("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_upper", "n_letters"), ("n_digits", "word_chars"), ("n_marks", "n_words"), ("n_distinct", "n_words"), ("n_words", "n_lines")]
    return plain + [_ratio(a, b) for a, b in pairs]


def _cuts(values: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring quantiles of the values seen."""
    seen = np.unique(np.quantile(values, np.linspace(0, 1, 65)))
    return (seen[1:] + seen[:-1]) / 2


def _holds(x: np.ndarray, rule: list) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def _grow(x: np.ndarray, y: np.ndarray) -> list:
    """Add the condition of the largest information gain until the rule covers no good document."""
    rule, inside = [], np.ones(len(x), bool)
    while len(rule) < CONDITIONS and (~y[inside]).any():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        base, best = np.log2(p0 / (p0 + n0)) if p0 else 0.0, (0.0, None)
        for f in range(x.shape[1]):
            v, own = x[inside, f], y[inside]
            for cut in _cuts(v):
                for above in (True, False):
                    ok = v > cut if above else v <= cut
                    p, n = own[ok].sum(), ok.sum() - own[ok].sum()
                    if p < COVER:
                        continue
                    gain = p * (np.log2(p / (p + n)) - base)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, above, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = _holds(x, rule)
    return rule


def _prune(rule: list, x: np.ndarray, y: np.ndarray) -> list:
    """Drop trailing conditions while that does not lower the worth on held-out labels."""

    def worth(r):
        ok = _holds(x, r)
        p, n = y[ok].sum(), (~y[ok]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, y: np.ndarray) -> list[list[tuple]]:
    """Ordered conjunctions of (feature, above, threshold) that pick the bad documents (y true)."""
    order = np.random.default_rng(6).permutation(len(x))
    held = np.zeros(len(x), bool)
    held[order[: len(x) // 3]] = True
    left, rules = np.ones(len(x), bool), []
    while len(rules) < RULES and (y & left & ~held).sum() >= COVER:
        rule = _grow(x[left & ~held], y[left & ~held])
        if not rule:
            break
        rule = _prune(rule, x[left & held], y[left & held])
        ok = _holds(x, rule) & left
        bad, test = y[ok].sum(), y[ok & held]
        if bad < COVER or bad / ok.sum() < PRECISION or (test.size and test.mean() < PRECISION - 0.05):
            break
        rules.append(rule)
        left &= ~ok
    return rules


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[list[tuple]]:
    """A decision list from the labelled documents; at most `rows` of them reach the driver.

    Of rows that share a labelled id the one with the least statistics stands; contradicting labels both count.
    """
    known = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    stats = statistics(joined, "doc_id", "quality").filter(~base_failed())
    # one row a labelled row, whatever repeats its id: the least by its statistics
    stats = stats.groupBy("doc_id", "quality").agg(F.min(F.struct(*STATS)).alias("s")).select("quality", "s.*").toPandas()
    if not len(stats):
        return []
    cols = {c: stats[c].to_numpy() for c in STATS}
    x, y = np.column_stack([f(cols) for _, f, _ in features()]), stats["quality"].to_numpy() == 0
    order = np.lexsort((*x.T, y))  # the split must not depend on the order of arrival
    return learn(x[order], y[order])


def verdict(rules: list[list[tuple]]) -> Column:
    """The ordered list as one conditional expression: true keeps."""
    own, chain = features(), None
    for rule in rules:
        test = None
        for f, above, cut in rule:
            one = own[f][2] > F.lit(cut) if above else own[f][2] <= F.lit(cut)
            test = one if test is None else test & one
        chain = F.when(test, F.lit(False)) if chain is None else chain.when(test, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def describe(rules: list[list[tuple]]) -> list[str]:
    names = [n for n, _, _ in features()]
    return [" and ".join(f"{names[f]} {'>' if up else '<='} {cut:.4g}" for f, up, cut in r) for r in rules]


def judge(docs: DataFrame, rules: list[list[tuple]], *keep: str) -> DataFrame:
    """The kept columns, STATS, base_failed and kept."""
    return statistics(docs, *keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def filter_documents(docs: DataFrame, rules: list[list[tuple]]) -> DataFrame:
    """The documents that stay, all columns; the text passes by its statistics, nothing is joined."""
    ship(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", _stats struct<{', '.join(s + ': bigint' for s in STATS)}>"
    wide = docs.mapInArrow(lean(_measure_beside), schema)
    inner = wide.select(F.struct(*docs.columns).alias("_row"), "_stats.*")
    return inner.filter(~base_failed() & verdict(rules)).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    done = judge(docs, fit(docs, table(spark, sf_dir, "labels")), "doc_id")
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
