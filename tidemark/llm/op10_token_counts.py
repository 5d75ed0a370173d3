"""Edit-aware token counts over per-document segment trees.

A text is cut at white space into leaf segments of about LEAF characters; their token counts add up
because no pre-token reaches across white space.  A tree of sums over the leaves gives the count of
the text and finds the leaves that an edit touches.  Only these leaves, widened to the neighbours
where an edit joins words across a leaf's edge, are encoded anew; then their sums up to the root are
put right.  A leaf that grows past twice its size is cut again.

Defined results: a null text is empty; edits outside the text are clipped to it; null parts of an edit
count as zero or empty; a null doc_id is kept; repeated rows are counted each; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .common import ship, table, tokenizer_path

LEAF = 512
EDITS = "array<struct<at: long, remove: long, insert: string>>"


def cut_leaves(text: str, leaf: int = LEAF) -> list[str]:
    """Pieces of the text, each but the first beginning with a blank or a line break."""
    out, lo, n = [], 0, len(text)
    while n - lo > leaf:
        spaces = [p for p in (text.find(" ", lo + leaf), text.find("\n", lo + leaf)) if p > 0]
        if not spaces:
            break
        out.append(text[lo : min(spaces)])
        lo = min(spaces)
    out.append(text[lo:])
    return out


class Node:
    """A leaf text with its tokens, and the sums of leaves, characters and tokens of its whole subtree."""

    __slots__ = ("chars", "leaves", "left", "own", "right", "text", "tokens")

    def __init__(self, text: str, own: int):
        self.text, self.own, self.left, self.right = text, own, None, None
        self.add_up()

    def add_up(self) -> Node:
        self.leaves, self.chars, self.tokens = 1, len(self.text), self.own
        for side in (self.left, self.right):
            if side is not None:
                self.leaves, self.chars, self.tokens = self.leaves + side.leaves, self.chars + side.chars, self.tokens + side.tokens
        return self


def balanced(nodes: list[Node], lo: int = 0, hi: int | None = None) -> Node | None:
    """A balanced tree of nodes in order."""
    hi = len(nodes) if hi is None else hi
    if lo >= hi:
        return None
    mid = (lo + hi) // 2
    root = nodes[mid]
    root.left, root.right = balanced(nodes, lo, mid), balanced(nodes, mid + 1, hi)
    return root.add_up()


def split(root: Node | None, k: int) -> tuple[Node | None, Node | None]:
    """The first k leaves and the others."""
    if root is None:
        return None, None
    before = root.left.leaves if root.left else 0
    if k <= before:
        a, root.left = split(root.left, k)
        return a, root.add_up()
    root.right, b = split(root.right, k - before - 1)
    return root.add_up(), b


class Tree:
    """Leaf texts in order as a balanced tree of sums: every edit takes O(log leaves) steps besides the leaves it touches.

    Two trees are joined under a root drawn in proportion to their sizes, which keeps them balanced whatever the edits.
    """

    def __init__(self, text: str, count, leaf: int = LEAF, tokens: list[int] | None = None):
        self.count, self.leaf, self.encoded, self.random = count, leaf, 0, random.Random(10)
        leaves = cut_leaves(text, leaf)
        tokens = tokens if tokens is not None else [count(x) for x in leaves]
        self.root = balanced([Node(t, n) for t, n in zip(leaves, tokens, strict=True)])

    @property
    def chars(self) -> int:
        return self.root.chars

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def nodes(self, root: Node | None):
        """The leaves of a subtree in order."""
        path = []
        while path or root is not None:
            while root is not None:
                path.append(root)
                root = root.left
            root = path.pop()
            yield root
            root = root.right

    def leaf_tokens(self) -> list[int]:
        return [x.own for x in self.nodes(self.root)]

    def text(self) -> str:
        return "".join(x.text for x in self.nodes(self.root))

    def join(self, a: Node | None, b: Node | None) -> Node | None:
        if a is None or b is None:
            return a or b
        if self.random.random() * (a.leaves + b.leaves) < a.leaves:
            a.right = self.join(a.right, b)
            return a.add_up()
        b.left = self.join(a, b.left)
        return b.add_up()

    def find(self, at: int) -> int:
        """The number of the leaf that holds a character position; the last one's for the text's end."""
        root, n = self.root, 0
        while True:
            before, chars = (root.left.leaves, root.left.chars) if root.left else (0, 0)
            if at < chars:
                root = root.left
            elif at < chars + len(root.text) or root.right is None:
                return n + before
            else:
                root, at, n = root.right, at - chars - len(root.text), n + before + 1

    def edit(self, at: int, remove: int, insert: str) -> None:
        """Replace `remove` characters at `at` by `insert`; both clipped to the text."""
        total = self.chars
        at = min(max(at, 0), total)
        end = min(at + max(remove, 0), total)
        i, j = self.find(at), self.find(end)
        a, rest = split(self.root, i)
        touched, b = split(rest, j - i + 1)
        texts, start = [x.text for x in self.nodes(touched)], a.chars if a else 0
        last = start + sum(map(len, texts[:-1]))
        new = texts[0][: at - start] + insert + texts[-1][end - last :]
        # a leaf must begin with its blank: else its first word may go on from the leaf before it
        while new[:1] not in (" ", "\n") and a is not None:
            a, before = split(a, a.leaves - 1)
            new = before.text + new
        pieces = [Node(t, self._counted(t)) for t in (cut_leaves(new, self.leaf) if len(new) > 2 * self.leaf else [new])]
        self.root = self.join(self.join(a, balanced(pieces)), b)

    def _counted(self, text: str) -> int:
        self.encoded += len(text)
        return self.count(text)


def _counter(path):
    enc = encoder(path)
    return lambda t: len(enc.packed(t)) // 4


def _build(path, leaf):
    def run(batches):
        count = _counter(path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                leaves = [Tree(t or "", count, leaf).leaf_tokens() for t in part.column("text").to_pylist()]
                out = [pa.array([sum(x) for x in leaves], pa.int64()), pa.array(leaves, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *out], [*part.schema.names, "n_tokens", "leaf_tokens"])

    return run


def build(docs: DataFrame, *keep: str, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """The kept columns with text, n_tokens and the tree's leaf counts."""
    ship(docs.sparkSession)
    names = [*(c for c in keep if c != "text"), "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names).mapInArrow(_build(path or tokenizer_path(), leaf), schema + ", n_tokens long, leaf_tokens array<bigint>")


def _apply(path, leaf):
    def run(batches):
        count = _counter(path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts, totals, work, leaves = [], [], [], []
                for t, own, edits in zip(*(part.column(c).to_pylist() for c in ("text", "leaf_tokens", "edits")), strict=True):
                    tree = Tree(t or "", count, leaf, own)
                    for e in edits or ():
                        if e is not None:
                            tree.edit(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                    texts.append(tree.text())
                    totals.append(tree.tokens)
                    work.append(tree.encoded)
                    leaves.append(tree.leaf_tokens())
                keep = [c for c in part.schema.names if c not in ("text", "leaf_tokens", "edits")]
                out = [pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(work, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *out], [*keep, "text", "n_tokens_edited", "chars_encoded"])

    return run


def recount(trees: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Apply each row's `edits`, in order, to its text and tree.

    Gives the kept columns, the edited text, n_tokens_edited and chars_encoded (what was encoded anew).
    """
    ship(trees.sparkSession)
    names = [c for c in trees.columns if c not in ("text", "leaf_tokens", "edits")]
    schema = ", ".join(f"`{c}` {trees.schema[c].dataType.simpleString()}" for c in names)
    return trees.mapInArrow(_apply(path or tokenizer_path(), leaf), schema + ", text string, n_tokens_edited long, chars_encoded long")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Join an edit log (doc_id, seq, at, remove, insert) onto trees; one document's edits make one row."""
    log = edits.filter("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "remove", "insert"))).alias("log"))
    log = log.select("doc_id", F.transform("log", lambda e: F.struct(e["at"].cast("long").alias("at"), e["remove"].cast("long").alias("remove"), e["insert"].alias("insert"))).alias("edits"))
    return trees.join(log, "doc_id", "left")


def stock_edits() -> F.Column:
    """The query's fixed edits, from the text's length n: an insertion at n/3, a deletion of 24
    characters at n/2, a replacement of 7 characters at 2n/3, an insertion inside a word at 0."""
    n = F.char_length(F.coalesce("text", F.lit("")))

    def one(at, remove, insert):
        return F.struct(at.cast("long").alias("at"), F.lit(remove).cast("long").alias("remove"), F.lit(insert).alias("insert"))

    return F.array(one(F.floor(n / 3), 0, " revised wording, 2nd draft "), one(F.floor(n / 2), 24, ""), one(F.floor(n * 2 / 3), 7, "it's"), one(F.lit(0), 0, "Re")).cast(EDITS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: token counts of every document before and after the stock edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", stock_edits())
    done = recount(build(docs, "doc_id", "edits"))
    return done.select("doc_id", "n_tokens", "n_tokens_edited", "chars_encoded", F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"))
