"""Edit-aware token counts: a tree of pre-token blocks per document, re-encoded only where edited.

The leaves hold blocks of ``BLOCK`` pre-tokens; every node sums the characters and the tokens below
it, so a position is found and a total updated in steps that grow with the tree's depth. The
pre-token pattern reads from left to right and looks at most ``LOOK`` characters ahead, or a special
token's length, so an edit can change pre-tokens only from just before it, up to where a new
boundary falls on an old one behind it. Only these are encoded again; blocks after them keep their
sums. An edit may make or break a special token, which is one token as in ``bpe``.

Defined results: a null text counts as empty; null edits are none; positions are code points and
are cut to the text, a stop before its start means an insertion, a null replacement is empty;
edits apply one after the other to the text as it then is; repeated rows are counted one by one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparktoire.llm.bpe import Bpe, content_of, tokenizer

BLOCK = 32
#: An apostrophe and two letters make a contraction.
LOOK = 3
SCHEMA = "doc_id long, n_chars long, n_tokens long, n_edits long, n_chars_edited long, n_tokens_edited long, n_reencoded long"


class Node:
    """A leaf with its pre-tokens, or an inner node with two children; sums of all below."""

    __slots__ = ("chars", "height", "left", "pieces", "right", "tokens")

    def __init__(self, pieces: list[str] | None, tokens: int, left: Node | None = None, right: Node | None = None):
        self.pieces, self.left, self.right = pieces, left, right
        if pieces is not None:
            self.chars, self.tokens, self.height = sum(map(len, pieces)), tokens, 0
        else:
            self.chars, self.tokens, self.height = left.chars + right.chars, left.tokens + right.tokens, 1 + max(left.height, right.height)


def built(leaves: list[Node]) -> Node | None:
    """A balanced tree over the leaves."""
    while len(leaves) > 1:
        leaves = [Node(None, 0, leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else None


def joined(a: Node | None, b: Node | None) -> Node | None:
    """The tree of both, balanced like an AVL tree."""
    if a is None or b is None:
        return a or b
    if abs(a.height - b.height) <= 1:
        return Node(None, 0, a, b)
    if a.height > b.height:
        left, right = a.left, joined(a.right, b)
        if right.height > left.height + 1:
            if right.left.height > right.right.height:
                return Node(None, 0, Node(None, 0, left, right.left.left), Node(None, 0, right.left.right, right.right))
            return Node(None, 0, Node(None, 0, left, right.left), right.right)
        return Node(None, 0, left, right)
    left, right = joined(a, b.left), b.right
    if left.height > right.height + 1:
        if left.right.height > left.left.height:
            return Node(None, 0, Node(None, 0, left.left, left.right.left), Node(None, 0, left.right.right, right))
        return Node(None, 0, left.left, Node(None, 0, left.right, right))
    return Node(None, 0, left, right)


def parted(node: Node | None, at: int) -> tuple[Node | None, Node | None, Node | None]:
    """``(before, leaf, after)``: the leaf that holds the character ``at``, and what stands around it."""
    if node is None or node.pieces is not None:
        return None, node, None
    if at < node.left.chars:
        before, leaf, after = parted(node.left, at)
        return before, leaf, joined(after, node.right)
    before, leaf, after = parted(node.right, at - node.left.chars)
    return joined(node.left, before), leaf, after


def first_leaf(node: Node) -> tuple[Node, Node | None]:
    """The first leaf and the rest."""
    _, leaf, after = parted(node, 0)
    return leaf, after


class CountedText:
    """A text whose token count follows its edits."""

    def __init__(self, text: str, bpe: Bpe):
        self.bpe, self.reencoded = bpe, 0
        self.look = max([LOOK, *map(len, bpe.special)])
        self.root = built(self._leaves(bpe.split(text)))

    def _leaves(self, pieces: list[str]) -> list[Node]:
        out = []
        for i in range(0, len(pieces), BLOCK):
            part = pieces[i : i + BLOCK]
            out.append(Node(part, ",".join(self.bpe.ids(part)).count(",") + 1))
        return out

    @property
    def chars(self) -> int:
        return self.root.chars if self.root else 0

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    def text(self) -> str:
        def walk(node: Node | None) -> Iterator[str]:
            if node is not None:
                if node.pieces is not None:
                    yield from node.pieces
                else:
                    yield from walk(node.left)
                    yield from walk(node.right)

        return "".join(walk(self.root))

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replace the characters from ``start`` to before ``stop``."""
        start = min(max(start, 0), self.chars)
        stop = min(max(stop, start), self.chars)
        if start == stop and not text:
            return
        # the part before: all pre-tokens that end ``look`` characters in front of the edit, or earlier
        before, leaf, after = parted(self.root, max(0, start - self.look))
        at, kept, changed = (before.chars if before else 0), [], []
        for k, piece in enumerate(leaf.pieces if leaf else []):
            if at + len(piece) > start - self.look:
                changed = leaf.pieces[k:]
                break
            kept.append(piece)
            at += len(piece)
        # the old text from there, as far as the edit goes
        old, ends, begin = list(changed), [], at
        while at + sum(map(len, old)) < stop:
            leaf, after = first_leaf(after)
            old += leaf.pieces
        for piece in old:
            at += len(piece)
            ends.append(at)
        shift = len(text) - (stop - start)
        fresh = "".join(old)
        fresh = fresh[: start - begin] + text + fresh[stop - begin :]
        new: list[str] = []
        while True:
            # a boundary may be trusted if the text that decides it is there
            ahead = self.look if after else 1
            pieces, here, boundaries = self.bpe.split(fresh), begin, {e + shift for e in ends if e >= stop}
            done = 0
            for k, piece in enumerate(pieces):
                here += len(piece)
                if here in boundaries and here - begin + ahead <= len(fresh) and here >= start + len(text):
                    done = k + 1
                    break
            if done or after is None:
                new = pieces[:done] if done else pieces
                rest = [p for p, e in zip(old, ends, strict=True) if e + shift > here] if done else []
                break
            leaf, after = first_leaf(after)
            fresh += "".join(leaf.pieces)
            for piece in leaf.pieces:
                at += len(piece)
                ends.append(at)
            old += leaf.pieces
        self.reencoded += len(new)
        middle = built(self._leaves(kept + new + rest))
        self.root = joined(joined(before, middle), after)


def edited_counts(docs: DataFrame, path: str, edits: str = "edits") -> DataFrame:
    """Counts before and after the edits in the column ``edits``, arrays of ``start, stop, text``.

    ``path``: a tokenizer file, which the driver reads and sends to the workers.
    """
    content = docs.sparkSession.sparkContext.broadcast(content_of(path))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(content.value)
        for batch in batches:
            rows = []
            for text, script in zip(batch.column(1), batch.column(2), strict=True):
                counted = CountedText(text.as_py() or "", bpe)
                row = [counted.chars, counted.tokens, 0]
                for e in script.as_py() or []:
                    if e is not None:
                        counted.edit(e["start"] or 0, e["stop"] if e["stop"] is not None else e["start"] or 0, e["text"] or "")
                        row[2] += 1
                rows.append([*row, counted.chars, counted.tokens, counted.reencoded])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(6))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits).mapInArrow(run, SCHEMA)


def sample_edits(docs: DataFrame) -> DataFrame:
    """Three edits of every text: one in its middle, a heading before it, an end cut off."""
    n = F.char_length(F.coalesce(F.col("text"), F.lit("")))
    middle = F.floor(n / 2).cast("int")

    def edit(start, stop, text):
        return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(text).alias("text"))

    return docs.withColumn("edits", F.array(edit(middle, middle + 12, " revised passage,"), edit(F.lit(0), F.lit(0), "Draft 2:\n"), edit(n - 10, n + 100, ".")))
