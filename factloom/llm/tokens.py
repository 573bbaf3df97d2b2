"""Edit-aware token counts: a tree of pre-token segments for each document.

A text is cut into pre-tokens, each encoded on its own, so the tokens of a text are the sum over its segments. The
tree keeps segments in leaves of bounded size with their characters and tokens, and the sums of both over subtrees. An edit
goes down by characters to the first segment that it or the pattern's look-ahead can reach, cuts the text anew from
there until a new boundary meets an old one beyond the edit, encodes only what lies between, and adds the differences on
the way up. The text itself is held in the leaves only, so the cost of an edit does not depend on the length of the text. The
vocabulary is a file of ranks whose path, on the driver, is a parameter; it is sent to the workers with the job.

Edits are code-point ranges of the text before any of them, applied in order; one that overlaps an earlier one, or lies
outside the text, is an error. Null and empty texts have no segments and 0 tokens. Each of repeated rows is counted; an empty table gives an
empty result; columns other than key and text are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens of byte-level BPE; a fixed value of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that a pre-token may look at beyond its end, segments of a leaf, cached pre-tokens of a worker.
AHEAD, LEAF, CACHED = 3, 64, 1 << 19


class Encoder:
    """Token counts of pre-tokens, cached."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.full = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.encoded = 0

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.full._core_bpe.encode_single_piece(piece.encode()))
            if len(piece) <= 64:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[piece] = n
        return n


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> Encoder:
    return Encoder(path)


class Node:
    """A leaf with segments and their tokens, or a pair of nodes; sums of characters and tokens of all below."""

    __slots__ = ("chars", "counts", "left", "pieces", "right", "tokens", "up")

    def __init__(self, pieces: list[str] | None, counts: list[int] | None, left: Node | None = None, right: Node | None = None):
        self.pieces, self.counts, self.left, self.right, self.up = pieces, counts, left, right, None
        if left is not None:
            left.up = right.up = self
            self.chars, self.tokens = left.chars + right.chars, left.tokens + right.tokens
        else:
            self.chars, self.tokens = sum(map(len, pieces)), sum(counts)


def balanced(nodes: list[Node]) -> Node:
    """A node above all of ``nodes``, in order."""
    while len(nodes) > 1:
        nodes = [Node(None, None, *nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]


class Tree:
    """Segments of one text in leaves, and sums of characters and tokens over a binary tree of the leaves. The text is
    only in the leaves: an edit reads and writes what it reaches, whatever the length of the text."""

    def __init__(self, text: str, enc: Encoder):
        self.enc, self.encoded = enc, 0
        pieces = enc.cut.findall(text)
        self.root = balanced(self._leaves(pieces, self._encode(pieces)))

    def _encode(self, pieces: list[str]) -> list[int]:
        self.encoded += len(pieces)
        return list(map(self.enc.count, pieces))

    @staticmethod
    def _leaves(pieces: list[str], counts: list[int]) -> list[Node]:
        return [Node(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, max(1, len(pieces)), LEAF)]

    @property
    def total(self) -> int:
        return self.root.tokens

    @property
    def length(self) -> int:
        return self.root.chars

    @property
    def text(self) -> str:
        return "".join(p for leaf in self._all() for p in leaf.pieces)

    def _at(self, place: int) -> tuple[Node, int]:
        """(leaf, its first character) that holds the character ``place``; the last one with characters if there is none."""
        node, start = self.root, 0
        while node.left is not None:
            if place < start + node.left.chars or not node.right.chars:
                node = node.left
            else:
                start += node.left.chars
                node = node.right
        return node, start

    @staticmethod
    def _next(node: Node) -> Node | None:
        """The leaf after ``node``."""
        while node.up is not None and node.up.right is node:
            node = node.up
        if node.up is None:
            return None
        node = node.up.right
        while node.left is not None:
            node = node.left
        return node

    def _all(self) -> list[Node]:
        node, out = self.root, []
        while node.left is not None:
            node = node.left
        while node is not None:
            out.append(node)
            node = self._next(node)
        return out

    def _put(self, leaf: Node, pieces: list[str], counts: list[int]) -> None:
        """New segments for a leaf; one that gets too many becomes a pair of nodes in its place."""
        chars, tokens = sum(map(len, pieces)) - leaf.chars, sum(counts) - leaf.tokens
        leaf.pieces, leaf.counts = pieces, counts
        node, depth = leaf, 0
        while node is not None:
            node.chars += chars
            node.tokens += tokens
            node, depth = node.up, depth + 1
        if len(pieces) > 8 * LEAF:
            below = balanced(self._leaves(pieces, counts))
            leaf.pieces = leaf.counts = None
            leaf.left, leaf.right = below.left, below.right
            leaf.left.up = leaf.right.up = leaf
            if depth > 64:  # many splits in one place: the same leaves in a balanced tree
                self.root = balanced(self._all())
                self.root.up = None

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to ``end``."""
        first, at = self._at(max(0, start - AHEAD - 1))
        k = 0
        while k < len(first.pieces) and at + len(first.pieces[k]) + AHEAD <= start:
            at += len(first.pieces[k])
            k += 1
        # old segments from there on, as many as it takes until a new boundary beyond the edit meets an old one
        leaf, place, upto, more = first, k, at, 64
        old, ends = [], {}  # segments, and where each ends: the leaf and the place after it
        shift, past = len(new) - (end - start), start - at + len(new)
        while True:
            while leaf is not None and upto < end + more:
                if place < len(leaf.pieces):
                    old.append(leaf.pieces[place])
                    upto, place = upto + len(old[-1]), place + 1
                    ends[upto] = leaf, place
                else:
                    leaf, place = self._next(leaf), 0
            local = "".join(old)
            local = local[: start - at] + new + local[end - at :]
            fresh, last = [], None
            for m in self.enc.cut.finditer(local):
                if leaf is not None and m.end() + AHEAD > len(local):
                    break  # what follows may reach into it
                fresh.append(m.group())
                if m.end() >= past and m.end() + at - shift >= end and m.end() + at - shift in ends:
                    last = ends[m.end() + at - shift]
                    break
            if last is not None or leaf is None:
                break
            more *= 2
        counts = self._encode(fresh)
        kept = first.pieces[:k], first.counts[:k]
        if last is None:  # to the end of the text
            last = ends[upto] if old else (first, len(first.pieces))
        leaf, place = last
        rest = leaf.pieces[place:], leaf.counts[place:]
        if leaf is first:
            self._put(first, kept[0] + fresh + rest[0], kept[1] + counts + rest[1])
            return
        node = self._next(first)
        while node is not leaf:
            after = self._next(node)
            self._put(node, [], [])
            node = after
        self._put(leaf, *rest)
        self._put(first, kept[0] + fresh, kept[1] + counts)


_CLEAN = re.compile(r"\d{6,}|[^\S\n]{2,}|[\w.+-]+@[\w-]+\.[\w.-]+")


def cleaning(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask e-mail addresses and long numbers and close gaps within lines."""
    return [(m.start(), m.end(), "<mail>" if "@" in m.group() else "<number>" if m.group().strip() else " ") for m in _CLEAN.finditer(text)]


def apply(tree: Tree, edits: list[tuple[int, int, str]]) -> None:
    """Apply edits whose ranges are those of the text before all of them, ascending."""
    shift, upto = 0, 0
    for start, end, new in edits:
        if start < upto or end < start or end + shift > tree.length:
            raise ValueError("edits overlap or leave the text")
        tree.edit(start + shift, end + shift, new)
        shift += len(new) - (end - start)
        upto = end


def recount(docs: DataFrame, edits=cleaning, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_segments, n_tokens, n_edits, n_reencoded, n_tokens_after) of every row; ``edits`` gives a text's edits."""
    names = ["doc_id", "n_segments", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after"]

    docs.sparkSession.sparkContext.addFile(vocabulary)  # every worker gets it with the job

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(os.path.basename(vocabulary)))
        for batch in batches:
            out = []
            for t in batch.column(1):
                text = t.as_py() or ""
                tree = Tree(text, enc)
                n, before = tree.encoded, tree.total
                changes = edits(text)
                apply(tree, changes)
                out.append((n, before, len(changes), tree.encoded - n, tree.total))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: tokens of every document before and after cleaning, re-encoding only what the edits reach."""
    return recount(spark.read.parquet(f"{sf_dir}/documents.parquet"))
