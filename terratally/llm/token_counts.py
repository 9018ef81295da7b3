"""Edit-aware token counts: a segment tree of pre-tokens per document.

A leaf holds a run of LEAF pre-tokens, as its number of characters and of tokens; every inner node holds the sums of
its two children, so the root has the document's count and a character position is found in logarithmic time. An edit
(start, end, replacement) changes the text of the leaves that it touches. Afterwards only the changed leaves are split
and encoded again, with the context that decides about their borders: to the left back to a border that a non-space
character and one more keep from the change, to the right on to the first old border that is a border again. The new
numbers go into the leaves, and the sums above them are updated. All other leaves keep their counts.

The edits of a document are applied in order, each to the text that the one before left. Positions are characters;
they are clipped to the text, and an end before the start counts as the start. Defined results: null or empty text: no
leaves, 0 tokens; null replacement: deletion; no or null edits: nothing is encoded again; an edit with a null start or
end is ignored.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from terratally.llm.bpe import BlockIds, Vocabulary, vocabulary_on_executors
from terratally.llm.common import blocks, documents, text_bytes

LEAF = 32
#: A leaf that would get more pre-tokens than this makes the tree grow instead.
FULL = 4 * LEAF


class Tree:
    """Sums of characters and tokens in heap order: node k has the children 2k and 2k + 1, leaves start at ``half``."""

    def __init__(self, chars, tokens):
        self.half = 1 << max(0, (max(len(chars), 1) - 1).bit_length())
        self.used = len(chars)
        self.sums = np.zeros((2, 2 * self.half), np.int64)
        self.sums[0, self.half:self.half + self.used] = chars
        self.sums[1, self.half:self.half + self.used] = tokens
        level = self.half
        while level > 1:
            self.sums[:, level // 2:level] = self.sums[:, level:2 * level].reshape(2, -1, 2).sum(axis=2)
            level //= 2

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = self.half + leaf
        dc, dt = chars - self.sums[0, k], tokens - self.sums[1, k]
        while k:
            self.sums[0, k] += dc
            self.sums[1, k] += dt
            k //= 2

    def find(self, position: int) -> tuple[int, int]:
        """Leaf that holds a character position, and the position in it; the end of the text is in the last leaf."""
        k = 1
        while k < self.half:
            left = self.sums[0, 2 * k]
            k *= 2
            if position >= left and self.sums[0, k + 1]:
                position -= left
                k += 1
        return k - self.half, int(position)

    @property
    def chars(self):
        return self.sums[0, self.half:self.half + self.used]

    @property
    def tokens(self):
        return self.sums[1, self.half:self.half + self.used]


def leaves_of(word_chars: np.ndarray, word_counts: np.ndarray, size: int = LEAF):
    if not len(word_chars):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(0, len(word_chars), size)
    return np.add.reduceat(word_chars, at), np.add.reduceat(word_counts, at)


def encoded(v: Vocabulary, texts: list[str]) -> BlockIds:
    return BlockIds(v, *text_bytes(pa.array(texts, pa.string())))


def settled(text: str) -> bool:
    """Whether a border before ``text`` stands whatever follows: a non-space character and one more."""
    return len(text.lstrip()) >= 2


class Edited:
    """A document with its tree while its edits are applied."""

    def __init__(self, text: str, tree: Tree, edits):
        self.tree, at = tree, np.append(0, np.cumsum(tree.chars))
        self.leaves = [text[a:b] for a, b in zip(at[:-1], at[1:])] or [""]
        self.dirty: set[int] = set()
        self.applied = 0
        for e in edits or []:
            if e is not None and e["start"] is not None and e["end"] is not None:
                self.apply(e["start"], e["end"], e["replacement"] or "")

    def apply(self, start: int, end: int, new: str) -> None:
        total = int(self.tree.sums[0, 1])
        start = min(max(start, 0), total)
        end = min(max(end, start), total)
        (a, i), (b, j) = self.tree.find(start), self.tree.find(end)
        joined = self.leaves[a][:i] + new + self.leaves[b][j:]
        for k in range(a, b + 1):
            self.leaves[k] = joined if k == a else ""
            self.tree.put(k, len(self.leaves[k]), 0)
            self.dirty.add(k)
        self.applied += 1

    def regions(self) -> list[list[int]]:
        """Ranges of leaves (first, last) to encode again: runs of changed leaves with context on the left."""
        out: list[list[int]] = []
        for k in sorted(self.dirty):
            first, before = k, ""
            while first > 0 and (first == k or not settled(before)):
                first -= 1
                before = self.leaves[first] + before
            if out and first <= out[-1][1] + 1:
                out[-1][1] = k
            else:
                out.append([first, k])
        return out

    def sample(self, region: list[int]) -> str:
        """The region's text and what follows, as far as it can bear on the borders."""
        text, k, after = "".join(self.leaves[region[0]:region[1] + 1]), region[1] + 1, ""
        while k < len(self.leaves) and not settled(after):
            after += self.leaves[k]
            k += 1
        return text + after


def refresh(v: Vocabulary, docs: list[Edited]) -> None:
    """Encode the changed regions of all documents together, and put the results into the trees."""
    open_ = [(d, r) for d in docs for r in d.regions()]
    done: list[tuple[Edited, list[int], np.ndarray, np.ndarray]] = []
    for d in docs:
        d.encoded_chars = 0
    while open_:
        b = encoded(v, [d.sample(r) for d, r in open_])
        again = []
        for n, (d, r) in enumerate(open_):
            s, e = b.word_offsets[n], b.word_offsets[n + 1]
            ends = np.cumsum(b.word_chars[s:e])
            size = sum(len(x) for x in d.leaves[r[0]:r[1] + 1])
            words = int(np.searchsorted(ends, size, side="right"))
            d.encoded_chars += size
            if r[1] + 1 < len(d.leaves) and size and (not words or ends[words - 1] != size):
                again.append((d, [r[0], r[1] + 1]))  # the old border is none any more
            else:
                done.append((d, r, b.word_chars[s:s + words], b.word_counts[s:s + words]))
        open_ = again
    grown: dict[int, tuple[Edited, list]] = {}
    for d, r, chars, counts in sorted(done, key=lambda x: x[1][0]):
        slots = r[1] - r[0] + 1
        if len(chars) <= slots * FULL:
            part = leaves_of(chars, counts, max(1, -(-len(chars) // slots)))
            for k in range(slots):
                inside = k < len(part[0])
                d.tree.put(r[0] + k, int(part[0][k]) if inside else 0, int(part[1][k]) if inside else 0)
        else:
            grown.setdefault(id(d), (d, []))[1].append((r, leaves_of(chars, counts)))
    for d, parts in grown.values():
        chars, tokens, at = [], [], 0
        for r, (c, t) in parts:
            chars += [d.tree.chars[at:r[0]], c]
            tokens += [d.tree.tokens[at:r[0]], t]
            at = r[1] + 1
        d.text = "".join(d.leaves)
        d.tree = Tree(np.concatenate([*chars, d.tree.chars[at:]]), np.concatenate([*tokens, d.tree.tokens[at:]]))


EDITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("replacement", T.StringType())]))
EDIT_LISTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("replacement", pa.string())]))
NUMBERS = T.ArrayType(T.LongType())


def block_leaves(v: Vocabulary, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Characters and tokens of the leaves of each text of a block."""
    b = BlockIds(v, *text_bytes(texts))
    pairs = [leaves_of(b.word_chars[s:e], b.word_counts[s:e]) for s, e in zip(b.word_offsets[:-1], b.word_offsets[1:])]
    return [c for c, _ in pairs], [t for _, t in pairs]


def edited_block(v: Vocabulary, block: pa.RecordBatch, chars: list, tokens: list, before: pa.Array) -> pa.RecordBatch:
    """The rows of ``apply_edits`` for a block of documents with their leaves and ``edits``."""
    docs = [Edited(t, Tree(c, k), e) for t, c, k, e in zip(block.column("text").to_pylist(), chars, tokens, block.column("edits").to_pylist())]
    refresh(v, docs)
    lists = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [block.column("doc_id"), pa.array(["".join(d.leaves) for d in docs], pa.string()), pa.array([d.tree.chars for d in docs], lists), pa.array([d.tree.tokens for d in docs], lists),
         before, pa.array([int(d.tree.sums[1, 1]) for d in docs], pa.int64()), pa.array([d.applied for d in docs], pa.int64()), pa.array([d.encoded_chars for d in docs], pa.int64())],
        ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_before", "n_tokens", "n_edits", "n_chars_encoded"])


def edited_schema(source: DataFrame) -> T.StructType:
    numbers = [T.StructField(c, T.LongType()) for c in ("n_before", "n_tokens", "n_edits", "n_chars_encoded")]
    return T.StructType([source.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("leaf_chars", NUMBERS), T.StructField("leaf_tokens", NUMBERS), *numbers])


def build_trees(docs: DataFrame, v: Vocabulary, *columns: str) -> DataFrame:
    """doc_id, text, leaf_chars, leaf_tokens and n_tokens of every document, with the named columns."""
    shared = vocabulary_on_executors(docs, v)

    def run(batches):
        for block in blocks(batches):
            chars, tokens = block_leaves(shared.value, block.column("text"))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("text"), pa.array(chars, lists), pa.array(tokens, lists), pa.array([int(t.sum()) for t in tokens], pa.int64()),
                                              *(block.column(c) for c in columns)], ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", *columns])

    source = documents(docs, *columns)
    fields = [source.schema["doc_id"], source.schema["text"], T.StructField("leaf_chars", NUMBERS), T.StructField("leaf_tokens", NUMBERS), T.StructField("n_tokens", T.LongType())]
    return source.mapInArrow(run, T.StructType(fields + [source.schema[c] for c in columns]))


def apply_edits(trees: DataFrame, v: Vocabulary) -> DataFrame:
    """``trees`` with a column ``edits``: the text and the tree after the edits, n_before, n_tokens, n_edits and the
    number of characters that were encoded again."""
    shared = vocabulary_on_executors(trees, v)

    def run(batches):
        for block in blocks(batches):
            chars, tokens = ([np.asarray(x, np.int64) for x in block.column(c).to_pylist()] for c in ("leaf_chars", "leaf_tokens"))
            yield edited_block(shared.value, block, chars, tokens, block.column("n_tokens"))

    source = trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "edits")
    return source.mapInArrow(run, edited_schema(source))


def build_and_edit(docs: DataFrame, v: Vocabulary, edits: Callable[[str], list[dict]]) -> DataFrame:
    """``apply_edits`` on fresh trees, with ``edits`` naming those of a text.

    All of it is one Python step: a task has one worker with one vocabulary, and neither trees nor edits travel.
    """
    shared = vocabulary_on_executors(docs, v)

    def run(batches):
        for block in blocks(batches):
            chars, tokens = block_leaves(shared.value, block.column("text"))
            found = pa.array([edits(t) for t in block.column("text").to_pylist()], EDIT_LISTS)
            yield edited_block(shared.value, block.append_column("edits", found), chars, tokens, pa.array([int(t.sum()) for t in tokens], pa.int64()))

    source = documents(docs)
    return source.mapInArrow(run, edited_schema(source))
