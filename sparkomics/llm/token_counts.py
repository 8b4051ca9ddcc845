"""Edit-aware token counts: a segment tree of pre-token runs for each document, in which edits re-encode only what they
touch.

A document's text is cut into leaves of LEAF characters or more. Cuts lie between a character that is no white space and
a space or line end, or behind a letter or digit where something else follows; no pre-token of the byte-level vocabulary
spans such a place, so that the leaves' counts add up to the text's, also in scripts without spaces. A binary tree holds
the sums of characters and tokens below each node; it is kept, as a row. An edit finds its leaves by descent, and takes in
a neighbour where the edge to it is no such place any more. It encodes that region again and updates the sums on the paths
to the root.

Nulls: a null text is empty and has one empty leaf, null edits are none, a null replacement is empty; a null doc_id stays
null. Edits refer to the text before all edits (code points, exclusive end), are clipped to it, and are applied by
start; one that overlaps an earlier one begins where that ends. Ties in start go by end, then replacement. Repeated rows
give a row each; with `with_edits` each gets all edits of its doc_id. Empty tables give empty results; further columns
are ignored.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 256

#: How the vocabulary's tokenizer splits a text before it merges bytes.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CUT = regex.compile(r"\S(?=[ \n])|[\p{L}\p{N}](?=[^\p{L}\p{N}])")
_ENCODERS: dict = {}

TREE = "doc_id long, text string, leaves int, chars array<int>, tokens array<int>"
EDITS = "array<struct<start:long,end:long,replacement:string>>"


def encoder(path: str):
    """The tiktoken encoding of a file of ranks, once for a process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _word(ch: str) -> bool:
    return unicodedata.category(ch)[0] in "LN"


def may_cut(left: str, right: str) -> bool:
    """Whether no pre-token spans two characters, whatever stands around them."""
    return (right in " \n" and not left.isspace()) or (_word(left) and not _word(right))


def leaves_of(text: str, size: int = LEAF) -> list[str]:
    out, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + size - 1) if at + size < len(text) else None
        end = cut.end() if cut else len(text)
        out.append(text[at:end])
        at = end
    return out or [""]


def sums(leaves: list[int]) -> list[int]:
    """The sums of a binary tree over the leaves."""
    width = 1 << (len(leaves) - 1).bit_length()
    out = [0] * width + leaves + [0] * (width - len(leaves))
    for i in range(width - 1, 0, -1):
        out[i] = out[2 * i] + out[2 * i + 1]
    return out


class TokenTree:
    """Leaves of a text in order, with the sums of their characters and tokens in a binary tree."""

    def __init__(self, leaves: list[str], chars: list[int], tokens: list[int], encode) -> None:
        """`chars` and `tokens` are the sums of all nodes, as `sums` makes them: the root's at 1, node i's children's at 2 i
        and 2 i + 1."""
        self.leaves, self.encode, self.encoded = leaves, encode, 0
        self.width, self.chars, self.tokens = len(chars) // 2, chars, tokens

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """(leaf that holds the character at this place, its start); the end of the text is in the last leaf."""
        if at >= self.chars[1]:
            last = len(self.leaves) - 1
            return last, self.chars[1] - len(self.leaves[last])
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def _put(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        i = leaf + self.width
        self.chars[i] = len(text)
        self.tokens[i] = len(self.encode(text)) if text else 0
        self.encoded += len(text)
        i //= 2
        while i:
            self._sum(i)
            i //= 2

    def _before(self, leaf: int) -> int:
        while leaf >= 0 and not self.leaves[leaf]:
            leaf -= 1
        return leaf

    def _after(self, leaf: int) -> int:
        while leaf < len(self.leaves) and not self.leaves[leaf]:
            leaf += 1
        return leaf

    def edit(self, start: int, end: int, replacement: str) -> None:
        first, at = self.find(start)
        last, last_at = self.find(max(start, end - 1))
        old = "".join(self.leaves[first : last + 1])
        text = old[: start - at] + replacement + old[end - at :]
        while (left := self._before(first - 1)) >= 0 and not (text and may_cut(self.leaves[left][-1], text[0])):
            first, text = left, self.leaves[left] + text
        while (right := self._after(last + 1)) < len(self.leaves) and not (text and may_cut(text[-1], self.leaves[right][0])):
            last, text = right, text + self.leaves[right]
        parts, room = leaves_of(text), last - first + 1
        if len(parts) > room:  # the tree keeps its shape; its last leaf takes what is left
            parts = [*parts[: room - 1], "".join(parts[room - 1 :])]
        for k in range(room):
            self._put(first + k, parts[k] if k < len(parts) else "")


def build(docs: DataFrame, ranks_path: str, leaf: int = LEAF) -> DataFrame:
    """The tree of every document as a row: doc_id, text, the number of leaves, and all nodes' characters and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path).encode_ordinary
        for batch in batches:
            n, chars, tokens = [], [], []
            for text in batch.column(1):
                leaves = leaves_of(text.as_py() or "", leaf)
                n.append(len(leaves))
                chars.append(sums(list(map(len, leaves))))
                tokens.append(sums([len(encode(x)) for x in leaves]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32()), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "text", "leaves", "chars", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TREE)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """The trees with the edits (doc_id, start, end, replacement) of their doc_id."""
    listed = edits.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("long"), F.col("end").cast("long"), "replacement")).alias("edits"))
    return trees.join(listed, "doc_id", "left")


def recount(trees: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_chars_after, encoded_chars (encoded for the edits) of trees with `edits`."""
    names = ["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "encoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path).encode_ordinary
        for batch in batches:
            out = []
            for doc_id, text, n_leaves, chars, tokens, edits in zip(*batch.columns):
                text, at, leaves, nodes = text.as_py() or "", 0, [], chars.as_py()
                for n in nodes[len(nodes) // 2 :][: n_leaves.as_py()]:
                    leaves.append(text[at : at + n])
                    at += n
                tree = TokenTree(leaves, nodes, tokens.as_py(), encode)
                before, done = tree.tokens[1], []
                key = lambda e: (e["start"], e["end"], e["replacement"] or "")
                for e in sorted((e for e in edits.as_py() or () if e and e["start"] is not None and e["end"] is not None), key=key):
                    start = min(max(e["start"], 0, done[-1][1] if done else 0), len(text))
                    done.append((start, min(max(e["end"], start), len(text)), e["replacement"] or ""))
                for edit in reversed(done):  # places before an edit stay as they are
                    tree.edit(*edit)
                out.append((doc_id.as_py(), before, tree.tokens[1], tree.chars[1], tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names)

    rows = trees.select("doc_id", "text", "leaves", "chars", "tokens", F.col("edits").cast(EDITS).alias("edits"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def revision(trees: DataFrame) -> DataFrame:
    """The trees with the edits of a routine revision: a notice put in front, a word's length in the middle replaced, the
    last ten characters cut."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    edit = lambda start, end, text: F.struct(start.alias("start"), end.alias("end"), F.lit(text).alias("replacement"))
    middle, zero = F.floor(n / 2), F.lit(0).cast("long")
    return trees.withColumn("edits", F.array(edit(zero, zero, "Revised. "), edit(middle, middle + 5, "as amended"), edit(F.greatest(n - 10, middle + 5), n, "")))
