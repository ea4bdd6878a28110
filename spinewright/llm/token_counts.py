"""Token counts that follow edits: a segment tree of pre-token counts for each document.

A text is cut into pre-tokens, which byte-pair merges never cross; up to ``LEAF`` of them form a leaf with its
length and token count, and a tree of sums stands on the leaves. An edit descends to its leaf, pre-tokenises again
from the start of the last leaf before it that holds text (the boundary context) until a new boundary meets an old leaf's end behind
the edit, and updates the sums above the leaves it touched. From a common boundary on both texts are cut alike,
as the pattern only looks ahead, so the count equals that of the edited text encoded anew. A region that has outgrown
its leaves is split into more of them, one that has emptied gives leaves up; the other leaves keep their counts and
only the sums above are laid out again. Nothing outside the region is ever encoded again, whatever an edit's size.

Trees are ordinary rows (``leaf_chars``, ``leaf_tokens``), to be stored with the documents. Edits apply in their
order, each to the text the last one left; offsets beyond the text are clipped, a null replacement is a deletion, edits
at one place apply one after the other. Null texts and empty ones have no leaves and zero tokens; an empty table gives
no rows. Very long texts have more leaves, none is cut short. Repeated rows get a row each; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where executors find the vocabulary, unless the caller names another path or has shipped the file with ``addFile``.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-token pattern the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 64
_CACHE = 400_000
_CUT = regex.compile(PATTERN)


class Counter:
    """Tokens of a pre-token, remembered for the common ones."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, int] = {}

    def __call__(self, pre_token: str) -> int:
        n = self._known.get(pre_token)
        if n is None:
            if len(self._known) >= _CACHE:
                self._known.clear()
            n = len(self._encode(pre_token))
            if len(pre_token) < 40:
                self._known[pre_token] = n
        return n


@lru_cache(maxsize=4)
def counter(vocabulary: str) -> Counter:
    """The counter of a vocabulary: a path on the executor, or the name of a file shipped with ``SparkContext.addFile``."""
    return Counter(vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary)))


class Tree:
    """The leaves' lengths and counts with their sums; ``reencoded`` counts the pre-tokens that edits encoded again."""

    def __init__(self, leaf_chars: list[int], leaf_tokens: list[int], count: Counter):
        self.count, self.reencoded = count, 0
        self._build(leaf_chars, leaf_tokens)

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.leaves = max(1, len(chars))
        self.size = 1 << (self.leaves - 1).bit_length()
        pad = [0] * (self.size - len(chars))
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @classmethod
    def of(cls, text: str, count: Counter) -> Tree:
        return cls(*leaves(text, count), count)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf_lists(self) -> tuple[list[int], list[int]]:
        return self.chars[self.size : self.size + self.leaves], self.tokens[self.size : self.size + self.leaves]

    def _leaf_at(self, offset: int) -> tuple[int, int]:
        """(leaf, its start) that holds ``offset``; the last leaf for the text's end."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if offset >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def edit(self, text: str, start: int, stop: int, new: str) -> str:
        """Replace ``text[start:stop]``; returns the edited text and brings the sums up to date."""
        start = min(max(start, 0), len(text))
        stop = min(max(stop, start), len(text))
        edited, shift = text[:start] + new + text[stop:], len(new) - (stop - start)
        first, at = self._leaf_at(start)
        context = at
        while first and at == context:  # boundary context, which an emptied leaf doesn't hold
            first -= 1
            at -= self.chars[self.size + first]
        last, end = first, at
        while last < self.leaves:  # old ends behind the edit, found as the cutting goes on
            end += self.chars[self.size + last]
            if end >= stop:
                break
            last += 1
        last = min(last, self.leaves - 1)
        target = end + shift
        pre: list[str] = []
        place = at
        for m in _CUT.finditer(edited, at):
            place = m.end()
            pre.append(m[0])
            while place > target and last < self.leaves - 1:
                last += 1
                target += self.chars[self.size + last]
            if place == target and target - shift >= stop:
                break
        self.reencoded += len(pre)
        slots = last - first + 1
        if len(pre) > 2 * LEAF * slots or 4 * len(pre) < LEAF * (slots - 1):
            # leaves are split or given up; the others' counts stay, only the sums are laid out anew
            chars, tokens = self.leaf_lists()
            parts = [pre[i : i + LEAF] for i in range(0, len(pre), LEAF)]
            self._build(chars[:first] + [sum(map(len, p)) for p in parts] + chars[last + 1 :], tokens[:first] + [sum(map(self.count, p)) for p in parts] + tokens[last + 1 :])
            return edited
        step = max(1, -(-len(pre) // slots))
        for k in range(slots):
            part, i = pre[k * step : (k + 1) * step], self.size + first + k
            self.chars[i], self.tokens[i] = sum(map(len, part)), sum(map(self.count, part))
        level = {(self.size + first + k) >> 1 for k in range(slots)} - {0}
        while level:
            for i in level:
                self._sum(i)
            level = {i >> 1 for i in level} - {0}
        return edited


def leaves(text: str, count: Counter) -> tuple[list[int], list[int]]:
    pre = _CUT.findall(text)
    tokens = list(map(count, pre))
    sizes = list(map(len, pre))
    return [sum(sizes[i : i + LEAF]) for i in range(0, len(pre), LEAF)], [sum(tokens[i : i + LEAF]) for i in range(0, len(pre), LEAF)]


def trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, leaf_chars, leaf_tokens``: the trees' leaves, to be stored and joined with edits later."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [leaves(t.as_py() or "", counter(vocabulary)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sum(t) for _, t in both], pa.int64()), pa.array([c for c, _ in both], pa.list_(pa.int32())), pa.array([t for _, t in both], pa.list_(pa.int32()))], ["doc_id", "n_tokens", "leaf_chars", "leaf_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(built, "doc_id long, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>")


EDITED = "doc_id long, n_tokens long, n_tokens_edited long, n_reencoded long"


def apply_edits(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, n_tokens_edited, n_reencoded`` of ``doc_id, text, edits``, edits being an array of
    ``start, stop, new``; with columns ``leaf_chars`` and ``leaf_tokens`` a stored tree is taken up instead of built."""
    stored = {"leaf_chars", "leaf_tokens"} <= set(docs.columns)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, out = counter(vocabulary), []
            kept = zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True) if stored else ((None, None) for _ in range(b.num_rows))
            for t, edits, (chars, tokens) in zip(b.column(1), b.column(2).to_pylist(), kept, strict=True):
                text = t.as_py() or ""
                tree = Tree(chars, tokens, count) if chars is not None else Tree.of(text, count)
                before = tree.total
                for e in edits or []:
                    text = tree.edit(text, e["start"] or 0, e["stop"] or 0, e["new"] or "")
                out.append((before, tree.total, tree.reencoded))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], pa.int64()) for i in range(3))], ["doc_id", "n_tokens", "n_tokens_edited", "n_reencoded"])

    cols = [F.col("doc_id").cast("long"), F.col("text").cast("string"), "edits"] + ["leaf_chars", "leaf_tokens"] * stored
    return docs.select(*cols).mapInArrow(applied, EDITED)


def sample_edits(docs: DataFrame, edits: int = 6) -> DataFrame:
    """``docs`` with an edit log at places that follow from the id: replacements of up to 11 characters, every third edit a
    deletion of up to 2,047, and every fifth an insertion of 400 words."""
    h = lambda k: F.xxhash64(F.lit(f"edit-{k}"), F.col("doc_id"))
    n = F.length(F.coalesce(F.col("text"), F.lit(""))) + 1

    def edit(k: int):  # noqa: ANN202
        start = F.pmod(h(k), n).cast("int")
        stop = F.pmod(F.shiftright(h(k), 20), F.lit(2048 if k % 3 == 2 else 12)).cast("int")
        if k % 5 == 4:
            return F.struct(start.alias("start"), start.alias("stop"), F.lit(" inserted words" * 200).alias("new"))
        new = F.lit("") if k % 3 == 2 else F.element_at(F.array(*map(F.lit, ("", " and", "ß", "<redacted>", " 42", "\n"))), (F.pmod(F.shiftright(h(k), 40), F.lit(6)) + 1).cast("int"))
        return F.struct(start.alias("start"), (start + stop).alias("stop"), new.alias("new"))

    return docs.withColumn("edits", F.array(*[edit(k) for k in range(edits)]))
