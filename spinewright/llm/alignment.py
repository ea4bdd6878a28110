"""Alignment of two tokenizers: a byte-level one (A) and a sentence-piece one (B) over the same texts.

Both encode a space and the text. Token ends are running sums of token bytes; the offsets where both have an end cut the
tokens into groups, and the A and B tokens that end at one offset are linked. A pair of ids counts as often as it is
linked in all texts; a link is best if its pair's count is the highest of its B id's pairs.

Neither tokenizer merges across a single space between two other characters (A's pattern starts a pre-token there, no
piece of B holds a space behind another character), so a batch's texts are cut there, and each distinct chunk is encoded
once. Whole batches of chunks are aligned in numpy: ``cumsum`` gives the ends, ``intersect1d`` the common cuts,
``searchsorted`` the group of each token, and counts of tokens at a cut, repeated, the links. A text's groups are those
of its chunks in order.

Each text's distinct pairs and their numbers are written once, narrow, to the shared folder. Pair counts come from them
by two shuffles, the first on pair and salt, so that a pair that every text holds is summed in ``SALTS`` places; texts
then meet the counts in a join that broadcasts them only while they are counted few. Batches are worked off in runs of
``RUN_BYTES`` of text, so memory grows with the longest text only.

Texts that are null or empty have no tokens, and neither have those whose tokens' bytes don't give back the text (U+2581,
which B reads as a space): they get zeros and an empty digest. Very long texts are encoded whole. Strings of special
tokens are ordinary text. Rows that repeat an id or a text count each. An empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spinewright.core import materialize, sized_join

#: Where executors find the vocabularies, unless the caller names other paths or has shipped the files with ``addFile``.
BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUN_BYTES = 8 << 20
SALTS = 16
#: Rows of pair counts that may be broadcast, of some 24 bytes each.
BROADCAST_PAIRS = 1_000_000
#: Chunks that are encoded in one call.
BLOCK = 256
_CHUNK = regex.compile(r"(?<=\S) (?=\S)")
# where a space isn't a place to cut: at either end, and beside other white space
_UNEVEN = re.compile(r"\A | \Z|\s | [^\S ]")
_PIECE_BYTE = regex.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the others
    follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _table(pieces: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    return pieces, np.array([len(p) for p in pieces], np.int64)


class Tokenizers:
    """Both encoders, and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(byte_bpe, encoding="utf-8") as f:
            model = json.load(f)
        alphabet, special = byte_alphabet(), {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            a_bytes[i] = token
        self.a_bytes, self.a_size = _table(a_bytes)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError(f"{pieces}: a piece holds a space behind another character, so texts can't be cut at spaces")
        control = [self.b.is_control(i) or self.b.is_unknown(i) for i in range(len(names))]
        to_bytes = lambda n: bytes.fromhex(m[1]) if (m := _PIECE_BYTE.fullmatch(n)) else n.replace("▁", " ").encode()
        self.b_bytes, self.b_size = _table([b"" if c else to_bytes(n) for n, c in zip(names, control, strict=True)])
        self.a_digits, self.b_digits = _digits(len(self.a_bytes)), _digits(len(self.b_bytes))


def _digits(n: int) -> np.ndarray:
    """Ids in decimal, followed by one of ``,|;``, as eight bytes; row ``3 * id + separator``."""
    return np.frombuffer(b"".join(f"{i}{sep}".encode().ljust(8, b"\0") for i in range(n) for sep in ",|;"), np.uint64)


@lru_cache(maxsize=2)
def tokenizers(byte_bpe: str, pieces: str) -> Tokenizers:
    """The tokenizers of two files: paths on the executor, or names of files shipped with ``SparkContext.addFile``."""
    return Tokenizers(*(p if os.path.exists(p) else SparkFiles.get(os.path.basename(p)) for p in (byte_bpe, pieces)))


def chunked(text: str) -> list[str]:
    """``text`` cut at single spaces between two characters that aren't white space."""
    return _CHUNK.split(text) if _UNEVEN.search(text) else text.split(" ")


def _blocks(chunks: list[str]) -> list[list[str]]:
    """Neighbouring chunks that may be encoded as one text, as the space between them is again a place to cut."""
    out: list[list[str]] = [[]]
    ragged = True
    for c in chunks:
        if ragged or len(out[-1]) >= BLOCK or c[0].isspace():
            out.append([])
        out[-1].append(c)
        ragged = c[-1].isspace()
    return out[1:]


class Chunks:
    """Distinct chunks encoded and aligned together; arrays by chunk, and the chunks' links one after the other."""

    def __init__(self, chunks: list[str], t: Tokenizers):
        a_ids, b_ids, self.ok, sizes = self._encoded(chunks, t)
        # both cover the same bytes, so ends compare across chunks
        a_ends, b_ends, stops = np.cumsum(t.a_size[a_ids]), np.cumsum(t.b_size[b_ids]), np.cumsum(sizes)
        a_stop, b_stop = np.searchsorted(a_ends, stops, side="right"), np.searchsorted(b_ends, stops, side="right")
        self.n_a, self.n_b = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)  # every token has bytes
        a_label, b_label = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        chunk_cuts = np.searchsorted(cuts, stops, side="right")
        self.n_groups = np.diff(chunk_cuts, prepend=0)
        # links: at each cut, every A token that ends there with every B token that does
        (a_low, a_n), (b_low, b_n) = self._ending(a_ends, cuts), self._ending(b_ends, cuts)
        n = a_n * b_n
        cut = np.repeat(np.arange(len(cuts)), n)
        place = np.arange(len(cut)) - np.repeat(np.cumsum(n) - n, n)
        pairs = (a_ids[a_low[cut] + place // b_n[cut]] << 32) | b_ids[b_low[cut] + place % b_n[cut]]
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)
        link_stop = np.concatenate([[0], np.cumsum(n)])[chunk_cuts]
        self.n_links = np.diff(link_stop, prepend=0)
        self.link_start = link_stop - self.n_links
        self.groups = self._written(t, (a_ids, a_label, a_stop), (b_ids, b_label, b_stop), len(cuts))

    @staticmethod
    def _encoded(chunks: list[str], t: Tokenizers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B; for each chunk whether the ids give back its bytes, and these bytes' number, 0 if not."""
        joined = lambda ids, table: b"".join(map(table.__getitem__, ids))
        flat = lambda lists: list(chain.from_iterable(lists))
        blocks = [" ".join(x) for x in _blocks(chunks)]
        a, b = flat(t.a.encode_ordinary(" " + x) for x in blocks), flat(t.b.encode(blocks, num_threads=1) if blocks else [])
        source = "".join(" " + x for x in blocks).encode()
        ok, sizes = np.ones(len(chunks), bool), np.fromiter((len(c.encode()) + 1 for c in chunks), np.int64, len(chunks))
        if joined(a, t.a_bytes) != source or joined(b, t.b_bytes) != source:  # somewhere; find the chunks
            each_a, each_b = [t.a.encode_ordinary(" " + c) for c in chunks], t.b.encode(chunks, num_threads=1)
            for i, c in enumerate(chunks):
                ok[i] = joined(each_a[i], t.a_bytes) == joined(each_b[i], t.b_bytes) == (" " + c).encode()
            a, b = (flat(x for x, good in zip(ids, ok, strict=True) if good) for ids in (each_a, each_b))
            sizes = sizes * ok
        return np.array(a, np.int64), np.array(b, np.int64), ok, sizes

    @staticmethod
    def _ending(ends: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.searchsorted(ends, cuts, side="left")
        return low, np.searchsorted(ends, cuts, side="right") - low

    @staticmethod
    def _written(t: Tokenizers, a: tuple, b: tuple, n_cuts: int) -> list[str]:
        """The groups of each chunk as text: A ids, ``|``, B ids, with ``;`` between groups."""
        (a_ids, a_label, a_stop), (b_ids, b_label, b_stop) = a, b
        a_of, b_of = np.bincount(a_label, minlength=n_cuts), np.bincount(b_label, minlength=n_cuts)
        a_at = np.arange(len(a_ids)) + (np.cumsum(b_of) - b_of)[a_label]
        b_at = np.arange(len(b_ids)) + np.cumsum(a_of)[b_label]
        last = lambda label: np.diff(label, append=-1) != 0
        out = np.zeros(len(a_ids) + len(b_ids), np.uint64)
        out[a_at] = t.a_digits[3 * a_ids + last(a_label)]
        out[b_at] = t.b_digits[3 * b_ids + 2 * last(b_label)]
        data = out.view(np.uint8)
        used = data != 0
        text = data[used].tobytes().decode("ascii")
        stops = np.concatenate([[0], np.cumsum(used.reshape(-1, 8).sum(axis=1))])[a_stop + b_stop]
        return [text[x : max(x, y - 1)] for x, y in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


def align_texts(texts: list[str], t: Tokenizers) -> dict[str, object]:
    """For each text: token, group and link numbers, its groups as text, and its distinct pairs (A id above 32 bits of
    B id) with how often each is linked in it."""
    known: dict[str, int] = {}
    cut = [[known.setdefault(c, len(known)) for c in chunked(x)] if x else [] for x in texts]
    c = Chunks(list(known), t)
    if not c.ok.all():
        cut = [x if c.ok[x].all() else [] for x in cut]
    per_text = np.array([len(x) for x in cut], np.int64)
    flat, text_of = np.fromiter(chain.from_iterable(cut), np.int64), np.repeat(np.arange(len(texts)), per_text)
    total = lambda by_chunk: np.bincount(text_of, weights=by_chunk[flat], minlength=len(texts)).astype(np.int64)
    n = c.n_links[flat]
    at = np.repeat(c.link_start[flat] - np.cumsum(n) + n, n) + np.arange(n.sum())
    # text and pair as one number, so that a sort brings a text's equal pairs together
    both = np.sort(np.repeat(text_of, n) * len(c.pairs) + c.pair[at])
    first = np.flatnonzero(np.diff(both, prepend=-1))
    times = np.diff(first, append=len(both))
    owner, pair = np.divmod(both[first], max(1, len(c.pairs)))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)
    out: dict[str, object] = {k: total(getattr(c, k)) for k in ("n_a", "n_b", "n_groups", "n_links")}
    return out | {"groups": [";".join(map(c.groups.__getitem__, x)) for x in cut], "pairs": c.pairs[pair], "times": times, "offsets": offsets}


def _columns(texts: list[str], t: Tokenizers, written: bool) -> list[pa.Array]:
    x = align_texts(texts, t)
    offsets = pa.array(x["offsets"])
    digests = [hashlib.sha256(g.encode("ascii")).hexdigest() if g else "" for g in x["groups"]]
    return [
        *[pa.array(x[k]) for k in ("n_a", "n_b", "n_groups", "n_links")], pa.array(digests, pa.string()), *([pa.array(x["groups"], pa.string())] if written else []),
        pa.ListArray.from_arrays(offsets, pa.array(x["pairs"])), pa.ListArray.from_arrays(offsets, pa.array(x["times"].astype(np.int32))),
    ]


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES, written: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` of every row, ``groups`` as text if ``written``, and its
    distinct ``pairs`` with their ``times``."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long, text = T.LongType(), T.StringType()
    fields = [*[(k, long) for k in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", text), *([("groups", text)] if written else []), ("pairs", T.ArrayType(long, False)), ("times", T.ArrayType(T.IntegerType(), False))]
    schema = T.StructType([narrow.schema["doc_id"], *[T.StructField(k, kind) for k, kind in fields]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(byte_bpe, pieces)
        for batch in batches:
            run = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64)) // RUN_BYTES
            edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
            for at, to in zip(edges, edges[1:], strict=False):
                if to > at:
                    part = batch.slice(at, to - at)
                    yield pa.RecordBatch.from_arrays([part["doc_id"], *_columns(part["text"].to_pylist(), t, written)], schema.names)

    return narrow.mapInArrow(work, schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``pair, count, best``: how often each pair is linked in all texts, and whether no pair of its B id is more often.
    ``pairs``: rows of ``pair, times``, any number a pair."""
    salted = pairs.groupBy("pair", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).agg(F.sum("times").alias("times"))
    counts = materialize(salted.groupBy("pair").agg(F.sum("times").alias("count")))
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id")
    highest = counts.groupBy(b_id).agg(F.max("count").alias("highest"))
    # a row for each B id at most, and a vocabulary is small
    return counts.withColumn("b_id", b_id).join(F.broadcast(highest), "b_id").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def links(docs: DataFrame, **options: object) -> DataFrame:
    """``a_id, b_id, count, best`` of every linked pair of ids."""
    counts = pair_counts(_exploded(aligned(docs, **options)))
    return counts.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "count", "best")


def _exploded(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(*keep, F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES, written: bool = False) -> DataFrame:
    """A row for each row of ``docs``: the numbers and digest of :func:`aligned`, ``n_best`` and ``count_sum``."""
    rows = materialize(aligned(docs, id_col, text_col, byte_bpe, pieces, written).withColumn("k", F.monotonically_increasing_id()))
    counts = materialize(pair_counts(_exploded(rows)))
    met = sized_join(_exploded(rows, "k"), counts, "pair", limit=BROADCAST_PAIRS)
    sums = met.groupBy("k").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return rows.drop("pairs", "times").join(sums, "k", "left").select(*kept, zero("n_best"), zero("count_sum"), "groups_sha256", *(["groups"] if written else []))
