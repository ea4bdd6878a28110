"""Fill-in-middle transformation: each text cut into prefix, middle and suffix and written out of order.

A text's units are its lines (``[^\\n]*\\n|[^\\n]+``). Two hashes of the row's id choose two cuts between units, a third
whether the text is transformed at all, a fourth the form: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle,
``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle, ``plain`` is the text as it was. Texts that hold one of the
three marks stay plain, so that a transformed text always has each mark once and :func:`restore` is exact.

The cuts of a whole Arrow batch are found together on its UTF-8 buffers: a lookup table classes each byte (line end,
continuation byte or other), a mask of adjacent bytes marks where units end, running sums that start anew at each
document count units and code points, and one ``searchsorted`` a cut finds its byte for all rows. Rows need nothing of
each other, so there is no shuffle; a batch is worked off in runs of ``RUN_BYTES`` of text, so memory doesn't grow with
the table, only with the longest text.

Null texts and empty ones are plain, with no units and an empty output; so are texts of the marks. Very long texts are
cut like others. A null id hashes as ``null``; rows that repeat an id get the same hashes. An empty table gives no
rows. Extra columns come through whole, whatever their names, in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spinewright.llm.rows import packed

SEED = 7
#: Of 100 texts, how many are transformed, and how many of those have the suffix first.
FIM_PERCENT, SPM_PERCENT = 100, 50
#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RUN_BYTES = 8 << 20

_LINE_END, _CONTINUATION = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("\n")] = _LINE_END
_CLASS[0x80:0xC0] = _CONTINUATION


def draws(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from a row's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _has_mark(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which rows hold a mark within their own bytes."""
    last = np.frombuffer("".join(m[1] for m in (PREFIX, SUFFIX, MIDDLE)).encode(), np.uint8)
    at = np.flatnonzero((data[:-2] == ord("<")) & np.isin(data[1:-1], last) & (data[2:] == ord(">")))
    row = np.searchsorted(ends, at, side="right")  # the first row that ends behind it
    out = np.zeros(len(starts), bool)
    out[row[(at >= starts[row]) & (at + 3 <= ends[row])]] = True
    return out


def cut(offsets: np.ndarray, data: np.ndarray, first: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
    """For all rows of UTF-8 ``data`` between ``offsets``: their ``units``, the bytes where prefix and middle end, the
    code points of both, and whether a mark occurs. ``first`` and ``second`` are the draws for the two cuts."""
    starts, ends = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    kind = _CLASS[data]
    # a unit ends at a line end, and where the next byte belongs to another row
    is_end = kind == _LINE_END
    is_end[ends[ends > starts] - 1] = True
    unit_ends = np.flatnonzero(is_end) + 1
    before = np.searchsorted(unit_ends, starts, side="right")  # units before the row: sums start anew with it
    units = np.searchsorted(unit_ends, ends, side="right") - before
    low, high = np.minimum(first % (units + 1), second % (units + 1)), np.maximum(first % (units + 1), second % (units + 1))
    place = lambda k: np.where(k > 0, unit_ends[np.minimum(before + k, len(unit_ends)) - 1] if len(unit_ends) else 0, starts)
    prefix_end, middle_end = place(low), place(high)
    points = np.concatenate([[0], np.cumsum(kind != _CONTINUATION)])
    return {
        "units": units, "prefix_end": prefix_end, "middle_end": middle_end,
        "prefix_chars": points[prefix_end] - points[starts], "middle_chars": points[middle_end] - points[prefix_end],
        "marked": _has_mark(data, starts, ends),
    }


def _transformed(text: pa.Array, draw: list[np.ndarray], fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """``n, form, prefix_chars, middle_chars, output`` of a run of rows."""
    text = text.cast(pa.large_string())
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    c = cut(offsets, data, draw[0], draw[1])
    plain = (c["units"] == 0) | c["marked"] | (draw[2] % 100 >= fim_percent)
    spm = ~plain & (draw[3] % 100 < spm_percent)
    view, p, s, m = memoryview(data), PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    parts: list[bytes | memoryview] = []
    for start, a, b, end, is_plain, is_spm in zip(offsets[:-1].tolist(), c["prefix_end"].tolist(), c["middle_end"].tolist(), offsets[1:].tolist(), plain.tolist(), spm.tolist(), strict=True):
        if is_plain:
            parts.append(view[start:end])
        elif is_spm:
            parts += (s, view[b:end], p, view[start:a], m, view[a:b])
        else:
            parts += (p, view[start:a], s, view[b:end], m, view[a:b])
    sizes = np.diff(offsets) + np.where(plain, 0, len(p) + len(s) + len(m))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    output = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(b"".join(parts)))
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
    chars = [pa.array(c[k].astype(np.int64), mask=plain) for k in ("prefix_chars", "middle_chars")]
    return [pa.array(c["units"].astype(np.int64)), form, *chars, output.cast(pa.string())]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, columns: list[str] | None = None) -> DataFrame:
    """``row`` (the whole row of ``docs``, or its ``columns``), ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and
    ``output``, the transformed text."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kept = docs if columns is None else docs.select(*[quoted(c) for c in columns])
    drawn = draws(quoted(id_col), seed)
    narrow = docs.select(packed(kept), F.coalesce(quoted(text_col), F.lit("")).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(drawn)])
    schema = T.StructType([narrow.schema["row"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "n", "form", "prefix_chars", "middle_chars", "output"]
        for batch in batches:
            sizes = pa.compute.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64)
            run = np.cumsum(sizes) // RUN_BYTES
            for at, to in zip(*_runs(run), strict=True):
                part = batch.slice(at, to - at)
                draw = [part[f"h{i}"].to_numpy(zero_copy_only=False) for i in range(4)]
                yield pa.RecordBatch.from_arrays([part["row"], *_transformed(part["text"], draw, fim_percent, spm_percent)], names)

    return narrow.mapInArrow(work, schema)


def _runs(run: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches of equal values."""
    if not len(run):
        return [], []
    edges = (np.flatnonzero(np.diff(run)) + 1).tolist()
    return [0, *edges], [*edges, len(run)]


def restore(output: Column, form: Column) -> Column:
    """The text that a transformed one was made of. It splits at the marks, which occur once each."""
    parts = F.split(F.substring(output, len(PREFIX) + 1, 2_147_483_647), "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(0), part(2), part(1))).otherwise(F.concat(part(1), part(2), part(0)))


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars`` of every row, and the digests of its output and of the text
    restored from that."""
    out = transform(docs, columns=["doc_id"])
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
