"""Quality rules: base counts of a text, and its divergence from its language's references.

Each text's shares of character classes and of common words (short fixed lists of four languages, and the rest) are
compared with its language's reference by the Jensen-Shannon distance (square root of the divergence in bits, 0 to
1). A reference is the mean of the shares over all texts of that language that pass the base rules and are long
enough, one vote a text, so it covers all data. Guards: texts under ``MIN_CLASS_WORDS`` or ``MIN_COMMON_WORDS``
words aren't judged by that histogram, nor is a language with fewer than ``MIN_REFERENCE_TEXTS`` such texts, as
short counts diverge by chance; the limits also rise with the chance divergence of a text's length.

One pass over the texts counts; references and distances need only the counts. The lists of common words are short on
purpose: they hold articles, prepositions and pronouns that any longer text of the language uses.

Null texts count as empty, a null language is one of its own. Very long texts are counted whole, in chunks. Equal
words and lines are told apart by their bytes; a distance that equals its limit passes. Repeated rows get a row each
and each has a vote in the reference; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinewright.core import materialize, sized_join

CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "beyond_ascii")
# Frequent function words of four languages.
COMMON = {
    "en": "the of and to in is that it for was on are with as be this from or at not",
    "de": "der die und das den von zu mit auf ist im nicht ein eine dem des sich für",
    "fr": "le la les de des et en un une du que est pour qui dans pas sur par au",
    "es": "el los las del que en y por con para una no se al lo como su más",
}
MIN_WORDS, REPEAT_PERCENT = 50, 50
MIN_CLASS_WORDS, MIN_COMMON_WORDS, MIN_REFERENCE_TEXTS = 50, 80, 20
CLASS_LIMIT, COMMON_LIMIT = 0.28, 0.25

_WORDS = sorted({w for ws in COMMON.values() for w in ws.split()})
_PLACE = {w: i for i, w in enumerate(_WORDS)}
_SYMBOLS, _SPACES = "#*$%&|<>", " \t\n\v\f\r"
_TRIM = b".,;:!?\"'()[]"
_CLASS_OF = np.full(129, 5, np.int64)
for _at, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", _SPACES, ".,;:!?'\"()-")):
    _CLASS_OF[[ord(_c) for _c in _chars]] = _at
_CLASS_OF[128] = 6
_CHUNK = 1 << 20
SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<double>, common array<double>"


def _repeated(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, place, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    often = np.flatnonzero(times[place] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[often + k] = True
    return int(covered.sum())


def _shares(counts: np.ndarray) -> list[float]:
    return (counts / max(1, counts.sum())).tolist()


def measure(text: str | None) -> tuple:
    """The counts of one text, in the order of ``SCHEMA`` from ``n_words``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split knows just the six ASCII spaces
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    classes = np.zeros(len(CLASSES), np.int64)
    for at in range(0, len(text), _CHUNK):
        points = np.frombuffer(text[at : at + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        classes += np.bincount(_CLASS_OF[np.minimum(points, 128)], minlength=len(CLASSES))
    common = [0] * (len(_WORDS) + 1)
    for w, n in Counter(words).items():
        common[_PLACE.get(w.strip(_TRIM).decode("utf-8", "replace").lower(), -1)] += n
    return len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), _repeated(words), _shares(classes), _shares(np.array(common))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 5 + [pa.list_(pa.float64())] * 2
    names = [x.strip().split()[0] for x in SCHEMA.split(", ")]
    for b in batches:
        rows = [measure(t.as_py()) for t in b.column(2)]
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distances of rows of shares: the root of the divergence in bits."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
    return np.sqrt(np.maximum(parts.sum(axis=1) / 2, 0.0))


def _column(of: pa.Array, width: int) -> np.ndarray:
    """Lists of one width as rows; null lists as zeros."""
    out = np.zeros((len(of), width))
    there = np.flatnonzero(of.is_valid().to_numpy(zero_copy_only=False))
    if len(there):
        out[there] = of.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distance of each row's shares from its language's reference, null where the row has none."""
    for b in batches:
        out = []
        for share, reference, width in ((7, 9, len(CLASSES)), (8, 10, len(_WORDS) + 1)):
            known = b.column(reference).is_valid().to_numpy(zero_copy_only=False)
            distance = js_distance(_column(b.column(share), width), _column(b.column(reference), width))
            out.append(pa.array(distance, pa.float64(), mask=~known))
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(7)), *out], [*b.schema.names[:7], "class_distance", "common_distance"])


def quality(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``class_distance``, ``common_distance`` and ``kept``."""
    base = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    counted = materialize(base.mapInArrow(_measured, SCHEMA))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = counted.withColumns({"base_failed": failed, "key": F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("none"))})
    good = rows.where(~F.col("base_failed"))
    mean = lambda c, n, least: F.array(*[F.avg(F.when(F.col("n_words") >= least, F.col(c)[i])) for i in range(n)])
    seen = lambda least: F.count(F.when(F.col("n_words") >= least, 1))
    references = materialize(good.groupBy("key").agg(
        mean("classes", len(CLASSES), MIN_CLASS_WORDS).alias("class_reference"), mean("common", len(_WORDS) + 1, MIN_COMMON_WORDS).alias("common_reference"),
        seen(MIN_CLASS_WORDS).alias("class_texts"), seen(MIN_COMMON_WORDS).alias("common_texts"),
    ))
    # a language's references are some 700 bytes, so the limit is 14 MB
    joined = sized_join(rows, references, "key", "left", limit=20_000)
    known = lambda reference, texts, least: F.when((F.col("n_words") >= least) & (F.col(texts) >= MIN_REFERENCE_TEXTS), F.col(reference)).alias(reference)
    judged = joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "classes", "common",
        known("class_reference", "class_texts", MIN_CLASS_WORDS), known("common_reference", "common_texts", MIN_COMMON_WORDS),
    ).mapInArrow(_judged, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, common_distance double")
    chance = 0.6 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    diverges = F.coalesce(F.col("class_distance") > CLASS_LIMIT, F.lit(False)) | F.coalesce(F.col("common_distance") > COMMON_LIMIT + chance, F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"), (~F.col("base_failed") & ~diverges).alias("kept"))
