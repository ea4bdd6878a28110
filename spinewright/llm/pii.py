"""Personal data by weak supervision: labelers vote, EM rates them, and a span classifier is trained on the result.

Candidates are wide: every match of the four base patterns (email, ip, card, phone), the matches that fail their
check too, addresses with a spelled-out at-sign, national phone forms, numbers in the shape of a national id,
credential-like runs of letters and digits and what stands behind a cue such as ``token =``, titles with a name,
and street addresses. Six labelers vote yes, no or nothing on each: ``format`` (the kind's strict form, with its
checksum or ranges), ``gazetteer`` (lists of endings, issuers, area codes, key prefixes, given names, streets),
``cue`` and ``against`` (words around the span), ``alone`` (the signs beside it) and ``variety`` (how mixed its
characters are). Spark counts the vote patterns of all documents, at most 3^6 a kind; expectation-maximisation
over them estimates each labeler's reliability, without a labelled example, and one logistic span classifier for
all kinds is fitted to the resulting probabilities on votes, shape and kind. Candidates it gives ``ACCEPT`` or
more are added to the base spans.

Base spans are leftmost and do not overlap within a kind; a failing match is dropped without a retry, and base
spans stay whatever the classifier says. Added spans don't overlap each other or a base span, but may enclose a
base span of another kind (a card number within a key). Offsets are code points, ends exclusive.

Null and empty texts have no spans, an empty table has no rows and an empty model. Repeated rows get a row each;
extra columns are ignored, whatever their names. Of candidates that overlap, the likelier one stays, of equally
likely ones the earlier, then the one whose kind is listed first. Texts of any length cost time in proportion to
their length and matches, as every pattern starts at an anchor or a run's beginning and overlaps are looked up in
sorted lists. Documents stay whole; no span or candidate is capped.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Candidates beyond the base patterns' matches. Each starts where a run starts.
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?[\[({<] ?at ?[\])}>] ?[A-Za-z0-9-]{2,63}(?: ?(?:[\[({<] ?dot ?[\])}>]|\.) ?[A-Za-z0-9-]{2,24}){1,4}",
    re.IGNORECASE,
)
_SPELLED_AT = re.compile(r"[\[({<] ?at ?[\])}>]", re.IGNORECASE)
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z]|[-.][0-9])|(?<![0-9A-Za-z+.(/-])0[0-9]{1,4}[ /-][0-9]{3,4}(?:[ -]?[0-9]{2,4}){1,2}(?![0-9A-Za-z])")
_ID = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])")
_RUN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}")
_ASSIGNED = re.compile(r"\b(?:token|secret|passwd|password|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth)\b[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?([^\s\"'<>,;]{6,})", re.IGNORECASE)
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Señor|Señora|Monsieur|Madame)\.? [A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+){0,2}")
_STREET = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Square|Sq)\b")
# Endings of network names, issuers' first digits, prefixes of keys, given names, cue words, and words that speak against personal data.
_ENDINGS = frozenset(("com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "eu", "us", "ca", "ch", "at", "it", "nl", "be"))
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "22", "23", "24", "25", "26", "27", "35", "36", "38")
_KEY_PREFIXES = ("sk-", "pk-", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "eyJ", "ya29.")
_GIVEN = frozenset(("john", "mary", "james", "anna", "peter", "maria", "paul", "laura", "david", "julia", "thomas", "sarah", "michael", "emma", "jean", "marie", "hans", "carlos", "jose", "pierre"))
_CUES = {
    "email": frozenset(("mail", "email", "e-mail", "contact", "write", "reach", "address", "kontakt", "correo", "courriel")),
    "ip": frozenset(("ip", "host", "server", "address", "client", "login", "from", "ping")),
    "card": frozenset(("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "karte", "carte", "tarjeta")),
    "phone": frozenset(("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "llame", "appelez", "whatsapp", "sms")),
    "secret": frozenset(("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api-key", "auth", "bearer", "credential", "credentials")),
    "id": frozenset(("ssn", "social", "security", "id", "insurance", "tax", "identity", "passport")),
    "name": frozenset(("dear", "sincerely", "signed", "contact", "regards", "from")),
    "address": frozenset(("address", "lives", "located", "street", "ship", "delivery", "home")),
}
_AGAINST = frozenset(("version", "isbn", "issn", "page", "pages", "order", "item", "model", "serial", "chapter", "section", "table", "figure", "checksum", "sha", "sha1", "sha256", "md5", "commit", "digest", "hash", "uuid"))
LABELERS = ("format", "gazetteer", "cue", "against", "alone", "variety")
#: Kinds in the order of the result: the four base kinds and those that only the method adds.
KINDS = (*BASE_KINDS, "secret", "id", "name", "address")
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9-]*")


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The email pattern's matches: its first part is the whole run before an at-sign, from the last match's end on."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        # the run before the next sign can't reach behind this one
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four kinds, in the order of the kinds, then of the starts."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _wide(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of all candidates, of the base patterns those too that fail."""
    if "@" in text:
        yield from (("email", a, b) for a, b in _emails(text))
    if _SPELLED_AT.search(text):
        yield from (("email", *m.span()) for m in _SPELLED.finditer(text))
    yield from (("ip", *m.span()) for m in _IP.finditer(text))
    yield from (("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(_NOT_DIGIT.sub("", m[0])) <= 19)
    if "+" in text:
        yield from (("phone", *m.span()) for m in _PHONE.finditer(text))
    yield from (("phone", *m.span()) for m in _NATIONAL.finditer(text))
    yield from (("id", *m.span()) for m in _ID.finditer(text))
    for m in _RUN.finditer(text):
        if not (m[0].isalpha() or m[0].isdigit()) and any(map(str.isdigit, m[0])) and any(map(str.isalpha, m[0])):
            yield ("secret", *m.span())
    if "=" in text or ":" in text:
        yield from (("secret", *m.span(1)) for m in _ASSIGNED.finditer(text))
    yield from (("name", *m.span()) for m in _NAME.finditer(text))
    yield from (("address", *m.span()) for m in _STREET.finditer(text))


def candidates(text: str) -> list[tuple[str, int, int, tuple[int, ...], tuple[int, ...]]]:
    """(kind, start, end, votes, shape) of every candidate, once each."""
    return [(k, a, b, _votes(k, text, a, b), _shape(text[a:b])) for k, a, b in dict.fromkeys(_wide(text))]


def _format(kind: str, span: str, digits: str) -> bool:
    """Whether the span has its kind's strict form."""
    if kind == "email":
        return bool(re.search(r"[A-Za-z0-9]", span[:2])) and span.rpartition(".")[2].isalpha() or bool(_SPELLED_AT.search(span))
    if kind == "ip":
        return all(len(p) <= 3 and int(p) <= 255 for p in span.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15 and (span[0] == "+" or digits[0] == "0" or digits[3] not in "01")
    if kind == "id":
        return digits[:3] not in ("000", "666") and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "secret":
        return len(span) <= 512 and bool(digits) and len(digits) < len(span)
    return True


def _known(kind: str, span: str, digits: str) -> int:
    """The vote of the lists."""
    if kind == "email":
        return 1 if (w := _WORD.findall(span)) and w[-1].lower() in _ENDINGS else -1
    if kind == "ip":
        first = span.split(".")[0]
        return 1 if len(first) <= 3 and 0 < int(first) < 224 else -1
    if kind == "card":
        return 1 if digits.startswith(_ISSUERS) else -1
    if kind == "phone":
        area = digits[-10:-7]
        return 1 if span[0] == "+" and digits[0] != "0" or digits[0] == "0" or area[:1] not in ("0", "1") and area[1:2] != "9" else -1
    if kind == "secret":
        return 1 if span.startswith(_KEY_PREFIXES) or len(span) in (32, 40, 64) and not re.search(r"[^0-9a-fA-F]", span) else 0
    if kind == "id":
        return -1 if digits[0] == "9" else 0
    if kind == "name":
        return 1 if {w.lower() for w in _WORD.findall(span)} & _GIVEN else 0
    return 1


def _varied(kind: str, span: str, digits: str) -> int:
    """The vote on a span's mix of characters."""
    if kind == "secret":
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span[:512], span[1:512], strict=False))
        return 1 if 4 * turns >= min(len(span), 512) else -1 if 12 * turns < min(len(span), 512) else 0
    if kind in ("name", "address", "email", "ip"):
        return 0
    return 1 if len(set(digits)) >= 4 else -1


def _votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    around = {w.lower() for w in _WORD.findall(text[max(0, start - 48) : start]) + _WORD.findall(text[end : end + 24])}
    alone = 1 if (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum()) else -1
    return (1 if _format(kind, span, digits) else -1, _known(kind, span, digits), 1 if around & _CUES[kind] else 0, -1 if around & _AGAINST else 0, alone, _varied(kind, span, digits))


def _shape(span: str) -> tuple[int, ...]:
    """A span's look in a few small numbers, 128 in all: length in four steps, four flags, and two steps of digits."""
    size = len(span)
    return ((size > 12) + (size > 24) + (size > 48), int("(" in span or "[" in span), int("-" in span), int("." in span), int(" " in span), int(2 * sum(map(str.isdigit, span)) > size))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(k, "".join(f"{v + 1}" for v in votes), "".join(map(str, shape))) for t in b.column(0) if (s := t.as_py()) for k, _, _, votes, shape in candidates(s)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["kind", "votes", "shape"])


#: Weight of the beliefs EM starts with, in votes: a labeler's vote is right more often than wrong, strict forms mostly so.
_BELIEF = (96.0, 4.0, 6.0, 6.0, 2.0, 2.0)


def reliabilities(votes: np.ndarray, times: np.ndarray, rounds: int = 50, belief: tuple[float, ...] = _BELIEF) -> tuple[np.ndarray, np.ndarray]:
    """EM for one kind: P(vote | class) of each labeler, and P(personal) of each vote pattern.

    ``votes``: patterns x labelers of 0 (no), 1 (nothing), 2 (yes). Starts from the vote weighted by ``belief``, which
    also keeps labelers better than chance, so that few patterns can't turn the classes round.
    """
    p = 1 / (1 + np.exp(-((votes - 1) @ np.log(belief[: votes.shape[1]]))))
    table = np.full((2, votes.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        for c, q in ((1, p), (0, 1 - p)):
            for v in range(3):
                prior = np.where(v == 2 * c, np.array(belief[: votes.shape[1]]), 1.0)
                table[c, :, v] = prior + ((votes == v) * (q * times)[:, None]).sum(axis=0)
            table[c] /= table[c].sum(axis=1, keepdims=True)
        share = (1 + (p * times).sum()) / (2 + times.sum())
        at = np.arange(votes.shape[1])
        odds = np.log(share / (1 - share)) + sum(np.log(table[1, j, votes[:, j]]) - np.log(table[0, j, votes[:, j]]) for j in at)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return table, p


def _inputs(kinds: np.ndarray, votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Rows of the classifier: the votes, the shape, the kind, and the first two votes by kind."""
    of = np.eye(len(KINDS))[kinds]
    votes = votes - 1.0
    return np.concatenate([votes, shape / np.array([3.0, 1, 1, 1, 1, 1]), of, of * votes[:, :1], of * votes[:, 1:2]], axis=1)


@dataclass
class Model:
    """The classifier's weights (none if no text has a candidate), and P(vote | class) of each labeler by kind."""

    weights: np.ndarray | None
    rates: dict[str, np.ndarray]

    def chances(self, found: list[tuple[str, int, int, tuple[int, ...], tuple[int, ...]]]) -> np.ndarray:
        """P(personal) of candidates."""
        if self.weights is None or not found:
            return np.zeros(len(found))
        x = _inputs(np.array([KINDS.index(c[0]) for c in found]), np.array([c[3] for c in found]) + 1, np.array([c[4] for c in found], float))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def train(docs: DataFrame) -> Model:
    """The span classifier. The driver sees distinct (kind, votes, shape) patterns with their counts over all documents,
    at most 8 x 3^6 x 128 of them whatever the data, in truth some hundreds."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_patterns, "kind string, votes string, shape string").groupBy("kind", "votes", "shape").count().orderBy("kind", "votes", "shape").collect()
    if not counted:
        return Model(None, {})
    kinds = np.array([KINDS.index(r["kind"]) for r in counted])
    votes = np.array([[int(x) for x in r["votes"]] for r in counted])
    shape = np.array([[int(x) for x in r["shape"]] for r in counted], float)
    times, target, rates = np.array([r["count"] for r in counted], float), np.zeros(len(counted)), {}
    for at in sorted(set(kinds.tolist())):
        own = np.flatnonzero(kinds == at)
        pattern, place = np.unique(votes[own], axis=0, return_inverse=True)
        rates[KINDS[at]], p = reliabilities(pattern, np.bincount(place.ravel(), weights=times[own]))
        target[own] = p[place.ravel()]
    x = _inputs(kinds, votes, shape)
    w = np.zeros(x.shape[1])
    for _ in range(50):  # logistic regression on the soft labels
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (times * p * (1 - p))) @ x + 0.1 * np.eye(len(w)), x.T @ (times * (target - p)) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(w, rates)


def spans(text: str | None, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans and those that the classifier adds."""
    if not text:
        return [], []
    base = base_spans(text)
    known = set(base)
    found = [c for c in candidates(text) if c[:3] not in known]
    rated = sorted(((-p, c[1], KINDS.index(c[0]), c[2]) for c, p in zip(found, model.chances(found).tolist(), strict=True) if p >= ACCEPT))
    # spans of a list don't overlap, so only the neighbours of a place in the order of starts matter
    by_kind = {k: sorted((a, b) for x, a, b in base if x == k) for k in BASE_KINDS}
    taken: list[tuple[int, int]] = []
    more = []
    for _, a, kind, b in rated:
        free = not _touching(taken, a, b)
        for k, own in by_kind.items():
            free = free and all(k != KINDS[kind] and a <= x and y <= b for x, y in _touching(own, a, b))
        if free:
            insort(taken, (a, b))
            more.append((KINDS[kind], a, b))
    return base, more


def _touching(own: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """Those of sorted spans without overlaps that share a character with ``a`` to ``b``."""
    at = bisect_left(own, (a, a))
    at -= at > 0 and own[at - 1][1] > a
    end = at
    while end < len(own) and own[end][0] < b:
        end += 1
    return own[at:end]


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (KINDS.index(s[0]), s[1])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long, has_personal boolean"


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each document: the counts and digest of its base spans, all its spans with their number, how many of
    them the classifier added, and whether there is any. ``model`` is trained on ``docs`` where none is given."""
    model = model or train(docs)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [spans(t.as_py(), model) for t in b.column(1)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in BASE_KINDS]
            digests = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in both], pa.string())
            joined = pa.array([_joined(base + more) for base, more in both], pa.string())
            numbers = [pa.array([len(more) for _, more in both], pa.int64()), pa.array([len(base) + len(more) for base, more in both], pa.int64())]
            some = pa.array([bool(base or more) for base, more in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, joined, *numbers, some], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(found, SCHEMA)
