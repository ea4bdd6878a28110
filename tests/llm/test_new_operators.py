"""Fingerprints, alignment and fill-in-middle against brute force and round trips, and on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spinewright.llm import alignment, fim, imatch
from tests.llm.helpers import docs, empty

NASTY = [None, "", " ", "  ", "\n", "\n\n\n", "a\nb", "é\nß漢\n\U0001f600", "x<P>y\nz", "q\n<", "P>\n>", "<|endoftext|> <s> </s>", "a▁b", "tab\tnbsp x", "'s 'll don't", "12 345  6", "\r\n \r\n", "\x00\x01", "ﬁ ½", "w" * 5000, "​ ﻿"]


# fill in middle


def _plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(h[i] % (len(units) + 1) for i in (0, 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), form, len(p), len(m), out


def test_fill_in_middle_equals_a_plain_version(spark, monkeypatch):
    r = random.Random(2)
    texts = NASTY + ["".join(r.choice("ab\n\né漢<>PSM") for _ in range(r.randrange(60))) for _ in range(400)]
    d = spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    want = {(i if i != 5 else None): _plain_fim(i if i != 5 else None, t) for i, t in enumerate(texts)}
    out = fim.transform(d).select("row.doc_id", "row.text", "n", "form", "prefix_chars", "middle_chars", "output", fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert {x["doc_id"]: tuple(x)[2:7] for x in out} == want
    assert all(x["back"] == (x["text"] or "") for x in out) and {x["form"] for x in out} == {"plain", "psm", "spm"}
    monkeypatch.setattr(fim, "RUN_BYTES", 40)  # a batch in many runs
    assert [tuple(x) for x in fim.fill_in_middle(d.limit(100)).collect()] == [tuple(x) for x in fim.fill_in_middle(d).limit(100).collect()]


def test_fill_in_middle_rates_and_edge_cases(spark):
    rows = fim.transform(spark.createDataFrame([(i, "a\nb\nc\n") for i in range(1000)], "doc_id long, text string"), fim_percent=30, spm_percent=0).groupBy("form").count().collect()
    n = {x["form"]: x["count"] for x in rows}
    assert set(n) == {"plain", "psm"} and 220 < n["psm"] < 380
    d = docs(spark)
    out = fim.transform(d)
    assert Counter(str(x["row"]) for x in out.collect()) == Counter(str(x) for x in d.collect())
    assert fim.fill_in_middle(empty(spark)).count() == 0 and fim.fill_in_middle(d).count() == d.count()


# alignment


def _plain_alignment(texts):
    """Groups, links and pair counts by two cursors, with another library for A."""
    from tokenizers import Tokenizer

    t = alignment.tokenizers(alignment.BYTE_BPE, alignment.PIECES)
    other = Tokenizer.from_file(alignment.BYTE_BPE)
    other.encode_special_tokens = True
    out, counts = [], Counter()
    for text in texts:
        a, b = (other.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if b"".join(t.a_bytes[i] for i in a) != raw or b"".join(t.b_bytes[i] for i in b) != raw:
            a = b = []
        ends = []
        for ids, table in ((a, t.a_bytes), (b, t.b_bytes)):
            at, e = 0, []
            for i in ids:
                at += len(table[i])
                e.append(at)
            ends.append(e)
        cuts, groups, links, i, j = sorted(set(ends[0]) & set(ends[1])), [], [], 0, 0
        for c in cuts:
            x = sum(e <= c for e in ends[0])
            y = sum(e <= c for e in ends[1])
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        counts.update(links)
        out.append((len(a), len(b), links, ";".join(groups)))
    highest = {}
    for (_, q), n in counts.items():
        highest[q] = max(highest.get(q, 0), n)
    return [(na, nb, len(links), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for na, nb, links, g in out], counts


@pytest.mark.parametrize("limit", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_equals_a_plain_version(spark, monkeypatch, limit):
    r = random.Random(5)
    parts = [" ", "  ", "\n", "the", "Wörter", "漢字", "\U0001f600", "'s", "12", "<s>", "▁", "\x1c", "x" * 30, "!!", "<0x0A>", "ed", "ing "]
    texts = [t and t[:300] for t in NASTY] + ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(150)] + ["the end of the line. the end"] * 3
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", limit)  # both ways to meet the counts
    monkeypatch.setattr(alignment, "RUN_BYTES", 2000)
    want, counts = _plain_alignment(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: tuple(x)[1:] for x in alignment.align(d).collect()}
    assert [got[i] for i in range(len(texts))] == want
    pairs = {(x["a_id"], x["b_id"]): (x["count"], x["best"]) for x in alignment.links(d).collect()}
    assert {k: n for k, (n, _) in pairs.items()} == counts and any(b for _, b in pairs.values()) and not all(b for _, b in pairs.values())


def test_alignment_writes_groups_and_takes_edge_cases(spark):
    rows = alignment.align(docs(spark), written=True).collect()
    assert len(rows) == 12 and all(hashlib.sha256(x["groups"].encode()).hexdigest() == x["groups_sha256"] if x["groups"] else x["groups_sha256"] == "" for x in rows)
    assert [(x["n_a"], x["n_links"]) for x in rows if x["doc_id"] in (3, 4)] == [(0, 0), (0, 0)]
    assert max(x["n_a"] for x in rows) > 100_000  # the longest text is encoded whole
    assert alignment.align(empty(spark)).count() == 0 and alignment.links(empty(spark)).count() == 0


# I-Match


def _rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _words(r, n, size=3000):
    return " ".join(f"w{int(size * r.random() ** 2)}" for _ in range(n))


def test_edits_take_the_next_document(spark):
    r = random.Random(7)
    texts = NASTY + [_words(r, r.randint(1, 40)) for _ in range(100)]
    got = {x["doc_id"]: x for x in imatch.against_edits(_rows(spark, texts).repartition(5)).collect()}
    for i, t in enumerate(texts):
        t, n = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
    assert len({x["fingerprint"] for x in got.values() if not (texts[x["doc_id"]] or "").strip(" \n\r")}) == 1


def test_fingerprints_equal_a_plain_version(spark):
    r = random.Random(9)
    texts = [_words(r, r.randint(1, 200), 800) for _ in range(150)]
    d = _rows(spark, texts)
    df = Counter(w for t in texts for w in set(t.split()))
    low, high = max(2, 150**imatch.LEAST_POWER), max(2, 150**imatch.MOST_POWER)
    band = {w for w, n in df.items() if low <= n <= high}
    import xxhash

    h = lambda w: xxhash.xxh64_intdigest(w.encode(), imatch.HASH_SEED)
    assert {x["term"] % 2**64 for x in imatch.lexicon(d).collect()} == {h(w) for w in band}
    got = {x["doc_id"]: x["fingerprint"] for x in imatch.against_edits(d).collect()}
    for i, t in enumerate(texts):
        terms = sorted(h(w) for w in set(t.split()) & band)
        if not terms:
            assert got[i][0] == "a"
            continue
        level = math.ceil(math.log2(len(terms))) if len(terms) > 1 else 0
        parts = [f"l{level:02d}", xxhash.xxh64_hexdigest(b"".join(x.to_bytes(8, "little") for x in terms), imatch.HASH_SEED)]
        for deeper in range(level, level + imatch.LEVELS):
            for factor in map(int, imatch._FACTORS):
                mixed = lambda x, f=factor: (((x * f) % 2**64 ^ ((x * f) % 2**64 >> 32)) * f) % 2**64
                mine = [x for x in terms if deeper == 0 or mixed(x) < 2 ** (64 - deeper)]
                parts.append(f"{xxhash.xxh32_intdigest(b''.join(x.to_bytes(8, 'little') for x in mine), imatch.HASH_SEED) >> 8 | 1:06x}" if mine else imatch.NONE)
        assert got[i] == "".join(parts)


def test_likeness_tells_edits_from_others(spark):
    r = random.Random(3)
    texts = [_words(r, r.randint(100, 400)) for _ in range(200)]
    texts[51] = texts[50]
    rows = sorted(imatch.against_edits(_rows(spark, texts)).collect())
    assert rows[50]["near_next"] == 1.0 and rows[50]["fingerprint"] == rows[51]["fingerprint"]
    others = [x for x in rows if x["doc_id"] != 50]
    assert sum(x["near_edited"] > x["near_next"] for x in others) > 0.95 * len(others)
    assert all(0 <= x[k] <= 1 for x in rows for k in ("near_edited", "near_next"))


def test_lexicon_is_bounded_by_the_rarest(spark):
    r = random.Random(1)
    d = _rows(spark, [_words(r, 100, 500) for _ in range(80)])
    whole = {x["term"]: x["df"] for x in imatch.lexicon(d, most_power=0.9).collect()}
    few = {x["term"]: x["df"] for x in imatch.lexicon(d, most_power=0.9, most_terms=60).collect()}
    assert 0 < len(few) <= 60 < len(whole) and min(few.values()) >= max(n for t, n in whole.items() if t not in few)


def test_fingerprints_take_edge_cases(spark):
    d = docs(spark, [(6, "same"), (6, "same"), (6, "other")])
    rows = imatch.against_edits(d).collect()
    assert len(rows) == 15 and sorted(map(str, rows)) == sorted(map(str, imatch.against_edits(d.repartition(6)).collect()))
    assert imatch.against_edits(empty(spark)).count() == 0
    one = imatch.against_edits(_rows(spark, ["alone in the table"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"alone in " + b"alone in ").hexdigest()
