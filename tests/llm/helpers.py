"""Small tables with the awkward cases that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, node int, shard string, hw string, kept string, toxicity string, rank long, mix_size long, mix_copy long, s_size long, d_bytes long, t_text string, t_id long, version string, none string, id string, n long, key string, taken long, target string, whole string, score string, o string, row string, _h long, _bad long, _old string, _version long"
_LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(40_000))


def docs(spark, extra=()):
    texts = [(1, "The cat sat on the mat today"), (2, "the CAT sat on the mat today"), (3, None), (4, ""), (5, " \n\t"), (None, "no id at all here"), (None, None), (7, _LONG), (8, "x" * 200_000), (9, "one"), (9, "one"), (10, "ß é 漢字 \U0001f600 words"), *extra]
    rows = [(i, t, None if i == 4 else "en", None if i in (3, 9) else f"s{(i or 0) % 3}", None, 5, 6, 7, "s", "h", "k", "t", 1, 2, *range(3), "tt", 9, "v", "no", "ii", 11, "kk", 12, "ta", "wh", "sc", "oo", "rr", 13, 14, "ol", 15) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
