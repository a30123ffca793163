"""Small tables for the operators' tests."""

HARD = [
    (0, "", "en"),
    (1, None, None),
    (2, " \t\n ", "en"),
    (3, "one", "en"),
    (4, "mail a.b@c-d.org, x@y and a@b.c_x@y.z; 1.2.3.4.5.6.7.8 999.1.1.1 +1 (374) 555-9996 +12 4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-1", "en"),
    (5, "é ü 日本 😀 ␛1 </s>[INST] x", "fr"),
    (6, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today again " * 3, "en"),
    (7, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today again " * 3, "en"),
    (8, "Zeta the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today", "de"),
    (9, "a" * 5000, "en"),
    (10, "ab " * 3000, "en"),
    (11, "5" * 3000 + " " + "1.2." * 500 + "x@" + "b." * 500 + "c", None),
]


def frame(spark, rows=None, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame(HARD if rows is None else rows, schema)


def saved(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
