"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while many small birds sing in tall green trees near old stone bridges".split()


def prose(n, seed=0):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def awkward(spark):
    long = prose(30_000, 5)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, prose(60, 1), "en", "b", 1), (5, prose(60, 1), "en", "b", 1),
        (None, prose(60, 2), None, None, None), (6, long, "fr", "c", len(long)), (7, long, "fr", "c", len(long)), (8, "tie one\ntwo\nthree\nfour", "de", "a", 9), (8, "tie one\ntwo\nthree\nfour", "de", "a", 9),
        (9, "été naïve Ærø 日本語 😀 \u0000 ▁x", "fr", "z", 3), (10, "short", "en", "a", 5),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def folder(df, path, name="documents"):
    df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
