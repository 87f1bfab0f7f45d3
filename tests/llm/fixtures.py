"""Small documents with everything that operators must bear: nulls, empty and long texts, ties, copies, clashing columns."""

import random

CLASHING = ("t", "fp", "row", "base", "tests", "spans", "tile", "shard", "run", "units", "score", "y", "id", "ids", "value", "place", "cluster", "bin", "n_tokens", "key", "digest", "component_id", "text_hash", "root")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(("the", "of", "thing", "eration", "onble", "reth", "hast", "wh", "éque", "schung", "ción", "nd")) + rng.choice(("", "er", "st", ",", ".")) for _ in range(n))


def texts():
    base = words(1, 60)
    out = [None, "", " ", "\n\t ", "a", "A b", base, base, base.upper(), base + " more", base.replace("thing", "ding", 1), words(2, 3000), "x" * 70_000, "日本 語 😀 ﬁn", words(3), words(3)]
    out += [words(seed) for seed in range(10, 30)]
    return out


def docs(spark, rows=None, clash=False):
    """(doc_id, text, ...) of the given texts, with ids 0, 1, ...; or of the usual ones, with a null id and a repeated row besides."""
    if rows is None:
        rows = [(k, t) for k, t in enumerate(texts())] + [(None, "no id"), (6, texts()[6]), (6, texts()[6])]
    rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
    df = spark.createDataFrame([(d, t, "en", f"s{k % 3}" if k % 7 else None, None) for k, (d, t) in enumerate(rows)], DOCS)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))
    return df


def as_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)
