"""Documents with the awkward cases every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n: int = 120, seed: int = 3) -> list[tuple]:
    """Texts with exact and near copies, nulls, empties, short ones, repeated rows and one long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 4))) for _ in range(60)]
    texts: list[str | None] = [None, "", " \t\n", "one", "one two", "One  two\n", "a b c", "é ü ß", " x y"]
    while len(texts) < n:
        kind = r.random()
        if kind < 0.35 and len(texts) > 12:
            words = (r.choice(texts[9:]) or "x").split()
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(vocab)
            texts.append(" ".join(words))
        elif kind < 0.45 and len(texts) > 12:
            texts.append((r.choice(texts) or "") + r.choice(["", " ", "\n"]))
        else:
            texts.append(" ".join(r.choice(vocab) for _ in range(r.randint(1, 80))) + r.choice(["", ".", " common line shared by many texts of this set"]))
    texts.append(" ".join(r.choice(vocab) for _ in range(30_000)))
    out = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return out


def frame(spark, data=None):
    """Several partitions, in no order, with extra columns whose names the operators use inside."""
    data = rows() if data is None else data
    df = spark.createDataFrame(data, DOCS).repartition(5)
    for name in ("hash", "head", "rep", "block", "u", "v", "n", "keep_id", "_id", "score", "shard"):
        df = df.selectExpr("*", f"'extra' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
