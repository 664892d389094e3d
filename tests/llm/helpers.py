"""Small tables with every awkward row, and plain restatements of the operators."""

import random

EXTRA = {"node": "n", "m": "x", "block": "7", "score": "s", "_row": "r", "digest": "d", "_id": "i", "key": "k", "lang_pred": "l"}
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ro", "su", "ti") for b in ("an", "en", "in", "on", "un", "ar", "er")]


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + pick.choice(WORDS) for _ in range(n))


def changed(text: str, seed: int, n: int) -> str:
    pick, words = random.Random(seed), text.split()
    for i in pick.sample(range(len(words)), n):
        words[i] = f"new{seed}x{i}"
    return " ".join(words)


def awkward_rows() -> list[tuple]:
    """(doc_id, text, lang): nulls, empty, white space, short, very long, copies, near copies, repeated rows."""
    base, passage = prose(1, 120), prose(2, 40)
    rows = [(None, base, "aa"), (None, None, None), (1, None, "aa"), (2, "", None), (3, " \n\t ", "aa"), (4, "one", "aa"),
            (5, "One", "aa"), (6, base, "aa"), (7, base, "aa"), (7, base, "aa"), (8, changed(base, 1, 3), "aa"),
            (9, changed(base, 2, 4), "aa"), (10, prose(3, 20_000), "aa"), (11, prose(4, 50) + "\n" + passage + "  " + prose(5, 9), "aa"),
            (12, passage, "aa"), (13, prose(6, 30) + " " + passage, "aa"), (14, "a b c d e f g h i j k l", "aa"),
            (15, "a b c d e f g h i j k l m", "aa"), (16, "x a b c d e f g h i j k l m", "aa"), (17, "same " * 400, "aa"),
            (18, "same " * 300 + "end", "aa"), (19, "ümläut   \x1c ß 😀 " * 9, "aa"), (-3, base.upper(), "aa")]
    group = prose(7, 60)
    rows += [(100 + i, changed(group, i, 1 + i % 5), "aa") for i in range(40)]
    return rows


def table(spark, rows, names=("doc_id", "text", "lang"), extra=True):
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "n_chars": "int"}
    df = spark.createDataFrame(rows, ", ".join(f"{n} {kinds[n]}" for n in names)).repartition(5)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({k: F.lit(v) for k, v in EXTRA.items()})
    return df


def folded(text):
    return (text or "").encode().lower().split()


def shingle_set(text, size):
    words = folded(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))
