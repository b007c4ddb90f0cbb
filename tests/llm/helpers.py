"""Small tables with every odd case, written as Parquet so that row places are stable."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, copies long, gone int"
WORDS = "the of and river stone cloud amber winter signal copper garden distant silver morning harbour timber quiet ember".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ","]) for _ in range(n))


def write_docs(spark, path, rows, parts=3):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s1", 0, "clash", 7, 1) for r in rows]
    spark.createDataFrame(full, DOCS).repartition(parts).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def odd_docs(seed=1):
    """Nulls, empty and blank texts, ties, repeated rows, one long text, copies and shared passages."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(3, 80)) for _ in range(30)]
    long = prose(rng, 6000)
    passage = prose(rng, 70)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(8)] + [(200, base[0]), (200, base[0]), (201, base[1].replace(" ", "  "))]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, None), (None, base[2]), (None, None)]
    rows += [(400, long), (401, long + " end"), (402, "a\n" * 300), (403, "é漢🙂 " * 40), (404, "x")]
    rows += [(500 + i, prose(rng, 10) + " " + passage + " " + prose(rng, 9)) for i in range(6)]
    rows += [(600 + i, base[5] + f" tail{i}") for i in range(5)]
    return rows
