"""Spelling variants and importance resampling against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from helpers import odd_docs, write_docs
from pyspark.sql import functions as F

from steadfield.llm import resampling, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def more_docs(seed=5):
    """Odd documents, misspelt words, letters beyond ASCII, one word in a third of all places, repeated rows."""
    rng = random.Random(seed)
    base = ["harbour", "signal", "Élève", "straße", "ÀÀÀÀÀ", "mississippi", "abcdefg", "letters"]

    def slip(w):
        i = rng.randrange(len(w))
        c = rng.choice("aezéÀ")
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w])

    rows = [(900 + k, " ".join(rng.choice(["harbour", slip(rng.choice(base))]) + rng.choice([",", "", "1", "-"]) for _ in range(120))) for k in range(40)]
    chain = [(800 + k, "signal " * 30 + "signel " * 6 + "sigxel") for k in range(6)]
    return odd_docs() + rows + rows[:2] + chain + [(7000, "word " * 9000), (7001, "A" * 5000), (7002, "x1y2 Zürich日本 Ünder_score \x00\x7f end")]


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    out = {}
    for w in n:
        close = [x for x in n if one_apart(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best and n[best] >= 2 * n[w] else None, len(close)]
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return sorted((w, f or "", root, n[w], k, n[f] if f else -1) for w, (f, k, root) in out.items())


def as_rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_variants_against_plain_python(spark, tmp_path):
    rows = more_docs()
    docs = write_docs(spark, str(tmp_path / "docs"), rows)
    found = spelling.variants(spelling.words(docs))
    want = plain_variants(plain_words(rows))
    assert as_rows(found) == want
    assert any(f and root != f for _, f, root, *_ in want) and any(k > 5 for *_, k, _ in want)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("seed", range(3))
def test_near_words_of_a_small_alphabet(spark, seed):
    """Words of two and three letters' arrangements: many anagrams, many meeting keys, both halves shared."""
    rng = random.Random(seed)
    found = {"".join(rng.choice("abÿ"[: 2 + seed % 2]) for _ in range(rng.randint(5, 9))) for _ in range(150)}
    n = {w: rng.choice([3, 3, 7, 50, 400]) for w in found}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    assert as_rows(spelling.variants(table)) == plain_variants(n)


def test_no_two_differences_of_letters_are_the_same():
    letters = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
    gaps = [a**spelling.POWER - b**spelling.POWER for a, b in itertools.permutations(letters, 2)]
    assert len(set(gaps)) == len(gaps) and not set(gaps) & {a**spelling.POWER for a in letters}


def test_empty_tables(spark, tmp_path):
    docs = write_docs(spark, str(tmp_path / "docs"), more_docs()[:3]).limit(0)
    assert spelling.variants(spelling.words(docs)).count() == 0
    assert resampling.resample(docs, docs).count() == 0
    some = write_docs(spark, str(tmp_path / "some"), [(1, None), (2, ""), (3, " .\n"), (None, "abc")])
    assert spelling.variants(spelling.words(some)).count() == 0
    assert sorted((r.n_features, r.rank) for r in resampling.resample(some, docs).collect()) == [(0, None)] * 3 + [(1, None)]


def plain_resample(rows, goal, percent=5):
    feats = []
    for _, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        feats.append((len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]))
    goals = []
    for text in goal:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        goals += [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    s, t = Counter(b for _, f in feats for b in f), Counter(goals)
    S, T = sum(s.values()), sum(t.values())
    out = []
    for (doc_id, _), (n, f) in zip(rows, feats):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    open_ = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(open_[: percent * len(open_) // 100]):
        r[4] = k + 1
    return sorted((r[:5] for r in out), key=repr)


def test_resampling_against_plain_python(spark, tmp_path):
    rows = more_docs()
    docs = write_docs(spark, str(tmp_path / "docs"), rows)
    goal = [None, "", rows[3][1], rows[8][1], rows[70][1], "harbour signal"]
    target = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(goal)], "item_id long, text string, uid string, bucket int")
    for percent, block in ((5, 4096), (60, 7)):
        got = resampling.resample(docs, target, percent=percent, block=block)
        assert sorted(([r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in got.collect()), key=repr) == plain_resample(rows, goal, percent)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5


def test_resampling_has_no_python_in_its_plan(spark, tmp_path):
    docs = write_docs(spark, str(tmp_path / "docs"), more_docs()[:20])
    plan = resampling.resample(docs, docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_ranks_over_many_partitions(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(900)).alias("v"), "id")
    got = {r.id: r["rank"] for r in resampling.ranked(rows, F.desc("v"), F.asc("id")).collect()}
    want = sorted(((-r.v, r.id) for r in rows.collect()))
    assert got == {i: k + 1 for k, (_, i) in enumerate(want)}
