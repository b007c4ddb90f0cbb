import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from helpers import odd_docs, prose, write_docs

from steadfield.llm import bag_minhash, components, exact_dedup, line_dedup, suffix_dedup

FOLD = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_groups_match_brute_force(spark, tmp_path):
    rows = odd_docs()
    docs = write_docs(spark, str(tmp_path / "d"), rows)
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[FOLD.sub(" ", t or "")].append(d)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for text, ids in groups.items():
        mine = by[hashlib.sha256(text.encode()).hexdigest()]
        first = min(ids, key=lambda d: (d is None, d or 0))
        assert len(mine) == len(ids) and {r.group_size for r in mine} == {len(ids)} and {r.keep_id for r in mine} == {first}
        assert sum(r.kept for r in mine) == 1
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_groups_of_texts_that_differ_late(spark, tmp_path):
    text = "q" * 5000
    rows = [(1, text), (2, text + "a"), (3, text + "b"), (4, text + "a"), (5, text[:64]), (6, text[:64]), (7, text[:65])]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(write_docs(spark, str(tmp_path / "d"), rows)).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (3, 1), 4: (2, 2), 5: (5, 2), 6: (5, 2), 7: (7, 1)}


def test_lines_match_sql(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "\n".join(["  Shared notice "] * (i % 3 > 0) + [prose(rng, 5), "", prose(rng, 4)] + ["Rare notice"] * (i < 3)), None if i % 7 == 0 else f"s{i % 9}") for i in range(60)]
    rows += [(100, None, "s1"), (101, "", "s2"), (102, "Shared notice\nShared notice", None)]
    write_docs(spark, str(tmp_path / "documents.parquet"), rows)
    done = line_dedup.remove_boilerplate(spark.read.parquet(str(tmp_path / "documents.parquet")), min_sites=5)
    got = {r.doc_id: (r.n_lines, r.n_removed, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in done.collect()}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = line_dedup.SQL.replace(f">= {line_dedup.MIN_SITES}", ">= 5")
    assert got == {r[0]: r[1:] for r in c.sql(sql).fetchall()}
    assert sum(n for _, n, _ in got.values()) > 30
    assert "lang" in done.columns and "gone" in done.columns


def test_lines_repeated_on_few_sites_go(spark, tmp_path):
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = [(i, "\n".join([prose(rng, 6), passage] if i < 6 else [prose(rng, 6)] + ["Twice on three"] * (i < 15)), f"s{i % 4 if i < 6 else i % 3}") for i in range(60)]
    write_docs(spark, str(tmp_path / "documents.parquet"), rows)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.query(spark, str(tmp_path)).collect()}
    assert all(got[i][1] == (1 if i < 6 else 0) for i in range(60))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == {r[0]: r[1:] for r in c.sql(line_dedup.SQL).fetchall()}


def test_bwt_and_common_prefixes_match_sorted_suffixes(tmp_path, monkeypatch):
    rng = random.Random(5)
    for _ in range(120):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9))]
        lengths = np.array([len(s) for s in strings], dtype=np.int64)
        filed = rng.random() < 0.5  # every round through files of 7 symbols
        monkeypatch.setattr(suffix_dedup, "IN_MEMORY", 3 if filed else 1 << 20)
        monkeypatch.setattr(suffix_dedup, "PART", 7)
        pieces = list(suffix_dedup.build(np.frombuffer(b"".join(strings), dtype=np.uint8), lengths, f"file://{tmp_path}/rounds" if filed else None))
        bwt, lcp, who, size = (np.concatenate(x) for x in zip(*pieces))
        assert not filed or len(pieces) > 1 or len(bwt) <= 7
        order = sorted(((i, j) for i in range(len(strings)) for j in range(len(strings[i]) + 1)), key=lambda t: ([(1, c) for c in strings[t[0]][len(strings[t[0]]) - t[1] :]] + [(0, t[0])]))
        assert order == list(zip(who.tolist(), size.tolist()))
        for k in range(1, len(order)):
            a, b = (strings[i][len(strings[i]) - j :] for i, j in order[k - 1 : k + 1])
            n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
            assert n == lcp[k]


def brute_spans(rows, span=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        key = float("inf") if d is None else d
        for i in range(len(b) - span + 1):
            s = b[i : i + span]
            first[s] = min(first.get(s, float("inf")), key)
    out = []
    for d, t in rows:
        b, key = (t or "").encode(), float("inf") if d is None else d
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < key:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeated_spans_match_brute_force(spark, tmp_path):
    rows = odd_docs(3)
    got = suffix_dedup.repeated_spans(write_docs(spark, str(tmp_path / "d"), rows)).collect()
    mine = Counter((r.doc_id, r.n_bytes, sum(r.spans[1::2]) - sum(r.spans[::2]), len(r.spans) // 2, r.kept_sha256) for r in got)
    assert mine == brute_spans(rows)


def test_spans_of_many_blocks_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "IN_MEMORY", 500)
    monkeypatch.setattr(suffix_dedup, "PART", 300)
    monkeypatch.setattr(suffix_dedup, "COLLECTION", 7)
    rng = random.Random(9)
    passages = [bytes(rng.choice(b"abcdefgh ") for _ in range(90)) for _ in range(12)]
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(5, 30))) + rng.choice(passages)[rng.randint(0, 20) :] + rng.choice(passages) for _ in range(60)]
    block = suffix_dedup.Block(np.arange(60), np.ones(60), np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), dtype=np.uint8))
    bucket, _, _, place = block.hashes(16)
    held, *_ = block.strings(np.ones(len(bucket), dtype=bool), place, bucket)
    strings = [block.b[block.first[r] : block.last[r] + suffix_dedup.SPAN].tobytes() for r in held]
    ids = np.array(rng.sample(range(len(strings)), len(strings)), dtype=np.int64)
    least = {}
    for s, d in zip(strings, ids.tolist()):
        for i in range(len(s) - 49):
            least[s[i : i + 50]] = min(least.get(s[i : i + 50], d), d)
    got = suffix_dedup.least_ids(strings, ids, f"file://{tmp_path}/rounds")
    assert (tmp_path / "rounds").is_dir() and not list((tmp_path / "rounds").iterdir())  # all went through files, and none is left
    monkeypatch.undo()
    assert all((a == b).all() for a, b in zip(got, suffix_dedup.least_ids(strings, ids)))
    assert all(least[strings[s][i : i + 50]] == v for s, a, z, v in zip(*got) for i in range(a, z + 1)) and len(least) < sum(len(s) - 49 for s in strings)


def runs_as_strings(texts):
    """The distinct strings of all runs of windows in texts."""
    block = suffix_dedup.Block(np.arange(len(texts)), np.ones(len(texts)), np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), dtype=np.uint8))
    bucket, _, _, place = block.hashes(16)
    held, *_ = block.strings(np.ones(len(bucket), dtype=bool), place, bucket)
    return [block.b[block.first[r] : block.last[r] + suffix_dedup.SPAN].tobytes() for r in held]


@pytest.mark.parametrize("seed", range(12))
def test_least_ids_of_periodic_texts_and_shared_parts(seed):
    """Windows that are left out of the transform are those that no other string holds, also where an anchor stands often."""
    rng = random.Random(seed)
    letters = b"abcdefghijkl"[: rng.choice([1, 2, 3, 12])]
    word = lambda n: bytes(rng.choice(letters) for _ in range(n))
    shared = [word(rng.randint(20, 75)) for _ in range(6)] + [word(rng.randint(1, 30)) * 40 for _ in range(6)]
    strings = runs_as_strings([word(rng.randint(0, 40)) + rng.choice(shared)[rng.randint(0, 9) :] + word(rng.randint(0, 40)) + rng.choice(shared) for _ in range(60)])
    ids = np.array(rng.sample(range(len(strings)), len(strings)), dtype=np.int64)
    least = {}
    for s, d in zip(strings, ids.tolist()):
        for i in range(len(s) - 49):
            least[s[i : i + 50]] = min(least.get(s[i : i + 50], d), d)
    got = {(s, i): v for s, a, z, v in zip(*suffix_dedup.least_ids(strings, ids)) for i in range(a, z + 1)}
    assert got == {(k, i): least[s[i : i + 50]] for k, s in enumerate(strings) for i in range(len(s) - 49)}


def test_strings_that_meet_by_chance_are_not_ordered(monkeypatch):
    rng = random.Random(4)
    word = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    phrases, passage, ordered, build = [word(40) for _ in range(5)], word(70), [], suffix_dedup.build
    monkeypatch.setattr(suffix_dedup, "build", lambda symbols, lengths, folder=None: ordered.append((len(lengths), len(symbols))) or build(symbols, lengths, folder))
    strings = runs_as_strings([word(60) + rng.choice(phrases) + word(60) for _ in range(300)])
    suffix_dedup.least_ids(strings, np.arange(len(strings)))
    assert not ordered  # 40 bytes in common, and so their anchors, but no window
    strings = runs_as_strings([word(60) + passage + word(60) for _ in range(50)])
    got = suffix_dedup.least_ids(strings, np.arange(len(strings)))
    assert 50 <= sum(n for n, _ in ordered) < len(strings) / 2 and len(got[0]) > len(strings)


def test_the_last_pass_reads_where_strings_stand(spark, tmp_path, monkeypatch):
    """Anchors are found twice, for hashes and for strings; the cut takes the places that were written with the strings."""
    from types import SimpleNamespace

    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0)))
    folder, text = f"file://{tmp_path}", prose(random.Random(8), 40)
    (sent,) = suffix_dedup._blocks(folder, 16)(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": [text, "x", text]})]))
    masks = pa.Table.from_batches([sent]).drop_columns(["hashes", "several"]).append_column("mask", pa.array([b"\xff" * len(h) for h in sent.column("hashes").to_pylist()]))
    asked = suffix_dedup._strings(folder, 16)(masks)
    answers = pa.concat_tables([suffix_dedup._answers(asked.slice(k, 1), folder) for k in range(asked.num_rows)])
    monkeypatch.setattr(suffix_dedup, "anchored_runs", None)
    cut = suffix_dedup._cut(folder)(masks.slice(0, 1).select(["block"]), answers).to_pydict()
    assert cut["doc_id"] == [1, 2, 3] and cut["spans"] == [[], [], [0, len(text)]]


def test_rows_between_blocks_and_buckets():
    """Each block sends a row to each bucket that it touches, so 6 GB of text make no more than 300,000."""
    total = 6 << 30
    assert total // suffix_dedup.BLOCK_BYTES * (total // suffix_dedup.BUCKET_BYTES) <= 300_000


def morse(n, a="a", b="b"):
    """Strings whose polynomial hashes modulo 2**64 are equal, from 1,024 characters on, when the letters change places."""
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_of_equal_hash_stay_apart(spark, tmp_path, n):
    rng = random.Random(n)
    tail = prose(rng, 30)
    rows = [(1, morse(n)), (2, morse(n, "b", "a")), (3, morse(n)), (4, f"{morse(n)} {tail}"), (5, f"{morse(n, 'b', 'a')} {tail}"), (6, f"{morse(n)} four more words"), (7, f"{morse(n, 'b', 'a')} four more words")]
    assert bag_minhash.word_hashes(rows[0][1])[0] == bag_minhash.word_hashes(rows[1][1])[0]
    got = bag_minhash.near_classes(write_docs(spark, str(tmp_path / "d"), rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == brute_classes(rows)


def test_strings_of_equal_hash_stay_apart(monkeypatch):
    """The removal of spans with a hash under which all strings of a block meet."""
    from steadfield.llm import hashing

    rng = random.Random(7)
    texts = [b"".join(rng.choice([b"alpha beta gamma delta epsilon zeta eta theta iota kappa ", b"one two three four five six seven eight nine ten eleven "]) for _ in range(3)) for _ in range(9)]
    blocks = lambda: suffix_dedup.Block(np.arange(9), np.ones(9), np.array([len(t) for t in texts]), np.frombuffer(b"".join(texts), dtype=np.uint8))
    found = []
    for hashed in (hashing.string_hashes, lambda b, s, e: np.zeros(len(s), dtype=np.uint64)):
        monkeypatch.setattr(hashing, "string_hashes", hashed)
        block = blocks()
        bucket, _, _, place = block.hashes(16)
        held, least, most, own = block.strings(np.ones(len(bucket), dtype=bool), place, bucket)
        text = lambda r: block.b[block.first[r] : block.last[r] + suffix_dedup.SPAN].tobytes()
        assert all(text(r) == text(held[own[r]]) for r in range(len(own)))
        found.append({text(h): (a, z) for h, a, z in zip(held, least, most)})
        assert len(found[-1]) == len(held)
    assert found[0] == found[1]


def test_the_last_doc_id_is_kept(spark, tmp_path):
    passage = prose(random.Random(3), 40)
    rows = [(1, passage), (2**63 - 1, passage + " tail"), (2**63 - 2, "x"), (None, passage), (None, "y")]
    got = suffix_dedup.repeated_spans(write_docs(spark, str(tmp_path / "d"), rows)).collect()
    assert sorted((repr(r.doc_id), len(r.spans) // 2) for r in got) == sorted([("1", 0), (repr(2**63 - 1), 1), (repr(2**63 - 2), 0), ("None", 1), ("None", 0)])


def words(text):
    return tuple(FOLD.sub(" ", text or "").split())


def multiset(text):
    w = words(text)
    return Counter(w[i : i + 5] for i in range(len(w) - 4))


def jaccard(a, b):
    common = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 0.0


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [multiset(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if words(rows[i][1]) == words(rows[j][1]) or jaccard(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return Counter((d, min(g, key=lambda x: (x is not None, x or 0)), len(g)) for g in groups.values() for d in g)


def test_near_classes_match_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = odd_docs(4)
    base = prose(rng, 200).split()
    for i in range(60):  # near copies at all distances from each other
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    docs = write_docs(spark, str(tmp_path / "d"), rows)
    got = bag_minhash.near_classes(docs)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got.collect()) == brute_classes(rows)
    kept = bag_minhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == got.select("class_uid").distinct().count()


def test_a_bucket_with_several_components_is_searched_in_blocks(spark, tmp_path, monkeypatch):
    import pandas as pd

    rng = random.Random(13)
    base = prose(rng, 150).split()
    texts = []
    for _ in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sigs, bands = [], []
    for t in texts:
        s = bag_minhash.signature(*bag_minhash.shingles(bag_minhash.word_hashes(t)))
        sigs.append((s & np.uint64(255)).astype(np.uint8).tobytes())
        bands.append(np.array([5] + list(range(len(bands) * 100, len(bands) * 100 + bag_minhash.BANDS - 1))))
    pdf = pd.DataFrame({"key": 5, "uid": range(30), "component": range(30), "sig": sigs, "bands": bands, "side": 2, "text": texts})
    found = bag_minhash._joined(pdf)
    sets = [multiset(t) for t in texts]
    parent = list(range(30))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v, j in found.itertuples(index=False):
        assert j >= 0.8 and abs(j - jaccard(sets[u], sets[v])) < 1e-12 and find(u) != find(v)
        parent[find(u)] = find(v)
    assert all(find(i) == find(j) for i in range(30) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8)


def test_signatures_estimate_weighted_jaccard_without_bias():
    rng = random.Random(3)
    off = []
    for _ in range(150):
        a = [rng.choice("abcdefghij") for _ in range(rng.choice([8, 60, 200]))] * rng.choice([1, 3])
        b = list(a)
        for _ in range(len(b) // 20 + 1):
            b[rng.randrange(len(b))] = rng.choice("abcdefghij")
        x, y = (bag_minhash.shingles(bag_minhash.word_hashes(" ".join(t))) for t in (a, b))
        off.append((bag_minhash.signature(*x) == bag_minhash.signature(*y)).mean() - bag_minhash.similarity(x, y))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (7, 9), (5, 5), (4, 20), (20, 21), (21, 22)], "u long, v long")
    assert {r.node: r.component for r in components.components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 21: 1, 22: 1, 7: 7, 8: 7, 9: 7}


@pytest.mark.parametrize("run", [exact_dedup.exact_groups, line_dedup.remove_boilerplate, suffix_dedup.repeated_spans, bag_minhash.near_classes, exact_dedup.drop_copies, bag_minhash.keep_one])
def test_empty_tables(spark, tmp_path, run):
    assert run(write_docs(spark, str(tmp_path / "d"), [])).count() == 0
