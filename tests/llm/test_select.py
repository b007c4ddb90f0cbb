import random
import zlib

import numpy as np
import pytest
from helpers import odd_docs, prose, write_docs

from pyspark.sql import functions as F

from steadfield.llm import hnsw, html_wrappers, mixing, quality


def share_by_bisection(sizes, weights, total, limit=2.0):
    """Targets by a plain search for the unit at which all of total is given out."""
    give = lambda unit: [min(unit * w, limit * s) if s else 0.0 for s, w in zip(sizes, weights)]
    low, high = 0.0, limit * max([*sizes, 1.0]) / min(weights)
    for _ in range(200):
        low, high = ((low + high) / 2, high) if sum(give((low + high) / 2)) < total else (low, (low + high) / 2)
    return give(high)


@pytest.mark.parametrize("sizes, share", [([100, 100, 0, 800], 1.5), ([5], 1.5), ([0, 0], 1.5), ([7, 1, 1, 1, 90, 3, 2000, 4, 4, 50], 1.5), ([10, 20, 30], 2.0), ([10, 20, 30], 5.0), ([1000, 1, 1], 0.01)])
def test_targets_match_a_search(spark, sizes, share):
    rows = spark.createDataFrame(list(enumerate(sizes)), "no long, source_size long")
    got = [r.target for r in mixing.share_out(rows, mixing.WEIGHTS, share).orderBy("no").collect()]
    want = share_by_bisection([float(s) for s in sizes], [mixing.WEIGHTS[i % 3] for i in range(len(sizes))], share * sum(sizes))
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9) and all(t <= 2 * s for t, s in zip(got, sizes))


def test_sources_are_numbered_by_code_point(spark):
    names = [None, "b", "a", "\U00010000", "\uffff", "", "é", *(f"s{i}" for i in range(50))]
    got = mixing.numbered(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(5)).collect()
    want = [*sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n]), None]
    assert [r.source for r in sorted(got, key=lambda r: r.no)] == want and sorted(r.no for r in got) == list(range(len(names)))


def test_flight_keeps_totals_and_probabilities():
    rng, total = random.Random(1), np.zeros(40)
    sizes = [float(rng.randint(0, 500)) for _ in range(40)]
    for k in range(400):
        p = [0.3] * 40
        held = mixing.flight(p, sizes, random.Random(k))
        assert len(held) <= 2 and abs(sum(p) - 12) < 1e-6 and abs(sum(a * b for a, b in zip(p, sizes)) - 0.3 * sum(sizes)) < 1e-4
        mixing.land(p, sizes, held)
        assert set(p) <= {0.0, 1.0} and abs(sum(a * b for a, b in zip(p, sizes)) - 0.3 * sum(sizes)) <= max(sizes)
        total += p
    assert abs(total / 400 - 0.3).max() < 0.12


def test_mix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 60)), ["a", "b", "c", None, "é"][i % 5 if i % 3 else 0]) for i in range(300)] + [(500, None, "z"), (501, "", "z"), (9, "again and again", "a")]
    rows += [(700, "the same row " * 9, "c")] * 41 + [(None, "no name of its own", "a")] * 5
    docs = write_docs(spark, str(tmp_path / "d"), rows)
    got = mixing.mix(docs).collect()
    plain = lambda mixed: sorted(map(repr, mixed.drop("uid").collect()))
    assert len(got) == len(rows) and plain(mixing.mix(docs)) == plain(mixing.mix(write_docs(spark, str(tmp_path / "e"), rows[::-1], 5)))
    names = sorted({r[2] for r in rows if r[2]}) + [None]
    size = {n: sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names}
    targets = dict(zip(names, share_by_bisection([float(size[n]) for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(size.values()))))
    same = [r.copies for r in got if r.doc_id == 700]
    assert len(same) == 41 and max(same) - min(same) <= 1
    source = {r[0]: r[2] for r in rows}
    for n in names:
        mine = [r for r in got if source[r.doc_id] == n]
        assert {r.source_size for r in mine} == {size[n]} and all(abs(r.target - targets[n]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - targets[n]) <= max([r.size for r in mine] + [0]) and all(r.taken in (0, r.size, 2 * r.size) for r in mine)
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in got)


def pages():
    def page(i, n, extra=""):
        links = "".join(f'<li><a href="/{k}">menu{k}</a></li>' for k in range(i % 4 + 1))
        body = "".join(f"<p>Para {i}.{k} &amp; more   text</p>" if k % 2 else f"<p><b>Bold {k}<br>line" for k in range(n))
        return f'<!DOCTYPE html><html><head><title>T{i}</title><script>var a="</p>"</script></head><body><nav><ul>{links}</ul></nav><!-- c --><div class="ad">Buy</div><article><h1>Head {i}</h1>{body}{extra}</article><aside>side</aside><footer>foot</footer></body></html>'

    rows = [(i, f"http://h{i % 2}.example.com/{i}", page(i, i % 5)) for i in range(24)]
    rows += [(100, None, page(1, 2)), (101, "http://h0.example.com/x", None), (102, "::bad::[", ""), (103, "http://h0.example.com/y", "<p>only text<p>two <form>no</form>"), (104, "http://h1.example.com/z", page(9, 2, '<div class="comments"><p>me too</p></div>'))]
    return rows


def expected(i, n):
    out = [f"Head {i}"]
    for k in range(n):
        out.append(f"Para {i}.{k} & more text" if k % 2 else f"Bold {k} line")
    return "\n".join(out)


def test_main_text(spark):
    rows = pages() + [pages()[0]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_wrappers.extract_main_text(df).collect()}
    assert html_wrappers.extract_main_text(df).count() == len(rows)
    for i in range(24):
        assert got[i].text == expected(i, i % 5) and got[i].n_chars == len(got[i].text)
    assert got[100].text == expected(1, 2) and got[101].text == "" and got[102].text == "" and got[103].text == "only text\ntwo" and got[104].text == expected(9, 2)
    assert html_wrappers.extract_main_text(df.limit(0)).count() == 0


def test_texts_that_are_the_same_over_a_host_are_template(spark):
    """In a box that no list names; a passage on few pages, a page's copies and a host of near copies keep theirs."""
    box = '<div class="x9"><p>All rights with the river club.</p></div>'
    varied = [f"<html><body><div><h1>Head {i}</h1><p>{'word%d ' % i * (5 + i)}</p>{'<p>Told twice.</p>' if i < 2 else ''}{box}</div></body></html>" for i in range(8)]
    near = [f"<html><body><div><p>Seen {i}</p><p>{'the same long text ' * 9}</p><p>End.</p></div></body></html>" for i in range(8)]
    rows = [(i, "http://a.example/", h) for i, h in enumerate(varied)] + [(50 + i, "http://b.example/", h) for i, h in enumerate(near)]
    rows += [(80 + i, "http://c.example/", varied[0]) for i in range(6)] + [(90, "http://d.example/", varied[1])]
    got = {r.page_id: r.text for r in html_wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"Head {i}" in got[i] and f"word{i}" in got[i] and "river club" not in got[i] for i in range(8))
    assert "Told twice." in got[0] and "Told twice." in got[1]
    assert all("same long text" in got[50 + i] and "End." in got[50 + i] for i in range(8))
    assert all("river club" in got[i] for i in (80, 85, 90))


def made_host(rng, k, named):
    """Pages of a generated template, with the main text that went into each. Boxes have neutral names or none."""
    box = lambda n, inside: f'<div class="{"qrstuvwxyz"[n]}{k}">{inside}</div>' if named else f"<div>{inside}</div>"
    menu, club, rights = prose(rng, 3), prose(rng, 5), f"Rights {prose(rng, 3)} {k}"
    rows = []
    for i in range(12):
        paras = [f"{prose(rng, rng.randint(12, 40))} {i}.{j}" for j in range(rng.randint(1, 5))]
        head = f"{prose(rng, 3)} {i}"
        story = f"<h2>{head}</h2>" + "".join(f"<p>{x}</p>" for x in paras)
        links = "".join(f'<p><a href="/{j}">{prose(rng, 2)} {i}</a></p>' for j in range(rng.randint(1, 3)))
        extra = box(5, club) if rng.random() < 0.8 else ""
        rows.append((f"<html><body>{box(0, menu)}{box(1, links) if named else ''}{extra}{box(2, story)}{box(3, rights)}</body></html>", "\n".join([head, *paras])))
    return rows


@pytest.mark.parametrize("named", [True, False])
def test_main_text_of_generated_templates(spark, named):
    """No box has a name that a list knows: what varies over the host and holds the most text is the story."""
    rng = random.Random(21)
    made = [(100 * k + i, f"http://n{k}.example/{i}", h, t) for k in range(5) for i, (h, t) in enumerate(made_host(rng, k, named))]
    got = {r.page_id: r.text for r in html_wrappers.extract_main_text(spark.createDataFrame([m[:3] for m in made], "page_id long, url string, html string")).collect()}
    assert [(i, got[i]) for i, _, _, t in made if got[i] != t] == []
    alone = html_wrappers.Page(made[0][2], None)
    assert "\n".join(b[3] for b in alone.blocks if b[1]) != made[0][3]  # the page by itself can't tell


def test_alignment_and_repeats_of_any_length():
    rng = random.Random(4)

    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        return best[0][0]

    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 25))] for _ in range(2))
        got = list(html_wrappers._common(a, b))
        assert len(got) == plain(a, b) and all(a[i] == b[j] for i, j in got) and got == sorted(got) and len({j for _, j in got}) == len(got)
    a, b = ([rng.randrange(300) for _ in range(6000)] for _ in range(2))
    assert len(list(html_wrappers._common(a, b))) > 500
    period = [f"<x{i}" for i in range(90)]
    assert html_wrappers.fold(["<a", *period * 3, "<b"]) == ["<a", ["+", period], "<b"]


def test_wrappers_accept_the_pages_they_come_from():
    streams = [html_wrappers.skeleton(html_wrappers.tokenize(r[2] or "")[0]) for r in pages()[:24]]
    wrapper = streams[0]
    for s in streams[1:]:
        wrapper = html_wrappers.align(wrapper, s)
    w = html_wrappers.Wrapper(wrapper)
    accepted = [w.filled(html_wrappers.tokenize(r[2])[0]) is not None for r in pages()[:24]]
    assert all(accepted)
    assert html_wrappers.fold(["<p", "#p", "</p"] * 3) == [["+", ["<p", "#p", "</p"]]]


def test_quality_on_held_out_rows(spark, tmp_path):
    rng = random.Random(6)
    good = [prose(rng, rng.randint(30, 90)) for _ in range(300)]
    bad = ["!!! ".join(prose(rng, rng.randint(30, 60)).upper().split()) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, ""), (None, "some words"), (3, good[3])]
    docs = write_docs(spark, str(tmp_path / "d"), rows)
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(450)] + [(5, 1), (None, 0), (7, None)], "doc_id long, quality int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 450 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id < 300) for r in held]) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    nothing = quality.score(docs, labels.limit(0)).collect()
    assert {round(r.score, 9) for r in nothing} == {0.5}
    assert quality.score(docs.limit(0), labels).count() == 0


def brute(vectors, queries, k):
    out = {}
    ids = np.array(sorted(vectors))
    m = np.array([vectors[i] for i in ids])
    for q in queries:
        s = m @ vectors[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [int(ids[i]) for i in order]
    return out


def test_nearest_beside_long_vectors(spark):
    """A few vectors of lengths far beyond the rest don't blur the others, and are found themselves."""
    rng = np.random.default_rng(8)
    m = rng.standard_normal((1500, 24))
    m /= np.linalg.norm(m, axis=1)[:, None]
    m[7] *= 1e4
    m[8] *= 1e160
    m[9] *= 3e160
    vectors = {i: m[i] for i in range(len(m))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, v array<double>")
    asked = [8, *range(0, 1500, 30)]
    got = {}
    for r in hnsw.nearest(df, df.filter(F.col("vec_id").isin(asked)).withColumnRenamed("vec_id", "query_id"), 20).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    want = brute(vectors, [q for q in asked if q != 8], 20)
    recall = [len(set(got[q].values()) & set(want[q])) / 20 for q in want]
    assert np.mean(recall) > 0.9, np.mean(recall)
    for q in want:
        if m[9] @ m[q] > 0:
            assert got[q][1 if m[8] @ m[q] < m[9] @ m[q] else 2] == 9
    if m[8] @ (m[9] / 3e160) > 0:
        assert got[8][1] == 9


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 300)
    rng = np.random.default_rng(5)
    m = np.round(rng.standard_normal((900, 12)) * rng.uniform(0.5, 2, (900, 1)), 6)
    m[100:160] = m[100]
    vectors = {i: m[i] for i in range(900)}
    odd = [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] * 12), (2060, [1.0, 2.0]), (2080, []), (None, [1.0] * 12)]
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in vectors.items()] + [(0, m[0].tolist(), "clash")] + [(i, v, "clash") for i, v in odd], "vec_id long, v array<double>, members string")
    queries = df.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in sorted(hnsw.nearest(df, queries).collect(), key=lambda r: (r.query_id, r.rank)):
        assert abs(r.score - float(m[r.query_id] @ m[r.vec_id])) < 1e-9
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(vectors, [q for q in vectors if q % 20 == 0], 20)
    assert got.keys() == want.keys() and all(len(v) == 20 and q not in v for q, v in got.items())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) > 0.95
    assert got[120] == want[120]  # ties among equal vectors go to the smaller ids
    few = df.filter("vec_id < 3")
    assert hnsw.nearest(few, few.withColumnRenamed("vec_id", "query_id").filter("query_id = 0").limit(1)).count() == 2
    assert hnsw.nearest(df.limit(0), queries.limit(0)).count() == 0


def test_odd_documents_mix(spark, tmp_path):
    docs = write_docs(spark, str(tmp_path / "d"), odd_docs())
    assert mixing.mix(docs).count() == len(odd_docs())
    assert mixing.mix(write_docs(spark, str(tmp_path / "e"), [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_graphs_of_few_points(n):
    p = np.random.default_rng(1).standard_normal((n, 5)).astype(np.float32)
    if n:
        ids, _ = hnsw.Graph.build(p).search(p, 8)
        assert (ids[:, 0] >= 0).all() and {i for i in ids.ravel().tolist() if i >= 0} == set(range(n)) if n < 8 else True


def test_the_mix_does_not_depend_on_the_layout(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(0, 40)), f"s{i % 3}") for i in range(150)]
    one, other = write_docs(spark, str(tmp_path / "a"), rows, 1), write_docs(spark, str(tmp_path / "b"), rows[::-1], 7)
    pick = lambda d: sorted((r.doc_id, r.taken) for r in mixing.mix(d).collect())
    assert pick(one) == pick(other)
