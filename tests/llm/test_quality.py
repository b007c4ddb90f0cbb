"""Quality scores against a plain version, and their accuracy on rows that were held out."""

import os
import zlib

import numpy as np
import pytest
import zstandard

from steadfield.llm import quality


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_accuracy_on_the_tables(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [r for r in quality.query(spark, "/root/testdata/sf0.1").collect() if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = ([r.score for r in got if labels[r.doc_id] == q] for q in (1, 0))
    assert len(good) > 500 and len(bad) > 100, (len(good), len(bad))
    above = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert above >= 0.995, above
    assert np.mean([r.predicted == labels[r.doc_id] for r in got]) >= 0.98


def test_scores_against_a_plain_version(spark):
    """The same dictionaries and calibration, applied text by text with the library itself."""
    rng = np.random.default_rng(5)
    words = {1: "river stone cloud amber winter signal copper garden".split(), 0: "CLICK!! buy### $$$ win*** now%%% free&&&".split()}
    rows = [(i, " ".join(rng.choice(words[i % 2], rng.integers(3, 120))), i % 2) for i in range(400)] + [(900, None, None), (901, "", None), (902, "é漢🙂 " * 3000, None)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(d, q) for d, _, q in rows if q is not None], "doc_id long, quality int")
    (bad, good), calibration = quality.fit(docs, labels)
    learnt = {d: t for d, t, q in rows if q is not None and zlib.crc32(str(d).encode()) % 5 not in (0, 4)}
    assert all(t.encode() in good or t.encode() in bad or len(t) < quality.SHORTEST for t in learnt.values())  # all of them fit

    def size(content, text):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d).compress((text or "").encode()))

    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    for d, t, _ in rows:
        b, g, n = size(bad, t), size(good, t), len((t or "").encode())
        f = np.clip([(b - g) / (n + 32), min(b, g) / (n + 32), np.log(n + 32)], calibration.low, calibration.high)
        x = np.array([1, *f, f[1] ** 2, f[1] * f[2], f[2] ** 2, f[0] * f[2]])
        want = 1 / (1 + np.exp(-np.clip(((x - calibration.mean) / calibration.scale) @ calibration.weights, -30, 30)))
        assert got[d].score == pytest.approx(want, abs=1e-9) and got[d].predicted == int(got[d].score >= 0.3)
    held = [d for d, _, q in rows if q is not None and zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([got[d].predicted == d % 2 for d in held]) >= 0.97
