import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import prose

FOLD = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture
def sf_dir(spark, tmp_path):
    rng = random.Random(8)
    good = [prose(rng, rng.randint(40, 90)) for _ in range(160)]
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(200 + i, "!!! ".join(prose(rng, 50).upper().split())) for i in range(80)]
    rows += [(300 + i, good[i]) for i in range(20)] + [(400 + i, good[50 + i] + " extra") for i in range(10)] + [(500, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "en", f"s{d % 4}", len(t or "")) for d, t in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 160)) for i in [*range(160), *range(200, 280)]], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_match_brute_force(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, text = docs.columns, {}
    for (_, stage), check in zip(cp.STAGES, (quality_, exact_, near_, mix_, tokens_)):
        before = docs.collect()
        out = f"{sf_dir}/after-{check.__name__}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        after = docs.collect()
        if check is not tokens_:
            assert docs.columns == columns
        check(before, after)
        text.update({r.doc_id: r.text for r in before})
    ran = cp.run(spark, sf_dir)
    assert Counter((r.doc_id, r.ids_sha256) for r in ran.collect()) == Counter((r.doc_id, r.ids_sha256) for r in after)


def quality_(before, after):
    kept = {r.doc_id for r in after}
    assert sum(d in kept for d in range(160)) >= 156 and sum(d in kept for d in range(200, 280)) <= 3


def exact_(before, after):
    groups = defaultdict(list)
    for r in before:
        groups[FOLD.sub(" ", r.text or "")].append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(min(g) for g in groups.values())


def near_(before, after):
    kept = {r.doc_id for r in after}
    assert not any(400 + i in kept and 50 + i in kept for i in range(10))
    assert all(d in kept for d in (r.doc_id for r in before) if d < 160)


def mix_(before, after):
    copies, size = Counter(r.doc_id for r in after), {r.doc_id: len((r.text or "").split()) for r in before}
    assert max(copies.values()) <= 2 and copies.keys() <= size.keys()
    assert abs(sum(size[d] * n for d, n in copies.items()) - 1.5 * sum(size.values())) <= 4 * max(size.values())


def tokens_(before, after):
    import hashlib

    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r.doc_id, digest(r.text)) for r in before) == Counter((r.doc_id, r.decoded_sha256) for r in after)


@pytest.mark.parametrize("rows", [[], [(1, None)], "odd"], ids=["empty", "null", "odd"])
def test_odd_inputs(spark, tmp_path, rows):
    """No labels, no documents, nulls, very long and repeated texts, columns whose names the operators use themselves."""
    import corpus_pipeline as cp
    from helpers import odd_docs, write_docs

    rows = odd_docs() + [(7000, "word " * 60_000), (7000, "word " * 60_000)] if rows == "odd" else rows
    write_docs(spark, f"{tmp_path}/documents.parquet", rows)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), Counter((r[0], r[1]) for r in rows)
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
            out.write.parquet(f"{tmp_path}/after-{k}")
            docs = spark.read.parquet(f"{tmp_path}/after-{k}")
            after = Counter((r.doc_id, r.text) for r in docs.collect())
            assert after.keys() <= kept.keys(), name
            if k == 0:
                assert after == kept, name  # without labels nothing is rejected
            if k == 1:
                assert len({FOLD.sub(" ", t or "") for _, t in after.elements()}) == after.total()
            kept = after
        else:
            tokens_(docs.collect(), out.collect())
    assert Counter(r.doc_id for r in cp.run(spark, str(tmp_path)).collect()) == Counter(d for d, _ in kept.elements())
