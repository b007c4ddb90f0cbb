import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import odd_docs, write_docs

from steadfield.llm import byte_bpe, token_files

JSON, RANKS = public_tokenizers.path(token_files.VOCABULARY), public_tokenizers.path(byte_bpe.VOCABULARY)
ALPHABET = " \n\t\x1c\x85\xa0　abcDEéñß12.,!'s漢字🙂\x00́\x7f"


def strings(n=1500):
    rng = random.Random(1)
    some = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return some + ["", "a", " ", "\n", "\nab cd\nef ", "x y.", "don't, we'll.", "a<|endoftext|>b", "words. and, words. and, words."]


def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_that_of_the_ranks():
    b, own = byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN), reference()
    for s, ids in zip(strings(), b.encode(strings())):
        assert ids.tolist() == own.encode_ordinary(s) and b.decode(ids) == s.encode()


def test_file_encoder_is_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    for s, got in zip(strings(), token_files.encoder(JSON, 2, 2)(strings())):
        assert np.frombuffer(got, "<u2").tolist() == t.encode(s, add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_pieces_of_equal_hash_stay_apart(n):
    """Strings whose polynomial hashes modulo 2**64 are equal, in one group."""
    from tokenizers import Tokenizer

    morse = lambda a, b: "".join((a, b)[bin(i).count("1") & 1] for i in range(n))
    texts = [morse("a", "b"), morse("b", "a"), "x " + morse("a", "b"), "x " + morse("b", "a"), morse("a", "b")]
    own, t = reference(), Tokenizer.from_file(JSON)
    b = byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
    assert [i.tolist() for i in b.encode(texts)] == [own.encode_ordinary(x) for x in texts]
    assert [np.frombuffer(g, "<u2").tolist() for g in token_files.encoder(JSON, 2, 2)(texts)] == [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]


@pytest.mark.parametrize("forced", [False, True])
def test_distinct_strings(monkeypatch, forced):
    from steadfield.llm import hashing

    if forced:  # every hash meets every other
        monkeypatch.setattr(hashing, "string_hashes", lambda b, s, e: np.zeros(len(s), dtype=np.uint64))
    rng = random.Random(2)
    for alphabet in (b"a", b"ab\0"):
        for _ in range(60):
            w = [bytes(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(rng.randint(0, 60))]
            length = np.array([len(x) for x in w], dtype=np.int64)
            end = np.cumsum(length)
            which, some = hashing.distinct(np.frombuffer(b"".join(w), dtype=np.uint8), end - length, end)
            assert [w[some[k]] for k in which] == w and len(some) == len(set(w))


def test_cache_generations():
    b, own = byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN), reference()
    b._cached.most, b._cached.group = 5, 30
    texts = strings(200) * 2
    assert [i.tolist() for i in b.encode(texts)] == [own.encode_ordinary(s) for s in texts]


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [7, 7, 9], list(range(600)), sorted(random.Random(4).choices(range(10**6), k=3000))])
def test_elias_fano(values):
    e = token_files.EliasFano.of(np.array(values, dtype=np.uint64))
    data = e.to_bytes()
    back, end = token_files.EliasFano.read(memoryview(data), 0)
    assert end == len(data) and back.all().tolist() == values and [back.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        back.select(len(values))


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, t = odd_docs(), Tokenizer.from_file(JSON)
    docs = write_docs(spark, str(tmp_path / "d"), rows)
    files = token_files.write_files(docs, f"file://{tmp_path}/files", JSON, shard_tokens=500)
    got = token_files.read_files(files).collect()
    want, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    path = files.first().path.removeprefix("file://")
    shard = token_files.Shard(open(path, "rb").read())
    assert shard.document(0)[-1] == 2 and len(shard.doc_ids()) == shard.ends.n


def test_digests(spark, tmp_path):
    rows, own = odd_docs(), reference()
    docs = write_docs(spark, str(tmp_path / "d"), rows)
    want = sorted((repr(d), len(ids := own.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    got = sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode_digests(docs, RANKS, public_tokenizers.PATTERN).collect())
    assert got == want
    kept = byte_bpe.with_tokens(docs, ["doc_id", "uid"], RANKS, public_tokenizers.PATTERN)
    assert kept.columns[:2] == ["doc_id", "uid"] and all(len(r.ids) == r.n_tokens for r in kept.collect())


def test_empty_tables(spark, tmp_path):
    docs = write_docs(spark, str(tmp_path / "d"), [])
    assert token_files.read_files(token_files.write_files(docs, f"file://{tmp_path}/files", JSON)).count() == 0
    assert byte_bpe.encode_digests(docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_ranks_must_be_whole(tmp_path):
    (tmp_path / "r").write_bytes(base64.b64encode(b"a") + b" 0\n" + base64.b64encode(b"b") + b" 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(tmp_path / "r"))


def test_select_many():
    rng = np.random.default_rng(3)
    for n, top in ((1, 5), (700, 3), (5000, 900), (3000, 10**9)):
        v = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
        ef, _ = token_files.EliasFano.read(memoryview(token_files.EliasFano.of(v).to_bytes()), 0)
        assert (ef.select_many(np.arange(n)) == v).all() and (ef.all() == v).all()
        some = np.sort(rng.choice(n, min(n, 60), replace=False))
        assert (ef.select_many(some) == v[some]).all() and [ef.select(int(i)) for i in some] == v[some].tolist()
        assert len(ef.select_many(np.empty(0, dtype=np.int64))) == 0
        with pytest.raises(IndexError):
            ef.select_many(np.array([n]))
