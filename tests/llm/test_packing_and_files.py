import uuid
import zlib

import numpy as np
import pytest

from tesselon.llm import common, packing, token_files, tokens

TEXTS = ["The anhely eran, it's a test.", "", None, "Ça va été ßtraße 12,3.5 !!", "a\x1cb  c　d\x85e", "<|endoftext|> x <|STARTOFTEXT|>", "İstanbul ΑΣ ﬁ \U0001f600 ab​c", " ".join(f"word{i}" for i in range(3000)), "and. and, AND.. (and)"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_path())
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(plain):
    e = tokens.Encoder(tokens.default_path())
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in e.encode([None if t is None else t.encode() for t in TEXTS])]
        assert got == [plain(t) for t in TEXTS]


def test_pieces(documents, plain):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(50, TEXTS[0]), (50, TEXTS[0]), (None, "x")]
    pieces = packing.pack(documents(*rows)).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and all(p.offset == 0 and p.length & (p.length - 1) == 0 and p.length <= 2048 and len(p.ids) == 4 * p.length and 1 << p.bucket == p.length for p in pieces)
    for d, t in rows[: len(TEXTS)]:
        mine = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
        ids = [i for p in mine for i in np.frombuffer(p.ids, "<u4").tolist()]
        assert ids == [*plain(t), 1] and all(p.doc_tokens == len(ids) for p in mine)
        assert [p.start for p in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))]
    assert sum(p.length for p in pieces if p.doc_id == 50) == 2 * (len(plain(TEXTS[0])) + 1)
    assert packing.pack(documents((1, "a")).limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(documents((1, "a")), longest=100)
    assert packing.cuts(4101, 2048) == [2048, 2048, 4, 1]


def test_op5_digest(spark):
    r = packing.op5_packing(spark, "/root/testdata/sf0.001").collect()
    p = {(x.doc_id, x.start): bytes(x.ids) for x in packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert len(r) == len(p) and all(zlib.crc32(p[x.doc_id, x.start]) == x.ids_crc32 for x in r)


def test_codes_give_any_id():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 256, 2000), rng.integers(0, 1 << 20, 3000), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype(np.uint32)
    rng.shuffle(ids)
    s = token_files.Segment(token_files.encode_segment([1, None], [2000, len(ids) - 2000], ids))
    assert (s.all() == ids).all() and s.doc_ids == [1, None]
    assert all(s[i] == ids[i] for i in range(0, len(ids), 7))
    with pytest.raises(IndexError):
        s[len(ids)]
    with pytest.raises(ValueError):
        token_files.Segment(b"XXXX" + bytes(40))


def test_files_round_trip(documents, spark, plain, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 40)
    rows = [(k * 7 % 20, t) for k, t in enumerate(TEXTS * 2)] + [(None, "y"), (3, "z")]
    path = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(documents(*rows), path)
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*plain(t), 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got] == want


def test_empty_file(documents, spark):
    path = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(documents((1, "a")).limit(0), path)
    assert token_files.read_tokens(spark, path).count() == 0


def test_token_at_reads_one_id(documents, spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 30)
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    path = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(documents(*rows), path)
    ids = [i for r in token_files.read_tokens(spark, path).orderBy("start").collect() for i in np.frombuffer(bytes(r.ids), "<u4").tolist()]
    for at in (0, 1, 29, 30, 31, len(ids) // 2, len(ids) - 1):
        assert token_files.token_at(spark, path, at) == ids[at]
    with pytest.raises(IndexError):
        token_files.token_at(spark, path, len(ids))


def test_fuzz_against_the_library(plain):
    import random

    e, rng = tokens.Encoder(tokens.default_path()), random.Random(3)
    assert e.cut and e.lowers and e.direct
    pool = list("abzAZIYi.,' !?0129-_<>|=\n\t") + ["'s", "'ll", "\u0307", "\u030a", "\u0338", "\u0345", "\u0130", "\u0131", "\u00df", "\u00e9", "\u0301", "\u00c9", "\u1e99", "\u00b5", "\u00aa", "\u03a3", "\u212b", "\u2126", "\u00a0", "\u3000", "\u0085", "\x1c", "\u1112", "\u1161", "\u0958", "\ufb01", "\u200d", "\U0001f600", "\u1fb3", "\u01e8", "\u212a"]
    latin = [chr(c) for c in range(0x20, 0x100)] + ["a", "b", " "] * 20
    for k in range(100_000):
        text = "".join(rng.choice(latin if k % 3 == 0 else pool) for _ in range(rng.randrange(1, 12)))
        assert np.frombuffer(e.encode([text.encode()])[0], "<u4").tolist() == plain(text), repr(text)


def test_a_vocabulary_that_keeps_spaces_is_never_cut(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    assert not tokens.Encoder(path).cut
    text = "Some words,  and\nmore words."
    got = packing.pack(documents((1, text)), tokenizer=path).collect()
    ids = [i for p in sorted(got, key=lambda p: p.start) for i in np.frombuffer(p.ids, "<u4").tolist()]
    assert ids == [*tok.encode(text, add_special_tokens=False).ids, 1]
