import numpy as np
import pytest

from tesselon.llm import line_dedup as L


def brute(rows, least=20, min_docs=3):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    docs = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= least:
                docs.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [d is not None and len(docs.get(key(x), ())) >= min_docs and max(docs[key(x)]) != d for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=str)


LONG = "This line is long enough to count"
ROWS = [
    (1, f"a\n{LONG}\nb"),
    (2, f"{LONG.upper()}\n  {LONG}\t"),
    (3, f"c\n{LONG} \n{LONG}\nd"),
    (4, "short line\nshort line"),
    (5, "short line"),
    (6, "short line"),
    (7, None),
    (8, ""),
    (9, "\n\n"),
    (10, "ÄÖÜ é ñ ßtraße einundzwanzig\nx"),
    (11, "ÄÖÜ é ñ ßtraße einundzwanzig\ny"),
    (12, "äöü é ñ ßtraße einundzwanzig"),
    (13, "ÄÖÜ é ñ ßtraße einundzwanzig"),
    (13, "ÄÖÜ é ñ ßtraße einundzwanzig"),
    (14, "exactly twenty chars\nnineteen characters"),
    (15, "exactly twenty chars\nnineteen characters"),
    (16, "EXACTLY twenty chars\nnineteen characters"),
    (17, "éééééééééééééééééééé"),
    (18, "éééééééééééééééééééé"),
    (19, "éééééééééééééééééééé"),
    (20, "ééééééééééééééééééé\nééééééééééééééééééé"),
    (21, "ééééééééééééééééééé"),
    (22, "ééééééééééééééééééé"),
    (None, f"{LONG}\nz"),
]


@pytest.mark.parametrize("send", [L.SEND_BYTES, -1])
def test_against_brute_force(documents, send):
    out = L.drop_lines(documents(*ROWS), send_bytes=send)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()), key=str) == brute(ROWS)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "value", "n_lines", "n_dropped"}


@pytest.mark.parametrize("send", [L.SEND_BYTES, -1])
def test_empty_table(documents, send):
    assert L.drop_lines(documents((1, "a")).limit(0), send_bytes=send).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 20000):
        h = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        f = rng.integers(0, 1 << 63, len(h)).astype(np.uint64)
        s = L.Shard(L.build_shard(h, f, np.arange(len(h)), -np.arange(len(h))))
        assert sorted(s.slots(h).tolist()) == list(range(len(h)))
        found, count, last = s.probe(h, f)
        assert found.all() and (count == np.arange(len(h))).all() and (last == -np.arange(len(h))).all()
        assert not s.probe(h, f + np.uint64(1))[0].any()
        assert not s.probe(rng.integers(0, 1 << 63, 50).astype(np.uint64), np.zeros(50, np.uint64))[0].any()


def test_keys_of_one_hash_are_told_apart(documents, monkeypatch):
    whole = L.hashes
    monkeypatch.setattr(L, "hashes", lambda key: (whole(key)[0] % 3, whole(key)[1]))
    h, f = np.array([7, 7, 9], np.uint64), np.array([1, 2, 3], np.uint64)
    shard = L.Shard(L.build_shard(h, f, np.array([3, 4, 5]), np.array([10, 20, 30])))
    found, count, last = shard.probe(np.array([7, 7, 9, 7], np.uint64), np.array([2, 1, 3, 5], np.uint64))
    assert found.tolist() == [True, True, True, False] and count[:3].tolist() == [4, 3, 5] and last[:3].tolist() == [20, 10, 30]


@pytest.mark.parametrize("send", [L.SEND_BYTES, -1])
def test_clashing_names_and_a_very_long_text(documents, send):
    from pyspark.sql import functions as F

    long_text = "\n".join(f"line number {i % 5000} of a long text" for i in range(20_000))
    rows = [*ROWS, (30, long_text), (31, long_text)]
    docs = documents(*rows).withColumns({c: F.lit("mine") for c in ("__gone", "gone", "gone_", "h", "f", "doc", "shard", "salt", "payload", "column0")})
    out = L.drop_lines(docs, min_docs=2, send_bytes=send).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out), key=str) == brute(rows, min_docs=2)
    assert all(r["__gone"] == r["gone"] == r["doc"] == r["salt"] == "mine" for r in out)


def test_packs_are_bounded(documents, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 1)
    monkeypatch.setattr(L, "HELD", 5)
    monkeypatch.setattr(L, "PACK", 2)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in L.drop_lines(documents(*ROWS), send_bytes=-1).collect()), key=str) == brute(ROWS)
