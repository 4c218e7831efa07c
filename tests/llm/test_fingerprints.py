import hashlib
import random

import numpy as np
from brute import fingerprint, phrase_levels, print_likeness
from pyspark.sql import functions as F

from sparsewright.llm.fingerprints import fingerprint_documents, fingerprints, from_text, likeness, parse, to_text


def _wanted(rows):
    """{id: (n_chars, digest of the edited text, text, edited, next)}; unique ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, nxt)
    return out


def _hex(names):
    return b"".join(x.to_bytes(8, "big") for x in names).hex()


def _check(docs, **options):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = _wanted(rows)
    found = {r["doc_id"]: r for r in fingerprint_documents(docs, **options).collect()}
    assert found.keys() == want.keys()
    for i, (n, digest, text, edited, nxt) in want.items():
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, digest)
        if len(text) < 6000:  # the plain version takes its time
            own, other, after = (fingerprint(x.encode()) for x in (text, edited, nxt))
            assert (r["fingerprint"], r["edited_fingerprint"]) == (_hex(own), _hex(other))
            assert (r["near_edited"], r["near_next"]) == (print_likeness(own, other), print_likeness(own, after))
    return found


def test_levels_equal_the_plain_version():
    r = random.Random(4)
    texts = [b"", b"a", b"aa", b"ab", b"aab" * 30, bytes(r.randrange(3) for _ in range(500)), bytes(r.randrange(256) for _ in range(700)), b"x" * 90 + b"yx" * 40]
    for t in texts:
        got = parse(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert [x[1].tolist() for x in got] == phrase_levels(t), t[:20]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    _check(docs)
    found = _check(docs, groups=16).values()
    near, nxt = np.array([r["near_edited"] for r in found]), np.array([r["near_next"] for r in found])
    assert 0.35 < np.median(near) < 0.65 and np.median(nxt) < 0.05


def test_equal_substrings_share_interior_phrases():
    r = random.Random(1)
    shared = "".join(r.choice("abcdefgh ") for _ in range(4000)).encode()
    a, b = b"x" * 777 + shared, bytes(r.randrange(256) for _ in range(1234)) + shared + b"tail"
    for k, ((ra, na), (rb, nb)) in enumerate(zip(parse(np.frombuffer(a, np.uint8), np.array([0, len(a)])), parse(np.frombuffer(b, np.uint8), np.array([0, len(b)])), strict=False)):
        if len(na) > 60:
            assert len(np.intersect1d(na, nb)) >= 0.7 * len(np.unique(na)), k


def test_results_do_not_depend_on_neighbours_and_levels_end():
    texts = [b"", b"a", b"ab", b"a" * 5000, b"abab" * 900, bytes(range(256)) * 30, b"zz", b"q" * 3 + b"r"]
    together = fingerprints(texts)
    for t, p in zip(texts, together, strict=True):
        assert np.array_equal(fingerprints([t])[0], p) and likeness(p, p) == 1.0
        assert np.array_equal(from_text(to_text(p)), p)


def test_edge_cases(spark):
    rows = [(None, "null id " * 9, 1), (5, None, 1), (-3, "", 2), (9, "é€\U0001f600" * 40, 2), (1 << 40, "w" * 90000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    _check(docs)
    _check(docs.filter("doc_id = 9"))
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (2, "d")], "doc_id long, text string")
    for groups in (None, 1, 50):
        assert fingerprint_documents(twice, groups=groups).count() == 4
    # rows without an id, many more than a group takes, follow one another by their digests
    texts = [f"text {k} " * 5 for k in range(300)]
    order = sorted(texts, key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    many = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(5)
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t, n in zip(order, [*order[1:], order[0]], strict=True))
    assert sorted(r["edited_sha256"] for r in fingerprint_documents(many, groups=20).collect()) == want
    assert fingerprint_documents(docs.filter(F.lit(False))).count() == 0
