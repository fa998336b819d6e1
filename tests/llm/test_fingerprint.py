import hashlib

import numpy as np

from loomwork.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, block int, guest int"


def test_differences_are_exact():
    rng = np.random.default_rng(1)
    ones, twos = [], []
    for n, m, k in [(0, 0, 0), (5, 0, 3), (200, 190, 0), (40, 40, 40), (1, 1, 0), (3000, 2500, 1000)]:
        both = rng.integers(0, 2**63, k, dtype=np.uint64)
        ones.append(np.unique(np.r_[both, rng.integers(0, 2**63, n, dtype=np.uint64)]))
        twos.append(np.unique(np.r_[both, rng.integers(0, 2**63, m, dtype=np.uint64)]))
    for (a, b, _), x, y in zip(fp.differences(ones, twos), ones, twos, strict=True):
        assert set(a) == set(x) - set(y) and set(b) == set(y) - set(x)


def test_a_stuck_table_grows():
    a = np.arange(1, 400, dtype=np.uint64)
    (mine, other, cells), = fp.differences([a], [a[:0]], cells=6)
    assert set(mine) == set(a) and not len(other) and cells > 6


def test_paragraphs_join_to_the_text():
    for text in ("", "a", "a\n\nb.", "x" * 1000, "word " * 500, "Ünï. cödé! ok?\n end"):
        assert "".join(fp.paragraphs(text)) == text


def test_rows_follow_one_another(spark):
    texts = {3: "First text here. It has two sentences.", 700: None, 701: "", 2000: "ab" * 40, 5000: "First text here. It has two sentences.", 10_000: "Lone words"}
    rows = [(k, v, 1, 2) for k, v in texts.items()] + [(None, "no id", 1, 2)]
    found = {r["doc_id"]: r for r in fp.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    ids = sorted(texts)
    assert sorted(found) == ids
    for i, k in enumerate(ids):
        own, after = texts[k] or "", texts[ids[(i + 1) % len(ids)]] or ""
        new = own[: len(own) - len(own) // 4] + after[: len(own) // 4]
        assert found[k]["n_chars"] == len(own)
        assert found[k]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert found[k]["fingerprint"] == fp.fingerprint(fp.digests(own))
        a, b = set(fp.digests(own)), set(fp.digests(after))
        assert found[k]["near_next"] == (len(a & b) / len(a | b) if a | b else 1.0)
    assert found[3]["fingerprint"] == found[5000]["fingerprint"]


def test_repeated_rows_and_single_and_empty(spark):
    found = fp.fingerprints(spark.createDataFrame([(1, "a b. c", 0, 0)] * 2, SCHEMA)).collect()
    assert len(found) == 2 and all(r["near_next"] == 1.0 for r in found)
    assert fp.fingerprints(spark.createDataFrame([(1, "x", 0, 0)], SCHEMA)).first()["near_next"] == 1.0
    assert fp.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
