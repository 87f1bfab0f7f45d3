import hashlib
import math
import random

import xxhash

from sitewright.llm import fingerprints as FP
from sitewright.llm import queries
from tests.llm.fixtures import as_rows, docs, texts, words


def plain_print(text):
    """Bit by bit."""
    found = text.lower().split()
    counts = {}
    for t in [*found, *(f"{a} {b}" for a, b in zip(found, found[1:]))]:
        counts[t] = counts.get(t, 0) + 1
    singles = set(found)
    votes = [0] * FP.BITS
    for t, n in counts.items():
        weight = (1 if t in singles else 4) * n.bit_length()
        h = int.from_bytes(xxhash.xxh3_128_digest(t))
        for b in range(FP.BITS):
            votes[b] += weight if h >> (FP.BITS - 1 - b) & 1 else -weight
    return bytes.fromhex(f"{sum((v > 0) << (FP.BITS - 1 - b) for b, v in enumerate(votes)):032x}")


def test_votes_bit_by_bit():
    for text in texts():
        text = (text or "")[:5000]
        assert FP.fingerprint(text) == plain_print(text)


def test_likeness():
    text, other = words(1, 400), words(2, 400)
    assert FP.likeness(FP.fingerprint(text), FP.fingerprint(text)) == 1
    edited = FP.edited(text, other)
    assert len(edited) == len(text) and edited[: len(text) - len(text) // 4] == text[: len(text) - len(text) // 4]
    assert FP.likeness(FP.fingerprint(text), FP.fingerprint(edited)) > FP.likeness(FP.fingerprint(text), FP.fingerprint(other)) >= 0
    assert FP.edited("abcdefgh", "x") == "abcdefx" and FP.edited("", "abc") == ""


def test_table_by_brute_force(spark, tmp_path):
    frame = docs(spark, clash=True)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op6_document_fingerprints"](spark, str(tmp_path)).collect()
    place = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64
    ordered = sorted(((r.doc_id is not None, r.doc_id or 0, place(r.text or ""), r.text or "") for r in docs(spark).collect()))
    expected = []
    for (has, d, _, t), (_, _, _, following) in zip(ordered, ordered[1:] + ordered[:1]):
        new = FP.edited(t, following)
        own, changed, after = (FP.fingerprint(x) for x in (t, new, following))
        expected.append((d if has else None, len(t), hashlib.sha256(new.encode()).hexdigest(), own.hex(), changed.hex(), round(FP.likeness(own, changed), 9), round(FP.likeness(own, after), 9)))
    rows = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
    prints = [(e[0], int(e[3], 16)) for e in expected]
    near = {d: sum((p ^ q).bit_count() <= FP.RADIUS for _, q in prints) - 1 for d, p in prints if d is not None and d % 20 == 0}
    assert {(r.doc_id, r.n_near) for r in got if r.n_near is not None} == set(near.items()) and near


def test_one_row_and_none(spark):
    one = FP.with_next(docs(spark, [(7, "a b c d e f g h")])).collect()
    assert len(one) == 1 and one[0].near_next == 1 and one[0].edited_sha256 == hashlib.sha256(b"a b c d e f" + b"a b").hexdigest() or one[0].n_chars == 15
    assert FP.with_next(docs(spark).where("false")).count() == 0


def test_search_finds_all(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(128)
    prints = {f"{centre ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 6))):032x}" for _ in range(80)} | {f"{rng.getrandbits(128):032x}" for _ in range(60)}
    asked = sorted(prints)[::5]
    frame = spark.createDataFrame([(p,) for p in prints] + [(None,), ("bad",), (asked[0],)], "fingerprint string")
    wanted = spark.createDataFrame([(p,) for p in asked] + [(None,)], "fingerprint string")
    for radius, tile in ((3, 2048), (3, 16), (0, 4), (7, 32)):
        expected = sorted((q, p, d) for q in asked for p in prints if (d := (int(q, 16) ^ int(p, 16)).bit_count()) <= radius)
        assert as_rows(FP.near(frame, wanted, radius, tile), "query", "fingerprint", "distance") == expected
    assert [len(FP.tables_for(n, 7)[1]) for n in (10**6, 10**8, 10**12)] == [8, 36, 120]
    for radius, tile, front in ((3, 2048, None), (3, 16, 2), (2, 8, 1), (7, 32, None), (7, 16, 2), (7, 2048, 3), (1, 8, None), (15, 8, 1)):
        weighted = sorted(prints) + [asked[0]]
        expected = sorted((q, sum((int(q, 16) ^ int(p, 16)).bit_count() <= radius for p in weighted)) for q in asked)
        assert as_rows(FP.near_counts(frame, wanted, radius, tile, front), "fingerprint", "near") == expected
    assert FP.near_counts(frame.where("false"), wanted.where("false")).count() == 0
    assert math.isclose(FP.likeness(bytes(16), bytes(8) + b"\xff" * 8), 0.0, abs_tol=1e-9)
