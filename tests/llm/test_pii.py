import hashlib
import itertools
import random
import re
import time

from pyspark.sql import functions as F

from sitewright.llm import pii, queries
from tests.llm.fixtures import docs, words

DIGITS = lambda s: re.sub("[^0-9]", "", s)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


PLAIN = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(DIGITS(m)) <= 19 and luhn(DIGITS(m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(DIGITS(m)) <= 15),
)


def plain(text):
    return [(kind, m.start(), m.end()) for kind, (pattern, good) in enumerate(PLAIN) for m in re.finditer(pattern, text) if good(m[0])]


def test_base_spans_by_brute_force(spark):
    rng = random.Random(8)
    parts = ["a", "b.c", "@", "x@y.z", ".", "-", "_", " ", "1", "22", "255", "256", "0000255", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (171) 555-2028", "+", "(", ")", "é", "😀", "49", "4929348385146306", "..", "a@b.c", "%"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["a" * 20_000 + "@", "1" * 20_000, "1 " * 50_000, "+1" + "(" * 100_000, "a@b" + ".c" * 50_000, ""]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in docs(spark, texts).select("doc_id", pii.entity_spans(F.col("text")).alias("base")).collect()}
    for k, text in enumerate(texts):
        assert found[k] == plain(text), text[:200]


def corpus():
    """One address always stands beside the same rare word, in different surroundings; common words stand beside everyone."""
    rows = []
    for k in range(60):
        rows.append((k, f"{words(k, 8)} {'zorblatt' if k % 6 == 0 else 'filler'} mail {'joe@corp.example.com' if k % 6 == 0 else f'p{k}@corp.example.org'} {words(k + 500, 8)}"))
    return rows


def test_disclosing_terms(spark):
    found = {r.doc_id: r for r in pii.scan(docs(spark, corpus())).collect()}
    terms = {(r.doc_id, t.value, t.level) for r in found.values() for t in r.terms}
    assert {(k, "zorblatt", "remove") for k in range(0, 60, 6)} == {t for t in terms if t[1] == "zorblatt"}
    assert not any(t[1] in ("mail", "filler", "the", "thing") for t in terms)
    clean = {r.doc_id: r.text for r in pii.sanitised(docs(spark, corpus())).collect()}
    assert "zorblatt" not in clean[0] and "<EMAIL>" in clean[0] and "joe@" not in clean[0] and " mail <EMAIL> " in clean[0]
    assert "filler mail <EMAIL>" in clean[1]


def test_measures_by_brute_force(spark):
    """PMI and IC from the definitions, over all words of all texts."""
    import math

    rows = corpus()
    word = re.compile(r"(?<![^\W_])[^\W\d_]{3,}(?![^\W_])")
    total = len(rows)
    df, both, contexts, of_entity = {}, {}, {}, {}
    for d, t in rows:
        for w in set(word.findall(t.lower())):
            df[w] = df.get(w, 0) + 1
        for kind, s, e in plain(t):
            left, right = t[max(0, s - 60) : s], t[e : e + 60]
            near = [m[0].lower() for m in word.finditer(left) if m.start() or s <= 60] + [m[0].lower() for m in word.finditer(right) if m.end() < len(right) or len(right) < 60]
            entity = (kind, t[s:e].lower())
            of_entity.setdefault(entity, set()).add(d)
            for w in near:
                both.setdefault((entity, w), set()).add(d)
                contexts.setdefault((entity, w), set()).add(tuple(near))
    expected = set()
    for (entity, w), seen in both.items():
        worth = math.log2(total / len(of_entity[entity]))
        told = math.log2(total * len(seen) / (len(of_entity[entity]) * df[w]))
        if len(contexts[entity, w]) >= 3 and worth > 0 and told >= 0.7 * worth:
            expected.add((w, "remove" if told >= 0.9 * worth else "generalise"))
    got = {(t.value.lower(), t.level) for r in pii.scan(docs(spark, rows)).collect() for t in r.terms}
    assert got == expected and expected


def test_terms_in_whole_texts_and_of_rare_entities(spark):
    rows = corpus() + [(100, f"Zorblatt {'filler ' * 40}zorblatt, and no entity"), (101, f"{words(3, 8)} quuxley mail once@corp.example.net"), (102, "filler and quuxley again"), (103, "filler " * 20)]
    found = {r.doc_id: [(t.start, t.end, t.value, t.level) for t in r.terms] for r in pii.scan(docs(spark, rows)).collect()}
    assert found[100] == [(0, 8, "Zorblatt", "remove"), (289, 297, "zorblatt", "remove")] and found[103] == []
    assert [t[2] for t in found[101]] == ["quuxley"] and found[102] == [(11, 18, "quuxley", "generalise")]
    clean = {r.doc_id: r.text for r in pii.sanitised(docs(spark, rows)).collect()}
    assert "orblatt" not in clean[100] and clean[102] == "filler and <WORD> again"


def test_running_values(spark):
    rng = random.Random(4)
    arrays = [[], [5], [0, 0], *([rng.randint(0, 50) for _ in range(n)] for n in (2, 3, 4, 5, 9, 10, 17, 100, 1000))]
    frame = spark.createDataFrame([(a,) for a in arrays], "a array<bigint>")
    rows = frame.select("a", pii.running(F.col("a")).alias("sums"), pii.running(F.col("a"), pii.greater).alias("most")).collect()
    for r in rows:
        assert r.sums == list(itertools.accumulate(r.a)) and r.most == list(itertools.accumulate(r.a, max))


def test_overlaps_by_brute_force(spark):
    """Free terms, and sanitised texts in which nothing that a span covers is left."""
    rng = random.Random(5)
    rows = []
    for k in range(200):
        spans = lambda n: sorted((s, s + rng.randint(1, 9)) for s in rng.sample(range(60), n))
        rows.append((k, [(0, s, e, "x") for s, e in spans(rng.randint(0, 5))], [(s, e, f"w{s}", "remove") for s, e in spans(rng.randint(0, 5))]))
    frame = spark.createDataFrame(rows, f"k bigint, base {pii.SPAN}, terms array<{pii.TERM_TYPE}>")
    found = {r.k: sorted((t.start, t.end) for t in r.free) for r in frame.select("k", pii.free_terms().alias("free")).collect()}
    for k, base, terms in rows:
        assert found[k] == sorted((s, e) for s, e, *_ in terms if not any(b < e and s < c for _, b, c, _ in base))
    text = "call +4912345678901 or 4929348385146306@b.c, +12 4929 3483 8514 6306 now"
    (clean,) = pii.sanitised(docs(spark, [text])).collect()
    covered = {c for _, s, e in plain(text) for c in range(s, e)}
    assert len(covered) > 30 and re.sub("<[A-Z]+>", "", clean.text) == "".join(c for k, c in enumerate(text) if k not in covered)


def test_query_by_brute_force(spark, tmp_path):
    """The query's strings: base spans of its texts, and the terms that the measures flag, where they stand free."""
    rows = corpus() + [(200, "zorblatt@corp.example.com and Zorblatt 10.0.0.1, +49 123 4567 890, 4111 1111 1111 1111"), (201, None)]
    docs(spark, rows, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    word = re.compile(r"(?<![^\W_])[^\W\d_]{3,}(?![^\W_])")
    flagged = {t.value.lower() for r in pii.scan(docs(spark, rows)).collect() for t in r.terms}
    got = {r.doc_id: r for r in queries.queries()["op7_private_data"](spark, str(tmp_path)).collect()}
    assert "zorblatt" in flagged and got[200].n_email == got[200].n_ip == got[200].n_card == got[200].n_phone == 1
    for d, t in rows:
        base = plain(t or "")
        terms = [(4, m.start(), m.end()) for m in word.finditer(t or "") if m[0].lower() in flagged and not any(s < m.end() and m.start() < e for _, s, e in base)]
        show = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        assert got[d].base_sha256 == hashlib.sha256(show(base).encode()).hexdigest() and got[d].spans == show(base + terms)


def test_one_text_of_very_many_matches(spark):
    text = " ".join(f"a{k}@b{k}.cd wörd" for k in range(40_000))
    frame = docs(spark, [text])
    began = time.time()
    (row,) = frame.select(pii.entity_spans(F.col("text")).alias("base")).collect()
    assert len(row.base) == 40_000 and time.time() - began < 10
    began = time.time()
    (clean,) = pii.sanitised(frame).collect()
    assert clean.text == " ".join(["<EMAIL> wörd"] * 40_000) and time.time() - began < 60


def test_query_on_odd_rows(spark, tmp_path):
    frame = docs(spark, clash=True)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.queries()["op7_private_data"](spark, str(tmp_path))
    rows = df.collect()
    assert len(rows) == frame.count() and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()} and {r.spans for r in rows} == {""}
    assert pii.scan(docs(spark).where("false")).count() == 0 and pii.sanitised(docs(spark).where("false")).count() == 0
    assert sorted(r.text for r in pii.sanitised(docs(spark)).collect()) == sorted(r.text or "" for r in docs(spark).collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
