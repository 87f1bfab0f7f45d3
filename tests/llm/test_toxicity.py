import math
import random
import zlib

from sitewright.llm import queries, toxicity
from tests.llm.fixtures import docs, words


def test_folding():
    assert toxicity.folded("Id1ot! ЅТUРІD  cl0wn, étÉ") == " idiot stupid clown ete "
    assert toxicity.folded("") == "  " and toxicity.folded("sc$m") == " scsm "


def test_exceptions_and_length():
    model = toxicity.Model({" trash ": 3.0, " moro": 4.0}, (-2.0, 1.0, 1.0, 0.5))
    score = lambda t: toxicity.probability(model.curve, toxicity.features(toxicity.folded(t), model.automaton()))
    assert score("you trash") > score("the trash can is full") == score("nothing here") == score("")
    assert score("moronic") > 0.5 and score("a moronic " + "word " * 500) < score("a moronic word")
    brute = lambda line: sum(w for t, w in model.lexicon.items() for k in range(len(line)) if line.startswith(t, k))
    for seed in range(30):
        line = toxicity.folded(words(seed).replace("thing", random.Random(seed).choice(("trash", "moron", "thing"))))
        assert abs(toxicity.features(line, model.automaton())[1] - brute(line) / line.count(" ") ** 0.5) < 1e-9


def corpus(n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        text = words(k, 30)
        if bad:
            text = text.replace("of", rng.choice(("grumbleworm", "GRUMBLEW0RM", "zonkhead")), 3) + " zonkhead"
        rows.append((k, text))
        labels.append((k, int(bad)))
    return rows, labels


def test_learning_on_held_out_rows(spark):
    rows, labels = corpus()
    frame, marks = docs(spark, rows, clash=True), spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame, marks)
    assert any("zonkh" in t or "zonk" in t for t in model.lexicon)
    found = {r.doc_id: r for r in toxicity.scores(frame, model).collect()}
    truth = dict(labels)
    held = [r for r in found.values() if r.held_out]
    assert len(held) > 60 and all(r.predicted == truth[r.doc_id] for r in held)
    assert {r.doc_id for r in toxicity.without_toxic(frame, model).collect()} == {d for d, y in labels if not y}


def test_query_by_brute_force(spark, tmp_path):
    """The query's scores against the model applied text by text; exception phrases count through it; nothing but texts and labels is read."""
    rows, labels = corpus()
    rows = [(d, t + (" trash" if dict(labels)[d] and d % 2 else "")) for d, t in rows]
    rows += [(9000, "please put it in the trash can of the thing"), (9001, "please put it in the trash of the thing"), (9002, "Tr4sh"), (9003, None), (None, "zonkhead")]
    frame, marks = docs(spark, rows, clash=True), spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id long, quality int, toxic int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(frame, marks)
    assert any(" trash".startswith(t.rstrip()) for t in model.lexicon)
    got = {r.doc_id: r for r in queries.queries()["op3_toxicity"](spark, str(tmp_path)).collect()}
    for d, t in rows:
        line = toxicity.folded(t or "")
        hits = [(k, k + len(term), w) for term, w in model.lexicon.items() for k in range(len(line)) if line.startswith(term, k)]
        safe = [(k, k + len(p)) for p in map(toxicity.folded, model.exceptions) if not model.lexicon.get(p) for k in range(len(line)) if line.startswith(p, k)]
        weights = [w for a, b, w in hits if not any(s <= a and b <= e for s, e in safe)]
        total = sum(weights)
        features = (math.log1p(total), total / math.sqrt(line.count(" ")), max(weights)) if weights else (0.0, 0.0, 0.0)
        z = model.curve[0] + sum(c * f for c, f in zip(model.curve[1:], features))
        assert abs(got[d].score - 1 / (1 + math.exp(-z))) < 1e-9 and got[d].predicted == int(got[d].score >= 0.5)
        assert got[d].held_out == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0)
    assert got[9000].score < got[9001].score and got[9003].score < 0.5 < got[None].score


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(200)
    frame = docs(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    from pyspark.sql import functions as F

    turned = marks.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(frame, marks) == toxicity.fit(frame, turned)


def test_odd_rows(spark):
    marks = spark.createDataFrame([(0, 1), (1, None), (2, 0), (2, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark), marks)
    rows = toxicity.scores(docs(spark), model).collect()
    assert len(rows) == docs(spark).count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    empty = toxicity.fit(docs(spark), marks.where("false"))
    assert empty.lexicon == {} and {r.score for r in toxicity.scores(docs(spark), empty).collect()} == {0.0}
    assert toxicity.scores(docs(spark).where("false"), empty).count() == 0
    assert toxicity.without_toxic(docs(spark, clash=True), empty).count() == docs(spark).count()
