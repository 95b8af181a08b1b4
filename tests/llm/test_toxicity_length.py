"""Toxicity: length alone makes nothing toxic, and a document is known by its one bad sentence."""

import math

from sedimenta.llm import queries, toxicity
from sedimenta.llm.common import remainder, table

DATA = "/root/testdata/sf0.01"


def test_long_clean_texts(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = queries.toxicity_model(spark, docs, DATA)
    run = model.scorer()
    held = docs.join(labels, "doc_id").where(remainder("doc_id", 3) == 1).collect()
    clean = [r.text for r in held if r.text and not r.toxic and run(r.text)[0] < 0.1]
    whole = "\n".join(clean)
    p, parts, _ = run(whole)
    assert len(parts) > 2000 and p < 0.3
    bad = max((r.text for r in held if r.toxic and r.text), key=lambda t: run(t)[0])
    assert run(whole + "\n" + bad)[0] >= 0.7
    assert run("")[0] == run(" \n ")[0] < 0.1


def test_score_is_the_noisy_or_of_its_sentences(spark):
    rows = [("Calm words stand here. More calm words.", 0)] * 2 + [(f"Calm line {i}. Still calm {i}.", 0) for i in range(40)] + [(f"Calm line {i}. A vile thing {i}.", 1) for i in range(20)]
    model = toxicity.fit(rows)
    for text, _ in rows:
        left = 1.0
        for s in toxicity.sentences(text):
            z = model.bias + sum(sum(model.weights.get(f, 0.0) for f in toxicity.features(w)) for w in toxicity.words(s))
            p = 1 / (1 + math.exp(-z))
            left *= min(1.0, (1 - p) / (1 - 0.1))
        want = 1 - math.exp(-model.leak) * left
        assert abs(model.scorer()(text)[0] - want) < 1e-9
