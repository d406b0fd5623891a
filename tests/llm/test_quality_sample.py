"""A labelled id on very many rows does not fill the training sample."""

from swathframe.llm import quality_classifier


def test_copies_of_one_id_are_one_row(spark, monkeypatch):
    ids = range(60)
    docs = [(d, f"word{d} " * (d + 5)) for d in ids] + [(d, "a") for d in (0, 1, 2, 3) for _ in range(100)]
    labels = [(d, d % 2, 0) for d in ids]
    seen = []
    monkeypatch.setattr(quality_classifier, "fit_trees", lambda x, y: seen.append((x, y)))
    quality_classifier.fit_quality(spark.createDataFrame(docs, "doc_id long, text string"),
                                   spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample=70)
    x, y = seen[0]
    assert len(x) <= 64 and len({tuple(r) for r in x.tolist()}) >= 25 and set(y) == {0.0, 1.0}
