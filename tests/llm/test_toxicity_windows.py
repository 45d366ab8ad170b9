from contestra.llm import toxicity


def test_fit_reads_every_window(spark, monkeypatch):
    texts = {1: 3000, 2: 40, 3: 784, 4: 0}
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(n))) for i, n in texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    got = []
    monkeypatch.setattr(toxicity, "train", lambda windows, y: got.extend(windows))
    assert toxicity.fit(docs, labels) == 0.5
    assert [len(d) for d in got] == [toxicity.windows_of(n) for n in texts.values()]
    for (i, n), d in zip(texts.items(), got, strict=True):
        assert {w for window in d for w in window} == {f"d{i}w{k}".encode() for k in range(n)}
