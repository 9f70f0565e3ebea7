"""Samples for the driver: in order of their hash, bounded in rows, characters and bytes before a text moves."""

from quorumlens.llm import common


def test_sample_texts(spark):
    docs = spark.createDataFrame([(i, "é" * (10 * i) if i else None) for i in range(8)] + [(3, "again")], "doc_id long, text string")
    sample = spark.createDataFrame([(i, 100 - i, i % 2) for i in range(8)], "doc_id long, h long, label int")

    def take(most_chars=1_000, most_bytes=10_000):
        return [(r["h"], r["text"], r["label"]) for r in common.sample_texts(docs, sample, 8, most_chars, most_bytes)]

    every = [(100 - i, "é" * (10 * i), i % 2) for i in range(7, 0, -1)]
    every.insert(4, (97, "again", 1))
    assert take() == every  # null texts are left out, a repeated id has both its texts, smaller first
    assert [h for h, *_ in take(most_chars=50)] == [95, 96, 97, 97, 98, 99]
    # 140 and 120 bytes fit, the next 100 don't, and nothing behind them is taken
    assert [h for h, *_ in take(most_bytes=300)] == [93, 94] and take(most_bytes=100) == []
    assert common.sample_texts(docs.where("false"), sample, 8, 10, 10) == []


def test_batches_are_bounded_in_rows_and_bytes(spark):
    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "20")
        common.small_batches(spark, 500, 1 << 20)
        assert spark.conf.get(keys[0]) == "20" and spark.conf.get(keys[1]).startswith(str(1 << 20))
        spark.conf.set(keys[0], "-1")
        common.small_batches(spark, 500)
        assert spark.conf.get(keys[0]) == "500"
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
