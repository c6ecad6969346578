from __future__ import annotations

import zlib

from framelake.llm import toxicity


def test_copies_of_one_key_displace_no_labels(spark):
    keys = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1][:12]
    hot = [(keys[0], f"hot {i}") for i in range(200)]
    df = spark.createDataFrame(hot + [(k, f"text {k}") for k in keys[1:]], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(k, i % 2) for i, k in enumerate(keys)], "doc_id long, toxic int")
    learned = []
    for order in (df, df.orderBy("text", ascending=False)):
        learned.append(sorted((r.t, float(r.y)) for r in toxicity.training_rows(order, labels, sample=10).collect()))
    assert learned[0] == learned[1]
    assert [r for r in learned[0] if r[0].startswith("text")] == sorted((f"text {k}", float(i % 2)) for i, k in enumerate(keys) if i)
    assert sum(t.startswith("hot") for t, _ in learned[0]) == 1
