from __future__ import annotations

import public_tokenizers

from framelake.llm import lexicon


def test_words_spread_thinly_over_blocks_are_counted(spark):
    texts = [f"thin thin own{chr(97 + k)}" for k in range(6)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    n = {bytes(r.word): r.n for r in lexicon.counts(df, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert n[b"thin"] == 6 and n[b" thin"] == 6
