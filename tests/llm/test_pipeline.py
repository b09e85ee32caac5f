"""The pipeline's stages on a small corpus."""

import corpus_pipeline
from stratatext.llm import bpe

from .test_text import PATH, words


def test_stages(spark, tmp_path):
    base = words(900, 60)
    line = "A licence line that is longer than forty characters, for all to see."
    bench = words(901, 30)
    rows = [(i, words(910 + i, 40), "src") for i in range(40)]
    rows += [(100 + i, words(960 + i, 30) + "\n" + line, "src") for i in range(6)]
    rows += [(200, base, "src"), (201, base + " more", "a"), (202, base, "b"), (300, words(990, 30) + " " + bench, "c"), (400, "too short", "d"), (401, None, None), (402, "", "e")]
    rows += [(500 + i, words(1000 + i, 40).replace(" ", "### "), "junk") for i in range(30)]
    docs = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 0 if k >= 400 else 1, 0) for k, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r["doc_id"]: r["text"] for r in bpe.decode_texts(out, PATH).collect()}
    assert set(kept) == {*range(40), *range(100, 106), 200}
    assert [k for k in range(100, 106) if line in kept[k]] == [105]
    assert kept[200] == base
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept)
