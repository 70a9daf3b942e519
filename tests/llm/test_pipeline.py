"""The corpus pipeline against a plain version of its stages."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from brickledger.llm import language_crf as lc
from brickledger.llm.decontaminate import words_of
from tests.llm.test_covering_simhash import plain_components, plain_fingerprint
from tests.llm.test_decontaminate import plain_hits

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, rows, items):
    docs = [(d, t, lang, "s", len(t or "")) for d, t, lang in rows]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_equals_plain_stages(spark, sf_dir, tmp_path):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    base = next(r for r in given if 80 <= len((r.text or "").split()) <= 400).text
    edited = base.split()
    edited[40] = "changed"
    rows = [(r.doc_id, r.text, r.lang) for r in given] + [
        (10**6, base, None), (10**6 + 1, " ".join(edited), None), (10**6 + 2, None, "en"), (10**6 + 3, "12 34 ?", "en"),
        (10**6 + 4, "Before it. " + items[0][1] + " After it.", None), (10**6 + 5, "", None), (10**6 + 6, "a short clean text of its own", None), (10**6 + 7, "совсем другой язык которого здесь никто не учил " * 4, None)]
    folder = write(spark, tmp_path, rows, items)

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labeller = lc.Labeller(lc.fit(lc.training_sample(docs.where(~lc.held_out()), "doc_id", "text", "lang")))
    texts = {}
    for d, t, _ in rows:
        name, *_, certainty = labeller.label([t])[0]
        assert (name == "und") == (not any(c.isalpha() for c in t or ""))
        if name != "und" and certainty >= lc.LEAST_CERTAINTY:
            texts[d] = t
    last = {}
    for d, t in texts.items():
        last[t] = max(d, last.get(t, d))
    texts = {d: t for t, d in last.items()}
    low = plain_components({d: plain_fingerprint(t) for d, t in texts.items()})
    texts = {d: t for d, t in texts.items() if low[d] == d}
    vocabulary = [(item, set(words_of(item[1]))) for item in items]
    for d, t in list(texts.items()):
        # a text of similarity 0.8 has most of the item's words
        present = set(words_of(t))
        if plain_hits(t, [item for item, own in vocabulary if len(own & present) >= 0.5 * len(own)]):
            del texts[d]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation(), library.no_padding()

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(texts)
    assert 10**6 + 6 in got and not {10**6 + i for i in (2, 3, 4, 5, 7)} & set(got)
    for d, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path, [], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert corpus_pipeline.run(spark, folder).count() == 0
