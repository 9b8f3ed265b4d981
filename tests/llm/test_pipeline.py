"""The pipeline against plain restatements of its stages, each on its own input."""

import random
import sys
from pathlib import Path

import corpus_pipeline
from docquarry.llm import bpe_chunks, line_quality
from docquarry.llm.queries import tokenizer_path

sys.path.insert(0, str(Path(__file__).parent))
import corpus as C  # noqa: E402


def test_passages_of_some_words_are_caught(spark):
    """Passages of 51 to 80 words in several documents: all but the first go, whole, and the words about them stay."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in range(51, 81)]
    docs, own = [], {}
    for k, passage in enumerate(passages):
        for copy in range(5):
            doc_id, parts = 10 * k + copy, (prose(r.randint(60, 200)), prose(r.randint(60, 200)))
            own[doc_id] = (*parts, passage)
            docs.append((doc_id, f"{parts[0]}\n{passage}\n{parts[1]}", "en", "s", 0))
    clean = [(1000 + i, prose(r.randint(20, 300)), "en", "s", 0) for i in range(100)]
    frame = spark.createDataFrame(docs + clean, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    after = {x.doc_id: x.text for x in corpus_pipeline.repeated_passages(spark, frame, "").collect()}
    assert all(after[d] == t for d, t, *_ in clean)
    later = [d for d in own if d % 10]
    gone = [d for d in later if own[d][2] not in after[d] and own[d][0][:-8] in after[d] and own[d][1][8:] in after[d]]  # a letter or two may agree by chance
    assert len(gone) >= 0.99 * len(later) and all(own[d][2] in after[d] for d in own if d % 10 == 0)


def test_stages_with_awkward_rows(spark, sf_dir):
    """Null and repeated ids, repeated rows, null, empty and very long texts, and an empty table go through every stage but the last."""
    rows = C.rows()
    rows += [(None, rows[12][1], "en", "src1", 0, None, None, None), (None, None, None, None, None, None, None, None)] * 2
    frame = spark.createDataFrame(rows, C.COLUMNS).repartition(3)
    for docs in (frame, frame.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            seen = docs.collect()
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert docs.count() <= len(seen) and {x.doc_id for x in docs.collect()} <= {x.doc_id for x in seen}
        if not seen:
            assert docs.count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in seen.collect()]
        seen = stage(spark, seen, sf_dir).cache()
        assert seen.columns == docs.columns
        after = {r.doc_id: r.text for r in seen.collect()}
        assert all(r.n_chars == len(r.text) for r in seen.collect())
        if name == "quality_rules":
            failed = {r[0] for r in C.base_quality(before) if r[-1]}
            assert not failed & set(after)
            assert set(after) == {r.doc_id for r in line_quality.quality(docs).filter("kept").collect()}
        elif name == "near_duplicates":
            assert set(after) == {c for _, _, c in C.near_duplicates(before)}
        elif name == "repeated_passages":
            for doc_id, left in C.later_bytes(sorted(before), corpus_pipeline.PASSAGE_BYTES):
                # a character that is cut in part stays
                assert 0 <= len(after[doc_id].encode()) - len(left) <= 2 * 3 * (1 + len(left) // 50)
        else:
            assert set(after) == {r[0] for r in C.contamination(before, items) if not r[-1]}
    t = bpe_chunks.tokenizer(tokenizer_path("word_bpe_49k.json"))
    rows = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert rows == {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) for r in seen.collect()}
