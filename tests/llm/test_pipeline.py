"""The pipeline and its stages on a small corpus, against plain Python stage by stage."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_near_copies import slow_kept
from tokenizers import Tokenizer

import corpus_pipeline
from armspan.llm.simhash_trie import near_duplicates

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def corpus():
    """Plain, toxic, copied, near-copied and leaking documents, and odd ones."""
    rng = random.Random(6)
    plain = lambda n: " ".join(rng.choice("stone river house green walk slowly under many light paper table window".split()) + str(rng.randint(0, 99)) for _ in range(n))
    rows, labels = [], []
    for i in range(120):
        rows.append((i, plain(rng.randint(20, 90)), "en", rng.choice(["a", "b", None])))
        labels.append((i, 1, 0))
    for i in range(120, 170):
        rows.append((i, plain(30) + " you vilescum wretchface get lost " + plain(10), "en", "a"))
        labels.append((i, 0, 1))
    for i in range(170, 180):
        words = rows[i - 170][1].split() * 3
        rows.append((i, " ".join(words), "en", "b"))
        words[-1] = "changed"
        rows.append((i + 100, " ".join(words), "en", "b"))
        rows.append((i + 200, " ".join(words), "en", "b"))
    for i in range(400, 406):
        half = ITEM.split()
        rows.append((i, f"{plain(8)} {' '.join(half[6:])} {plain(3)} {' '.join(half[:6])}", "en", "c"))
    rows += [(500, None, None, None), (501, "", "en", "a"), (502, "one", "en", "c"), (None, plain(12), "en", "c"), (0, rows[0][1], "en", "a")]
    return [(i, text, lang, source, len(text or "")) for i, text, lang, source in rows], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root)


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)

    def after(name):
        nonlocal docs, rows
        docs = corpus_pipeline.stored(stages[name](spark, docs, folder), "test")
        assert docs.columns == COLUMNS.replace(" bigint", "").replace(" string", "").split(", ") or name == "token files"
        before, rows = rows, [tuple(r) for r in docs.collect()]
        return before

    before = after("toxicity")
    assert sorted(map(str, rows)) == sorted(str(r) for r in before if "vilescum" not in (r[1] or ""))
    before = after("near-dedup")
    wanted = slow_kept([(10**9 if r[0] is None else r[0], r[1]) for r in before])
    assert sorted(10**9 if r[0] is None else r[0] for r in rows) == wanted
    before = after("benchmark decontamination")
    assert sorted(map(str, rows)) == sorted(str(r) for r in before if not (r[0] and 400 <= r[0] < 406))
    before = after("source mix")
    assert {str(r) for r in rows} <= {str(r) for r in before}
    assert all(rows.count(r) <= 2 for r in before)
    assert {r for r in before if not (r[1] or "").split()} <= set(rows)
    before = after("token files")
    assert sorted(map(str, (r[0] for r in rows))) == sorted(str(r[0]) for r in before)


def test_run(spark, folder):
    # A lazy result of another operator, whose stored tables the pipeline must leave.
    others = near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect())
    texts = {row[0]: row[1] for row in corpus()[0]}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    for at, doc_id, n, crc in found:
        ids = [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1]
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    assert not {i for _, i, _, _ in found} & {*range(120, 170), *range(400, 406), *range(270, 280), *range(370, 380)}
    assert others.count() == len(corpus()[0])


def test_stages_on_odd_documents(spark, odd_docs, no_docs, folder):
    for docs, n in ((odd_docs, 9), (no_docs, 0)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, folder)
            assert found.columns == docs.columns or name == "token files"
            assert found.count() <= 2 * n
