"""The pipeline, stage by stage, against brute force on a small table with hard cases."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from weft.llm import dedup, langid, minhash, packing, secretscan

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _dropped int, row string"
PASSAGE = " ".join(f"house{i} river{i % 7} mountain" for i in range(60))
TEXTS = [
    (0, None), (1, ""), (2, "1234 5678"), (3, "the house of the river and the mountain"), (4, "THE HOUSE of the river and the mountain"),
    (5, PASSAGE), (6, PASSAGE.replace("river3", "stream", 1)), (7, PASSAGE.upper()), (8, "der Fluss und das Haus und der Berg sind alt"),
    (9, "the password=abcdef1234567890 of the house"), (9, "another text of the same number for the house"), (None, "a text without a number for the mountain"),
    (None, "a text without a number for the mountain"), (None, "a second text without a number for the river"), (10, "the house of the river and the mountain"),
    (11, "one two"), (11, "one two"), (12, "the " * 4000 + "end of it"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), k, f"r{k}") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, FIELDS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FIELDS)


def lower(text):
    return (text or "").encode().lower().decode()


def kept(frame):
    """The rows by their own number, with all columns."""
    return {r._dropped: tuple(r) for r in frame.collect()}


def test_language(spark, docs, empty):
    got = kept(corpus_pipeline.language(spark, docs, ""))
    scores = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.identify(docs, public_tokenizers.path("piece_bpe_32k.model")).join(docs, "doc_id").collect()}
    assert not {0, 1, 2} & set(got) and {3, 4, 5, 8, 17} <= set(got)
    assert all(scores[TEXTS[k]][0] != "und" for k in got if TEXTS[k] in scores)
    assert corpus_pipeline.language(spark, empty, "").count() == 0


def test_exact(spark, docs, empty):
    best = {}
    for k, (i, t) in enumerate(TEXTS):
        best.setdefault(lower(t), []).append((-1 if i is None else i, k))
    got = kept(corpus_pipeline.exact(spark, docs, ""))
    assert len(got) == len(best)
    for own in best.values():
        high = max(i for i, _ in own)
        assert len([k for i, k in own if k in got and i == high]) == 1  # one row that has the largest doc_id
    assert corpus_pipeline.exact(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.exact(spark, empty, "").count() == 0


def test_exact_with_collisions(spark, docs, monkeypatch):
    class Same:
        @staticmethod
        def digest():
            return b"0" * 16

    monkeypatch.setattr(dedup.hashlib, "md5", lambda _: Same)
    assert len(kept(dedup.keep_one(docs))) == len({lower(t) for _, t in TEXTS})


def test_near(spark, docs, empty):
    sets = []
    for _, t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0d]+", lower(t))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(TEXTS)))
    order = sorted(root, key=lambda k: (TEXTS[k][0] is None, TEXTS[k][0] or 0))
    rank = {k: n for n, k in enumerate(order)}
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b], key=rank.get)
    got = kept(corpus_pipeline.near(spark, docs, ""))
    # of rows that share the smallest doc_id any one may stay
    assert sorted(map(root.__getitem__, got)) == sorted(set(root))
    assert all(TEXTS[k][0] == TEXTS[root[k]][0] for k in got)
    assert corpus_pipeline.near(spark, empty, "").count() == 0


def test_secrets(spark, docs, empty):
    words = secretscan.dictionary(public_tokenizers.path("word_bpe_49k.json"))
    got = kept(corpus_pipeline.secrets(spark, docs, ""))
    assert len(got) == len(TEXTS)
    for k, (_, t) in enumerate(TEXTS):
        spans = secretscan.base_spans(t or "")
        spans += secretscan.added_spans(t or "", spans, words)
        gone = {x for s, _, e in spans for x in range(s, e)}
        want = None if t is None else "".join("[SECRET]" if x in gone and x - 1 not in gone else "" if x in gone else c for x, c in enumerate(t))
        assert got[k][1] == want and got[k][4] == (None if want is None else len(want))
    assert "[SECRET]" in got[9][1] and corpus_pipeline.secrets(spark, empty, "").count() == 0


def test_pack(spark, docs, empty):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(tuple([*library.encode(t or "", add_special_tokens=False).ids, 1]) for _, t in TEXTS)
    pieces = packing.pack_documents(docs.selectExpr("_dropped as doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=True).collect()
    whole, windows = {}, {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == len(whole.get(r.doc_id, [])) and r.length == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        whole.setdefault(r.doc_id, []).extend(ids)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(map(tuple, whole.values())) == want
    for parts in windows.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist()
        total = sum(n for _, n in parts)
        assert total == 2048 or total & (total - 1) == 0 and total < 2048
    assert corpus_pipeline.pack(spark, empty, "").count() == 0


def test_whole(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        want = stage(spark, want, str(tmp_path))
        assert want.columns == docs.columns
    sizes = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {}
    for r in want.collect():
        expected[r.doc_id] = expected.get(r.doc_id, 0) + len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert sizes == expected
    assert minhash.keep_one(docs).columns == docs.columns
