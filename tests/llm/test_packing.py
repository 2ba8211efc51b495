import random
import zlib
from array import array

import public_tokenizers
from data import ROWS, hard_docs, no_docs
from tokenizers import Tokenizer

from logsieve.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def first_fit(lengths, capacity):
    free, place = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, f in enumerate(free) if f >= lengths[i]), None)
        if b is None:
            free.append(capacity)
            b = len(free) - 1
        place[i] = b, capacity - free[b]
        free[b] -= lengths[i]
    return [place[i] for i in range(len(lengths))]


def test_tree_is_first_fit_decreasing():
    rnd = random.Random(1)
    for n in (1, 2, 3, 17, 200):
        lengths = [rnd.randint(1, 100) for _ in range(n)]
        assert packing.first_fit_decreasing(lengths, 100) == first_fit(lengths, 100)


def test_every_id_once(spark):
    tokenizer = Tokenizer.from_file(PATH)
    got = packing.pack(hard_docs(spark), PATH, length=64).collect()
    docs = {}
    for i, text, *_ in ROWS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        docs.setdefault(i, []).append(sorted((s, min(64, len(ids) - s), zlib.crc32(array("I", ids[s:s + 64]).tobytes()), len(ids))
                                             for s in range(0, len(ids), 64)))
    want = sorted((str(i), *p) for i, ds in docs.items() for d in ds for p in d)
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(no_docs(spark), PATH).collect() == []


def test_little_padding(spark):
    docs = spark.createDataFrame([(i, "the cat sat " * (i % 97)) for i in range(3000)], "doc_id long, text string")
    got = packing.pack(docs, PATH, length=512).toPandas()
    assert got.length.sum() / (512 * got.sequence_id.nunique()) > 0.99


def test_groups_come_from_the_pieces(spark):
    # few documents of many pieces: 6 x 3,001 words in pieces of 1 id
    docs = spark.createDataFrame([(i, "the cat sat " * 1000) for i in range(6)], "doc_id long, text string")
    got = packing.pack(docs, PATH, length=1).toPandas()
    sizes = got.groupby(got.sequence_id // 2**32).size()
    assert len(got) > 4 * packing.GROUP_PIECES and got.sequence_id.is_unique
    assert len(sizes) == round(len(got) / packing.GROUP_PIECES)
    assert sizes.max() < 1.2 * packing.GROUP_PIECES


def test_a_tasks_memory():
    """Many new words are merged in small matrices, and only a chunk's texts become strings."""
    import tracemalloc

    import pyarrow as pa

    from logsieve.llm import common, word_bpe
    rnd = random.Random(3)
    words = ["".join(rnd.choice("theinganr") for _ in range(30)) for _ in range(40_000)]
    merges = word_bpe.Merges(PATH)
    tracemalloc.start()
    merges.merge([w.encode() for w in words])
    assert tracemalloc.get_traced_memory()[1] < 40e6                     # 57 MB in matrices of 2 million cells
    tracemalloc.stop()
    texts = ["ab", None, "", "é" * 7, "abc", None]
    column = pa.array(["zz", *texts]).slice(1)
    for limit in (1, 3, 8, 100):
        assert list(common.ranges(column, limit)) == list(common.chunks([t or "" for t in texts], limit))
    assert list(common.ranges(column.slice(0, 0))) == []


def test_words_kept_over_chunks(monkeypatch):
    """Ids of words met in earlier chunks, in any order, and after the store starts anew."""
    from logsieve.llm import word_bpe
    rnd, tokenizer = random.Random(4), Tokenizer.from_file(PATH)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    monkeypatch.setattr(word_bpe, "MAX_WORDS", 150)
    ids = word_bpe.WordIds(PATH)
    for _ in range(12):
        texts = [" ".join(rnd.choices(words, k=20)) for _ in range(rnd.randint(0, 4))] + ["", "日本 <|x"][:rnd.randint(0, 2)]
        want = [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
        assert ids.encode(texts) == want if texts else True
