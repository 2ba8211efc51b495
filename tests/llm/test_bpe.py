import numpy as np
import hashlib
import random
from array import array

import public_tokenizers
from data import ROWS, hard_docs, no_docs, table_of
from tokenizers import Tokenizer

from logsieve.llm import bpe, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_safe_characters_split_alike():
    ids = word_bpe.WordIds(PATH)
    for c in [*range(0x2070), *range(0x20A0, 0x20B0), *range(0x3040, 0x3050)]:
        for text in (f"ab{chr(c)}cd1{chr(c)}!{chr(c)}{chr(c)}", f"{chr(c)}S 'S{chr(c)}", f"'{chr(c)} 7{chr(c)}"):
            want = array("I", TOKENIZER.encode(text, add_special_tokens=False).ids).tobytes()
            assert ids.encode([text])[0] == want, hex(c)


def test_merging_words_of_any_length():
    merges, rnd = word_bpe.Merges(PATH), random.Random(5)
    words = ["".join(rnd.choice(a) for _ in range(n)) for n in (1, 2, 5, 13, 40, 100, 255, 256, 257, 1500)
             for a in ("ab", "theinganr", "aeiouéß") for _ in range(4)]
    for w, got in zip(words, merges.merge([w.encode() for w in words]), strict=True):
        assert got == array("I", TOKENIZER.encode(w, add_special_tokens=False).ids).tobytes(), w


def test_transducer_holds_its_words_only():
    rnd = random.Random(2)
    words = sorted({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 7))) for _ in range(300)})
    ids = [array("I", [i, i + 1][:1 + i % 2]).tobytes() for i in range(len(words))]
    arrays = bpe.compile_transducer(words, ids)
    t = bpe.Transducer(arrays)
    others = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))) for _ in range(500)})
    want = dict(zip(words, ids, strict=True))
    assert t.lookup([w.decode() for w in words]) == ids
    assert t.lookup(others) == [want.get(w.encode()) for w in others]
    # minimal: as many states as there are different right languages
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    languages = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in prefixes}
    assert len(arrays["final"]) == len(languages)
    assert bpe.Transducer(bpe.compile_transducer([], [])).lookup(["a"]) == [None]


def test_round_trip_against_library(spark):
    want = []
    for i, text, *_ in ROWS:
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(TOKENIZER.decode(ids, skip_special_tokens=False))))
    for size in (0, 3, 50_000):
        assert table_of(bpe.encode(hard_docs(spark), PATH, digests=True, lexicon_words=size).collect()) == table_of(want)
    full = {(r.doc_id, len(r.ids), sha(r.decoded)) for r in bpe.encode(hard_docs(spark), PATH).collect()}
    assert full == {(i, n, d) for i, n, _, d in want}
    assert bpe.encode(no_docs(spark), PATH).collect() == []


def test_words_of_arrays_are_the_matches_of_the_pattern():
    """Random texts of the safe characters, with apostrophes, digits, underscores and several texts at once."""
    import random

    from logsieve.llm import word_bpe
    draw, finder = random.Random(8), word_bpe.Words()
    letters = list("stmdrevl'''' __0123 \t\n.,!abé²½ßö‐—€") + ["'s", "'ll", "'re", "''", "'t'", "it's", "_'d"]
    for _ in range(150):
        texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(50))).lower() for _ in range(draw.randrange(1, 6))]
        starts, ends = finder.find(texts)
        bounds = finder.spans.text_bounds(starts)
        got = [[finder.spans.joined[a:b] for a, b in zip(starts[x:y], ends[x:y], strict=True)] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [[w for s in t.split() for w in word_bpe.WORDS.findall(s)] for t in texts]


def test_renderer_joins_names():
    from logsieve.llm.bpe import Renderer
    names = {i: "x" * (i % 40) + str(i) for i in range(60)}
    r = Renderer(names)
    for ids, bounds in (([1, 2, 3, 50, 4], [0, 2, 2, 5]), ([], [0, 0]), ([7], [0, 1]), ([5, 6, 7], [0, 3])):
        got = [bytes(x).decode() for x in r.texts(np.array(ids, np.int32), np.array(bounds))]
        assert got == [" ".join(names[i] for i in ids[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
