"""Greedy longest match against a brute-force splitter and the tokenizers library."""
import random

import public_tokenizers
from tokenizers import Tokenizer, models

from logsieve.llm import token_counts as tc
from logsieve.llm.word_bpe import byte_characters


def greedy(word, initial, continuing):
    n, at = 0, 0
    while at < len(word):
        pieces = initial if at == 0 else continuing
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def automaton(initial, continuing):
    return tc.Automaton(tc.compile_automaton(initial, continuing))


def test_small_vocabularies_against_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        some = lambda k: {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 5))) for _ in range(k)}
        initial, continuing = some(rnd.randint(1, 12)), some(rnd.randint(0, 12))
        words = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(1, 14))) for _ in range(200)]
        words.append(bytes(rnd.choice(b"ab") for _ in range(400)))
        got = automaton(initial, continuing).count(words).tolist()
        assert got == [greedy(w, initial, continuing) for w in words]


def test_production_vocabulary_against_library():
    initial, continuing = tc.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    chars = byte_characters()
    text = lambda b: "".join(chars[x] for x in b)
    pieces = ["[UNK]", *map(text, sorted(initial)), *("##" + text(p) for p in sorted(continuing))]
    library = Tokenizer(models.WordPiece({p: i for i, p in enumerate(pieces)}, unk_token="[UNK]",
                                         max_input_chars_per_word=10_000))
    rnd = random.Random(4)
    words = [w.encode() for w in ("the", "unbelievable", "d'être", "日本語", "$$$", "x" * 300, "état,")]
    words += ["".join(rnd.choice("theinganérüß.,") for _ in range(rnd.randint(1, 40))).encode() for _ in range(400)]
    assert automaton(initial, continuing).count(words).tolist() == \
        [len(library.encode(text(w)).ids) for w in words]


def test_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \n\t ", 9), (4, "the cat", 9), (4, "the cat", 9), (None, "the", 9),
            (5, "the " * 300_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    initial, continuing = tc.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    out = sorted((tuple(r) for r in tc.count_tokens(docs, initial, continuing).collect()), key=str)
    assert out == sorted([(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 2, 2), (4, 2, 2), (None, 1, 1),
                          (5, 300_000, 300_000)], key=str)
    assert tc.count_tokens(docs.limit(0), initial, continuing).collect() == []
