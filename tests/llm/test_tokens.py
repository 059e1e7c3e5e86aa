"""Token files: an exact round trip against the tokenizer itself."""

import zlib

import numpy as np
import pytest

from mixframe.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
TRICKY = [
    None, "", " ", "\n\n", "one", "It's  we'll\tYOU'VE\r\nx\x0by\x1cz\x85a\u00a0b\u2028c\u3000d", "<|endoftext|> <|startoftext|>a",
    "e\u0301 \u0301e", "ΑΣ ΑΣΑ ΟΔΟΣ", "漢字かな😀 1234", "'s 't's a's", "-- !!? ..." , "ab" * 30_000, "word " * 20_000, "ﬁ ½ Ǆ İI",
]


def test_round_trip(spark, folder, tmp_path):
    tokenizer = tokens.tokenizer(path := str(public_tokenizers.path("word_bpe_49k.json")))
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = real + [(100_000 - i, t) for i, t in enumerate(TRICKY)] + [(None, "no id"), (-5, "first"), (7, "tie a"), (7, "tie a")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, start int, part int").repartition(6)
    parts = tokens.write_tokens(docs, str(tmp_path / "out"), path)
    found = tokens.digests(spark, parts).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(r[0] for r in rows if r[0] is not None) + [None]
    ids = {}
    for doc, text in rows:
        ids.setdefault(doc, []).append(np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    start, seen = 0, []
    for r in found:
        assert r.start == start
        start += r.n_tokens
        seen.append((str(r.doc_id), r.n_tokens, r.ids_crc32))
    assert sorted(seen) == sorted((str(d), len(b) // 4, zlib.crc32(b)) for d, all_ in ids.items() for b in all_)
    named = [dict(zip(tokens._names(tokens.LISTED), p, strict=True)) for p in parts]
    joined = np.concatenate([tokens.mapped(f"{p['path']}.bin", f"<u{p['width']}") for p in named])
    assert len(joined) == start and {p["width"] for p in named} == {2}


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    parts = tokens.write_tokens(none, str(tmp_path / "out"), str(public_tokenizers.path("word_bpe_49k.json")))
    assert parts == [] and tokens.digests(spark, parts).collect() == []


def test_cache_limit():
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    small, large = tokens.Encoder(path, 2, limit=3), tokens.Encoder(path, 2)
    for text in ("a b c d e f", "f g h", "a a a"):
        assert small.encode([text])[0].tolist() == large.encode([text])[0].tolist()


def test_case_and_composition():
    """A-Z is lower-cased by the tokenizer after added tokens are found and characters are composed."""
    tokenizer = tokens.tokenizer(path := str(public_tokenizers.path("word_bpe_49k.json")))
    texts = ["<|ENDOFTEXT|> <|endoftext|>A", "x<|StartOfText|>,<|startoftext|>.", "H̱a T̈ W̊. Y̊,J̌", "A,'S B'S ''S 1'S", "İ. İa"]
    ids, lengths = tokens.Encoder(path, 2).encode(["", *texts, ""])
    found = [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])]
    assert found == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in ["", *texts, ""]]


def test_random_texts():
    tokenizer = tokens.tokenizer(path := str(public_tokenizers.path("word_bpe_49k.json")))
    some = [*"abstTHKI'.,;!-=<>|*/ \n\t\r\x0b12é×ªİΣ·ж漢½", "́", "̸", "̱", "<|endoftext|>", "<|EndOfText|>", "'S", "'ll"]
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(some, n)) for n in rng.integers(0, 15, 3000)]
    wanted = [e.ids + [2] for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for limit in (30, tokens.CACHE_WORDS):
        encoder, found = tokens.Encoder(path, 2, limit), []
        for start in range(0, len(texts), 100):
            ids, lengths = encoder.encode(texts[start : start + 100])
            found += [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])]
        assert found == wanted


def test_pieces():
    """Marks and digits are no part of the words that are remembered, and words that are met often stay."""
    encoder = tokens.Encoder(str(public_tokenizers.path("word_bpe_49k.json")), 2, limit=4)
    encoder.encode(["word, Word. (word) word### 3word12", "word word"])
    assert set(encoder.known) == {None, b"word", b",", b".", b"(", b")", b"###", b"1", b"2", b"3"}
    encoder.encode(["other"])
    assert len(encoder.known) == 4 and {b"word", b"other"} < set(encoder.known)


def test_other_vocabulary(tmp_path):
    """A tokenizer of another form gets whole texts."""
    import json

    form = json.loads(tokens.tokenizer(str(public_tokenizers.path("word_bpe_49k.json"))).to_str())
    form["normalizer"] = None
    (path := tmp_path / "cased.json").write_text(json.dumps(form))
    ids, lengths = tokens.Encoder(str(path), 2).encode(["The Word", "", "the word"])
    wanted = [tokens.tokenizer(str(path)).encode(t, add_special_tokens=False).ids + [2] for t in ("The Word", "", "the word")]
    assert [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])] == wanted


def test_letters():
    """Every letter that texts are cut after is one to the tokenizer, whatever letter or mark is beside it."""
    encoder = tokens.Encoder(path := str(public_tokenizers.path("word_bpe_49k.json")), 2)
    ids = lambda text: tokens.tokenizer(path).encode(text, add_special_tokens=False).ids
    letters = [chr(c) for c in np.flatnonzero(tokens.LETTERS)]
    assert {"é", "ж", "א", "ب"} < set(letters) and not {"İ", "×", "\u0301", "\u05b0"} & set(letters)
    for c in letters:
        assert encoder.ends[ids(f"a{c}b")].sum() == 1, c
        assert ids(f"{c}.{c}1{c}") == [i for part in (c, ".", c, "1", c) for i in ids(part)], c
    encoder.encode(["שלום, שלום. سلام! سلام"])
    assert set(encoder.known) == {None, *(t.encode() for t in ("שלום", "سلام", ",", ".", "!"))}
