"""What the limits of time ask: counts are looked up in one go, and made without ids."""

from llm_conftest import prose

from vecspark.llm import bpe, queries, token_counts


def test_leaves_are_as_counted_piece_by_piece():
    codec = bpe.Codec(bpe.read_spec(queries.tokenizer_path()), special=False)
    for text in ("", "a", "it's \n\n x\u3000é 12345", prose(5, 900)):
        pieces = codec.pattern.findall(text)
        own = token_counts.encoded_leaves(text, codec)
        assert "".join(x.text for x in own) == text and sum((x.lengths for x in own), []) == list(map(len, pieces))
        assert sum((x.tokens for x in own), []) == [len(codec.word(p)) // 4 for p in pieces]
        assert [(x.chars, x.count, x.pieces) for x in own] == [(sum(x.lengths), sum(x.tokens), len(x.lengths)) for x in own]


def test_counts_need_no_ids_of_words_that_are_short(monkeypatch):
    codec = bpe.Codec(bpe.read_spec(queries.tokenizer_path()), special=False)
    monkeypatch.setattr(codec, "word", None)  # its arrays of ids were made, and kept, for their lengths before
    assert sum(x.count for x in token_counts.encoded_leaves("any words, 12 of them", codec)) == len(bpe.Codec.encode(bpe.Codec(bpe.read_spec(queries.tokenizer_path())), "any words, 12 of them")) // 4
    assert not codec.words and set(codec.sizes) == set(codec.pattern.findall("any words, 12 of them"))
