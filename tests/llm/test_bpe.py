import os

import pytest

from chainloom.llm.bpe import DEFAULT_FOLDER, Encoder, count_tokens, encode_corpus, merge, read_ranks

pytestmark = pytest.mark.skipif(not os.path.exists(f"{DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")
TEXTS = ["", " ", "Hello  world\n\n", "don't 12345 ½ 👩‍💻 <|endoftext|>", "Ngày 0xdeadbeef…", "x" * 3000, "a" * 70 + " " * 70, "\r\n\tline", "中文。"]


def naive(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_against_the_library_and_round_trip(name):
    import tiktoken

    from chainloom.llm.bpe import PIECES

    ranks = read_ranks(name)
    library = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    encoder = Encoder(ranks)
    for text in TEXTS:
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert encoder.decode(ids) == text
    assert encoder.encode(None) == []


def test_merge_against_plain_loop():
    ranks = read_ranks("byte_bpe_50k")
    for piece in (b"transactions", b" unbelievably", bytes(range(60, 100)), b"aaaaaaaaaaaaa", "đối".encode()):
        got = merge(piece, ranks)
        assert got == ([ranks[piece]] if piece in ranks else naive(piece, ranks))


def test_tables(spark):
    rows = [(1, "Hello"), (2, None), (3, ""), (1, "Hello"), (None, "x")]
    out = encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in out) == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0)]
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string, ids string")).count() == 0
    sizes = count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), ["byte_bpe_50k", "byte_bpe_multi_50k"])
    assert sizes.count() == 10
