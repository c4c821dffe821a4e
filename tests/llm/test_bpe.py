import random

import pytest
import tiktoken

from riskbook.llm import bpe
from tests.llm.helpers import docs_frame

tokenizers = pytest.importorskip("public_tokenizers")
ALPHABET = ["a", "bc", " ", "  ", "\n", "\t", "'s", "'", "ß", "é", "漢字", "12", "½", "!!", "😀", " ", "́", "don't", "\r\n", "x" * 30, " " * 20, "١"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def reference(ranks):
    return tiktoken.Encoding("ref", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk, overlap", [(1, 1), (5, 2), (16, 8), (64, 16)])
def test_pieces_of_stitched_chunks_give_the_whole_texts_ids(ranks, chunk, overlap):
    rng, ref, enc = random.Random(chunk), reference(ranks), bpe.Encoder(ranks, tokenizers.PATTERN)
    for _ in range(120):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 60)))
        starts = range(0, len(text), chunk)
        chunks = [(s, enc.places(text[s:s + chunk + overlap], s, s + chunk + overlap >= len(text))) for s in starts]
        cuts = bpe.stitch(chunks, text, enc)
        ids = [i for a, b in zip(cuts[:-1], cuts[1:], strict=True) for i in enc.ids(text[a:b]).tolist()]
        assert ids == ref.encode_ordinary(text)


def test_round_trip_and_awkward_rows(spark, ranks):
    rng, ref = random.Random(8), reference(ranks)
    long = "".join(rng.choice(ALPHABET) for _ in range(900))
    texts = [(1, "plain text"), (2, None), (3, ""), (4, long), (4, long), (None, long + "!"), (6, "<|endoftext|>"), (7, "z" * 5_000), (8, " " * 3_000)]
    docs = docs_frame(spark, texts)
    got = bpe.decode(bpe.encode(docs, ranks, tokenizers.PATTERN, chunk_chars=100, overlap=20), ranks).collect()
    want = sorted(((i, ref.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts), key=str)
    assert sorted(((r["id"], r["ids"], bytes(r["decoded"])) for r in got), key=str) == want
    assert bpe.encode(docs.where("false"), ranks, tokenizers.PATTERN).count() == 0
