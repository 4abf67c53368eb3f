import os

import pytest

from tacitra.llm.tokenize import DEFAULT_RANKS, PATTERN, MergeTable, encode_batch, encode_corpus, read_ranks

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_RANKS), reason="no vocabulary file here")
TEXTS = ["", None, " ", "Hello world", "aaaaaaaaaaaaaaaaaaaaaaa", "<|endoftext|> is text", "naïve café — “quoted” 日本語 🙂🙂", "a\n\n\tb   c", "1234567 12.5%", "x" * 5000 + " " + "ab" * 3000, "don't we'll I'VE", "\x00�", "=" * 700]


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(DEFAULT_RANKS), special_tokens={})


def test_against_a_library(encoding):
    for chunk in (1, 50, 1 << 20):
        ids, at = encode_batch(MergeTable(read_ranks(DEFAULT_RANKS)), TEXTS, chunk)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [encoding.encode_ordinary(t) if t else [] for t in TEXTS]


def test_round_trip(encoding, spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, "Hello world", 1)], "doc_id bigint, text string, ids int")
    rows = encode_corpus(df, "doc_id", "text").collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert encoding.decode(r.ids) == (TEXTS[r.doc_id] or "")
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_slices_hold_every_row():
    import numpy as np

    from tacitra.llm.tokenize import slices

    for sizes in ([], [0, 0, 0], [5, 1, 9, 30, 0, 0, 2], [100]):
        cut = list(slices(np.array(sizes, int), 10))
        assert [i for at, n in cut for i in range(at, at + n)] == list(range(len(sizes)))
        assert all(n == 1 or sum(sizes[at : at + n]) <= 10 for at, n in cut)
