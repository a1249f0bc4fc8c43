"""op3 against tiktoken on texts made to break pre-tokenisation."""

import random

import pytest

pt = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402

from aerolith.llm import bpe  # noqa: E402

NAME = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=bpe.vocabulary(NAME).ranks, special_tokens={})


def check(texts, reference):
    for t, ids in zip(texts, bpe.encode(texts, NAME)):
        assert ids.tolist() == reference.encode_ordinary(t), repr(t[:80])
        data, offsets = bpe.decode(ids, NAME)
        assert data == t.encode()
        assert len(offsets) == len(ids) and (not len(ids) or offsets[0] == 0)


def test_made_up_texts(reference):
    rng = random.Random(3)
    alphabet = "'''  \n\t 　stmdrevlaéß中12²!?.’é👍‍STX"
    texts = ["", " ", "  ", "'s's", "!'s", "  's", "\n's", "''re", "'ll've'd'mX", "a'rex 'lx", "x 's", " \n a", "don't  stop"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    check(texts, reference)


def test_long_runs_and_chunk_edges(reference):
    rng = random.Random(5)
    check(["ab" * 3000, " " * 5000 + "x", "é" * 2000, "".join(rng.choice("ab 'sre\n") for _ in range(300_000)), "q" * 401], reference)


def test_every_assigned_codepoint_alone(reference):
    import unicodedata

    points = [c for c in range(0x30000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    check([" " + chr(c) + "a1!" for c in points[:: 3 if len(points) > 60000 else 1]], reference)


def test_rows(spark):
    frame = spark.createDataFrame([(1, "It's here"), (1, "It's here"), (None, None), (3, "")], "doc_id long, text string")
    rows = [tuple(r) for r in frame.select("doc_id", bpe.digests(NAME)("text").alias("d")).select("doc_id", "d.*").collect()]
    assert len(rows) == 4 and rows[0] == rows[1] and rows[2][1:] == rows[3][1:] and rows[3][1] == 0
    both = frame.select(bpe.decoded(NAME)(bpe.encoded(NAME)("text")).alias("d")).collect()
    assert bytes(both[0][0][0]) == b"It's here"


def test_nothing_and_clashing_columns(spark):
    odd = spark.createDataFrame([(1, "a long " * 50_000, "x", 7)], "doc_id long, text string, ids string, n_tokens int")
    row = odd.select("doc_id", "ids", bpe.digests(NAME)("text").alias("d")).first()
    assert row["d"]["n_tokens"] == len(bpe.encode(["a long " * 50_000], NAME)[0]) and row["ids"] == "x"
    assert odd.limit(0).select(bpe.digests(NAME)("text").alias("d")).select("d.*").collect() == []
