import random
from pathlib import Path

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.llm.encode import CorpusEncoder, TrieEncoder, encode_corpus, read_ranks
from tilewright.llm.queries import PATTERN, TOKENIZERS

FILE = Path(TOKENIZERS) / "byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not FILE.exists(), reason="needs the vocabulary")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(FILE.read_bytes())


@pytest.fixture(scope="module")
def plain(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours(ranks):
    return CorpusEncoder(ranks, PATTERN)


def test_words_against_plain_merges(ranks, plain):
    r = random.Random(1)
    words = {bytes(r.choice(b"abetnio\xc3\xa9 ") for _ in range(r.randint(1, 24))) for _ in range(3000)} | {b"a" * 500, b" ", b"\n" * 40}
    got = TrieEncoder(ranks).encode(list(words))
    assert got == {w: plain._encode_single_piece(w) for w in words}


PIECES = st.sampled_from(["a", " ", "  ", "\n", "\t", "é", "漢字", "\u00a0", "'s", "'", "!!", "12", "½", "😀", "\x00", "the", "<|endoftext|>", "\\alpha", "\r\n", "ٱل\u0652"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(PIECES, max_size=12).map("".join), st.text(max_size=8)), max_size=6))
def test_texts_against_the_library(ours, plain, texts):
    texts = [t and t.encode("utf-8", "ignore").decode() for t in texts]
    assert ours.batch(pa.array(texts, pa.string())).to_pylist() == [plain.encode_ordinary(t or "") for t in texts]


def test_very_long_text(ours, plain):
    for t in ("word " * 50_000, "x" * 30_000, " " * 5000 + "a"):
        assert ours.batch(pa.array([t])).to_pylist() == [plain.encode_ordinary(t)]


def test_corpus(spark, plain):
    texts = ["Hello  world", None, "", "Hello  world", " lead", "trail "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("r", F.lit(1)).withColumn("t", F.lit("x"))
    got = {r.doc_id: r.ids for r in encode_corpus(df, "doc_id", "text", str(FILE), PATTERN).collect()}
    assert got == {i: plain.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert encode_corpus(df.limit(0), "doc_id", "text", str(FILE), PATTERN).collect() == []
