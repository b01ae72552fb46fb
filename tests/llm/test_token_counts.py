import random

import pyarrow.parquet as pq
import pytest

from lodestar.llm import token_counts as tc


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    pieces = tc.vocabulary()
    extra = [("<unk>", 0.0)] + [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    # Bytes must be in the library's vocabulary but never match as text.
    low = min(s for _, s in pieces)
    library = tokenizers.Tokenizer(tokenizers.models.Unigram([(p, low) for p, _ in extra] + pieces, 0, True))
    library.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement=tc.SPACE, prepend_scheme="always", split=True)
    return tc.Counter(pieces), library


def same(both, text):
    counter, library = both
    assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids), text[:200]


def test_equals_library_on_documents(both):
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist():
        same(both, t)


def test_equals_library_on_odd_texts(both):
    r = random.Random(4)
    for t in ["", " ", "  ", "a", " a", "a  b", "\n", "a\nb\t c", "日本語🙂🙂x", "▁", "é́", "x" * 500]:
        same(both, t)
    for _ in range(3000):
        same(both, "".join(r.choices("ab eTh\né🙂日▁.1", k=r.randint(0, 24))))
