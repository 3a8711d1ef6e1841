import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorekeep.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n", "Hello world", "Hello  world \n\n  it's   we'll\tdon't ", "a\x1cb\x85c　d  e", "éàü ñandú 東京 12³ ½x ٣", "a <|endoftext|> b<|endoftext|><|endoftext|>c  <|endoftext|>  d",
    "🙂👍🏽 x", "word " * 5000, "x" * 3000, " 's 'S 're\n're", "A\r\nB\r\n\r\n C\x0b\x0cD", "tie tie", "tie tie", "é ​z   q",
]


#: The words of the pre-tokenizer's pattern, joined where white space doesn't part them.
S = "".join(map(chr, bpe.SPACES))
WORD = re.compile(f" ?[^{S}]+|[{S}]+(?![^{S}])|[{S}]+")


@given(st.lists(st.text("ab \n\u3000é🙂", max_size=12), max_size=6))
def test_words_as_by_pattern(texts):
    words, codes, n = bpe.numbered([(t, False) for t in texts])
    assert [words[i] for i in codes] == [w for t in texts for w in WORD.findall(t)] and n.tolist() == [len(WORD.findall(t)) for t in texts]


@pytest.mark.parametrize("chars, words, kept", [(1 << 21, 2_000_000, 500_000), (8, 1, 2), (64, 40, 500_000)])
def test_parts_and_blocks(monkeypatch, chars, words, kept):
    """Texts in parts, small blocks and buckets that forget give the same as the library's."""
    monkeypatch.setattr(bpe, "SLICE_CHARS", chars), monkeypatch.setattr(bpe, "BLOCK_WORDS", words), monkeypatch.setattr(bpe, "KEPT_WORDS", kept)
    v, texts = bpe.Vocabulary(PATH), [t or "" for t in TEXTS] + ["a b c " * 30 + "<|endoftext|>  x " * 9]
    rows = [[r for b in (*(b for i, t in enumerate(texts) for b in blocks.add(i, t)), blocks.close()) for r in b] for blocks in (bpe.Blocks(v, 0, 7), bpe.Blocks(v, 0))]
    batch = lambda rows, names: pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    ids = [r for b in bpe._encoded_words(v.spec, [batch(sorted(rows[0]), ["bucket", "block", "mark", "slots", "words"])]) for r in b.to_pylist()]
    both = [(r["block"], 0, r["mark"], None, None, None, r["slots"], r["data"]) for r in ids] + [(*r[:6], None, r[6]) for r in rows[1]]
    both.sort(key=lambda r: r[:2])
    found = bpe._documents(v, False, [batch(both, ["block", "rank", "mark", "keys", "sizes", "open", "slots", "data"])], ["doc_id", "ids", "decoded"], [pa.int64(), pa.binary(), pa.binary()])
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    got = {r["doc_id"]: (np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"].decode()) for b in found for r in b.to_pylist()}
    assert got == {i: (t.encode(x, add_special_tokens=False).ids, x) for i, x in enumerate(texts)}


def test_as_the_library(spark):
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    rows = [(i if i != 7 else None, x, "extra") for i, x in enumerate(TEXTS)] + [(14, "tie tie", "extra")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    want = []
    for d, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(df, PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    r = bpe.encode(df, PATH).collect()[0]
    assert bytes(r.decoded) == b"one two" and np.frombuffer(r.ids, "<u4").tolist() == Tokenizer.from_file(PATH).encode("one two").ids
    assert bpe.digests(df.limit(0), PATH).count() == 0
