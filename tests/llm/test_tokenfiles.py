import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rillwork.llm import tokenfiles
from rillwork.llm._shared import materialize, scratch

PATH = P.path("word_bpe_49k.json")
THEIRS = Tokenizer.from_file(PATH)
MEMO = tokenfiles.WordMemo(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAé \n\t́̈　 \x85'sΣς1١!<|>가", max_size=40))
def test_memo_equals_the_library_on_whole_texts(text):
    ids, ends = MEMO.encode(pa.array([text, None, text]))
    expected = THEIRS.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == expected * 2 and ends.tolist() == [len(expected), len(expected), 2 * len(expected)]


MARKS = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "a", "Z", "1", " ", "\n", "\t", ".", "|", "<", "é", "e\u0301"])


@settings(max_examples=300, deadline=None)
@given(st.lists(MARKS, max_size=12), st.lists(MARKS, max_size=12))
def test_marks_inside_beside_and_between_words(one, other):
    texts = ["".join(one), "plain words.", "".join(other)]
    ids, ends = MEMO.encode(pa.array(texts))
    expected = [THEIRS.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [x for e in expected for x in e] and ends.tolist() == np.cumsum([len(e) for e in expected]).tolist()


def test_a_mark_is_one_id():
    ids, _ = MEMO.encode(pa.array(["a<|endoftext|>b<|startoftext|>"]))
    assert ids.tolist() == [320, 49407, 321, 49406]


def test_memo_forgets_long_strings(monkeypatch):
    monkeypatch.setattr(tokenfiles, "MEMO_LETTERS", 1000)
    memo = tokenfiles.WordMemo(PATH)
    for k in range(6):
        texts = [f"{k}{'!?x' * 300}", "a"]
        assert memo.encode(pa.array(texts))[0].tolist() == [x for t in texts for x in THEIRS.encode(t, add_special_tokens=False).ids]
        assert memo.letters < 2000


def test_memo_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(tokenfiles, "MEMO", 50)
    memo = tokenfiles.WordMemo(PATH)
    for k in range(5):
        texts = [f"word{i} Straße{i}, été. x.{k} " + "Éa" * i for i in range(k * 7, k * 7 + 20)]
        ids, ends = memo.encode(pa.array(texts))
        assert ids.tolist() == [x for t in texts for x in THEIRS.encode(t, add_special_tokens=False).ids]
        assert len(memo.known) < 200


def expected(rows):
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*THEIRS.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK_DOCS", 7)
    rows = [(i * 3, f"the river {i} runs " * (i % 9)) for i in range(200)] + [(1000, None), (1001, ""), (1002, "same"), (None, "null id"), (1003, "long " * 50000)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, crc int")
    path = scratch(spark, "test-files")
    tokenfiles.write_token_files(materialize(tokenfiles.tokenize(docs, PATH, 1), "tokens"), path, tokenfiles.id_width(PATH))
    got = tokenfiles.read_token_files(spark, path).collect()
    mine = sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in got), key=lambda r: r[1])
    assert mine == expected(rows)
    one = tokenfiles.read_token_files(spark, path, doc_id=300).collect()
    assert [(r.start, r.n_tokens) for r in one] == [x[1:3] for x in expected(rows) if x[0] == 300]
    assert len({r.dict_hash for r in spark.read.parquet(f"{path}/blocks").collect()}) == 1


def test_ties_repeats_and_empty_table(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (0, "x")]
    for some in (rows, []):
        path = scratch(spark, "test-files")
        docs = spark.createDataFrame(some, "doc_id long, text string")
        tokenfiles.write_token_files(materialize(tokenfiles.tokenize(docs, PATH, 1), "tokens"), path, tokenfiles.id_width(PATH))
        got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenfiles.read_token_files(spark, path).collect())
        assert got == [(2 * i, d, 2) for i, d in enumerate(sorted(d for d, _ in some))]
