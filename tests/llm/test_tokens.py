import zlib

import numpy as np
import pytest
from helpers import SCHEMA, documents, table
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import tokens
from tidewatch.llm.queries import vocabulary


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=70))
@settings(max_examples=200, deadline=None)
def test_coding_round_trip(values):
    control, data = tokens.pack(np.array(values, dtype=np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)
    assert tokens.unpack(control, data, len(values)).tolist() == values


def test_damaged_bytes_are_refused():
    control, data = tokens.pack(np.array([1, 70000, 3], dtype=np.uint32))
    with pytest.raises(ValueError):
        tokens.unpack(control, data[:-1], 3)
    with pytest.raises(ValueError):
        tokens.unpack(control + b"\0", data, 3)


def test_digest_equals_whole_text_tokenizing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    got = sorted(tuple(r) for r in tokens.digest(table(spark), vocabulary()).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    want, start = [], 0
    for i, text, *_ in sorted(documents(), key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_ids_come_back_and_ranks_follow_counts(spark):
    files = tokens.write_files(table(spark), vocabulary())
    read = tokens.read_files(files, with_ids=True).collect()
    counts = np.bincount(np.concatenate([r["ids"] for r in read]))
    assert files.order == sorted(np.flatnonzero(counts).tolist(), key=lambda i: (-counts[i], i))
    keys = [r["key"] for r in files.documents.orderBy("bucket").collect()]
    assert sorted(keys) == sorted(r[0] for r in documents())


def test_empty_table(spark):
    assert tokens.digest(spark.createDataFrame([], SCHEMA), vocabulary()).count() == 0
