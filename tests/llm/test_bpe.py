import hashlib
import random
import struct

import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import bpe, queries

PATH = public.path("byte_bpe_multi_50k.tiktoken")
OURS = bpe.Bpe(PATH, public.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=OURS.ranks, special_tokens={})


def ids(data):
    return [x for (x,) in struct.iter_unpack("<I", data)]


def test_every_token_is_reached_by_merges():
    assert all(OURS.merge(t) == [t] for t in OURS.ranks)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab é日 '\n\t1!😀thion", max_size=200)))
def test_ids_equal_the_library_and_decode_back(text):
    got = OURS.encode_bytes(text)
    assert ids(got) == THEIRS.encode_ordinary(text)
    import numpy as np

    assert OURS.decode(np.frombuffer(got, "<u4")) == text.encode()


@pytest.mark.parametrize("text", ["a" * 4000, "thetion" * 900, "日本" * 900, "!" * 3000, " " * 2000, "ab" * 1500 + "é" * 1500])
def test_long_pieces(text):
    assert ids(OURS.encode_bytes(text)) == THEIRS.encode_ordinary(text)


def test_join_is_a_monoid_on_encodings():
    rng = random.Random(5)
    for _ in range(300):
        data = "".join(rng.choice("theioéna日 ") for _ in range(rng.randrange(60))).encode()
        i, j = sorted(rng.randrange(len(data) + 1) for _ in range(2))
        a, b, c = (OURS.tree(x) for x in (data[:i], data[i:j], data[j:]))
        assert OURS.join(OURS.join(a, b), c) == OURS.join(a, OURS.join(b, c)) == OURS.merge(data)


def test_query(spark, tmp_path):
    texts = [None, "", "the theta's 123  \n x", "same", "same", "<|endoftext|>", "é" * 5000]
    spark.createDataFrame([(i, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, ids binary").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op6_tree_bpe(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        want = THEIRS.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(want), hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert bpe.tokenise(docs.limit(0)).count() == 0


def test_most_tokens_come_through_joins():
    words = "internationalisation encodings neighbouring boundary windows stabilise reduction Donaudampfschifffahrt".split()
    seen = []
    ours, join = bpe.Bpe(PATH, public.PATTERN), bpe.Bpe.join
    ours.join = lambda left, right: seen.append((left, right)) or join(ours, left, right)
    for w in words:
        data = w.encode()
        whole = ours.piece(data)
        assert whole == ours.merge(data)
        if data not in ours.ranks:
            assert seen and len(b"".join(seen[-1][0] + seen[-1][1])) == len(data)


def test_decoding_goes_level_by_level():
    import numpy as np

    for n in (0, 1, 2, 3, 7, 64, 1001):
        picked = np.random.default_rng(n).integers(0, len(OURS.tokens), n)
        picked = np.array([i for i in picked if OURS.tokens[i] is not None], "<u4")
        assert OURS.decode(picked) == b"".join(OURS.tokens[i] for i in picked)


def test_empty_tables_ties_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x y", "a", 1), (1, "x y", "b", 2), (None, None, "c", 3)], "doc_id long, text string, decoded string, n_tokens int")
    got = bpe.tokenise(docs).collect()
    assert sorted(str((r["doc_id"], bytes(r["decoded"]))) for r in got) == sorted(str(x) for x in [(1, b"x y"), (1, b"x y"), (None, b"")])
    assert bpe.encode(docs.limit(0)).count() == bpe.tokenise(docs.limit(0)).count() == 0


def test_windows_of_two_tokens_are_merged_once():
    """Pieces of the same neighbours: what two of them give is merged once, however many joins meet them."""
    ours, merge, merged = bpe.Bpe(PATH, public.PATTERN), bpe.Bpe.merge, []
    ours.merge = lambda data: merged.append(bytes(data)) or merge(ours, data)
    words = [f"{a}{b}{c}".encode() for a in ("keitpf", "ungste", "mentea") for b in ("schau", "llrro", "ciónñ") for c in ("lichöß", "ngande", "fonath")]
    assert all(ours.tree(w) == merge(ours, w) for w in words)
    assert len(merged) < 1.2 * len(set(merged))
