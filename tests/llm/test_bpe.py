import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from limnos.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_matches_the_library(odd, none, make, text_of, library):
    shared = text_of(9, 400)
    docs = make([(100 + k, text_of(k, 50) + " " + shared + " " + text_of(k + 50, 30)) for k in range(6)]).unionByName(odd)
    got = bpe.encode_decode(docs, PATH).collect()
    want = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert sorted(r.decoded for r in got) == sorted(r.text or "" for r in docs.collect())
    one = {r.doc_id: r for r in bpe.digests(bpe.encode_decode(docs, PATH)).collect()}[100]
    ids = library.encode(docs.filter("doc_id = 100").first().text, add_special_tokens=False).ids
    assert (one.n_tokens, one.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert bpe.encode_decode(none, PATH).count() == 0


def test_joins_at_any_place(library):
    c, r = bpe.codec(PATH), random.Random(4)
    bits = ["a", "b", " ", "  ", "\n", "'s", "'", "é", "ß", " \n ", "1", "23", ".", "!", " ", "the", "ing", "日本", "😀", "\t", "<|endoftext|>"]
    for _ in range(1_500):
        text = "".join(r.choice(bits) for _ in range(r.randrange(40)))
        pieces = []
        for x in c.parted(text):
            if isinstance(x, int):
                pieces.append(x)
            else:
                u = x.decode()
                cuts = sorted(r.randrange(len(u) + 1) for _ in range(3))
                pieces += [c.encode(u[i:j].encode()) for i, j in zip([0, *cuts], [*cuts, len(u)], strict=True)]
        assert bpe._tokens(c, pieces).tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks_follow_content(text_of):
    body = text_of(3, 3_000).encode()
    a, b = bpe.chunks(body), bpe.chunks(b"something else before it " + body)
    assert b"".join(a) == body and len(set(a) & set(b)) > 0.8 * len(a)
