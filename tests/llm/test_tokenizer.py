import random

import pytest
import regex

P = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from spanlake.llm.tokenizer import PATTERN, Coder, Vocabulary, decode, encode, token_counts  # noqa: E402
from tests.conftest import rows  # noqa: E402

ODD = [
    None, "", " ", "\n", "\r\n\t ", "x" * 3000, "ab" * 700, "aaa aaaa aaaaa", "<|endoftext|>", "naïve ½ ²³ ４５  　 x", "👩‍👩‍👧 é́", "   \n\n  a\t\tb  ", "'s'S'll''re", "a\0b﻿​", "Ελληνικά и кириллица", "…—“”ﬁſ", "1234567890123", "!!!???;;;---===", "word " * 5000,
]


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_as_the_public_library(spark, public):
    rng = random.Random(6)
    pool = [chr(c) for c in (*range(32, 127), *range(160, 400), 0x3B1, 0x4E2D, 0x1F600, 10, 13, 9)]
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 200))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a"), (3, "a"), (3, "a")], "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens").repartition(3)
    coded = encode(df)
    want = sorted([(i, public(t)) for i, t in enumerate(texts)] + [(3, public("a"))] * 2)
    got = [(r.doc_id, r.ids) for r in coded.collect()]
    assert sorted(x for x in got if x[0] is not None) == want and [x[1] for x in got if x[0] is None] == [public("a")]
    assert rows(token_counts(df).where("doc_id IS NOT NULL")) == [(i, len(x)) for i, x in want]
    back = {r.doc_id: r.text for r in decode(coded.where("doc_id > 3")).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts) if i > 3}
    assert encode(df.limit(0)).count() == 0


def test_every_token_and_both_files(public):
    a, b = Vocabulary(P.path("byte_bpe_50k.json")), Vocabulary(P.path("byte_bpe_50k.tiktoken"))
    assert sorted((x, y, z) for x, y, _, z in a.merges) == sorted((x, y, z) for x, y, _, z in b.merges)
    assert a.tokens == b.tokens
    assert all(regex.findall(PATTERN, t) == regex.findall(P.PATTERN, t) for t in ODD if t)


def test_another_vocabulary():
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t for t in ODD if t]
    ids, n = Coder(path).encode(texts)
    assert ids.tolist() == [i for t in texts for i in own.encode_ordinary(t)] and len(n) == len(texts)


def test_long_words():
    """A word of any length: the heap gives what the recursive query gives, and a very long one ends soon."""
    import random
    import time

    from spanlake.llm import tokenizer

    path = f"{tokenizer.TOKENIZERS}/{tokenizer.VOCABULARY}"
    rng = random.Random(3)
    words = ["".join(rng.choice(a) for _ in range(rng.randint(1, 140))) for a in ("etaoin", "ab", "aaab", "thequickbrown", "éß漢") for _ in range(12)]
    c = tokenizer.Coder(path)
    c.learn(iter(words))
    assert [c.merged([int(c.bytes[b]) for b in w.encode()]) for w in words] == [c.known[w] for w in words]
    began = time.time()
    ids, _ = c.encode(["a" * 300_000 + " " + "etaoin" * 50_000])
    assert time.time() - began < 60 and c.decode(tokenizer.pa.array([ids.tolist()], tokenizer.pa.list_(tokenizer.pa.int32()))) == ["a" * 300_000 + " " + "etaoin" * 50_000]
