"""Token output and byte-level BPE against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from skein.llm import bpe, pretokens, rangecoder
from skein.llm.tokenbin import read_tokens, write_tokens

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"ab'strevmld  \n\t\r19é日😀.,!_ 　'", "'s", "'re", " '", "''"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_pieces_follow_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    for text in [*odd_texts(3000), "<|endoftext|>", "don't we'll I'd they've it's 'tis", "x" * 5000]:
        joined, points, bounds = pretokens.code_points([text])
        begin = [*pretokens.piece_starts(points, bounds).tolist(), len(points)]
        assert [joined[a:b] for a, b in zip(begin, begin[1:], strict=False)] == pattern.findall(text)


def test_bpe(docs, texts, empty):
    ranks = bpe.read_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: encoding.encode_ordinary(t or "") for i, t in (texts | {121: None}).items()}
    ids = bpe.bpe_encode(docs, RANKS)
    assert {r.doc_id: r.ids for r in ids.collect()} == want
    decoded = {r.doc_id: bytes(r.decoded) for r in bpe.bpe_decode(ids, RANKS).collect()}
    assert decoded == {i: (t or "").encode() for i, t in (texts | {121: None}).items()}
    for r in bpe.bpe_digests(docs, RANKS).collect():
        raw = np.array(want[r.doc_id], dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]), hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded[r.doc_id]).hexdigest()
    assert bpe.bpe_digests(empty, RANKS).count() == 0


def test_bpe_odd_texts_and_small_cache():
    ranks = bpe.read_ranks(RANKS)
    codec = bpe.Codec(bpe.model_proto(ranks))
    codec.pieces.limit = 200
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    many = odd_texts(800, seed=2)
    for begin in range(0, len(many), 50):
        part = many[begin : begin + 50]
        ids, bounds = codec.encode(part)
        for i, text in enumerate(part):
            own = ids[bounds[i] : bounds[i + 1]]
            assert own.tolist() == encoding.encode_ordinary(text)
            assert codec.decode(own) == text.encode()


def pieces_of(texts):
    return sorted({p for t in texts for p in regex.findall(public_tokenizers.PATTERN, t)})


def test_unseen_pieces_share_calls_of_the_library():
    """op5_token_output: a piece costs no call and no result object of its own."""
    tokenizer = Tokenizer.from_file(JSON)
    ids_of = pretokens.LibraryPieces(tokenizer)
    given, lists = [], ids_of._lists
    ids_of._lists = lambda texts: given.extend(texts) or lists(texts)
    words = pieces_of([" ".join(f"word{i}s" for i in range(3000)), *odd_texts(500, seed=3)])
    for pieces in (words, [w for w in words if not w.isspace()], [w for w in words if w.isspace()], ["\n"], ["a"], []):
        given.clear()
        ids, sizes = ids_of(pieces)
        want = [e.ids for e in tokenizer.encode_batch(pieces, add_special_tokens=False)]
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
        assert len(given) <= 1 + len(pieces) // pretokens.JOINED + sum(p.isspace() for p in pieces)


def test_a_full_cache_keeps_pieces_that_came_again():
    """op5_token_output: a full cache does not send its frequent pieces to the library again."""
    seen = []

    def encode(pieces):
        seen.extend(pieces)
        return pretokens.flattened([[len(p), *p.encode()] for p in pieces])

    cache = pretokens.PieceIds(encode, limit=100)
    for n in range(60):
        text = "the of " + " ".join(chr(97 + n % 26) * (n + 2) + chr(97 + i) * (i + 2) for i in range(20))
        want = [i for p in regex.findall(public_tokenizers.PATTERN, text) for i in (len(p), *p.encode())]
        ids, bounds = cache.ids([text, ""])
        assert ids.tolist() == want and bounds.tolist() == [0, len(want), len(want)]
        assert len(cache.keys) <= 100
    assert seen.count("the") == seen.count(" of") == 1
    assert len(seen) == 2 + 60 * 20


def test_places_with_crowded_homes():
    """Keys with one home and keys at the table's end are found, also after the table grew."""
    places, held = pretokens._Places(), {}
    for step in (1, 1 << 40, 1 << 46):
        keys = np.array([((1 << 64) - 1 - i * step) for i in range(300)], dtype=np.uint64)
        keys = np.array([k for k in keys.tolist() if k not in held], dtype=np.uint64)
        places.add(keys, np.arange(len(held), len(held) + len(keys), dtype=np.int32))
        held |= {k: len(held) + i for i, k in enumerate(keys.tolist())}
    many = np.random.default_rng(1).integers(1, 1 << 63, 100_000).astype(np.uint64)
    many = np.unique(many)
    assert (places.find(many) == -1).all()
    places.add(many, np.arange(1000, 1000 + len(many), dtype=np.int32))
    assert places.find(many).tolist() == list(range(1000, 1000 + len(many)))
    assert places.find(np.array(list(held), dtype=np.uint64)).tolist() == list(held.values())


@pytest.mark.parametrize("block_ids", [64, 1 << 20])
def test_token_table(spark, docs, texts, tmp_path, block_ids):
    path = str(tmp_path / "tokens")
    write_tokens(docs, path, JSON, end_id=2, block_ids=block_ids)
    tokenizer = Tokenizer.from_file(JSON)
    start = 0
    got = {r.doc_id: r for r in read_tokens(spark, path, with_ids=True).collect()}
    for i, t in sorted((texts | {121: None}).items()):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_added_tokens_are_the_librarys(spark, tmp_path):
    """The string of an added token is that token, as in the library's plain call."""
    texts = ["a <|endoftext|> b", "plain", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "<|endoftext"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    write_tokens(rows, str(tmp_path / "t"), JSON, end_id=2)
    tokenizer = Tokenizer.from_file(JSON)
    got = {r.doc_id: r.ids for r in read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect()}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert 50256 in got[0]


def test_token_table_odd_rows(spark, empty, tmp_path):
    write_tokens(empty, str(tmp_path / "none"), JSON, end_id=2)
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0
    rows = [(None, "b"), (1, "a"), (1, "a"), (0, "<|endoftext|>")]
    write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path / "t"), JSON, end_id=2)
    got = sorted((r.start, r.doc_id) for r in read_tokens(spark, str(tmp_path / "t")).collect())
    assert [x[1] for x in got] == [None, 0, 1, 1] and got[0][0] == 0


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 1000, 70_000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for vocabulary in (2, 300, 50_257):
        for ids in (rng.integers(0, vocabulary, n), np.minimum(rng.geometric(0.05, n), vocabulary) - 1, np.zeros(n, int), np.arange(n) % min(vocabulary, 7)):
            block = rangecoder.pack_block(np.arange(2), np.array([1, 0]), np.array([n, 0]), ids, vocabulary)
            keys, known, sizes, back = rangecoder.unpack_block(block)
            assert (back == ids).all() and len(back) == n
            assert keys.tolist() == [0, 1] and known.tolist() == [True, False] and sizes.tolist() == [n, 0]


def test_range_coder_codes_an_id_at_once(monkeypatch):
    """op5_token_output: outcome and order-0 share are one step of the coder; a full block comes back."""
    steps = []
    put = rangecoder._Coder.put
    monkeypatch.setattr(rangecoder._Coder, "put", lambda self, *a: steps.append(1) or put(self, *a))
    rng = np.random.default_rng(5)
    n = (1 << 20) + 1234
    ids = np.minimum(rng.zipf(1.2, n) - 1, 50_256)
    block = rangecoder.pack_block(np.arange(1), np.ones(1), np.array([n]), ids, 50_257)
    assert len(steps) == n // rangecoder.MOST_LANES + 1
    assert (rangecoder.unpack_block(block)[3] == ids).all()


def test_range_coder_finds_damage_and_predicts():
    block = bytearray(rangecoder.pack_block(np.arange(1), np.ones(1), np.array([50_000]), np.arange(50_000) % 11, 50_257))
    assert len(block) < 8_000  # a repeating run costs far less than its ids
    block[40] ^= 1
    with pytest.raises(ValueError):
        rangecoder.unpack_block(bytes(block))
