"""Packing, plane files and byte-level BPE against the libraries."""

import hashlib
import io
import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe, chunks, packing, planes

HARD = [None, "", " ", "  a", "a  b", "a \n b\n\n c", "\n", "x\n y", "tab\t z", "é́   b", "<|endoftext|> a", "a <|endoftext|> b", "a<|endoftext|>\n\n<|startoftext|>x", "<|ENDOFTEXT|> <| endoftext|>", "İstanbul ΣΑΣ", " lead", "trail ", "a\x1cb \x85 c", "don't I'll", "日本語 テスト", "½ a²b ªµº", "a\xadb", "a" * 3000, "word " * 3000, "\x00\x00 x", "😀 a😀b"]
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(HARD)] + [(None, "no id", "y"), (3, "twice, and at more length than its namesake", "z")], "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def library(path, plain_text=False):
    found = Tokenizer.from_file(path)
    if plain_text:
        found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def pieces_of(rows):
    return [np.frombuffer(r, "<u4").tolist() for r in rows]


PARTS = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,aBé̈1½ſ<|"), st.characters(codec="utf-8")), max_size=40)
TOKENS = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "<", " "])


@pytest.mark.parametrize("plain_text", [False, True])
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunked_ids_are_the_library_s(path, plain_text):
    table, encode = chunks.tokenizer_table(path, plain_text=plain_text), library(path, plain_text)

    @given(st.lists(PARTS | TOKENS, max_size=4).map("".join))
    @settings(max_examples=300, deadline=None)
    def check(text):
        assert np.frombuffer(table.joined(text), "<u4").tolist() == encode(text)

    check()
    for text in HARD:
        assert np.frombuffer(table.joined(text or ""), "<u4").tolist() == encode(text)


def test_tokenizers_of_another_kind_go_to_the_library_whole(tmp_path):
    """Its pieces run across spaces and newlines, and its added token starts with a letter."""
    from tokenizers import AddedToken, Regex, pre_tokenizers

    own = Tokenizer.from_file(BYTE)
    own.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"\s+|\S+"), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    own.add_tokens([AddedToken("end of", normalized=False)])
    own.save(str(tmp_path / "own.json"))
    table, encode = chunks.tokenizer_table(str(tmp_path / "own.json")), library(str(tmp_path / "own.json"))
    for text in ("a \n b", "the end of it", "x\n\ny z"):
        assert np.frombuffer(table.joined(text), "<u4").tolist() == encode(text)


def test_table_forgets_and_stays_right():
    table, encode = chunks.tokenizer_table(BYTE, limit=3), library(BYTE)
    for text in ("one two three four five six", "two three two one", "six one four two one"):
        assert np.frombuffer(table.joined(text), "<u4").tolist() == encode(text)


def test_bpe_is_tiktoken_s(ranks):
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = bpe.encoder(bpe.Vocabulary(ranks), public_tokenizers.PATTERN)

    @given(st.text(alphabet=st.one_of(st.sampled_from("abehint rs\n.,'é日"), st.characters(codec="utf-8")), max_size=60))
    @settings(max_examples=300, deadline=None)
    def check(text):
        assert np.frombuffer(table.joined(text), "<u4").tolist() == reference.encode_ordinary(text)

    check()
    for text in HARD:
        assert np.frombuffer(table.joined(text or ""), "<u4").tolist() == reference.encode_ordinary(text or "")


def merged_by_rank(letters, ranks):
    tokens = list(letters)
    while True:
        pairs = [(ranks[tokens[k] + tokens[k + 1]], k) for k in range(len(tokens) - 1) if tokens[k] + tokens[k + 1] in ranks]
        if not pairs:
            return tokens
        _, k = min(pairs)
        tokens[k : k + 2] = [tokens[k] + tokens[k + 1]]


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=14), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_merging_by_rank(letters, seed):
    """For vocabularies as training makes them: a token's parts are what merging its bytes had given before."""
    rng = random.Random(seed)
    ranks = {b"a": 0, b"b": 1, b"c": 2}
    for _ in range(20):
        pair = rng.choices(list(ranks), k=2)
        new = b"".join(pair)
        if new not in ranks and merged_by_rank([new[k : k + 1] for k in range(len(new))], ranks) == pair:
            ranks[new] = len(ranks)
    assert bpe.Vocabulary(ranks).encode(b"".join(letters)) == [ranks[t] for t in merged_by_rank(letters, ranks)]


def test_encode_decode(spark, docs, ranks):
    rows = bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN).collect()
    assert len(rows) == docs.count()
    texts = sorted((r["text"] or "" for r in docs.collect()))
    assert sorted(bytes(r["decoded"]).decode() for r in rows) == texts
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_decode(docs.where("doc_id = 16"), ranks, public_tokenizers.PATTERN, then=bpe.digests, schema=bpe.DIGESTS).collect():
        ids = reference.encode_ordinary(HARD[16])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.encode_decode(docs.limit(0), ranks, public_tokenizers.PATTERN).collect() == []


@given(st.lists(st.integers(1, 300), max_size=40), st.sampled_from([16, 64]))
@settings(max_examples=200, deadline=None)
def test_assign_places_everything_once(lengths, capacity):
    pieces, sizes, cost = packing.assign(lengths, capacity, 1.0, 0.01)
    assert all(s == capacity or s & (s - 1) == 0 for s in sizes) and sum(sizes) == sum(lengths)
    for d, n in enumerate(lengths):
        own = sorted((at, put) for e, at, put, *_ in pieces if e == d)
        assert [at for at, _ in own] == [sum(p for _, p in own[:k]) for k in range(len(own))] and sum(p for _, p in own) == n
    for s, size in enumerate(sizes):
        own = sorted((o, put) for *_, put, t, o in pieces if t == s)
        assert [o for o, _ in own] == [sum(p for _, p in own[:k]) for k in range(len(own))] and sum(p for _, p in own) == size
    assert abs(sum(cost) - sum(put + 0.01 * put * put for _, _, put, _, _ in pieces)) < 1e-6


def assigned_plainly(lengths, capacity, linear, quadratic):
    """Look through all sequences for each piece: the largest piece goes to the cheapest sequence with room, else what fits to the cheapest with any."""
    sizes = packing.sequence_sizes(sum(lengths), capacity)
    room, cost, pieces = sizes.copy(), [0.0] * len(sizes), []
    waiting = [(min(n - at, capacity), d, at) for d, n in enumerate(lengths) for at in range(0, n, capacity)]
    while waiting:
        length, d, at = min(waiting, key=lambda w: (-w[0], w[1], w[2]))
        waiting.remove((length, d, at))
        some = [s for s in range(len(sizes)) if room[s] >= length] or [s for s in range(len(sizes)) if room[s]]
        s = min(some, key=lambda s: (cost[s], room[s], s))
        put = min(length, room[s])
        pieces.append((d, at, put, s, sizes[s] - room[s]))
        room[s] -= put
        cost[s] += linear * put + quadratic * put * put
        if put < length:
            waiting.append((length - put, d, at + put))
    return pieces, sizes, cost


@given(st.lists(st.integers(1, 150), max_size=30), st.sampled_from([16, 64]), st.sampled_from([(1.0, 0.01), (0.0, 1.0), (1.0, 0.0)]))
@settings(max_examples=200, deadline=None)
def test_assign_is_the_plain_greedy_rule(lengths, capacity, rates):
    assert packing.assign(lengths, capacity, *rates) == assigned_plainly(lengths, capacity, *rates)


def test_assign_balances_cost():
    rng = random.Random(2)
    lengths = [rng.randrange(20, 700) for _ in range(400)]
    _, sizes, cost = packing.assign(lengths, 1024, 1.0, 1 / 1024)
    full = [c for c, s in zip(cost, sizes, strict=True) if s == 1024]
    order = sorted(range(len(full)), key=lambda k: full[k])
    naive, at = [0.0] * len(sizes), 0
    for n in lengths:  # in the order of the documents, cut where a sequence ends
        while n:
            put = min(n, 1024 - at % 1024)
            naive[at // 1024] += put + put * put / 1024
            at, n = at + put, n - put
    assert np.std(full) < 0.5 * np.std(naive[: len(full)]) and len(order) == len(full)


def test_pack(spark, docs):
    rows = packing.pack(docs, BYTE, capacity=64, end_id=0).collect()
    encode = library(BYTE)
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    expected = sorted(crc32(np.array([*encode(t), 0], "<u4").tobytes()) for _, t in texts)
    by_document = {}
    for r in rows:
        by_document.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], bytes(r["ids"])))
    got = []
    for (_, n), own in by_document.items():
        own.sort()
        assert [s for s, _, _ in own] == [sum(x for _, x, _ in own[:k]) for k in range(len(own))] and sum(x for _, x, _ in own) == n
        got.append(crc32(b"".join(i for *_, i in own)))
    assert sorted(got) == expected
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_tokens"]))
    for own in by_sequence.values():
        own.sort()
        size = own[0][2]
        assert size == 64 or size & (size - 1) == 0
        assert [o for o, _, _ in own] == [sum(x for _, x, _ in own[:k]) for k in range(len(own))] and sum(x for _, x, _ in own) == size
    assert packing.pack(docs.limit(0), BYTE).collect() == []


@pytest.mark.parametrize("bits", [False, True])
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=10), st.sampled_from([1, 7, 64]))
@settings(max_examples=80, deadline=None)
def test_planes_round_trip(bits, documents, block):
    file = io.BytesIO()
    writer = planes.Writer(file, bits, block)
    for k, ids in enumerate(documents):
        writer.add(k, np.array(ids, "<u4").tobytes())
    writer.close()
    reader = planes.Reader(file, len(file.getvalue()))
    assert [(k, np.frombuffer(i, "<u4").tolist()) for k, i in reader.documents()] == list(enumerate(documents))
    every = [x for ids in documents for x in ids]
    for k in range(len(reader.index["blocks"])):
        assert reader.block(k).tolist() == every[k * block : (k + 1) * block]


def test_planes_leave_out_high_planes_and_refuse_other_files():
    ids = np.arange(300, dtype="<u4")
    assert len(planes.shuffle_block(ids)) == 2 and len(planes.shuffle_block(ids, True)) == 9
    with pytest.raises(ValueError):
        planes.Reader(io.BytesIO(b"x" * 40), 40)


@pytest.mark.parametrize("bits", [False, True])
def test_files_hold_documents_in_order(spark, docs, tmp_path, bits):
    manifest = planes.write(docs, WORD, f"file://{tmp_path}/ids", end_id=2, bits=bits)
    rows = sorted((tuple(r) for r in planes.read(spark, manifest).collect()), key=lambda r: r[1])
    encode = library(WORD)
    ordered = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, np.int64(np.uint64(42 if r[1] is None else xxhash.xxh64_intdigest(r[1].encode(), 42)))))
    start = 0
    for (key, begin, ids), (doc_id, text) in zip(rows, ordered, strict=True):
        expected = [*encode(text), 2]
        assert (key, begin, np.frombuffer(ids, "<u4").tolist()) == (doc_id, start, expected)
        start += len(expected)
    small = planes.write(docs, WORD, f"file://{tmp_path}/small", end_id=2, bits=bits, file_ids=40)
    assert sorted((tuple(r) for r in planes.read(spark, small).collect()), key=lambda r: r[1]) == rows and small.count() > 4
    empty = planes.write(docs.limit(0), WORD, f"file://{tmp_path}/none")
    assert planes.read(spark, empty).collect() == []
