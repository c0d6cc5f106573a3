import functools
import hashlib
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tideline.llm import bitplanes, byte_bpe, packing, tokens
from tideline.session import Scratch


@functools.cache
def library(name):
    tokenizer = Tokenizer.from_file(P.path(name))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def specs():
    return {
        "byte": tokens.read_tokenizer(P.path("byte_bpe_50k.json")),
        "word": tokens.read_tokenizer(P.path("word_bpe_49k.json")),
        "ranks": byte_bpe.model_from_ranks(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN),
    }


ODD = st.text(alphabet=st.sampled_from("aAbZé漢🙂ΣςĲ'st re ll\0\t\n\r\x0b\x0c\x1c\x1f\x85 　́‍12!?<|>"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(text=ODD | st.text(max_size=30))
def test_chunks_give_the_ids_of_the_whole_text(specs, text):
    text = text.encode("utf-8", "replace").decode()
    for spec, name, keep in (("byte", "byte_bpe_50k.json", True), ("word", "word_bpe_49k.json", False)):
        got = tokens.encoder(specs[spec], keep).encode([text, None, "a  b", text])
        assert got[0].tolist() == got[3].tolist() == library(name)(text) and not len(got[1])


@settings(max_examples=400, deadline=None)
@given(text=ODD | st.text(max_size=30))
def test_ranks_give_the_ids_of_tiktoken(specs, text):
    text = text.encode("utf-8", "replace").decode()
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    own = _tiktoken(ranks)
    (found,) = tokens.encoder(specs["ranks"], True).encode([text])
    ids = found.tolist()
    assert ids == own.encode_ordinary(text)
    assert byte_bpe.decode_bytes(ids, byte_bpe.byte_table(specs["ranks"])) == text.encode()


_OWN = {}


@pytest.mark.parametrize('text', ['a \0b', '\0', '\0\0 x', ' \n', 'a\n\nb', ' a', 'a ', '\na', 'a\n'])
def test_marks_in_texts(specs, text):
    (found,) = tokens.encoder(specs['byte'], True).encode([text])
    assert found.tolist() == library('byte_bpe_50k.json')(text)


def _tiktoken(ranks):
    if "own" not in _OWN:
        _OWN["own"] = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _OWN["own"]


def test_decoding_handles_split_characters(specs):
    table, text = byte_bpe.byte_table(specs["ranks"]), "漢字🙂 naïve"
    (ids,) = tokens.encoder(specs["ranks"], True).encode([text])
    assert "".join(byte_bpe.decode_stream([[i] for i in ids.tolist()], table)) == text
    starts, chars = byte_bpe.offsets(ids, text, table)
    assert starts[0] == 0 and all(len(text[:c].encode()) <= s for s, c in zip(starts.tolist(), chars.tolist(), strict=True))


def test_round_trip_query(docs, specs):
    own = _tiktoken(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs, specs["ranks"]).collect())
    want = []
    for row in docs.collect():
        ids = own.encode_ordinary(row.text or "")
        want.append(
            (row.doc_id or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest())
        )
    assert got == sorted(want)
    again = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, specs["ranks"]), specs["ranks"])
    assert sorted(r.text for r in again.collect()) == sorted(r.text or "" for r in docs.collect())


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes_and_shards_round_trip(mode):
    draw = np.random.default_rng(3)
    for n in (1, 7, 8, 1000):
        ids = draw.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert (bitplanes.from_planes(bitplanes.to_planes(ids, bitplanes.MODES[mode]), n, bitplanes.MODES[mode]) == ids).all()
    parts = [draw.integers(0, 50000, n).astype("<u4") for n in (0, 1, 5000, 64, 3)]
    payload = bitplanes.write_shard([5, None, 7, -1, 7], parts, mode, block=512)
    back = list(bitplanes.read_shard(payload))
    assert [d for d, _ in back] == [5, None, 7, -1, 7]
    assert all((a == b).all() for (_, a), b in zip(back, parts, strict=True))
    with pytest.raises(ValueError):
        list(bitplanes.read_shard(b"XXXX" + payload[4:]))


def test_token_files(spark, docs, specs):
    encode = library("word_bpe_49k.json")
    got = bitplanes.read_token_files(bitplanes.write_token_files(docs, specs["word"], 2)).orderBy("start").collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in docs.collect())
    start, want = 0, []
    for (known, doc_id), text in rows:
        ids = [*encode(text), 2]
        want.append((doc_id if known else None, start, len(ids), crc(ids)))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    empty = bitplanes.read_token_files(bitplanes.write_token_files(docs.limit(0), specs["word"], 2))
    assert empty.count() == 0


def check_packing(got, docs, encode):
    pieces = defaultdict(list)
    for r in got:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
    for row in docs:
        ids = [*encode(row.text or ""), 1]
        own = sorted((r.start, r.length, r.ids_crc32) for r in pieces[(row.doc_id, len(ids))])
        copies = sum(1 for d in docs if d.doc_id == row.doc_id)
        spans = sorted({(s, n) for s, n, _ in own}) if copies == 1 else None
        if spans is not None:
            assert spans[0][0] == 0 and sum(n for _, n in spans) == len(ids)
            assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert all(c == crc(ids[s : s + n]) for s, n, c in own)
        assert sum(n for _, n, _ in own) == copies * len(ids)
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    for k, spans in windows.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        filled = spans[-1][0] + spans[-1][1]
        assert filled <= 2048 and (filled == 2048 or k == len(windows) - 1)


def test_packing(spark, docs, specs, sf_dir):
    encode = library("byte_bpe_50k.json")
    check_packing(packing.pack(docs, specs["byte"]).collect(), docs.collect(), encode)
    assert packing.pack(docs.limit(0), specs["byte"]).count() == 0
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_packing(packing.pack(whole, specs["byte"]).collect(), whole.collect(), encode)
    uneven = packing.pack(whole, specs["byte"], weights={"src0": 5.0})
    check_packing(uneven.collect(), whole.collect(), encode)


def test_windows_hold_the_target_mixture(spark, specs, sf_dir):
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE 'y' END AS source")
    got = packing.pack(whole, specs["byte"]).toPandas()
    share = got[got.source == "x"].length.sum() / got.length.sum()
    per = got[got.source == "x"].groupby("sequence_id").length.sum().reindex(range(got.sequence_id.max() - 1), fill_value=0)
    assert (abs(per.cumsum() - share * 2048 * np.arange(1, len(per) + 1)) <= 2 * 256).all()


def test_schedule_is_deficit_round_robin(spark):
    """The order against a plain loop: time runs until the next deficit reaches one; that queue is served and pays one."""
    sizes, weights = [70, 9, 1, 0, 25], [5.0, 3.0, 1.0, 1.0, 2.5]
    queues = spark.createDataFrame([(k, w, n) for k, (n, w) in enumerate(zip(sizes, weights, strict=True))], "queue long, weight double, full long")
    with Scratch(spark, "test") as scratch:
        got = sorted((r.slot, r.queue, r.quantum) for r in packing.schedule(queues, scratch).collect())
    assert [k for k, *_ in got] == list(range(sum(sizes)))
    deficit, given, now = [Fraction(0)] * 5, [0] * 5, []
    while len(now) < sum(sizes):
        live = [q for q in range(5) if given[q] < sizes[q]]
        wait, q = min(((1 - deficit[q]) / Fraction(weights[q]), q) for q in live)
        for x in live:
            deficit[x] += wait * Fraction(weights[x])
        now.append((q, given[q]))
        deficit[q] -= 1
        given[q] += 1
    assert [(q, j) for _, q, j in got] == now


def test_five_thousand_weighted_sources(spark, specs):
    """Every source keeps its own weight, however many there are."""
    text = "a b c d e f g h " * 8
    rows = [(k, text, f"s{k % 5000}") for k in range(5000)] + [(5000 + k, text * 60, f"s{k % 2}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    encode = library("byte_bpe_50k.json")
    got = packing.pack(docs, specs["byte"], weights={"s0": 3.0, "s1": 1.0}).collect()
    check_packing(got, docs.collect(), encode)
    assert len({r.source for r in got}) == 5000
    early = [r for r in got if r.sequence_id < 10]
    tokens_of = lambda x: sum(r.length for r in early if r.source == x)
    assert tokens_of("s0") >= 2.5 * tokens_of("s1") > 0
