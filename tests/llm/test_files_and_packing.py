"""Token files, packing and WARC archives: round trips against plain loops."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import DOCS, frame, sample
from tokenizers import Tokenizer

from ionweave.llm import packing, token_files, warc
from ionweave.llm.common import prepared
from ionweave.llm.tokens import Encoder, vocabulary
from ionweave.session import scratch

HARD = [
    "", " ", "  x", "a  b   c \n d\t\te ", "It's we'LL 's foo'bar", "\xdcn\xefcode \xdf ǅ İK ﬁ é ́x", "日本 語テ \U0001f642",
    "x\xa0y", "a <|endoftext|> b<|startoftext|>c", "\n\n\n", "a\r\nb\r\n", "ΑΣ ΑΣΑ", "1234 5678,90", "﻿x y​ z", "don’t “quote”", "a\x1cb c",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    own, library = Encoder(vocabulary(name), keep=20), Tokenizer.from_file(vocabulary(name))
    assert own.pieces is not None
    for text in HARD + [t or "" for _, t, *_ in sample()][:70]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark):
    prepared(spark)
    path = scratch(spark, "test_tokens")
    token_files.write_token_files(frame(spark), path, vocabulary("byte_bpe_50k.json"), shards=3)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = defaultdict(list)
    for i, text, *_ in sample():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want[i].append((len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    for r in got:
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        assert r.start == start
        start += r.n_tokens
    assert not any(want.values())
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_token_files_of_nothing(spark):
    path = scratch(prepared(spark), "test_tokens")
    token_files.write_token_files(frame(spark, []), path, vocabulary("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, path).count() == 0


def test_packing(spark):
    got = packing.pack_documents(frame(prepared(spark)), vocabulary("word_bpe_49k.json"), capacity=128).collect()
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for i, text, *_ in sample():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, len(ids[a : a + 128]), zlib.crc32(ids[a : a + 128].tobytes())) for k, a in enumerate(range(0, len(ids), 128))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= -(-sum(w[3] for w in want) // 128) + 1
    assert packing.pack_documents(frame(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


def test_local_search_empties_bins_that_best_fit_leaves():
    lengths = np.array([6, 5, 5, 4, 4, 3, 3, 2, 2, 6])
    start = packing.best_fit(lengths, 10)
    spread = [[i] for i in range(len(lengths))]
    for bins in (start, spread):
        done = packing.local_search(lengths, bins, 10)
        assert sorted(i for b in done for i in b) == list(range(10))
        assert all(lengths[b].sum() <= 10 for b in done)
        assert len(done) == 4


def test_underfull_sequences_of_all_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 64)
    rows = [(i, n) for i, n in enumerate(np.random.default_rng(3).integers(1, 25, 900).tolist())] + [(None, 7), (3, 100)]
    got = packing.pack_pieces(prepared(spark).createDataFrame(rows, "doc_id bigint, length bigint"), 100).collect()
    assert sorted(((r.doc_id is None, r.doc_id, r.length) for r in got if r.doc_id is not None)) == sorted((False, *r) for r in rows if r[0] is not None)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        assert [o for o, _ in sorted(items)] == [sum(n for o, n in items if o < at) for at, _ in sorted(items)]
        assert sum(n for _, n in items) <= 100
    # Fifteen blocks by themselves leave a last sequence nearly empty each.
    least = -(-sum(n for _, n in rows) // 100)
    pieces = [(i, n, i % 15) for i, (_, n) in enumerate(rows)]
    alone = packing._packed(spark.createDataFrame(pieces, "__id bigint, length bigint, __block bigint"), 100, 0).filter("offset = 0").count()
    assert least <= len(bins) < alone


PAGES = "page_id bigint, url string, html string, payload string"


def test_warc_round_trip(spark):
    prepared(spark)
    big, small = "<p>\xe9\r\n\r\n</p>" * 200, "tiny"
    rows = [(i, f"http://x/{i}\r\n", big if i % 3 else small, "clash") for i in range(1, 40)] + [(50, None, None, None), (51, "u", "", ""), (None, "u", big, ""), (None, None, "z" * 2000, "")]
    path = scratch(spark, "test_warc")
    warc.write_warc(spark.createDataFrame(rows, PAGES), path)
    got = sorted(warc.page_records(spark, path).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.payload_bytes))
    assert len(got) == len(rows)
    for r, (i, _, html, _) in zip(got, sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, len((x[2] or "").encode())))):
        data = (html or "").encode()
        assert (r.page_id, r.payload_bytes, r.payload_digest) == (i, len(data), hashlib.sha1(data).hexdigest())
        again = html == big and i != 38
        assert (r.record_type, r.refers_to) == (("revisit", 38) if again else ("response", None))
    one = warc.read_warc(spark, path).filter("page_id = 38 AND record_type = 'response'").collect()
    assert len(one) == 1 and bytes(one[0].payload).decode() == big
    empty = scratch(spark, "test_warc")
    warc.write_warc(spark.createDataFrame([], PAGES), empty)
    assert warc.page_records(spark, empty).count() == 0


def test_warc_reads_committed_files_alone(spark):
    path = scratch(prepared(spark), "test_warc")
    manifest = warc.write_warc(spark.createDataFrame([(1, "u", "<p>one</p>", "x"), (2, "v", "<p>two</p>", "x")], PAGES), path).collect()
    place = path.removeprefix("file:")
    whole = open(manifest[0].file.removeprefix("file:"), "rb").read()
    for name, data in (("again", whole), ("cut", whole[: len(whole) // 2])):
        with open(f"{place}/{name}.warc.gz", "wb") as out:
            out.write(data)
    assert sorted(r.page_id for r in warc.page_records(spark, path).collect()) == [1, 2]


def test_warc_steps_over_unwanted_payloads(monkeypatch):
    good = warc.member(warc.record(1, "u", b"x" * 5000, "00" * 20, None, "response"))
    bad = bytearray(warc.member(warc.record(2, "u", bytes(range(256)) * 400, "00" * 20, None, "response")))
    for i in range(len(bad) - 600, len(bad) - 8):
        bad[i] ^= 255
    data = good + bytes(bad) + good
    assert [r["page_id"] for r in warc.records(data, [("page_id", (1,))], True)] == [1, 1]
    assert [r["page_id"] for r in warc.records(data, [], False)] == [1, 2, 1]


def test_schema_is_as_declared():
    assert DOCS.count(",") == 7
