"""Packing: token ids, bins, islands and the whole query."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
from shroud.llm import packing, queries
from tokenizers import Tokenizer

PATH = public_tokenizers.path(packing.TOKENIZER)
ODD = ["", " ", "a\x1cb \x85 c\xa0d", "it's they'LL <|endoftext|> x<|startoftext|>y", "ΟΔΟΣ Σ. İstanbul ß ẞ ﬁ", "é café ñ",
       "日本語 テスト 한국어 🎉🎉 ½ ²", "\x00a​b", "  lead  trail \n\n", "x" * 500, "<|x|> <|endof text|>", "Å 가",
       "ÀÉ ÿ Ÿ ªº µ Straße, ÉCOLE! can't, O'Neil's x.y: a,b,", " ".join(chr(c) + " a" + chr(c) + "." for c in range(32, 0x250)),
       " ".join(chr(c) * 2 + "." for c in range(0x250, 0x3000, 5)), "word " * 3000]


def all_ids(enc, texts):
    return [np.frombuffer(b, "<u4").tolist() for b in packing._all_ids(enc, texts)]


def test_ids_equal_the_tokenizers(monkeypatch):
    plain = Tokenizer.from_file(PATH)
    want = [plain.encode(t, add_special_tokens=False).ids for t in ODD]
    assert all_ids(packing.WordEncoder(PATH), ODD) == want
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    monkeypatch.setattr(packing, "CHUNK_CHARS", 50)
    enc = packing.WordEncoder(PATH)
    assert all_ids(enc, ODD) == want and all_ids(enc, ODD) == want


def check_bins(bins, size, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(size)))
    assert all(sum(size[i] for i in b) <= capacity for b in bins)


def test_genetic_steps_keep_every_piece():
    rng = random.Random(1)
    size = [rng.randint(1, 100) for _ in range(200)]
    parents = list(packing.first_parents(size, 100, 4, rng))
    for p in parents:
        check_bins(p, size, 100)
    for _ in range(10):
        check_bins(packing.crossover(*rng.sample(parents, 2), size, 100, rng), size, 100)
    best = packing.evolve(size, 100, [], 3, 6, 6)
    assert len(best[0]) <= len(parents[0])
    assert packing._load(packing._dump(best[0], len(size))) == [sorted(b) for b in best[0]]


def test_evolution_beats_best_fit_on_triplets():
    # Three pieces fill a bin exactly; greedy fitting misses that.
    rng = random.Random(7)
    size = []
    for _ in range(20):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2 + 20)
        size += [a, b, 1000 - a - b]
    greedy = len(next(packing.first_parents(size, 1000, 1, rng)))
    assert len(packing.evolve(size, 1000, [], 5, 20, 60)[0]) < greedy


def packed(rows):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096
    return bins


def test_query_packs_every_piece(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op10_best_fit_packing(spark, sf).collect()
    tok = Tokenizer.from_file(PATH)
    want = set()
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array(tok.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4")
        want |= {(d.doc_id, n, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes()))
                 for n, at in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert len(packed(rows)) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_levels_and_edge_cases(spark):
    rows = [(None, None), (None, ""), (1, "a b c"), (1, "a b c"), (2, "word " * 10000)] + [(10 + i, "w " * (37 * i % 900)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "u", 3) for i, t in rows], "doc_id long, text string, uid string, piece int").repartition(3)
    out = packing.pack_documents(docs, chunk_pieces=40, merge=4, with_ids=True)
    got = out.collect()
    assert len(packed(got)) <= -(-sum(r.length for r in got) // 4096) + 3
    assert collections.Counter(r.id for r in got if r.piece == 0) == collections.Counter(i for i, _ in rows)
    whole = {r.sequence_id: r.ids for r in packing.sequences(out).collect()}
    assert all(list(whole[r.sequence_id][r.offset:r.offset + r.length]) == list(r.ids) for r in got)
    assert packing.pack_documents(docs.where("doc_id < 0")).count() == 0


def test_levels_end_when_nothing_can_be_saved(spark, monkeypatch):
    # No two pieces fit together, so the chunks never get fewer than two.
    n, calls, real = 2 * 16 + 1, [], packing.pack_chunks

    def counted(*args):
        calls.append(1)
        assert len(calls) <= 5, "the levels do not end"
        return real(*args)

    monkeypatch.setattr(packing, "pack_chunks", counted)
    pieces = spark.range(n).selectExpr("id AS uid", "2458L AS length")
    rows = packing.pack(pieces, chunk_pieces=16, islands=2, epochs=1).collect()
    assert sorted(r.uid for r in rows) == list(range(n))
    assert len({r.sequence_id for r in rows}) == n and {r.offset for r in rows} == {0}


def test_short_pieces_still_meet_the_long_ones(spark):
    # Levels over several chunks: every piece once, within the capacity.
    size = [2458] * 70 + [700] * 25 + [4096] * 3
    pieces = spark.createDataFrame(list(enumerate(size)), "uid long, length long")
    rows = packing.pack(pieces, chunk_pieces=8, islands=2, epochs=1).collect()
    assert sorted(r.uid for r in rows) == list(range(len(size)))
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, size[r.uid]))
    for v in bins.values():
        assert [o for o, _ in sorted(v)] == [sum(l for _, l in sorted(v)[:i]) for i in range(len(v))]
        assert sum(l for _, l in v) <= 4096
    assert 73 <= len(bins) <= 76
