"""Cross-tokenizer alignment against a plain version, token by token."""

import hashlib
import json
import random
from collections import Counter

import duckdb
import public_tokenizers as P
import pyarrow.parquet as pq
import sentencepiece
from shroud.llm import alignment, queries
from tokenizers import Tokenizer

ODD = [None, "", " ", "a", " lead", "trail ", "two  spaces", "a \n b", "tabs\tand\nlines", "<|endoftext|> and </s> <s> <unk> <0x41>", "ünï 漢字 ",
       "emoji 👩‍👩‍👧 x", "a b   c", "don't we'll 3.14 x_y", "▁mark ▁▁ marks", "é é ﬁ ½ ①", "\x00\x01 \x7f", "  ", "a" * 3000, "́x y"]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in shown]
        letters = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}
        with open(P.path("byte_bpe_50k.json")) as f:
            self.names = {i: bytes(letters[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items()}

    def tokens(self, text):
        if not text:
            return [], []
        ids = self.a.encode(" " + text, add_special_tokens=False).ids
        a = [(i, self.names[i]) for i in ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode())
             for i in self.b.encode(text)]
        want = (" " + text).encode()
        return (a, b) if all(b"".join(x for _, x in s) == want for s in (a, b)) else ([], [])


def ranges(tokens):
    at = 0
    for i, x in tokens:
        yield i, at, at + len(x)
        at += len(x)


def overlaps(a, b):
    """All pairs of tokens whose byte ranges overlap (both lists ascend)."""
    out, first = [], 0
    for x, s, e in a:
        while first < len(b) and b[first][2] <= s:
            first += 1
        k = first
        while k < len(b) and b[k][1] < e:
            out.append((x, b[k][0]))
            k += 1
    return out


def grouped(side, cuts):
    out, held = [], []
    for i, _, e in side:
        held.append(str(i))
        if e in cuts:
            out.append(",".join(held))
            held = []
    return out


def brute(rows):
    plain, found, counts = Plain(), [], Counter()
    for i, text in rows:
        a, b = (list(ranges(t)) for t in plain.tokens(text))
        links = overlaps(a, b)
        cuts = {e for _, _, e in a} & {e for _, _, e in b}
        groups = list(zip(*(grouped(side, cuts) for side in (a, b))))
        counts.update(links)
        text = ";".join("|".join(g) for g in groups)
        found.append((i, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [(i, a, b, g, len(k), sum(counts[p] == top[p[1]] for p in k), sum(counts[p] for p in k), d) for i, a, b, g, k, d in found]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def odd_rows():
    rng = random.Random(8)
    words = "the of Haus niño naïve running tokenizers, alignment. 2024 foo_bar Straße l'été x".split()
    rows = list(enumerate(ODD)) + [(100 + i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(40)]
    return rows + [(None, rows[-1][1]), rows[-1], rows[-1], (None, None)]


def test_whole_result(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, unit int, a string").repartition(3)
    want = sorted(brute(rows), key=key)
    assert sorted(map(tuple, alignment.alignment(docs).collect()), key=key) == [
        (r[0], *r[1:7], r[7]) for r in want]
    assert any(r[1] for r in want) and any(r[1] == 0 for r in want)


def test_units_of_any_size(monkeypatch):
    pair, texts = alignment.tokenizer_pair(), [t for _, t in odd_rows()]
    whole, _ = alignment.align(texts, pair)
    for size in (1, 40, 5000):
        monkeypatch.setattr(alignment, "UNIT_BYTES", size)
        cuts = list(alignment._units(texts))
        assert [n for s in cuts for n in range(s.start, s.stop)] == list(range(len(texts)))
        parts = [alignment.align(texts[s], pair)[0] for s in cuts]
        for name in ("n_a", "n_b", "n_groups", "n_links", "groups"):
            assert [x for p in parts for x in p[name].to_pylist()] == whole[name].to_pylist()


def test_a_unit_is_aligned_in_bounded_parts(monkeypatch):
    pair, texts = alignment.tokenizer_pair(), [t for _, t in odd_rows()]
    whole, pairs = alignment.align(texts, pair)
    ids = dict(zip(pairs["pair"].to_pylist(), zip(pairs["a"].to_pylist(), pairs["b"].to_pylist())))
    want = [sorted(zip(map(ids.get, p), n)) for p, n in zip(whole["pairs"].to_pylist(), whole["times"].to_pylist())]
    seen, align = [], alignment.align
    monkeypatch.setattr(alignment, "align", lambda part, pair: seen.append(part) or align(part, pair))
    for size, kept in ((1, 0), (40, 20), (5000, 10**6)):
        monkeypatch.setattr(alignment, "PART_BYTES", size)
        monkeypatch.setattr(alignment, "KEPT_PIECES", kept)
        seen.clear()
        *parts, (place, total) = alignment.align_unit(texts, pair)
        assert place is None and [t for part in seen for t in part] == texts
        assert all(sum(len(t or "") for t in part) <= size or sum(map(bool, part)) == 1 for part in seen)
        ids = list(zip(total["a"].to_pylist(), total["b"].to_pylist()))
        assert total["pair"].to_pylist() == list(range(len(ids))) and len(set(ids)) == len(ids)
        assert Counter(dict(zip(ids, total["n"].to_pylist()))) == Counter(
            {(a, b): n for a, b, n in zip(*(pairs[c].to_pylist() for c in ("a", "b", "n")))})
        got = [sorted(zip((ids[k] for k in p), n)) for _, f in parts for p, n in zip(f["pairs"].to_pylist(), f["times"].to_pylist())]
        assert got == want


def test_kept_tokens_take_few_bytes():
    pair = alignment.TokenizerPair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    words = [f"w{n}" for n in range(5000)] + ["long" * 100]
    given = alignment.pa.array(words)
    pair.tokens(given)
    assert [x.to_pylist() for x in pair.tokens(given)] == [list(x) for x in pair.encode(words)]
    assert len(pair.kept) == 5000 and sum(x.nbytes for x in (pair.kept, *pair.kept_ids)) < 100 * 5000


def test_pieces_encode_like_whole_texts():
    pair, rng = alignment.tokenizer_pair(), random.Random(1)
    assert pair.cuts
    texts = [t[0] for t in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text <> ''").fetchall()]
    marks = [" ", "  ", "\n", " \n", " ", "é", "é", "'s", "3", "漢", ".", "▁", "a", "​", "\x85", "\x1c"]
    texts += ["".join(rng.choices(marks, k=rng.randrange(1, 12))) for _ in range(3000)]
    for t in texts:
        pieces = pair.split(t)
        assert " ".join(pieces) == t
        a, b = pair.encode(pieces)
        assert [i for x in a for i in x] == pair.a.encode(" " + t, add_special_tokens=False).ids
        assert [i for x in b for i in x] == pair.b.encode(t)


def test_empty_and_null_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert alignment.alignment(docs.where("doc_id > 5")).count() == 0
    assert [tuple(r)[1:] for r in alignment.alignment(docs).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_query_agrees_on_the_corpus(spark):
    rows = queries.op12_token_alignment(spark, "/root/testdata/sf0.001").collect()
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    short = [(d["doc_id"], d["text"]) for d in docs]
    want = {r[0]: r[1:] for r in brute(short)}
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert {r.doc_id: tuple(r[n] for n in names) for r in rows} == want
