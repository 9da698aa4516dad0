"""Piece codec and token alignment against the libraries on whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL

from florin.llm import piece_codec as C
from florin.llm import queries as Q
from florin.llm import token_alignment as A

A_PATH, B_PATH = Q.tokenizer_path("byte_bpe_50k.json"), Q.tokenizer_path("piece_bpe_32k.model")
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(4)
    made = ["".join(rng.choice(" \n\t▁aé日\x00b.'<s>­ﬁ 　\xa0\x0b\x850") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    return [None, "", " ", "\n", "  x  ", "<s></s><unk> <|endoftext|>", "日本語" * 500, "😀 x‍", *made]


def test_codec_is_the_library(spark, small, odd_docs, odd_texts, no_docs):
    model = C.load_model(B_PATH)
    made = odd_docs.select("doc_id", "text").union(small.select("doc_id", "text")).union(spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string"))
    rows = C.decode_ids(C.encode_texts(made, B_PATH), B_PATH).collect()
    wanted = Counter((r.doc_id, tuple(model.encode(r.text or "")), model.decode(model.encode(r.text or ""))) for r in made.collect())
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in rows) == wanted
    assert C.encode_texts(odd_docs, B_PATH).count() == odd_docs.count() and C.encode_texts(no_docs, B_PATH).count() == 0


def test_decoding_of_any_ids(spark):
    model, rng = C.load_model(B_PATH), random.Random(5)
    lists = [[rng.randrange(300) if rng.random() < 0.4 else rng.randrange(32_000) for _ in range(rng.randint(0, 9))] for _ in range(2000)]
    got = {r.doc_id: r.text for r in C.decode_ids(spark.createDataFrame([*enumerate(lists), (-1, None)], "doc_id long, ids array<int>"), B_PATH).collect()}
    assert got == {**{k: model.decode(ids) for k, ids in enumerate(lists)}, -1: None}


def test_codec_query(spark):
    model = C.load_model(B_PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in Q.op12_piece_codec(spark, SMALL).collect():
        ids = model.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))


def aligned_by_brute_force(texts):
    """Whole texts, both libraries, sets of byte offsets."""
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_PATH), C.load_model(B_PATH)
    a.encode_special_tokens = True
    alphabet = A.byte_level_alphabet()
    a_bytes = {k: bytes(alphabet[c] for c in t) for t, k in a.get_vocab(with_added_tokens=False).items() if set(t) <= alphabet.keys()}
    out, links = [], Counter()
    for text in texts:
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        y = b.encode(text or "")
        p, q = [a_bytes[k] for k in x], [C.piece_bytes(b, k) for k in y]
        if not text or not b"".join(p) == b"".join(q) == (" " + text).encode():
            out.append(None)
            continue
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (p, q)]
        both = sorted(set(ends[0]) & set(ends[1]))
        group = [np.searchsorted(both, at).tolist() for at in ends]
        parts = [[[], []] for _ in both]
        for side, ids in enumerate((x, y)):
            for k, g in zip(ids, group[side]):
                parts[g][side].append(str(k))
        groups = ["|".join(",".join(ids) for ids in part) for part in parts]
        ending = [defaultdict(list), defaultdict(list)]
        for side, ids in enumerate((x, y)):
            for k, e in zip(ids, ends[side]):
                ending[side][e].append(k)
        pairs = [(k, m) for e, ids in ending[0].items() for k in ids for m in ending[1].get(e, ())]
        links.update(pairs)
        out.append((len(x), len(y), groups, pairs))
    highest = defaultdict(int)
    for (_, k), n in links.items():
        highest[k] = max(highest[k], n)
    rows = [(0, 0, 0, 0, 0, 0, "") if o is None else (o[0], o[1], len(o[2]), len(o[3]), sum(links[k] == highest[k[1]] for k in o[3]), sum(links[k] for k in o[3]), sha(";".join(o[2]))) for o in out]
    return rows, links, highest


def scores(frame):
    return Counter((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in frame.collect())


def test_alignment_by_brute_force(spark, small, odd_docs, odd_texts, no_docs):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect() + odd_docs.select("doc_id", "text").collect()] + [(10_000 + k, t) for k, t in enumerate(odd_texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted, links, highest = aligned_by_brute_force([t for _, t in rows])
    assert scores(A.alignment_scores(docs, A_PATH, B_PATH)) == Counter((k, w) for (k, _), w in zip(rows, wanted))
    got = {(r.a_id, r.b_id): (r.n_links, r.best) for r in A.linked_pairs(docs, A_PATH, B_PATH).collect()}
    assert got == {k: (n, n == highest[k[1]]) for k, n in links.items()}
    assert A.alignment_scores(odd_docs, A_PATH, B_PATH).count() == odd_docs.count() and A.alignment_scores(no_docs, A_PATH, B_PATH).count() == 0
    assert {sha(r.groups) if r.groups else "" for r in A.aligned_groups(docs, A_PATH, B_PATH).collect()} == {w[-1] for w in wanted}


def test_planes_hold_every_link():
    rng = np.random.default_rng(2)
    pairs, docs = rng.choice([7, 8, 9 << 32], 60_000, p=[0.9, 0.0995, 0.0005]), np.minimum(rng.geometric(0.002, 60_000), A.BLOCK) - 1
    made = A.planes_of(pairs, docs)
    values = np.array([[{7: 1, 8: 1000, 9 << 32: 10**9}[p]] for p in made["pair"].tolist()])
    got = A.block_scores(made, np.arange(len(made["pair"])), values)[:, 0]
    want = np.zeros(A.BLOCK, np.int64)
    np.add.at(want, docs, np.array([{7: 1, 8: 1000, 9 << 32: 10**9}[p] for p in pairs.tolist()]))
    assert (got == want).all() and (made["size"] >= A.DENSE).any() and (made["size"] < A.DENSE).any()
    for pair in (7, 8, 9 << 32):
        mine = made["pair"] == pair
        assert (made["size"].astype(int) << made["plane"])[mine].sum() == (pairs == pair).sum() and made["n_docs"][mine].sum() == len(set(docs[pairs == pair]))
