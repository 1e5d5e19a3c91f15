"""SentencePiece against the library, clustering and the source audit against plain loops, and odd rows of each."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from textbank.llm import centroids, divergence, sentencepieces
from textbank.llm.queries import PIECES, queries

ODD_TEXTS = [None, "", " ", "  ", "\n", "a", " a", "a  b ", "▁a▁▁b", "é一\U0001f600 x\0y", "<s> </s> <0x41> <unk>", "a" * 5000, " " * 300, "the " * 6000, "日本語" * 200, "�⁇"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def random_texts(n, seed=3):
    rng = random.Random(seed)
    parts = [*"abcdefgh  \n\t▁éñ一\U0001f600\0.,-<>0123x", "the ", "ing", "  ", "▁▁", "tion", "</s>", "<0x41>", "⁇", "�", "\xa0", "　"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_pieces(spark, library):
    texts = ODD_TEXTS + random_texts(3000)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ids = {r["doc_id"]: r for r in sentencepieces.decode(sentencepieces.encode(rows, PIECES), PIECES).collect()}
    once = {r["doc_id"]: r for r in sentencepieces.round_trip(rows, PIECES).collect()}
    for i, (t, want) in enumerate(zip(texts, library.encode([t or "" for t in texts], add_bos=True, add_eos=True), strict=True)):
        assert ids[i]["ids"] == want and ids[i]["decoded"] == once[i]["decoded"] == library.decode(want), repr(t)
        assert once[i]["n_tokens"] == len(want) and bytes(once[i]["packed"]) == np.array(want, "<u4").tobytes()


def test_a_full_table_starts_afresh(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "KEPT_CHUNKS", 5)
    coder = sentencepieces.Encoder(sentencepieces.load(PIECES))
    for t in random_texts(60, 8):
        ids, counts = coder.encode([t, None, t])
        own = library.encode(t, add_bos=True, add_eos=True)
        assert ids.tolist() == [*own, 1, 2, *own] and counts.tolist() == [len(own), 2, len(own)]


def test_decoding_any_ids(library):
    """Bytes that are no UTF-8, control ids inside, no ids at all."""
    rng = random.Random(5)
    pool = [0, 1, 2, 259, 260, 28705, 264, 287, 1000, 5000, *range(3, 259)]
    lists = [[rng.choice(pool) for _ in range(rng.randrange(9))] for _ in range(4000)]
    got = sentencepieces.load(PIECES).decode(np.array([x for y in lists for x in y]), np.array([len(y) for y in lists]))
    assert got == [library.decode(x) for x in lists]


def test_pieces_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries()["op11_sentencepiece"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        want = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), *want)


def test_nearest_with_ties():
    """Against a search of all centroids, on small integers, where many distances are equal and centroids repeat."""
    rng = np.random.default_rng(1)
    for k, dim, top in ((1, 2, 3), (2, 1, 2), (8, 2, 3), (40, 3, 4), (40, 1, 100), (64, 16, 1000)):
        c = rng.integers(-top, top + 1, (k, dim))
        x = rng.integers(-top, top + 1, (500, dim))
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own, near = centroids.Neighbours(c).nearest(x)
        assert (own == d.argmin(axis=1)).all() and (near == d.min(axis=1)).all()


def test_nearest_skips_far_centroids(monkeypatch):
    """Of two far groups of centroids only one is measured, but for its first."""
    rng = np.random.default_rng(2)
    c = np.concatenate([rng.integers(0, 100, (50, 4)), rng.integers(100_000, 100_100, (50, 4))])
    near = centroids.Neighbours(c)
    measured = []

    class Seen(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                measured.append(len(key))
            return np.asarray(self)[key]

    near.centroids = c.view(Seen)
    near.nearest(rng.integers(0, 100, (200, 4)))
    assert sum(measured) <= 200 * 50


def lloyd(rows, k, rounds, key):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (key(r[0]), r[1]))[:k]]
    distance = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    nearest = lambda v: min(range(len(c)), key=lambda j: (distance(v, c[j]), j))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        members = [[v for (_, v), o in zip(kept, own, strict=True) if o == j] for j in range(len(c))]
        c = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else old for m, old in zip(members, c, strict=True)]
    found = [(i, nearest(v), distance(v, c[nearest(v)])) for i, v in kept]
    total = sum(d for *_, d in found)
    return sorted((str(i), o, d, sum(e for _, p, e in found if p == o), total, c[o]) for i, o, d in found)


@pytest.mark.parametrize("k", [1, 4, 30])
def test_clusters(spark, k):
    """Odd vectors, repeated rows and ids, a null id, empty clusters, fewer vectors than centroids, columns with clashing names."""
    rng = random.Random(k)
    rows = [(i, [rng.choice([-1.5, -0.0005, 0.25, 1.0]) for _ in range(3)]) for i in range(25 if k < 30 else 12)]
    rows += [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (7, [9.0, -9.0, 9.0]), (7, [9.0, -9.0, 9.0]), (7, [8.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("cluster", "distance", "n", "total", "place", "centroid")})
    order = F.coalesce((F.col("vec_id") * 7919 % 31).cast("long"), F.lit(-1))
    got = centroids.cluster(frame.repartition(3), k, 4, order, 3)
    want = lloyd(rows, k, 4, lambda i: -1 if i is None else i * 7919 % 31)
    assert sorted((str(r[0]), *r[1:5], r[5]) for r in got.collect()) == want
    assert centroids.cluster(frame.where("false"), k, 4, order, 3).collect() == []


def test_vectors_too_large(spark):
    frame = spark.createDataFrame([(1, [1e9, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        centroids.cluster(frame, 2, 1, F.col("vec_id"), 2).collect()


def audit(rows, min_docs=3, max_rank=200):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    rows = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for a, b, t in rows]
    out = set()
    for lang in {a for a, *_ in rows}:
        own = [(s, t) for a, s, t in rows if a == lang]
        held = Counter(x for _, t in own for x in set(t))
        kept = [x for x in held if held[x] >= min_docs]

        def shares(terms):
            c = Counter(terms)
            total = sum(c[x] for x in kept)
            return {x: 1 + 10**9 * (c[x] + 1) // (total + len(kept)) for x in kept}, c

        all_, _ = shares([x for _, t in own for x in t])
        sources = {s: shares([x for r, t in own if r == s for x in t]) for s in {s for s, _ in own}}
        f = lambda p, q: (p - q) ** 2 // q
        for s, (p, c) in sources.items():
            pairs = sorted(((-sum(f(p[x], q[x]) for x in kept), t) for t, (q, _) in sources.items() if t != s), key=lambda r: (r[0], r[1].encode()))
            terms = sorted(((-f(p[x], all_[x]), x) for x in kept if c[x] and p[x] > all_[x]), key=lambda r: (r[0], r[1].encode()))
            out |= {(lang, s, "pair", t, -v, i) for i, (v, t) in enumerate(pairs, 1)} | {(lang, s, "term", x, -v, i) for i, (v, x) in enumerate(terms[:max_rank], 1)}
    return out


@pytest.mark.parametrize(("block", "group", "counts"), [(4096, 32, 300_000), (7, 2, 40)])
def test_audit(spark, monkeypatch, block, group, counts):
    """Whole, and with blocks of few terms, groups of two sources and tasks that hand on their counts early."""
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", group)
    monkeypatch.setattr(divergence, "KEPT_COUNTS", counts)
    rng = random.Random(6)
    words = ["the", "The", "of", "a", "naïve", "ÄÖ", "it's", "x2y", "Zed", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9))]
    texts = lambda n: " ".join(rng.choice(words[: rng.randrange(3, len(words))]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s10", "s2", "é", None, *"abc"]), texts(rng.randrange(60))) for _ in range(150)]
    rows += [("en", "hot", "the very " * 3000), ("en", "hot", "the very " * 3000), ("en", "none", None), ("fr", "one", "a b c"), ("fr", "two", ""), ("it", "alone", "x x x")] + 3 * [("en", "rare", "seldom")]
    frame = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit(5) for c in ("doc_id", "term", "n", "docs", "terms", "block", "id", "value", "item", "part", "rank", "all")})
    got = divergence.audit(frame.repartition(3)).collect()
    assert {tuple(r) for r in got} == audit(rows) and len(got) == len(audit(rows))
    few = divergence.audit(frame, min_docs=2, max_rank=3).collect()
    assert {tuple(r) for r in few} == audit(rows, 2, 3)
    assert divergence.audit(frame.where("false")).collect() == []


def test_shares_of_large_counts(spark):
    """No product leaves the range of longs."""
    rows = [(1, 1), (1, 3), (10**15, 10**15), (10**15 - 1, 9 * 10**15 - 1), (7, 9 * 10**15 - 1), (123456789012345, 987654321098765)]
    got = [r[0] for r in spark.createDataFrame(rows, "n long, all long").select(divergence.share(F.col("n"), F.col("all"))).collect()]
    assert got == [1 + 10**9 * n // d for n, d in rows] == [int(divergence.shares(np.array([n]), d)[0]) for n, d in rows]


def test_gallop():
    rng = random.Random(3)
    for n, m in ((0, 5), (5, 0), (1, 1), (300, 20_000), (5000, 5000), (2000, 100)):
        a, b = (np.array(sorted(rng.sample(range(40_000), x)), np.int64) for x in (n, m))
        assert (divergence.gallop(a, b) == np.searchsorted(b, a)).all()
