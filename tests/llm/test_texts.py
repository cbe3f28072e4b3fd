"""Brute-force versions of the operators on texts, on edge cases and on a small table."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillflow.llm import near_dup, suffix_dedup
from rillflow.llm.lm import Network, lm_scores, score_documents, train_window
from rillflow.llm.near_dup import drop_near_duplicates, near_duplicates
from rillflow.llm.packing import Places, pack, solve
from rillflow.llm.suffix_dedup import remove_repeats, suffix_digests
from rillflow.llm.token_counts import token_counts

from .conftest import SF, edge_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def small_rows(small):
    return [tuple(r) for r in small.select("doc_id", "text").collect()]


# --- 1 ---


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components_by_hand(rows, k=4):
    sets = {i: shingles(t, k) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("which", ["edge", "small"])
def test_near_duplicates(request, which):
    df = request.getfixturevalue(which)
    rows = edge_rows() if which == "edge" else small_rows(df)
    assert {tuple(r) for r in near_duplicates(df).collect()} == components_by_hand(rows)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Chains of near copies whose ends are far apart, with blocks so small that they split."""
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    text = [f"x{i}" for i in range(120)]
    rows = []
    for i in range(24):
        rows.append((i, " ".join(text)))
        for j in range(4):
            text[(i * 4 + j) % 120] = f"y{i}_{j}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(df).collect()} == components_by_hand(rows)


def test_near_duplicates_repeated_and_empty(repeated, empty):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(repeated).collect())
    assert got == sorted([("1", 47, "1", True)] * 3 + [("2", 47, "1", False), ("None", 47, "None", True), ("None", 0, "None", True), ("3", 0, "3", True)])
    assert near_duplicates(empty).count() == 0
    kept = drop_near_duplicates(repeated, k=5).collect()
    assert sorted(str(r.text)[:4] for r in kept if r.text) == sorted({str(r.text)[:4] for r in repeated.collect() if r.text}) and sum(r.text is None for r in kept) == 2


def test_posterior_bounds():
    least = near_dup.least_matches(0.8)
    for n, m in least.items():
        tail = sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(m))
        assert tail < near_dup.MISS
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, (200, 400), dtype=np.uint64)
    for keep in (400, 360):  # similar sets survive; unlike ones go
        b = a.copy()
        b[:, keep:] = rng.integers(0, 2**64, (200, 400 - keep), dtype=np.uint64)
        sa, sb = (near_dup.signatures([np.unique(x) for x in y]) for y in (a, b))
        assert len(near_dup.may_link(sa, sb, least)) == 200
    assert len(near_dup.may_link(sa, sa[::-1], least)) == 0


# --- 2 ---


@pytest.mark.parametrize("which", ["edge", "small", "repeated"])
def test_token_counts(request, which):
    df = request.getfixturevalue(which)
    encode = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(encode(r.text or "")), n > 4096) for r in df.collect())
    assert Counter(tuple(r) for r in token_counts(df, MODEL).collect()) == want


def test_token_counts_small_table_and_empty(small, empty):
    encode = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode
    got = {r.doc_id: r.n_tokens for r in token_counts(small, MODEL, table_size=7).collect()}
    assert got == {i: len(encode(t)) for i, t in small_rows(small)}
    assert token_counts(empty, MODEL).count() == 0


# --- 5 ---


def test_lm_counts_and_probability(small):
    rows = small_rows(small)
    tok = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tok(t))
    total = sum(c.values())
    got = {r.doc_id: r for r in lm_scores(small).collect()}
    for i, t in rows:
        r, w = got[i], tok(t)
        base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (len(c) + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(c[x] > 0 for x in w), total)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0


def test_lm_rare_words_join(small, monkeypatch):
    from rillflow.llm import lm

    some = small.limit(60)
    want = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm_scores(some).collect()}
    monkeypatch.setattr(lm, "BROADCAST_WORDS", 50)
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm_scores(some).collect()} == want


def test_lm_edges(edge, repeated, empty):
    got = {r.doc_id: r for r in lm_scores(edge).collect()}
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 1 and got[10].n_tokens == 30_001
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got.values())
    assert lm_scores(repeated).count() == 7 and lm_scores(empty).count() == 0


def test_lm_trains_on_every_training_document(small, edge, repeated, monkeypatch):
    from rillflow.llm import lm

    for df in (small, edge, repeated):
        rounds, trained = [], lm._trained
        mine = lambda learn, start, shards, r: (rounds.extend((x.id, len(x.words) // 2) for x in learn.filter(F.pmod(F.pmod(F.xxhash64("id"), F.lit(shards)), F.lit(lm.ROUNDS)) == r).collect()), start)[1]
        monkeypatch.setattr(lm, "_trained", mine)
        lm_scores(df)
        monkeypatch.setattr(lm, "_trained", trained)
        assert Counter(rounds) == Counter((r.doc_id, len(lm.tokens((r.text or "").encode()))) for r in df.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10)


def test_lm_score_does_not_depend_on_the_layout(spark, monkeypatch):
    """One file or many partitions, rows in any order: the same scores; and better ones than the base's on held-out documents."""
    from rillflow.llm import lm

    monkeypatch.setattr(lm, "SHARD_TOKENS", 60_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    per_layout = []
    for df in (docs.coalesce(1), docs.repartition(8), docs.orderBy("text").repartition(64)):
        per_layout.append({r.doc_id: (r.score, r.base_score, r.held_out, r.n_tokens) for r in lm_scores(df).collect()})
    for other in per_layout[1:]:
        assert all(abs(a[0] - per_layout[0][i][0]) <= 1e-6 * abs(a[0]) for i, a in other.items())
    held = [x for x in per_layout[0].values() if x[2]]
    assert sum(x[0] - x[1] for x in held) / sum(x[3] for x in held) > 0.06


def test_lm_lanes_hold_whole_documents():
    """Documents in lanes have the gradients and losses they have alone; several calls train on all of them."""
    from rillflow.llm import lm

    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50, n) for n in (4, 1, 7, 2)]
    lanes = lm._lanes(docs * 100)
    assert len(lanes) == lm.BATCH and Counter(d.tobytes() for lane in lanes for d in lane) == Counter(d.tobytes() for d in docs * 100)
    net = Network(rng.normal(0, 0.3, Network.size()))
    one, apart, loss = Network(np.zeros_like(net.flat)), Network(np.zeros_like(net.flat)), 0
    zero = np.zeros((1, lm.HIDDEN))
    for d in docs:
        grad = Network(np.zeros_like(net.flat))
        loss += train_window(net, grad, zero, d[:, None], np.ones((len(d), 1), bool))[1] * len(d)
        apart.flat += grad.flat * len(d)
    begins = np.zeros((14, 1), bool)
    begins[[0, 4, 5, 12]] = True
    _, mean = train_window(net, one, zero, np.concatenate(docs)[:, None], np.ones((14, 1), bool), begins)
    assert np.allclose(one.flat * 14, apart.flat, atol=1e-9) and abs(mean * 14 - loss) < 1e-9


def test_network_gradient_and_normalisation():
    rng = np.random.default_rng(1)
    net = Network(rng.normal(0, 0.3, Network.size()))
    words, valid = rng.integers(0, 50, (5, 3)), np.ones((5, 3), bool)
    valid[3:, 2] = False
    h = rng.normal(0, 0.5, (3, net.wh.shape[0]))
    grad = Network(np.zeros_like(net.flat))
    train_window(net, grad, h, words, valid)
    for i in np.argsort(-abs(grad.flat))[:400:20]:
        a, b = net.flat.copy(), net.flat.copy()
        a[i], b[i] = a[i] + 1e-5, b[i] - 1e-5
        loss = [train_window(Network(x), Network(np.zeros_like(x)), h, words, valid)[1] for x in (a, b)]
        assert abs((loss[0] - loss[1]) / 2e-5 - grad.flat[i]) < 1e-4
    from rillflow.llm.lm import WORDS as V

    start = Network.start(np.ones(V + 1))
    p = 10 ** score_documents(start, [np.array([i]) for i in range(V + 1)])
    assert abs(p.sum() - 1) < 1e-4
    docs = [np.array([3, 9, 4]), np.array([7]), np.array([2, 2, 2, 2, 5])]
    assert np.allclose(score_documents(start, docs), [score_documents(start, [d])[0] for d in docs], atol=1e-4)


# --- 9 ---


def check_packing(df, rows):
    tokenizer = Tokenizer.from_file(WORDS)
    out = pack(df, WORDS).collect()
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            part = np.array(ids[p : p + 2048], "<u4")
            want[i, p // 2048, p, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    return len(bins), sum(r.length for r in out)


@pytest.mark.parametrize("which", ["edge", "small", "repeated"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    bins, total = check_packing(df, [(r.doc_id, r.text) for r in df.collect()])
    assert bins <= -(-total // 2048) * 1.02 + 2


def test_packing_empty(empty):
    assert pack(empty, WORDS).count() == 0


def test_packing_solver():
    rng = np.random.default_rng(3)
    for _ in range(300):
        c = int(rng.choice([5, 12, 30]))
        counts = {int(k): int(rng.integers(1, 20)) for k in rng.choice(np.arange(1, c + 1), rng.integers(1, min(c, 8)), replace=False)}
        bins = solve(counts, c)
        used = Counter()
        for n, items in bins:
            assert n > 0 and sum(s * e for s, e in items) <= c
            for s, e in items:
                used[s] += n * e
        assert used == Counter(counts)
        assert Places(bins).sequences == sum(n for n, _ in bins)
    # Dominance finds what plain best fit, longest first, would miss nothing of: exact pairs stay pairs.
    assert sum(n for n, _ in solve({7: 3, 3: 3, 5: 2}, 10)) == 4


# --- 10 ---


def removed_by_hand(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("which", ["edge", "small"])
def test_suffix_dedup(request, which):
    df = request.getfixturevalue(which)
    rows = edge_rows() if which == "edge" else small_rows(df)
    got = {r[0]: tuple(r)[1:] for r in suffix_digests(df).collect()}
    assert got == removed_by_hand(rows)


def test_suffix_dedup_splits_crowded_names(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCHES", 3)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 2_000)
    monkeypatch.setattr(suffix_dedup, "HOT_NAMES", 20)
    monkeypatch.setattr(suffix_dedup, "NAME_BYTES", 2_000)
    rng = np.random.default_rng(2)
    line = "".join(chr(97 + x) for x in rng.integers(0, 26, 130))
    rows = [(i, "".join(chr(97 + x) for x in rng.integers(0, 26, int(rng.integers(0, 200)))) + line + "".join(chr(97 + x) for x in rng.integers(0, 2, 60))) for i in range(60)]
    got = {r[0]: tuple(r)[1:] for r in suffix_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == removed_by_hand(rows)


def test_suffix_dedup_repeated_and_empty(repeated, empty):
    got = suffix_digests(repeated).collect()
    texts = {len((r.text or "").encode()) for r in repeated.collect()}
    assert len(got) == 7 and {r.n_bytes for r in got} == texts
    assert sum(r.n_removed == 0 and r.n_bytes > 0 for r in got) == 2 and sum(r.n_removed == r.n_bytes > 0 for r in got) == 3
    assert suffix_digests(empty).count() == 0


def test_remove_repeats_keeps_columns(edge):
    got = {r.doc_id: r for r in remove_repeats(edge).collect()}
    assert got[1].text is None and got[6].text == dict(edge_rows())[6] and got[7].text == "" and set(edge.columns) < {*next(iter(got.values())).asDict()}
