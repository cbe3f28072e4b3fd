"""Language-model scoring with a gated recurrent network in numpy.

Counts of every training word (all of the corpus's training documents) give
the base score and the network's vocabulary: the ``WORDS`` most frequent words
and one entry for all others, whose probability is shared among those words by
their counts.  The output softmax is factored: a class of words, then the word
within its class.  Output biases start at the unigram logarithms.

Training: truncated backpropagation through ``WINDOW`` tokens with the state
carried from window to window over whole documents, which follow one another
in up to ``BATCH`` lanes; a document starts from a zero state.  A hash of the
id deals the training documents to shards of some ``SHARD_TOKENS`` tokens, as
many as the corpus has tokens for, and the shards to ``ROUNDS`` rounds; so each
document is trained on once, and neither files nor partitions decide how.  In a
round every shard trains a network of its own from the same start, which
becomes the mean of them, Adagrad's sums included.  The weights' size is fixed;
how many are averaged grows with the input.

Texts are read twice: to count their words, and to number them; training and
scoring read the numbers.  Scoring takes whole documents, carrying the state through; documents run side
by side, longest first.  The most frequent words, ``BROADCAST_WORDS`` at most, are
broadcast with their counts; the other words' counts come by a join on the word.

Tokens are counted, trained on and scored with A-Z lower-cased, split at ASCII
white space, with an end token after each document.  Defined cases: null and
empty texts are one end token; a null id is neither held out nor trained on;
repeated rows are scored each; other columns are ignored; with no training
rows every count is 0 and the network stays at its start.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import batches_of, bounded_batches, byte_rows, cut

END = b"\n"  # no word holds white space
WORDS = 4_095
CLASSES = 64
PER_CLASS = (WORDS + 1) // CLASSES
HIDDEN = 16
WINDOW = 32
BATCH = 128
ROUNDS = 2
SHARD_TOKENS = 3_000_000
MERGED = 32  # sums added up by one task
RATE = 0.16
BROADCAST_WORDS = 1 << 16
COUNTER = 400_000
SCORE_TOKENS = 3_000_000
SCORE_BYTES = 4_000_000
CHUNK = 8_192


def tokens(text: bytes | None) -> list[bytes]:
    return [*text.lower().split(), END] if text else [END]


# --- counts ---------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of the column ``text``; each task adds its own counts up first."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        seen: Counter = Counter()
        for b in it:
            for t in byte_rows(b, "text"):
                seen.update(tokens(t))
            if len(seen) > COUNTER:
                yield out()
                seen.clear()
        yield out()

    return texts.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


# --- the network ----------------------------------------------------------


class Network:
    """Weights in one flat vector; views by name."""

    SHAPES = {"emb": (WORDS + 1, HIDDEN), "wx": (HIDDEN, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wo": (CLASSES, HIDDEN, PER_CLASS), "bo": (CLASSES, PER_CLASS)}

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            n = math.prod(shape)
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def size(cls) -> int:
        return sum(math.prod(s) for s in cls.SHAPES.values())

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 7) -> Network:
        """Small random weights; output biases say the unigram probabilities."""
        net = cls(np.random.default_rng(seed).normal(0, 0.1, cls.size()).astype(np.float32))
        c = (counts + 0.1).reshape(CLASSES, PER_CLASS)
        net.b[:] = 0
        net.bc[:] = np.log(c.sum(1) / c.sum())
        net.bo[:] = np.log(c / c.sum(1, keepdims=True))
        return net

    def copy(self) -> Network:
        return Network(self.flat.copy())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place; logits are small, so their exponentials are taken as they are unless they could overflow or vanish."""
    if x.size and not (x.max() < 60 and x.min() > -60):
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def _picked(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """softmax(x)[row, at[row]]; logits are small, so their exponentials are taken as they are unless they overflow."""
    rows = np.arange(len(x))
    e = np.exp(x)
    total = e @ np.ones(e.shape[1], e.dtype)
    p = e[rows, at] / total
    bad = np.flatnonzero(~np.isfinite(total) | (total == 0))
    if len(bad):
        p[bad] = _softmax(x[bad])[np.arange(len(bad)), at[bad]]
    return p


def log_likelihood(net: Network, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log10 P(target | h), row by row: class, then word within it."""
    h = np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)  # the last column carries the biases
    wc, wo = np.concatenate([net.wc, net.bc[None]]), np.concatenate([net.wo, net.bo[:, None]], axis=1)
    order = np.argsort((target // PER_CLASS).astype(np.int16), kind="stable")
    h, (kind, within) = h[order], np.divmod(target[order], PER_CLASS)
    ends = np.searchsorted(kind, np.arange(CLASSES + 1))
    p = np.empty(len(h))
    with np.errstate(over="ignore", invalid="ignore"):
        for c in range(CLASSES):
            rows = slice(ends[c], ends[c + 1])
            if ends[c] < ends[c + 1]:
                p[rows] = _picked(h[rows] @ wo[c], within[rows])
        for i in range(0, len(h), CHUNK):
            rows = slice(i, i + CHUNK)
            p[rows] *= _picked(h[rows] @ wc, kind[rows])
    out = np.empty(len(h))
    out[order] = np.log10(np.maximum(p, 1e-300))
    return out


def score_documents(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """Each document's log10 probability of its vocabulary ids; all run side by side from a zero state."""
    total = np.zeros(len(docs))
    order = np.argsort([-len(d) for d in docs], kind="stable")
    size = np.array([len(docs[i]) for i in order])
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    flat = np.concatenate([docs[i] for i in order]) if len(docs) else np.zeros(0, np.int64)
    table = net.emb @ net.wx + net.b
    h = np.zeros((len(docs), HIDDEN), np.float32)
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def settle() -> None:
        nonlocal held
        if seen:
            out = log_likelihood(net, np.concatenate([x for x, _ in seen]), np.concatenate([y for _, y in seen]))
            at = 0
            for x, _ in seen:
                total[order[: len(x)]] += out[at : at + len(x)]
                at += len(x)
            seen.clear()
            held = 0

    for t in range(int(size[0]) if len(docs) else 0):
        n = int(np.searchsorted(-size, -t, side="left"))  # documents longer than t
        h = h[:n]
        word = flat[start[:n] + t]
        seen.append((h, word))
        held += n
        if held >= 30_000:
            settle()
        x, y = table[word], h @ net.wh
        zr = _sigmoid(x[:, : 2 * HIDDEN] + y[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + r * y[:, 2 * HIDDEN :])
        h = new + z * (h - new)
    settle()
    return total


def train_window(net: Network, grad: Network, h: np.ndarray, words: np.ndarray, valid: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Gradients of one window (time x lanes) into ``grad``; the state after it and the mean loss (nats).

    ``begins`` marks the first tokens of documents: their state starts from zero.
    """
    n_steps, width = len(words), 3 * HIDDEN
    fresh = begins.any(axis=1) if begins is not None else np.zeros(n_steps, bool)
    full = valid.all(axis=1)
    word = words.ravel()
    sign = np.repeat(np.array([-1, 1], h.dtype), [2 * HIDDEN, HIDDEN])  # gates are 1 / (1 + exp(-x))
    table = (net.emb[word] @ (net.wx * sign) + net.b * sign).reshape(*words.shape, width)
    wh = net.wh * sign
    states, news = np.empty((2, *words.shape, HIDDEN), h.dtype)
    gates, ys = np.empty((*words.shape, 2 * HIDDEN), h.dtype), np.empty(table.shape, h.dtype)
    for t in range(n_steps):
        if fresh[t]:
            h = np.where(begins[t][:, None], 0, h)
        states[t] = h
        x, y, e, new = table[t], np.matmul(h, wh, out=ys[t]), gates[t], news[t]
        np.add(x[:, : 2 * HIDDEN], y[:, : 2 * HIDDEN], out=e)
        np.exp(e, out=e)
        e += 1
        np.reciprocal(e, out=e)
        np.multiply(e[:, HIDDEN:], y[:, 2 * HIDDEN :], out=new)
        new += x[:, 2 * HIDDEN :]
        np.tanh(new, out=new)
        after = h - new
        after *= e[:, :HIDDEN]
        after += new
        h = after if full[t] else np.where(valid[t][:, None], after, h)
    # The output: rows in the order of their classes, so that a class is one product and all share the rest.
    at = np.flatnonzero(valid.ravel())
    at = at[np.argsort((word[at] // PER_CLASS).astype(np.int16), kind="stable")]
    (kind, within), own, n = np.divmod(word[at], PER_CLASS), np.arange(len(at)), max(1, len(at))
    hs = np.ones((len(at), HIDDEN + 1), h.dtype)  # the last column carries the biases
    hs[:, :HIDDEN] = states.reshape(-1, HIDDEN)[at]
    wo = np.concatenate([net.wo, net.bo[:, None]], axis=1)
    p = _softmax(hs @ np.concatenate([net.wc, net.bc[None]]))
    q = np.empty((len(at), PER_CLASS), h.dtype)
    ends = np.searchsorted(kind, np.arange(CLASSES + 1))
    used = [(c, slice(ends[c], ends[c + 1])) for c in range(CLASSES) if ends[c] < ends[c + 1]]
    for c, rows in used:
        np.matmul(hs[rows], wo[c], out=q[rows])
    _softmax(q)
    loss = -(np.log(np.maximum(p[own, kind], 1e-30)).sum() + np.log(np.maximum(q[own, within], 1e-30)).sum())
    p[own, kind] -= 1
    q[own, within] -= 1
    hs /= n
    g = hs.T @ p
    grad.wc += g[:HIDDEN]
    grad.bc += g[HIDDEN]
    dh_out = p @ net.wc.T
    for c, rows in used:
        g = hs[rows].T @ q[rows]
        grad.wo[c] += g[:HIDDEN]
        grad.bo[c] += g[HIDDEN]
        dh_out[rows] += q[rows] @ net.wo[c].T
    dh_out /= n
    out = np.zeros((len(word), HIDDEN), h.dtype)
    out[at] = dh_out
    out = out.reshape(states.shape)
    # Back through time: what reaches a step's inputs is its dh times `by`; the weights' products are made once.
    z, r = gates[..., :HIDDEN], gates[..., HIDDEN:]
    by = np.empty((*words.shape, 4, HIDDEN), h.dtype)  # of new by x, z, r, new by y
    by[..., 0, :] = (1 - z) * (1 - news * news)
    by[..., 1, :] = (states - news) * z * (1 - z)
    by[..., 2, :] = by[..., 0, :] * ys[..., 2 * HIDDEN :] * r * (1 - r)
    by[..., 3, :] = by[..., 0, :] * r
    if not full.all():
        by[~valid] = 0
        z[~valid] = 1
    flat = by.reshape(*words.shape, 4 * HIDDEN)
    back = np.ascontiguousarray(net.wh.T)
    dh = np.zeros_like(h)
    for t in reversed(range(n_steps)):
        by[t] *= dh[:, None]
        dh = dh * z[t]
        dh += flat[t, :, HIDDEN:] @ back
        dh += out[t]
        if fresh[t]:
            dh[begins[t]] = 0
    flat = flat.reshape(-1, 4 * HIDDEN)
    grad.wh += states.reshape(-1, HIDDEN).T @ flat[:, HIDDEN:]
    order = np.argsort(word.astype(np.int16), kind="stable")
    ordered = word[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    seen, sums = ordered[first], np.add.reduceat(flat[order, :width], first, axis=0)
    sums = np.roll(sums, -HIDDEN, axis=1)  # z, r, new, as in wx
    grad.b += sums.sum(0)
    grad.wx += net.emb[seen].T @ sums
    grad.emb[seen] += sums @ net.wx.T
    return h, loss / n


def _lanes(docs: list[np.ndarray]) -> list[list[np.ndarray]]:
    """The documents dealt to at most ``BATCH`` lanes of much the same length, longest lane first; whole, in their own order within a lane."""
    lanes: list[list[int]] = [[] for _ in range(min(BATCH, len(docs)))]
    heap = [(0, k) for k in range(len(lanes))]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        size, k = heap[0]
        lanes[k].append(i)
        heapq.heapreplace(heap, (size + len(docs[i]), k))
    return [[docs[i] for i in sorted(lanes[k])] for _, k in sorted(heap, reverse=True)]


def train(net: Network, docs: list[np.ndarray], squares: np.ndarray, rate: float = RATE) -> float:
    """Adagrad over truncated windows of lanes of documents; the mean loss of windows.  ``squares`` goes on from call to call."""
    total, windows = 0.0, 0
    lanes = _lanes(docs)
    size = np.array([sum(map(len, lane)) for lane in lanes])
    first = np.cumsum(size) - size
    flat = np.concatenate([d for lane in lanes for d in lane])
    opens = np.zeros(len(flat), bool)  # first tokens of documents
    opens[np.cumsum([0, *(len(d) for lane in lanes for d in lane)])[:-1]] = True
    h = np.zeros((len(lanes), HIDDEN), np.float32)
    grad = Network(np.zeros_like(net.flat))
    words = net.emb.size  # the embeddings come first
    embedded, step_ = squares[:words].reshape(net.emb.shape), np.empty_like(net.flat[words:])
    for t in range(0, int(size.max()), WINDOW):
        n = int((size > t).sum())
        step = np.arange(t, min(t + WINDOW, int(size.max())))[:, None]
        valid = step < size[None, :n]
        at = np.where(valid, first[None, :n] + step, 0)
        part = np.where(valid, flat[at], 0)
        h, loss = train_window(net, grad, h[:n], part, valid, opens[at] & valid)
        # Words outside the window have no gradient: only the others' rows move.
        seen = np.unique(part)
        rows, rest = grad.emb[seen], grad.flat[words:]
        # The last windows hold a few long documents only: a token counts as much there as anywhere.
        weight = np.float32(valid.sum() / (len(lanes) * WINDOW))
        rows *= weight
        rest *= weight
        norm = math.sqrt(rest @ rest + (rows * rows).sum())
        if norm > 1:
            rows /= norm
            rest /= norm
        sums = embedded[seen] + rows * rows
        embedded[seen] = sums
        net.emb[seen] -= rate * rows / np.sqrt(sums)
        np.multiply(rest, rest, out=step_)
        squares[words:] += step_
        np.sqrt(squares[words:], out=step_)
        np.divide(rest, step_, out=step_)
        step_ *= rate
        net.flat[words:] -= step_
        grad.emb[seen] = 0
        rest[:] = 0
        total, windows = total + loss, windows + 1
    return total / max(1, windows)


# --- Spark ----------------------------------------------------------------


def _trained(learn: DataFrame, start: np.ndarray, shards: int, r: int) -> np.ndarray:
    """Round ``r``: each of its shards of ``learn`` (id, words) trains from ``start`` (weights and squares); the means by tokens."""
    begin = learn.sparkSession.sparkContext.broadcast(start)
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    rows = learn.withColumn("shard", shard).filter(F.pmod("shard", F.lit(ROUNDS)) == r)
    parts = -(-len(start) // CHUNK)

    def fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens_, least = np.zeros(len(start)), 0, None
        shard, docs = None, []

        def settle() -> None:
            nonlocal tokens_, total
            flat, squares = np.split(begin.value.astype(np.float32), 2)
            net = Network(flat.copy())
            n, squares = sum(map(len, docs)), squares.copy()
            train(net, docs, squares)
            total += np.concatenate([net.flat, squares]).astype(np.float64) * n
            tokens_ += n

        for b in it:
            for s, words in zip(b.column("shard").to_pylist(), b.column("words").to_pylist(), strict=True):
                if s != shard and docs:
                    settle()
                    docs = []
                least = s if least is None else least
                shard = s
                docs.append(np.frombuffer(words, "<u2").astype(np.int64))
        if docs:
            settle()
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([least] * parts, pa.int32()), pa.array([tokens_] * parts, pa.int64()), pa.array([total[i * CHUNK : (i + 1) * CHUNK].tobytes() for i in range(parts)], pa.binary())], SUMS)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("least")
        w = np.sum([np.frombuffer(x) for x in group.w], axis=0)
        return pd.DataFrame({"part": group.part.iloc[:1], "least": group.least.iloc[:1], "n": [group.n.sum()], "w": [w.tobytes()]})

    own = -(-shards // ROUNDS)
    schema = "part int, least int, n long, w binary"
    sums = rows.select("shard", F.xxhash64("id", F.lit(1)).alias("mix"), "words").repartition(own, "shard").sortWithinPartitions("shard", "mix", "words").mapInArrow(fit, schema)
    groups = own
    while groups > 1:  # a task adds up MERGED of them at most, on average
        groups = -(-groups // MERGED)
        sums = sums.groupBy("part", F.pmod("least", F.lit(groups)).alias("to")).applyInPandas(add, schema)
    done = {x.part: np.frombuffer(x.w) / x.n for x in sums.collect()}  # one row per CHUNK weights
    return np.concatenate([done[i] for i in range(parts)]) if done else start


SUMS = ["part", "least", "n", "w"]


def _least_count(counts: DataFrame) -> int:
    """The least count that at most ``BROADCAST_WORDS`` words reach, in steps of an eighth of a doubling."""
    steps = counts.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("step")).agg(F.count("*").alias("n")).collect()  # some 500 rows at most
    least, words = 2**63 - 1, 0
    for r in sorted(steps, key=lambda r: -r.step):
        words += r.n
        if words > BROADCAST_WORDS:
            break
        least = math.ceil(2 ** (r.step / 8) - 1e-9)
    return least


def lm_scores(docs: DataFrame, id_col: str = "doc_id", folds: int = 10) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    base = docs.select(F.col(id_col).alias("id"), "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    learn = docs.filter(fold != 0)
    counts = cut(word_counts(learn.select("text")))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums.n, sums.v
    least = _least_count(counts)
    known = {bytes(r.word): r.c for r in counts.filter(F.col("c") >= least).collect()}  # at most BROADCAST_WORDS rows
    by_count = sorted(known, key=lambda w: (-known[w], w))
    vocabulary = by_count[:WORDS]
    inside = sum(known[w] for w in vocabulary)
    unigrams = np.zeros(WORDS + 1)
    unigrams[: len(vocabulary)] = [known[w] for w in vocabulary]
    unigrams[WORDS] = total - inside
    # log10 of: count smoothing for the base; the share of an unlisted word among the unlisted.
    logs = np.log10(np.array([known[w] for w in by_count], np.float64) + 0.1)
    places = {w: i for i, w in enumerate(by_count)}
    base_den = math.log10(total + 0.1 * (distinct + 1))
    rest_den = math.log10(total - inside + 0.1 * (distinct - len(vocabulary) + 1))
    listed = len(vocabulary)
    shared = spark.sparkContext.broadcast((places, logs))

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row its words' numbers in the network's vocabulary, what is known of them, and the words that aren't."""
        places, logs = shared.value
        place = places.get
        for b in batches_of(it, SCORE_BYTES, "text"):
            out = []
            for t in byte_rows(b, "text"):
                all_ = tokens(t)
                at = np.fromiter(map(place, all_, repeat(-1)), np.int64, len(all_))
                found = at[at >= 0]
                own = logs[found]
                rare = [all_[i] for i in np.flatnonzero(at < 0)] if len(found) < len(at) else []
                rest = own[found >= listed].sum() - (len(at) - np.count_nonzero(found < listed)) * rest_den
                out.append((len(all_), len(found), own.sum(), rest, rare, np.where((at < 0) | (at >= listed), WORDS, at).astype("<u2").tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.binary())
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], ["row", "id", "held_out", "n_tokens", "n_frequent", "base", "rest", "rare", "words"])

    kind = base.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, held_out boolean, n_tokens long, n_frequent long, base double, rest double"
    numbered = cut(base.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text").mapInArrow(number, f"{schema}, rare array<binary>, words binary"))
    state = np.concatenate([Network.start(unigrams).flat, np.full(Network.size(), 1e-6)])
    shards = max(ROUNDS, -(-total // SHARD_TOKENS))
    for r in range(ROUNDS):
        state = _trained(numbered.filter("id is not null and not held_out").select("id", "words"), state, shards, r)
    trained = spark.sparkContext.broadcast(state[: Network.size()].astype(np.float32))

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(trained.value)

        def settle(batches: list[pa.RecordBatch], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            s, at = score_documents(model, docs), 0
            for b in batches:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(b.column(6).to_numpy() + s[at : at + n])], [*b.schema.names[:6], "score"])
                at += n

        batches, docs, held = [], [], 0
        for b in it:
            docs += [np.frombuffer(x, "<u2").astype(np.int32) for x in b.column("words").to_pylist()]
            batches.append(b)
            held += b.column("words").nbytes // 2
            if held >= SCORE_TOKENS:
                yield from settle(batches, docs)
                batches, docs, held = [], [], 0
        yield from settle(batches, docs)

    scored = numbered.drop("rare").mapInArrow(score, schema.replace("rest", "score"))
    rare = numbered.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    found = rare.join(counts.filter(F.col("c") < least), "word", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    found = found.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 0.1)).alias("logs"))
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    done = scored.join(found, "row", "left")
    return done.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_frequent") + more).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(base_den)).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
