"""Token counts of whole texts by a two-tier, map-side lookup of pre-token lengths.

Tier 1 is a compact table (pre-token -> number of tokens) of the most frequent
pre-tokens, built once and broadcast; its size is bounded by ``table_size``.
Tier 2 is a per-worker cache filled by the tokenizer itself.  No pre-token of
the corpus is ever shuffled: only each task's bounded summary of frequent ones.

The sentencepiece model's pieces hold U+2581 only as a prefix and never hold a
line feed, so no merge crosses the start of a space or a line feed.  A text is
therefore the sum of its pieces cut there.  Texts with another use of spaces
(runs, leading or trailing ones) or with a literal U+2581 go to the tokenizer
whole.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted each; a null id stays null; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import batches_of, bounded_batches, byte_rows, cut

TABLE_SIZE = 65_536
CACHE_SIZE = 400_000
CACHED_CHARS = 64  # longer pre-tokens are neither counted as frequent nor cached: a text without spaces is one
BATCH_BYTES = 4_000_000
_workers: dict = {}


def _pretokens(text: str) -> list[str] | None:
    """Cuts before spaces and line feeds; None if the text needs the tokenizer as a whole."""
    cut = text.replace("\n", " \n")
    if not text or cut[0] == " " or cut[-1] == " " or "  " in cut or "▁" in text:
        return None
    return cut.split(" ")


class Lengths(dict):
    """pre-token -> tokens; misses are encoded, then cached up to a bound."""

    def __init__(self, model: str, known: dict[str, int], bound: int = CACHE_SIZE):
        import sentencepiece

        super().__init__(known)
        self.known, self.bound = known, bound
        self.encode = sentencepiece.SentencePieceProcessor(model_file=model).encode

    def __missing__(self, word: str) -> int:
        # Only a space gives a piece its prefix; after a line feed there is none, so its token is taken off.
        n = len(self.encode(word)) - (word[0] == "\n")
        if len(word) <= CACHED_CHARS:
            if len(self) >= self.bound + len(self.known):
                self.clear()
                self.update(self.known)
            self[word] = n
        return n

    def of(self, text: str) -> int:
        if not text:
            return 0
        words = _pretokens(text)
        return len(self.encode(text)) if words is None else sum(map(self.__getitem__, words))


def frequent_pretokens(docs: DataFrame, size: int = TABLE_SIZE) -> list[str]:
    """The most frequent pre-tokens, from every task's own most frequent ``size`` (bounded rows per task)."""

    def summarise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in it:
            for t in b.column("text").to_pylist():
                if t and (words := _pretokens(t)):
                    seen.update(words if max(map(len, words)) <= CACHED_CHARS else [w for w in words if len(w) <= CACHED_CHARS])
            if len(seen) > 16 * size:
                seen = Counter(dict(seen.most_common(4 * size)))
        top = [x for x in seen.most_common(size) if x[1] > 1]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(summarise, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = cut(rows)
    total = rows.agg(F.sum("n").alias("n")).first().n or 0
    # Words with at least this share are 8 * size at most; the driver picks the size most frequent of them.
    often = rows.filter(F.col("n") >= total / (8 * size)).collect()
    often.sort(key=lambda r: (-r.n, r.word))
    return [r.word for r in often[:size] if "\x00" not in r.word]


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", limit: int = 4096, table_size: int = TABLE_SIZE) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    import sentencepiece

    docs = docs.select(F.col(id_col), "text")
    bounded_batches(docs.sparkSession)
    words = frequent_pretokens(docs, table_size)
    encode = sentencepiece.SentencePieceProcessor(model_file=model).encode
    lengths = bytes(min(255, len(x) - (w[0] == "\n")) for w, x in zip(words, encode(words) if words else [], strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(("\x00".join(words), lengths))  # at most table_size entries

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (model, shared.value[0][:64], len(shared.value[1]))
        if key not in _workers:
            _workers.clear()
            table = dict(zip(shared.value[0].split("\x00"), shared.value[1], strict=True)) if shared.value[1] else {}
            _workers[key] = Lengths(model, {w: n for w, n in table.items() if n < 255})
        lengths_of = _workers[key]
        for b in batches_of(it, BATCH_BYTES, "text"):
            texts = b.column("text").to_pylist()
            tokens = [lengths_of.of(t) for t in texts]
            size = [len(x) if x else 0 for x in byte_rows(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
