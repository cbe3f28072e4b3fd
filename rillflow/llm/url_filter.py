"""URL filter: prefix rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from the small labelled table below (its
size is fixed, and it knows nothing of the tables to be judged), and its
``DIMENSIONS`` weights are broadcast.  Its bias is set for a share ``PRIOR`` of
unwanted urls.  Batches of urls are bounded in bytes.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased.  Path: from there up to ``?``, ``#`` or the end.  A url that is
null or has no ``://`` has an empty host and path; no rule fits it and the
method judges the empty strings.  A rule fits its host and all subdomains when
the path starts with the rule's; the longest rule wins.  Repeated rows are
judged each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import batches_of, bounded_batches, mix64

DIMENSIONS = 1 << 15
BATCH_BYTES = 1_000_000
GRAMS = (3, 4, 5)

#: (pattern, verdict).  A rule is host + path.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

#: The labelled table is made by a rule from these words: hosts of two words of one kind, in the same forms for both kinds.
UNWANTED_WORDS = """
casino casinos poker slots jackpot roulette bingo lottery bet bets betting sportsbook bonus win prize giveaway free cheap discount outlet
pills viagra cialis pharma meds steroids loans payday cash forex crypto bitcoin ads adserver popup banner tracker track click pixel affiliate
porn xxx sex adult cams webcam nude escort singles hot spam seo backlinks links followers farm crack keygen warez serials torrent replica rolex
""".split()
WANTED_WORDS = """
library museum gallery history science nature news journal times daily weather maps travel garden recipes kitchen music theatre school
university college course docs developer code kernel data research health hospital clinic council city village park trails railway bridge river
mountain farm dairy bakery books poetry language grammar physics chemistry astronomy biology chess cycling rowing football running yoga photo
paint craft sewing charity church choir legal tax census energy solar winter window freedom tracks adverbs betterment crystal linker shop store
open project forum wiki archive society institute observatory parliament teacher student family kids home house street bank union insurance
""".split()
PREFIXES = ("", "www.", "m.", "blog.")
ENDINGS = (".com", ".org", ".net", ".de", ".fr", ".es", ".info")
PATHS = ("/", "/en/{n}", "/de/{n}", "/fr/{n}.html", "/es/{n}/", "/shop/{n}", "/watch/{n}", "/{word}/{n}", "/wiki/{word}")


def labelled(own: list[str], paths: list[str], rounds: int = 4) -> list[str]:
    """``rounds`` names per word of ``own``: with another word of its kind and, in turn, each prefix, ending and form of path."""
    out = []
    for r in range(rounds):
        for i, word in enumerate(own):
            n = r * len(own) + i
            other = own[(i * 7 + 11 * r + 3) % len(own)]
            host = PREFIXES[(i + r) % len(PREFIXES)] + word + ("-" if n % 3 else "") + other + ENDINGS[(i + 3 * r) % len(ENDINGS)]
            out.append(host + PATHS[(i + 5 * r) % len(PATHS)].format(n=n * 37 % 9000, word=paths[n % len(paths)]))
    return out


#: Paths hold words of both kinds on wanted hosts, so that an article about a trade isn't the trade.
UNWANTED = labelled(UNWANTED_WORDS, UNWANTED_WORDS)
WANTED = labelled(WANTED_WORDS, [w for pair in zip(WANTED_WORDS, UNWANTED_WORDS) for w in pair])
#: Share of unwanted urls to expect: the bias is moved there from the table's own share, so that an unknown name is allowed.
PRIOR = 0.2


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for end in "?#":
        rest = rest.split(end, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def rule_of(host: str, path: str, rules: list[tuple[str, str]]) -> tuple[str, str] | None:
    """The longest rule that fits; ``rules`` are longest first."""
    for rule, verdict in rules:
        at = rule.index("/")
        name = rule[:at]
        if path.startswith(rule[at:]) and (host == name or host.endswith("." + name)):
            return rule, verdict
    return None


def features(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all names one after the other, and where each name's begin (every name has one at least)."""
    data = np.frombuffer(b"".join(b"\x02\x02" + x + b"\x03\x03" for x in names), np.uint8).astype(np.uint64)
    size = np.fromiter((len(x) + 4 for x in names), np.int64, len(names))
    end = np.cumsum(size)
    at, gram = [], []
    limit = np.repeat(end, size)
    for n in GRAMS:
        h = np.zeros(len(data), np.uint64)
        for i in range(n):
            h[: len(data) - i] = h[: len(data) - i] * np.uint64(1_099_511_628_211) + data[i:] + np.uint64(n)
        ok = np.arange(len(data)) + n <= limit
        at.append(np.flatnonzero(ok))
        gram.append(h[ok])
    at_all = np.concatenate(at)
    order = np.argsort(at_all, kind="stable")
    gram_all = (mix64(np.concatenate(gram)) % np.uint64(DIMENSIONS)).astype(np.int64)[order]
    return gram_all, np.searchsorted(at_all[order], end - size)


def train(unwanted: list[str], wanted: list[str], rounds: int = 400, rate: float = 2.0, momentum: float = 0.95, decay: float = 1e-5, prior: float = PRIOR) -> np.ndarray:
    """Weights, the last one the bias: gradient descent with momentum on the mean log loss over n-gram frequencies."""
    names = [x.encode() for x in (*unwanted, *wanted)]
    gram, start = features(names)
    used, gram = np.unique(gram, return_inverse=True)
    length = np.diff([*start, len(gram)])
    row = np.repeat(np.arange(len(names)), length)
    scale = 1 / np.sqrt(length)[row]
    y = np.r_[np.ones(len(unwanted)), np.zeros(len(wanted))]
    w, step = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for _ in range(rounds):
        z = np.bincount(row, w[gram] * scale, len(names)) + w[-1]
        e = 1 / (1 + np.exp(-z)) - y
        step *= momentum
        step[:-1] -= rate * (np.bincount(gram, e[row] * scale, len(used)) / len(names) + decay * w[:-1])
        step[-1] -= rate * e.mean()
        w += step
    out = np.zeros(DIMENSIONS + 1)
    out[used], out[-1] = w[:-1], w[-1]
    own = len(unwanted) / len(names)
    out[-1] += math.log(prior / (1 - prior)) - math.log(own / (1 - own))
    return out


def score(names: list[bytes], w: np.ndarray) -> np.ndarray:
    """Probability that a name (host and path) is unwanted."""
    if not names:
        return np.zeros(0)
    gram, start = features(names)
    z = np.add.reduceat(w[gram], start) / np.sqrt(np.diff([*start, len(gram)])) + w[-1]
    return 1 / (1 + np.exp(-z))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] = RULES, unwanted: list[str] = UNWANTED, wanted: list[str] = WANTED, id_col: str = "page_id", threshold: float = 0.5) -> DataFrame:
    """Per row: id, host, path, rule, verdict, block_score (the method's, for every row)."""
    bounded_batches(pages.sparkSession)
    w = pages.sparkSession.sparkContext.broadcast(train(unwanted, wanted))
    ordered = sorted(rules, key=lambda r: -len(r[0]))

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, BATCH_BYTES, "url"):
            parts = [split_url(u) for u in b.column("url").to_pylist()]
            p = score([f"{h}{x}".encode() for h, x in parts], w.value)
            found = [rule_of(h, x, ordered) for h, x in parts]
            verdict = [f[1] if f else "block" if s >= threshold else "allow" for f, s in zip(found, p, strict=True)]
            cols = [pa.array([h for h, _ in parts], pa.string()), pa.array([x for _, x in parts], pa.string()), pa.array([f[0] if f else None for f in found], pa.string()), pa.array(verdict, pa.string()), pa.array(p, pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, "host", "path", "rule", "verdict", "block_score"])

    pages = pages.select(F.col(id_col), "url")
    return pages.mapInArrow(judge, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string, block_score double")
