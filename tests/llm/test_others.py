import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from rillflow.llm import registry
from rillflow.llm.decontaminate import decontaminate, drop_contaminated
from rillflow.llm.sharding import balanced_shards
from rillflow.llm.topk import SlicedIndex, top_k
from rillflow.llm.toxicity import COMMA, CONJUNCTION, FLOOR, INSULT, LINE, NEGATION, PERSON, REPORTED, SENTENCE, TARGET, THREAT, WORDS, Lexicon, Matcher, drop_toxic, toxicity
from rillflow.llm.url_filter import RULES, UNWANTED, WANTED, rule_of, score, split_url, train, url_filter

from .conftest import SF, edge_rows


# --- 3 ---


def test_sliced_index_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, d = rng.integers(1, 300), rng.integers(1, 9)
        x = rng.integers(-rng.integers(1, 200), rng.integers(1, 200), (n, d))
        q, ids = rng.integers(-50, 50, d), np.sort(rng.integers(0, n + 3, n))
        own = rng.choice(ids)
        found, s = SlicedIndex(x, ids).search(q, own, 5)
        others = ids != own
        want = np.lexsort((ids[others], -(x @ q)[others]))[:5]
        assert found.tolist() == ids[others][want].tolist() and s.tolist() == (x @ q)[others][want].tolist()


def test_top_k_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, None), (3, []), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (50, [0.5, -0.25]), (50, [0.5, -0.25]), (None, [1.0, 1.0]), (100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("x", "x")
    got = [tuple(r) for r in top_k(df).orderBy("query_id", "rank").collect()]
    s = 128 * 128 + 64 * 64
    assert got == [(0, 1, 1, s), (0, 2, 50, s), (0, 3, 50, s), (50, 1, 0, s), (50, 2, 1, s), (100, 1, 7, 65536)]
    assert top_k(df.limit(0)).count() == 0


# --- 4 ---


def check_shards(df, shards=24):
    rows = df.select("doc_id", "text").collect()
    out = balanced_shards(df, shards).collect()
    unsigned = Counter((r.doc_id, len((r.text or "").encode()) + 8, None if r.text is None else zlib.crc32(r.text.encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == unsigned
    by = {s: sorted(r.slot for r in out if r.shard == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in by.values())
    counts = [len(v) for v in by.values()]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    assert {r.law for r in out} <= {"rows"} and all(r.grown_shard is None for r in out)
    return out, {r.doc_id: r.text for r in rows}


def test_sharding(spark, edge, repeated, empty):
    check_shards(edge)
    check_shards(repeated, 3)
    check_shards(empty)
    check_shards(spark.read.parquet(f"{SF}/documents.parquet"))
    # Groups of two to six copies, a third of all rows in one group: small groups stay whole, but for the few at the edges.
    rows = [(i, f"hot") for i in range(400)] + [(1000 + 10 * g + j, f"group {g}") for g in range(100) for j in range(2 + g % 5)] + [(5000 + i, f"single {i}") for i in range(400)]
    out, texts = check_shards(spark.createDataFrame(rows, "doc_id long, text string"), 6)
    where = {}
    for r in out:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(w) > 1 for t, w in where.items() if t != "hot") <= 10 and len(where["hot"]) <= 4


def test_sharding_goes_on_past_a_hot_group(spark):
    rows = [(i, "hot") for i in range(2000)] + [(6000 + 6 * g + j, f"group {g}") for g in range(300) for j in range(6)] + [(60000 + i, f"single {i}") for i in range(2200)]
    out, texts = check_shards(spark.createDataFrame(rows, "doc_id long, text string"))
    where = {}
    for r in out:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(w) > 1 for t, w in where.items() if t != "hot") <= 12


# --- 6 ---


def test_url_filter(spark, empty):
    urls = {
        None: ("", "", None), "nothing": ("", "", None), "http://A.Example.COM/en/7": ("a.example.com", "/en/7", "example.com/en/7"), "x://com/en/": ("com", "/en/", "com/en/"), "x://telecom/en/": ("telecom", "/en/", None),
        "https://m.example.com/en/8?x=/de/": ("m.example.com", "/en/8", "com/en/"), "https://example.net/de/81#a": ("example.net", "/de/81", "example.net/de/8"), "https://q.net/de/?": ("q.net", "/de/", "net/de/"),
        "https://example.org#/es/": ("example.org", "", None), "https://w.org/es/x": ("w.org", "/es/x", "org/es/"), "a://b?c://d/e": ("b", "", None), "": ("", "", None), "https://É.com/En/": ("É.com", "/En/", None),
    }
    rows = [(i, u, "x") for i, u in enumerate(urls)]
    got = url_filter(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    verdicts = dict(RULES)
    for r in got:
        assert (r.host, r.path, r.rule) == urls[rows[r.page_id][1]]
        if r.rule:
            assert r.verdict == verdicts[r.rule]
        else:
            assert r.verdict == ("block" if r.block_score >= 0.5 else "allow")
    assert url_filter(empty.selectExpr("doc_id as page_id", "text as url")).count() == 0
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    ordered = sorted(RULES, key=lambda r: -len(r[0]))
    for r in url_filter(pages).join(pages, "page_id").collect():
        assert (r.host, r.path) == split_url(r.url) and r.rule == (rule_of(r.host, r.path, ordered) or (None,))[0]


def test_url_model_on_held_out_hosts():
    """Every name of the table has a host of its own; ordinary hosts are allowed, nothing of the tables to be judged is in it."""
    hosts = [u.split("/")[0] for u in (*UNWANTED, *WANTED)]
    assert len(set(hosts)) == len(hosts)
    missed = wrong = 0
    for fold in range(5):
        w = train([u for i, u in enumerate(UNWANTED) if i % 5 != fold], [u for i, u in enumerate(WANTED) if i % 5 != fold])
        missed += sum(score([u.encode() for u in UNWANTED[fold::5]], w) < 0.5)
        wrong += sum(score([u.encode() for u in WANTED[fold::5]], w) >= 0.5)
    assert missed <= 0.1 * len(UNWANTED) and wrong <= 0.02 * len(WANTED)
    w = train(UNWANTED, WANTED)
    ordinary = ["en.wikipedia.org/wiki/Casino", "shop.bestbuy.com/product/1", "github.com/apache/spark", "www.example.com/", "stackoverflow.com/questions/11", "arxiv.org/abs/1706.03762", "docs.python.org/3/", "news.ycombinator.com/item", "qzvw.example.org/fr/9", "", "a"]
    assert max(score([u.encode() for u in ordinary], w)) < 0.5
    assert min(score([b"best-casino-bonus.net/play", b"cheapviagra-pills.org/", b"www.poker-slots.example.com/en/1"], w)) > 0.5
    names = {h.removeprefix(x) for r in duckdb.sql(f"select url from '{SF}/pages.parquet'").fetchall() for h in [split_url(r[0])[0]] for x in ("www.", "m.", "blog.", "") if h.startswith(x)}
    own = {n.split(".")[0] for n in names} - {"www", "m", "blog"}
    assert not own & {part for h in hosts for part in h.split(".")}


def test_url_filter_edges(spark):
    """Very long urls, repeated rows, clashing names."""
    long = "http://" + "a" * 300_000 + ".com/en/" + "b" * 300_000
    rows = [(1, long, "x", 0.5), (2, long, "y", 0.5), (1, long, "x", 0.5), (None, None, None, None)]
    got = url_filter(spark.createDataFrame(rows, "page_id long, url string, rule string, block_score double")).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "2", "None"] and all(r.rule == "com/en/" and r.verdict == "block" for r in got if r.page_id)


# --- 7 ---


def grammar(*symbols):
    m = Matcher()
    for s in symbols:
        m.read(s)
    return m.end()


def test_grammar_scores_clauses():
    assert grammar(INSULT) == 1 and grammar(TARGET, INSULT) == grammar(INSULT, TARGET) == grammar(PERSON, INSULT) == 1.25
    assert grammar(NEGATION, 0, INSULT) == pytest.approx(0.25) and grammar(NEGATION, 0, 0, 0, INSULT) == 1 and grammar(NEGATION, LINE, INSULT) == 1
    assert grammar(REPORTED, TARGET, INSULT) == pytest.approx(1.25 / 4) and grammar(REPORTED, SENTENCE, INSULT) == 1
    assert grammar(THREAT) == grammar(PERSON, THREAT) == grammar(THREAT, SENTENCE, TARGET) == 0 and grammar(TARGET, THREAT) == grammar(THREAT, TARGET) == 0.75
    assert grammar(THREAT, COMMA, CONJUNCTION, TARGET) == 0 and grammar(THREAT, COMMA, TARGET) == 0.75


#: Weighted words, as learned ones would be.
LEARNED = {"idiot$": 1.0, "scum$": 0.9}


def clause_score(text):
    """The grammar by hand: sentences, quotations and clauses cut by patterns, words looked up one by one."""
    import re

    kinds = {w: k for k, ws in WORDS.items() for w in ws.split()} | {w[:-1]: INSULT for w in LEARNED}
    total = 0.0
    for line in text.lower().splitlines():
        # A mark stands for a change of quotation; sentences end outside quotations only, but for a reported one.
        parts, quoted, pieces, reported_to_end, opened = re.split(r'(["“”„«»])', line), False, [], False, False
        for part in parts:
            if re.fullmatch(r'["“”„«»]', part):
                quoted = not quoted
                opened = quoted and reported_to_end
                if not quoted:
                    reported_to_end = False
                continue
            for sentence in re.findall(r"[^.!?]+[.!?]*|[.!?]+", part):
                for clause in re.split(r"[;:]|,(?=\s*(?:%s)\b)" % "|".join(WORDS[CONJUNCTION].split()), sentence):
                    words, weights, target, person, near = re.findall(r"[\w']+", clause), [], False, False, 0
                    for w in words:
                        k = kinds.get(w, 0)
                        target, person = target or k == TARGET, person or k == PERSON
                        factor = (0.25 if near else 1) * (0.25 if reported_to_end or opened else 1)
                        if k == INSULT:
                            weights.append((k, LEARNED[w + "$"] * factor))
                        if k == THREAT:
                            weights.append((k, factor))
                        if k == REPORTED:
                            reported_to_end = True
                            pieces.append(("speech", quoted, 0.0))
                        near = 3 if k == NEGATION else max(0, near - 1)
                    w = sum((1.25 if target or person else 1.0) * w if k == INSULT else 0.75 * w * target for k, w in weights)
                    pieces.append(("clause", quoted and not opened, w))
                if re.search(r"[.!?]\s*$", sentence) and not (quoted and not opened):
                    total += _settled(pieces)
                    pieces = []
                    reported_to_end = reported_to_end and opened
        total += _settled(pieces)
    return FLOOR + (1 - FLOOR) * (1 - np.exp(-total))


def _settled(pieces):
    speech = any(k == "speech" and not q for k, q, _ in pieces)
    return sum(w * (0.25 if q and speech else 1) for k, q, w in pieces if k == "clause")


def test_grammar_against_clauses_by_hand():
    words = Lexicon(LEARNED)
    for text in [
        "I will kill you.", "kill you", "We will hurt them tonight.", "you will kill", "they kill time", "not bad\nidiot", 'he wrote: "you idiot"', '"You idiot," he said.', '"You idiot."', "You are not an idiot", "an idiot",
        "she said that you are an idiot. You are scum", "never mind, and you are an idiot", 'he wrote: "you idiot" and you are scum', "they kill time, but you are nice", '"You idiot. You scum!" she said', "",
        "Kein idiot; du bist scum!", "he said you are an idiot\nscum", "idiot", "you, my friend, are an idiot", "murder the dog: you heard", 'no. "scum" and idiot', "the quick brown fox.",
    ]:
        assert words.score(text) == pytest.approx(clause_score(text), abs=1e-9), text
    rnd = np.random.default_rng(8)
    bag = ["you", "he", "idiot", "scum", "kill", "not", "the", "fox", "said", "and", "but", "never", "hurt", "them", "day"]
    for _ in range(400):
        text = "".join(w + str(rnd.choice(["", ",", ".", "!", ";", ":"], p=[0.6, 0.1, 0.1, 0.05, 0.1, 0.05])) + str(rnd.choice([" ", "\n"], p=[0.93, 0.07])) for w in rnd.choice(bag, rnd.integers(1, 30)))
        assert words.score(text) == pytest.approx(clause_score(text), abs=1e-9), text


def test_lexicon():
    words = Lexicon({"idiot$": 1.0, "lowei": 1.0})
    assert words.score(None) == words.score("") == words.score("fine day") == FLOOR
    assert words.score("You are an idiot.") > words.score("an idiot.") > words.score("said: he. not an idiot") > FLOOR
    assert words.score("xx LOWEIßen, yy") > 0.3
    assert words.score("loweih" + "e" * 100_000 + " " + "=" * 200_000 + "x idiot" + "!" * 100_000) > 0.8


@pytest.mark.parametrize("which", ["edge", "repeated", "empty"])
def test_toxicity_edges(spark, request, which):
    """Every row is scored as its text alone is; clashing names and other columns don't matter; rejected rows go."""
    df = request.getfixturevalue(which)
    text = "w10"  # a word of the edge texts that labels call toxic; learned words have three letters at least
    docs = spark.createDataFrame([(1000 + i, f"{text} w{i}" if i % 4 == 0 else f"plain w{2 + i}") for i in range(120)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(text like 'w10 %' as int) as toxic")
    from rillflow.llm.toxicity import learned_lexicon

    lexicon = learned_lexicon(docs, labels)
    assert "w10$" in lexicon
    both = df.select("doc_id", "text").unionByName(docs)
    words = Lexicon(lexicon)
    want = Counter((r.doc_id, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2, words.score(r.text)) for r in both.collect())
    assert Counter((r.doc_id, r.held_out, r.score) for r in toxicity(both, labels).collect()) == want
    kept = drop_toxic(both.withColumns({"score": both.doc_id, "toxic": both.text}), labels)
    assert kept.columns == ["doc_id", "text", "score", "toxic"] and Counter(r.doc_id for r in kept.collect()) == Counter(i for (i, _, s), n in want.items() for _ in range(n) if s < 0.3)


def test_toxicity_learns_from_labels(spark, repeated, empty):
    rnd = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + c) for c in rnd.integers(0, 26, 6))
    docs, labels = [], []
    for i in range(400):
        w = [word() for _ in range(30)]
        bad = i % 8 == 0
        if bad:
            w[5], w[20] = "grubnak", "Zorpled" + word() + ","
        docs.append((i, " ".join(w), 1))
        labels.append((i, None if i == 3 else int(bad)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.doc_id % 8 == 0) == int(r.score >= 0.3) for r in got) and len(got) == 400
    none = toxicity(repeated, labels.limit(0)).collect()
    assert len(none) == 7 and all(r.predicted == 0 for r in none) and toxicity(empty, labels).count() == 0


# --- 8 ---


@pytest.mark.parametrize("which", ["edge", "repeated", "empty"])
def test_decontamination_edges(spark, request, which):
    df = request.getfixturevalue(which)
    base = dict(edge_rows())[6].split()
    items = spark.createDataFrame([(1, " ".join(base[:40])), (2, "One"), (3, "two-THREE"), (4, None), (5, ""), (None, "one"), (6, " ".join(base[30:39])), (7, "日本語 x"), (8, " ".join(base[:40]))], "item_id long, text string")
    db = duckdb.connect()
    documents, benchmark = df.select("doc_id", "text").toPandas(), items.toPandas()
    documents = documents.assign(rid=range(len(documents)))
    sql = registry.ORACLE_SQL["op8_decontamination"]
    # Rows are told apart by a number of their own, as ids may repeat.
    benchmark["item_id"] = benchmark["item_id"].astype("Int64")
    db.register("documents_", documents)
    db.register("benchmark_", benchmark)
    db.execute("create table documents as select rid as doc_id, cast(text as varchar) as text from documents_")
    db.execute("create table benchmark as select item_id, cast(text as varchar) as text from benchmark_")
    want = Counter()
    names = documents.set_index("rid")["doc_id"].to_dict()
    for r in db.execute(sql).fetchall():
        d = names[r[0]]
        want[(None if d != d or d is None else int(d), *r[1:])] += 1
    assert Counter(tuple(r) for r in decontaminate(df, items).collect()) == want
    clean = sum(n for r, n in want.items() if not r[5])
    assert drop_contaminated(df, items).count() == clean


def test_decontamination_of_nothing(edge, spark):
    got = decontaminate(edge, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == len(edge_rows()) and not any(r.contaminated for r in got)


# --- all ---


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "pages", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_query_equals_its_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    sql = db.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in sql.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, sql.fetchall()))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        before = stage
        stage = f(spark, stage, SF)
        assert stage.columns == docs.columns and stage.dtypes == docs.dtypes
        assert {r.doc_id for r in stage.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in stage.select("doc_id").collect()}


def test_pipeline_against_brute_force(spark):
    """The same stages by hand: scores from the grammar, all pairs, all windows, all item windows, the tokenizer itself."""
    import re

    import corpus_pipeline

    from .test_texts import check_packing, components_by_hand

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = dict(tuple(r) for r in docs.select("doc_id", "text").collect())
    bad = {r.doc_id for r in toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    rows = {i: t for i, t in rows.items() if i not in bad}
    keep = {i for i, _, _, kept in components_by_hand(list(rows.items()), k=5) if kept}
    rows, seen, texts = {i: t for i, t in rows.items() if i in keep}, set(), {}
    for i in sorted(rows):
        b = rows[i].encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        texts[i] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    split = lambda t: [w for w in re.split("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = {i: t for i, t in texts.items() if not any(tuple(w[j : j + n]) in windows for w in [split(t)] for n in sizes for j in range(len(w) - n + 1))}

    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
    assert {r.doc_id: r.text for r in stage.collect()} == clean
    assert all(r.n_chars == len(r.text) for r in stage.collect() if rows[r.doc_id] != r.text)
    check_packing(stage, list(clean.items()))


@pytest.mark.parametrize("which", ["edge", "repeated", "empty"])
def test_pipeline_stages_on_edge_tables(spark, request, which):
    """Nulls, empty and very long texts, copies, repeated rows and ids, an empty table, clashing names: rows go or stay whole."""
    import corpus_pipeline
    from pyspark.sql import functions as F
    from rillflow.llm.common import cut

    from .test_texts import components_by_hand, removed_by_hand

    stage = request.getfixturevalue(which).withColumns({"n_removed": F.lit(7), "_row": F.lit(8), "all": F.lit("x"), "n_chars": F.char_length("text")})
    counted = lambda df: Counter(tuple(r) for r in df.select("doc_id", "n_removed", "_row", "all").collect())
    for name, f in corpus_pipeline.STAGES[:-1]:
        before, out = stage, cut(f(spark, stage, SF))
        assert out.columns == before.columns and out.dtypes == before.dtypes
        had, left = counted(before), counted(out)
        assert not left - had
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "near_dedup" and which == "edge":
            assert {i for i, *_ in left} == {i for i, _, _, kept in components_by_hand(rows, 5) if kept}
        if name == "near_dedup" and which == "repeated":
            texts = [t for _, t in rows if t]
            assert sorted(r.text for r in out.collect() if r.text) == sorted(set(texts))
        if name == "suffix_dedup":
            assert left == had and [r.text for r in out.collect() if r.text is None] == [t for _, t in rows if t is None]
        if name == "suffix_dedup" and which == "edge":
            gone = removed_by_hand(rows)
            assert all(len((r.text or "").encode()) == gone[r.doc_id][0] - gone[r.doc_id][1] and (r.text is None or r.n_chars == len(r.text)) for r in out.collect())
        if name == "decontamination":
            assert left == had
        stage = out
    packed = corpus_pipeline.STAGES[-1][1](spark, stage, SF)
    assert Counter(r.doc_id for r in packed.filter("piece = 0").collect()) == Counter(r.doc_id for r in stage.collect())


def test_remove_repeats_keeps_a_column_of_its_name(spark):
    from rillflow.llm.suffix_dedup import remove_repeats

    df = spark.createDataFrame([(1, "ab" * 120, 7), (2, "x", 9)], "doc_id long, text string, n_removed int")
    assert {(r.doc_id, r.n_removed, r.n_removed_) for r in remove_repeats(df).collect()} == {(1, 7, 238), (2, 9, 0)}
