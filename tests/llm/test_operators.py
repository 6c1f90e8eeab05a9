"""Each operator against brute force, a library, SQL or held-out rows, and on awkward input."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from emberlog.llm import chat_format, components, decontamination, language_id, line_dedup, mixing, registry, simhash, simhash_similar, substring_dedup, token_counts, topk_search, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, score string, row string"
AWKWARD = [
    (1, "the same line of some length\nshort\nthe same line of some length"),
    (2, "  THE same line of some length\t\nother words follow here"),
    (3, "the same line of some length\r\nlast"),
    (4, None),
    (5, ""),
    (6, "   \n\t"),
    (7, "word " * 3000),
    (7, "another text under a used id"),
    (8, "the quick brown fox jumps over the lazy dog and runs far away from it all again"),
    (8, "the quick brown fox jumps over the lazy dog and runs far away from it all again"),
    (None, "the quick brown fox jumps over the lazy dog and runs far away from it all again"),
    (9, "x" * 5000),
    (10, "é中😀   ▁"),
    (None, None),
]


def documents(spark, rows=AWKWARD):
    source = ["b", "a", None]
    return spark.createDataFrame([(i, t, "en", source[n % 3], 0, "x", "y", "z") for n, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def texts():
    found = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    return dict(found)


def words(text):
    return (text or "").encode().split()


def least_reachable(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# 1


def test_token_counts_agree_with_the_library(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    got = {r.doc_id: r for r in registry.QUERIES["op1_token_counts"](spark, SF).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(model.encode(t or "")) for i, t in texts.items()}
    assert all(r.n_bytes == len((texts[i] or "").encode()) and r.over_limit == (r.n_tokens > 4096) for i, r in got.items())
    counter, rng = token_counts.counter(token_counts.default_model()), random.Random(3)
    letters = "ab  \n\t\r;}e▁éß中😀<>/s　\x00  the"
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert counter.count(t) == len(model.encode(t)), t
    for t in ("<s> hi </s>", "<0x0A>", "  lead", "trail  ", " ", "x" * 4000, "ab" * 3000):
        assert counter.count(t) == len(model.encode(t))


def test_token_counts_of_awkward_rows(docs, empty):
    out = token_counts.with_token_counts(docs.withColumn("n_tokens", F.lit("old"))).collect()
    assert len(out) == len(AWKWARD) and [r.n_tokens for r in out if not r.text] == [0, 0, 0]
    assert token_counts.with_token_counts(empty).count() == 0


# 2


def test_simhash_fingerprints_and_components(spark, texts):
    def fingerprint(text):
        w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in texts.items()}
    expected = least_reachable(sorted(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = registry.QUERIES["op2_simhash"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", expected[i]) for i in texts}


def test_simhash_links_of_crowded_shards(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 400:
        x = rng.choice(sorted(prints)) if rng.random() < 0.5 else centre
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    rows = [(x - (1 << 64) if x >> 63 else x, n) for n, x in enumerate(sorted(prints))]
    by_node = {n: x & ((1 << 64) - 1) for x, n in rows}
    expected = least_reachable(sorted(by_node), lambda a, b: (by_node[a] ^ by_node[b]).bit_count() <= 2)
    for shard_rows in (8, 10_000):  # shards that are cut again, and shards that are not
        links = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long, node long"), shard_rows=shard_rows)
        roots = {r.node: r.root for r in components.components(links).collect()}
        assert {n: roots.get(n, n) for n in by_node} == expected


def test_simhash_of_awkward_rows(docs, empty):
    got = defaultdict(set)
    for r in simhash.near_duplicates(docs).collect():
        got[r.doc_id].add((r.fp, r.component_id))
    assert {c for i in (4, 5, 6) for _, c in got[i]} == {4} and all(f == 0 for i in (4, 5, 6) for f, _ in got[i])
    assert {c for _, c in got[8]} == {8} and {c for _, c in got[None]} == {8, 4}
    assert len({c for _, c in got[7]}) == 1
    assert simhash.near_duplicates(empty).count() == 0


def test_similar_documents(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(40)]
    rows = [(n, " ".join(w)) for n, w in enumerate(base)]
    for n, w in enumerate(base[:20]):
        w = list(w)
        w[rng.randrange(len(w))] = "edited"
        rows.append((100 + n, " ".join(w)))
        rows.append((200 + n, "  ".join(base[n]).upper()))
    for n, w in enumerate(base[20:]):  # half of the words are others
        rows.append((300 + n, " ".join(w[:100] + [rng.choice(vocabulary) for _ in range(100)])))
    got = {r.doc_id: r.component_id for r in simhash_similar.similar_documents(documents(spark, rows)).collect()}
    assert all(got[100 + n] == got[200 + n] == n for n in range(20))
    assert all(got[300 + n] == 300 + n for n in range(20))


def test_similar_documents_of_awkward_rows(docs, empty):
    got = {(r.doc_id, r.component_id) for r in simhash_similar.similar_documents(docs).collect()}
    assert {(4, 4), (5, 4), (6, 4), (8, 8), (None, 8), (None, 4)} <= got
    assert simhash_similar.similar_documents(empty).count() == 0


def test_jaccard_and_bands():
    a, b = (np.sort(np.array(x, np.uint32)).tobytes() for x in ([1, 2, 3, 4], [3, 4, 5]))
    assert simhash_similar.jaccard(a, 4, b, 3) == 2 / 5
    few, many = simhash_similar.bands(1000), simhash_similar.bands(10_000_000)
    assert few.shape[1] == 16 and many.shape[1] > 16 and len(many) == len(few) == simhash_similar.BANDS


def test_rows_without_ids_connect_nothing_unrelated(spark):
    rng = random.Random(20)
    a, b = ([f"w{rng.getrandbits(30)}" for _ in range(80)] for _ in range(2))
    rows = [(5, " ".join(a)), (9, " ".join(b)), (None, " ".join([*a[:-1], "other"])), (None, " ".join([*b[:-1], "other"])), (None, "alone")]
    for f in (simhash_similar.similar_documents, simhash.near_duplicates):
        got = {(r.doc_id, r.component_id) for r in f(documents(spark, rows)).collect()}
        assert {(5, 5), (9, 9), (None, None)} <= got and (9, 5) not in got
    got = simhash_similar.similar_documents(documents(spark, rows)).collect()
    assert Counter(r.component_id for r in got) == {5: 2, 9: 2, None: 1}
    links = simhash.fingerprint_links(spark.createDataFrame([(0, 0), (1, 1), (-1, -1), (-2, -2)], "fp long, node long"))
    assert {(r.node, r.root) for r in components.components(links).collect()} == {(1, 0), (-1, -2)}


def test_shards_of_many_are_dealt_to_several_trees(spark):
    rng = random.Random(21)
    prints = [rng.getrandbits(63) for _ in range(5)]
    rows = [(0, n, prints[n % 5] ^ (1 << rng.randrange(60))) for n in range(500)]
    links = simhash_similar.shard_links(spark.createDataFrame(rows, "key long, node long, fp long"), 20, tree_rows=40)
    groups = defaultdict(set)
    for r in components.components(links).collect():
        groups[r.root].add(r.node % 5)
    assert len(groups) == 5 and all(len(g) == 1 for g in groups.values())


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    nodes = sorted({n for e in edges for n in e})
    pairs = {tuple(sorted(e)) for e in edges}
    expected = least_reachable(nodes, lambda a, b: (a, b) in pairs)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "node long, other long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == expected
    assert components.components(spark.createDataFrame([], "node long, other long")).count() == 0


def test_few_links_are_connected_by_one_task(spark, monkeypatch):
    rng = random.Random(22)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(230)] + [(-1000 - i, -1001 - i) for i in range(60)] + [(5, 5)] * 3
    frame = spark.createDataFrame(edges, "node long, other long")
    by_steps = sorted(map(tuple, components.components(frame).collect()))
    steps = []
    monkeypatch.setattr(components, "_large_star", lambda edges, f=components._large_star: steps.append(1) or f(edges))
    assert sorted(map(tuple, components.components(frame, 1000).collect())) == by_steps
    assert components.components(frame.limit(0), 1000).count() == 0
    rows = [(i, f"one text of a few words with {'x' if i % 3 else 'y'}") for i in range(12)]
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(documents(spark, rows)).collect()} == {(i, min(1, i % 3)) for i in range(12)}
    assert not steps
    assert sorted(map(tuple, components.components(frame, 10).collect())) == by_steps and steps


# 3


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_sql_gives_the_same(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    found = c.sql(registry.ORACLE_SQL[name])
    plain = lambda r: tuple(round(v, 5) if isinstance(v, float) else v for v in r)
    assert sorted(plain(r[x] for x in found.columns) for r in df.collect()) == sorted(map(plain, found.fetchall()))


def test_lines_of_awkward_rows(docs, empty):
    out = line_dedup.drop_repeated_lines(docs).collect()
    assert len(out) == len(AWKWARD)
    by = {r.doc_id: r for r in out if r.doc_id not in (7, 8, None)}
    assert (by[1].text, by[1].n_lines, by[1].n_dropped) == ("short", 3, 2)
    assert (by[2].text, by[3].text) == ("other words follow here", "the same line of some length\r\nlast")
    assert (by[4].text, by[4].n_lines, by[5].text, by[6].text, by[6].n_lines) == ("", 1, "", "   \n\t", 2)
    # ids 8, 8 and null are two documents
    assert [r.n_dropped for r in out if r.doc_id in (8, None)] == [0, 0, 0, 0]
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_line_runs_are_levelled_and_joined(spark):
    runs, rng, seen, last = line_dedup.LineRuns(spark, buckets=4), random.Random(3), Counter(), {}
    for n in range(7):
        batch = {(n * 1000 + rng.randrange(50), rng.randrange(60)) for _ in range(80)}
        for d, k in batch:
            seen[k] += 1
            last[k] = max(last.get(k, d), d)
        runs.add(spark.createDataFrame([(d, k, -k) for d, k in batch], "doc_id long, h1 long, h2 long"))
        assert all(len(level) < line_dedup.FANOUT for level in runs.levels) and len(runs.more) < line_dedup.FANOUT
        for least in (1, 3):
            assert sorted((r.h1, r.docs, r.last) for r in runs.often(least).collect()) == sorted((k, c, last[k]) for k, c in seen.items() if c >= least)
    assert len(runs.levels) == 2
    # a key is in one run, and joins of runs move nothing
    keys = [r.h1 for level in runs.levels for run in level for r in run.select("h1").collect()]
    assert len(keys) == len(set(keys)) == len(seen)
    some = next(run for level in runs.levels for run in level)
    plan = runs.unseen(some)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert [r.h1 for r in runs.unseen(spark.createDataFrame([(1, -1), (99, -99)], "h1 long, h2 long")).collect()] == [99] or 1 not in seen


def removed(texts):
    first, out = {}, {}
    for d, t in texts.items():
        for i in range(len(words(t)) - 12):
            key = tuple(words(t)[i : i + 13])
            first[key] = min(first.get(key, d), d)
    for d, t in texts.items():
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("batch", [2_000, 1_500_000])
def test_substrings_by_brute_force(spark, texts, monkeypatch, batch):
    monkeypatch.setattr(substring_dedup, "BATCH_WINDOWS", batch)
    got = registry.QUERIES["op4_substring_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == removed(texts)


def test_substrings_of_awkward_rows(docs, empty):
    out = substring_dedup.repeated_windows(docs).collect()
    assert len(out) == len(AWKWARD)
    assert sorted((r.doc_id or 0, len(r.at or [])) for r in out if r.at) == [(0, 5)]
    assert substring_dedup.repeated_windows(empty).count() == 0


def test_runs_are_packed_compacted_and_given_as_history(spark):
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64))
    run = (h, np.arange(50, dtype=np.uint16), np.repeat([7, 9], 25), np.zeros(50, np.int32), np.arange(50))
    for a, b in zip(run, substring_dedup.unpacked(substring_dedup.packed(*run))):
        assert (a == b).all()
    old = documents(spark, [(1, " ".join(f"a{i}" for i in range(20)))]).withColumn("seq", F.lit(0))
    index = substring_dedup.compacted(substring_dedup.window_runs(old, 13, 64))
    assert index.count() <= 8
    new = documents(spark, [(2, "x y " + " ".join(f"a{i}" for i in range(14))), (3, "none of it")])
    out = {r.doc_id: sorted(r.at or []) for r in substring_dedup.repeated_windows(new, history=index, buckets=64).collect()}
    assert out == {2: [2, 3], 3: []}


# 5


def test_chats_read_back(spark):
    odd = ["", "### ", "</turn>", "\\", "\\### x</turn>\\\\", "a\n### user: b</turn>\n", "é😀#### </turn", None]
    rows = [(c, t, role, odd[(c + t) % len(odd)], "x") for c in range(8) for t, role in enumerate(["system: x", "user", "assistant", "a\\</turn>"])]
    rows += [(None, 1, None, None, "x"), (None, None, "assistant", "first", "x"), (3, 2, "assistant", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert len(out) == 9
    for c, r in out.items():
        key = lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")
        own = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=key)]
        assert chat_format.read_back(r.formatted) == own
        assert [chat_format.unescaped(r.formatted[b:e]) for b, e in zip(r.loss_begin, r.loss_end)] == [t for role, t in own if role == "assistant"]
    assert chat_format.format_chats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat_format.read_back("### user: x")


def test_chats_across_batches(spark):
    import pyarrow as pa

    rows = [(c, "user", f"{c} {t}") for c in range(5) for t in range(c + 1)]
    table = pa.table({n: list(x) for n, x in zip(("conv_id", "role", "text"), zip(*rows))})
    whole = [r for b in chat_format.formatted_batches(iter(table.to_batches())) for r in b.to_pylist()]
    parts = [r for b in chat_format.formatted_batches(iter(table.to_batches(max_chunksize=2))) for r in b.to_pylist()]
    assert whole == parts and [r["n_turns"] for r in whole] == [1, 2, 3, 4, 5]


# 6


def toxic_rows(rng, n, first=0):
    plain = ["the", "garden", "water", "reading", "stone", "window", "evening", "careful", "paper", "river", "market", "silver"]
    rude = ["idiot", "worthless", "moron"]
    rows = []
    for i in range(first, first + n):
        y = int(rng.random() < 0.3)
        w = [rng.choice(plain) for _ in range(30)]
        if y:
            w[rng.randrange(30)] = rng.choice(rude)
        rows.append((i, " ".join(w), y))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    train, test = toxic_rows(rng, 300), toxic_rows(rng, 100, 300)
    frame = spark.createDataFrame([(i, t) for i, t, _ in train + test] + [(900, None), (901, ""), (902, "you id-i-ot"), (903, "i d i o t")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train] + [(1, None), (2, train[2][2])], "doc_id long, toxic int")
    model = toxicity.train(frame, labels)
    out = {r.doc_id: r for r in toxicity.with_toxicity(frame, model).collect()}
    assert sum(out[i].predicted == y for i, _, y in test) >= 97
    assert all(0 <= r.score <= 1 for r in out.values())
    assert out[900].score == out[901].score < 0.5 < min(out[902].score, out[903].score)
    assert toxicity.with_toxicity(frame.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        toxicity.train(frame, labels.limit(0))


def test_toxicity_without_anything_to_learn(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1), (8, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    clashing = docs.withColumnRenamed("row", "predicted")
    for seen, judged, score in (
        (labels.limit(0), 0, 0.0),
        (labels.where("doc_id IS NULL"), 0, 0.0),
        (labels.where("doc_id = 99"), 0, 0.0),
        (labels.where("doc_id = 8"), 0, 0.0),
        (labels.where("doc_id = 1"), 1, 1.0),
    ):
        out = toxicity.with_toxicity(clashing, toxicity.train(docs, seen)).collect()
        assert len(out) == len(AWKWARD) and all(r.predicted == judged and abs(r.score - score) < 1e-6 for r in out)
    assert toxicity.with_toxicity(empty, toxicity.train(docs, labels)).count() == 0
    assert toxicity.with_toxicity(docs, toxicity.train(empty, labels)).where("predicted = 1").count() == 0


def test_queries_run_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, run in registry.QUERIES.items():
        assert run(spark, str(tmp_path)).count() == (1 if name == "op5_chat_format" else 0), name


def test_subsequence_kernel_by_brute_force():
    from itertools import combinations

    def brute(a, b, p=toxicity.LETTERS, d=toxicity.DECAY):
        def spans(w):
            found = defaultdict(float)
            for at in combinations(range(len(w)), p):
                found["".join(w[i] for i in at)] += d ** (at[-1] - at[0] + 1)
            return found

        x, y = spans(a), spans(b)
        return sum(v * y[k] for k, v in x.items() if k in y)

    pool = ["idiot", "idxiot", "toidi", "worthless", "wrthls", "abcd"]
    for mark in pool:
        got = toxicity.kernel(toxicity.coded(pool), mark)
        assert np.allclose(got, [brute(w, mark) for w in pool], rtol=1e-4, atol=1e-6)
    assert np.allclose(toxicity.self_kernels(pool), [brute(w, w) for w in pool], rtol=1e-4)


def test_words_of_tokens():
    assert toxicity.words_of("id.iot") == ["^idiot"] and toxicity.words_of("--") == []
    assert len(toxicity.words_of("x" * 1000)) > 50 and "idiot" in toxicity.tokens_of("an i d i o t")


# 7


def test_search_by_brute_force(spark, texts):
    got = defaultdict(list)
    for r in registry.QUERIES["op7_topk_search"](spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    bags = {i: Counter(words((t or "").lower() if (t or "").isascii() else None) or (t or "").encode().lower().split()) for i, t in texts.items()}
    length = {i: sum(c.values()) for i, c in bags.items()}
    mean = sum(length.values()) / len(length)
    df = Counter(w for c in bags.values() for w in c)
    for q in (i for i in texts if i % 100 == 0):
        scores = {}
        for i, c in bags.items():
            s = sum(n * math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for w, n in bags[q].items() if w in c)
            if s > 0 and i != q:
                scores[i] = s
        expected = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:10]
        assert [i for i, _ in got[q]] == [i for i, _ in expected]
        assert np.allclose([s for _, s in got[q]], [s for _, s in expected], atol=2e-6)


def test_search_of_awkward_rows(docs, empty, monkeypatch):
    queries = docs.select(F.col("doc_id").alias("query_id"), "text")
    out = topk_search.search(docs, queries, k=2)
    found = {(r.query_id, r.doc_id) for r in out.collect()}
    assert (1, 3) in found and not {4, 5, 6, None} & {q for q, _ in found} and not {4, 5, 6, None} & {d for _, d in found}
    blocks = topk_search.search(docs, queries, k=2, block_terms=5)
    monkeypatch.setattr(topk_search, "SHARD_DOCS", 3)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, topk_search.search(docs, queries, k=2).collect()))
    assert topk_search.search(empty, queries.where("query_id = 1")).count() == 0
    assert topk_search.search(docs, queries.limit(0)).count() == 0


def test_search_of_repeated_rows_and_ties(spark):
    rows = [(5, "red fox runs"), (5, "red fox sits"), *((n, f"red fox number{n}") for n in range(10, 21)), (7, None)]
    docs = documents(spark, rows)
    asked = spark.createDataFrame([(5, "red fox"), (7, "red"), (7, "fox"), (None, "red")], "query_id long, text string")
    got = topk_search.search(docs, asked, k=10).collect()
    assert [r.doc_id for r in sorted((r for r in got if r.query_id == 5), key=lambda r: r["rank"])] == list(range(10, 20))
    assert [r.doc_id for r in sorted((r for r in got if r.query_id == 7), key=lambda r: r["rank"])] == [5, 5, *range(10, 18)]
    assert len(got) == 20
    # scores that differ below the sixth digit are equal: the smaller id is first
    shard = topk_search.Shard(np.array([9, 3]), np.array([10, 10]), [np.array([0], np.uint32)] * 2, [np.array([1], np.uint32)] * 2, np.array([1.0]), 10.0)
    shard.impact = shard.impact + np.where(shard.ids[shard.doc] == 9, 4e-8, 0)
    assert [i for i, _ in shard.search(np.array([0]), np.array([1.0]), 1)] == [3]


def test_search_skips_postings():
    rng = np.random.default_rng(4)
    n, words = 4000, 2100  # forty subjects of fifty words, and a hundred that all have
    bags = [np.unique(np.concatenate([rng.integers(0, 100, 30), 100 + d % 40 * 50 + rng.integers(0, 50, 20)])) for d in range(n)]
    counts = [rng.integers(1, 4, len(b)).astype(np.uint32) for b in bags]
    lengths = np.array([c.sum() for c in counts])
    df = np.bincount(np.concatenate(bags), minlength=words)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shard = topk_search.Shard(np.arange(n), lengths, [b.astype(np.uint32) for b in bags], counts, idf, lengths.mean())
    for q in range(0, n, 200):
        terms, weights = bags[q], counts[q].astype(float)
        score = np.zeros(n)
        for d in range(n):
            _, x, y = np.intersect1d(terms, bags[d], return_indices=True)
            tf = counts[d][y]
            score[d] = (weights[x] * idf[bags[d][y]] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[d] / lengths.mean()))).sum()
        wanted = sorted((-round(s, 6), d) for d, s in enumerate(score.tolist()) if d != q and s)[:10]
        assert [i for i, _ in shard.search(terms, weights, 10, q)] == [d for _, d in wanted]
    assert shard.read < 0.75 * shard.postings


def test_search_adds_common_words_of_many_queries_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    n, words = 1500, 3000
    bags = [np.unique((words * rng.random(int(rng.integers(0, 120))) ** 3).astype(np.int64)) for _ in range(n)]
    counts = [rng.integers(1, 4, len(b)).astype(np.uint32) for b in bags]
    lengths = np.array([c.sum() for c in counts])
    df = np.bincount(np.concatenate(bags), minlength=words)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shard = topk_search.Shard(np.arange(n), lengths, [b.astype(np.uint32) for b in bags], counts, idf, lengths.mean())
    impact = np.zeros((n, words))
    for d, (b, c) in enumerate(zip(bags, counts)):
        impact[d, b] = idf[b] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * lengths[d] / lengths.mean()))
    added = []
    monkeypatch.setattr(topk_search.Shard, "_add", lambda self, score, begin, sizes, *more, f=topk_search.Shard._add: added.append(sizes.sum()) or f(self, score, begin, sizes, *more))
    asked = [(bags[q], counts[q].astype(float)) for q in range(70)]
    for q, ((terms, weights), begun) in enumerate(zip(asked, shard.begun(asked))):
        score = impact[:, terms] @ weights
        wanted = sorted((-round(s, 6), d) for d, s in enumerate(score.tolist()) if d != q and s)[:10]
        assert [i for i, _ in shard.search(terms, weights, 10, q, begun)] == [d for _, d in wanted]
        assert [i for i, _ in shard.search(terms, weights, 10, q)] == [d for _, d in wanted]
    assert sum(added) < shard.postings / 1.5


# 8


def test_overlaps_by_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 13, 30])))) for n in range(30)]
    rows = []
    for n in range(200):
        w = [rng.choice(vocabulary) for _ in range(40)]
        part = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(len(part))] = rng.choice(vocabulary)
        at = rng.randrange(40)
        rows.append((n, " ".join([*w[:at], *part, *w[at:]]) + "."))
    got = {r.doc_id: (r.contaminated, r["items"], r.n_agree) for r in decontamination.with_overlaps(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    clean = lambda t: [w.strip(".") for w in t.lower().split()]
    for n, text in rows:
        w, best = clean(text), {}
        for item, t in items:
            x = clean(t)
            span, need = min(13, len(x)), 11 if len(x) >= 13 else len(x)
            most = max((sum(a == b for a, b in zip(x[i : i + span], w[j : j + span])) for i in range(len(x) - span + 1) for j in range(len(w) - span + 1)), default=0)
            if most >= need:
                best[item] = most
        assert got[n] == (bool(best), sorted(best), max(best.values(), default=0)), text


def test_overlaps_of_awkward_rows(spark, docs, empty):
    items = [(1, "The QUICK brown, fox jumps over the lazy dog and runs far away"), (1, "The QUICK brown, fox jumps over the lazy dog and runs far away"), (2, None), (3, ""), (None, "last")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (2_000_000, 5):
        out = decontamination.with_overlaps(docs, benchmark, block_words=block_words).collect()
        assert sorted((r.doc_id or 0, r["items"]) for r in out if r.contaminated) == [(0, [1]), (3, []), (8, [1]), (8, [1])]
    assert decontamination.with_overlaps(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontamination.with_overlaps(empty, benchmark).count() == 0


def test_overlaps_of_repeated_words():
    block = decontamination.SeedBlock([(n, "same " * 200) for n in range(20)] + [(20, "a b c d e f g h i j k l m " * 10), (21, "x y " * 100)])
    began = time.process_time()
    assert block.overlaps("same " * 3000) == {n: 13 for n in range(20)}
    assert block.overlaps("x y " * 1500) == {21: 13}
    assert block.overlaps("x y x z " * 700) == {}
    assert block.overlaps("x y x y x y x z x y x y x q " * 200) == {21: 12}
    assert time.process_time() - began < 2


# 9


def test_language_on_held_out_rows(spark):
    lang = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    out = registry.QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert len(out) > 250 and np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_language_of_awkward_rows(spark, docs, empty):
    rng = random.Random(9)
    plain = [" ".join(rng.choice(["the", "dog", "house", "walks", "with", "and"]) for _ in range(60)) for _ in range(30)]
    other = [" ".join(rng.choice(["der", "hund", "geht", "schnell", "und", "nicht"]) for _ in range(60)) for _ in range(30)]
    rows = [(n, t, l) for n, (t, l) in enumerate([(t, "en") for t in plain] + [(t, "de") for t in other] + [(None, "en"), ("123", "fr"), ("text", None)])]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = documents(spark, [(1, None), (2, ""), (3, "12 ?!"), (4, "the dog"), (5, "DER HUND"), (6, "的是不了人我在有他这" * 40), (7, "a")])
    out = {r.doc_id: r for r in language_id.with_language(odd, model).collect()}
    assert [out[i].lang_pred for i in range(1, 6)] == ["und", "und", "und", "en", "de"]
    assert all(out[i].rejected for i in (1, 2, 3, 6)) and not any(out[i].rejected for i in (4, 5))
    assert out[6].lang_pred in ("en", "de") and out[1].score == 0
    assert language_id.with_language(empty, model).count() == 0 and language_id.with_language(docs, model).count() == len(AWKWARD)
    clashing = docs.withColumnsRenamed({"lang": "lang_pred", "row": "rejected"})
    assert language_id.with_language(clashing, model).columns.count("rejected") == 1
    for nothing in (language_id.train(empty), language_id.train(docs.where("text IS NULL"))):
        assert {(r.lang_pred, r.score, r.rejected) for r in language_id.with_language(docs, nothing).collect()} == {("und", 0.0, True)}


def test_language_by_brute_force(spark):
    rng = random.Random(19)
    rows = [(n, " ".join(rng.choice(["the", "dog", "walks"] if n % 2 else ["der", "hund", "geht"]) for _ in range(30)), "en" if n % 2 else "de") for n in range(60)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for _, text, _ in rows[:10]:
        v = np.log1p(language_id.trigram_counts(text)) * model.idf
        cosines = model.centroids @ (v / np.linalg.norm(v))
        got = model.predict([text]).iloc[0]
        assert got.lang_pred == model.languages[model.language_of[int(np.argmax(cosines))]] and abs(got.score - min(1, cosines.max())) < 1e-5
    raw = b" " + b"the dog" + b" "
    grams = Counter(raw[i : i + 3] for i in range(len(raw) - 2))
    assert language_id.trigram_counts("the dog").sum() == sum(grams.values())
    assert language_id.trigram_counts("ab" * 100_000).max() > 65_535


# 10


def targets_by_hand(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + ([None] if None in sizes else [])
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[n] for n in open_)
        full = [n for n in open_ if left * weight[n] / total > 2 * sizes[n]]
        if not full:
            target |= {n: left * weight[n] / total for n in open_}
            break
        for n in full:
            target[n] = 2.0 * sizes[n]
        open_ -= set(full)
        left -= sum(2 * sizes[n] for n in full)
    return target


def test_targets(spark):
    rng = random.Random(10)
    for _ in range(6):
        names = rng.sample(["a", "B", "é", "zz", "😀", "", None], rng.randint(1, 7))
        sizes = {n: rng.choice([0, 1, 10, 1000, rng.randint(0, 5000)]) for n in names}
        out = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        expected = targets_by_hand(sizes)
        assert all(abs(r.target - expected[r.source]) < 1e-6 for r in out), sizes


def test_mix_meets_its_targets(spark):
    out = registry.QUERIES["op10_mixing"](spark, "/root/testdata/sf0.01").collect()
    source = dict(duckdb.sql("SELECT doc_id, source FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    text = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0d]+", text[r.doc_id])) and 0 <= r.taken <= 2 * r.size
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
    assert all(r.source_size == sizes[source[r.doc_id]] for r in out)
    expected = targets_by_hand(sizes)
    assert all(abs(target[s] - expected[s]) < 1e-6 * expected[s] for s in sizes)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    again = registry.QUERIES["op10_mixing"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(out) == sorted(again)


def test_mix_of_awkward_rows(docs, empty):
    out = mixing.mix(docs, mixing.word_count(F.col("text"))).collect()
    assert len(out) == len(AWKWARD) and all(r.taken <= 2 * r.size for r in out)
    assert mixing.mix(empty, mixing.word_count(F.col("text"))).count() == 0
    assert mixing.mix(docs.where("text IS NULL"), mixing.word_count(F.col("text"))).where("taken > 0").count() == 0


def test_all_ten_are_registered():
    assert sorted(int(n[2:].partition("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
