"""The operators on small tables against brute force, with nulls, empty and repeated rows, and clashing extra columns."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from depgrove.llm import embedding_dedup, jaccard_join, lm_scoring, packing, pieces, quality_classifier, quality_rules, substring_dedup, toxicity, url_filter
from depgrove.llm.components import components

C = F.col


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("block"), F.lit(1).alias("range"), F.lit("x").alias("rep"), F.lit(0).cast("long").alias("n_chars"))


def roots(n, pairs):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(60, 90)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(91, pairs)
    assert found == {i: want[i] for i in {x for p in pairs for x in p if p[0] != p[1]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filters(spark):
    rows = [(1, "http://WWW.Example.NET/en/x?y"), (2, "https://example.net"), (3, "http://a.example.com/de/"), (4, "http://b.org/fr/1#f"), (5, None), (6, "no scheme"), (7, "http://spam-farm.org/x"), (8, "http://x.org/x"), (9, "http://net/"), (8, "http://x.org/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("keys", F.lit(1))
    want = {1: ("www.example.net", "/en/x", "example.net/en/", "allow"), 2: ("example.net", "", None, "allow"), 3: ("a.example.com", "/de/", "example.com/de/", "block"), 4: ("b.org", "/fr/1", "org/fr/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("spam-farm.org", "/x", None, "block"), 8: ("x.org", "/x", None, "allow"), 9: ("net", "/", "net/", "block")}
    for most in (url_filter.MAX_BITS, 32):  # 32: hosts in three groups
        found = url_filter.judge(pages, max_bits=most).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found} == want and len(found) == len(rows)
    assert url_filter.judge(pages.limit(0)).count() == 0
    mine = spark.createDataFrame([("x.org", 1), ("x.org", 2), (None, 3), ("nowhere.org", 4), ("b.org", 5)], "host string, key int")
    listed = {r.page_id: r.verdict for r in url_filter.judge(pages, listed_hosts=mine).collect()}
    assert listed == {d: v for d, (*_, v) in want.items()} | {7: "allow", 8: "block"}


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (C("id") % 7 == 0).alias("listed"))
    cascade = url_filter.Cascade(keys)
    assert len(cascade.levels) > 1
    assert keys.where(cascade.contains(C("key")) != C("listed")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(z)) for z in rng.normal(size=4)], i % 2) for i in range(150)]
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 4, 1), (403, [1.0, None, 0.0, 0.0], 1), (404, [1.0, nan, 0.0, 0.0], 1), (405, [inf, 0.0, 0.0, 0.0], 1), (406, [1.0, 2.0], 1), (407, [1.0, 2.0], 1), (408, [2.0, 4.0], 1), (409, [1.0, 2.0], None), (407, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    unit = [np.array(e) / np.linalg.norm(e) if e and label is not None and None not in e and np.isfinite(e).all() and any(e) else None for _, e, label in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]
    links, root = collections.Counter(x for p in pairs for x in p), roots(len(rows), pairs)
    least = collections.defaultdict(lambda: 10**9)
    for i, r in enumerate(root):
        least[r] = min(least[r], rows[i][0])
    want = sorted((rows[i][0], links[i], least[root[i]]) for i in range(len(rows)))
    for shard in (1 << 20, 30 * 4 * 8):
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.dedup(df, shard_bytes=shard).collect()) == want
    assert embedding_dedup.dedup(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (3, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(embedding_dedup.dedup(none).collect(), key=str) == sorted([(None, 0, None, True), (None, 1, 3, False), (3, 1, 3, True)], key=str)


def test_embeddings_through_the_graph(spark):
    """Over a thousand vectors a label, in one shard and in several: few links, and a group whose members all link."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2600, 24))
    x[1000:1040] = x[:40] + 0.05 * rng.normal(size=(40, 24))
    x[1200:1500] = x[1100] + 0.03 * rng.normal(size=(300, 24))
    x[1500:1520] = x[1400]
    rows = [(i, [float(np.float32(z)) for z in v], i % 2 if i < 1000 else 1) for i, v in enumerate(x)]
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([c for *_, c in rows])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    root = roots(len(rows), np.argwhere(linked).tolist())
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for shard in (16 << 20, 700 * 24 * 8):
        found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.dedup(df, shard_bytes=shard).collect()}
        lost = sum(int(linked[i].sum()) - found[i][0] for i in range(len(rows)))
        assert 0 <= lost <= 0.002 * linked.sum()
        assert lost or found == {i: (int(linked[i].sum()), root[i]) for i in range(len(rows))}


def lower(x):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (x or "").encode())


def brute_ctw(rows, depth=5):
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    counts, words = {}, collections.Counter()

    def steps(x):
        s = b"\xfe" * depth + lower(x) + b"\xff"
        for i in range(depth, len(s)):
            for k in range(8):
                yield [(tuple(s[i - 1 - j] for j in range(d)), (1 << k) | (s[i] >> (8 - k))) for d in range(depth + 1)], s[i] >> (7 - k) & 1

    for d, x in rows:
        if not held[d]:
            words.update(lower(x).split() + ["end"])
            for nodes, bit in steps(x):
                for n in nodes:
                    counts.setdefault(n, [0, 0])[bit] += 1
    below = collections.defaultdict(float)
    share = {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        a, b = counts[key]
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        weighted = kt if len(key[0]) == depth else math.log(0.5) + np.logaddexp(kt, below[key])
        share[key] = 1.0 if len(key[0]) == depth else math.exp(math.log(0.5) + kt - weighted)
        if key[0]:
            below[key[0][:-1], key[1]] += weighted
    n, v, out = sum(words.values()), len(words), {}
    for d, x in rows:
        total = 0.0
        for nodes, bit in steps(x):
            p = 0.5
            for node in reversed(nodes):
                if node in counts:
                    a, b = counts[node]
                    p = share[node] * (b + 0.5) / (a + b + 1) + (1 - share[node]) * p
            total += math.log10(p if bit else 1 - p)
        tokens = lower(x).split() + ["end"]
        out[d] = (held[d], len(tokens), sum(words[t] > 0 for t in tokens), n, sum(math.log10((words[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), total)
    return out


def test_language_model(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["The", "cat", "sat", "é", "xyz", "on mat"], k=rng.randint(0, 12)))) for i in range(40)] + [(100, None), (101, ""), (102, "QQQ zzz\x00")]
    want = brute_ctw(rows)
    for size in (300, 1 << 20):
        found = {r.doc_id: tuple(r)[1:7] for r in lm_scoring.score(documents(spark, rows), size).collect()}
        assert found.keys() == want.keys()
        for d, w in want.items():
            assert found[d][:4] == w[:4] and found[d][4] == pytest.approx(w[4], abs=1e-6) and found[d][5] == pytest.approx(w[5], abs=2e-3)
    assert lm_scoring.score(documents(spark, rows).limit(0)).count() == 0


def test_jaccard_join(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows, line = [], rng.choices(words, k=12)
    for size, copies, edits in ((60, 12, 3), (80, 300, 2)):
        base = rng.choices(words, k=size)
        for _ in range(copies):
            x = list(base)
            for _ in range(rng.randint(0, edits)):
                x[rng.randrange(size)] = f"e{rng.randint(0, 5)}"
            rows.append(" ".join(x))
    rows += [" ".join(rng.choices(words, k=20) + line + rng.choices(words, k=20)) for _ in range(280)]
    rows += [None, "", "a b", "a  b", "a"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    sets = []
    for _, x in rows:
        w = (x or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    links, root = collections.Counter(x for p in pairs for x in p), roots(len(rows), pairs)
    docs = documents(spark, rows)
    found = {r.doc_id: (r.n_links, r.component_id, r.kept) for r in jaccard_join.join(docs).collect()}
    assert found == {i: (links[i], root[i], root[i] == i) for i in range(len(rows))}
    assert {r.doc_id for r in jaccard_join.keep_one(docs).collect()} == {i for i in range(len(rows)) if root[i] == i}
    assert jaccard_join.keep_one(docs).columns == docs.columns
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_jaccard_join_keeps_links_through_splits(spark, monkeypatch):
    """Buckets of well over 512 different sets, which are split twice: all tokens of a text are those of passages that many share."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 256)
    monkeypatch.setattr(jaccard_join, "ROW", 0, raising=False)
    splits, split = [], jaccard_join._split
    monkeypatch.setattr(jaccard_join, "_split", lambda *x: splits.append(x[0].agg(F.max("members")).first()[0]) or split(*x))
    rng = random.Random(11)
    passages = [[f"p{p}x{i}" for i in range(40)] for p in range(24)]
    rows = []
    for _ in range(700):
        own = sorted(rng.sample(range(24), 10))
        whole = [w for p in own for w in passages[p]]
        rows.append(" ".join(whole))
        for cut in (32, 36):  # the same with one or two passages shortened: about 0.85 to 0.9
            rows.append(" ".join(w for p in own for w in (passages[p][:6] if p in own[: (40 - cut) // 4] else passages[p])))
    ids, at, of = {}, [], []
    for i, x in enumerate(rows):
        w = x.split()
        own = {ids.setdefault(tuple(w[j : j + 5]), len(ids)) for j in range(len(w) - 4)}
        at += [i] * len(own)
        of += own
    sets = np.zeros((len(rows), len(ids)), np.float32)
    sets[at, of] = 1
    both, size = sets @ sets.T, sets.sum(1)
    linked = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-6
    truth = linked.sum(1) - 1
    held = sets.sum(0)
    assert np.median(held[of]) > 700 and truth.sum() > 2000
    found = {r.doc_id: r.n_links for r in jaccard_join.join(documents(spark, list(enumerate(rows)))).collect()}
    lost = [int(truth[i]) - found[i] for i in range(len(rows))]
    assert len(splits) >= 2 and splits[0] > 512, splits
    assert min(lost) >= 0 and sum(lost) <= 0.0004 * truth.sum(), (sum(lost), truth.sum())


def test_jaccard_join_in_blocks(spark, monkeypatch):
    """Buckets over many blocks: a group of like texts that are all different, one that hangs together by its centre alone, and long texts."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 24)
    monkeypatch.setattr(jaccard_join, "BLOCK", 40)
    monkeypatch.setattr(jaccard_join, "TOKENS", 6000)
    rng = random.Random(17)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for size, copies, edits in ((100, 260, 2), (45, 200, 1), (3000, 12, 20)):
        base = rng.choices(words, k=size)
        rows.append(" ".join(base))
        for i in range(copies):
            x = list(base)
            for _ in range(rng.randint(1, edits)):
                x[rng.randrange(size)] = f"e{rng.randint(0, 10**6)}"
            rows.append(" ".join(x))
    rows += rows[:3]
    rng.shuffle(rows)
    rows = [(i if i % 9 else None, x) for i, x in enumerate(rows)]
    rows += [(5, rows[7][1]), (5, rows[8][1]), (5, rows[8][1])]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.split() for _, x in rows)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    links, root = collections.Counter(x for p in pairs for x in p), roots(len(rows), pairs)
    least = {}
    for (d, _), r in zip(rows, root):
        least[r] = min(x for x in (d, least.get(r)) if x is not None) if d is not None or least.get(r) is not None else None
    docs = documents(spark, rows)
    found = jaccard_join.join(docs).collect()
    want = collections.Counter((d, links[i], least[root[i]]) for i, (d, _) in enumerate(rows))
    have = collections.Counter((r.doc_id, r.n_links, r.component_id) for r in found)
    assert sum((want - have).values()) <= 0.002 * len(rows), (want - have, have - want)
    kept = jaccard_join.keep_one(docs)
    assert kept.count() == len(set(root)) and kept.columns == docs.columns
    texts = {x: r for (_, x), r in zip(rows, root)}
    assert {texts[r.text] for r in kept.collect()} == set(root)


def brute_substrings(rows, size):
    first, tokens, out = {}, {}, {}
    for d, x in sorted(rows, key=lambda r: r[0]):
        tokens[d] = w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        for s in range(len(w) - size + 1):
            first.setdefault(tuple(w[s : s + size]), (d, s))
    for d, w in tokens.items():
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (d, s):
                gone |= set(range(s, s + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_factors(rows, size):
    """The greedy parse of each text against the reference, word by word: passages of windows that stand nowhere earlier."""
    texts = sorted((i, (text or "").split()) for i, text in rows)
    seen, passages = set(), []
    for i, w in texts:
        for k in range(len(w) - size + 1):
            if tuple(w[k : k + size]) in seen:
                continue
            seen.add(tuple(w[k : k + size]))
            if passages and passages[-1][0] == i and passages[-1][1] + len(passages[-1][2]) == k + size - 1:
                passages[-1][2].append(w[k + size - 1])
            else:
                passages.append((i, k, w[k : k + size]))
    found = {}
    for i, w in texts:
        found[i], p = [], 0
        while p < len(w):
            best = (0, None, None)
            for doc, start, words in passages:
                for o in range(len(words) - size + 1):
                    if (doc, start + o) < (i, p) and words[o : o + size] == w[p : p + size]:
                        n = size
                        while o + n < len(words) and p + n < len(w) and words[o + n] == w[p + n]:
                            n += 1
                        best = max(best, (n, doc, start + o), key=lambda x: x[0])
            if best[0]:
                found[i].append((p, *best))
            p += best[0] or 1
    return found


def test_substrings(spark):
    rng, rows = random.Random(3), []
    for i in range(80):
        x = []
        while rng.random() < 0.85:
            if rows and rng.random() < 0.5:
                y = (rng.choice(rows)[1] or "").split()
                k = rng.randint(0, max(0, len(y) - 1))
                x += y[k : k + rng.randint(1, 60)]
            else:
                x += rng.choices(["a", "b", "cc", "dé", "e."], k=rng.randint(1, 30))
        rows.append((i * 7 % 131, " \n".join(x) if rng.random() < 0.9 else None))
    rows += [(500, ""), (501, "x " * 100)]
    docs = documents(spark, rows)
    for size, block in ((20, 500), (9, 1 << 20)):
        found = substring_dedup.dedup(docs, size, block, with_factors=True).withColumn("sha", F.sha2(C("kept").cast("binary"), 256)).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in found} == brute_substrings(rows, size)
        assert {r.doc_id: [(f.start, f.length, f.source_doc, f.source_start) for f in r.factors] for r in found} == brute_factors(rows, size)
        assert all(a.start + a.length <= b.start for r in found for a, b in zip(r.factors, r.factors[1:]))
        words = {i: (text or "").split() for i, text in rows}
        for r in found:
            inside = {f.start + k for f in r.factors for k in range(f.length)}
            for c in r.crossing:
                assert c.length >= size and (c.source_doc, c.source_start) < (r.doc_id, c.start) and c.start in inside
                assert words[r.doc_id][c.start : c.start + c.length] == words[c.source_doc][c.source_start : c.source_start + c.length]
        assert any(r.crossing for r in found)
    out = substring_dedup.remove(docs)
    assert out.columns == docs.columns and {r.doc_id: r.n_chars for r in out.collect()} == {r.doc_id: len(r.kept) for r in substring_dedup.dedup(docs).collect()}
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_sentencepiece(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, None), (2, ""), (3, " a  b\nç"), (3, " a  b\nç"), (4, "x" * 5000)]
    docs = documents(spark, rows)
    found = sorted(tuple(r) for r in pieces.digests(docs, path).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(d, lib.encode(x or "")) for d, x in rows]
    assert found == sorted((d, len(i), sha(",".join(map(str, i))), sha(lib.decode(i)), True) for d, i in ids)
    assert {r.doc_id: list(r.ids) for r in pieces.encoded(docs, path).collect()} == dict(ids)
    assert pieces.digests(docs.limit(0), path).count() == 0


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "cat", "Sat", "ümlaut", "12"], k=rng.choice([0, 3, 200, 6000])))) for i in range(40)] + [(90, None)]
    found = packing.pack(documents(spark, rows), path, shard_bytes=50_000).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, x in rows:
        ids, at = [*lib.encode(x or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rows_ in by_sequence.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack(documents(spark, rows[:1]).limit(0), path).count() == 0


def test_packing_neighbours(spark):
    """The neighbours of each seed against a walk over all documents; the memo forgets and still gives each word's ids."""
    import public_tokenizers
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"word{i}" for i in range(60)], k=rng.choice([0, 5, 40]))) for _ in range(50)]
    corpus = packing.frequencies(documents(spark, list(enumerate(texts)) + [(70 + i, x) for i, x in enumerate(texts[:7])]))
    split = [x.split() for x in texts]
    every = split + split[:7]
    df = collections.Counter(w for ws in every for w in set(ws))
    mean, n = sum(map(len, every)) / len(every), len(every)
    idf = {w: math.log((n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    shard = packing.Shard(pa.array(texts), path, corpus)
    for seed in range(len(texts)):
        want = {}
        for d, ws in enumerate(split):
            for w in set(ws) & set(split[seed]):
                if idf[w] > 0 and sum(w in x for x in split) > 1:
                    k = ws.count(w)
                    want[d] = want.get(d, 0) + idf[w] * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        used = np.zeros(len(texts), bool)
        used[[seed, 3]] = True
        found = list(shard.neighbours(seed, used))
        assert set(found) == {d for d in want if not used[d]}
        assert all(want[a] >= want[b] - 1e-4 for a, b in zip(found, found[1:]))
    words = [f"{rng.choice('abcd')}{i} x{i}y".encode() for i in range(300)] + [b"a\x01b", b"z" * 5000]
    words = sorted({w for x in words for w in x.split()})
    tokens, whole = packing._Tokens(path), packing._Tokens(path)
    hashes = np.arange(len(words), dtype=np.uint64) * np.uint64(7919)
    for at in (range(0, 200), range(100, len(words)), range(0, len(words))):
        packing_ids, begins, sizes = tokens.of(hashes[list(at)], lambda i: words[list(at)[i]])
        got = [packing_ids[b : b + s].tolist() for b, s in zip(begins, sizes)]
        assert got == [whole.tokenizer.encode(words[i].decode(), add_special_tokens=False).ids for i in at]
        tokens._forget()
    assert len(tokens.hashes) == len(words) // 2


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows, labels = [(5000, None), (5001, ""), (5001, "")], [(5000, None, 5), (1, 1, 0), (1, None, None)]
    for i in range(600):
        words = ["".join(rng.choices("aeiourst", k=rng.randint(2, 8))) for _ in range(rng.randint(55, 150))]
        bad, toxic = rng.random() < 0.35, rng.random() < 0.35
        if bad:
            words = [w.upper() + "$$$" for w in words]
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "clown", "scum"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, labelled):
    docs, labels = labelled
    truth = {r.doc_id: r.quality for r in labels.where("quality IS NOT NULL").collect()}
    found = quality_classifier.score(docs, quality_classifier.model(docs, labels)).collect()
    assert len(found) == docs.count()
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.predicted}
    judged = quality_rules.judge(docs, quality_rules.model(docs, labels)).collect()
    wrong = [r for r in judged if r.doc_id in truth and not r.base_failed and r.kept != bool(truth[r.doc_id])]
    assert len(judged) == docs.count() and len(wrong) <= 0.05 * len(judged) and all(not r.kept for r in judged if r.doc_id >= 5000)
    assert {r.doc_id for r in quality_rules.keep_clean(docs, labels).collect()} == {r.doc_id for r in judged if r.kept}
    none = labels.limit(0)
    assert {r.score for r in quality_classifier.score(docs.limit(3), quality_classifier.model(docs, none)).collect()} == {0.5}
    assert {r.score for r in quality_rules.judge(docs.limit(3), quality_rules.model(docs, none)).collect()} == {0.5}


def test_toxicity(spark, labelled):
    docs, labels = labelled
    truth = {r.doc_id: r.toxic for r in labels.where("toxic IN (0, 1)").collect()}
    found = toxicity.score(docs, toxicity.model(docs, labels)).collect()
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(found) == docs.count() and len(held) > 50 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert {r.score for r in found if r.doc_id >= 5000} == {0.0}
    assert toxicity.score(docs.limit(5), toxicity.model(docs, labels.limit(0))).count() == 5


def test_pipeline(spark, tmp_path, labelled):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = labelled
    twice = docs.unionByName(docs.withColumn("doc_id", C("doc_id") + 10_000))
    twice.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages, rows = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in stages["quality_classifier"](spark, rows, str(tmp_path)).collect()}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in packed.collect()}
    assert ids and ids <= good and max(ids) < 10_000
    assert json.dumps(packed.columns) == json.dumps(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
