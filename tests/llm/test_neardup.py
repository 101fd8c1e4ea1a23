import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from tarnlake.llm import neardup, shingles


def words(rnd, n):
    return [f"{rnd.choice('abcdefgh')}{rnd.randrange(4000)}" for _ in range(n)]


def corpus(seed=1):
    rnd = random.Random(seed)
    shared = words(rnd, 60)
    docs = []
    for k in range(150):
        w = words(rnd, rnd.randint(60, 200))
        if k % 3 == 0:
            w[10:10] = shared
        docs.append(w)
        for _ in range(rnd.choice([0, 0, 1, 3])):
            c = list(w)
            for _ in range(max(1, len(c) // rnd.choice([40, 80, 300]))):
                c[rnd.randrange(len(c))] = "changed"
            docs.append(c)
    rows = [" ".join(w) for w in docs]
    rows += [rows[0]] * 20 + [rows[1].upper(), rows[2].replace(" ", "  \n"), "", None, "", "one two", "one two", "one three", " "]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def shingle_counts(text, size=5):
    """Of words between ASCII white space, lower case; by the definition, without the tested module."""
    w = re.findall(r"[^\t\n\x0b\x0c\r ]+", (text or "").lower())
    return tuple(w), Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def brute_classes(docs, threshold=0.8, similarity="tfidf"):
    """Classes of (id, text) rows: all pairs that share a shingle, over exact document frequencies."""
    nodes = {}
    for i, (_, text) in enumerate(docs):
        words_of, counts = shingle_counts(text)
        nodes.setdefault(words_of, (counts, []))[1].append(i)
    n, df = len(docs), Counter()
    for counts, rows in nodes.values():
        df.update(dict.fromkeys(counts, len(rows)))
    idf = {x: 1 + math.log((n + 1) / (max(k, 0.05 * n) + 1)) if similarity == "tfidf" else 1.0 for x, k in df.items()}
    sets = [({x: k * idf[x] for x, k in counts.items()}, rows) for counts, rows in nodes.values()]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(i, j):
        a, b = sorted((find(i), find(j)))
        parent[b] = a

    holders = defaultdict(list)
    for k, (weights, rows) in enumerate(sets):
        for r in rows:
            join(rows[0], r)
        shared = Counter()
        for x, w in weights.items():
            for other in holders[x]:
                shared[other] += min(w, sets[other][0][x])
            holders[x].append(k)
        total = sum(weights.values())
        for other, both in shared.items():
            if both / (total + sum(sets[other][0].values()) - both) >= threshold - 1e-9:
                join(rows[0], sets[other][1][0])
    return {docs[i][0]: docs[find(i)][0] for i in range(len(docs))}


def test_classes_equal_brute_force(spark):
    docs = corpus()
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(docs) and len(got) == len(docs)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_table_equals_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    docs = sorted((r.doc_id, r.text) for r in df.collect())
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()}
    assert got == brute_classes(docs)
    # against unweighted overlap: at least 0.9 of its links keep together
    plain = brute_classes(docs, similarity="plain")
    linked = [(d, c) for d, c in plain.items() if d != c]
    assert sum(got[d] == got[c] for d, c in linked) >= 0.9 * len(linked) > 0


def test_bucket_of_unlike_nodes_loses_no_link(spark):
    """With bands of one sample, buckets hold many unlike texts, which meet in blocks or longer bands."""
    docs = corpus(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_classes(docs)
    for more in ({"levels": ((40, 1),)}, {"levels": ((40, 1),), "block": 4}, {"levels": ((40, 1), (38, 6)), "block": 4, "most_blocks": 2}):
        assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df, **more).collect()} == want


def test_document_frequencies_are_exact(spark):
    """However the texts are dealt to blocks, all shingles from the share on are found with their counts."""
    rnd = random.Random(8)
    texts = [" ".join(f"c{k}" for k in range(40) if rnd.random() < k / 40) + f" u{i}" * 3 for i in range(300)] + ["the same"] * 20 + ["", None]
    sets = [np.unique(shingles.shingle_hashes(shingles.word_hashes(t or ""), 1)) for t in texts]
    want = {h: n for h, n in Counter(x for s in sets for x in s.tolist()).items() if n >= 0.05 * len(texts)}
    for docs_a_block in (1, 10, 4096):
        block, often = neardup.Blocks(0.05, docs=docs_a_block), []
        for s in [*sets, None]:
            if s is not None:
                block.add(s)
            if s is None or block.full():
                often += zip(*(x.astype(np.int64).tolist() for x in block.take()), strict=True)
        found = neardup.common_shingles(len(texts), spark.createDataFrame(often, "hash long, n long"), spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 1)
        assert dict(zip(found.hashes.tolist(), found.counts.tolist(), strict=True)) == want
        assert list(found.hashes) == sorted(found.hashes)


def test_texts_cut_together():
    rnd = random.Random(9)
    texts = [" ".join(words(rnd, rnd.choice([0, 1, 4, 5, 6, 90]))) for _ in range(200)] + [None, " ", "\n\n", "É x " * 3, "w " * 200_000]
    for together in (1, 50, 1 << 18):
        got = list(shingles.of_texts(texts, 5, together))
        assert len(got) == len(texts)
        for t, (w, s) in zip(texts, got, strict=True):
            assert (w == shingles.word_hashes(t or "")).all() and (s == shingles.shingle_hashes(w)).all() and len(s) == max(len(w) - 4, min(len(w), 1))


def test_repeated_rows_are_kept_once(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text), (1, text), (1, text.upper()), (2, text), (None, None), (None, None), (3, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.class_id, r.kept) for r in got) == {(1, True): 1, (1, False): 3, (None, True): 1, (None, False): 2}


def test_keep_one_of_each(spark):
    docs = corpus(3)
    rows = [(i, t, f"x{i}") for i, t in docs] + [(docs[0][0], docs[0][1], f"x{docs[0][0]}"), (None, "quite another text here now", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, body string")
    kept = neardup.keep_one_of_each(df)
    assert kept.columns == df.columns
    want = set(brute_classes(docs).values()) | {None}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
    assert neardup.keep_one_of_each(df.limit(0)).count() == 0


def test_sampler_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    for seed in range(3):
        sampler = neardup.WeightedSampler(3000, seed)
        h = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        wa = (rng.random(len(h)) * 4 + 0.1).astype(np.float32)
        wb, keep = wa.copy(), rng.random(len(h)) < 0.8
        wb[:50] *= 2
        want = neardup.weighted_jaccard((h, wa), (h[keep], wb[keep]))
        got = (sampler.draw(h, wa) == sampler.draw(h[keep], wb[keep])).mean()
        assert abs(got - want) < 0.035


def test_hashes():
    h = shingles.word_hashes("a b c a  b\nc")
    assert len(set(h.tolist())) == 3
    assert (shingles.word_hashes("The  Big\tdog ") == shingles.word_hashes("the big dog")).all()
    long = " ".join(f"w{k}" for k in range(400_000))
    assert (shingles.word_hashes(long)[-5:] == shingles.word_hashes(" ".join(long.split()[-5:]))).all()
    assert len(shingles.shingle_hashes(shingles.word_hashes("a b"))) == 1
    groups = defaultdict(list)
    for k in range(3):
        groups[shingles.text_key(shingles.word_hashes("x y"))].append(k)
    assert len(groups) == 1
