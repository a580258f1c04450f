import random

import numpy as np

from limnos.llm import latent


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_run_is_the_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(8) for _ in range(r.randrange(1, 30))] for _ in range(2))
        assert latent.common_run(np.array(a), np.array(b)) == lcs(a, b)


def test_decomposition_spans_the_leading_directions():
    r = np.random.default_rng(2)
    a = r.standard_normal((200, 5)) @ r.standard_normal((5, 40))
    basis = latent.decompose(a.T @ (a @ (o := r.standard_normal((40, 12)))), o)
    v = np.linalg.svd(a, full_matrices=False)[2][:5]
    assert np.allclose(np.linalg.norm(v @ basis, axis=1), 1, atol=1e-3)


def test_planted_items_are_found_and_others_left(spark, make, text_of):
    items = [(k, text_of(1000 + k, 15 + 3 * k)) for k in range(14)] + [(90, None), (91, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    r, docs, want = random.Random(3), [], set()
    for d in range(120):
        w = text_of(d, r.choice((30, 200, 900))).split()
        if d % 4 == 0:
            k = d // 4 % 14
            q = items[k][1].split()
            if d % 8 == 0:
                for _ in range(len(q) // 10):
                    q[r.randrange(len(q))] = "other"
            at = r.randrange(len(w))
            w[at:at] = [x.upper() if d % 12 == 0 else x for x in q]
            want.add((d, k))
        docs.append((d, " ".join(w)))
    got = {(x.doc_id, x.item_id) for x in latent.leaks(make(docs), bench).collect()}
    assert got == want
    left = latent.drop_leaks(make(docs), bench)
    assert {x.doc_id for x in left.collect()} == set(range(120)) - {d for d, _ in want}


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, odd.filter("doc_id = 9").first().text), (1, None), (None, "one two")], "item_id long, text string")
    got = sorted((x.doc_id, str(x.item_id)) for x in latent.leaks(odd, bench).collect() if x.doc_id is not None)
    assert (9, "1") in got and (10, "None") in got and (11, "None") in got and not [g for g in got if g[0] in (4, 5, 6)]
    kept = latent.drop_leaks(odd, bench)
    assert kept.dtypes == odd.dtypes and kept.filter("doc_id IS NULL").count() == 2
    assert latent.leaks(none, bench).count() == 0 and latent.leaks(odd, bench.limit(0)).count() == 0


def test_drop_leaks_tells_rows_apart_whatever_their_ids(spark, make, text_of):
    item, clean = text_of(900, 60), [text_of(k, 200) for k in range(40)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    leaking = clean[0] + " " + item + " " + clean[1]
    docs = make([(k, t) for k, t in enumerate(clean)] + [(None, leaking), (None, clean[5]), (3, leaking)])
    left = latent.drop_leaks(docs, bench).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted([*((str(k), t) for k, t in enumerate(clean)), ("None", clean[5])])


def test_word_gate_and_overlap_are_counts(text_of):
    r = random.Random(5)
    rows = [{"key": k, "text": text_of(700 + k, r.choice((4, 15, 40)))} for k in range(70)]
    items, number = latent.read_items(rows)
    seqs = []
    for d in range(40):
        w = text_of(d, r.choice((1, 5, 12, 13, 24, 100))).split()
        w[r.randrange(len(w)) : 0] = rows[r.randrange(70)]["text"].split()[: r.randrange(1, 30)]
        seqs.append(np.array([number.get(x, 0) for x in w], np.int32))
    seqs.append(np.empty(0, np.int32))
    cut = latent.Halves.of(seqs)
    asked = np.array([-int(-latent.WEAK * min(len(x.ids), latent.STEP) // 1) for x in items])
    half, item = latent.enough(cut, latent.item_bits(items, len(number) + 1), latent._bit_planes(asked, 2))
    want = set()
    for d, s in enumerate(seqs):
        for b in range(max(1, -(-len(s) // 12) - 1) if len(s) else 0):
            for k, x in enumerate(items):
                if np.isin(s[12 * b : 12 * b + 24], x.ids).sum() >= asked[k]:
                    want.add((int(cut.first[d]) + b, k))
    assert set(zip(half.tolist(), item.tolist(), strict=True)) == want
    place = np.zeros(len(number) + 1, np.int64)
    for k in {k for _, k in want}:
        mine, n = half[item == k], len(items[k].ids)
        for h, found in zip(mine.tolist(), latent.overlap(cut, mine, items[k], place).tolist(), strict=True):
            x = int(cut.text_of(np.array([h]))[0])
            at = (h - int(cut.first[x])) * 12
            region = seqs[x][max(0, at - n) : at + 24 + n]
            assert found == sum(min((region == t).sum(), (items[k].ids == t).sum()) for t in set(items[k].ids.tolist()))
            assert latent.common_run(items[k].ids, region) <= found


def test_recall_against_brute_force(spark):
    """Every text and item whose words lie in common order anywhere, without gate or vectors."""
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    bench = spark.read.parquet(f"{at}/benchmark.parquet").filter("item_id % 4 = 0")
    rows = [{"key": r.item_id, "text": r.text} for r in bench.collect()]
    items, number = latent.read_items(rows)
    want = set()
    for r in docs.collect():
        s = np.array([number.get(w, 0) for w in latent.words(r.text)], np.int64)
        for x in items:
            n = len(x.ids)
            if any(latent.judge(x, s[max(0, b - n) : b + 24 + n]) for b in range(0, max(len(s) - 12, 1), 12) if np.isin(s[max(0, b - n) : b + 24 + n], x.ids).sum() >= 0.6 * n):
                want.add((r.doc_id, x.key))
    got = {(r.doc_id, r.item_id) for r in latent.leaks(docs, bench).collect()}
    assert want and got <= want and len(got) >= 0.9 * len(want), (len(want), len(got), want - got)


def test_hot_copies_of_an_item_and_repeated_items(spark, make, text_of):
    """A third of all rows are copies of a text that has most words of an item; near copies of the item are found all the same."""
    item = text_of(800, 48)
    hot = " ".join(random.Random(1).sample(item.split() + text_of(801, 400).split(), 440))
    near = item.split()
    near[5], near[20], near[33] = "one", "two", "three"
    docs = [(k, text_of(k, 150)) for k in range(60)] + [(100 + k, hot) for k in range(40)] + [(200, text_of(5, 100) + " " + " ".join(near) + " " + text_of(6, 100))]
    bench = spark.createDataFrame([(1, item), (2, item), (3, text_of(900, 40))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in latent.leaks(make(docs), bench).collect()}
    assert {g for g in got if g[0] < 100 or g[0] >= 200} == {(200, 1), (200, 2)}
