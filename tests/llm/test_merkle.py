import zlib
from hashlib import sha256

import pytest

from limnos.llm import merkle, registry


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    fields = (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def tree(nodes):
    """Levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def steps(levels, pos):
    for nodes in levels[:-1]:
        yield (pos & 1, nodes[pos ^ 1] if pos ^ 1 < len(nodes) else None)
        pos >>= 1


def brute(rows):
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r.lang == x), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r))) for x in langs}
    levels = {x: tree([leaf(r) for r in t]) for x, t in trees.items()}
    top = tree([levels[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for pos, r in enumerate(trees[x]):
            path = [*steps(levels[x], pos), *steps(top, k)]
            forged = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
            now = leaf(r, 1 if forged else 0)
            for odd, s in path:
                now = h(now) if s is None else h(s, now) if odd else h(now, s)
            assert (now == top[-1][0]) == (not forged)
            out.append((r.doc_id, leaf(r), levels[x][-1][0], top[-1][0], h(*[s for _, s in path if s]), now, not forged))
    return sorted(out, key=str)


def answers(docs, **how):
    got = merkle.checked(merkle.Manifest(docs, forged=merkle.seventh(docs["doc_id"]), **how)).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=str)


def test_odd_rows(odd, none):
    assert answers(odd) == brute(odd.collect())
    assert answers(none) == []
    assert answers(odd.limit(1)) == brute(odd.limit(1).collect())


@pytest.mark.parametrize("step", [1, 3, 10])
def test_trees_of_all_sizes(spark, odd, step):
    rows, k = [], 0
    for lang, n in ((None, 3), ("", 1), ("a", 2), ("b", 5), ("é", 8), ("z", 9), ("Z", 90)):
        for _ in range(n):
            rows.append((k * 37 % 101, f"text {k % 60}", lang, None if k % 9 == 0 else "s", None if k % 11 == 0 else k, 0.5, 1, 2, 3, "x"))
            k += 1
    docs = spark.createDataFrame(rows, odd.schema).repartition(6)
    assert answers(docs, step=step) == brute(docs.collect())


def test_proofs_of_some_rows_and_the_store(spark, make, text_of):
    docs = make([(k, text_of(k, 8)) for k in range(70)])
    manifest = merkle.Manifest(docs)
    some = manifest.proofs(manifest.rows.filter("id IN (3, 69)")).collect()
    assert sorted(r.id for r in some) == [3, 69]
    for r in some:
        assert merkle.folded(bytes(r.hash).hex(), r.path.split(",")) == manifest.root
    counts = {r.level: r["count"] for r in manifest.trees.nodes().groupBy("level").count().collect()}
    assert counts == {0: 70, 1: 35, 2: 18, 3: 9, 4: 5, 5: 3, 6: 2, 7: 1}


def test_query(spark, make, text_of, tmp_path):
    make([(k, text_of(k % 9, 12)) for k in range(40)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == 40 and all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in got)
