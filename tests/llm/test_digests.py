import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from limnos.llm import digests, registry


def brute(rows):
    """Every row's answer, as a multiset of tuples."""
    groups = defaultdict(list)
    for r in rows:
        t = r.text or ""
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()].append((-len(t), r.doc_id is None, r.doc_id or 0))
    out = []
    for sha, g in groups.items():
        best = min(g)
        keep = None if best[1] else best[2]
        first = True
        for x in sorted(g):
            out.append((None if x[1] else x[2], keep, len(g), first, sha))
            first = False
    return sorted(out, key=str)


def answers(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def test_odd_rows_match_brute_force(odd, none):
    assert answers(digests.exact_duplicates(odd)) == brute(odd.collect())
    assert digests.exact_duplicates(none).count() == 0


def test_groups_over_arrivals(make, text_of):
    texts = []
    for k in range(600):
        t = text_of(k % 40, 5 + k % 40) if k % 3 else "the same line\nwith  spaces"
        texts.append((k % 550, t.replace(" ", "  " if k % 7 == 0 else "\n" if k % 5 == 0 else " ")))
    docs = make(texts).repartition(7)
    want = brute(docs.collect())
    for arrivals in ((0,), (100, 0), (500, 120, 27, 0)):
        assert answers(digests.exact_duplicates(docs, arrivals)) == want


def test_index_is_found_again_and_takes_only_new_texts(spark, make, text_of, tmp_path):
    first = digests.digested(make([(k, text_of(k % 30, 20)) for k in range(60)]))
    second = digests.digested(make([(100 + k, text_of(k % 45, 20)) for k in range(90)]))
    index = digests.DigestIndex.new(spark, 100, path=str(tmp_path / "index"))
    index.add(first)
    again = digests.DigestIndex.open(spark, index.path)
    again.add(second)
    again.add(second)
    got = {r.keep_id for r in digests.DigestIndex.open(spark, index.path).entries().collect()}
    assert got == {*range(30), *range(130, 145)}
    whole = again.compacted(buckets=16)
    assert whole.buckets == 16 and sorted(whole.entries().collect()) == sorted(again.entries().collect())
    assert len(whole.entries().inputFiles()) <= 16


def test_anti_join_reads_the_index_without_exchange(spark, make, text_of):
    rows = digests.digested(make([(k, text_of(k, 20)) for k in range(60)]))
    index = digests.DigestIndex.new(spark, 100)
    index.add(rows)
    probe = rows.groupBy("digest").agg(F.min("row")).repartition(index.buckets, "digest").join(index.entries().hint("merge"), "digest", "left_anti")
    plan = probe._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    executed = probe._jdf.queryExecution().executedPlan().toString()
    right = executed[executed.index("SortMergeJoin") :].rpartition("FileScan parquet")[0].rpartition("+- ")[0]
    assert "Bucketed: true" in executed and "Exchange" not in right.rpartition("+- Sort")[2]


def test_hot_groups_are_joined_by_broadcast(spark, make, text_of, monkeypatch):
    docs = make([(k, "copy" if k % 3 == 0 else text_of(k, 12)) for k in range(900)])
    want = brute(docs.collect())
    for share in (1, 3, 10**6):  # none hot, the copies hot, all hot
        monkeypatch.setattr(digests, "HOT_SHARE", share)
        assert answers(digests.exact_duplicates(docs)) == want


def test_query(spark, make, text_of, tmp_path):
    make([(k, text_of(k % 9, 12)) for k in range(40)]).write.parquet(str(tmp_path / "documents.parquet"))
    out = registry.op12_digest_index(spark, str(tmp_path))
    assert out.count() == 40 and set(out.columns) == {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}
