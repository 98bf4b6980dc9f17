import heapq
import random
import zlib
from collections import Counter, defaultdict

from strandworks.llm import sharding as S


def plain(sizes, parts):
    """Differencing with sets of items; the sums of the parts that are left."""
    heap = [(-s, k, [{k}, *[set() for _ in range(parts - 1)]]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    weight = lambda p: sum(sizes[k] for k in p)
    made = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sorted((x | y for x, y in zip(sorted(a, key=weight, reverse=True), sorted(b, key=weight))), key=weight, reverse=True)
        heapq.heappush(heap, (weight(both[-1]) - weight(both[0]), made, both))
        made += 1
    return sorted(map(weight, heap[0][2])) if heap else [0] * parts


def test_differences_match_a_plain_form():
    r = random.Random(3)
    for _ in range(60):
        sizes = sorted((r.choice([r.randint(1, 9), r.randint(1, 10_000)]) for _ in range(r.randint(0, 60))), reverse=True)
        parts = r.randint(1, 7)
        got = S.differences(sizes, parts)
        sums = Counter()
        for s, p in zip(sizes, got):
            sums[p] += s
        assert set(got) <= set(range(parts))
        assert sorted(sums[p] for p in range(parts)) == plain(sizes, parts), (sizes, parts)
    assert S.differences([8, 7, 6, 5, 4], 2).count(0) in (2, 3) and sorted(plain([8, 7, 6, 5, 4], 2)) == [14, 16]  # the textbook's set


def check(rows, got, shards):
    assert Counter((g.doc_id, g.size, g.text_crc32) for g in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    home, places, total = defaultdict(set), defaultdict(list), Counter()
    for g in got:
        home[g.size, g.text_crc32].add(g.shard)
        places[g.shard].append(g.slot)
        total[g.shard] += g.size
    assert all(len(x) == 1 for x in home.values()) and set(total) <= set(range(shards))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    check.mixed = [total[k] for k in total if len({(g.size, g.text_crc32) for g in got if g.shard == k}) > 1]
    return [total[k] for k in range(shards)]


def test_shards(spark):
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(["ab", "cde", "é", "fghijk"]) for _ in range(n))
    copied = say(40)
    rows = [(k, say(int(r.paretovariate(1)) % 5000 + 1)) for k in range(3000)] + [(10_000 + k, copied) for k in range(900)]
    rows += [(None, "x"), (None, "x"), (1, rows[1][1]), (7777, None), (7778, ""), (7779, say(9000))]
    df = spark.createDataFrame([(*x, "s", 0) for x in rows], "doc_id long, text string, shard string, slot long").repartition(7)
    sums = check(rows, S.shard(df).collect(), 24)
    group = 900 * (len(copied.encode()) + 8)
    assert max(sums) == group and len(check.mixed) > 12 and max(check.mixed) - min(check.mixed) <= 40  # what exceeds a shard stands alone, all others are even
    sums = check(rows, S.shard(df, 4, fine=2, bundles=97).collect(), 4)
    assert max(sums) == group and max(check.mixed) - min(check.mixed) <= 0.002 * sum(sums)
    # the differencing of groups themselves, when each stands alone
    sizes = Counter()
    for _, t in rows:
        sizes[t or ""] += len((t or "").encode()) + 8
    fine = S.shard(df, 5, fine=10**9).collect()
    assert sorted(check(rows, fine, 5)) == plain(sorted(sizes.values(), reverse=True), 5)


def test_odd_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert S.shard(df.limit(0)).count() == 0
    got = S.shard(df).collect()
    assert [(g.doc_id, g.size, g.slot) for g in got] == [(1, 9, 0)]
    rows = [(k, "t" * (k % 5), k) for k in range(50)]
    S.write(spark.createDataFrame(rows, "doc_id long, text string, size int"), f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((b.doc_id, b.text, b.size) for b in back.collect()) == sorted(rows) and back.where("shard = 0").groupBy("_slot").count().where("count > 1").count() == 0
