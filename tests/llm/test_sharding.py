from collections import Counter, defaultdict

from linkwright.llm.sharding import equal_text_links, propagate, shard
from tests.llm.helpers import documents


def test_counts_are_even_and_groups_stay_together(spark):
    texts = [f"text {i}" for i in range(300)] + [f"copy {i % 40}" for i in range(200)] + ["hot"] * 250 + [None, None, ""]
    rows = shard(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    where = defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        where[texts[r.doc_id]].add(r.shard)
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    copies = [where[f"copy {i}"] for i in range(40)]
    assert sum(len(x) > 1 for x in copies) <= 15 and len(where["hot"]) <= 250 // (753 // 16) + 2


def test_propagation_keeps_linked_nodes_close_and_even(spark):
    ring = [(i, i + 1) for block in range(64) for i in range(block * 10, block * 10 + 9)]
    links = spark.createDataFrame(ring, "src long, dst long")
    labels = {r.node: r.label for r in propagate(links, 4, 8).collect()}
    cut = sum(labels[a] != labels[b] for a, b in ring) / len(ring)
    assert cut < 0.45 and max(Counter(labels.values()).values()) < 0.45 * len(labels)


def test_few_or_no_rows(spark):
    assert shard(documents(spark, [])).count() == 0
    rows = shard(documents(spark, ["a", "a", None])).collect()
    assert sorted(r.slot for r in rows) == [0, 0, 0] and len({r.shard for r in rows}) == 3
    none = documents(spark, ["a", "a"]).selectExpr("cast(null as bigint) as doc_id", "text", "1 as label", "2 as home", "3 as rank")
    assert shard(none).count() == 2


def test_rounds_and_quotas_place_equal_texts(spark):
    texts = [f"copy {i % 300}" for i in range(1200)] + ["hot"] * 600
    links = equal_text_links(documents(spark, texts)).cache()
    pairs = [(a, b) for a, b in links.collect() if texts[a] != "hot"]

    def labels(rounds):
        return {r.node: r.label for r in propagate(links, 4, rounds).collect()}

    def apart(found):
        return sum(found[a] != found[b] for a, b in pairs) / len(pairs)

    first, last = labels(0), labels(4)
    assert apart(first) > 0.6 and apart(last) < 0.5 * apart(first)
    # a group of a third of all rows doesn't fill one shard beyond its room
    assert max(Counter(last.values()).values()) <= max(1.1 * len(texts) / 4, max(Counter(first.values()).values()) + 10)
