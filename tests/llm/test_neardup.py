"""The pipeline's near-duplicate stage against brute-force Jaccard."""

import random

import corpus_pipeline
from glossa.llm import neardup
from tests.conftest import SF
from tests.llm.test_operators import prose, roots


def brute(texts):
    own = []
    for t in texts:
        w = (t or "").lower().split()
        own.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
    return roots(len(own), [(a, b) for a in range(len(own)) for b in range(a) if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])])


def test_similarity_of_near_copies(spark):
    rng = random.Random(9)
    texts = ["", None, "a b", "A  b"]
    for n, copies, changes in ((120, 6, (1, 2, 3)), (200, 700, (3, 4)), (60, 5, (1,)), (400, 8, (5, 8, 12))):
        base = prose(rng, n).split()
        for _ in range(copies):
            own = list(base)
            for at in rng.sample(range(n), rng.choice(changes)):
                own[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    want = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == dict(enumerate(want))
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, SF).collect()} == set(want)


def test_repeated_ids_are_judged_by_their_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (5, a), (5, b), (7, b), (None, a)]
    kept = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept.collect()) == [(0, "a"), (1, "a"), (5, "b")]


def test_recall_of_edited_copies(spark):
    """Copies with one word in twenty-five put in or left out share about 80 %."""
    import random

    rng, texts = random.Random(2), []
    for k in range(120):
        own = [f"w{rng.randrange(4000)}" for _ in range(150)]
        edited = [w for w in own if rng.random() > 0.012]
        texts += [" ".join(own), " ".join(x for w in edited for x in ((w, "new") if rng.random() < 0.012 else (w,)))]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    want = {k for k in range(0, 240, 2) if len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1])}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(want) > 20 and {k for k in range(0, 240, 2) if got[k] == got[k + 1]} == want


def test_work_on_a_large_group_is_linear(spark):
    """A group of 100,000 linked nodes meets the few others of its component, and not itself."""
    from pyspark.sql import functions as F

    large = spark.range(100_000).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("root"), F.lit(0).cast("long").alias("group"))
    others = spark.range(5).select((F.col("id") + 200_000).alias("node"), F.lit(0).cast("long").alias("root"), (F.col("id") + 200_000).alias("group"))
    done = spark.range(50_000).select((F.col("id") + 300_000).alias("node"), F.lit(300_000).cast("long").alias("root"), F.lit(300_000).cast("long").alias("group"))
    dealt = neardup._pieces(large.unionByName(others).unionByName(done), 4)
    sizes = {r.task: (r.rows, r.large) for r in dealt.groupBy("task").agg(F.count("*").alias("rows"), F.count_if(F.col("group") == 0).alias("large")).collect()}
    assert sum(n for n, _ in sizes.values()) <= 100_000 + 5 * 300 and max(n for n, _ in sizes.values()) < 1_000
    assert len(sizes) <= 100_000 // neardup.PIECE + 2
    names = dealt.groupBy("name").agg(F.count("*").alias("n")).groupBy("n").count().collect()
    assert {r.n: r["count"] for r in names}[1] == 100_000  # each of the large group meets the others once


def test_groups_that_links_join_late(spark):
    """Chains of texts whose ends differ too much: candidates tie families together that only some members link."""
    rng, texts = random.Random(12), []
    for _ in range(3):
        own = [f"w{rng.randrange(5000)}" for _ in range(100)]
        for step in range(60):
            texts.append(" ".join(own))
            own = list(own)
            own[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
    want = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == dict(enumerate(want))
