import random

import numpy as np
from pyspark.sql import functions as F

from lexflow.llm import leakage
from lexflow.llm.leakage import LEAST_SHARE, Codes, Item, all_seeds, leaked_items, passing, seed_filter, words
from lexflow.runtime import table

VOCABULARY = [f"w{k}" for k in range(4000)]


def text(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def changed(rng, passage, rate):
    return [rng.choice(VOCABULARY) if rng.random() < rate else w for w in passage]


def test_planted_passages(spark):
    """Whole items, halves with replaced words and two passages are found; short phrases and shared clauses are not."""
    rng = random.Random(3)
    clause = text(rng, 20)
    items = [(i, text(rng, 50) + " " + clause + " " + text(rng, 50)) for i in range(20)]
    docs, want = [], set()
    for i, t in items:
        w = words(t)
        cases = {"whole": w, "half": changed(rng, w[10:70], 0.12), "two": w[:30] + text(rng, 30).split() + w[90:], "phrase": w[5:20], "clause": clause.split(), "upper": [x.upper() + "," for x in w[:60]], "gap": w[:25] + w[28:70]}
        for k, (kind, part) in enumerate(cases.items()):
            docs.append((100 * i + k, text(rng, 200) + " " + " ".join(part) + " " + text(rng, 100)))
            if kind not in ("phrase", "clause"):
                want.add((100 * i + k, i))
    d = spark.createDataFrame(docs + docs[:3] + [(9001, None), (9002, ""), (None, items[0][1]), (9003, "x" * 100_000), (9004, "one two")], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    e = spark.createDataFrame(items + items[:2] + [(77, None), (78, "too short"), (None, "lost")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = leaked_items(d, e)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert leaked_items(d.limit(0), e).count() == 0 and leaked_items(d, e.limit(0)).count() == 0


def test_seeds_by_shuffle_give_the_same(spark, monkeypatch):
    docs, items = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "eval_items")
    whole = {(r.doc_id, r.item_id, r.share) for r in leaked_items(docs, items).collect()}
    monkeypatch.setattr(leakage, "FEW", 0)
    monkeypatch.setattr(leakage, "FEW_TEXTS", 0)
    assert {(r.doc_id, r.item_id, r.share) for r in leaked_items(docs, items).collect()} == whole


def test_repeated_items_shared_clauses_and_short_items(spark):
    """Equal items are each found, near copies too; a clause that six items share is no case alone; an item of 13 words is found whole."""
    rng = random.Random(11)
    same, near, clause, short, signs = text(rng, 60), text(rng, 60).split(), text(rng, 30), text(rng, 13), "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    copies = [" ".join(near[:k] + ["changed"] + near[k + 1 :]) for k in (5, 25, 45, 55)]
    items = [(1, same), (2, same.upper()), (3, same + ".")] + [(10 + k, t) for k, t in enumerate(copies)] + [(20 + k, clause + " " + text(rng, 20)) for k in range(6)] + [(30, short), (31, signs)]
    around = lambda t: text(rng, 40) + " " + t + " " + text(rng, 40)
    docs = [(1, around(same)), (2, around(" ".join(near))), (3, around(clause)), (4, around(short)), (5, "前言" + signs + "后语"), (6, around(" ".join(short.split()[:8])))]
    got = {(r.doc_id, r.item_id) for r in leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 10), (2, 11), (2, 12), (2, 13), (4, 30), (5, 31)}


def test_filter_lets_all_seeds_pass(spark):
    codes = Codes()
    own = np.unique(all_seeds(codes.of(text(random.Random(1), 400)))[1])
    other = np.unique(all_seeds(codes.of(text(random.Random(2), 4000)))[1])
    bits = seed_filter(spark.createDataFrame([(int(h),) for h in own.view(np.int64)], "hash long"))
    assert len(passing(*bits, own)) == len(own) and len(passing(*bits, other)) < 5 + len(np.intersect1d(own, other))


def brute_share(item, doc):
    """Share of the item's words in the two longest stretches that follow one diagonal, by trying all of them."""
    n, stretches = len(item), []
    for d in range(-n, len(doc)):
        at = [i for i in range(n) if 0 <= i + d < len(doc) and item[i] == doc[i + d]]
        run = []
        for i in at:
            if run and i - run[-1] > 5:
                stretches.append((len(run), run[-1] - run[0] + 1))
                run = []
            run.append(i)
        if run:
            stretches.append((len(run), run[-1] - run[0] + 1))
    return sum(sorted((size for n_equal, size in stretches if size >= 14 and n_equal >= 0.75 * size), reverse=True)[:2]) / n


def test_against_brute_force_on_tables(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    items = [(r.item_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "eval_items").collect()][:60]
    got = {(r.doc_id, r.item_id) for r in leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in items:
        item = words(t)
        for r in docs:
            doc = words(r.text)
            if len(set(item) & set(doc)) > 0.45 * len(set(item)):
                share = brute_share(item, doc)
                if share > 0.45:
                    assert (r.doc_id, i) in got, (r.doc_id, i, share)
                elif share < 0.2:
                    assert (r.doc_id, i) not in got, (r.doc_id, i, share)


def test_masks_tolerate_replaced_words():
    rng = random.Random(5)
    item = text(rng, 80)
    codes = Codes()
    known = Item(codes.of(item), np.zeros(0, np.uint64))
    for rate, least in ((0.0, 0.95), (0.1, 0.8), (0.2, 0.5)):
        doc = codes.of(" ".join(changed(rng, words(item), rate)))
        assert known.share_in(doc, *all_seeds(doc)) >= least
    assert LEAST_SHARE < 0.5
