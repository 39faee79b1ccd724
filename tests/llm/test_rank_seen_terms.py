"""Problems 1 to 3 on small tables, against brute force."""

import hashlib
import math
import random
from statistics import median

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import p1_rank, p2_seen, p3_terms

RANKED = "query_id long, list_no int, metric string, id string, rank int, score double, weight string, key string"


def test_median_rank_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for q in range(4):
        for n, metric in enumerate(["COSINE", "BM25", "L2"][: 2 + q % 2]):
            for i in range(12):
                if rng.random() < 0.8:
                    s = round(rng.choice([1, 10, 100]) * rng.random(), 1)
                    rows.append((q, n, metric, f"c{i}", None, rng.choice([s, s, s, s, None, math.nan, math.inf]), "x", "y"))
    rows += rows[:7]  # delivered twice
    got = {(r.query_id, r.id): r for r in p1_rank.median_ranks(spark.createDataFrame(rows, RANKED)).collect()}
    entries = {}
    for q, n, m, i, _, s, *_ in rows:
        if s is not None and math.isfinite(s):
            entries.setdefault(q, {}).setdefault(n, {})[i] = s if m == "L2" else -s
    for q, lists in entries.items():
        for i in {i for x in lists.values() for i in x}:
            places = []
            for x in lists.values():
                below, same = sum(v < x[i] for v in x.values()) if i in x else 0, sum(v == x[i] for v in x.values()) if i in x else 0
                places.append(below + (same + 1) / 2 if i in x else len(x) + 1)
            assert got[q, i].median_rank == median(places)
            assert abs(got[q, i].mean_rank - sum(places) / len(places)) < 1e-9
    assert len(got) == sum(len({i for x in lists.values() for i in x}) for lists in entries.values())


def test_weights_decide_and_broken_options_do_not(spark):
    rows = [(1, 0, "COSINE", "a", 1, 0.9, None, None), (1, 0, "COSINE", "b", 2, 0.1, None, None), (1, 1, "BM25", "a", 1, 1.0, None, None), (1, 1, "BM25", "b", 2, 900.0, None, None)]
    ranked = spark.createDataFrame(rows, RANKED)
    options = ['{"strategy": "weighted", "params": {"weights": [1, 3]}}', '{"strategy": "weighted", "params": {"weights": [3, 1]}}', '{"strategy": "weighted"', None, '{"strategy": "weighted", "params": {"weights": [0, 0]}}']
    firsts = []
    for o in options:
        q = spark.createDataFrame([(1, o), (1, o)], "query_id long, rerank string")
        order = p1_rank.full_order(p1_rank.median_ranks(ranked, p1_rank.list_weights(q))).orderBy("place").collect()
        firsts.append(order[0].id)
        assert [r.place for r in order] == [1, 2]
    assert firsts == ["b", "a", "a", "a", "a"]


def test_rank_of_nothing(spark):
    empty = spark.createDataFrame([], RANKED)
    assert p1_rank.first_items(p1_rank.median_ranks(empty), 3).count() == 0
    assert p1_rank.full_order(p1_rank.median_ranks(empty)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 20) - 1), max_size=300), st.integers(3, 16), st.sets(st.integers(0, (1 << 20) - 1), max_size=60))
def test_quotient_filter_holds_what_it_was_given(keys, q, more):
    ordered = np.array(sorted(keys), np.uint64)
    f = p2_seen.QuotientFilter(ordered, q, 20 - q)
    assert f.read().tolist() == ordered.tolist()
    asked = np.array([*keys, *more, 0, (1 << 20) - 1], np.uint64)
    assert f.contains(asked).tolist() == [int(x) in keys for x in asked]
    g = f.merged(np.array(sorted(more), np.uint64), max(3, q - 1))
    assert g.read().tolist() == sorted(keys | more) and (g.q, g.q + g.r) == (max(3, q - 1), 20)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), max_size=40), max_size=30))
def test_levels_answer_in_the_order_of_arrival(batches):
    held, before = p2_seen.Levels(20), set()
    for batch in batches:
        truth = []
        for k in batch:
            truth.append(k in before)
            before.add(k)
        assert held.ask(np.array(batch, np.uint64)).tolist() == truth
    assert sorted(k for f in held.filters for k in f.read().tolist()) == sorted(before)


def test_work_grows_with_the_keys():
    """250 and 2,500 batches of 200 keys: a key is moved a few times, however many batches there are."""
    rng = np.random.default_rng(6)
    each = []
    for n in (250, 2500):
        held = p2_seen.Levels(44)
        keys = rng.integers(0, 1 << 44, (n, 200), dtype=np.uint64)
        for batch in keys:
            assert not held.ask(batch).any()
        assert held.ask(keys.ravel()[:5000]).all() and len(held.filters) < 14
        each.append(held.moved / keys.size)
    assert each[1] < 1.5 * each[0] and each[1] < 16


def _digest(n):
    return hashlib.sha256(str(n).encode()).hexdigest()


WAYS = [str, str.upper, lambda h: "sha256:" + h, lambda h: "  " + h + " ", lambda h: "0x" + h.upper(), lambda h: "-".join(h[i : i + 8] for i in range(0, 64, 8))]


def test_seen_before_against_brute_force(spark):
    rng = random.Random(5)
    cache = [(rng.choice(WAYS)(_digest(n)), "x") for n in range(40)] + [(None, "x"), (_digest(1)[:30], "x")]
    stream = [(i, rng.choice(WAYS)(_digest(7 if i % 3 == 0 else rng.randrange(300)))) for i in range(900)]  # a third of all rows is one key
    stream += [(900, None), (901, _digest(5)[:20]), (902, ""), (903, _digest(5)[:20])]
    truth, seen = {}, set(range(40))
    numbers = {_digest(n): n for n in range(300)}
    for i, h in sorted(stream, key=lambda x: x[0]):
        bare = "".join(c for c in (h or "").lower().replace("sha256", "").replace("0x", "") if c in "0123456789abcdef")
        n = numbers.get(bare)
        truth[i] = None if n is None else n in seen
        seen.add(n)
    stream += rng.sample(stream, 50)
    rng.shuffle(stream)
    c = spark.createDataFrame(cache, "content_hash string, fp string")
    s = spark.createDataFrame(stream, "lookup_id long, content_hash string").withColumn("block", F.lit("clash"))
    for blocks, segments in ((10_000, 10_000), (100, 64), (4, 100)):  # the last: 225 blocks
        got = {r.lookup_id: r.seen for r in p2_seen.seen_before(c, s, block_rows=blocks, segment_rows=segments).collect()}
        assert got == truth
    few = p2_seen.error_report(c, s, bits=9).first()
    assert few.false_new == 0 and few.false_seen > 0 and 0.3 * few.expected_false_seen < few.false_seen < 2 * few.expected_false_seen
    assert p2_seen.error_report(c, s, bits=50).first().measured_rate == 0
    assert p2_seen.seen_before(c.limit(0), s.limit(0)).count() == 0
    assert p2_seen.seen_before(c, s.limit(0)).count() == 0


def test_terms_against_brute_force(spark):
    texts = {"a": "getUser getUser user_id 12abc", "b": "user name user", "c": None, "d": "x " * 5000 + "rareTerm", "e": ""}
    chunks = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [("a", texts["a"], 1)], "id string, content string, score int")
    asked = [("a", "user"), ("a", "get"), ("a", "get"), ("a", "nothing"), ("d", "rare"), ("d", "x"), ("c", "user"), ("z", "user"), ("e", "x"), (None, "user"), ("a", None)]
    terms = spark.createDataFrame([(i, t, None, 7) for i, t in asked], "id string, term string, score double, df int")
    got = {(r.id, r.term): r for r in p3_terms.distinctive_terms(chunks, terms).collect()}
    tokens = {"a": "get user get user user id 12 abc".split(), "b": ["user", "name", "user"], "c": [], "d": ["x"] * 5000 + ["rare", "term"], "e": []}
    n, avg = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    assert set(got) == {(i, t) for i, t in asked if i and t}
    for (i, t), r in got.items():
        tf, df = tokens.get(i, []).count(t), sum(t in x for x in tokens.values())
        score = math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens.get(i, [])) / avg)) if tf else 0
        assert (r.frequency, r.document_count) == (tf, df) and abs(r.score - score) < 1e-9
    best = {r.id: r.term for r in p3_terms.most_distinctive(p3_terms.distinctive_terms(chunks, terms)).collect()}
    assert best == {"a": "get", "d": "x", "c": "user", "z": "user", "e": "x"}
    few = chunks.unionByName(spark.createDataFrame([("b", "user", 1)], "id string, content string, score int"))  # a copy that disagrees
    for most in (1000, 0):  # sent to all tasks, and by shuffle
        assert {r.id: r.t for r in p3_terms.tokenized(few, most).collect()} == tokens
        assert {(r.id, r.term): r for r in p3_terms.distinctive_terms(few, terms, broadcast_rows=most).collect()} == got
    assert p3_terms.distinctive_terms(chunks.limit(0), terms).where("score > 0").count() == 0
    assert p3_terms.distinctive_terms(chunks, terms.limit(0)).count() == 0
