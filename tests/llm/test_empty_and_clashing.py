"""Every problem's operators over empty tables, over nulls in every column, and beside columns whose names clash with their own."""

import pytest
from pyspark.sql import functions as F

from quern.llm import p1_rank, p2_seen, p3_terms, p4_similar, p5_credentials, p6_split, p7_machine_made, p8_pack, p9_mix, p10_one_form

CLASH = "k string, h long, n int, row long, t string, part int, parts int, rep string, g long, segment long, form string, place long, cell int, why string, copies long"
RANKED = "query_id long, list_no int, metric string, id string, rank int, score double"
CHUNKS = "id string, content string, relative_path string, start_line long, end_line long, file_extension string, metadata string, collection_name string"
VECTORS = "id string, vector array<float>"
CODE = "chunk_no long, content string, start_line int, end_line int, language string, file_path string"
DOCUMENTS = "doc_id long, text string, lang string, source string"
HASHES = "content_hash string, embedding array<float>, dimension int, created_at timestamp"
LOOKUPS = "lookup_id long, content_hash string"


def frames(spark, schema, rows):
    """The rows twice, with a row of nulls, beside clashing columns; and the table without rows."""
    own = {f.split()[0] for f in schema.split(", ")}
    more = ", ".join(f for f in CLASH.split(", ") if f.split()[0] not in own)
    full = f"{schema}, {more}"
    width = len(full.split(", "))
    data = [(*r, *[None] * (width - len(r))) for r in [*rows, *rows, (None,) * len(own)]]
    df = spark.createDataFrame(data, full).withColumns({c.split()[0]: F.lit("7").cast(c.split()[1]) for c in more.split(", ")})
    return df, df.limit(0)


TEXT = "password = 'Wodi-krelu7713'\nx = 1\n"
CASES = {
    "p1": (RANKED, [(1, 0, "L2", "a", None, 0.5), (1, 1, "BM25", "b", None, None)], lambda d: p1_rank.first_items(p1_rank.median_ranks(d), 3), 1),
    "p1 order": (RANKED, [(1, 0, "L2", "a", None, 0.5), (1, 1, "BM25", "b", None, 3.0)], lambda d: p1_rank.full_order(p1_rank.median_ranks(d)), 2),
    "p2": (LOOKUPS, [(1, "ab" * 32), (2, "AB" * 32), (3, "no")], lambda d: p2_seen.seen_before(d.select(F.lit(None).cast("string").alias("content_hash")).limit(0), d), 3),
    "p3": ("id string, content string, term string", [("a", "one two two", "two"), ("b", "", "one")], lambda d: p3_terms.most_distinctive(p3_terms.distinctive_terms(d, d)), 2),
    "p4 pairs": (VECTORS, [("a", [1.0] + [0.0] * 63), ("b", [2.0] + [0.0] * 63), ("c", [0.0] * 64)], lambda d: p4_similar.similar_pairs(d), 1),
    "p4 groups": (VECTORS, [("a", [1.0] + [0.0] * 63), ("b", [2.0] + [0.0] * 63), ("c", [])], lambda d: p4_similar.similar_degree(d), 2),
    "p4 nearest": (VECTORS, [("a", [1.0] + [0.0] * 63), ("b", [1.0] * 64), ("c", None)], lambda d: p4_similar.nearest(d), 2),
    "p5": (CHUNKS, [("a", TEXT, "a.py", 1, 2, ".py", None, "r"), ("b", "", None, None, None, None, None, None)], lambda d: p5_credentials.credential_lines(d), 1),
    "p5 redacted": (CHUNKS, [("a", TEXT, "a.py", 1, 2, ".py", None, "r"), ("b", None, None, None, None, None, None, None)], lambda d: p5_credentials.find_credentials(d), 2),
    "p6": (CODE, [(1, "a\n" * 40, 1, 40, "go", "p"), (2, "", None, None, None, None)], lambda d: p6_split.split_oversized(d, d.sparkSession.createDataFrame([("default", 50, 5)], "language string, chunk_size int, chunk_overlap int")), None),
    "p7": (CHUNKS, [("a", TEXT, "vendor/a.py", 1, 2, ".py", "{", "r"), ("b", None, "b.py", None, None, None, None, None)], lambda d: p7_machine_made.machine_made(d), 2),
    "p7 lines": (CHUNKS, [("a", TEXT, "vendor/a.py", 1, 2, ".py", "{", "r"), ("b", None, "b.py", None, None, None, None, None)], lambda d: p7_machine_made.shared_lines(d, 0.1), 0),
    "p8": (DOCUMENTS, [(1, "one two", "en", "s"), (2, "", None, None)], lambda d: p8_pack.room_left(p8_pack.pack(d, d.sparkSession.createDataFrame([("a", 8)], "pack_name string, capacity_tokens int"))), None),
    "p9": (DOCUMENTS, [(1, "one two", "en", "s"), (2, "", None, None)], lambda d: p9_mix.mixture(d, d.sparkSession.createDataFrame([("s", 1.0, 2)], "source string, weight double, max_repeats int"))[0], None),
    "p10": (DOCUMENTS, [(1, "the same", "en", "s"), (2, "the ｓame", None, None), (3, "", None, None)], lambda d: p10_one_form.found_pairs(d), 1),
    "p10 classes": (DOCUMENTS, [(1, "the same", "en", "s"), (2, "the ｓame", None, None), (3, " ", None, None)], lambda d: p10_one_form.reading_classes(d), 2),
}


@pytest.mark.parametrize("name", CASES)
def test_rows_that_come_twice_nulls_and_clashing_names(spark, name):
    schema, rows, run, count = CASES[name]
    df, empty = frames(spark, schema, rows)
    found = run(df).count()
    assert found == count if count is not None else found > 0
    assert run(empty).count() == 0
