"""Problems 6 to 10."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import p6_split, p7_machine_made, p8_pack, p9_mix, p10_one_form
from quern.llm.tokens import encoder


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\r.,{}éя😀", max_size=400), st.integers(1, 60), st.integers(0, 40))
def test_pieces_join_to_the_text(text, size, overlap):
    cut = p6_split.pieces(text, size, overlap)
    assert "".join(text[own:end] for _, own, end in cut) == text
    assert all(end - start <= size for start, _, end in cut)
    if len(text) > size:
        shared = min(overlap, size // 2)
        assert all(own - start == min(shared, own) for start, own, _ in cut) and all(end > own for _, own, end in cut)
    else:
        assert cut == [(0, 0, len(text))]


def test_pieces_end_where_the_code_pauses():
    code = "\n\n".join(f"def f{i}(x):\n    y = x + {i}\n    return y" for i in range(30)) + "\n"
    cut = p6_split.pieces(code, 200, 20)
    assert len(cut) > 5 and all(code[own:].startswith("def ") for _, own, _ in cut)
    assert len(p6_split.pieces("x" * 1000, 100, 10)) == 12  # no pause anywhere: cut where it must be


def test_split_table(spark):
    config = spark.createDataFrame([("python", 50, 10), ("python", 50, 10), ("go", 30, None), ("default", 40, 100), (None, 5, 0), ("bad", -1, 0)], "language string, chunk_size int, chunk_overlap int")
    long = "line one\nline two\n" * 10
    rows = [(1, long, 5, 25, "python", "p"), (1, long, 5, 25, "python", "p"), (2, long, None, None, None, None), (3, "", 1, 1, "go", "p"), (4, None, 1, 1, "go", "p"), (5, "x" * 50, 1, 1, "python", "p"), (6, "x" * 51, 1, 1, "other", "p"), (None, long, 1, 1, "go", "p"), (7, "y" * 40_000, 1, 1, "go", "p")]
    df = spark.createDataFrame(rows, "chunk_no long, content string, start_line int, end_line int, language string, chunk_size string")
    got = p6_split.split_oversized(df.drop("chunk_size"), config).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.chunk_no, r.piece_no)):
        by.setdefault(r.chunk_no, []).append(r)
    assert {k: len(v) > 1 for k, v in by.items()} == {1: True, 2: True, 3: False, 5: False, 6: True, 7: True}
    assert by[2][0].chunk_size == 40 and by[6][0].chunk_size == 40 and by[3][0].content == ""
    assert by[1][0].start_line == 5 and by[2][0].start_line is None and by[1][1].start_line == 5 + long[: by[1][1].start].count("\n")
    assert all(len(r.content) <= r.chunk_size for r in got)
    assert p6_split.split_oversized(df.drop("chunk_size").limit(0), config).count() == 0
    assert p6_split.split_oversized(df.drop("chunk_size"), config.limit(0)).where("n_pieces > 1").count() == 0


def _chunk(i, text, path, ext=".py", repo="r1", meta='{"chunkIndex": 0}', start=1):
    return (f"c{i}", text, path, start, start + 1, ext, meta, repo, "clash")


CHUNKS = "id string, content string, relative_path string, start_line long, end_line long, file_extension string, metadata string, collection_name string, why string"


def test_machine_made_files(spark):
    rng = random.Random(2)
    words = "alpha bravo carbon delta ember falcon garnet harbor indigo jasper".split()
    line = lambda: f"    {rng.choice(words)}_{rng.choice(words)} = {rng.choice(words)}({rng.choice(words)}, {rng.randint(1, 999)})"
    lib = [line() for _ in range(40)]
    own = "\n".join(line() for _ in range(30))
    rows = [
        _chunk(1, "# Code generated by maker v1. DO NOT EDIT.\n" + own, "src/a.py"),
        _chunk(2, "# writes the DO NOT EDIT banner on top of every emitted file\n" + own, "src/b.py"),
        _chunk(3, "\n".join(f"  field{i}: {{ id: {i} }}," for i in range(30)), "src/c.ts", ".ts"),
        _chunk(4, "var a=1;" * 400, "static/d.js", "JS"),
        _chunk(5, "T = [\n" + "\n".join("  1, 2, 3, 4, 5, 6, 7, 8," for _ in range(20)) + "\n]", "src/e.py"),
        _chunk(6, "\n".join(lib), "third_party/libx/core.py", repo="r2"),
        _chunk(7, "\n".join([*lib[:36], *[line() for _ in range(3)]]), "src/util/copied.py", repo="r1"),
        _chunk(8, "\n".join([*lib[:12], *[line() for _ in range(40)]]), "src/util/inspired.py", repo="r1"),
        _chunk(9, "\n".join(lib), "src/own_copy.py", repo="r2"),  # of the same repository
        _chunk(10, '"a":\n  resolved x\n', "web/yarn.lock", None, meta=None),
        _chunk(11, "1, 2, 3, 4\n" * 30, "conf/table.yaml", ".yaml"),
        _chunk(12, "", "src/empty.py", ""),
        _chunk(13, None, "src/null.py", None, meta='{"chunk'),
        _chunk(14, own, "src/two.py", start=40),
        _chunk(15, "// <auto-generated> x 1.0 </auto-generated>\n", "src/two.py", start=1),
        _chunk(16, own, None),
        _chunk(17, "x = '" + "word " * 2000 + "'", "docs/long.md", ".md"),
    ]
    rows += rows[:4]
    df = spark.createDataFrame(rows, CHUNKS)
    got = {r.relative_path: r for r in p7_machine_made.machine_made(df).collect()}
    assert len(got) == 15
    why = {p: r.why for p, r in got.items() if r.why}
    assert why == {
        "src/a.py": "generated", "src/c.ts": "generated", "static/d.js": "minified", "src/e.py": "data", "third_party/libx/core.py": "vendored",
        "src/util/copied.py": "vendored", "web/yarn.lock": "lock file", "src/two.py": "generated",
    }
    assert got["src/util/copied.py"].origin == "third_party/libx/core.py" and abs(got["src/util/copied.py"].containment - 36 / 39) < 0.02
    assert p7_machine_made.machine_made(df.limit(0)).count() == 0


def test_copies_in_many_repositories_are_found(spark):
    """An unmarked copy that very many repositories have is as surely found as a single one."""
    lib = "\n".join(f"    step_{chr(97 + i)} = run(value_{chr(97 + i)}, mode)" for i in range(20))
    rows = [_chunk(0, lib, "vendor/lib/x.py", repo="r0")] + [_chunk(i, lib, f"src/m{i}/x.py", repo=f"r{i}") for i in range(1, 80)]
    got = p7_machine_made.machine_made(spark.createDataFrame(rows, CHUNKS)).where("why = 'vendored'").count()
    assert got == 80


def test_edited_copies_of_a_library_in_many_variants_are_found(spark):
    """However many vendored variants share a line, it leads to them."""
    word = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    lib = [f"    step_{word(i)} = run(value_{word(i)}, mode)" for i in range(30)]
    rows = [_chunk(i, "\n".join([*lib, f"    variant_{word(i)} = start(mode)"]), f"vendor/lib{i}/x.py", repo=f"r{i}") for i in range(60)]
    mine = [f"    {x}_of_mine = other(thing)" for x in ("first", "second", "third")]
    rows.append(_chunk(90, "\n".join([*lib, *mine]), "src/edited.py", repo="own"))
    rows.append(_chunk(91, "\n".join([*lib[:20], *(f"    own_{word(i)} = call(mode)" for i in range(10))]), "src/third.py", repo="own"))
    got = {r.relative_path: r for r in p7_machine_made.machine_made(spark.createDataFrame(rows, CHUNKS)).collect()}
    assert got["src/edited.py"].why == "vendored" and abs(got["src/edited.py"].containment - 30 / 33) < 1e-6
    assert got["src/third.py"].why is None


def test_lines_of_many_chunks_count_once(spark):
    """A line that a vendored file repeats in more than 50 chunks still leads to it, and counts once a file on either side."""
    word = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    lib = "\n".join(f"    step_{word(i)} = run(value_{word(i)}, mode)" for i in range(10))
    rows = [_chunk(i, f"{lib}\n    part_{word(i)} = begin(mode)", "vendor/lib/x.py", repo="r0", start=1 + 20 * i) for i in range(55)]
    rows.append(_chunk(80, f"{lib}\n    own_first = other(thing)\n    own_second = other(thing)", "src/edited.py", repo="own"))
    got = {r.relative_path: r for r in p7_machine_made.machine_made(spark.createDataFrame(rows, CHUNKS)).collect()}
    assert got["src/edited.py"].why == "vendored" and abs(got["src/edited.py"].containment - 10 / 12) < 1e-6


def test_lines_that_two_chunks_share_count_once(spark):
    """Four of an asking file's twelve distinct lines are vendored: no copy, however often its chunks repeat these."""
    word = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    lib = [f"    step_{word(i)} = run(value_{word(i)}, mode)" for i in range(12)]
    own = [f"    own_{word(i)} = call(other, mode)" for i in range(8)]
    rows = [_chunk(0, "\n".join(lib), "vendor/lib/x.py", repo="r0"), _chunk(1, "\n".join(lib[:4]), "vendor/lib/x.py", repo="r0", start=40)]
    rows += [_chunk(10 + i, "\n".join([*lib[:4], *(own if i == 0 else [])]), "src/mine.py", repo="own", start=1 + 20 * i) for i in range(9)]
    rows += [_chunk(30, "\n".join(lib[:6]), "src/copy.py", repo="own"), _chunk(31, "\n".join(lib[4:12]), "src/copy.py", repo="own", start=9)]
    got = {r.relative_path: r for r in p7_machine_made.machine_made(spark.createDataFrame(rows, CHUNKS)).collect()}
    assert got["src/mine.py"].why is None and got["src/copy.py"].why == "vendored" and got["src/copy.py"].containment == 1


def test_unmarked_files_of_many_repositories_are_nobodys_own(spark):
    word = lambda i: chr(97 + i % 26) + chr(97 + i // 26)
    lib = "\n".join(f"    step_{word(i)} = run(value_{word(i)}, mode)" for i in range(25))
    rows = [_chunk(i, lib, f"lib/x{i}.py", repo=f"r{i}") for i in range(3)] + [_chunk(10 + i, lib.replace("step", "part"), f"lib/y{i}.py", repo=f"r{i % 2}") for i in range(4)] + [_chunk(20 + i, lib.replace("step", "word"), f"docs/z{i}.md", ".md", repo=f"r{i}") for i in range(3)]
    got = {r.relative_path: r for r in p7_machine_made.machine_made(spark.createDataFrame(rows, CHUNKS)).collect()}
    assert {k for k, r in got.items() if r.why} == {"lib/x0.py", "lib/x1.py", "lib/x2.py"} and got["lib/x2.py"].origin == "lib/x0.py"


def test_notices_are_read_to_the_first_line_of_code(spark):
    notice, code = "// Code generated by maker v1. DO NOT EDIT.", "func add(a int, b int) int {\n\treturn a + b\n}\n"
    lines = "\n".join("// some words of a licence" for _ in range(30))
    block = "/*\n" + "some words of a licence\n" * 30
    rows = [
        _chunk(1, f"{lines}\n{notice}\n{code}", "src/long.go", ".go"),
        _chunk(2, f"{block}*/\n{notice}\n{code}", "src/block.go", ".go"),
        _chunk(3, "// " + "words " * 100 + notice[3:] + "\n" + code, "src/wide.go", ".go"),
        _chunk(4, block, "src/parted.go", ".go", start=1),
        _chunk(5, f"words\n*/\n{notice}\n{code}", "src/parted.go", ".go", start=32),
        _chunk(6, code * 5 + notice + "\n" + code, "src/later.go", ".go"),
        _chunk(7, lines, "src/below.go", ".go", start=1),
        _chunk(8, f"{code}{notice}\n{code}", "src/below.go", ".go", start=31),
        _chunk(9, lines + "\n" + code, "src/plain.go", ".go", start=1),
        _chunk(10, f"{notice}\n{code}", "src/plain.go", ".go", start=40),
    ]
    got = {r.relative_path: r.why for r in p7_machine_made.machine_made(spark.createDataFrame(rows, CHUNKS)).collect()}
    assert {k for k, v in got.items() if v == "generated"} == {f"src/{x}.go" for x in ("long", "block", "wide", "parted")}, got
    assert p7_machine_made.leading("x = 1\n# y") == (0, False) and p7_machine_made.leading("/* a */ x = 1") == (1, False)
    assert p7_machine_made.leading("# a\n\n# b") == (3, True) and p7_machine_made.leading("#include <a>") == (0, False)


def test_hilbert_curve_is_a_path():
    """All cells once, and neighbours on the curve are neighbours in the cube."""
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(p8_pack.hilbert(cells, 3))
    assert sorted(p8_pack.hilbert(cells, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def _documents(spark, texts, extra="clash"):
    rows = [(i, t, ["s1", "s2", None, "other"][i % 4], extra) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string, place string")


def test_pack_keeps_everything_whole(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("one two three four five six".split()) for _ in range(rng.randint(1, 90))) for _ in range(300)] + ["", None, "   ", "long " * 3000] + ["same text again"] * 150
    limits = spark.createDataFrame([("small", 64), ("small", 64), ("large", 500), (None, 5), ("none", 0)], "pack_name string, capacity_tokens int")
    df = _documents(spark, texts)
    got = p8_pack.pack(df, limits).collect()
    sizes = {i: len(encoder().encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    for name, capacity in (("small", 64), ("large", 500)):
        mine = [r for r in got if r.pack_name == name]
        total, held = {}, {}
        for r in mine:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            if r.container_id:
                held.setdefault(r.container_id, []).append(r)
        assert total == sizes
        for rows in held.values():
            used = sum(r.n_tokens for r in rows)
            assert used <= capacity and all((r.used, r.room) == (used, capacity - used) for r in rows)
            assert sorted(r.place_in_container for r in rows)[0] == 0
        pieces = {}
        for r in mine:
            pieces.setdefault(r.doc_id, []).append(r)
        assert all(len(p) == 1 or sizes[i] > capacity for i, p in pieces.items())
        summary = {r.pack_name: r for r in p8_pack.room_left(spark.createDataFrame(got, p8_pack.PACKED)).collect()}[name]
        assert summary.containers == len(held) and summary.documents == len(texts) and summary.room_share < 0.05 and summary.same_cell >= summary.by_chance
    assert p8_pack.pack(df.limit(0), limits).count() == 0 and p8_pack.pack(df, limits.limit(0)).count() == 0


def test_containers_hold_neighbours_on_the_curve(spark, monkeypatch):
    """Documents of ten vocabularies: a container's documents lie together, and no longer do when the curve's order is shuffled."""
    rng = random.Random(3)
    words = [[f"{a}{b}" for b in "abcdefghij"] for a in ("lo", "ka", "mi", "zu", "pe", "ra", "to", "vi", "ne", "su")]
    texts = [" ".join(rng.choice(words[i % 10]) for _ in range(rng.randint(20, 60))) for i in range(1500)]
    limits = spark.createDataFrame([("small", 500)], "pack_name string, capacity_tokens int")
    df = _documents(spark, texts)
    near = p8_pack.room_left(p8_pack.pack(df, limits, task_rows=400)).first()
    keys = p8_pack.curve_keys
    monkeypatch.setattr(p8_pack, "curve_keys", lambda d, r: keys(d, r).withColumn("cell", F.col("place")).withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id"), 4)))
    far = p8_pack.pack(df, limits, task_rows=400).drop("cell").join(keys(df).select("doc_id", F.shiftright("place", 52).cast("int").alias("cell")), "doc_id")
    far = p8_pack.room_left(far).first()
    assert near.containers > 100 and near.room_share < 0.03 and near.by_chance == far.by_chance
    assert near.same_cell > 2 * far.same_cell and far.same_cell < 1.3 * far.by_chance


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(4)
    texts = ["word " * rng.randint(5, 40) for _ in range(4000)] + [None, ""]
    df = _documents(spark, texts)
    mix = spark.createDataFrame([("s1", 3.0, 1), ("s2", 1.0, 2), ("s2", 1.0, 2), ("absent", 1.0, 3), ("zero", 0.0, 9), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    uses, shares = p9_mix.mixture(df, mix)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"s1", "s2", "absent"} and got["absent"].tokens == 0 and abs(got["s1"].target_share - 0.6) < 1e-6
    assert abs(got["s1"].tokens / got["s2"].tokens - 3) < 0.02 and got["s1"].most_uses == 1 and got["s2"].most_uses <= 2
    rows = uses.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"s1", "s2"}
    s1 = sum(len(encoder().encode_ordinary(t)) for i, t in enumerate(texts) if t and i % 4 == 0)
    assert got["s1"].tokens == s1  # what is scarce is used up
    small, shares = p9_mix.mixture(df, mix, total=9000)
    got = {r.source: r.tokens for r in shares.collect()}
    assert abs(got["s1"] - 5400) <= 40 and abs(got["s2"] - 1800) <= 40
    assert {r.doc_id for r in small.where("source = 's1'").collect()} <= {r.doc_id for r in rows}  # thresholds are nested
    _, shares = p9_mix.mixture(df, mix, total=10_000_000)
    got = {r.source: r for r in shares.collect()}
    assert got["s1"].most_uses == 1 and got["s2"].most_uses == 2
    assert p9_mix.mixture(df.limit(0), mix)[0].count() == 0 and p9_mix.mixture(df, mix.limit(0))[1].count() == 0


SAME = [
    ("stale ｅｎｔｒｉｅｓ ６２", "stale entries 62"),
    ("loﬆ vé", "lost vé"),
    ("ret﻿ur​n so­ft⁠ly‍", "return softly"),
    ("a　b c d", "a b c d"),
    ("well‐known no‑break", "well-known no-break"),
    ("priсing аgainst еnd", "pricing against end"),
    ("сбoрка индeкс", "сборка индекс"),
    ("Τhe meadοw", "The meadow"),
    ("САО pуthon", "CAO python"),
    ("Νach der Ζone", "Nach der Zone"),
    ("Տee the gսide", "See the guide"),
]


def test_same_reading_gives_the_same_form():
    for a, b in SAME:
        assert p10_one_form.one_form(a) == p10_one_form.one_form(b), (a, b)


def test_other_reading_gives_another_form():
    for a, b in [("naive", "naïve"), ("Case", "case"), ("x2", "x²"), ("end", "and"), ("сбой", "сбоя"), ("1", "l"), ("file", "files"), ("ё", "е"), ("и", "й"), ("a b", "ab")]:
        assert p10_one_form.one_form(a) != p10_one_form.one_form(b), (a, b)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abceopxyсборкаТαο ｆ２​́ﬁ\n-", max_size=40))
def test_form_is_its_own_form(text):
    once = p10_one_form.one_form(text)
    assert p10_one_form.one_form(once) == once


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="acdeghopsxykmnt ", min_size=1, max_size=30), st.data())
def test_any_disguise_gives_one_form(text, data):
    out = ""
    for c in text:
        family = [x for x in p10_one_form.FAMILY.get(c, ()) if x] or [c]
        out += data.draw(st.sampled_from(family)) + data.draw(st.sampled_from(["", "", "​", "⁠"]))
    assert p10_one_form.one_form(out) == p10_one_form.one_form(text)


def test_found_pairs(spark):
    texts = ["the same", "the ｓame", "the sаme", "another", None, "", " ", "​", "x" * 200_000, "x" * 200_000 + "​"] + ["hot text"] * 300 + ["hot text"]
    rows = [(i, t, "k") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:4], "doc_id long, text string, form string")
    got = {tuple(r) for r in p10_one_form.found_pairs(df).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (8, 9)} | {(i, 310) for i in range(10, 310)}
    many = spark.createDataFrame([(i, "e" * i + "е" * (40 - i)) for i in range(41)], "doc_id long, text string")  # one reading, 41 spellings
    pairs, members = p10_one_form.same_reading(many, spellings=10)
    assert pairs.count() == pairs.distinct().count() == 41 * 40 // 2 and members.count() == 41
    classes = {r.doc_id: (r.reading, r.spelling) for r in p10_one_form.reading_classes(df).collect()}
    assert classes == {0: (0, 0), 1: (0, 1), 2: (0, 2), 8: (8, 8), 9: (8, 9)} | {i: (10, 10) for i in range(10, 310)} | {310: (10, 310)}
    forms = {r.doc_id: r.form for r in p10_one_form.normalized(df).collect()}
    assert forms[4] is None and forms[5] == forms[6] == forms[7] == "" and forms[0] == forms[1] == forms[2]
    assert p10_one_form.found_pairs(df.limit(0)).count() == 0
    assert p10_one_form.normalized(df.where(F.lit(False))).count() == 0
