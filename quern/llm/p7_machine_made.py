"""Problem 7: generated, minified and vendored files, and data saved as code."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.staging import once, staged

# What tools write, and where package managers put what they fetch.
LOCK_NAMES = "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml poetry.lock Pipfile.lock Gemfile.lock Cargo.lock composer.lock go.sum Podfile.lock mix.lock pubspec.lock packages.lock.json flake.lock uv.lock".split()
VENDOR_DIRS = "vendor vendored third_party third-party thirdparty node_modules bower_components jspm_packages Pods Carthage Godeps deps external site-packages".split()
GENERATED_DIRS = "__generated__ generated generated-sources".split()
GENERATED_NAME = r"(\.pb\.(go|cc|h)|_pb2?(_grpc)?\.(js|ts|py|rb)|\.g\.(cs|dart)|\.designer\.(cs|vb)|\.generated\.\w+|\.freezed\.dart)$|(^|/)(moc|ui|qrc)_[^/]+\.(cpp|h)$|(^|/)zz_generated[^/]*$|(^|/)zz_[^/]*deepcopy[^/]*\.go$"
CODE = "py ts tsx js jsx mjs cjs java go rs cs cpp cc c h hpp rb php kt scala swift m mm css scss dart lua pl r sh".split()
GENERATED_HEADER = re.compile(
    r"""(?ix) code\s+generated\b.*\bdo\s+not\s+edit
    | <auto-?generated | ^\W*@generated\b
    | ^\W*auto-?generated\s+(?:file|by|from|code|source|using|with)\b
    | \b(?:automatically|machine)[\s-](?:generated|produced|created|written|made)\b.*\b(?:by|from|at|using)\b
    | \bautomatisch\s+(?:erzeugt|generiert|erstellt)\b | \b(?:generado|creado)\s+autom[aá]ticamente\b | \b(?:g[eé]n[eé]r[eé]|cr[eé][eé])e?\s+automatiquement\b
    | \b(?:создан|сгенерирован)о?\s+автоматически\b
    | \bgenerated\s+(?:by|from|with|using)\b.*\b(?:do\s+not|don't|never)\s+(?:edit|modify|change)"""
)
VENDORED_HEADER = re.compile(
    r"""(?ix) @license\s+\S+\s+v?\d+\.\d+ | ^\W*distributed\s+with\s+permission\s+of\s+the\b
    | ^\W*copied\s+(?:unchanged|verbatim|unmodified|as\s+is)?\s*from\s+\S+\s+v?\d | ^\W*this\s+copy\s+of\s+\S+\s+\(v?\d
    | ^(?:\W*+|[^\w.\-]*+(?=[.\-]++\s))[\w.\-]++\s+v\d+\.\d+(?:\.\d+)?\s+-\s+https?:// | \(c\)\s+\d{4}\S*\s+the\s+\S+\s+(?:authors|contributors)\b | ^/\*!\s*\S+\s+v\d"""
)
NUMBERS = re.compile(r"^[\[{(\s]*(?:[-+]?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfF]*\s*[,;]?\s*){4,}[\]})\s;,]*$")
ENCODED = re.compile(r"""^\s*[\[(]?\s*["'][A-Za-z0-9+/=\\]{40,}["'][\s+,;)\]\\.]*$""")
RECORD = re.compile(r"""^\s*[\[{(].*["']?\w+["']?\s*[:=].*[\]})]\s*[,;]?\s*$""")
NUMBERED = re.compile(r"[A-Za-z_]\d+\b|_\d+_")
HEADER_LINES, LONG_LINE = 8, 400


INTEGRITY = re.compile(r"\b(?:integrity|resolved|checksum)\b|h1:[\w+/]{20}|sha\d{3}[-:]")
KEYS = re.compile(r"[\"']?(\w+)[\"']?\s*:")
LETTERS, DIGITS = re.compile(r"[A-Za-z]+"), re.compile(r"\d+")


def line_facts(x: str) -> tuple[bool, tuple[str, ...] | None, str | None, bool]:
    """Of a line by itself: is it numbers or encoded bytes; the keys of a record that has a digit; its form, if it has a numbered name (lines of
    one form have one, or none); does it hold a digest as lock files do."""
    data = NUMBERS.match(x) is not None or ENCODED.match(x) is not None
    record = tuple(KEYS.findall(x)) if RECORD.match(x) else None
    form = DIGITS.sub("0", LETTERS.sub("a", x)) if NUMBERED.search(x) else None
    return data, record, form, INTEGRITY.search(x) is not None


kept_facts = lru_cache(maxsize=1 << 17)(line_facts)


def measures(text: str) -> tuple:
    """Sums over the lines of a chunk (so that they add up over a file): see COUNTS."""
    lines = text.split("\n")
    filled = [x for x in lines if x.strip()]
    long_ = [x for x in lines if len(x) > LONG_LINE]
    facts = [kept_facts(x) if len(x) <= LONG_LINE else line_facts(x) for x in filled]
    keys = Counter(f[1] for x, f in zip(filled, facts, strict=True) if f[1] is not None and len(x) < 2 * LONG_LINE)
    forms = Counter(f[2] for f in facts if f[2] is not None)
    data = records = numbered = 0
    for x, (is_data, record, form, _) in zip(filled, facts, strict=True):
        if is_data:
            data += len(x)
        elif record is not None and len(record) > 1 and keys[record] >= 4 and DIGITS.search(x):
            records += len(x)
        if form is not None and forms[form] >= 3:
            numbered += 1
    return len(text), len(filled), sum(map(len, long_)), sum(x.count(" ") for x in long_), data, records, numbered, sum(f[3] for f in facts)


SAYS = "says_generated says_vendored block_generated block_vendored open".split()
COUNTS = "chars filled long_chars long_blanks data_chars record_chars numbered integrity".split()


#: Comments of several lines: what opens them and what closes them. And what begins a line that is a comment (or a preamble) as a whole.
BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''", "{-": "-}", "--[[": "]]", "(*": "*)", "<#": "#>", "=begin": "=end"}
COMMENT = re.compile(r"(?i)//|#(?!\s*(?:include|define|pragma|ifn?def|if|undef|import|region)\b)|--|;|%|\*(?!\s*[{,])|<\?|<!doctype|rem\b")
EDGE = re.compile(r"(?m)/\*|<!--|^(?:(?!/\*|<!--)[^\"'`\n])*?(\*/|-->)\s*$")


def leading(text: str) -> tuple[int, bool]:
    """How many lines lie before the first line of code (one that begins with a comment counts), and whether there is no code at all.

    A chunk that closes a comment which it does not open begins inside it.
    """
    close = m[1] if ("*/" in text or "-->" in text) and (m := EDGE.search(text)) and m[1] else ""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        rest, begun = line.strip("\ufeff \t\r\f\v"), False
        while rest:
            if not close and (mark := next((o for o in BLOCKS if rest.startswith(o)), "")):
                close, rest = BLOCKS[mark], rest[len(mark) :]
            if close:
                begun = True
                _, closed, rest = rest.partition(close)
                rest = rest.strip()
                close = "" if closed else close
            elif COMMENT.match(rest):
                break
            else:
                return i + begun, False
    return len(lines), True


def notice(x: str) -> tuple[bool, bool]:
    """Whether a line says that a tool wrote the file, and whether it says that it comes from elsewhere."""
    return GENERATED_HEADER.search(x) is not None, VENDORED_HEADER.search(x) is not None


kept_notice = lru_cache(maxsize=1 << 16)(notice)


def header(text: str) -> tuple[bool, bool, bool, bool, bool]:
    """Whether the first lines say that a tool wrote the file, or that it comes from elsewhere; whether the comment before the first line
    of code says so; and whether there is no such line, so that the comment may go on in the next chunk.

    The first lines are that comment, however long, and HEADER_LINES at least.
    """
    lines = text.split("\n")
    n, open_ = leading(text)
    said = [kept_notice(x) if len(x) <= LONG_LINE else notice(x) for x in lines[: max(n, HEADER_LINES)]]
    generated, vendored = [g for g, _ in said], [v for _, v in said]
    return any(generated), any(vendored), any(generated[:n]), any(vendored[:n]), open_


#: A line of at least LINE characters counts, once a file.
LINE = 12
HASHES = f"array_distinct(transform(filter(transform(split(content, '\\n'), x -> trim(x)), x -> length(x) >= {LINE}), x -> xxhash64(x)))"


def chunk_measures(chunks: DataFrame) -> DataFrame:
    """Each distinct chunk once: (relative_path, repo, position, ext, COUNTS, SAYS, hs: hashes of its lines).

    The contents are read and measured in one pass where they lie; what is shuffled to find chunks that come twice is the
    measures (of copies that disagree, those of the longest content hold). Chunks without a path are no file's.
    """
    index = F.get_json_object("metadata", "$.chunkIndex").try_cast("long")
    rows = chunks.where("relative_path is not null").select(
        "id",
        "relative_path",
        F.col("collection_name").alias("repo"),
        F.coalesce(F.col("start_line").cast("long"), index, F.lit(1 << 40)).alias("position"),
        F.regexp_replace(F.lower(F.coalesce("file_extension", F.lit(""))), r"^\s*\.|\s+$", "").alias("ext"),
        F.coalesce("content", F.lit("")).alias("content"),
    )
    rows = rows.withColumn("hs", F.expr(HASHES))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = pd.DataFrame([(*measures(c), *header(c)) for c in p.content], columns=[*COUNTS, *SAYS])
            yield pd.concat([p[["id", "relative_path", "repo", "position", "ext"]].reset_index(drop=True), out, p[["hs"]].reset_index(drop=True)], axis=1)

    counts = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} boolean" for c in SAYS])
    measured = rows.mapInPandas(run, f"id string, relative_path string, repo string, position long, ext string, {counts}, hs array<long>")
    rest = [*COUNTS, "repo", "position", "ext", *SAYS, "hs"]
    return measured.groupBy("id", "relative_path").agg(F.max(F.struct(*rest)).alias("r")).select("relative_path", "r.*")


def file_measures(rows: DataFrame) -> DataFrame:
    """One row per file: sums over its chunks, and what its first lines say. Files are never put together: all measures add up.

    Where the first chunk is comment only, those after it are read too, to the first that has code. (One that lies wholly inside a comment
    whose lines bear no mark is taken for code.)
    """
    said = lambda c: F.col(f"first.says_{c}") | (F.col("first.open") & F.coalesce(F.col(f"at_{c}") <= F.coalesce("code_at", F.lit(1 << 62)), F.lit(False)))
    return (
        rows.groupBy("relative_path")
        .agg(
            F.min("repo").alias("repo"),
            F.max(F.when(F.col("ext") != "", F.col("ext"))).alias("ext"),
            *[F.sum(c).alias(c) for c in COUNTS],
            F.count("*").alias("chunks"),
            F.min(F.struct("position", "says_generated", "says_vendored", "open")).alias("first"),
            F.min(F.when(~F.col("open"), F.col("position"))).alias("code_at"),
            *[F.min(F.when(F.col(f"block_{c}"), F.col("position"))).alias(f"at_{c}") for c in ("generated", "vendored")],
        )
        .select(
            "relative_path",
            "repo",
            # the path's extension holds; the column only where the path has none
            F.coalesce(F.nullif(F.lower(F.regexp_extract("relative_path", r"\.([A-Za-z0-9]+)$", 1)), F.lit("")), "ext").alias("ext"),
            *COUNTS,
            "chunks",
            said("generated").alias("says_generated"),
            said("vendored").alias("says_vendored"),
        )
    )


def reason() -> Column:
    """What a file's name, first lines and composition of tokens say; null for hand-written ones."""
    path, name = F.col("relative_path"), F.regexp_extract("relative_path", r"[^/]*$", 0)
    dirs = F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
    code = F.col("ext").isin(*CODE)
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return (
        F.when(name.isin(*LOCK_NAMES), "lock file")
        .when(name.rlike(r"(?i)\.lock$|[-.]lock\.(json|ya?ml)$") & (share("integrity", "filled") >= 0.1), "lock file")
        .when(F.arrays_overlap(dirs, F.array(*map(F.lit, VENDOR_DIRS))), "vendored")
        .when(code & F.col("says_vendored") & ~(share("long_chars", "chars") > 0.6), "vendored")
        .when(F.arrays_overlap(dirs, F.array(*map(F.lit, GENERATED_DIRS))), "generated")
        .when(F.col("says_generated"), "generated")
        .when(path.rlike("(?i)" + GENERATED_NAME), "generated")
        .when(code & (share("long_chars", "chars") > 0.6) & (share("long_blanks", "long_chars") < 0.15), "minified")
        .when(code & (share("data_chars", "chars") + share("record_chars", "chars") > 0.6), "data")
        .when(code & (F.col("filled") >= 8) & (share("numbered", "filled") > 0.25), "generated")
    )


CONTAINED, LEAST_LINES = 0.8, 5
#: An unmarked file of code with at least SPREAD_LINES distinct lines that so many repositories hold unchanged is nobody's own.
SPREAD, SPREAD_LINES = 3, 20
#: Distinct vendored lines up to this number (8 bytes each) are sent to all tasks; more are matched by shuffle.
BROADCAST_LINES = 500_000


def file_lines(hashed: DataFrame, known: DataFrame) -> DataFrame:
    """(relative_path, repo, marked, h): the distinct lines of each file that nothing marks, or that is marked as vendored.

    Only files of several chunks are looked through for lines that come again; where the lines of one chunk are, they are distinct.
    """
    open_ = known.where("why is null or why = 'vendored'").select("relative_path", "repo", F.col("why").isNotNull().alias("marked"), "chunks")
    lines = hashed.join(open_, "relative_path").select("relative_path", "repo", "marked", "chunks", F.explode("hs").alias("h"))
    columns = ["relative_path", "repo", "marked", "h"]
    return lines.where("chunks = 1").select(columns).unionByName(lines.where("chunks > 1").select(columns).distinct())


def vendored_edits(hashed: DataFrame, known: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(relative_path, origin, containment): files that nothing marks, most of whose lines are in a vendored file of another repository.

    hashed: (relative_path, hs) of all chunks; known: (relative_path, repo, why, chunks) of all files. Files of equal lines are one class (by
    count, sum and exclusive or of the hashes of their distinct lines), so that a copied file, however often, counts once on either side.
    The vendored classes' lines are the inverted index. Of the others' lines only those in it are kept; a class of which less than `contained`
    are, is no copy, whatever it is compared with. For the few that remain, the rarest lines name the vendored classes they may come from,
    by the number of these, until they are more than a copy may have of its own (so that none can lack them all, however many classes share
    them). For these pairs the shared lines are counted, rare or not: distinct lines of the asking file that the vendored one has.
    A class that holds an unmarked file and a vendored one of another repository is contained whole. So is an unmarked class of code that
    SPREAD repositories or more hold: nobody wrote it in each of them; its origin is its first file.
    """
    lines = staged(file_lines(hashed, known))
    files = lines.groupBy("relative_path").agg(
        F.first("repo").alias("repo"), F.first("marked").alias("marked"), F.count("*").alias("n"), F.sum(F.col("h").bitwiseAND(F.lit((1 << 32) - 1))).alias("s"), F.bit_xor("h").alias("x")
    )
    files = staged(files.where(F.col("n") >= LEAST_LINES).select("relative_path", "repo", "n", "marked", F.xxhash64("n", "s", "x").alias("class")))
    held = files.groupBy("class", "repo").agg(
        F.max("n").alias("n"), F.min(F.when(F.col("marked"), F.col("relative_path"))).alias("origin"), F.min(F.when(~F.col("marked"), F.col("relative_path"))).alias("other")
    )
    classes = held.groupBy("class").agg(
        F.max("n").alias("n"), F.min("origin").alias("origin"), F.min("other").alias("other"),
        # enough to tell whether the vendored side is another repository
        F.min(F.when(F.col("origin").isNotNull(), F.col("repo"))).alias("first_repo"), F.max(F.when(F.col("origin").isNotNull(), F.col("repo"))).alias("last_repo"),
        F.count("repo").alias("repos"),
    )
    classes = staged(classes)
    index = staged(lines.select("relative_path", "h").join(classes.where("origin is not null").select(F.col("origin").alias("relative_path"), F.col("class").alias("b")), "relative_path").select("b", "h"))
    rare = staged(index.groupBy("h").agg(F.count("*").alias("df")))
    asked = lines.select("relative_path", "h").join(classes.where("origin is null").select(F.col("other").alias("relative_path"), F.col("class").alias("a"), "n"), "relative_path").select("a", "n", "h")
    wanted = F.broadcast(rare.select("h")) if rare.count() <= BROADCAST_LINES else rare.select("h")
    matched = staged(asked.join(wanted, "h", "left_semi"))
    enough = matched.groupBy("a").agg(F.count("*").alias("m"), F.max("n").alias("n")).where(F.col("m") >= contained * F.col("n")).select("a", "m")
    mine = staged(matched.join(enough, "a").join(rare, "h"))
    # more than n - m + place lines are read with this one; a copy may lack (1 - contained) n
    place = F.row_number().over(W.partitionBy("a").orderBy("df", "h"))
    telling = mine.withColumn("place", place).where(F.col("n") - F.col("m") + F.col("place") - 1 <= (1 - contained) * F.col("n") + 1e-6)
    pairs = telling.select("a", "h").join(index, "h").select("a", "b").distinct()
    shared = (
        pairs.join(mine, "a").join(index, ["b", "h"])
        .groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("n").alias("n"))
        .where(F.col("shared") >= contained * F.col("n"))
    )
    whole = classes.where("origin is not null and other is not null").select(F.col("class").alias("a"), F.col("class").alias("b"), F.col("n").alias("shared"), "n")
    origins = classes.where("origin is not null").select(F.col("class").alias("b"), "origin", "first_repo", "last_repo")
    elsewhere = (F.col("first_repo") != F.col("repo")) | (F.col("last_repo") != F.col("repo"))
    code = F.lower(F.regexp_extract("relative_path", r"\.([A-Za-z0-9]+)$", 1)).isin(*CODE)
    spread = classes.where((F.col("repos") >= SPREAD) & F.col("origin").isNull() & (F.col("n") >= SPREAD_LINES)).select(F.col("class").alias("a"), F.col("other").alias("origin"), F.col("n").alias("shared"), "n")
    unmarked = files.where(~F.col("marked")).select("relative_path", "repo", F.col("class").alias("a"))
    return (
        unmarked.join(shared.unionByName(whole).join(origins, "b"), "a").where(elsewhere).select("relative_path", "origin", "shared", "n")
        .unionByName(unmarked.where(code).join(spread, "a").select("relative_path", "origin", "shared", "n"))
        .groupBy("relative_path")
        .agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("containment"), "origin")).alias("r"))
        .select("relative_path", "r.origin", F.round("r.containment", 6).alias("containment"))
    )


def machine_made(chunks: DataFrame) -> DataFrame:
    """One row per file (relative_path): `why` it is not hand-written (lock file, vendored, generated, minified, data), or null.

    A file's measures are sums over its distinct chunks, its first lines those of the chunk with the smallest start_line (without
    one, chunkIndex), and of those after it while there is only comment. Null contents count as empty; chunks that come twice once; rows without a path belong to no file; broken
    metadata and extensions are passed over. The contents are read once.
    """
    rows = staged(chunk_measures(chunks))
    known = staged(file_measures(rows).withColumn("why", reason()).select("relative_path", "repo", "why", "chunks"))
    edits = vendored_edits(rows.select("relative_path", "hs"), known)
    return known.join(edits, "relative_path", "left").select(
        "relative_path", "repo", F.coalesce("why", F.when(F.col("origin").isNotNull(), F.lit("vendored"))).alias("why"), "origin", "containment"
    )


def shared_lines(chunks: DataFrame, least: float) -> DataFrame:
    """(relative_path, origin, containment): of each file outside the folders of vendored code the vendored file of another repository that has
    most of its lines, and which share, where that is `least` or more: the index by itself, without what other rules say of a file."""
    rows = chunks.where("relative_path is not null").select("id", "relative_path", F.col("collection_name").alias("repo"), F.coalesce("content", F.lit("")).alias("content")).withColumn("hs", F.expr(HASHES)).drop("content")
    rows = staged(once(rows, "id", lambda rest: F.max(F.struct(*rest))))
    dirs = F.split(F.regexp_replace("relative_path", r"/?[^/]*$", ""), "/")
    why = F.when(F.arrays_overlap(dirs, F.array(*map(F.lit, VENDOR_DIRS))), "vendored")
    known = rows.groupBy("relative_path").agg(F.min("repo").alias("repo"), F.count("*").alias("chunks")).withColumn("why", why)
    return vendored_edits(rows.select("relative_path", "hs"), staged(known), least)
