"""Problem 6: oversized items cut at natural boundaries, by merging the pieces across the weakest boundary first."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECLARATION = re.compile(r"^(?:[@#/*]|export\b|public\b|private\b|def\b|class\b|async\b|func\b|function\b|fn\b|impl\b|struct\b|interface\b|describe\b|module\b|pub\b|static\b|final\b)")


def atoms(text: str, most: int) -> list[tuple[int, int, float]]:
    """(start, end, strength of the boundary at its end): lines, and parts of lines that are longer than `most`.

    Strengths: 0 to 1 within a line, from 2 at a line's end; more where an indented part ends, an empty line follows, or a
    declaration at the margin begins.
    """
    out: list[tuple[int, int, float]] = []
    at = 0
    lines = text.splitlines(keepends=True)
    lines = [x for line in lines for x in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$", line)] if any("\x0b" in x or "\x0c" in x for x in lines) else lines
    for n, line in enumerate(lines):
        end = at + len(line)
        while end - at > most:
            cut, strength = at + most, 0.0
            # the last pause in the second half of what fits; a hard cut only where there is none
            for rank, pattern in ((1.0, r"[.;!?]\s+"), (0.8, r"[;,)}\]>]"), (0.6, r"\s+"), (0.2, r"[^\w]")):
                last = None
                for last in re.finditer(pattern, text[at + most // 2 : at + most]):
                    pass
                if last:
                    cut, strength = at + most // 2 + last.end(), rank
                    break
            out.append((at, cut, strength))
            at = cut
        following = lines[n + 1] if n + 1 < len(lines) else ""
        strength = 2.0
        if not line.strip():
            strength += 4.0 if following[:1].strip() else 2.0
        indent = len(following) - len(following.lstrip())
        if following.strip():
            strength += max(0.0, 1.5 - indent / 4)
            if not indent and DECLARATION.match(following):
                strength += 2.0
            if re.match(r"^\s*[})\]]", following):
                strength = 1.5  # a closing bracket belongs to what it closes
        else:
            strength = 2.2 if line.strip() else strength  # the blank line itself goes with what is before it
        if end > at:
            out.append((at, end, strength))
        at = end
    return out


def pieces(text: str, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, own start, end) of each piece of a text longer than `size`; of another, the text as one piece.

    Own parts follow on one another and give the text when joined; each but the first starts `overlap` characters before its
    own part. Adjacent parts wait in a heap by the strength of the boundary between them; the weakest is merged
    first as long as the two and the overlap fit (of equal ones the shorter result first, then the earlier).
    """
    if len(text) <= size:
        return [(0, 0, len(text))]
    overlap = max(0, min(overlap, size // 2))
    room = size - overlap
    parts = atoms(text, room)
    start, end = [p[0] for p in parts], [p[1] for p in parts]
    after, before, alive = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)], [True] * len(parts)
    last = [*range(len(parts))]  # the atom a part ends with
    heap = [(parts[i][2], end[i + 1] - start[i], i, i + 1, end[i + 1]) for i in range(len(parts) - 1)]
    heapq.heapify(heap)
    limit = lambda i: size if start[i] == 0 else room
    while heap:
        _, length, i, j, upto = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or end[j] != upto or end[j] - start[i] != length or length > limit(i):
            continue
        end[i], last[i], alive[j], after[i] = end[j], last[j], False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
            heapq.heappush(heap, (parts[last[i]][2], end[after[i]] - start[i], i, after[i], end[after[i]]))
        if before[i] >= 0:
            h = before[i]
            heapq.heappush(heap, (parts[i - 1][2], end[i] - start[h], h, i, end[i]))
    return [(max(0, start[i] - overlap) if start[i] else 0, start[i], end[i]) for i in range(len(parts)) if alive[i]]


def applicable(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """chunks with the chunk_size and chunk_overlap of their language.

    The row 'default' is for a null language and one that is not listed. A config row that comes twice counts once
    (the smaller size holds). Without any fitting row the size is null, and nothing is cut.
    """
    listed = config.where("language is not null and chunk_size > 0").groupBy("language").agg(F.min(F.struct("chunk_size", "chunk_overlap")).alias("c"))
    default = listed.where("language = 'default'").select(F.col("c").alias("d"))
    one = chunks.sparkSession.range(1).join(default, how="left").select("d")
    return (
        chunks.join(F.broadcast(listed.select("language", "c")), "language", "left")  # one row per language of the configuration
        .crossJoin(F.broadcast(one))
        .withColumn("c", F.coalesce("c", "d"))
        .withColumn("chunk_size", F.col("c.chunk_size"))
        .withColumn("chunk_overlap", F.coalesce("c.chunk_overlap", F.lit(0)))
        .drop("c", "d")
    )


PIECES = "chunk_no long, language string, chunk_size int, chunk_overlap int, piece_no int, n_pieces int, start int, own_start int, end int, start_line int, content string"


def split_oversized(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """One row per piece of every distinct chunk_no; a chunk within its size is one piece.

    start, own_start and end are code points in the chunk's content; a piece is content[start:end] and at most chunk_size long;
    the own parts give the content when joined. An overlap of more than half the size counts as half; a null one as 0.
    start_line is the line of the piece in the file (null where the chunk has none). Null content has no piece; empty content is
    one empty piece. A chunk_no that comes twice counts once (where copies disagree, the largest content holds); rows without
    chunk_no are none.
    """
    once = (
        chunks.where("chunk_no is not null")
        .groupBy("chunk_no")
        .agg(F.max(F.struct("content", "language", "start_line")).alias("r"))
        .select("chunk_no", "r.content", "r.language", "r.start_line")
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                if r.content is None:
                    continue
                bounded = pd.notna(r.chunk_size)
                cut = pieces(r.content, int(r.chunk_size), int(r.chunk_overlap)) if bounded else [(0, 0, len(r.content))]
                base, line, seen = int(r.start_line) if pd.notna(r.start_line) else None, 0, 0
                for k, (a, own, b) in enumerate(cut):
                    line += r.content.count("\n", seen, a) if a >= seen else -r.content.count("\n", a, seen)
                    seen = a
                    out.append((r.chunk_no, r.language, int(r.chunk_size) if bounded else None, int(r.chunk_overlap), k, len(cut), a, own, b, None if base is None else base + line, r.content[a:b]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"chunk_size": "Int32", "start_line": "Int32"})

    return applicable(once, config).select("chunk_no", "content", "language", "start_line", "chunk_size", "chunk_overlap").mapInPandas(run, PIECES)
