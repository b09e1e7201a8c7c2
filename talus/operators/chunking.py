"""Chunks of texts, token counts and prompts.

Where a chunk's start depends on where the one before ended, a text's cuts are
found in one pass over its row, in time and memory linear in the text and what
is cut from it. The chunkers give the columns of the table without the text,
then those of the chunk; columns of these names are replaced.

Defined cases: a null or empty text has no chunks by size or structure, and an
empty table no rows; repeated rows each have theirs.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.functions.text import token_estimate, word_tokens

SIZE, OVERLAP = 1000, 200


def fixed_chunks(table: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """One row per chunk: chunk_index from 0, total_chunks, content. An empty or null text has none."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.char_length(text) - 1, F.lit(step))
    some = table.where(F.char_length(text) > 0).withColumn("_s", starts)
    out = some.select("*", F.size("_s").alias("total_chunks"), F.posexplode("_s").alias("chunk_index", "_p"))
    return out.withColumn("content", F.substring(F.col(text), F.col("_p") + 1, F.lit(size))).drop("_s", "_p", text)


#: Lines repeated at the start of the next chunk; sizes in characters of a chunk of lines and of a text that is kept whole.
OVERLAP_LINES, LINE_SIZE, WHOLE_SIZE = 50, 4000, 8000
_HELD = 4 << 20


def _cut_rows(table: DataFrame, text: str, ddl: str, cut: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """table without its text, with a row for each tuple that cut gives for the text; total_chunks counts them."""
    fields = T.StructType.fromDDL(ddl).fields
    names = [f.name for f in fields]
    kept = table.select(*(c for c in table.columns if c not in (text, *names)), F.col(text).cast("string").alias("_text"))
    schema = T.StructType(kept.schema.fields[:-1] + fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            own = b.schema.get_field_index("_text")
            rest = pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != own], names=[n for i, n in enumerate(b.schema.names) if i != own]) if b.num_columns > 1 else None
            at, rows, held = [], [], 0

            def batch():
                columns = [*(rest.take(pa.array(at, pa.int64())).columns if rest is not None else ()), *map(list, zip(*rows, strict=True))]
                return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)  # noqa: B023

            for i, x in enumerate(b.column(own)):
                found = list(cut(x.as_py() or ""))
                for k, row in enumerate(found):
                    at.append(i)
                    rows.append((k, len(found), *row))
                    held += len(row[-1]) + 32
                    if held >= _HELD:
                        yield batch()
                        at, rows, held = [], [], 0
            if rows:
                yield batch()

    return kept.mapInArrow(run, schema)


def line_cuts(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, content) of chunks of whole lines: a chunk ends before the line that would pass size, and repeats up to overlap lines of the one before."""
    feeds = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10)
    # where each line begins, the end counted as a line feed
    start = np.r_[0, feeds + 1, len(text) + 1]
    n, a, b = len(start) - 1, 0, 0
    while b < n:
        b = max(b + 1, int(np.searchsorted(start, start[a] + size, side="right")) - 1)
        yield a + 1, b, text[start[a] : start[b] - 1]
        a = b - min(overlap, b - a)


def line_chunks(table: DataFrame, size: int = LINE_SIZE, overlap: int = OVERLAP_LINES, text: str = "text") -> DataFrame:
    """chunk_index, total_chunks, start_line, end_line, content: whole lines up to size characters, or one longer line; a null or empty text is one empty line."""
    return _cut_rows(table, text, "chunk_index int, total_chunks int, start_line int, end_line int, content string", lambda t: line_cuts(t, size, overlap))


def review_chunks(table: DataFrame, whole: int = WHOLE_SIZE, overlap: int = OVERLAP_LINES, text: str = "text") -> DataFrame:
    """As line_chunks: a text of up to `whole` characters is one chunk, a longer one is cut in chunks of half of that."""
    cut = lambda t: [(1, t.count("\n") + 1, t)] if len(t) <= whole else line_cuts(t, whole // 2, overlap)
    return _cut_rows(table, text, "chunk_index int, total_chunks int, start_line int, end_line int, content string", cut)


def newline_cuts(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, content) of chunks of size characters that end after their last line feed, if that lies past their half; the last one ends with the text."""
    a, n = 0, len(text)
    while a < n:
        b = min(a + size, n)
        if b < n and (feed := text.rfind("\n", a, b)) > a + size // 2:
            b = feed + 1
        yield a, text[a:b]
        if b == n:
            return
        a = max(b - overlap, a + 1)


def newline_chunks(table: DataFrame, size: int = 0, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """chunk_index, total_chunks, start (from 0), content; without a size it follows from the text's bytes."""
    by_bytes = lambda n: min(SIZE, 2048) if n > 5 << 20 else min(SIZE, 4096) if n > 1 << 20 else SIZE
    cut = lambda t: newline_cuts(t, size or by_bytes(len(t.encode())), overlap)
    return _cut_rows(table, text, "chunk_index int, total_chunks int, start long, content string", cut)


def structure_spans(text: str) -> Iterator[tuple[str, str, str, str]]:
    """(kind, name, before, own) of each top-level node of a Python source: the stripped text before its line, and its own; at last kind None with what follows."""
    tree = ast.parse(text)
    lines = text.splitlines(keepends=True)
    begins = np.r_[0, np.cumsum([len(x) for x in lines])].astype(int)
    at = 0
    for node in tree.body:
        start = int(begins[node.lineno - 1])
        before = text[at:start].strip() if start > at else ""
        yield type(node).__name__, getattr(node, "name", "[Unnamed]"), before, (ast.get_source_segment(text, node, padded=True) or "").strip()
        at = int(begins[min(node.end_lineno, len(lines))])
    yield None, None, text[at:].strip(), ""


def structure_cuts(text: str, size: int, overlap: int) -> Iterator[tuple[str]]:
    """Top-level nodes and what lies between them; what is longer than size is cut in fixed chunks, a node's between two marks."""
    step = max(1, size - overlap)
    fixed = lambda x: ([(x[a : a + size],) for a in range(0, len(x), step)] if len(x) > size else [(x,)] if x else [])
    try:
        spans = list(structure_spans(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        yield from ((text[a : a + size],) for a in range(0, len(text), step))
        return
    for kind, name, before, own in spans:
        yield from fixed(before)
        if len(own) > size:
            yield (f"# --- Start of large {kind}: {name} ---",)
            yield from fixed(own)
            yield (f"# --- End of large {kind}: {name} ---",)
        elif own:
            yield (own,)


def structure_chunks(table: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """chunk_index, total_chunks, content of Python sources; one that doesn't parse is cut in fixed chunks."""
    return _cut_rows(table, text, "chunk_index int, total_chunks int, content string", lambda t: structure_cuts(t, size, overlap))


def chat_prompts(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, prompt: the turns in order, each headed by its role."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    got = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    return got.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("prompt"))


def token_usage(turns: DataFrame) -> DataFrame:
    """Prompt and completion tokens of each conversation, as word counts, and their estimate by length."""
    reply = F.coalesce(F.col("role") == "assistant", F.lit(False))
    w = word_tokens(F.col("text"))
    total = lambda c: F.sum(F.when(c, w).otherwise(0))
    return turns.groupBy("conv_id").agg(total(~reply).alias("prompt_tokens"), total(reply).alias("completion_tokens"), F.sum(w).alias("total_tokens"), F.sum(token_estimate(F.col("text"))).alias("estimated_tokens"))
