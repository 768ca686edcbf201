"""Token counts by section: encode a document once, place its tokens in the text, join them to sections.

The document of a row is the text of its fields, joined by a line feed.  A section is a line of a field with
the line feed that ends it.  The token spans (running sums of token widths) are joined to the section spans
as sorted intervals.  A token over a boundary goes, by ``rule``, to the section with the largest part of
its bytes (``"largest"``, the earlier one on a tie), to that of its first byte (``"first"``) or of its last one
(``"last"``).  The counts of a document's sections add up to its number of tokens.

Results for odd input: null fields are empty; a document without text has one section without tokens; repeated
rows give repeated sections; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.tokens import encoder, vocabulary_files

RULES = ("largest", "first", "last")


def allocate(widths: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section and, of these, tokens that crossed a boundary.

    ``bounds``: start of every section and the end of the last, in bytes.
    """
    sections = len(bounds) - 1
    ends = np.cumsum(widths)
    starts = ends - widths
    inner = bounds[1:-1]
    first = np.searchsorted(inner, starts, "right")
    last = np.searchsorted(inner, ends - 1, "right")
    owner = last.copy() if rule == "last" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "largest":
        for t in crossing.tolist():
            inside = np.arange(first[t], last[t] + 1)
            part = np.minimum(bounds[inside + 1], ends[t]) - np.maximum(bounds[inside], starts[t])
            owner[t] = inside[np.argmax(part)]
    return np.bincount(owner, minlength=sections), np.bincount(owner[crossing], minlength=sections)


def count_tokens(
    docs: DataFrame,
    key: str = "doc_id",
    fields: tuple[str, ...] = ("text",),
    rule: str = "largest",
    files: tuple[str, str] | None = None,
) -> DataFrame:
    """Per section: ``key``, field, section, start_char, end_char, n_tokens, n_crossing.  No shuffle."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    files = files or vocabulary_files()
    texts = docs.select(
        F.col(key).alias("key"),
        *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"field{i}") for i, f in enumerate(fields)),
    )
    width = len(fields)

    def sections(batches):
        coder = encoder(files)
        names = np.array(fields, dtype=object)
        for batch in batches:
            rows, field, number, start, end, tokens, crossing = [], [], [], [], [], [], []
            columns = [batch.column(f"field{i}").to_pylist() for i in range(width)]
            wholes = ["\n".join(parts) for parts in zip(*columns, strict=True)]
            for row, whole in enumerate(wholes):
                raw = np.frombuffer(whole.encode(), np.uint8)
                chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                lines = np.flatnonzero(raw[:-1] == 10) + 1 if len(raw) else np.zeros(0, np.int64)
                bounds = np.concatenate(([0], lines, [len(raw)]))
                owner = np.zeros(len(bounds) - 1, np.int64)
                if width > 1:
                    sizes = np.cumsum([len(c[row].encode()) + 1 for c in columns[:-1]])
                    bounds = np.unique(np.concatenate((bounds, np.minimum(sizes, len(raw)))))
                    bounds = bounds if len(bounds) > 1 else np.array([0, len(raw)])
                    owner = np.searchsorted(sizes, bounds[:-1], "right")
                widths = coder.widths[coder.ids(whole)]
                own, over = allocate(widths, bounds, rule)
                n = len(own)
                rows.append(np.full(n, row))
                field.append(names[owner])
                number.append(np.arange(n))
                start.append(chars[bounds[:-1]])
                end.append(chars[bounds[1:]])
                tokens.append(own)
                crossing.append(over)
            if not rows:
                continue
            flat = [np.concatenate(x) for x in (rows, field, number, start, end, tokens, crossing)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(flat[0], pa.int64())),
                    pa.array(flat[1], pa.string()),
                    *(pa.array(x.astype(np.int64)) for x in flat[2:]),
                ],
                names=["key", "field", "section", "start_char", "end_char", "n_tokens", "n_crossing"],
            )

    kind = dict(texts.dtypes)["key"]
    schema = (
        f"key {kind}, field string, section bigint, start_char bigint, end_char bigint, "
        "n_tokens bigint, n_crossing bigint"
    )
    return texts.mapInArrow(sections, schema).withColumnRenamed("key", key)
