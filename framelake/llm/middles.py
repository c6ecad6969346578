"""Fill-in-the-middle transformation over code points.

Each text is decoded to a UTF-32 numpy array. Neighbouring classes (white space or not) are compared, and flatnonzero of
where a word ends gives the boundaries of units (`[white]*[word]+`, or white space at the end). Two ranks, drawn from a
hash of the row's key, index the boundaries; the three slices are encoded again and put together around markers:

    psm: <P>prefix<S>suffix<M>middle        spm: <S>suffix<P>prefix<M>middle        plain: the text

`restored` rebuilds the text from output and form alone. Markers occur once each in an output, as texts that hold one stay
plain, and no cut between code points makes a new one.

Defined cases: a null or empty text has no units and is plain; a text of white space only is one unit; a text that holds a
marker is plain, as is one that the draw leaves so; texts are taken whole, a very long one in a block of its own; a null
key is drawn for as the empty string; rows that repeat a key are drawn for alike; an empty table gives an empty result;
other columns come along unchanged in `row`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B

#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 of these so many in the order spm.
RATE, SPM = 50, 80
#: Bytes of text worked on at once.
BLOCK = 1 << 20
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where units start and end: 0, the end of each word, and the end of the text; [0] for an empty one."""
    white = B.WHITE[np.minimum(points, 128)]
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    return np.concatenate([[0], ends, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def draws(key: str, seed: int) -> list[int]:
    """Four numbers of 32 bits for a key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def cut(text: str, key: str, seed: int = 42, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), output."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = boundaries(points)
    n = len(at) - 1
    h1, h2, h3, h4 = draws(key, seed)
    if not n or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, z = at[sorted((h1 % (n + 1), h2 % (n + 1)))]
    prefix, middle, suffix = (points[i:j].tobytes().decode("utf-32-le") for i, j in ((0, a), (a, z), (z, len(points))))
    if h4 % 100 < spm:
        return n, "spm", int(a), int(z - a), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", int(a), int(z - a), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = RATE, spm: int = SPM, carry: list[str] | None = None) -> DataFrame:
    """For each row: row (a struct of its columns, or of those to carry), n, form, prefix_chars, middle_chars, output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks(batches, "text", BLOCK):
            data, offsets = B.buffers(block.column("text"))
            raw, ends = memoryview(np.ascontiguousarray(data)), offsets.tolist()
            made = [cut(str(raw[a:z], "utf-8", "replace"), k, seed, rate, spm) for a, z, k in zip(ends, ends[1:], block.column("key").to_pylist(), strict=False)]
            columns = list(zip(*made, strict=True)) if made else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([block.column("row"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    row = F.struct(*[F.col(f"`{c}`") for c in (df.columns if carry is None else carry)]).alias("row")
    rows = df.select(row, F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *T.StructType.fromDDL(MADE)]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    head, tail = F.split_part(output, F.lit(MIDDLE), F.lit(1)), F.split_part(output, F.lit(MIDDLE), F.lit(2))
    first, second = (F.when(form == "psm", F.lit(m)).otherwise(F.lit(o)) for m, o in ((PREFIX, SUFFIX), (SUFFIX, PREFIX)))
    one, two = F.split_part(F.split_part(head, first, F.lit(2)), second, F.lit(1)), F.split_part(head, second, F.lit(2))
    prefix, suffix = F.when(form == "psm", one).otherwise(two), F.when(form == "psm", two).otherwise(one)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, tail, suffix))
