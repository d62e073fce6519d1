"""CSV files whose quoted fields hold line breaks, read by many tasks.

A task that starts in the middle of a file cannot know whether it starts inside a quoted field. So the file is read twice.
First every split (Spark's own, as the text source cuts them) reports whether it holds an odd number of quotes;
the exclusive or of all splits before it says whether a split begins inside a field. Then each split cuts its lines into rows: a
line that begins outside quotes starts one. Rows that reach over a split's end leave it as fragments, at most two a split,
which are put together by file; all other rows never leave their task.

Quotes must stand around whole fields and be doubled inside them, as CSV writers do. Rows end with a line feed or with
carriage return and line feed. As Spark's reader does, the first line of a file decides; in files of the second kind such breaks
within fields become line feeds too, all other breaks are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a cut piece is: a whole row, the first piece of a row, a later piece.
WHOLE, FIRST, LATER = 0, 1, 2
_PIECES = "kind int, file string, split long, header boolean, text string"


@dataclass(frozen=True)
class Splits:
    """Where the splits of each file with several of them start, and whether inside a quoted field.

    16 bytes a split, so a few MB for the splits of 100 TB. A file of one split needs no entry: it starts outside.
    `carriage` holds those files whose first line ends with a carriage return.
    """

    starts: dict[str, np.ndarray] = field(default_factory=dict)
    inside: dict[str, np.ndarray] = field(default_factory=dict)
    carriage: set[str] = field(default_factory=set)

    def begins_inside(self, file: str, start: int) -> bool:
        if start == 0:
            return False
        known = self.starts.get(file, np.zeros(0, np.int64))
        at = int(np.searchsorted(known, start))
        if at == len(known) or known[at] != start:
            raise ValueError(f"{file} is split differently now (at byte {start}); read it anew")
        return bool(self.inside[file][at])


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file, split of every line, as the splits hold them."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def quote_parity(lines: DataFrame, quote: str = '"') -> Splits:
    """What `lines` says about its splits, from one aggregate."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    numbered = lines.withColumn("line", F.monotonically_increasing_id())
    odd = numbered.groupBy("file", "split").agg(
        (F.sum(quotes) % 2).alias("odd"), F.min_by(F.col("value").endswith("\r"), "line").alias("carriage")
    )
    # The running exclusive or of a file's splits; one narrow row for each of them.
    of_file = Window.partitionBy("file").orderBy("split")
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    begins = odd.select(
        "file", "split", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        F.first("carriage").over(of_file).alias("carriage"),
    )
    found = begins.filter("split > 0").toArrow().sort_by([("file", "ascending"), ("split", "ascending")])
    out = Splits()
    if found.num_rows:
        files = found["file"].combine_chunks().dictionary_encode()
        starts, inside = found["split"].to_numpy(), found["inside"].to_numpy(zero_copy_only=False)
        number = files.indices.to_numpy()
        out.carriage.update(found.filter(found["carriage"])["file"].unique().to_pylist())
        for i, name in enumerate(files.dictionary.to_pylist()):
            out.starts[name], out.inside[name] = starts[number == i], inside[number == i]
    return out


class _Cutter:
    """Cuts the lines of one split, batch after batch."""

    def __init__(self, file: str, split: int, splits: Splits, quote: str):
        self.file, self.split, self.quote = file, split, quote
        self.inside = inside = splits.begins_inside(file, split)
        # Unknown until the first line is seen, unless the file has more splits.
        self.carriage = None if split == 0 else file in splits.carriage
        # The piece that is still open: its lines, and whether it began before this split.
        self.open: list[str] = []
        self.later = inside
        self.header = split == 0

    def _piece(self, kind: int, text: str, header: bool) -> tuple:
        return kind, self.file, self.split, header, text

    def _is_header(self) -> bool:
        """The first row of a file; asked for each row until it was found."""
        first, self.header = self.header, False
        return first

    def lines(self, values: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.carriage is None:
            self.carriage = values[0].as_py().endswith("\r")
        if self.carriage:
            values = pc.replace_substring_regex(values, "\r$", "")
        quotes = pc.count_substring(values, self.quote).to_numpy(zero_copy_only=False)
        ends = (np.cumsum(quotes) + self.inside) % 2 == 1
        begins = np.empty(len(ends), bool)
        begins[0], begins[1:] = self.inside, ends[:-1]
        starts = np.flatnonzero(~begins)
        self.inside = bool(ends[-1])
        # Lines up to the first start belong to the open piece.
        head = int(starts[0]) if len(starts) else len(values)
        self.open += values[:head].to_pylist()
        pieces = []
        if len(starts) and self.open:
            pieces.append(self._close())
        # The last row may go on in the next batch if a field is open at the end.
        stop = len(values)
        if len(starts) and self.inside:
            stop = int(starts[-1])
            self.open, self.later = values[stop:].to_pylist(), False
            starts = starts[:-1]
        if head and not len(starts) and not self.inside and self.open:
            pieces.append(self._close())
        rows = self._rows(values, starts, stop)
        if pieces:
            yield _batch(pieces)
        if rows is not None:
            yield rows

    def _rows(self, values: pa.Array, starts: np.ndarray, stop: int) -> pa.RecordBatch | None:
        if not len(starts):
            return None
        first = int(starts[0])
        offsets = pa.array(np.append(starts, stop) - first, pa.int32())
        text = pc.binary_join(pa.ListArray.from_arrays(offsets, values[first:stop].cast(pa.string())), "\n")
        text = text.filter(pc.not_equal(text, ""))
        n = len(text)
        if not n:
            return None
        header = np.zeros(n, bool)
        header[0] = self._is_header()
        columns = [pa.array(np.full(n, WHOLE, np.int32)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(header), text]
        return pa.RecordBatch.from_arrays(columns, _names())

    def _close(self, ended: bool = True) -> tuple:
        """The open piece as a row: whole if it began here and has ended."""
        text, self.open = "\n".join(self.open), []
        kind = LATER if self.later else WHOLE if ended else FIRST
        self.later = False
        return self._piece(kind, text, kind != LATER and self._is_header())

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield _batch([self._close(ended=False)])


def _names() -> list[str]:
    return [c.split()[0] for c in _PIECES.split(", ")]


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces), types)], _names())


def cut(lines: DataFrame, splits: Splits, quote: str = '"') -> DataFrame:
    """kind, file, split, header, text of the pieces of rows, as the splits hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Cutter | None = None
        for batch in batches:
            values, file, split = batch.columns
            if not batch.num_rows:
                continue
            place = split.to_numpy()
            # A task reads its splits one after the other; file names are compared where the start repeats.
            names = file.dictionary_encode()
            change = (np.diff(place) != 0) | (np.diff(names.indices.to_numpy()) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                here = file[a].as_py(), int(place[a])
                if now is None or (now.file, now.split) != here:
                    if now is not None:
                        yield from now.rest()
                    now = _Cutter(*here, splits, quote)
                yield from now.lines(values[a:b])
        if now is not None:
            yield from now.rest()

    return lines.mapInArrow(run, _PIECES)


def csv_rows(spark: SparkSession, path: str | list[str], quote: str = '"') -> DataFrame:
    """text of every row of the files but their headers. Looks at the files' quotes when called."""
    lines = text_lines(spark, path)
    pieces = cut(lines, quote_parity(lines, quote), quote)
    whole = pieces.filter((F.col("kind") == WHOLE) & ~F.col("header")).select("text")
    # At most two fragments a split: number the rows they belong to within a file, and join them in order.
    parts = pieces.filter(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("split", F.desc("kind"))
    numbered = parts.withColumn("row", F.sum((F.col("kind") == FIRST).cast("int")).over(order))
    joined = numbered.groupBy("file", "row").agg(
        F.max("header").alias("header"), F.sort_array(F.collect_list(F.struct("split", "text"))).alias("parts")
    )
    text = F.array_join(F.col("parts.text"), "\n")
    stitched = joined.filter(~F.col("header")).select(text.alias("text"))
    return whole.union(stitched)


def read_quoted_csv(spark: SparkSession, path: str | list[str], names: list[str]) -> DataFrame:
    """The files' rows as text columns `names`, as one task reading each whole file would give them (in any order)."""
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    return csv_rows(spark, path).select(F.from_csv("text", schema, options).alias("row")).select("row.*")
