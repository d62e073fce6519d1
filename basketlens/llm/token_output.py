"""Token ids as binary shards: one wavelet matrix per shard.

Documents are sorted into range partitions, encoded, and cut into shards of about
SHARD_TOKENS ids (a shard ends with the document that fills it). The output is a Parquet table
in shared storage with one row per shard: its place (part, shard), the ids and lengths of its documents,
and `tokens`, the compressed wavelet matrix, which by itself answers access, counts and occurrence
lookups. Spark's committer makes a shard appear once however often its task runs.

Encoding splits texts at ASCII white space, which no token of this tokenizer spans (its
pre-tokenizer drops white space). The words of a group of texts become a dictionary and an array of numbers, so that only different words are
looked up, among those already met, or encoded; the ids of all texts are then taken from these by offset.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketlens.llm.tables import column, frugal, narrow, prepared, scratch_path
from basketlens.llm.wavelet import WaveletMatrix

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARD_TOKENS = 1 << 18
# Words whose ids a worker keeps, none longer than CACHED_CHARS: some 200 bytes each. Frequent words come early, so more of them save little.
CACHED_WORDS = 200_000
CACHED_CHARS = 16
# Bytes of a group of texts; longer texts are cut at white space.
PIECE_BYTES = 1 << 21

# New words that are encoded as one text, and how the vocabulary writes a word's end.
JOINED_WORDS = 2000
WORD_END = "</w>"

_SPACE = re.compile(rb"[ \t-\r]")
_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def listed(words: pa.Array) -> list[str]:
    """The words of an array without nulls. By way of an object array, as to_pylist makes a scalar of each word first."""
    return words.to_numpy(zero_copy_only=False).tolist()


class _Known(dict):
    """Numbers of words; -1 for others."""

    def __missing__(self, word: str) -> int:
        return -1


class _Held:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.used = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray, keep: int) -> int:
        """Put values behind those held, and hold the first `keep` of them; the place of the first."""
        at, need = self.used, self.used + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[:at], np.zeros(need - at + need // 4, self.data.dtype)])
        self.data[at:need] = values
        self.used += keep
        return at


class Encoder:
    """Ids of texts, by their different words; bounded memory for words already met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32
        self.reset()
        # Bytes that each id stands for, as its piece is spelt (one character a byte, and a mark at the end of words).
        pieces = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.spelt = np.array([len(p.removesuffix(WORD_END)) for p in pieces], np.int64)

    def reset(self) -> None:
        """Forget all words."""
        # Words met, by number; where their ids begin in `ids`, and how many they are.
        self.known = _Known()
        self.ids, self.start, self.size = _Held(self.kind), _Held(np.int32), _Held(np.int32)

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian integers of self.kind."""
        return b"".join(ids.tobytes() for ids, _ in self.encode_all(pa.array([text.decode()], pa.large_string())))

    def encode_all(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, their number by text) of successive groups of texts, the id `end` after each; a long text makes its own group."""
        texts = texts.fill_null("").cast(pa.large_string())
        if not len(texts):
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            stop = int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1
            if stop > at:
                yield self._group(texts[at:stop], end)
            else:
                stop = at + 1
                pieces = [self._group(pa.array([p], pa.large_binary()).cast(pa.large_string()), None)[0] for p in self._pieces(texts[at].as_buffer().to_pybytes())]
                ids = np.concatenate([*pieces, np.array([] if end is None else [end], self.kind)])
                yield ids, np.array([len(ids)])
            at = stop

    @staticmethod
    def _pieces(text: bytes) -> Iterator[bytes]:
        """A long text, cut at white space."""
        at = 0
        while at < len(text):
            stop = at + PIECE_BYTES
            if stop < len(text):
                found = _SPACE.search(text, stop)
                stop = found.end() if found else len(text)
            yield text[at:stop]
            at = stop

    def _group(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        start, size = self._places(listed(words.dictionary))
        stops = lists.offsets.to_numpy().astype(np.int64)
        stops -= stops[0]
        number = words.indices.to_numpy()
        if end is not None:
            # The end id is one word more, after the last of each text.
            number = np.insert(number, stops[1:], len(start))
            stops = stops + np.arange(len(stops))
            start = np.append(start, np.int32(self._aside(np.array([end], self.kind))))
            size = np.append(size, np.int32(1))
        taken = size[number]
        reached = np.cumsum(taken, dtype=np.int32)
        # Place among the held ids of every id of the group, word by word; a group has far fewer than 2^31.
        place = np.repeat(start[number] - (reached - taken), taken)
        place += np.arange(len(place), dtype=np.int32)
        upto = np.concatenate([[0], reached])[stops]
        return self.ids.data[place], np.diff(upto)

    def _aside(self, ids: np.ndarray) -> int:
        """The place of ids that are needed for this group only; behind those of its new words."""
        at = self.ids.used
        self.ids.used = self.beyond
        place = self.ids.add(ids, 0)
        self.ids.used = at
        return place

    def _places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of different words begin in self.ids, and how many they are."""
        number = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        new = np.flatnonzero(number < 0)
        start, size = self.start.data[number], self.size.data[number]
        self.beyond = self.ids.used
        if len(new):
            short = np.array([len(words[i]) <= CACHED_CHARS for i in new])
            new = np.concatenate([new[short], new[~short]])
            fresh = [words[i] for i in new]
            ids, sizes = self._encoded(fresh)
            # As many as there is room for; once full, what is known stays.
            kept = min(int(short.sum()), max(0, CACHED_WORDS - len(self.known)))
            at = self.ids.add(ids, int(sizes[:kept].sum()))
            self.beyond = at + len(ids)
            begins = (at + np.cumsum(sizes) - sizes).astype(np.int32)
            first = self.start.add(begins, kept)
            self.size.add(sizes, kept)
            self.known.update(zip(fresh[:kept], range(first, first + kept)))
            start[new], size[new] = begins, sizes
        return start, size

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and the number of each.

        Many words are encoded as one text. No id spans two of them, so a word ends where its bytes are spelt
        out; where the spelling does not come out even for each word, they are encoded one by one.
        """
        found: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for i in range(0, len(words), JOINED_WORDS):
            some = words[i : i + JOINED_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum([len(w.encode()) for w in some])
            spelt = np.cumsum(self.spelt[ids])
            last = np.searchsorted(spelt, ends)
            if len(ids) and spelt[-1] == ends[-1] and (spelt[last] == ends).all() and (self.spelt[ids] > 0).all():
                sizes.append(np.diff(last, prepend=-1))
                found.append(ids)
                continue
            codes = [c.ids for c in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes.append(np.array([len(c) for c in codes], np.int64))
            found.append(np.array([x for c in codes for x in c], np.int64))
        return np.concatenate(found).astype(self.kind), np.concatenate(sizes)


def _sharded(path: str, end_id: int, shard_tokens: int, in_place: bool):
    """Shards of rows (doc_id, text) in the order they come; named by their task and number or, in place, by file and first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        part = TaskContext.get().partitionId()
        shard = 0
        now: str | None = None
        row = 0
        ids: list[np.ndarray] = []
        docs: list = []
        lengths: list[int] = []
        held = 0

        def close() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(ids))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([now or ""]),
                    pa.array([part], pa.int64()),
                    pa.array([shard], pa.int64()),
                    pa.array([matrix.n], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([matrix.to_bytes()], pa.binary()),
                ],
                ["file", "part", "shard", "n_tokens", "doc_ids", "lengths", "tokens"],
            )

        for batch in batches:
            at = 0
            for found, sizes in encoder.encode_all(batch.column("text"), end_id):
                stops = np.cumsum(sizes)
                for k, (start, stop) in enumerate(zip(stops - sizes, stops)):
                    if in_place:
                        # Rows that do not follow each other in one file cannot share a shard.
                        here = batch.column("file")[at + k].as_py(), batch.column("row")[at + k].as_py()
                        if here != (now, row + 1) and docs:
                            yield close()
                            ids, docs, lengths, held = [], [], [], 0
                        if not docs:
                            part, shard = batch.column("number")[at + k].as_py(), here[1]
                        now, row = here
                    ids.append(found[start:stop])
                    docs.append(batch.column("doc_id")[at + k].as_py())
                    lengths.append(int(stop - start))
                    held += lengths[-1]
                    if held >= shard_tokens:
                        yield close()
                        ids, docs, lengths, held = [], [], [], 0
                        shard += 1
                at += len(sizes)
        if docs:
            yield close()
        if in_place:
            # The last stage of a pipeline: its workers go on to other things.
            encoder.reset()

    return run


SHARD_SCHEMA = "file string, part long, shard long, n_tokens long, doc_ids array<long>, lengths array<long>, tokens binary"


def write_shards(
    df: DataFrame,
    path: str,
    order: list[Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Write the documents of df, in the given order, as shards below path."""
    prepared(df.sparkSession)
    keys = [c.alias(f"__{i}") for i, c in enumerate(order)]
    rows = df.select(*keys, column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    names = [f"__{i}" for i in range(len(order))]
    dealt = rows.repartitionByRange(*names).sortWithinPartitions(*names, "text")
    shards = dealt.select("doc_id", "text").mapInArrow(
        frugal(_sharded(tokenizer or tokenizer_path(), end_id, shard_tokens, False)), SHARD_SCHEMA
    )
    shards.write.option("compression", "none").parquet(path)


def write_shards_in_place(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Write the documents of df, read from files, in the order in which the rows lie there. Nothing is moved."""
    prepared(df.sparkSession)
    at = df.metadataColumn("_metadata")
    rows = df.select(
        F.regexp_extract(at["file_name"], r"part-(\d+)", 1).cast("long").alias("number"),
        at["file_name"].alias("file"),
        at["row_index"].alias("row"),
        column(id_col).cast("long").alias("doc_id"),
        column(text_col).cast("string").alias("text"),
    )
    shards = rows.mapInArrow(frugal(_sharded(tokenizer or tokenizer_path(), end_id, shard_tokens, True)), SHARD_SCHEMA)
    shards.write.option("compression", "none").parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            part, shard = batch.column("part")[k].as_py(), batch.column("shard")[k].as_py()
            file = batch.column("file")[k].as_py()
            lengths = batch.column("lengths")[k].values.to_numpy()
            ids = WaveletMatrix.from_bytes(batch.column("tokens")[k].as_py()).tokens().astype("<u4")
            stops = np.cumsum(lengths)
            starts = stops - lengths
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * len(lengths), pa.string()),
                    pa.array(np.full(len(lengths), part)),
                    pa.array(np.full(len(lengths), shard)),
                    batch.column("doc_ids")[k].values,
                    pa.array(starts),
                    pa.array(lengths),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, stops)], pa.int64()),
                ],
                ["file", "part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shards below path."""
    shards = prepared(spark).read.schema(SHARD_SCHEMA).parquet(path)
    # A few shards of an Arrow batch each, as a shard's ids are unpacked whole.
    docs = shards.mapInArrow(
        frugal(_digests), "file string, part long, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    sizes = shards.select("file", "part", "shard", "n_tokens")
    earlier = Window.unboundedPreceding
    within = F.sum("n_tokens").over(Window.partitionBy("part", "file").orderBy("shard").rowsBetween(earlier, -1))
    # One row for each partition (or file) of the writing job meets here.
    parts = sizes.groupBy("part", "file").agg(F.sum("n_tokens").alias("all"))
    offset = F.sum("all").over(Window.orderBy("part", "file").rowsBetween(earlier, -1))
    offsets = parts.select("part", "file", F.coalesce(offset, F.lit(0)).alias("offset"))
    starts = (
        sizes.withColumn("within", F.coalesce(within, F.lit(0)))
        .join(offsets, ["part", "file"])
        .select("file", "part", "shard", (F.col("within") + F.col("offset")).alias("before"))
    )
    return docs.join(starts, ["file", "part", "shard"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_output(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write df's documents in ascending id order and return the digests read back from the files.

    (doc_id, start, n_tokens, ids_crc32): a null or empty text is the end id alone. Null ids
    come first, rows that repeat an id lie next to each other in the order of their texts.
    An empty table writes no shard and returns no row. Other columns are not looked at.
    Without `path` the shards go to a new folder below spark.checkpoint.dir.
    """
    path = path or scratch_path(df.sparkSession, "tokens")
    write_shards(df, path, [column(id_col).cast("long")], id_col, text_col)
    return read_digests(df.sparkSession, path)


def token_output_in_file_order(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As token_output, but in the order in which the rows lie in the files df was read from, by the files' part numbers."""
    path = scratch_path(df.sparkSession, "tokens")
    write_shards_in_place(df, path, id_col, text_col)
    return read_digests(df.sparkSession, path)
