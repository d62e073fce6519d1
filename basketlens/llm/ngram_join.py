"""N-gram Jaccard join by parity sketches.

1. A text's distinct word shingles are XOR-hashed into a parity sketch: each shingle flips
   one bit. Two sketches differ in no more bits than the sets differ in elements, so their
   Hamming distance is a lower bound of the symmetric difference.
2. Texts of one size band share a sketch layout of `most + 1 + slack` chunks, where `most`
   is the largest symmetric difference two linked texts of the band can have. A linked
   pair then agrees on at least slack + 1 whole chunks (pigeonhole). The smaller text of a
   pair may lie in the band below, so texts near a band's upper end join the next one too.
   A chunk is known by the XOR of the shingles' hashes in it, as if it had 2^64 bits, and is the text's key.
3. A pair agrees on more than `slack` keys, so each text may leave out the `slack` first of its keys in any order
   that is the same for all texts, and the pair still meets in one. The order: empty chunks, then keys
   by the number of texts that hold them, most first. A passage that many texts share makes keys that many texts
   share, and these are the ones left out.
4. Texts that share a key that is left to both are compared with the first text of the key: by a second parity sketch, as
   wide as the set, then exactly. What links is put together (components). Where the texts of a key are then of several classes,
   those outside its largest class are compared with all texts of the key that are of other classes than they: up to HEADS of them
   as pairs, which many keys have in common and are compared once; more of them in blocks of bounded size,
   which links leave as a spanning forest. So a key of many near copies costs as many comparisons as it has texts. Equal sets
   are one text from the start.

Keys travel packed, many to a row, and are matched within parts of the key space; a part keeps one text per key, so its memory
does not depend on how many texts share it, and passes on only the texts of keys that several texts hold.
Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.components import components, merged
from basketlens.llm.tables import column, forget, frugal, narrow, prepared, written
from basketlens.llm.words import Words, joined, mix, words
from basketlens.operators.keyfilter import MOST_KEYS, key_words, may_have_partner, with_partner

BAND = 1.5
# Rows and bytes of a block of texts that are compared with all others of their key.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
# Texts outside the largest class of a key that are compared pair by pair.
HEADS = 16
PART_KEYS = 500_000
HELD_KEYS = 500_000
# Names of sets whose keys a task remembers to have sent.
SENT = 200_000


def distance_limit(total: int, percent: int) -> int:
    """Largest symmetric difference of two linked sets with `total` elements together.

    100 * inter >= percent * union with inter = (total - d) / 2 and union = (total + d) / 2.
    """
    return total * (100 - percent) // (100 + percent)


def band_of(n: int) -> int:
    return int(math.log(n) / math.log(BAND) + 1e-9)


def band_top(band: int) -> int:
    """Largest size in the band."""
    return max(k for k in range(int(BAND ** (band + 1)) + 2) if k == 0 or band_of(k) <= band)


def parity(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """Parity sketch: n_words 64-bit words, in which each hash flips one bit."""
    sketch = np.zeros(n_words, np.uint64)
    if len(hashes):
        at = hashes % np.uint64(n_words)
        bit = np.uint64(1) << (hashes >> np.uint64(58))
        order = np.argsort(at, kind="stable")
        at, bit = at[order], bit[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        sketch[at[first]] = np.bitwise_xor.reduceat(bit, first)
    return sketch


class Layouts:
    """Sketch layouts by band, worked out once."""

    def __init__(self, percent: int):
        self.percent = percent
        self.known: dict[int, tuple[int, int, int]] = {}

    def of(self, band: int) -> tuple[int, int, int]:
        """Largest difference, slack, words of the whole sketch."""
        if band not in self.known:
            top = band_top(band)
            most = distance_limit(2 * top, self.percent)
            self.known[band] = most, max(2, most // 2), max(4, -(-top * 3 // 128))
        return self.known[band]

    def bands(self, n: int) -> list[int]:
        """The text's own band, and the next one if a partner there is close enough."""
        if n == 0:
            return []
        own = band_of(n)
        largest = n * 100 // self.percent
        return [b for b in (own, own + 1) if band_of(largest) >= b and self.of(b)[0] > 0]

    def _chunks(self, hashes: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Salted hashes, the chunk of each, and the number of chunks."""
        most, slack, _ = self.of(band)
        salt = np.full(1, band * 2654435761 + 1, np.uint64)
        salted = mix(hashes ^ mix(salt)[0])
        return salted, salted % np.uint64(most + 1 + slack), most + 1 + slack

    def spare(self, hashes: np.ndarray, band: int) -> int:
        """How many of its keys a text may leave out besides the empty chunks that `keys` leaves out."""
        _, at, count = self._chunks(hashes, band)
        return max(0, self.of(band)[1] - (count - len(np.unique(at))))

    def keys(self, hashes: np.ndarray, band: int) -> np.ndarray:
        """Keys of the chunks, without the first `slack` empty ones."""
        salted, at, count = self._chunks(hashes, band)
        slack = self.of(band)[1]
        order = np.argsort(at, kind="stable")
        at, salted = at[order], salted[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        names = mix(np.arange(count, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(band * 2654435761 + 1))
        keys = mix(names[at[first]] ^ mix(np.bitwise_xor.reduceat(salted, first)))
        if count - len(first) <= slack:
            return keys
        bare = np.setdiff1d(np.arange(count), at[first].astype(np.int64), assume_unique=True)
        return np.concatenate([keys, names[bare[slack:]]])


def mark_of(hashes: np.ndarray, salt: int) -> int:
    return int(mix(hashes ^ np.uint64(salt)).sum()) if len(hashes) else 0


def slot_of(mark: int, band: int) -> int:
    """Name of a set in a band."""
    return int(mix(np.array([(mark + band * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])


def shingle_sets(part: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, no words are none."""
    at = part.bounds()
    runs = joined(part.hash, size)
    out = []
    for t in range(part.texts):
        first, last = at[t], at[t + 1]
        if last - first >= size:
            out.append(np.unique(runs[first : last - size + 1]))
        else:
            out.append(joined(part.hash[first:last], int(last - first), salt=1)[: 1 if last > first else 0])
    return out


def _binary(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _marked(size: int, percent: int):
    """Per text: size of its set, a 128-bit fingerprint of it, and for each of its bands a sketch and the keys it may leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(percent)
        for batch in batches:
            for part in words(batch.column("text")):
                sets = shingle_sets(part, size)
                marks = [mark_of(s, 11) for s in sets]
                bands = [layouts.bands(len(s)) for s in sets]
                offsets = pa.array(np.cumsum([0, *map(len, bands)]).astype(np.int32))
                spares = [layouts.spare(s, b) for s, own in zip(sets, bands) for b in own]
                slots = _signed([slot_of(m, b) for m, own in zip(marks, bands) for b in own])
                sketches = _binary([parity(s, layouts.of(b)[2]) for s, own in zip(sets, bands) for b in own])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.first, part.texts),
                        pa.array([len(s) for s in sets], pa.int64()),
                        _signed(marks),
                        _signed([mark_of(s, 23) for s in sets]),
                        pa.ListArray.from_arrays(offsets, slots),
                        pa.ListArray.from_arrays(offsets, sketches),
                        pa.ListArray.from_arrays(offsets, pa.array(spares, pa.int32())),
                    ],
                    ["doc_id", "n_shingles", "mark", "mark2", "slots", "sketches", "spares"],
                )

    return run


def _packed(size: int, percent: int, parts: int):
    """Chunk keys of many texts by part of the key space: 32 bits of the key and the text's slot; equal sets of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(percent)
        sent: set[int] = set()
        for batch in batches:
            own, slots = [], []
            for part in words(batch.column("text")):
                for s in shingle_sets(part, size):
                    mark = mark_of(s, 11)
                    for band in layouts.bands(len(s)):
                        slot = slot_of(mark, band)
                        if slot not in sent:
                            sent.add(slot)
                            own.append(layouts.keys(s, band))
                            slots.append(slot)
            if len(sent) > SENT:
                sent.clear()
            if not own:
                continue
            key = np.concatenate(own)
            slot = np.repeat(np.array(slots, np.uint64), [len(k) for k in own])
            home = ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            at = np.searchsorted(home[order], np.arange(parts + 1))
            key, slot = key[order].astype(np.uint32), slot[order]
            full = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full),
                    _binary([key[at[p] : at[p + 1]] for p in full]),
                    _binary([slot[at[p] : at[p + 1]] for p in full]),
                ],
                ["part", "keys", "slots"],
            )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part -> (key, slot) of the keys that several slots hold; a pair may come again."""
    held_key, held_slot, held_sent = np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, bool)
    new_keys: list[np.ndarray] = []
    new_slots: list[np.ndarray] = []
    waiting, now = 0, None

    def settle() -> pa.RecordBatch | None:
        """Send what is known to be shared; of each key stays the first slot, and whether it was sent."""
        nonlocal held_key, held_slot, held_sent, waiting
        if not waiting:
            return None
        key = np.concatenate([held_key, *new_keys])
        slot = np.concatenate([held_slot, *new_slots])
        late = np.arange(len(key)) >= len(held_key)
        order = np.lexsort((slot, late, key))
        key, slot, late = key[order], slot[order], late[order]
        sent = np.zeros(len(key), bool)
        sent[~late] = held_sent[order[~late]]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        other = slot != slot[first][group]
        shared = np.zeros(len(first), bool)
        shared[group[other]] = True
        out = other.copy()
        out[first] = shared & ~sent[first]
        held_key, held_slot, held_sent = key[first], slot[first], sent[first] | shared
        new_keys.clear()
        new_slots.clear()
        waiting = 0
        if not out.any():
            return None
        whole = (np.int64(now) << np.int64(32)) | key[out].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(whole), pa.array(slot[out].view(np.int64))], ["key", "slot"])

    for batch in batches:
        for k, part in enumerate(batch.column("part").to_pylist()):
            if part != now:
                if (out := settle()) is not None:
                    yield out
                held_key, held_slot, held_sent, now = held_key[:0], held_slot[:0], held_sent[:0], part
            new_keys.append(np.frombuffer(batch.column("keys")[k].as_py(), np.uint32))
            new_slots.append(np.frombuffer(batch.column("slots")[k].as_py(), np.uint64))
            waiting += len(new_keys[-1])
            if waiting > HELD_KEYS:
                if (out := settle()) is not None:
                    yield out
    if (out := settle()) is not None:
        yield out


def shared_keys(texts: DataFrame, size: int, percent: int, expected: int) -> DataFrame:
    """(key, slot) of all keys that several different sets hold, of some `expected` keys; a written table."""
    parts = max(8, -(-expected // PART_KEYS))
    packed = texts.select("text").mapInArrow(frugal(_packed(size, percent, parts)), "part long, keys binary, slots binary")
    rows = packed.repartition("part").sortWithinPartitions("part").mapInArrow(frugal(_shared), "key long, slot long")
    return written(rows.distinct(), "shared-keys")


def rare_keys(shared: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, slot, node) without the `spare` most frequent keys of each slot; a written table.

    Keys that nobody shares come last in the order of frequency, so leaving them out of `shared` changes nothing.
    """
    counts = written(shared.groupBy("key").agg(F.count("*").alias("texts")), "key-counts")
    listed = shared.join(counts, "key").join(entries.select("slot", "node", "spare"), "slot")
    # A slot has as many rows as its text has chunks at most.
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("texts"), "key"))
    out = written(listed.withColumn("place", place).where("place > spare").select("key", "slot", "node"), "keys")
    forget(counts)
    return out


def _near(percent: int):
    """Pairs (a, b, their sizes and sketches) whose sketches do not rule a link out -> (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketches = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64) for c in ("held_a", "held_b")]
            ends = np.cumsum([len(x) // 8 for x in batch.column("held_a").to_pylist()])
            differing = np.cumsum(np.r_[0, np.bitwise_count(sketches[0] ^ sketches[1]).astype(np.int64)])
            distance = differing[ends] - differing[np.r_[0, ends[:-1]]]
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            close = distance <= total * (100 - percent) // (100 + percent)
            yield batch.select(["a", "b"]).filter(pa.array(close))

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets (distinct hashes) link."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _linked(percent: int):
    """Pairs (a, b, their sets) -> the linked ones (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c) for c in ("held_a", "held_b"))
            keep = [
                linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                for x, y in zip(left, right)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(size: int):
    """(node, text) -> (node, held): the text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words(batch.column("text")):
                sets = shingle_sets(part, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(part.first, part.texts), _binary(sets)], ["node", "held"]
                )

    return run


def _pairs_with(pairs: DataFrame, sides: DataFrame, on: str, *columns: str) -> DataFrame:
    """pairs with the columns of both ends, as <column>_a and <column>_b; `on` names the ends' column of `sides`."""
    for end in ("a", "b"):
        side = sides.select(F.col(on).alias(f"__{end}"), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        pairs = pairs.join(side, F.col(end) == F.col(f"__{end}")).drop(f"__{end}")
    return pairs


def head_pairs(keys: DataFrame) -> DataFrame:
    """(a, b): slots that share a key, a being the first of the key's texts."""
    first = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("slot").alias("a"))).alias("first")
    heads = keys.groupBy("key").agg(first, F.count("*").alias("texts")).where("texts > 1").select("key", "first.a")
    heads = written(heads, "heads")
    out = written(keys.join(heads, "key").where("slot <> a").select("a", F.col("slot").alias("b")).distinct(), "pairs")
    forget(heads)
    return out


def sets_of(pairs: DataFrame, entries: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(node, held): the sets of all texts that occur in pairs of slots; a written table.

    Only these texts are moved; which they are is known to a filter of bounded size, if they are not too many for it.
    """
    slots = pairs.select("a").union(pairs.select("b")).distinct()
    nodes = written(entries.join(slots, F.col("slot") == F.col("a")).select("node").distinct(), "nodes")
    count = nodes.count()
    if count <= MOST_KEYS:
        texts = with_partner(texts, "doc_id", *key_words(nodes, "node", count))
    wanted = texts.join(nodes, F.col("doc_id") == F.col("node")).select("node", "text")
    # An id whose rows hold several sets has a row for each; it links if any of them does.
    sets = written(wanted.mapInArrow(frugal(_sets(size)), "node long, held binary"), "sets")
    forget(nodes)
    return sets


def links_of(pairs: DataFrame, entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b, nodes) among pairs of slots; a written table."""
    near = _pairs_with(pairs, entries, "slot", "node", "n", "held")
    # Keys travel as 32 bits within their part, so now and then two of different bands fall together.
    near = near.where(F.octet_length("held_a") == F.octet_length("held_b"))
    near = near.drop("a", "b").withColumnsRenamed({"node_a": "a", "node_b": "b"})
    near = near.mapInArrow(frugal(_near(percent)), "a long, b long").distinct()
    links = _pairs_with(near, sets, "node", "held").mapInArrow(frugal(_linked(percent)), "a long, b long")
    return written(links.distinct(), "links")


def _rest(percent: int):
    """Rows sorted by (key, block, other) -> links (a, b): the block's own rows (other 0) against all that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        own: list[tuple[int, int, np.ndarray]] = []
        sizes = sketch = None
        width = 0
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            found = []
            for key, block, other, node, label, held in zip(*(batch.column(c) for c in ("key", "block", "other", "node", "label", "held"))):
                here = key.as_py(), block.as_py()
                if here != now:
                    now, own, sketch = here, [], None
                    parent.clear()
                row = node.as_py(), label.as_py(), np.frombuffer(held.as_py(), np.uint64)
                if not other.as_py():
                    own.append(row)
                    continue
                if not own:
                    continue
                if sketch is None:
                    sizes = np.array([len(h) for *_, h in own])
                    width = max(4, int(sizes.max()) // 16)
                    sketch = np.stack([parity(h, width) for *_, h in own])
                n = len(row[2])
                total = sizes + n
                near = np.bitwise_count(sketch ^ parity(row[2], width)).sum(axis=1) <= total * (100 - percent) // (100 + percent)
                near &= (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
                for i in np.flatnonzero(near):
                    a, b = root(own[i][1]), root(row[1])
                    if a != b and linked(own[i][2], row[2], percent):
                        parent[b] = a
                        found.append((own[i][0], row[0]))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def mixed_keys(keys: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, slot, node, label, main, others) of the texts of keys with several classes (node, component) so far; a written table.

    `main` is the key's largest class, `others` the number of texts outside it.
    """
    labelled = keys.join(classes, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    labelled = written(labelled, "labelled")
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("texts"))
    kept = counts.groupBy("key").agg(
        F.max_by("label", F.struct("texts", "label")).alias("main"),
        (F.sum("texts") - F.max("texts")).alias("others"),
        F.count("*").alias("labels"),
    )
    kept = written(kept.where("labels > 1").drop("labels"), "mixed-keys")
    out = written(labelled.join(kept, "key"), "mixed")
    forget(labelled, kept)
    return out


def other_pairs(mixed: DataFrame) -> DataFrame:
    """(a, b): slots of a key that are of different classes, one outside the largest; keys with at most HEADS such texts."""
    few = mixed.where(F.col("others") <= HEADS)
    heads = few.where("label <> main").select(F.col("key").alias("of"), F.col("slot").alias("x"), F.col("label").alias("class"))
    met = few.join(heads, F.col("key") == F.col("of")).where(F.col("label") != F.col("class"))
    return written(met.select(F.least("x", "slot").alias("a"), F.greatest("x", "slot").alias("b")).distinct(), "pairs")


def rest_links(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within keys with more than HEADS texts outside their largest class; a written table.

    These texts are dealt into blocks, by a hash of the node, and a block is compared with all texts of the key.
    """
    rows = mixed.where(F.col("others") > HEADS)
    held = sets.withColumnRenamed("node", "__node")
    # Sets are large: blocks are worked out from their lengths, and a set moves once its places are known.
    lengths = rows.where("label <> main").join(held.select("__node", F.octet_length("held").alias("length")), F.col("node") == F.col("__node"))
    small = lengths.groupBy(F.col("key").alias("__key")).agg(F.sum("length").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("others") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES)).cast("int")
    rows = rows.join(small, F.col("key") == F.col("__key")).withColumn("blocks", F.greatest(blocks, F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # A text is compared with every block; those outside the largest class also make up a block.
    places = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(1).alias("other"))
    )
    itself = F.array(F.struct(own.alias("block"), F.lit(0).alias("other")))
    places = F.when(F.col("label") != F.col("main"), F.concat(itself, places)).otherwise(places)
    placed = rows.select("key", "node", "label", places.alias("places")).join(held, F.col("node") == F.col("__node"))
    dealt = placed.withColumn("place", F.explode("places")).select("key", "place.block", "place.other", "node", "label", "held")
    links = (
        dealt.repartition("key", "block").sortWithinPartitions("key", "block", "other").mapInArrow(frugal(_rest(percent)), "a long, b long")
    )
    return written(links.distinct(), "links")


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of df.

    Two texts link when 100 * intersection >= percent * union of their sets of distinct
    word shingles; component_id is the smallest id reachable over links, its own included.
    A text of fewer words is one shingle. Null, empty and wordless texts have an empty set
    (n_shingles 0) and link with nothing. Rows that repeat an id are rows of their own. A
    row with a null id keeps its set size and, if its set is that of a row with an id, takes
    that row's class; otherwise component_id is null. An empty table gives an empty result.
    """
    prepared(df.sparkSession)
    texts = narrow(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    marked = written(
        texts.mapInArrow(
            frugal(_marked(shingle, percent)),
            "doc_id long, n_shingles long, mark long, mark2 long, slots array<long>, sketches array<binary>, spares array<int>",
        ),
        "marked",
    )
    marks = ["n_shingles", "mark", "mark2"]
    # Texts without id are compared with nothing.
    named = marked.where("n_shingles > 0 and doc_id is not null")
    same = named.groupBy(*marks).agg(F.min("doc_id").alias("node"))
    # One row of each set, though its id may have rows of other sets too.
    of_set = named.join(same.withColumnRenamed("node", "doc_id"), [*marks, "doc_id"]).dropDuplicates([*marks])
    entries = of_set.select("doc_id", "n_shingles", F.explode(F.arrays_zip("slots", "sketches", "spares")).alias("s")).select(
        F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.col("s.slots").alias("slot"),
        F.col("s.sketches").alias("held"), F.col("s.spares").alias("spare"),
    )
    entries = written(entries, "entries")
    count = marked.agg(F.sum("n_shingles")).first()[0] or 0
    keyed = texts.where("doc_id is not null and text is not null")
    shared = shared_keys(keyed, shingle, percent, count * (100 - percent) // 40)
    keys = rare_keys(shared, entries)
    forget(shared)
    pairs = head_pairs(keys)
    sets = sets_of(pairs, entries, keyed, shingle)
    links = links_of(pairs, entries, sets, percent)
    classes = components(links)
    mixed = mixed_keys(keys, classes)
    forget(keys, pairs)
    pairs = other_pairs(mixed)
    more = [links_of(pairs, entries, sets, percent), rest_links(mixed, sets, percent)]
    forget(pairs, mixed, sets, entries)
    if not (more[0].isEmpty() and more[1].isEmpty()):
        before, classes = classes, merged(classes, more[0].union(more[1]))
        forget(before)
    found = same.join(classes, "node", "left").select(*marks, F.coalesce("component", "node").alias("component_id"))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = written(
        marked.select("doc_id", *marks)
        .join(found, marks, "left")
        .select("doc_id", "n_shingles", component.alias("component_id")),
        "classes",
    )
    forget(marked, links, *more, classes)
    return out


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df without near copies: of each component the document with the smallest id stays.

    Rows that repeat the id that stays stay too, as do rows without id or words.
    """
    classes = jaccard_components(df, id_col, text_col, shingle, percent)
    gone = written(classes.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    forget(classes)
    count = gone.count()
    if count > MOST_KEYS:
        return df.join(gone, column(id_col) == F.col("__gone"), "left_anti")
    # Only rows that may be gone move to be compared; a filter of bounded size tells the others where they lie.
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    id_at = f"c{df.columns.index(id_col)}"
    words_of_gone, size = key_words(gone, "__gone", count)
    marked = may_have_partner(numbered.withColumn("id", F.col(id_at).cast("long")), "id", words_of_gone, size, "may").drop("id")
    sure = marked.where("not may").drop("may")
    left = marked.where("may").drop("may").join(gone, F.col(id_at) == F.col("__gone"), "left_anti")
    return sure.union(left).toDF(*df.columns)
