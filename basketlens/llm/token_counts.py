"""Token counts without tokens: Viterbi over a unigram vocabulary that carries score and count only.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; the best
path to a position is the best-scored one, and of equal scores the one whose last piece
starts first (a later candidate must be strictly better). A character that is no piece by
itself may be taken as unknown, at the lowest score minus UNKNOWN_PENALTY; unknown text is
spelt in byte pieces, so it counts its UTF-8 bytes. These are the rules of the tokenizers library's
Unigram model with byte fallback, behind a Metaspace pre-tokenizer that splits.

A space begins a word and no piece spans two, so texts are counted word by word, and
short words already met are looked up. A text without spaces, however long, is one word and is counted in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.tables import narrow, prepared

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
# Words whose numbers a worker keeps, none longer than LONGEST_CACHED characters.
CACHED_WORDS = 500_000
LONGEST_CACHED = 32
BAR = "▁"

_counters: dict[str, Counter] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, by id."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Numbers of pieces of words."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.pieces = {piece for piece, _ in vocabulary}
        self.unknown_piece = vocabulary[unknown][0]
        self.unknown_score = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    @staticmethod
    def of(path: str) -> Counter:
        if path not in _counters:
            _counters[path] = Counter(read_vocabulary(path))
        return _counters[path]

    def word(self, word: str) -> int:
        """Pieces of one word with its leading bar."""
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (length, score) in self.automaton.iter(word):
            ending[last + 1].append((last + 1 - length, score))
        best, count, start = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top, found, begin = None, 0, 0
            single = False
            for at, score in sorted(ending[end]):
                single = at == end - 1
                if top is None or best[at] + score > top:
                    top, found, begin = best[at] + score, count[at] + 1, at
            if not single and (top is None or best[end - 1] + self.unknown_score > top):
                top = best[end - 1] + self.unknown_score
                found, begin = count[end - 1] + len(word[end - 1].encode()), end - 1
            best[end], count[end], start[end] = top, found, begin
        return count[n] if self.unknown_piece not in word else self._fused(word, start)

    def _fused(self, word: str, start: list[int]) -> int:
        """The count when the unknown piece's own name occurs: it fuses with unknown neighbours."""
        total, end, held = 0, len(word), ""
        while end > 0:
            part = word[start[end] : end]
            if part == self.unknown_piece or part not in self.pieces:
                held = part + held
            else:
                total += 1 + self._spelt(held)
                held = ""
            end = start[end]
        return total + self._spelt(held)

    def _spelt(self, text: str) -> int:
        return 1 if text in self.pieces else len(text.encode())

    def text(self, text: str) -> int:
        """Pieces of a text; none for an empty one."""
        if not text:
            return 0
        text = text.replace(BAR, " ")
        words = (text[1:] if text[0] == " " else text).split(" ")
        known = self.known
        fresh = {w: self.word(BAR + w) for w in set(words).difference(known)}
        if len(known) + len(fresh) > CACHED_WORDS:
            return sum([known[w] if w in known else fresh[w] for w in words])
        known.update({w: n for w, n in fresh.items() if len(w) <= LONGEST_CACHED})
        return sum([known[w] if w in known else fresh[w] for w in words])


def token_counts(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """(doc_id, n_tokens) for every row of documents.

    A null or empty text has no tokens. Ids may be null or repeat; each row is counted by itself.
    An empty table gives an empty result. Other columns are not looked at.
    """
    prepared(documents.sparkSession)
    path = vocabulary or vocabulary_path()
    docs = narrow(documents, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        for batch in batches:
            texts = batch.column("text")
            counts = [counter.text(texts[i].as_py() or "") for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"]
            )

    return docs.mapInArrow(run, "doc_id long, n_tokens long")
