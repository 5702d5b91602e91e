"""Count the tokens of a unigram tokenizer without building them.

For every word an Aho-Corasick automaton lists the vocabulary pieces that end at each
place; dynamic programming carries the best score and the number of pieces that reach it.
No piece crosses a space, so words are independent and their counts are remembered.

The tie rules are those of the ``tokenizers`` library's Unigram model: scores are added in
double precision from the left; of pieces ending at the same place, the one that starts first
wins unless a later one is strictly better; a character that is no piece is unknown, at the
lowest score less 10; adjacent unknown characters are one run, which is spelled in byte pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmine.llm.common import ship_package

UNKNOWN_PENALTY = 10.0
MARK = "▁"
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64

Vocabulary = list[tuple[str, float]]


def read_vocabulary(path: str) -> Vocabulary:
    """The (piece, score) pairs of a SentencePiece model file, by id."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Word (with its leading mark) to number of tokens; forgets all when ``REMEMBERED`` words are held."""

    def __init__(self, vocabulary: Vocabulary):
        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        held = {piece for piece, _ in vocabulary}
        self.bytes = [f"<0x{b:02X}>" in held for b in range(256)]

    def __missing__(self, word: str) -> int:
        count = self.count(MARK + word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = count
        return count

    def count(self, text: str) -> int:
        """Tokens of the best path over ``text``, which has no space inside."""
        n = len(text)
        score: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)  # without the unknown run that is still open
        opened = [-1] * (n + 1)  # where the open run began, or -1
        score[0] = 0.0
        hits = self.pieces.iter(text)
        hit = next(hits, None)
        for end in range(1, n + 1):
            single, best, before = False, None, -1
            while hit is not None and hit[0] == end - 1:
                length, value = hit[1]
                single = single or length == 1
                start = end - length
                if score[start] is not None:
                    total = score[start] + value
                    if best is None or total > best:
                        best, before, unknown = total, start, False
                hit = next(hits, None)
            if not single:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best, before, unknown = total, end - 1, True
            score[end] = best
            if unknown:
                opened[end] = opened[before] if opened[before] >= 0 else before
                count[end] = count[before]
            else:
                count[end] = count[before] + 1 + self._spelled(text, opened[before], before)
        return count[n] + self._spelled(text, opened[n], n)

    def _spelled(self, text: str, start: int, end: int) -> int:
        """Tokens of an unknown run: its bytes if all of them are pieces, else one."""
        if start < 0:
            return 0
        raw = text[start:end].encode()
        return len(raw) if all(self.bytes[b] for b in raw) else 1

    def of_text(self, text: str) -> int:
        """Spaces part words; a text begins with a mark unless it has one already."""
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        return sum(map(self.__getitem__, words[1:] if words[0] == "" else words))


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_chars, n_tokens) of every row, over whole texts.

    A null or empty text has 0 tokens, ill-formed UTF-8 is read as U+FFFD; a null doc_id stays, repeated rows are counted each for
    itself, an empty table gives an empty result. Needs (doc_id, text); other columns are ignored.
    The vocabulary (some 10,000 pieces, whatever the input) is broadcast.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_chars", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            numbers = [counter.of_text((raw.as_py() or b"").decode(errors="replace")) for raw in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(numbers, pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return docs.select(
        "doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), F.col("text").cast("binary").alias("raw")
    ).mapInArrow(count, schema)
