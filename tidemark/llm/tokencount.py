"""Token counts of a unigram vocabulary without the tokens: best score and number of pieces per word."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.memo import Memo
from tidemark.llm.text import parts, span_hashes, utf8

# Fixed values of unigram tokenizers: the mark of a word's begin, and what an unknown character costs.
MARK = "▁"
UNKNOWN_COST = 10.0


class CountViterbi:
    """Forward pass over the ends of vocabulary matches, which carries score and piece count and no path.

    Ties go to the longer piece, as a forward search keeps what it found first. A character that is no piece by itself
    may be unknown; a run of unknown characters is one piece, or its bytes if the vocabulary has them all.
    """

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and piece not in self.matches:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_COST
        names = {p for p, _ in pieces}
        self.bytes_known = all(f"<0x{b:02X}>" in names for b in range(256))

    def count(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best way to write the word."""
        ends: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, match in self.matches.iter(word):
            ends[end].append(match)
        # score, pieces, and whether the last piece is unknown, for every prefix
        score, pieces, open_run = [0.0], [0], [False]
        for end, found in enumerate(ends):
            best = n = None
            run = False
            for length, s in sorted(found, reverse=True):
                start = end + 1 - length
                if best is None or score[start] + s > best:
                    best, n = score[start] + s, pieces[start] + 1
            if not any(length == 1 for length, _ in found) and (best is None or score[end] + self.unknown > best):
                best, run = score[end] + self.unknown, True
                more = len(word[end].encode()) if self.bytes_known else 0 if open_run[end] else 1
                n = pieces[end] + more
            score.append(best)
            pieces.append(n)
            open_run.append(run)
        return pieces[-1], score[-1]


def sentencepiece_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


_memos: dict[str, Memo] = {}


def _memo(path: str) -> Memo:
    if path not in _memos:
        machine = CountViterbi(sentencepiece_pieces(path))
        _memos[path] = Memo(lambda words: [machine.count(MARK + w.decode()) for w in words], float)
    return _memos[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_tokens`` and ``score`` of its text by the pieces of the file ``vocabulary``.

    The text is split at each space (U+0020), every part gets the mark of a word's begin, and parts are counted by
    themselves; so equal parts are counted once per worker. Null and empty texts have 0 tokens. Texts are counted
    whole, a text must fit a task; repeated rows repeat their result; other columns are not read.
    """
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))
    kind = d.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(vocabulary)
        for batch in parts(batches, "body"):
            data, offsets = utf8(batch["body"])
            rows = np.flatnonzero(np.diff(offsets))
            space = np.flatnonzero(data == 0x20)
            starts = np.sort(np.concatenate([offsets[rows], space + 1]))
            ends = np.sort(np.concatenate([offsets[rows + 1], space]))
            # a space at the very end of a text is followed by an empty part
            owner = np.sort(np.concatenate([rows, np.searchsorted(offsets, space, "right") - 1]))
            numbers = memo.look(data, starts, ends, span_hashes(data, starts, ends))
            values = memo.rows(numbers).reshape(-1, 2)
            n = np.bincount(owner, values[:, 0], batch.num_rows).astype(np.int64)
            score = np.bincount(owner, values[:, 1], batch.num_rows).astype(float)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n), pa.array(score)], names=["id", "n_tokens", "score"])

    return d.mapInArrow(read, f"id {kind}, n_tokens long, score double").withColumnRenamed("id", id_col)
