"""Token counts by dynamic programming shared along a trie of pre-tokens.

The vocabulary of a sentencepiece file and its scores are taken as a unigram model: of all ways to
write a pre-token as pieces, the one of greatest total score counts (the fewest pieces among equals).
The forward score of a prefix does not depend on what follows it; so the distinct pre-tokens of a batch are
put into a trie and walked depth first, each node's score is computed once for all pre-tokens
below it, and terminal nodes store their counts.  A document's count is the sum over its pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands before a pre-token, as in the vocabulary.
MARK = "▁"
#: An unknown character scores this much below the least piece and counts as its UTF-8 bytes.
UNKNOWN = 10.0
#: Pre-tokens whose counts a task remembers, before it forgets all.
REMEMBER = 800_000


class TrieCounter:
    """Token counts of pre-tokens under a unigram model {piece: score}."""

    def __init__(self, pieces: dict[str, float], remember: int = REMEMBER) -> None:
        self.pieces, self.remember = pieces, remember
        #: How long the pieces are that end in these two characters.
        self.ends: dict[str, list[int]] = {}
        for end, length in sorted({(piece[-2:], len(piece)) for piece in pieces if len(piece) > 1}):
            self.ends.setdefault(end, []).append(length)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        self.counts: dict[bytes, int] = {}

    @classmethod
    def from_file(cls, path: str) -> TrieCounter:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        plain = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
        return cls({sp.id_to_piece(i): sp.get_score(i) for i in plain})

    def _extend(self, scores: list[tuple[float, int]], word: str, end: int) -> None:
        """Append the forward score (total, minus pieces) of word[:end]."""
        get = self.pieces.get
        total, count = scores[end - 1]
        score = get(word[end - 1])
        if score is None:
            best = (total + self.unknown, count - len(word[end - 1].encode()))
        else:
            best = (total + score, count - 1)
        for length in self.ends.get(word[max(0, end - 2) : end], ()):
            if length > end:
                break
            score = get(word[end - length : end])
            if score is not None:
                total, count = scores[end - length]
                here = (total + score, count - 1)
                if here > best:
                    best = here
        scores.append(best)

    def learn(self, words: set[bytes]) -> None:
        """Store the counts of new pre-tokens.  Sorted, they are their trie in depth-first order: the path to the next begins with what it shares with the last."""
        path, scores = "", [(0.0, 0)]
        for word, raw in sorted((MARK + w.decode(), w) for w in words):
            shared = len(commonprefix((path, word)))
            del scores[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                self._extend(scores, word, end)
            path = word
            self.counts[raw] = -scores[-1][1]

    def __call__(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text; pre-tokens are parted by ASCII white space."""
        split = [t.split() for t in texts]
        if len(self.counts) > self.remember:
            self.counts = {}
        self.learn(set().union(*split).difference(self.counts))
        return [(len(words), sum(map(self.counts.__getitem__, words))) for words in split]


def token_counts(documents: DataFrame, vocabulary: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens): a row per row of documents, repeated ones included.

    vocabulary is the path of a sentencepiece file, which every executor must have.  Null and empty texts have 0
    of both.  An empty table gives no rows; other columns are not read.  Nothing is shuffled.
    """
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter.from_file(vocabulary)
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                counts = counter([bytes(t.as_buffer()) if t.is_valid and len(t.as_buffer()) else b"" for t in part["text"]])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return source.mapInArrow(count, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long")
