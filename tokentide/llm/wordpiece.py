"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary becomes a trie whose nodes carry a failure link and the number of pieces that
following the link pops (Song et al., "Fast WordPiece Tokenization", 2021). A word's piece count is
then one left-to-right walk: no piece is built and no byte is read twice.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tokentide.llm.text import raw, spaced_words

#: A vocabulary above this many bytes is refused: it is broadcast, and its trie has at most a node a byte, each a few
#: hundred bytes in every Python worker, so this is some 1 GB there. Public vocabularies have 0.3 to 2 MB.
MAX_VOCABULARY_BYTES = 4 << 20


def read_ranked_vocabulary(path: str) -> list[bytes]:
    """Pieces of a file of "base64 rank" lines, as byte strings."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class PieceAutomaton:
    """Trie over the pieces that may start a word (root 0) and those that may continue it (root 1).

    ``pops[v]`` pieces are final when the walk leaves node v by its failure link ``fail[v]``;
    -1 marks a node from which no greedy split exists.
    """

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        ends = {v for root, pieces in ((0, initial), (1, continuing)) for p in pieces if p for v in [self._add(root, p)]}
        self.fail = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = deque((root, c, v) for root in (0, 1) for c, v in self.next[root].items())
        while queue:  # breadth first: a node's links lead to shallower nodes
            parent, c, v = queue.popleft()
            if v in ends:
                self.fail[v], self.pops[v] = 1, 1
            else:
                popped, at = self.pops[parent], self.fail[parent]
                while at >= 0 and c not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[v], self.pops[v] = self.next[at][c], popped
            queue.extend((v, d, w) for d, w in self.next[v].items())

    def _add(self, root: int, piece: bytes) -> int:
        at = root
        for c in piece:
            step = self.next[at].get(c)
            if step is None:
                step = self.next[at][c] = len(self.next)
                self.next.append({})
            at = step
        return at

    def count(self, word: bytes) -> int:
        """Pieces of the word's greedy split; 1 (the unknown piece) if it has none."""
        goto, fail, pops = self.next, self.fail, self.pops
        at = total = 0
        for c in word:
            while (step := goto[at].get(c)) is None:
                total += pops[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = step
        while at > 1:
            total += pops[at]
            at = fail[at]
        return total if at >= 0 else 1


class _Counts(dict):
    """Piece counts of the words met so far; emptied when full, so memory stays bounded."""

    def __init__(self, automaton: PieceAutomaton, mark: bytes, most: int = 300_000):
        super().__init__()
        self.automaton, self.mark, self.most = automaton, mark, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self.automaton.count(self.mark + word)
        if len(word) <= 64:
            self[word] = n
        return n


_built: dict[int, tuple[object, _Counts]] = {}


def count_pieces(
    docs: DataFrame,
    initial: list[bytes],
    continuing: list[bytes],
    mark: bytes = b"",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words`` and ``n_pieces`` (long).

    Words are maximal runs free of ASCII white space; ``mark`` is put before each. A piece in
    ``initial`` may start a marked word, one in ``continuing`` may go on. A word without a greedy
    split counts as one unknown piece.

    Cases: null, empty and blank texts have no words and no pieces. A word of any length is walked
    once. Repeated rows are counted each. Null ids pass through. Extra columns are ignored. No
    rows give no rows; an empty vocabulary makes every word one unknown piece.
    """
    if sum(map(len, initial)) + sum(map(len, continuing)) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    sent = docs.sparkSession.sparkContext.broadcast((initial, continuing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        if 0 not in _built or _built[0][0] is not pieces:  # one automaton for each Python worker
            _built[0] = (pieces, _Counts(PieceAutomaton(*pieces), mark))
        count = _built[0][1].__getitem__
        for batch in batches:
            words = [spaced_words(t) for t in raw(batch.column("text"))]
            totals = [sum(map(count, w)) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(map(len, words), pa.int64()), pa.array(totals, pa.int64())], names=["id", "n_words", "n_pieces"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, n_pieces bigint").withColumnRenamed("id", id_col)


def byte_level_pieces(pieces: Iterable[bytes], mark: bytes = b" ") -> tuple[list[bytes], list[bytes]]:
    """Split a byte-level vocabulary, in which a leading space marks a word's start, in (initial, continuing)."""
    pieces = list(pieces)
    return [p for p in pieces if p.startswith(mark)], [p for p in pieces if not p.startswith(mark)]
