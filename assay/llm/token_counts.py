"""Token counts without tokens: greedy longest match by an automaton that never looks back.

The vocabulary is a trie. Where a word leaves it, the longest tokens of what was read are popped and
reading goes on behind them; for every trie node both are known beforehand: the failure link to the
node where reading goes on, and how many tokens are popped on the way. So each byte of a word is read
once, and no piece is ever built.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from assay.llm.texts import named, text_or_empty

#: distinct words, and their bytes, whose counts a task keeps before it starts anew
KEPT, KEPT_BYTES = 300_000, 1 << 24


class LongestMatch:
    """Counts the greedy longest-match pieces of words over byte tokens."""

    def __init__(self, tokens: Iterable[bytes]):
        child, is_token, parent = {}, [False], [(0, 0)]
        for token in filter(None, tokens):
            node = 0
            for byte in token:
                nxt = child.get(node << 8 | byte)
                if nxt is None:
                    nxt = child[node << 8 | byte] = len(is_token)
                    is_token.append(False)
                    parent.append((node, byte))
                node = nxt
            is_token[node] = True
        fail, popped = [-1] * len(is_token), [0] * len(is_token)
        queue, below = deque([0]), [[] for _ in is_token]
        for node in range(1, len(is_token)):
            below[parent[node][0]].append(node)
        while queue:  # breadth first: links of shorter strings are known
            node = queue.popleft()
            queue += below[node]
            if not node:
                continue
            if is_token[node]:
                fail[node], popped[node] = 0, 1
                continue
            above, byte = parent[node]
            at, pops = fail[above], popped[above]
            while at >= 0 and (at << 8 | byte) not in child:
                pops += popped[at]
                at = fail[at]
            if at >= 0:
                fail[node], popped[node] = child[at << 8 | byte], pops
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of a word; a word that the tokens cannot spell is one unknown piece."""
        child, fail, popped = self.child, self.fail, self.popped
        node = pieces = 0
        for byte in word:
            nxt = child.get(node << 8 | byte)
            while nxt is None:
                pieces += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                nxt = child.get(node << 8 | byte)
            node = nxt
        while node > 0:
            pieces += popped[node]
            node = fail[node]
        return 1 if node < 0 else pieces


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    """The automaton of a rank file, once in each Python worker. Its size is the vocabulary's."""
    with open(path, "rb") as lines:
        return LongestMatch(base64.b64decode(line.split()[0]) for line in lines if line.strip())


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens, longest_word) of every row.

    Words are runs of characters other than space and control characters 9 to 13, each matched with
    the space before it, as byte-level vocabularies mark the start of a word; ``longest_word`` is the
    largest number of tokens of a word. Null and empty texts have no words. Repeated rows and ids are
    counted alike; an empty table gives no rows; other columns are not read. ``path`` must be
    readable by the executors.
    """
    rows = docs.select(named(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known, size = automaton(path).count, {}, 0
        for batch in batches:
            n_bytes, n_words, n_tokens, longest = [], [], [], []
            for cell in batch.column(1):
                text = cell.as_py()
                words = text.split()
                for word in set(words).difference(known):
                    known[word] = count(b" " + word)
                    size += len(word)
                counts = [known[w] for w in words]
                n_bytes.append(len(text)), n_words.append(len(words))
                n_tokens.append(sum(counts)), longest.append(max(counts, default=0))
                if len(known) > KEPT or size > KEPT_BYTES:
                    known.clear()
                    size = 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (n_bytes, n_words, n_tokens, longest)]],
                ["doc_id", "n_bytes", "n_words", "n_tokens", "longest_word"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_bytes long, n_words long, n_tokens long, longest_word long")
