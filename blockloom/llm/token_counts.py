"""Token counts by a linear longest-match automaton.

A trie over the vocabulary gets, for each node, a failure link and the number
of pieces that greedy longest-match-first would have popped by following it.
A word is then counted in one pass over its symbols, without building or
backing off over any piece: the automaton only adds up the precomputed counts.

Pieces are sequences of small integers. A word of bytes b1 .. bn becomes
b1 .. b(n-1), 256 + bn: its last byte is another symbol, so pieces that end a
word and pieces that do not are told apart within one trie.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, batches, only, strings

#: Fixed value: how the vocabulary's library splits lower-case text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that a worker remembers; only speed depends on it.
MEMO_WORDS = 300_000
_LAST = 256
_BITS = 10


class Automaton:
    """Counts the pieces of greedy longest-match-first.

    ``pieces`` are symbol sequences (symbols below 1024). A word with a symbol
    that no piece can cover counts as one unknown token, as word-piece
    tokenizers have it. The empty word has no tokens.
    """

    def __init__(self, pieces: Iterable[Sequence[int]]):
        step: dict[int, int] = {}
        parent, symbol, final = [0], [0], [False]
        for piece in pieces:
            at = 0
            for s in piece:
                key = at << _BITS | s
                to = step.get(key)
                if to is None:
                    to = step[key] = len(final)
                    parent.append(at)
                    symbol.append(s)
                    final.append(False)
                at = to
            final[at] = at != 0
        children: dict[int, list[int]] = {}
        for node in range(1, len(final)):
            children.setdefault(parent[node], []).append(node)
        link, popped = [-1] * len(final), [0] * len(final)
        queue = deque(children.get(0, ()))
        while queue:  # breadth first: links lead to shallower nodes
            node = queue.popleft()
            queue.extend(children.get(node, ()))
            if final[node]:
                link[node], popped[node] = 0, 1
                continue
            above = parent[node]
            to, count = link[above], popped[above]
            while to > 0 and (to << _BITS | symbol[node]) not in step:
                count += popped[to]
                to = link[to]
            if to >= 0 and (to << _BITS | symbol[node]) in step:
                link[node], popped[node] = step[to << _BITS | symbol[node]], count
        self.step, self.link, self.popped = step, link, popped

    def count(self, word: Sequence[int]) -> int:
        step, link, popped = self.step, self.link, self.popped
        at = total = 0
        for s in word:
            to = step.get(at << _BITS | s)
            while to is None:
                if link[at] < 0:
                    return 1
                total += popped[at]
                at = link[at]
                to = step.get(at << _BITS | s)
            at = to
        while at:
            if link[at] < 0:
                return 1
            total += popped[at]
            at = link[at]
        return total


def byte_symbols(word: str | bytes) -> list[int]:
    """A word's bytes, the last one marked."""
    out = list(word.encode() if isinstance(word, str) else word)
    if out:
        out[-1] += _LAST
    return out


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in order.
    """
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in kept}
    rest = (b for b in range(256) if chr(b) not in table)
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


def load_pieces(path: str, end: str = "</w>") -> list[list[int]]:
    """The pieces of a tokenizer file as symbols; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    table = printable_bytes()
    pieces = []
    for piece in spec["model"]["vocab"]:
        if piece in special:
            continue
        body = piece.removesuffix(end)
        symbols = [table[c] for c in body]
        if symbols and body != piece:
            symbols[-1] += _LAST
        if symbols:
            pieces.append(symbols)
    return pieces


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(load_pieces(path))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words and greedy longest-match tokens of every text.

    Returns ``doc_id, n_words, n_tokens``, one row per input row: null and
    empty texts have no words, repeated rows are counted each, a null id stays
    null, other columns are ignored. A map without any shuffle. ``vocabulary``
    is a path that exists on every executor.
    """
    split = SPLIT

    def run(rows):
        auto, find = automaton(vocabulary), regex.compile(split).finditer
        memo = Memo(lambda w: auto.count(byte_symbols(w)), MEMO_WORDS)
        whole = regex.compile(split).findall
        for batch in batches(rows):
            n_words, n_tokens = [], []
            for text in strings(batch.column(1)):
                text = (text or "").lower()
                if len(text) < 1_000_000:
                    found = whole(text)
                    n_words.append(len(found))
                    n_tokens.append(sum(map(memo.__getitem__, found)))
                else:
                    w = t = 0
                    for m in find(text):
                        word = m[0]
                        w += 1
                        t += memo[word] if len(word) < 200 else auto.count(byte_symbols(word))
                    n_words.append(w)
                    n_tokens.append(t)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = only(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_tokens bigint")
