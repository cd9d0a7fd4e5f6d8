"""Token ids of a public byte-level vocabulary. Each distinct piece of a chunk is encoded once; the rest are array look-ups.

Text is cut before single spaces that stand between two visible characters. The vocabulary's splitting pattern always begins a
new piece there, so the tokens of the pieces are the tokens of the text, exactly.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pandas as pd
import tiktoken

from strandline.llm import core

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_GRAPH = np.zeros(256, bool)
_GRAPH[33:127] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True  # two-byte letters and marks: no white space among them


class Bpe:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.size = np.zeros(self.end + 1, np.int64)
        self.size[list(ranks.values())] = [len(x) for x in ranks]

    def pieces(self, data: np.ndarray, offs: np.ndarray):
        """Start and end bytes of the pieces, and whether each is cut from its neighbours on both sides."""
        n = len(data)
        graph, lead = _GRAPH[data], _LEAD[data]
        mark = np.zeros(n + 1, bool)
        if n > 2:
            before = graph[:-2].copy()
            before[1:] |= lead[:-3] & (data[1:-2] >= 128)
            mark[1 : n - 1] = (data[1:-1] == 32) & before & (graph[2:] | lead[2:])
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        mark |= edge
        start = np.flatnonzero(mark[:-1])
        end = np.append(start[1:], n)[: len(start)]
        return start, end, ~edge[start] & ~edge[end]

    def distinct(self, data: np.ndarray, offs: np.ndarray):
        """(tokens of all distinct pieces, first token of each and the end, piece of each place, row of each place)."""
        start, end, inner = self.pieces(data, offs)
        # By a hash table, in order of appearance: many pieces, few of them distinct, need no sort.
        which, kinds = pd.factorize(core.span_hash(data, start, end))
        first = np.empty(len(kinds), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        mem, whole = data.tobytes(), inner[first]
        order = np.concatenate([np.flatnonzero(whole), np.flatnonzero(~whole)])
        joined = [mem[a:b] for a, b in zip(start[first[order]].tolist(), end[first[order]].tolist())]
        k = int(whole.sum())
        ids = self.encoding.encode_to_numpy(b"".join(joined[:k]).decode(), disallowed_special=())
        ends = np.cumsum(self.size[ids])
        bound = np.cumsum((end - start)[first[order[:k]]])
        count = np.searchsorted(ends, bound) + 1
        if k and not np.array_equal(ends[count - 1], bound):
            raise ValueError("a token crosses a cut")
        alone = [self.encoding.encode_ordinary(x.decode()) for x in joined[k:]]
        tokens = np.concatenate([ids, np.array([t for x in alone for t in x], np.uint32)]).astype(np.uint32, copy=False)
        place = np.concatenate([[0], count, len(ids) + np.cumsum([len(x) for x in alone], dtype=np.int64)]).astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return tokens, place, rank[which], np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(start, offs)))

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        _, place, which, row = self.distinct(data, offs)
        return np.bincount(row, np.diff(place)[which], len(offs) - 1).astype(np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' tokens one after the other, and where each row's begin, with the end."""
        tokens, place, which, row = self.distinct(data, offs)
        size = np.diff(place)[which]
        begin = np.cumsum(size) - size
        flat = np.repeat(place[which] - begin, size) + np.arange(int(size.sum()))
        rows = np.bincount(row, size, len(offs) - 1).astype(np.int64)
        return tokens[flat], np.concatenate([[0], np.cumsum(rows)])


@functools.lru_cache(maxsize=2)
def load(path: str = PATH) -> Bpe:
    return Bpe(path)
