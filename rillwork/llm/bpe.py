"""Byte-level BPE as a monoid reduced over a tree.

Encodings of neighbouring texts are joined without encoding the whole again. Two facts make that exact:

* The pattern's match at a position depends on what follows only, so scanning again from a match of
  the left half that its end cut (or might have cut) meets a match start of the right half; from there on
  the right half's matches hold.
* In a match, a sequence of tokens is the BPE encoding if and only if each pair of neighbours is
  the encoding of its own bytes. So a window at the seam is encoded again and grows, doubling,
  until the pairs at both of its ends are stable; no token outside can then change.

Both halves are encoded recursively. Decoding maps leaves of ids to bytes and concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from rillwork.llm._shared import map_batches, read_table, with_default_columns

#: Characters after a match that can decide about it: contractions look two ahead, white space one.
LOOKAHEAD = 3
#: Matches kept in a task's memory, and their longest length; parts of matches likewise, in bytes. With these
#: and the pairs and seams below a worker holds about 100 MB at most, whatever the texts.
MEMO, MEMO_CHARS, PART_BYTES, PAIRS, SEAMS = 300_000, 64, 8, 1 << 17, 1 << 17


class TreeBPE:
    """Encoder and decoder of one rank table; ``leaf`` is the characters below which a text is not halved."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = 1 << 16):
        self.ranks, self.pattern, self.leaf = ranks, regex.compile(pattern), leaf
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.memo: dict[str, bytes] = {}
        self.parts: dict[bytes, list[int]] = {}
        self.stable = lru_cache(PAIRS)(self._stable)
        self.seam = lru_cache(SEAMS)(self._scan)

    # --- one match -------------------------------------------------------------------------

    def window(self, data: bytes) -> list[int]:
        """Merges by rank, leftmost first: the encoding of a seam's bytes. Short ones are scanned, long ones use a heap."""
        if len(data) > 48:
            return self._window(data)
        return self.seam(data) if len(data) <= 16 else self._scan(data)

    def _scan(self, data: bytes) -> list[int]:
        rank, part = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        none = len(self.ranks)
        ranks = [rank(a + b, none) for a, b in zip(part, part[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(part[i - 1] + part[i], none)
            if i < len(ranks):
                ranks[i] = rank(part[i] + part[i + 1], none)
        return [self.ranks[p] for p in part]

    def _window(self, data: bytes) -> list[int]:
        n = len(data)
        part = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or rank(part[i] + part[j]) != r:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [self.ranks[p] for p in part if p is not None]

    def _stable(self, a: int, b: int) -> bool:
        return self.window(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        take_l = take_r = 1
        while True:
            l, r = left[max(0, len(left) - take_l) :], right[:take_r]
            middle = self.window(b"".join(self.bytes_of[t] for t in l + r))
            fixed_l = take_l >= len(left) or self.stable(left[-take_l - 1], middle[0])
            fixed_r = take_r >= len(right) or self.stable(middle[-1], right[take_r])
            if fixed_l and fixed_r:
                return left[: max(0, len(left) - take_l)] + middle + right[take_r:]
            take_l, take_r = take_l * (1 if fixed_l else 2), take_r * (1 if fixed_r else 2)

    def match_ids(self, data: bytes) -> list[int]:
        """Halves first, then their seam. A token's bytes encode to that token; short parts are remembered."""
        if (token := self.ranks.get(data)) is not None:
            return [token]
        short = len(data) <= PART_BYTES
        if short and (got := self.parts.get(data)) is not None:
            return got
        out = self.join(self.match_ids(data[: len(data) // 2]), self.match_ids(data[len(data) // 2 :]))
        if short:
            if len(self.parts) >= MEMO:
                self.parts.clear()
            self.parts[data] = out
        return out

    def packed(self, match: str) -> bytes:
        """The match's ids as little-endian unsigned 32-bit integers."""
        got = self.memo.get(match)
        if got is None:
            got = np.array(self.match_ids(match.encode()), "<u4").tobytes()
            if len(match) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[match] = got
        return got

    # --- a text ----------------------------------------------------------------------------

    def matches(self, text: str, start: int = 0, end: int | None = None) -> list[str]:
        """The pattern's matches of text[start:end], halves first, then the seam."""
        end = len(text) if end is None else end
        if end - start <= self.leaf:
            return self.pattern.findall(text[start:end])
        middle = (start + end) // 2
        left, right = self.matches(text, start, middle), self.matches(text, middle, end)
        at = middle
        while left and at > middle - LOOKAHEAD:  # matches that the cut may have changed
            at -= len(left.pop())
        starts, p, i, seam = middle, at, 0, []
        while p < end:
            while i < len(right) and starts < p:
                starts += len(right[i])
                i += 1
            if starts == p and p >= middle:
                break
            # a match longer than what is read here goes on into the next characters
            size = 256
            while (m := self.pattern.match(text, p, min(end, p + size))) and m.end() + LOOKAHEAD > p + size and p + size < end:
                size *= 4
            seam.append(m[0])
            p = m.end()
        return left + seam + (right[i:] if p < end else [])

    def encode(self, text: str) -> bytes:
        packed = self.memo.get
        return b"".join([packed(m) or self.packed(m) for m in self.matches(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_documents(docs: DataFrame, path: str, pattern: str, leaf: int = 1 << 16) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids: binary of little-endian uint32, decoded: binary).

    A null text is empty; an empty text has no ids. ``path`` names the rank file on every executor.
    """

    def make():
        coder = TreeBPE(read_ranks(path), pattern, leaf)

        def step(c: dict) -> dict:
            ids = [coder.encode(t or "") for t in c["text"].to_pylist()]
            return {"doc_id": c["doc_id"], "ids": ids, "decoded": [coder.decode(np.frombuffer(x, "<u4")) for x in ids]}

        return step

    return map_batches(with_default_columns(docs, doc_id="bigint", text="string"), make, "doc_id bigint, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encode_documents`` gives, digested where it is made.

    A text's ids and decoded bytes are dropped before the next text is encoded. A null text counts as empty: no ids, and the digests
    of nothing. Rows with a null doc_id and repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """

    def make():
        coder = TreeBPE(read_ranks(path), pattern)

        def step(c: dict) -> dict:
            out: dict = {"doc_id": c["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in c["text"].to_pylist():
                ids = coder.encode(text or "")
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(coder.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            return out

        return step

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_batches(with_default_columns(docs, doc_id="bigint", text="string"), make, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
