"""Byte-level BPE by a lazily determinised transducer, and a streaming UTF-8 decoder.

A token sequence is the BPE encoding of its bytes exactly if every token encodes to itself and
every two neighbours encode to themselves when put together. So the merges compile into a
nondeterministic transducer: walk the token trie from the last boundary; where a token ends that
agrees with the one before it, a new token may begin. Its subset construction is done on demand.
A state of the deterministic machine is the set of hypotheses still alive, each with the tokens it
has not yet emitted; what all of them share is emitted at once. No hypothesis outlives the longest
token, which bounds the lookahead. States are memoised up to a limit; where a text leads beyond the
memoised part, its hypotheses are followed one byte at a time without being made into states.

Defined cases: null text counts as empty; an empty text has no tokens; a match of the pattern that is
itself a token is emitted as that token; texts of any length are read once, from left to right; repeated rows are
encoded each by itself, a null doc_id stays null, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweft.llm.common import Memo, by_parts, kept


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class Transducer:
    """Bytes of one match of the pattern in, token ids out."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 150_000):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.ranks, self.max_states = ranks, max_states
        self.token = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.ends: dict[int, int] = {}  # node -> token that ends there
        nodes = 1
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = nodes
                    nodes += 1
                node = self.child[key]
            self.ends[node] = rank
        self._built: dict[int, tuple[bool, list[bytes], list[bytes]]] = {}
        self._agree: dict[int, bool] = {}
        start = (((), -1, 0),)
        self._ids, self._states, self._last = {start: 0}, [start], [()]
        self._moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merge(self, data: bytes) -> tuple[list[bytes], list[bytes], list[bytes]]:
        """Plain merging, lowest rank first, of the few bytes of one or two tokens; also the first
        and the last part as they were from step to step."""
        parts = [data[i : i + 1] for i in range(len(data))]
        firsts, lasts = [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            firsts.append(parts[0])
            lasts.append(parts[-1])
        return parts, list(dict.fromkeys(firsts)), list(dict.fromkeys(lasts))

    def _own(self, token: int) -> tuple[bool, list[bytes], list[bytes]]:
        """Whether it encodes to itself, and the parts that stand at either edge meanwhile."""
        own = self._built.get(token)
        if own is None:
            parts, firsts, lasts = self.merge(self.token[token])
            own = self._built[token] = (len(parts) == 1, firsts, lasts)
        return own

    def _fits(self, before: int, token: int) -> bool:
        key = before << 32 | token
        agree = self._agree.get(key)
        if agree is None:
            if len(self._agree) > 600_000:
                self._agree.clear()
            agree, firsts, _ = self._own(token)
            # only parts at the two edges can merge over the boundary
            if agree and before >= 0 and any(x + y in self.ranks for x in self._own(before)[2] for y in firsts):
                a, b = self.token[before], self.token[token]
                agree = self.merge(a + b)[0] == [a, b]
            self._agree[key] = agree
        return agree

    def _move(self, state: int, b: int) -> tuple[int, tuple[int, ...]] | None:
        """The subset step; None once there are as many states as allowed."""
        if len(self._states) >= self.max_states:
            return None
        alive = []
        for held, before, node in self._states[state]:
            node = self.child.get(node << 8 | b)
            if node is None:
                continue
            alive.append((held, before, node))
            token = self.ends.get(node)
            if token is not None and self._fits(before, token):
                alive.append(((*held, token), token, 0))
        first, last = min(h for h, _, _ in alive), max(h for h, _, _ in alive)
        same = 0
        while same < min(len(first), len(last)) and first[same] == last[same]:
            same += 1
        found = tuple(sorted((held[same:], before, node) for held, before, node in alive))
        to = self._ids.get(found)
        if to is None:
            to = self._ids[found] = len(self._states)
            self._states.append(found)
            self._last.append(next(held for held, _, node in found if node == 0))
        move = self._moves[state << 8 | b] = (to, first[:same])
        return move

    def _follow(self, state: int, data: bytes) -> list[int]:
        """The tokens still to come after `state` when `data` ends the match, hypothesis by hypothesis.
        Tokens hang on one another as (token, those before), so that a step costs the same anywhere."""
        child, ends, agree = self.child, self.ends, self._agree
        alive = []
        for held, before, node in self._states[state]:
            chain: tuple | None = None
            for token in held:
                chain = (token, chain)
            alive.append((node, before, chain))
        for b in data:
            step = []
            for node, before, chain in alive:
                node = child.get(node << 8 | b)
                if node is not None:
                    step.append((node, before, chain))
                    token = ends.get(node)
                    if token is not None:
                        fits = agree.get(before << 32 | token)
                        if self._fits(before, token) if fits is None else fits:
                            step.append((0, token, (token, chain)))
            alive = step
        chain = next(chain for node, _, chain in alive if node == 0)
        out = []
        while chain:
            token, chain = chain
            out.append(token)
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        known = self.ranks.get(data)
        if known is not None:
            return [known]
        out: list[int] = []
        state, moves = 0, self._moves
        for i, b in enumerate(data):
            move = moves.get(state << 8 | b) or self._move(state, b)
            if move is None:
                return out + self._follow(state, data[i:])
            state = move[0]
            if move[1]:
                out += move[1]
        out += self._last[state]
        return out


class Encoder:
    """Whole texts to little-endian unsigned 32-bit ids. A single space between two characters that
    are no white space always begins a match, so texts are cut there and each part is encoded once."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.matches = regex.compile(pattern).findall
        self.cut = regex.compile(r"(?<=\S) (?=\S)").split
        self.crowded = re.compile(r"\s | \s").search
        self.match = Memo(self._match, limit=500_000)
        self.rest = Memo(lambda part: self._part(" " + part))

    def _match(self, match: str) -> bytes:
        ids = self.transducer.encode(match.encode())
        return pack(f"<{len(ids)}I", *ids)

    def _part(self, text: str) -> bytes:
        return b"".join(map(self.match.__getitem__, self.matches(text)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = self.cut(text) if self.crowded(text) else text.split(" ")
        return self._part(parts[0]) + b"".join(map(self.rest.__getitem__, islice(parts, 1, None)))


#: Lead byte -> bytes of its character; 0 where no character begins.
WIDTH = [1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0 for b in range(256)]


class Utf8Stream:
    """Bytes arrive in any pieces; text leaves as soon as its characters are complete."""

    def __init__(self) -> None:
        self.open = b""

    def push(self, data: bytes) -> str:
        data = self.open + data
        keep = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 != 0x80:
                keep -= back if WIDTH[b] > back else 0
                break
        self.open = data[keep:]
        return data[:keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], token: dict[int, bytes], at_once: int = 4096) -> Iterator[str]:
    ids, stream = iter(ids), Utf8Stream()
    while some := list(islice(ids, at_once)):
        yield stream.push(b"".join(map(token.__getitem__, some)))
    yield stream.close()


def encoder(path: str, pattern: str) -> Encoder:
    return kept(f"transducer of {path} {pattern}", lambda: Encoder(path, pattern))


def encode(text: Column, path: str, pattern: str) -> Column:
    """array<int> of token ids."""

    def ids(texts: list[str | None]) -> list[np.ndarray]:
        e = encoder(path, pattern)
        return [np.frombuffer(e.encode(t), "<i4") for t in texts]

    return by_parts(ids, "array<int>", pa.list_(pa.int32()))(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The text of an array<int> of token ids; null for null."""

    def text(rows: list[list[int] | None]) -> list[str | None]:
        token = encoder(path, pattern).transducer.token
        return [None if r is None else "".join(decode_stream(r, token)) for r in rows]

    return by_parts(text, "string", pa.string())(ids)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode the ids, digest both in one pass."""

    def both(texts: list[str | None]) -> list[dict]:
        e, rows = encoder(path, pattern), []
        token = e.transducer.token
        for t in texts:
            ids = e.encode(t)
            decoded = hashlib.sha256()
            for part in decode_stream(np.frombuffer(ids, "<u4").tolist(), token):
                decoded.update(part.encode())
            rows.append({"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": decoded.hexdigest()})
        return rows

    digested = by_parts(both, "n_tokens long, ids_sha256 string, decoded_sha256 string", pa.struct({"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}))
    return docs.select("doc_id", digested(F.col("text")).alias("b")).select("doc_id", "b.*")
