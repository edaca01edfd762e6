"""Byte-level BPE: exact merges in linear time over an Aho-Corasick automaton, and decoding."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Characters of a text that are taken apart at a time.
LONG = 1 << 20


class Codec:
    """A vocabulary of ranks; encodes and decodes bytes.

    Bytes are mapped to Latin-1 so that the automaton sees one character a byte. From the longest match at a
    position the encoder backs off to shorter ones; a token may follow another only if merging their joined bytes by rank
    gives those two tokens again. Texts that no choice fits never occur, since single bytes are tokens.
    memo: bytes, about, of the pieces and of the borders that are remembered; each memory is dropped by halves, the older one first.
    """

    def __init__(self, path: str, pattern: str, memo: int = 96 << 20):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.rank = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.bytes = {v: k for k, v in ranks.items()}
        self.text = {v: k for k, v in self.rank.items()}
        self.find, self.matches = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.automaton = ahocorasick.Automaton()
        for s, v in self.rank.items():
            self.automaton.add_word(s, (len(s), v))
        self.automaton.make_automaton()
        self.size = {v: len(k) for k, v in ranks.items()}
        self.prefix: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}
        self.memo: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}
        self.held, self.most, self.most_fits = 0, memo // 2, memo // 128

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; itself twice for a token that no merge makes."""
        found = self.halves.get(token)
        if found is None:
            parts = self._merge(self.text[token], token)
            found = self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
        return found

    def _merge(self, s: str, below: int) -> list[int]:
        """Plain merging by rank, with ranks under a limit; only for single tokens, so it is short."""
        parts = list(s)
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between the two tokens alone. Memoised."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.most_fits:
                self.fits.clear()
            known = self.fits[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        """Undoes the merges next to the border, latest first. The border falls if the two pieces there
        would merge before the merge that was undone last took place."""
        rank, text = self.rank, self.text
        before = (1 << 62, 0)  # rank of the merge undone last; 1 if it stood right of the border, so later among equals
        while True:
            joined = rank.get(text[left] + text[right])
            if joined is not None and (joined, 0.5) < before:
                return False
            l_parts, r_parts = self._halves(left), self._halves(right)
            l_whole, r_whole = l_parts[0] == left, r_parts[0] == right
            if l_whole and r_whole:
                return True
            if r_whole or (not l_whole and left > right):
                before, left = (left, 0), l_parts[1]
            else:
                before, right = (right, 1), r_parts[0]

    def _shorter(self, token: int) -> int:
        """The longest token that this one begins with, other than itself; -1 if it is a single byte."""
        found = self.prefix.get(token)
        if found is None:
            s = self.text[token]
            found = self.prefix[token] = next((self.rank[s[:i]] for i in range(len(s) - 1, 0, -1) if s[:i] in self.rank), -1)
        return found

    def _search(self, s: str) -> list[int]:
        n = len(s)
        longest = [-1] * n
        for end, (length, token) in self.automaton.iter(s):
            longest[end - length + 1] = token  # ends ascend, so the last one at a start is the longest
        sizes, fits = self.size, self.fits
        at, token, last = 0, longest[0], -1
        dead = bytearray(n + 1)
        path: list[int] = []
        while at < n:
            while token >= 0:
                if not dead[at + sizes[token]]:
                    if last < 0:
                        break
                    good = fits.get(last << 32 | token)
                    if self.follows(last, token) if good is None else good:
                        break
                token = self._shorter(token)
            if token >= 0:
                path.append(token)
                last = token
                at += sizes[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                if not path:
                    return self._merge(s, 1 << 62)
                token = path.pop()
                at -= sizes[token]
                last = path[-1] if path else -1
        return path

    def piece(self, s: str) -> tuple[tuple[int, ...], str]:
        """Ids of one match of the pattern, and their decimal text. Memoised: words repeat."""
        found = self.memo.get(s)
        if found is None:
            found = self.older.get(s)
            if found is None:
                raw = s.encode("utf-8", "surrogatepass").decode("latin-1")
                whole = self.rank.get(raw)
                ids = (whole,) if whole is not None else tuple(self._search(raw))
                found = (ids, ",".join(map(str, ids)))
            if len(s) <= 64:
                if self.held >= self.most:
                    self.older, self.memo, self.held = self.memo, {}, 0
                self.memo[s] = found
                self.held += 300 + 4 * len(s)
        return found

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.piece(s)[0] for s in self.find(text or "")))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def _blocks(self, text: str):
        """The matches of the pattern, in lists of bounded length."""
        if len(text) <= LONG:
            yield self.find(text)
            return
        matches = (m.group() for m in self.matches(text))
        while block := list(islice(matches, LONG // 8)):
            yield block

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the bytes that the ids decode to. A long text is never held as one list."""
        n, listed, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for block in self._blocks(text or ""):
            pieces = [self.memo.get(s) or self.piece(s) for s in block]
            ids = list(chain.from_iterable([p[0] for p in pieces]))
            if n and ids:
                listed.update(b",")
            n += len(ids)
            listed.update(",".join([p[1] for p in pieces]).encode())
            decoded.update(self.decode(ids))
        return n, listed.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string: the tokens of every text and what they decode to. Null text: no ids."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            ids = [c.encode(t.as_py()) for t in b.column(1)]
            back = [c.decode(x).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row, no shuffle. Null and empty text: no
    tokens, digests of nothing. Repeated rows and null ids give a row each."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            rows = [c.digest(t.as_py()) for t in b.column(1)]
            n, ids, back = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
