"""Unigram pieces: Viterbi over a double-array trie, with byte fallback.

The best segmentation of a text is found by dynamic programming over the pieces
that start at each character, which a double-array trie lists byte by byte.
Where no piece has a white-space marker after another character, the text falls
apart at its markers and each word is solved once. Characters that no piece
holds become byte pieces. Decoding joins pieces, bytes included, and turns
markers back into spaces.

Scores are natural logarithms of probabilities that sum to 1 over the normal
pieces. The public file at hand has merge ranks instead, and tokenizers aren't
trained here, so ``log_scores`` derives probabilities from the ranks by the
Zipf-Mandelbrot law: merges are made in order of frequency, and the r-th most
frequent piece has a probability in proportion to 1 / (r + OFFSET). Files that have
log scores are taken as they are.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logdistill.llm.common import PieceCache, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Below the lowest piece's score, for a character that no piece holds.
UNKNOWN_PENALTY = 10.0
#: Mandelbrot's offset of the rank.
OFFSET = 2.7


def log_scores(ranked: list[float]) -> np.ndarray:
    """Log probabilities of pieces whose scores only rank them, the greatest first; equal scores rank in the order given."""
    place = np.empty(len(ranked))
    place[np.argsort(-np.asarray(ranked, dtype=float), kind="stable")] = np.arange(len(ranked))
    p = 1 / (place + 1 + OFFSET)
    return np.log(p / p.sum())


class DoubleArray:
    """Byte trie in two arrays: the child of node s by byte c is t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, words: dict[bytes, int]):
        self.base, self.check, self.value = array("i", [0]), array("i", [-2]), array("i", [-1])
        tree: dict = {}
        for word, number in words.items():
            node = tree
            for c in word:
                node = node.setdefault(c, {})
            node[-1] = number
        waiting, lowest, roomy = [(0, tree)], 1, 1
        for state, node in waiting:
            if -1 in node:
                self.value[state] = node.pop(-1)
            if not node:
                continue
            keys = sorted(node)
            while lowest < len(self.check) and self.check[lowest] != -1:
                lowest += 1
            # Several children need a gap of their shape; where gaps were hard to find, the search isn't begun again.
            begin = (lowest if len(keys) == 1 else max(lowest, roomy)) - keys[0] - 1
            base = begin
            while True:
                self._reach(base + keys[-1] + 2)
                if all(self.check[base + c + 1] == -1 for c in keys):
                    break
                base += 1
            if base - begin > 64:
                roomy = base + keys[0] + 1 - 32
            self.base[state] = base
            for c in keys:
                self.check[base + c + 1] = state
                waiting.append((base + c + 1, node[c]))
        # A step never leaves the arrays: the end is free, and a base is above -257, so a negative t is read there as well.
        self._reach(max(len(self.check), max(self.base)) + 514)

    def _reach(self, n: int) -> None:
        more = n - len(self.check)
        if more > 0:
            self.base.extend([0] * more)
            self.check.extend([-1] * more)
            self.value.extend([-1] * more)


class Unigram:
    """Pieces with log scores. ``pieces``: (text, score, kind) by id; kind is normal, byte, control or unknown."""

    def __init__(self, pieces: list[tuple[str, float, str]], dummy_prefix: bool = True):
        self.dummy_prefix = dummy_prefix
        normal = {p.encode(): i for i, (p, _, kind) in enumerate(pieces) if kind == "normal" and p}
        self.trie = DoubleArray(normal)
        self.scores = [s for _, s, _ in pieces]
        self.unknown_score = min((pieces[i][1] for i in normal.values()), default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = next((i for i, x in enumerate(pieces) if x[2] == "unknown"), 0)
        by_byte = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.bytes = [by_byte[b] for b in range(256)] if len(by_byte) == 256 else None
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in pieces if kind == "normal")
        out = {"control": b"", "unknown": " ⁇ ".encode()}
        self.texts = [
            bytes([int(p[1:-1], 16)]) if kind == "byte" else out.get(kind, p.replace(MARK, " ").encode()) for p, _, kind in pieces
        ]
        self.is_byte = np.array([kind in ("byte", "unknown") for *_, kind in pieces])
        self._cache: PieceCache | None = None
        self._numpy: tuple | None = None

    @classmethod
    def load(cls, path: str = MODEL, dummy_prefix: bool = True, ranked: bool = True) -> Unigram:
        """Pieces of a model file. ``ranked``: its scores are merge ranks; else they are log scores, whose probabilities must sum to 1."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)

        def kind(i: int) -> str:
            return "byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unused(i) else "unknown" if m.is_unknown(i) else "normal"

        kinds = [kind(i) for i in range(m.get_piece_size())]
        scores = [m.get_score(i) for i in range(len(kinds))]
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        if ranked:
            for i, s in zip(normal, log_scores([scores[i] for i in normal]).tolist()):
                scores[i] = s
        elif abs(sum(math.exp(scores[i]) for i in normal) - 1) > 0.05:
            raise ValueError(f"{path} has no log scores: their probabilities don't sum to 1")
        return cls([(m.id_to_piece(i), s, k) for i, (s, k) in enumerate(zip(scores, kinds))], dummy_prefix)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_cache": None, "_numpy": None}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the segmentation of highest total score; of equal ones, the one whose last differing piece starts first."""
        data = text.encode("utf-8", "replace")
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(data)
        none = float("-inf")
        best, start, piece = [none] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == none:
                continue
            first = data[i]
            width = i + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            node, j = 0, i
            while j < n:
                t = base[node] + data[j] + 1
                if check[t] != node:
                    break
                node = t
                j += 1
                p = value[node]
                if p >= 0 and here + scores[p] > best[j]:
                    best[j], start[j], piece[j] = here + scores[p], i, p
            if best[width] == none or start[width] != i and here + self.unknown_score > best[width]:
                best[width], start[width], piece[width] = here + self.unknown_score, i, -1
        out: list[int] = []
        at = n
        while at:
            i = start[at]
            if piece[at] >= 0:
                out.append(piece[at])
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(data[i:at]))
            else:
                out.append(self.unknown_id)
            at = i
        return out[::-1]

    def viterbi_many(self, words: list[str]) -> list[bytes]:
        """int32 ids of each word, as bytes: the same recurrence as ``viterbi``, a step for all words at once."""
        coded = [w.encode("utf-8", "replace") for w in words]
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(coded):
            groups.setdefault(len(w) if len(w) < 16 else len(w) + 7 & ~7, []).append(k)
        for n, members in groups.items():
            for at in range(0, len(members), 20_000):
                part = members[at : at + 20_000]
                if n > 64 or len(part) < 4:
                    for k in part:
                        out[k] = np.array(self.viterbi(words[k]), dtype="<i4").tobytes()
                elif n:
                    for k, x in zip(part, self._viterbi_block([coded[k] for k in part], n)):
                        out[k] = np.array(self.viterbi(words[k]), dtype="<i4").tobytes() if x is None else x
        return out

    def _viterbi_block(self, coded: list[bytes], n: int) -> list[bytes | None]:
        """For words of up to n bytes; None for those that need byte fallback."""
        base, check, value, scores, widths = self._arrays()
        length = np.array([len(w) for w in coded])
        data = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in coded), dtype=np.uint8).reshape(len(coded), n).T.astype(np.int32)
        none = -np.inf
        best = np.full((n + 1, len(coded)), none)
        best[0] = 0.0
        start = np.zeros((n + 1, len(coded)), dtype=np.int32)
        piece = np.full((n + 1, len(coded)), -1, dtype=np.int32)
        for i in range(n):
            idx = begun = np.flatnonzero((best[i] > none) & (length > i))
            if not idx.size:
                continue
            here = from_here = best[i, idx]
            node = np.zeros(idx.size, dtype=np.int32)
            for j in range(i, n):
                t = base[node] + data[j, idx] + 1
                ok = (check[t] == node) & (length[idx] > j)
                idx, node, here = idx[ok], t[ok], here[ok]
                if not idx.size:
                    break
                v = value[node]
                total = here + scores[v]
                better = (v >= 0) & (total > best[j + 1, idx])
                to = idx[better]
                best[j + 1, to], start[j + 1, to], piece[j + 1, to] = total[better], i, v[better]
            end = i + widths[data[i, begun]]
            total = from_here + self.unknown_score
            known = best[end, begun]
            lone = (known == none) | (start[end, begun] != i) & (total > known)
            to, end = begun[lone], end[lone]
            best[end, to], start[end, to], piece[end, to] = total[lone], i, -1
        ids = np.zeros((len(coded), n), dtype="<i4")
        at, left, count = length.copy(), np.arange(len(coded)), np.zeros(len(coded), dtype=np.int64)
        unknown = np.zeros(len(coded), dtype=bool)
        by_byte = np.array(self.bytes or [-1] * 256, dtype=np.int32)
        while left.size:
            p = piece[at[left], left]
            lone = p < 0
            if lone.any():  # one byte is known here; characters of several are left to viterbi
                begun = start[at[left], left]
                short = lone & (at[left] - begun == 1) & (self.bytes is not None)
                if self.bytes is not None:
                    p = np.where(short, by_byte[data[begun, left]], p)
                unknown[left[lone & ~short]] = True
            count[left] += 1
            ids[left, n - count[left]] = p
            at[left] = start[at[left], left]
            left = left[at[left] > 0]
        flat = ids.tobytes()
        return [None if u else flat[4 * (k * n + n - c) : 4 * (k + 1) * n] for k, (c, u) in enumerate(zip(count.tolist(), unknown.tolist()))]

    def _arrays(self):
        if self._numpy is None:
            widths = np.array([1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)], dtype=np.int64)
            self._numpy = (*(np.array(x, dtype=np.int32) for x in (self.trie.base, self.trie.check, self.trie.value)), np.array(self.scores), widths)
        return self._numpy

    def _words(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = text.replace(MARK, " ")
        if self.dummy_prefix:
            text = " " + text
        if not self.splits:
            return [text.replace(" ", MARK)]
        if "  " in text or not self.dummy_prefix:
            return [w.replace(" ", MARK) for w in re.findall(" +[^ ]*|^[^ ]+", text)]
        return [MARK + w for w in text[1:].split(" ")]

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian int32 ids of each whole text; null and empty texts have none."""
        if self._cache is None:
            self._cache = PieceCache(self.viterbi_many)
        return self._cache.join_all([self._words(t) for t in texts])

    def decode(self, ids: list[int]) -> str:
        """Text of ids: markers are spaces, the one put before the text goes; bytes that form no character become U+FFFD."""
        out = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out.startswith(" ") else out


def encode(docs: DataFrame, model: Unigram, check: bool = True) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ids, n_ids, n_byte_ids, and round_trip (if the decoded ids are the text; markers in a text decode as spaces). A null text has no ids and decodes as empty.

    Null and repeated ids come back as they are; extra columns are ignored; an empty
    table gives an empty result. Of segmentations with equal scores ``viterbi`` says
    which counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is the vocabulary's
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("n_byte_ids", pa.int64()), ("round_trip", pa.bool_())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(it):
            if b.num_rows:
                texts = b.column("text").to_pylist()
                found = [np.frombuffer(x, dtype="<i4") for x in m.ids_of(texts)]
                same = [m.decode(x.tolist()) == (t or "").replace(MARK, " ") for t, x in zip(texts, found)] if check else [None] * len(found)
                lengths = [len(x) for x in found]
                flat = np.concatenate(found)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i4")
                fallback = [int(m.is_byte[x].sum()) for x in found]
                arrays = [
                    b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(lengths, pa.int64()), pa.array(fallback, pa.int64()), pa.array(same, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    ddl = "doc_id long, ids array<int>, n_ids long, n_byte_ids long, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches, ddl)


def decode(encoded: DataFrame, model: Unigram, ids: str = "ids") -> DataFrame:
    """doc_id and decoded text of each row of ``encoded(doc_id, ids)``; null ids give a null text, no ids an empty one. Null and repeated doc_ids come back as they are; an empty table gives an empty result."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [None if x is None else shared.value.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col(ids).alias("ids")).mapInArrow(batches, "doc_id long, text string")
