"""Problem 8: encoding a whole corpus with a public byte-level BPE, by segment trees over adjacent pair ranks."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = os.environ.get("ROSTRA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.int64(2**62)  # key of a pair that can't be merged
_MANY = 24  # words from which a size class is encoded as one matrix of trees
_CELLS = 2_000_000  # tree cells of one matrix at most
_KEPT_IDS = 3_000_000  # ids of remembered words at most
_BATCH_BYTES = 8_000_000  # bytes of the texts that are encoded together


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: printable Latin-1 bytes stand for
    themselves, the others take the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


def load_tables(path: str = DEFAULT_TOKENIZER) -> dict[str, np.ndarray]:
    """Arrays of a byte-level BPE in the JSON format of the tokenizers library: id of each byte, and sorted by
    (left id, right id) the rank and the merged id of each pair. About 1 MB for 50,000 merges."""
    with open(path, encoding="utf8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    width = max(vocab.values()) + 1
    key = np.array([vocab[a] * width + vocab[b] for a, b in pairs], dtype=np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
    key, first = np.unique(key, return_index=True)  # of a pair given twice the first rank holds
    return {
        "bytes": np.array([vocab[c] for c in _byte_characters()], dtype=np.int64),
        "key": key, "rank": first.astype(np.int64), "merged": merged, "width": np.array([width], dtype=np.int64),
    }


class Encoder:
    """Encodes texts to ids. Of each distinct word (piece of the pre-tokenizer) one segment tree holds the ranks of
    the adjacent pairs, in every leaf rank and position as one key, in every inner node the smaller key of its
    children. The root is thus the leftmost pair of the lowest rank; a merge changes three leaves, whose paths to
    the root are updated, until no pair is left that can be merged. Words of like length are one matrix of trees
    whose merges run together; long or lone words have a tree of their own."""

    def __init__(self, tables: dict[str, np.ndarray]):
        self.bytes, self.key, self.rank, self.merged = (tables[k] for k in ("bytes", "key", "rank", "merged"))
        self.width = int(tables["width"][0])
        self.find = regex.compile(PATTERN).findall
        self._ranks: dict[int, int] | None = None
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.lengths, self.flat, self.kept = [], [], [], 0

    # ---- one tree per word
    def _encode_one(self, data: bytes) -> np.ndarray:
        if self._ranks is None:
            self._ranks = dict(zip(self.key.tolist(), self.rank.tolist(), strict=True))
        ranks, width, merged, none = self._ranks, self.width, self.merged, int(_NONE)
        ids = self.bytes[np.frombuffer(data, np.uint8)].tolist()
        n = len(ids)
        leaves = 1 << max(0, (n - 2).bit_length())
        shift = leaves.bit_length()
        mask = (1 << shift) - 1
        tree = [none] * (2 * leaves)

        def leaf(i: int, j: int) -> int:
            r = ranks.get(ids[i] * width + ids[j])
            return none if r is None else r << shift | i

        for i in range(n - 1):
            tree[leaves + i] = leaf(i, i + 1)
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, key: int) -> None:
            k = leaves + i
            tree[k] = key
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        while (top := tree[1]) != none:
            p = top & mask
            q = after[p]
            r = after[q]
            ids[p], ids[q], after[p] = int(merged[top >> shift]), -1, r
            if q < n - 1:
                put(q, none)
            if r < n:
                before[r] = p
                put(p, leaf(p, r))
            elif p < n - 1:
                put(p, none)
            if before[p] >= 0:
                put(before[p], leaf(before[p], p))
        return np.array([i for i in ids if i >= 0], dtype=np.int32)

    # ---- a matrix of trees
    def _keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
        pair = left * self.width + right
        i = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        ok = (left >= 0) & (right >= 0) & (self.key[i] == pair)
        return np.where(ok, self.rank[i] << shift | at, _NONE)

    def _encode_many(self, words: list[bytes], leaves: int) -> list[np.ndarray]:
        w, n = len(words), leaves + 1
        shift = leaves.bit_length()
        mask = (1 << shift) - 1
        sizes = np.fromiter(map(len, words), np.int64, w)
        ids = np.full((w, n + 1), -1, dtype=np.int64)  # the last column stands for the end
        ids[np.arange(n + 1) < sizes[:, None]] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        after = np.minimum(np.arange(1, n + 2), n).repeat(w).reshape(n + 1, w).T.copy()
        before = np.arange(-1, n).repeat(w).reshape(n + 1, w).T.copy()
        at = np.arange(leaves)
        tree = np.full((w, 2 * leaves), _NONE, dtype=np.int64)
        tree[:, leaves:] = self._keys(ids[:, :leaves], ids[:, 1 : leaves + 1], at, shift)
        k = leaves
        while k > 1:
            k >>= 1
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        rows = np.arange(w)
        while True:
            top = tree[rows, 1]
            alive = top < _NONE
            if not alive.all():
                rows, top = rows[alive], top[alive]
            if not len(rows):
                break
            p = top & mask
            q = after[rows, p]
            r = after[rows, q]
            ids[rows, p] = self.merged[top >> shift]
            ids[rows, q] = -1
            after[rows, p] = r
            before[rows, r] = p
            b = before[rows, p]
            has = b >= 0
            # leaves: the pair at q is gone, those at p and before p have a new member
            left = np.where(has, b, p)
            spots = np.stack([np.minimum(q, leaves - 1), np.minimum(p, leaves - 1), left])
            gone = np.where(q < leaves, _NONE, tree[rows, 2 * leaves - 1])
            fresh = self._keys(ids[rows, p], ids[rows, r], p, shift)
            prior = np.where(has, self._keys(ids[rows, left], ids[rows, p], left, shift), fresh)
            for spot, value in zip(spots, (gone, fresh, prior), strict=True):
                tree[rows, leaves + spot] = value
            k3, r3 = (spots + leaves) >> 1, np.broadcast_to(rows, spots.shape)
            while k3[0, 0] >= 1:
                tree[r3, k3] = np.minimum(tree[r3, 2 * k3], tree[r3, 2 * k3 + 1])
                k3 = k3 >> 1
        ids = ids[:, :n]
        kept = ids >= 0
        ends = np.cumsum(kept.sum(axis=1))[:-1]
        return np.split(ids[kept].astype(np.int32), ends)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        classes: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) == 1:
                out[i] = self.bytes[np.frombuffer(word, np.uint8)].astype(np.int32)
            else:
                classes.setdefault(1 << (len(word) - 2).bit_length(), []).append(i)
        for leaves, members in classes.items():
            step = max(1, _CELLS // (2 * leaves))
            if min(step, len(members)) < _MANY:
                for i in members:
                    out[i] = self._encode_one(words[i])
                continue
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._encode_many([words[i] for i in part], leaves), strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each). Null and empty texts have none."""
        pieces = [self.find(t) if t else [] for t in texts]
        if self.kept > _KEPT_IDS:
            self._forget()
        fresh = list({w for p in pieces for w in p if w not in self.index})
        for word, ids in zip(fresh, self.encode_words([w.encode("utf8") for w in fresh]), strict=True):
            self.index[word] = len(self.starts)
            self.starts.append(self.kept)
            self.lengths.append(len(ids))
            self.flat.append(ids)
            self.kept += len(ids)
        if len(self.flat) > 1:
            self.flat = [np.concatenate(self.flat)]
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.fromiter((self.index[w] for p in pieces for w in p), np.int64, int(counts.sum()))
        if not len(at):
            return np.empty(0, np.int32), np.zeros(len(pieces), np.int64)
        starts, lengths = np.array(self.starts)[at], np.array(self.lengths)[at]
        ends = np.cumsum(lengths)
        ids = self.flat[0][np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]
        total = np.concatenate([[0], ends])
        bounds = total[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds)


def byte_runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about _BATCH_BYTES together; only these become Python strings at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + _BATCH_BYTES)) + 1
        yield start, min(end, len(texts))
        start = end


def _encoded(df: DataFrame, id_column: str, text_column: str, tokenizer: str, counts_only: bool) -> DataFrame:
    tables = df.sparkSession.sparkContext.broadcast(load_tables(tokenizer))  # size is that of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo, hi in byte_runs(texts):
                ids, counts = encoder.encode(texts.slice(lo, hi - lo).to_pylist())
                if counts_only:
                    value = pa.array(counts, pa.int64())
                else:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    value = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), value], names=["id", "value"])

    # the key's own name may be anything, also "id" or "value"
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("value"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, value {'bigint' if counts_only else 'array<int>'}")


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(id_column, ids): token ids of every text, without special tokens (their strings are ordinary text).

    Null and empty texts have an empty list; repeated rows give repeated rows; further columns of any name are
    ignored; no text is cut. No shuffle: one pass over the table. The vocabulary is read on the driver, so the file
    needs to exist there only.
    """
    return _encoded(df, id_column, text_column, tokenizer, False).select(F.col("id").alias(id_column), F.col("value").alias("ids"))


def count_tokens(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(id_column, tokens): number of ids of every text; 0 for null and empty texts."""
    return _encoded(df, id_column, text_column, tokenizer, True).select(F.col("id").alias(id_column), F.col("value").alias("tokens"))
