"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The vocabulary is a public tokenizer file (byte-level BPE); nothing is trained. A text is cut into words by the
tokenizer's own pattern; each word starts as its bytes, and a segment tree over the ranks of adjacent symbol
pairs yields at its root the leftmost pair of the lowest rank. A merge rewrites three leaves (the merged pair
and its two neighbours) and their paths to the root, until the root holds no mergeable pair. Words of like
length share one forest of trees held as NumPy arrays, so each step advances every unfinished word at once;
very long words walk a single tree. A bounded cache keeps the words met before.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from .common import chunks, lean, small_batches, utf8

#: Code points outside these ranges may be classed differently by the two pattern engines' Unicode versions.
_UNSURE = regex.compile("[^\x00-՗ऀ-௿฀-໿Ḁ-ⁿ₠-₿℀-↋←-⏿─-⯿　-〿ぁ-ゖ゛-ヿ㐀-鿼가-힣！-￮]")
_NONE = np.iinfo(np.int64).max
#: Symbols up to which words share a forest.
_FOREST_WIDTH = 64
_CACHE_WORDS = 600_000
#: Longer texts are cut into pieces of about so many characters.
_PIECE_CHARS = 500_000
_CUT = regex.compile(r"(?<=\S) ")


class SegmentTreeBPE:
    """Encoder and decoder for one tokenizer file. ``encode`` and ``decode`` work on ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        # The byte alphabet of byte-level BPE: printable bytes stand for themselves, the rest follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        bytes_of = {c: b for b, c in chars.items()}
        self.byte_ids = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in merges]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.specials.values()])
        self.pieces = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(bytes_of[c] for c in token)
        for token, i in self.specials.items():
            self.pieces[i] = token.encode()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.own_split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.cache: dict[str, bytes] = {}

    # words ------------------------------------------------------------------------------------------------
    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text without special tokens, in runs."""
        at = 0
        while at < len(text):
            # No word spans a space after something else, so long texts are cut there.
            cut = _CUT.search(text, at + _PIECE_CHARS) if len(text) - at > 2 * _PIECE_CHARS else None
            part = text[at:cut.start()] if cut else text[at:]
            at += len(part)
            if _UNSURE.search(part):
                yield [part[i:j] for _, (i, j) in self.own_split.pre_tokenize_str(part)]
            else:
                yield self.pattern.findall(part)

    def _learn(self, missing: list[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in missing]
        by_width: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            by_width.setdefault(max(2, 1 << max(0, len(b) - 2).bit_length()), []).append(i)
        for width, rows in by_width.items():
            if width > _FOREST_WIDTH:
                for i in rows:
                    self.cache[missing[i]] = self._one_tree(raw[i])
            else:
                for at in range(0, len(rows), 50_000):
                    part = rows[at:at + 50_000]
                    for i, ids in zip(part, self._forest([raw[i] for i in part], width)):
                        self.cache[missing[i]] = ids

    # merging ----------------------------------------------------------------------------------------------
    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def _forest(self, words: list[bytes], width: int) -> list[bytes]:
        """Merge words of up to ``width + 1`` bytes together: row k of ``tree`` is node k of each word's segment tree."""
        n, lengths = len(words), np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(w.ljust(width + 1, b"\0") for w in words), np.uint8).reshape(n, width + 1)
        symbols = self.byte_ids[flat].T.copy()  # symbols[position, word]
        spot = np.arange(width + 1)[:, None]
        symbols[spot >= lengths[None, :]] = -1
        follow = np.where(spot + 1 < lengths[None, :], spot + 1, width + 1).astype(np.int64)
        before = np.broadcast_to(spot - 1, (width + 1, n)).astype(np.int64).copy()
        shift = width.bit_length() - 1
        ranks = self._look_up(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(width, n)
        tree = np.full((2 * width, n), _NONE, np.int64)
        tree[width:] = np.where(ranks >= 0, (ranks << shift) | spot[:width], _NONE)
        for k in range(width - 1, 0, -1):
            np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])

        def put(position: np.ndarray, word: np.ndarray, value: np.ndarray) -> None:
            node = position + width
            tree[node, word] = value
            for _ in range(shift):
                node >>= 1
                tree[node, word] = np.minimum(tree[2 * node, word], tree[2 * node + 1, word])

        def leaf(left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
            rank = self._look_up(left, right)
            return np.where(rank >= 0, (rank << shift) | position, _NONE)

        live = np.flatnonzero(tree[1] != _NONE)
        while len(live):
            root = tree[1, live]
            at, merged = root & (width - 1), self.made[root >> shift]
            gone = follow[at, live]
            after = follow[gone, live]
            symbols[at, live] = merged
            symbols[gone, live] = -1
            follow[at, live] = after
            has = after <= width
            before[after[has], live[has]] = at[has]
            inner = gone < width
            put(gone[inner], live[inner], np.full(int(inner.sum()), _NONE))
            right = np.where(has, symbols[np.minimum(after, width), live], -1)
            kept = at < width
            put(at[kept], live[kept], leaf(merged, right, at)[kept])
            prior = before[at, live]
            some = prior >= 0
            put(prior[some], live[some], leaf(symbols[prior[some], live[some]], merged[some], prior[some]))
            live = live[tree[1, live] != _NONE]
        done = symbols.T
        kept = done >= 0
        ids, ends = done[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _one_tree(self, word: bytes) -> bytes:
        """The same merge loop on a single tree, for long words."""
        symbols = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, ranks, made = len(symbols), self.rank_of, self.made.tolist()
        width = 1 << max(1, (n - 1).bit_length())
        none = _NONE
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = ranks.get((symbols[i] << 32) | symbols[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        follow, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(position: int, value: int) -> None:
            node = position + width
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                best = a if a < b else b
                if tree[node] == best:
                    break
                tree[node] = best
                node >>= 1

        while tree[1] != none:
            rank, at = divmod(tree[1], width)
            gone = follow[at]
            after = follow[gone]
            symbols[at], symbols[gone] = made[rank], -1
            follow[at] = after
            if after < n:
                before[after] = at
            put(gone, none)
            rank = ranks.get((symbols[at] << 32) | symbols[after]) if after < n else None
            put(at, none if rank is None else rank * width + at)
            if (prior := before[at]) >= 0:
                rank = ranks.get((symbols[prior] << 32) | symbols[at])
                put(prior, none if rank is None else rank * width + prior)
        return np.array([s for s in symbols if s >= 0], "<u4").tobytes()

    # texts ------------------------------------------------------------------------------------------------
    def _runs(self, text: str) -> Iterator[list[str] | bytes]:
        parts = self.special_split.split(text) if self.special_split else [text]
        for part in parts:
            if part in self.specials:
                yield np.array([self.specials[part]], "<u4").tobytes()
            elif part:
                yield from self.words(part)

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text, piece by piece."""
        for run in self._runs(text):
            if isinstance(run, bytes):
                yield run
                continue
            cache = self.cache
            if missing := {w for w in run if w not in cache}:
                if len(cache) + len(missing) > _CACHE_WORDS:
                    cache.clear()
                    missing = set(run)
                self._learn(list(missing))
            yield b"".join(map(cache.__getitem__, run))

    def warm(self, texts: list[str]) -> None:
        """Learn the words of many texts in one forest."""
        missing = {w for t in texts if len(t) < 2 * _PIECE_CHARS for run in self._runs(t) if not isinstance(run, bytes) for w in run if w not in self.cache}
        if missing:
            if len(self.cache) + len(missing) > _CACHE_WORDS:
                self.cache.clear()
            self._learn(list(missing))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the pieces; the decoded text is these bytes as UTF-8, ill-formed runs replaced."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def codec(path: str) -> SegmentTreeBPE:
    return SegmentTreeBPE(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode every whole text.

    Returns ``doc_id, n_tokens, ids, ids_sha256, decoded_sha256``: ids as little-endian uint32 bytes (null with
    ``keep_ids=False``), the digests over these bytes and over the text decoded from them. A null text is the
    empty text (0 tokens); a null id stays null; repeated rows are encoded each; other columns are ignored but for those
    named in ``carry``, which follow as they are; an empty table gives an empty table. Special-token strings in a text are
    encoded as these tokens, as the tokenizer library does by default. No shuffle; memory is bounded by one
    Arrow batch, one document and a cache of bounded size.
    """
    path = tokenizer or tokenizer_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            sizes = np.diff(np.frombuffer(batch.column(1).cast(pa.large_binary()).buffers()[1], np.int64, batch.num_rows + 1)) if batch.num_rows else np.zeros(0, np.int64)
            for a, b in chunks(sizes):
                part = batch.slice(a, b - a)
                texts = [t.decode("utf-8", "replace") for t in part.column(1).cast(pa.binary()).to_pylist()]
                bpe.warm(texts)
                rows: tuple[list, ...] = ([], [], [], [])
                for text in texts:
                    said, back, count, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                    tail = b""
                    for ids in bpe.encode(text):
                        said.update(ids)
                        count += len(ids) // 4
                        raw = tail + bpe.decode(ids)
                        cut = _whole(raw)
                        back.update(raw[:cut].decode("utf-8", "replace").encode())
                        tail = raw[cut:]
                        if keep_ids:
                            kept.append(ids)
                    back.update(tail.decode("utf-8", "replace").encode())
                    for out, value in zip(rows, (count, b"".join(kept) if keep_ids else None, said.hexdigest(), back.hexdigest())):
                        out.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string()), *part.columns[2:]], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", *carry])
        bpe.cache.clear()  # an idle worker holds no words

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"), *carry)
    made = T.StructType.fromDDL("doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
    return rows.mapInArrow(lean(run), T.StructType([*made.fields, *[docs.schema[c] for c in carry]]))


def _whole(raw: bytes) -> int:
    """Bytes up to the last character that may still be open."""
    for back in range(1, min(4, len(raw)) + 1):
        lead = raw[-back]
        if lead < 0x80:
            return len(raw)
        if lead >= 0xC0:
            return len(raw) - back if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) else len(raw)
    return len(raw)
