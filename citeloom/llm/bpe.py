"""Operator 1: byte-level BPE encoding and decoding.

Encoding is the backtracking form: an Aho-Corasick automaton over the vocabulary
gives the longest token that starts at each byte, and a pair-compatibility test
(would merging the two tokens' text ever cross their border?) accepts or rejects
each step. A position from which no way leads on is marked and never tried again,
so the work is linear in the text and the result is exactly that of applying the
merges by rank. The pre-tokens of natural text repeat, so a bounded cache keeps
their ids. Decoding concatenates slices of one byte table by an offset table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from citeloom.llm.common import ensure_path, table

#: Fixed: the published pre-tokenization pattern of this vocabulary.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def printable_bytes() -> dict[str, int]:
    """The published one-to-one map from the vocabulary's printable characters to bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairCodec:
    """Encoder and decoder of one vocabulary file (byte-level BPE, JSON)."""

    def __init__(self, path: str, cache_size: int = 150_000, cache_bytes: int = 64):
        with open(ensure_path(path), encoding="utf-8") as f:
            spec = json.load(f)
        of = printable_bytes()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        raw = {i: bytes(of[c] for c in s) for s, i in vocab.items() if s not in self.special}
        size = max([*raw, *self.special.values()]) + 1
        self.pieces: list[bytes | None] = [None] * size
        for i, b in raw.items():
            self.pieces[i] = b
        self.id_of = {b: i for i, b in raw.items()}
        #: pair -> (rank, merged id), and for each token the pair it is merged from.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank_of: dict[int, int] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merge[a, b] = (rank, c)
            if c not in self.parts:
                self.parts[c], self.rank_of[c] = (a, b), rank
        # The vocabulary as text of one character per byte, which is what the automaton walks.
        self.machine = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.machine.add_word(b.decode("latin-1"), (len(b) - 1, i))
        self.machine.make_automaton()
        #: For each token its longest proper prefix that is a token (-1: none).
        self.shorter: dict[int, int] = {}
        for b, i in self.id_of.items():
            k = len(b) - 1
            while k and b[:k] not in self.id_of:
                k -= 1
            self.shorter[i] = self.id_of[b[:k]] if k else -1
        self.compatible: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_size, self.cache_bytes = cache_size, cache_bytes
        self.pattern = regex.compile(PRETOKEN)
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        # Offset table: token i is data[offset[i]:offset[i + 1]].
        by_id = [b or b"" for b in self.pieces]
        for s, i in self.special.items():
            by_id[i] = s.encode()
        self.data = np.frombuffer(b"".join(by_id), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(b) for b in by_id])]).astype(np.int64)

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether left, right side by side stay as they are: no merge crosses their border.

        Undo merges from the later one: if at any moment the two tokens at the
        border could have merged before either was built, the pair can't occur.
        """
        key = (left, right)
        known = self.compatible.get(key)
        if known is not None:
            return known
        limit, a, b = 1 << 60, left, right
        fits = True
        while True:
            m = self.merge.get((a, b))
            if m is not None and m[0] < limit:
                fits = False
                break
            # Undo the later of the two last merges; equal merges ran from left to
            # right, so one of the same rank as the right token's own counts too.
            ra, rb = self.rank_of.get(a, -1), self.rank_of.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1, self.parts[b][0]
        if len(self.compatible) >= 100_000:
            self.compatible.clear()
        self.compatible[key] = fits
        return fits

    def longest_at(self, piece: str) -> list[int]:
        """For each position the longest token that starts there."""
        best = [-1] * len(piece)
        # Matches come in the order of their ends: of those with one start the last is the longest.
        for end, (back, i) in self.machine.iter(piece):
            best[end - back] = i
        return best

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        whole = self.id_of.get(piece)
        if whole is not None:
            return (whole,)  # the longest match of all, with no pair to check
        best = self.longest_at(piece.decode("latin-1"))
        n, pos, nxt, out = len(piece), 0, best[0], []
        dead = bytearray(n + 1)
        pieces, shorter, fits = self.pieces, self.shorter, self.pair_fits
        while pos < n:
            end = pos + len(pieces[nxt])
            if not dead[end] and (not out or fits(out[-1], nxt)):
                out.append(nxt)
                pos = end
                if pos < n:
                    nxt = best[pos]
            elif shorter[nxt] >= 0:
                nxt = shorter[nxt]
            else:
                # Nothing leads on from here: never come back, and retry the token before.
                dead[pos] = 1
                nxt = out.pop()
                pos -= len(pieces[nxt])
        return tuple(out)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text (None: none) as uint32; special tokens' strings become their ids."""
        if not text:
            return np.empty(0, np.uint32)
        ids: list[int] = []
        cache, get = self.cache, self.cache.get
        for part in self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else (text,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            for w in self.pattern.findall(part):
                got = get(w)
                if got is None:
                    got = self.encode_piece(w.encode("utf-8"))
                    if len(w) <= self.cache_bytes:
                        if len(cache) >= self.cache_size:
                            cache.clear()
                        cache[w] = got
                ids += got
        return np.array(ids, np.uint32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        if not ids.size:
            return b""
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(size)
        take = np.repeat(start - (ends - size), size) + np.arange(ends[-1])
        return self.data[take].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_codecs: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    """One codec per Python worker and file."""
    if path not in _codecs:
        _codecs[path] = BytePairCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = True, text: str = "text") -> DataFrame:
    """Add n_tokens, token_ids (array<int>, if with_ids), ids_sha256 and decoded_sha256 to every row.

    A null text counts as empty (0 tokens, the digests of nothing); rows repeat as
    they come; other columns stay, except that columns named like the added ones
    are replaced. One map over the rows, no shuffle; memory is that of one Arrow
    batch plus the bounded caches.
    """
    path = ensure_path(vocabulary or default_vocabulary())
    added = ["n_tokens long", *(["token_ids array<int>"] if with_ids else []), "ids_sha256 string", "decoded_sha256 string"]
    names = [a.split(" ")[0] for a in added]
    base = docs.drop(*names)
    from pyspark.sql import types as T

    schema = T.StructType([*base.schema.fields, *T._parse_datatype_string(", ".join(added)).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                pdf = batch.iloc[at : at + 1000]
                n, ids_hex, text_hex, arrays = [], [], [], []
                for t in pdf[text]:
                    ids = c.encode(t)
                    n.append(len(ids))
                    ids_hex.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_hex.append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
                    if with_ids:
                        arrays.append(ids.astype(np.int32))
                pdf = pdf.assign(n_tokens=np.array(n, np.int64), ids_sha256=ids_hex, decoded_sha256=text_hex)
                if with_ids:
                    pdf["token_ids"] = pd.Series(arrays, index=pdf.index, dtype=object)
                yield pdf[[f.name for f in schema.fields]]

    return base.mapInPandas(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, with_ids=False).drop("text")
