"""SentencePiece encoding and decoding by vectorised merge rounds.

The distinct new words of a block of texts are laid out as one flat array of symbols, cut into segments where no piece of the
model spans two neighbouring characters. Each round looks up the smallest pair rank of every segment, merges its places from
left to right in all segments at once, and compacts the array; segments in which no pair is left are set aside. A rank's
places are merged in one round up to and including the first that makes a pair of the same or a better rank, as that pair
comes next in its segment. Finished words are kept for later blocks, up to a bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import blocks
from .common import kept, table, tidied

#: Words kept in a worker, in two generations of half as many, none longer than so many characters.
KEPT_WORDS, LONGEST_KEPT = 300_000, 64
#: The stand-in for a space, and the piece types of the model format: ordinary, unknown, control, byte (fixed values).
SPACE, NORMAL, UNKNOWN, CONTROL, BYTE = "▁", 1, 2, 3, 6
#: Bits of a symbol in a pair's key; a character outside the vocabulary is the symbol size of the vocabulary + code point.
BITS = 22


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.int64) << BITS | right


class PieceBpe:
    """The tables of a SentencePiece model of kind BPE with byte fallback, and the words encoded so far.

    Models that rewrite texts, strip white space, or have user-defined or unused pieces are refused.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        norm, train = m.normalizer_spec, m.trainer_spec
        types = [p.type for p in m.pieces]
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or not set(types) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: a BPE model with byte fallback that leaves texts as they are is needed")
        pieces = [p.piece for p in m.pieces]
        known = {p: i for i, p in enumerate(pieces) if types[i] == NORMAL}
        self.size = len(pieces)
        self.byte_id = np.full(256, -1, np.int64)
        self.surface: list[bytes] = []
        self.is_byte = [t == BYTE for t in types]
        self.spaced = [t == NORMAL and p.startswith(SPACE) for p, t in zip(pieces, types, strict=True)]
        for i, (p, t) in enumerate(zip(pieces, types, strict=True)):
            if t == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
            self.surface.append(p.replace(SPACE, " ").encode() if t == NORMAL else bytes([int(p[3:5], 16)]) if t == BYTE else (train.unk_surface or " ⁇ ").encode() if t == UNKNOWN else b"")
        self.letter = np.arange(0x110000, dtype=np.int64) + self.size
        for p, i in known.items():
            if len(p) == 1:
                self.letter[ord(p)] = i
        # every way to put a piece together from two symbols; equal scores are one rank, taken from the left
        scores = np.array([p.score for p in m.pieces], np.float32)
        order = np.unique(-scores, return_inverse=True)[1]
        symbol = {p: i for p, i in known.items()} | {c: self.size + ord(c) for p in known for c in p if c not in known}
        made = sorted((symbol[p[:k]] << BITS | symbol[p[k:]], int(order[i]), i) for p, i in known.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        self.keys, self.rank_of, self.made = (np.array(x, np.int64) for x in zip(*made, strict=True))
        self.none = int(order.max()) + 1
        inner = {(ord(a), ord(b)) for p in known for a, b in zip(p, p[1:], strict=False)}
        self.joined = np.unique(np.array([a << BITS | b for a, b in inner], np.int64))
        if any(chr(b) == SPACE and chr(a) != SPACE for a, b in inner):
            raise ValueError(f"{path}: pieces reach over the start of a word")
        # a word is a run of spaces and what follows; an ASCII character that is in no longer piece is a word by itself
        alone = "".join(re.escape(chr(c)) for c in range(128) if c not in {x for ab in inner for x in ab})
        self.words = re.compile(f"[{alone}]|{SPACE}+[^{alone}{SPACE}]*|[^{alone}{SPACE}]+")
        self.done: dict[str, bytes] = {}
        self.past: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; `none` where the model has no such piece."""
        key = pair_keys(left, right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank_of[at], self.none), self.made[at]

    def merged(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all segments, and how many each has. points: code points; first: where each segment starts."""
        sym, seg = self.letter[points], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(points))))
        out_sym, out_seg = [], []
        rank, new = np.full(len(sym), self.none), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(seg[:-1] == seg[1:])
        rank[inner], new[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            count = np.diff(np.append(starts, len(sym)))
            best = np.repeat(np.minimum.reduceat(rank, starts), count)
            live = best < self.none
            if not live.all():  # segments that are through
                out_sym.append(sym[~live])
                out_seg.append(seg[~live])
                sym, seg, rank, new, best = (x[live] for x in (sym, seg, rank, new, best))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            follows = np.concatenate(([False], at[1:] == at[:-1] + 1))  # of places that overlap every other one, from the left
            step = np.arange(len(at))
            at = at[(step - np.maximum.accumulate(np.where(follows, 0, step))) % 2 == 0]
            at = at[self.safe(sym, seg, at, new, best)]
            sym[at] = new[at]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            # the pairs around a merged symbol change: the one it begins and the one it ends
            moved = at - np.cumsum(gone)[at]
            sym, seg, rank, new = (x[~gone] for x in (sym, seg, rank, new))
            left = np.concatenate((moved, moved[moved > 0] - 1))
            rank[left] = self.none
            left = left[left + 1 < len(sym)]
            left = left[seg[left] == seg[left + 1]]
            rank[left], new[left] = self.ranks(sym[left], sym[left + 1])
        if not out_sym:
            return sym, np.zeros(len(first), np.int64)
        sym, seg = np.concatenate(out_sym), np.concatenate(out_seg)
        order = np.argsort(seg, kind="stable")
        return sym[order], np.bincount(seg, minlength=len(first))

    def safe(self, sym: np.ndarray, seg: np.ndarray, at: np.ndarray, new: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Which places may be merged in this round: in each segment, those up to the first that makes a pair as good or better."""
        made = new[at]
        again = seg[at[1:]] == seg[at[:-1]]
        if not again.any():
            return np.ones(len(at), bool)
        touching = np.concatenate(([False], at[1:] == at[:-1] + 2))
        before = np.where(touching, np.concatenate(([0], made[:-1])), sym[np.maximum(at - 1, 0)])
        has_before = (at > 0) & (seg[np.maximum(at - 1, 0)] == seg[at])
        after_at = np.minimum(at + 2, len(sym) - 1)
        has_after = (at + 2 < len(sym)) & (seg[after_at] == seg[at])
        lower = (self.ranks(before, made)[0] <= best[at]) & has_before | (self.ranks(made, sym[after_at])[0] <= best[at]) & has_after
        # places of the same segment that have such a one before them
        total = np.cumsum(lower) - lower
        start = np.concatenate(([True], ~again))
        base = total[start][np.cumsum(start) - 1]
        return total == base

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of each word, four bytes each."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        apart = ~np.isin(pair_keys(points[:-1], points[1:]), self.joined)
        first = np.zeros(len(points), bool)
        first[1:], first[0] = apart, True
        first[stop[:-1]] = True
        begins = np.flatnonzero(first)
        sym, count = self.merged(points, begins)
        place = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(begins, np.concatenate(([0], stop[:-1]))).tolist() + [len(begins)]]
        odd = sym >= self.size
        if odd.any():  # characters outside the vocabulary are their UTF-8 bytes
            raw = [chr(c).encode() for c in (sym[odd] - self.size).tolist()]
            wide = np.ones(len(sym), np.int64)
            wide[odd] = [len(x) for x in raw]
            ends = np.concatenate(([0], np.cumsum(wide)))
            flat = np.repeat(sym, wide)
            flat[np.repeat(odd, wide)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            sym, place = flat, ends[place]
        data, place = sym.astype("<u4").tobytes(), (4 * place).tolist()
        return [data[a:b] for a, b in zip(place, place[1:], strict=False)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        if len(self.done) > KEPT_WORDS // 2:  # words that come again move to the new generation
            self.past, self.done = self.done, {}
        split = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = [w for w in set(chain.from_iterable(split)) if w not in self.done]
        have = {w: self.past[w] for w in new if w in self.past}
        fresh = [w for w in new if w not in have]
        if fresh:
            have.update(zip(fresh, self.learn(fresh), strict=True))
        self.done.update(have)
        out = [b"".join(map(self.done.__getitem__, ws)) for ws in split]
        for w in fresh:
            if len(w) > LONGEST_KEPT:
                del self.done[w]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.packed(texts)]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: bytes are read as UTF-8, the space that encoding puts in front goes, control pieces are empty."""
        parts = list(map(self.surface.__getitem__, ids))
        head = next((i for i in ids if self.surface[i]), None)
        cut = 1 if head is not None and self.spaced[head] else 0
        try:
            if not all(parts):
                raise ValueError
            return b"".join(parts)[cut:].decode()
        except ValueError:  # bytes that are no text, each replaced by itself; control pieces end a run of bytes
            out, held = [], bytearray()
            for i in [*ids, None]:
                if i is not None and self.is_byte[i]:
                    held += self.surface[i]
                    continue
                while held:
                    n = next((n for n in (1, 2, 3, 4) if _reads(bytes(held[:n]))), 0)
                    out.append(held[:n].decode() if n else "�")
                    del held[: n or 1]
                out.append(self.surface[i].decode() if i is not None else "")
            return "".join(out)[cut:]


def _reads(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def encoder(path: str) -> PieceBpe:
    return kept(f"pieces {path}", lambda: PieceBpe(path))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the piece ids of `text` as array<int> in column `ids` and, if asked for, their decoded text.

    Ids are those of the sentencepiece library for the model at `path`, without begin and end. Null and empty texts have no
    ids and decode to the empty text; a text of blanks has the ids of these. All columns of docs stay; one that has the name
    of a new column is replaced. Whole texts are encoded, row by row, without a shuffle, so rows that repeat are encoded each.
    """
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    source = docs.select(*keep) if text in keep else docs.select(*keep, text)
    b_text = source.columns.index(text)
    names = [*keep, ids, *([decoded] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        t = encoder(path)
        for b in blocks(batches, b_text):
            got = t.packed([x or "" for x in b.column(b_text).to_pylist()])
            ends = (np.cumsum([0, *map(len, got)]) // 4).astype(np.int32)
            new = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32)))]
            if decoded:
                new.append(pa.array([t.decode(np.frombuffer(x, "<u4").tolist()) for x in got], pa.string()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], *new], names=names)

    schema = ", ".join([*[f"`{n}` {t}" for n, t in docs.select(*keep).dtypes], f"`{ids}` array<int>", *([f"`{decoded}` string"] if decoded else [])])
    return source.mapInArrow(tidied(run), schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows with the text of the piece ids; null ids decode to the empty text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(s):  # noqa: ANN001, ANN202
        t = encoder(path)
        return s.map(lambda x: t.decode([] if x is None else list(x)))

    text.__annotations__ = {}
    return rows.withColumn(decoded, text(ids))


def model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model(), decoded="decoded")
    return got.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op12_pieces": op12_pieces}
ORACLES: dict[str, str] = {}
