"""BPE encoding and decoding with a pair occurrence index.

The distinct new words of a block of a partition are laid out as one linked list of symbols. Each pair that has a rank is
mapped to all its positions in the block. Active ranks are taken in ascending order; all positions of a rank are merged at
once, left to right, and the lists of the pairs that this makes are extended. A position whose pair has gone since is
skipped. Finished words are kept for later blocks, up to a bound, so a word is merged once for most tasks.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table, tidied

#: UTF-8 bytes of text that are indexed together, and words kept in a worker, in two generations of half as many.
BLOCK_BYTES, KEPT_WORDS = 1 << 20, 300_000
#: White space as the vocabulary's own pattern library has it.
WHITE_POINTS = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WHITE = "".join(map(chr, WHITE_POINTS))


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next free letter from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class WordBpe:
    """The tables of a tokenizer file of kind BPE with word ends, and the words encoded so far."""

    def __init__(self, path: str):
        import regex
        from tokenizers.normalizers import NFC

        spec = json.load(open(path, encoding="utf-8"))
        model, self.vocab = spec["model"], dict(spec["model"]["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.vocab.values(), *added.values()]) + 1)
        for t, i in [*self.vocab.items(), *added.items()]:
            self.tokens[i] = t
        self.added = added
        self.parts = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}"))
        self.composing = regex.compile(r"[\u0300-\U0010ffff]")  # below, every text is in normal form C
        self.nfc = NFC().normalize_str
        self.white = regex.compile(f"[{WHITE}]+")
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        self.pair: list[tuple[int, int]] = []
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[self.vocab[a] << 20 | self.vocab[b]] = r
            self.pair.append((self.vocab[a], self.vocab[b]))
            self.made.append(self.vocab[a + b])
        self.letter = np.array([self.vocab.get(c, -1) for c in byte_letters()], np.int64)
        self.last = np.array([self.vocab.get(c + self.suffix, -1) for c in byte_letters()], np.int64)
        self.done: dict[str, bytes] = {}
        self.past: dict[str, bytes] = {}

    def split(self, text: str) -> list[str | int]:
        """Words of a text after normalisation; an added token that stands in the text is its id."""
        def plain(part: str) -> list[str]:
            if not part.isascii():
                if self.composing.search(part):
                    part = self.nfc(part)
                part = self.white.sub(" ", part).replace("Σ", "σ")
            return self.words.findall(part.lower())

        if self.parts is None or not any(t in text for t in self.added):
            return plain(text)
        out, at = [], 0
        for m in self.parts.finditer(text):
            out += [*plain(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return out + plain(text[at:])

    def learn(self, words: set[str]) -> None:
        """Encode the given new words by the pair occurrence index."""
        names = list(words)
        raw = [w.encode() for w in names]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        octets = np.frombuffer(b"".join(raw), np.uint8)
        stop = np.cumsum(lens)
        symbols = self.letter[octets]
        symbols[stop - 1] = self.last[octets[stop - 1]]
        if len(symbols) and symbols.min() < 0:  # a letter that the vocabulary lacks is left out
            has = symbols >= 0
            lens = np.add.reduceat(has, stop - lens, dtype=np.int64)
            symbols, stop = symbols[has], np.cumsum(lens)
        start, full = stop - lens, lens > 0
        after, ahead = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        after[stop[full] - 1], ahead[start[full]] = -1, -1
        rank, made, pair = self.rank, self.made, self.pair
        # the index: positions of each pair that has a rank, in ascending order
        left = np.flatnonzero(after >= 0)
        keys, of = np.unique(symbols[left] << 20 | symbols[left + 1], return_inverse=True)
        ranks = np.array([rank.get(k, -1) for k in keys.tolist()], np.int64)
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=len(keys)))
        spots_of = np.split(left[order], ends[:-1]) if len(keys) else []
        where: dict[int, list[int]] = {r: x.tolist() for r, x in zip(ranks.tolist(), spots_of, strict=True) if r >= 0}
        sym, nxt, prv = symbols.tolist(), after.tolist(), ahead.tolist()
        find, active = rank.get, list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            spots, new, (a, b) = where.pop(r), made[r], pair[r]
            spots.sort()
            for n, i in enumerate(spots):
                j = nxt[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue
                k, h = nxt[j], prv[i]
                sym[i], sym[j], nxt[i] = new, -1, k
                lower = False
                if h >= 0 and (q := find(sym[h] << 20 | new)) is not None:
                    if q in where:
                        where[q].append(h)
                    else:
                        where[q] = [h]
                        heapq.heappush(active, q)
                    lower = q < r
                if k >= 0:
                    prv[k] = i
                    if (q := find(new << 20 | sym[k])) is not None:
                        if q in where:
                            where[q].append(i)
                        else:
                            where[q] = [i]
                            heapq.heappush(active, q)
                        lower |= q < r
                if lower:  # what this made comes first in its word: the rest of this rank waits
                    where[r] = [*where.get(r, []), *spots[n + 1 :]]
                    heapq.heappush(active, r)
                    break
        final = np.array(sym, np.int64)
        place = 4 * np.concatenate(([0], np.cumsum(final >= 0)))
        flat = final[final >= 0].astype("<u4").tobytes()
        self.done.update(zip(names, [flat[a:b] for a, b in zip(place[start].tolist(), place[stop].tolist(), strict=True)], strict=True))

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        if len(self.done) > KEPT_WORDS // 2:  # words that come again move to the new generation
            self.past, self.done = self.done, {}
        split = [self.split(t) for t in texts]
        new = {w for w in set(chain.from_iterable(split)) if w.__class__ is str and w not in self.done}
        again = {w: self.past[w] for w in new if w in self.past}
        self.done.update(again)
        self.learn(new - again.keys())
        get = self.done.__getitem__
        return [b"".join([w.to_bytes(4, "little") if w.__class__ is int else get(w) for w in ws]) if any(w.__class__ is int for w in ws) else b"".join(map(get, ws)) for ws in split]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.packed(texts)]

    def decode(self, ids) -> str:
        """Token strings joined by spaces, as the library does for a file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def encoder(path: str) -> WordBpe:
    return kept(f"bpe {path}", lambda: WordBpe(path))


def blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BLOCK_BYTES of the column; a longer text is a batch of its own."""
    for b in batches:
        size = np.asarray(pa.compute.binary_length(b.column(column)).fill_null(0))
        part = np.cumsum(size) // BLOCK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield b.slice(i, j - i)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the token ids of `text` as array<int> in column `ids` and, if asked for, their decoded text.

    Ids are those of the tokenizers library for the file at `path`, without special tokens of its own; the strings of added
    tokens inside a text are those tokens. Null and blank texts have no ids and decode to the empty text. All columns of
    docs stay; one that has the name of a new column is replaced. Whole texts are encoded, row by row, without a shuffle.
    """
    keep = [c for c in docs.columns if c not in (ids, decoded)]
    made = [(ids, pa.list_(pa.int32())), *([(decoded, pa.string())] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        t = encoder(path)
        for b in blocks(batches, b_text):
            got = t.packed([x or "" for x in b.column(b_text).to_pylist()])
            ends = (np.cumsum([0, *map(len, got)]) // 4).astype(np.int32)
            flat = np.frombuffer(b"".join(got), "<u4").astype(np.int32)
            new = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            if decoded:
                new.append(pa.array([t.decode(np.frombuffer(x, "<u4").tolist()) for x in got], pa.string()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], *new], names=[*keep, *[n for n, _ in made]])

    source = docs.select(*keep) if text in keep else docs.select(*keep, text)
    b_text = source.columns.index(text)
    schema = ", ".join([*[f"`{n}` {t}" for n, t in docs.select(*keep).dtypes], f"`{ids}` array<int>", *([f"`{decoded}` string"] if decoded else [])])
    return source.mapInArrow(tidied(run), schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows with the text of the token ids; null ids decode to the empty text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(s):  # noqa: ANN001, ANN202
        t = encoder(path)
        return s.map(lambda x: t.decode([] if x is None else x))

    text.__annotations__ = {}
    return rows.withColumn(decoded, text(ids))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), decoded="decoded")
    return got.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op8_bpe": op8_bpe}
ORACLES: dict[str, str] = {}
