"""SentencePiece encoding and decoding of whole texts with numpy: merge rounds over flat symbol arrays.

Each distinct part of a batch (a run of blanks and what follows up to the next blank; no piece reaches over its start) is
a segment of one flat symbol array. A round finds every segment's best pair (least rank, leftmost), merges all of them at
once, compacts the array and looks up only the pairs beside a merge; finished segments leave the array. In long segments
a round merges wherever a pair is the best within a reach that no merge can cross in time. The library is
used to read the model and to decode byte sequences that aren't UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import flat, id_array, ints, mapped, ragged, sliding_least, slices, tokenizer_path
from tallyforge.llm.words import BLOCK, PartCache

BLANK = np.array([32], np.uint8)
LONG = 200  # symbols from which a segment has many merges a round
NONE, GAP = np.int32(1 << 30), np.int32(-(1 << 30))


class PieceModel:
    """Tables of a BPE model with byte fallback, identity normaliser and a blank put before each text."""

    def __init__(self, name: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        m = pb.ModelProto()
        with open(tokenizer_path(name), "rb") as f:
            m.ParseFromString(f.read())
        norm = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces and m.trainer_spec.byte_fallback) or any(p.type not in (1, 2, 3, 6) for p in m.pieces):
            raise ValueError("only BPE models with an identity normaliser, a leading blank and byte fallback are supported")
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        pieces = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has a blank behind another character")
        self.size = len(m.pieces)
        chars = {c for p in pieces for c in p}
        self.longest = max(map(len, pieces))
        extra = sorted(c for c in chars if c not in pieces)  # they can merge, but are no pieces themselves
        number = pieces | {c: self.size + i for i, c in enumerate(extra)}
        self.extra = np.array([ord(c) for c in extra], np.int64)
        self.by_char = np.full(0x110000, -1, np.int32)
        for c in chars:
            self.by_char[ord(c)] = number[c]
        scores = sorted({m.pieces[i].score for i in pieces.values()}, reverse=True)
        place = {s: i for i, s in enumerate(scores)}
        keys, made = [], []
        for p, i in pieces.items():
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    keys.append(number[p[:k]] << 20 | number[p[k:]])
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]
        self.rank = np.array([place[m.pieces[i].score] for i in self.made], np.int32)
        # What ids say: bytes with blanks, a single byte, or nothing.
        self.kinds = np.array([p.type for p in m.pieces], np.int8)
        self.bytes_at = min(i for i, p in enumerate(m.pieces) if p.type == 6)
        said = [b"" if p.type == 3 else " ⁇ ".encode() if p.type == 2 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace("▁", " ").encode() for p in m.pieces]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_off = np.r_[0, np.cumsum([len(x) for x in said])].astype(np.int64)
        self.leading = np.array([p.type == 1 and p.piece.startswith("▁") for p in m.pieces])
        self.cache = PartCache(self.encode_parts)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NONE if it is no piece."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.made[at], -1)

    def merge(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and their segments, sorted by segment."""
        n = len(sym)
        rank, made = np.full(n, NONE), np.full(n, -1, np.int32)
        if n > 1:
            rank[:-1], made[:-1] = self.pairs(sym[:-1], sym[1:])
            rank[:-1][seg[:-1] != seg[1:]] = NONE
        done = []
        while len(sym):
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            least = np.minimum.reduceat(rank, first)
            lens = np.diff(np.r_[first, len(sym)])
            live = least < NONE
            if not live.all():
                over = np.repeat(~live, lens)
                done.append((sym[over], seg[over]))
                sym, seg, rank, made = (x[~over] for x in (sym, seg, rank, made))
                least, lens = least[live], lens[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lens))
            at = at[np.r_[True, seg[at][1:] != seg[at][:-1]]]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # each earlier segment has lost one symbol
            sym, seg, rank, made = (x[keep] for x in (sym, seg, rank, made))
            look = np.concatenate([moved, moved[moved > 0] - 1])
            rank[look] = NONE
            look = look[look + 1 < len(sym)]
            look = look[seg[look] == seg[look + 1]]
            rank[look], made[look] = self.pairs(sym[look], sym[look + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sym, seg = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def merge_long(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for long segments, whose rounds merge at many places at once.

        A pair merges if it is the least (rank, then place) of all pairs within ``reach`` of it. What happens beyond
        can't matter to it in time: only the neighbours of a merged symbol get new pairs, so a change travels as one
        growing symbol, and no symbol has more characters than the longest piece.
        """
        if not len(sym):
            return sym, seg
        reach = 2 * self.longest + 2
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        apart = np.repeat(first, reach + 1)  # cells without a pair keep segments from each other
        sym, seg = np.insert(sym, apart, GAP), np.insert(seg, apart, -1)
        rank, made = np.full(len(sym), NONE), np.full(len(sym), -1, np.int32)
        rank[:-1], made[:-1] = self.pairs(sym[:-1], sym[1:])
        while True:
            at = self._ready(sym, rank, made, reach)
            if not len(at):
                break
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            sym, seg, rank, made = (x[keep] for x in (sym, seg, rank, made))
            rank[moved] = NONE
            look = np.unique(np.concatenate([moved, moved - 1]))
            look = look[(look >= 0) & (look + 1 < len(sym))]
            rank[look], made[look] = self.pairs(sym[look], sym[look + 1])
        own = seg >= 0
        return sym[own], seg[own]

    def _ready(self, sym: np.ndarray, rank: np.ndarray, made: np.ndarray, reach: int) -> np.ndarray:
        """Places of the pairs that can merge now, none beside another.

        Of pairs of one rank the left one is first. The others may go along (in a run of pairs every second one from its
        start) unless one near them must wait, or makes a pair that is as good as theirs, which would come before them.
        """
        around = lambda x, none: sliding_least(np.concatenate([np.full(reach, none), x, np.full(reach, none)]), 2 * reach + 1)
        live = np.flatnonzero((rank < NONE) & (rank == around(rank, NONE)))
        if not len(live):
            return live
        run = np.flatnonzero(np.r_[True, np.diff(live) != 1])
        size = np.diff(np.r_[run, len(live)])
        second = (np.arange(len(live)) - np.repeat(run, size)) % 2 == 1
        before = live[run] - 1
        headless = np.repeat((before >= 0) & (rank[np.maximum(before, 0)] == rank[live[run]]), size)
        at = live[~second]
        left = np.where(at > 0, sym[np.maximum(at - 1, 0)], GAP)
        beside = np.flatnonzero(np.diff(at) == 2) + 1
        left[beside] = made[at[beside - 1]]
        right = sym[np.minimum(at + 2, len(sym) - 1)]
        better = np.minimum(self.pairs(left, made[at])[0], self.pairs(made[at], right)[0]) <= rank[at]
        waiting = rank.copy()
        waiting[live] = NONE
        wait = headless[~second] | (around(waiting, NONE)[at] <= rank[at])
        if not (better | wait).any():
            return at
        place = np.where(rank < NONE, rank.astype(np.int64) << 32 | np.arange(len(rank)), np.int64(1 << 62))
        first = place[at] == around(place, np.int64(1 << 62))[at]
        calm = np.ones(len(sym), np.int8)
        calm[at[better]] = 0
        return at[first | (around(calm, np.int8(1))[at] == 1) & ~wait]

    def encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, off = flat(parts)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        chars = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        chars[chars == 32] = 0x2581
        starts = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)][off]
        lens = np.diff(starts)
        seg = np.repeat(np.arange(len(lens)), lens)
        sym = self.by_char[chars]
        sym = np.where(sym < 0, (-1 - chars), sym).astype(np.int32)
        long = (lens > LONG)[seg]
        out, own = (np.concatenate(x) for x in zip(self.merge(sym[~long], seg[~long]), self.merge_long(sym[long], seg[long])))
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
        # Characters that are no pieces turn into their bytes.
        strange = np.flatnonzero((out < 0) | (out >= self.size))
        if len(strange):
            codes = np.where(out[strange] < 0, -1 - out[strange].astype(np.int64), self.extra[np.maximum(out[strange] - self.size, 0)] if len(self.extra) else 0)
            raw = [np.frombuffer(chr(c).encode(), np.uint8) for c in codes]
            count = np.ones(len(out), np.int64)
            count[strange] = [len(r) for r in raw]
            at = np.cumsum(count) - count
            full = np.repeat(out, count)
            full[ragged(at[strange], count[strange])] = np.concatenate(raw).astype(np.int32) + self.bytes_at
            out, own = full, np.repeat(own, count)
        return out, np.searchsorted(own, np.arange(len(lens) + 1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids with begin and end of each text (null: empty), and n + 1 offsets."""
        buf, off = flat(texts)
        lens = np.diff(off)
        put = off[:-1][lens > 0]
        blank = np.insert(buf, put, 32)  # the blank that the model puts before a text
        at = off + np.r_[0, np.cumsum(lens > 0)]
        ids, ends = self.cache.texts(blank, at, BLANK, False)
        n = np.diff(ends) + 2
        to = np.r_[0, np.cumsum(n)]
        out = np.empty(int(to[-1]), np.int32)
        inner = np.ones(len(out), bool)
        inner[to[:-1]] = inner[to[1:] - 1] = False
        out[to[:-1]], out[to[1:] - 1], out[inner] = self.bos, self.eos, ids
        return out, to

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """UTF-8 of the texts of ids in [off[i], off[i + 1])."""
        lens = self.said_off[ids + 1] - self.said_off[ids]
        raw = self.said[ragged(self.said_off[ids], lens)]
        ends = np.r_[0, np.cumsum(lens)][off]
        known = np.flatnonzero(self.kinds[ids] != 3)
        first = np.searchsorted(known, off[:-1])
        has = (first < len(known)) & (known[np.minimum(first, len(known) - 1)] < off[1:]) if len(known) else np.zeros(len(off) - 1, bool)
        strip = np.zeros(len(off) - 1, bool)
        strip[has] = self.leading[ids[known[first[has]]]]
        out = []
        for i, (a, b) in enumerate(zip((ends[:-1] + strip).tolist(), ends[1:].tolist())):
            text = raw[a:b].tobytes()
            try:
                text.decode()
            except UnicodeDecodeError:
                text = self.library.decode(ids[off[i] : off[i + 1]].tolist()).encode()
            out.append(text)
        return out


_models: dict[str, PieceModel] = {}


def piece_model(name: str) -> PieceModel:
    if name not in _models:
        _models[name] = PieceModel(name)
    return _models[name]


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Ids (little-endian 32-bit, with begin and end) and decoded text of each document, or digests of both.

    Null and empty texts have the two marks alone and decode to an empty text. Rows are independent: repeated rows give
    repeated results, an empty table gives none, other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for b in slices(batches, "text", BLOCK):
            ids, off = m.encode(b.column(1))
            said = m.decode(ids, off)
            raw = [ids[i:j].astype("<u4").tobytes() for i, j in zip(off[:-1], off[1:])]
            if digests:
                cols = [pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([hashlib.sha256(x).hexdigest() for x in said])]
            else:
                cols = [pa.array(raw, pa.binary()), pa.array([x.decode() for x in said])]
            yield pa.RecordBatch.from_arrays([id_array(ints(b.column(0))[0]), pa.array(np.diff(off)), *cols], ["doc_id", "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256" if digests else "decoded"])

    return mapped(rows, run, schema)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every row's ids and decoded text; cases as in ``encode_pieces``."""
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
