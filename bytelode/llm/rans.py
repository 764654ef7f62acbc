"""Static range asymmetric numeral system over token ids (Duda 2013), interleaved in numpy lanes.

A segment is one frequency table and the blocks that share it. A block is coded on its own: LANES
states of 64 bits advance together, token t belongs to lane t % LANES, and a state that leaves its
range sheds or takes 32 bits. A block's checkpoints hold the states and the place in its words from
which decoding can start; each block has a checksum of its ids.

Layout, little-endian: header (magic, version, table bits, lanes, symbols, blocks, table bytes), the
deflated table (symbol gaps, then frequencies, u32), then per block its directory (ids, words,
checkpoints, checksum), its checkpoints (step u32, words read u32, states u64) and its words (u32).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"BLRA", 1
LANES = 1024
BLOCK_STEPS = 512
CHECKPOINT_STEPS = 256
#: Ids below this are counted in a table.
DIRECT = 1 << 22
_HEADER = struct.Struct("<4sHBxIIII")
_BLOCK = struct.Struct("<IIII")
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class Damaged(ValueError):
    """A segment that isn't what was written."""


def frequencies(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies of at least 1 that sum to a power of two, and that power."""
    bits = max(16, int(len(counts)).bit_length() + 3)
    total = 1 << bits
    freq = np.maximum(1, counts.astype(np.float64) * total / counts.sum()).astype(np.int64)
    spare = total - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if spare >= 0:
        freq[order[0]] += spare
    for i in order:  # ones that were raised to 1 are paid for by the most frequent
        if spare >= 0:
            break
        take = min(-spare, int(freq[i]) - 1)
        freq[i] -= take
        spare += take
    return freq, bits


def _encode_block(slots: np.ndarray, freq: np.ndarray, cum: np.ndarray, bits: int) -> bytes:
    n = len(slots)
    steps = -(-n // LANES)
    state = np.full(LANES, _LOW, np.uint64)
    words, checkpoints = [], []
    shift, room = np.uint64(bits), np.uint64(63 - bits)
    f_all, c_all = freq.astype(np.uint64)[slots], cum.astype(np.uint64)[slots]
    for step in range(steps - 1, -1, -1):
        f, c = f_all[step * LANES : (step + 1) * LANES], c_all[step * LANES : (step + 1) * LANES]
        x = state[: len(f)]
        full = x >= f << room
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> _WORD, x)
        q, r = np.divmod(x, f)
        state[: len(f)] = (q << shift) + r + c
        if step % CHECKPOINT_STEPS == 0:
            checkpoints.append((step, state.copy()))
    words.reverse()
    read = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    states = b"".join(struct.pack("<II", step, read[step]) + s.astype("<u8").tobytes() for step, s in reversed(checkpoints))
    return states, len(checkpoints), np.concatenate(words).astype("<u4").tobytes()


def encode(ids: np.ndarray) -> bytes:
    """A segment of token ids (any number, below 2^32)."""
    ids = ids.astype(np.uint32)
    if not len(ids):
        return _HEADER.pack(MAGIC, VERSION, 0, LANES, 0, 0, 0)
    if ids.max() < DIRECT:  # counted in a table; sorting takes ten times as long
        all_counts = np.bincount(ids)
        symbols = np.flatnonzero(all_counts).astype(np.uint32)
        counts = all_counts[symbols]
        place = np.zeros(len(all_counts), np.uint32)
        place[symbols] = np.arange(len(symbols))
        slots = place[ids]
    else:
        symbols, slots, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq, bits = frequencies(counts)
    cum = np.concatenate(([0], np.cumsum(freq)[:-1]))
    table = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    size, out = LANES * BLOCK_STEPS, []
    for at in range(0, len(ids), size):
        part = ids[at : at + size]
        states, n, words = _encode_block(slots[at : at + size], freq, cum, bits)
        out += [_BLOCK.pack(len(part), len(words) // 4, n, zlib.crc32(part.astype("<u4").tobytes())), states, words]
    return b"".join([_HEADER.pack(MAGIC, VERSION, bits, LANES, len(symbols), len(out) // 3, len(table)), table, *out])


class Segment:
    """An encoded segment; every block, or any checkpoint of it, decodes on its own."""

    def __init__(self, data: bytes):
        try:
            magic, version, self.bits, self.lanes, n, blocks, size = _HEADER.unpack_from(data)
            if magic != MAGIC or version != VERSION:
                raise Damaged("not a segment of this version")
            at = _HEADER.size
            self.blocks: list[tuple[int, int, list, np.ndarray]] = []
            if n:
                table = np.frombuffer(zlib.decompress(data[at : at + size]), "<u4")
                symbols, freq = np.cumsum(table[:n], dtype=np.uint32), table[n:].astype(np.int64)
                if len(freq) != n or freq.sum() != 1 << self.bits:
                    raise Damaged("its table")
                cum = np.cumsum(freq) - freq
                self.symbol_at = np.repeat(symbols, freq)
                self.freq_at = np.repeat(freq, freq).astype(np.uint64)
                self.bias_at = (np.arange(1 << self.bits) - np.repeat(cum, freq)).astype(np.uint64)
            at += size
            for _ in range(blocks):
                count, words, checkpoints, crc = _BLOCK.unpack_from(data, at)
                at += _BLOCK.size
                starts = []
                for _ in range(checkpoints):
                    step, read = struct.unpack_from("<II", data, at)
                    starts.append((step, read, np.frombuffer(data, "<u8", self.lanes, at + 8)))
                    at += 8 + 8 * self.lanes
                self.blocks.append((count, crc, starts, np.frombuffer(data, "<u4", words, at)))
                at += 4 * words
        except (struct.error, zlib.error, ValueError) as e:
            raise Damaged(str(e)) from e

    def from_checkpoint(self, block: int, checkpoint: int) -> np.ndarray:
        """Ids from a checkpoint up to the next one or the block's end."""
        count, _, starts, words = self.blocks[block]
        step, at, states = starts[checkpoint]
        last = starts[checkpoint + 1][0] if checkpoint + 1 < len(starts) else -(-count // self.lanes)
        state, words = states.astype(np.uint64), words.astype(np.uint64)
        low, shift, out = np.uint64((1 << self.bits) - 1), np.uint64(self.bits), np.empty(min(last * self.lanes, count) - step * self.lanes, np.uint32)
        for k in range(step, last):
            to = (k - step) * self.lanes
            x = state[: min(self.lanes, len(out) - to)]
            slot = x & low
            out[to : to + len(x)] = self.symbol_at[slot]
            x = self.freq_at[slot] * (x >> shift) + self.bias_at[slot]
            short = np.flatnonzero(x < _LOW)
            if at + len(short) > len(words):
                raise Damaged("its words end early")
            x[short] = x[short] << _WORD | words[at : at + len(short)]
            at += len(short)
            state[: len(x)] = x
        return out

    def block(self, i: int) -> np.ndarray:
        """A block's ids, held against its checksum."""
        ids = np.concatenate([self.from_checkpoint(i, c) for c in range(len(self.blocks[i][2]))])
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.blocks[i][1]:
            raise Damaged(f"checksum of block {i}")
        return ids

    def ids(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint32), *(self.block(i) for i in range(len(self.blocks)))])
