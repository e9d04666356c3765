"""Token ids in canonical, length-limited Huffman files: coded from global counts, decoded by table in independent blocks.

A file holds, little-endian:
  magic b"TFHC1\\0\\0\\0"; u64 header length; header (JSON: longest, documents, tokens, blocks, symbols);
  code lengths, u8 for each symbol (0: not used);
  document index: i64 key and i64 number of ids of each, and u8 whether the key is null;
  block index: u64 byte offset in the payload, u32 number of ids;
  checkpoints: u32 bit offset from its block's start, one for each STEP ids of a block;
  payload: each block's bits, highest first, filled up to whole 16-bit words.
"""

from __future__ import annotations

import heapq
import json
import struct

import numpy as np

MAGIC = b"TFHC1\0\0\0"
LONGEST = 16
BLOCK, STEP = 1 << 15, 512


def code_lengths(counts: dict[int, int], symbols: int, longest: int = LONGEST) -> np.ndarray:
    """Lengths of the best code with none over longest: package-merge. A sole symbol gets length 1."""
    used = sorted((n, s) for s, n in counts.items() if n > 0)
    lengths = np.zeros(symbols, np.uint8)
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols don't fit codes of {longest} bits")
    if len(used) == 1:
        lengths[used[0][1]] = 1
    if len(used) < 2:
        return lengths
    weights = np.array([n for n, _ in used], np.int64)
    # Each level keeps only how many of its cheapest 2n-2 items are leaves: leaves are taken in order, so counts are enough.
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(longest):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(weights))
        merged = merged[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, depth = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    for (_, s), d in zip(used, depth.tolist(), strict=True):
        lengths[s] = d
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of the lengths: in order of (length, symbol), each the one before plus 1, shifted."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[np.count_nonzero(lengths == 0) :].tolist():
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def table(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) for each value of the next longest bits."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (longest - lengths[order].astype(np.int64))
    symbols, sizes = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.uint8)
    symbols[: spans.sum()] = np.repeat(order, spans)
    sizes[: spans.sum()] = np.repeat(lengths[order], spans)
    return symbols, sizes


def block_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of a block and the bit offset of every STEP-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    word, room = starts >> 4, 32 - (starts & 15) - size
    shifted = codes[ids].astype(np.uint64) << room.astype(np.uint64)
    n = int(ends[-1] + 15 >> 4) + 1
    # Bits of different ids never meet, so sums are unions, exact in doubles.
    high = np.bincount(word, (shifted >> np.uint64(16)).astype(np.float64), n)
    low = np.bincount(word + 1, (shifted & np.uint64(0xFFFF)).astype(np.float64), n + 1)[: n + 1]
    words = (np.append(high, 0) + low)[: n - 1].astype(">u2")
    return words.tobytes(), starts[::STEP].astype("<u4")


def pack_file(keys: list[int | None], ids: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """The file of these documents, in their order."""
    everything = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int64)
    offsets, sizes, marks, payload, at = [], [], [], [], 0
    for k in range(0, len(everything), BLOCK):
        bits, points = block_bits(everything[k : k + BLOCK], lengths, codes)
        offsets.append(at)
        sizes.append(min(BLOCK, len(everything) - k))
        marks.append(points)
        payload.append(bits)
        at += len(bits)
    head = json.dumps({"longest": LONGEST, "documents": len(keys), "tokens": len(everything), "blocks": len(sizes), "symbols": len(lengths)}).encode()
    index = [np.array([k or 0 for k in keys], "<i8"), np.array([len(i) for i in ids], "<i8"), np.array([k is None for k in keys], "u1")]
    index += [np.array(offsets, "<u8"), np.array(sizes, "<u4"), np.concatenate([*marks, np.zeros(0, "<u4")]).astype("<u4")]
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, lengths.tobytes(), *[i.tobytes() for i in index], *payload])


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(keys, ids of each, all ids) of a file. Every stretch between two checkpoints is decoded on its own, all of them side by side."""
    if data[:8] != MAGIC:
        raise ValueError("not such a file")
    (n,) = struct.unpack_from("<Q", data, 8)
    head, at = json.loads(data[16 : 16 + n]), 16 + n

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    lengths = take("u1", head["symbols"])
    keys, counts, null = take("<i8", head["documents"]), take("<i8", head["documents"]), take("u1", head["documents"])
    offsets, sizes = take("<u8", head["blocks"]), take("<u4", head["blocks"]).astype(np.int64)
    steps = -(-sizes // STEP)
    marks = take("<u4", int(steps.sum())).astype(np.int64)
    words = np.append(take(">u2", (len(data) - at) // 2).astype(np.uint32), np.zeros(3, np.uint32))
    pairs = (words[:-1] << np.uint32(16)) | words[1:]
    # Ids in each stretch: STEP, but for the last of a block.
    length = np.full(len(marks), STEP, np.int64)
    if len(marks):
        length[np.cumsum(steps) - 1] = sizes - (steps - 1) * STEP
    # Longer stretches first, so that those that still have an id are the first ones.
    order = np.argsort(-length, kind="stable")
    bit, live = (np.repeat(offsets.astype(np.int64) * 8, steps) + marks)[order], np.searchsorted(-length[order], -np.arange(STEP))
    symbols, spans = table(lengths, head["longest"])
    coded = symbols.astype(np.uint32) << np.uint32(5) | spans  # a length has 5 bits
    side = np.zeros((STEP, len(marks)), np.uint32)
    for k, n in enumerate(live.tolist()):
        here = bit[:n]
        window = (pairs[here >> 4] >> (16 - (here & 15)).astype(np.uint32)) & np.uint32(0xFFFF)
        found = coded[window]
        side[k, :n] = found >> np.uint32(5)
        here += found & np.uint32(31)
    out = np.zeros((len(marks), STEP), np.uint32)
    out[order] = side.T
    out = out.reshape(-1)
    if head["tokens"] < len(out):
        out = out[(np.arange(STEP) < length[:, None]).reshape(-1)]
    return [None if z else k for k, z in zip(keys.tolist(), null.tolist(), strict=True)], counts, out


def merge_counts(parts: list[dict[int, int]]) -> dict[int, int]:
    out: dict[int, int] = {}
    for p in parts:
        for s, n in p.items():
            out[s] = out.get(s, 0) + n
    return out


def kraft(lengths: np.ndarray) -> float:
    return float((0.5 ** lengths[lengths > 0].astype(float)).sum())


def huffman_cost(counts: dict[int, int]) -> int:
    """Bits of the best code without a limit; for tests."""
    heap, cost = [n for n in counts.values() if n], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost
