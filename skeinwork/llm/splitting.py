"""Oversized texts cut into pieces at content-defined places.

A rolling hash over the last 16 characters marks landmarks; each landmark snaps to
the nearest block, line, sentence or word boundary around it, so that a possible cut
depends on the text near it only. Pieces are then taken greedily between a minimum
and a maximum size. An edit thus changes the pieces around it and no others.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD, SENTENCE, LINE, BLOCK = 1, 2, 3, 4
#: How far a landmark looks for a boundary of each kind, in characters.
REACH = {BLOCK: 320, LINE: 200, SENTENCE: 200, WORD: 80}
_HASHED = 16
_SLICE = 1 << 20
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)
_ENDS = np.array([ord(c) for c in ".!?;:"], np.uint32)
_WIDE_ENDS = np.array([ord(c) for c in "。！？"], np.uint32)


def _landmarks(code: np.ndarray, spacing: int) -> np.ndarray:
    """Positions whose preceding 16 characters hash to zero, about one in ``spacing``."""
    found, mask = [], np.uint32(spacing - 1)
    for at in range(0, len(code), _SLICE):
        a = max(0, at - _HASHED + 1)
        part = code[a : at + _SLICE] * np.uint32(2654435761)
        part ^= part >> np.uint32(15)
        h = np.zeros(len(part), np.uint32)
        for j in range(_HASHED):
            h[_HASHED - 1 :] = h[_HASHED - 1 :] * np.uint32(31) + part[j : len(part) - _HASHED + 1 + j] if len(part) >= _HASHED else 0
        h ^= h >> np.uint32(13)
        h *= np.uint32(2246822519)
        hit = np.flatnonzero(((h >> np.uint32(12)) & mask) == 0)
        hit = hit[hit >= _HASHED - 1] + a + 1
        found.append(hit[hit > at])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _boundaries(code: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Sorted boundary positions of each kind or better, and the ends of the lines."""
    n = len(code)
    space = np.isin(code, _SPACES)
    lf = code == 10
    lone_cr = code == 13
    if n > 1:
        lone_cr[:-1] &= ~lf[1:]
    ends = np.flatnonzero(lf | lone_cr) + 1
    solid = np.concatenate([[0], np.cumsum(~space)])
    starts = np.concatenate([[0], ends])
    stops = np.concatenate([ends, [n]])
    blank = solid[stops] == solid[starts]
    first = code[np.minimum(starts, n - 1)]
    closes = (first == ord("}")) & ~blank
    # a block starts after a blank line, or after a line that closes one at the margin
    opens = np.zeros(len(starts), bool)
    opens[1:] = (blank[:-1] | closes[:-1]) & ~blank[1:]
    blocks = starts[opens]
    stop = np.isin(code, _ENDS)
    sentence = np.flatnonzero(stop[:-1] & space[1:]) + 2 if n > 1 else np.empty(0, np.int64)
    sentence = np.union1d(sentence, np.flatnonzero(np.isin(code, _WIDE_ENDS)) + 1)
    words = np.flatnonzero(space) + 1
    kinds = {BLOCK: blocks, LINE: np.union1d(blocks, ends)}
    kinds[SENTENCE] = np.union1d(kinds[LINE], sentence)
    kinds[WORD] = np.union1d(kinds[SENTENCE], words)
    return {k: v[(v > 0) & (v < n)] for k, v in kinds.items()}, ends


def _nearest(sorted_at: np.ndarray, p: int, reach: int) -> int | None:
    i = int(np.searchsorted(sorted_at, p))
    near = [int(sorted_at[j]) for j in (i - 1, i) if 0 <= j < len(sorted_at)]
    best = min(near, key=lambda b: abs(b - p), default=None)
    return best if best is not None and abs(best - p) <= reach else None


def _whole(code: np.ndarray, p: int, low: int) -> int:
    """``p`` moved back so that it parts neither CR from LF nor a mark from its letter."""
    q = p
    while low < q < len(code) and p - q < 32:
        c = int(code[q])
        if (c == 10 and code[q - 1] == 13) or c in (0x200D, 0xFE0E, 0xFE0F) or int(code[q - 1]) == 0x200D or (c > 0x2FF and unicodedata.combining(chr(c))):
            q -= 1
        else:
            return q
    return p


def cut_points(text: str, limit: int = 2000, overlap: int = 200, minimum: int = 500, spacing: int = 512) -> list[tuple[int, int, int]]:
    """``(start, fresh, end)`` of each piece: it repeats ``text[start:fresh]`` and adds ``text[fresh:end]``."""
    code = _codes(text)
    return _cut(code, _boundaries(code)[0] if len(code) > limit else {}, limit, overlap, minimum, spacing)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _cut(code: np.ndarray, kinds: dict[int, np.ndarray], limit: int = 2000, overlap: int = 200, minimum: int = 500, spacing: int = 512) -> list[tuple[int, int, int]]:
    n = len(code)
    if n <= limit:
        return [(0, 0, n)]
    if not 0 <= overlap < minimum <= (limit - overlap) // 2 or spacing & (spacing - 1):
        raise ValueError("needs overlap < minimum <= (limit - overlap) / 2 and a power of two as spacing")
    anchors = set()
    for p in _landmarks(code, spacing).tolist():
        for kind in (BLOCK, LINE, SENTENCE, WORD):
            if (b := _nearest(kinds[kind], p, REACH[kind])) is not None:
                anchors.add(b)
                break
        else:
            anchors.add(p)
    at = np.array(sorted(anchors), np.int64)
    pieces, s, start = [], 0, 0
    while True:
        most = limit - (s - start)
        if n - s <= most:
            pieces.append((start, s, n))
            return pieces
        low, high = s + minimum, s + most
        i = int(np.searchsorted(at, low))
        e = int(at[i]) if i < len(at) and at[i] <= high else None
        if e is None:
            for kind in (BLOCK, LINE, SENTENCE, WORD):
                j = int(np.searchsorted(kinds[kind], high, "right")) - 1
                if j >= 0 and kinds[kind][j] > low:
                    e = int(kinds[kind][j])
                    break
            else:
                e = high
        e = _whole(code, e, s + 1)
        pieces.append((start, s, e))
        start = e - overlap
        for kind in (LINE, SENTENCE, WORD):
            j = int(np.searchsorted(kinds[kind], start))
            if j < len(kinds[kind]) and kinds[kind][j] < e:
                start = int(kinds[kind][j])
                break
        start = max(_whole(code, start, s + 1), e - overlap)
        if start < e and int(code[start]) == 10 and int(code[start - 1]) == 13:
            start += 1
        s = e


def split_pieces(text: str, first_line: int = 1, **size: int) -> list[tuple[int, str, int, int, int]]:
    """``(piece, content, start_line, end_line, repeated characters)`` of each piece of ``text``."""
    code = _codes(text)
    kinds, ends = _boundaries(code) if len(code) else ({}, np.empty(0, np.int64))
    out = []
    for k, (a, f, e) in enumerate(_cut(code, kinds, **size)):
        top = first_line + int(np.searchsorted(ends, a, "right"))
        last = first_line + int(np.searchsorted(ends, max(a, e - 1), "right"))
        out.append((k, text[a:e], top, last, f - a))
    return out


_OUT = "id string, piece int, file_path string, symbol_name string, start_line int, end_line int, overlap int, content string"


def split_oversized(chunks: DataFrame, limit: int = 2000, overlap: int = 200, minimum: int = 500, spacing: int = 512) -> DataFrame:
    """Pieces of every chunk whose content has more than ``limit`` characters.

    ``chunks`` has id, file_path, start_line, content and symbol_name; other columns are
    left aside, whatever their names. A piece has at most ``limit`` characters, the
    ``overlap`` ones or fewer that it repeats from the piece before included; joined
    without these, the pieces give the content back exactly. Lines end at LF, CRLF or a
    lone CR. Null, empty and short contents give no row. Rows repeated with equal id,
    place and content count once; a null id is kept as null. Without a start_line,
    lines count from 1.
    """
    big = chunks.select("id", "file_path", "start_line", "symbol_name", "content").where(F.length("content") > limit)
    key = ["id", "file_path", "start_line", "symbol_name"]
    big = big.groupBy(*key, F.xxhash64("content").alias("_h")).agg(F.first("content").alias("content")).drop("_h")
    size = {"limit": limit, "overlap": overlap, "minimum": minimum, "spacing": spacing}

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "piece", "file_path", "symbol_name", "start_line", "end_line", "overlap", "content"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        schema = pa.schema(list(zip(names, kinds)))
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            held = 0
            for r in zip(*(batch.column(c).to_pylist() for c in (*key, "content"))):
                for k, piece, top, last, rep in split_pieces(r[4], r[2] if r[2] is not None else 1, **size):
                    for col, v in zip(cols, (r[0], k, r[1], r[3], top, last, rep, piece)):
                        col.append(v)
                    held += len(piece)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], schema=schema)
                    cols, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], schema=schema)

    return big.mapInArrow(cut_batches, _OUT)
