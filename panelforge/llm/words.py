"""Words of whole texts as hashes, a batch at a time: each distinct word is hashed once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: ASCII white space and letters, by byte.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[0x41:0x5B] = True
#: Bytes of text that are handled together.
SLICE = 1 << 22


def distinct_words(texts: pa.Array):
    """The distinct words of some texts, A-Z in lower case, parted by ASCII white space; the number of each word in turn;
    and where each text's words begin (and the last ones end). A null text has none."""
    texts = texts.cast(pa.large_utf8()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    begin, end = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[begin:end] if end > begin else np.zeros(0, np.uint8)
    inner = ~WHITE[data]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    text_starts = offsets[:-1][offsets[:-1] < offsets[1:]] - begin
    first[text_starts] = inner[text_starts]
    starts = np.flatnonzero(first)
    data = np.where(CAPITAL[data], data | 32, data)[inner].astype(np.uint8)
    bounds = np.append((np.cumsum(inner) - 1)[starts], len(data)).astype(np.int64)
    cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    return cut.dictionary.to_pylist(), cut.indices.to_numpy().astype(np.int64), np.searchsorted(starts, offsets - begin)


def word_hashes(texts: pa.Array):
    """The 64-bit hashes of all words of some texts, and where each text's begin (and the last ones end)."""
    import xxhash

    found, numbers, offsets = distinct_words(texts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    return hashes[numbers], offsets
