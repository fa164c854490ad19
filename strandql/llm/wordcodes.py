"""Words of many texts at once, as numpy codes: runs of ASCII letters and digits and of bytes beyond ASCII, A-Z in lower case."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Every byte as it stands in a word; 0: it stands in none.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8)


def word_codes(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the code of every word of all texts in order, and the bounds of each text's words. Null: no word.

    Bytes are classed all at once; a byte beyond ASCII is always part of a word, so characters needn't be decoded.
    """
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    if offsets[-1] == offsets[0]:
        return [], np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    offsets -= offsets[0]
    inside = data != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    kept, starts = data[inside], np.flatnonzero(begins[inside])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(kept))), pa.py_buffer(kept)]).dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(), np.searchsorted(np.flatnonzero(begins), offsets)
