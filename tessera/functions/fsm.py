"""Quote-aware finite-state tokenizer for separated records, over a byte buffer.

The buffer is cut into chunks without regard to records. Each chunk is reduced
to its transition function (an end state for each start state); composing these
functions one after the other gives every chunk's start state, and a second pass over all chunks at once gives the state after every byte. Nothing is
scanned byte by byte in Python: each step advances all chunks together.
"""

from __future__ import annotations

import numpy as np

# States: at the start of a field, in a plain field, in a quoted field, at a quote within a quoted field, violated.
START, PLAIN, QUOTED, CLOSING, BROKEN = range(5)
# Byte classes: other, separator, quote, end of record.
OTHER, SEPARATOR, QUOTE, END = range(4)
#: next state by [class, state]; the end of a record always leads to START.
STEP = np.array([[PLAIN, PLAIN, QUOTED, BROKEN, BROKEN], [START, START, QUOTED, START, BROKEN], [QUOTED, PLAIN, CLOSING, QUOTED, BROKEN], [START] * 5], np.uint8)


def states(classes: np.ndarray, chunk: int = 512, start: int = START) -> np.ndarray:
    """The state before each byte, and after the last: length n + 1."""
    n = len(classes)
    if not n:
        return np.array([start], np.uint8)
    count = -(-n // chunk)
    padded = np.zeros(count * chunk, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(count, chunk).T)
    ends = np.broadcast_to(np.arange(5, dtype=np.uint8), (count, 5))
    for column in columns:
        ends = STEP[column[:, None], ends]
    begins = np.empty(count, np.uint8)
    for i, function in enumerate(ends.tolist()):  # one step a chunk, not a byte
        begins[i] = start
        start = function[start]
    out = np.empty((chunk, count), np.uint8)
    now = begins
    for i, column in enumerate(columns):
        out[i] = now
        now = STEP[column, now]
    flat = out.T.reshape(-1)
    return np.append(flat[:n], STEP[classes[-1], flat[n - 1]])


def tokenize(buffer: np.ndarray, ends: np.ndarray, separator: int = 9, quote: int = 34, chunk: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records of a buffer, each with an end mark at ``ends`` (positions, ascending).

    Returns (offset of the first violation within each record, or -1; the
    positions of field separators; the record of each separator).
    """
    classes = np.zeros(len(buffer), np.uint8)
    classes[buffer == separator] = SEPARATOR
    classes[buffer == quote] = QUOTE
    classes[ends] = END
    before = states(classes, chunk)[:-1]
    record_of = lambda at: np.searchsorted(ends, at)
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    broken = np.full(len(ends), -1, np.int64)
    # The violation is at the byte that leads out of CLOSING, or at the end that comes while QUOTED.
    at = np.nonzero(((before == CLOSING) & ((classes == OTHER))) | ((before == QUOTED) & (classes == END)))[0]
    records, first = np.unique(record_of(at), return_index=True)
    broken[records] = at[first] - begins[records]
    separators = np.nonzero((classes == SEPARATOR) & ((before == START) | (before == PLAIN) | (before == CLOSING)))[0]
    return broken, separators, record_of(separators)
