"""Token ids of whole texts by a public tokenizer: a batch is cut into pieces, and each distinct piece is encoded once."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa

#: Distinct pieces whose ids a task remembers from one slice to the next; a full memory starts anew.
KNOWN = 300_000
#: Bytes of text in one slice, bytes of a piece that goes alone, pieces that are encoded in one call.
SLICE, LONG, TOGETHER = 1 << 23, 200, 2000
#: Kinds of bytes. MARK ends a piece that a letter precedes; LEAD starts a character of two bytes that is neither white
#: space nor a number (U+00C0 to U+04FF).
SPACE, LETTER, MARK, PLAIN, LEAD = 1, 2, 3, 4, 5
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = PLAIN
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[np.r_[0x41:0x5B, 0x61:0x7B]] = LETTER
KIND[list(b".,;:!?")] = MARK
KIND[0xC3:0xD4] = LEAD
#: A digit is a token apart from what surrounds it, so this one parts pieces that hold no number.
BETWEEN = b"0"
NUMERIC = (KIND == 0) & ~((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0))
NUMERIC[list(b"0123456789")] = True


class Encoder:
    """Texts to ids, each text with the end id after it.

    pieces: "words" for a tokenizer that drops white space and case, "spaced" for one whose tokens start with at most one
    space, None for any other, which encodes each text whole. No token of the first two spans the start of a run of ASCII
    white space, or a letter and the full stop, comma or other mark after it; nor, for "spaced", a single line feed and
    the letter after it. So the ids of a text are those of the pieces between, in turn. Characters that might be white
    space beyond ASCII part nothing.
    """

    def __init__(self, path: str, pieces: str | None, end_id: int = 2, most: int = KNOWN):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.pieces, self.end_id, self.most = pieces, end_id, most
        self.between = self._ids(BETWEEN.decode())
        self.forget()

    def _ids(self, text: str):
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def forget(self) -> None:
        """Start with the end id alone, as piece 0."""
        self.known: dict[bytes, int] = {}
        self.ids, self.lengths = np.array([self.end_id], np.uint32), np.array([1], np.int64)

    def _learn(self, pieces: list[bytes], plain) -> None:
        """Remember the ids of new pieces; those without numbers are encoded together."""
        together = [p for p, fine in zip(pieces, plain, strict=True) if fine and len(self.between) == 1]
        alone = [p for p, fine in zip(pieces, plain, strict=True) if not fine or len(self.between) != 1]
        names, ids, lengths = [], [self.ids], [self.lengths]
        for at in range(0, len(together), TOGETHER):
            part = together[at : at + TOGETHER]
            found = self._ids(BETWEEN.join(part).decode())
            ends = np.append(np.flatnonzero(found == self.between[0]), len(found))
            if len(ends) != len(part):
                alone += part
                continue
            names += part
            ids.append(found[found != self.between[0]])
            lengths.append(np.diff(ends, prepend=-1) - 1)
        for piece in alone:
            found = self._ids(piece.decode())
            names.append(piece)
            ids.append(found)
            lengths.append(np.array([len(found)]))
        self.known.update(zip(names, range(len(self.lengths), len(self.lengths) + len(names)), strict=True))
        self.ids, self.lengths = np.concatenate(ids), np.concatenate(lengths)

    def _cut(self, data, offsets):
        """Where pieces start, and the end of the last one; every text starts a piece."""
        kind = KIND[data]
        cut = np.zeros(len(data) + 1, bool)
        before, here = kind[:-1], kind[1:]
        run = (here == SPACE) & (before >= LETTER) & (before <= PLAIN)
        run[1:] |= (here[1:] == SPACE) & (kind[:-2] == LEAD)
        cut[1:-1] = run | ((here == MARK) & (before == LETTER))
        if self.pieces == "spaced":
            cut[2:-1] |= run[:-1] & (data[1:-1] == 10) & (here[1:] == LETTER)
        cut[offsets] = True
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array):
        """The ids of some texts one after another, and where each begins (and the last ends). A null text is empty."""
        texts = texts.cast(pa.large_utf8()).fill_null("")
        if self.pieces is None:
            found = [self._ids(t) if t else np.zeros(0, np.uint32) for t in texts.to_pylist()]
            end = np.array([self.end_id], np.uint32)
            return np.concatenate([x for ids in found for x in (ids, end)] or [end[:0]]), np.concatenate([[0], np.cumsum([len(x) + 1 for x in found])]).astype(np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        begin, end = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(texts.buffers()[2], np.uint8)[begin:end] if end > begin else np.zeros(0, np.uint8)
        offsets = offsets - begin
        if self.pieces == "words":  # which has neither case nor kinds of white space
            kind = KIND[data]
            data = np.where(kind == LETTER, data | 32, np.where(kind == SPACE, 32, data)).astype(np.uint8)
        bounds = self._cut(data, offsets) if len(data) else np.zeros(1, np.int64)
        cut = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        coded = cut.dictionary_encode()
        pieces, numbers = coded.dictionary.to_pylist(), np.zeros(0, np.int64)
        if pieces:
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            numeric = np.add.reduceat(NUMERIC[np.frombuffer(b"".join(pieces), np.uint8)], np.cumsum(sizes) - sizes)
            plain = (numeric == 0) & (sizes <= LONG)
            new = [i for i, p in enumerate(pieces) if p not in self.known]
            if len(self.known) + len(new) > self.most:
                self.forget()
                new = range(len(pieces))
            self._learn([pieces[i] for i in new], plain[list(new)])
            numbers = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))[coded.indices.to_numpy()]
        # the end id, piece 0, after the pieces of each text
        last = np.searchsorted(bounds, offsets[1:])
        numbers = np.insert(numbers, last, 0)
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        at = np.repeat(starts[numbers] - (ends - lengths), lengths)
        at += np.arange(len(at))
        return self.ids[at], np.concatenate([[0], ends[last + np.arange(len(last))]]).astype(np.int64)

    def __call__(self, text: str | None) -> bytes:
        """The ids of one text and the end id, as little-endian unsigned 32-bit integers."""
        return self.encode(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


_encoders: dict = {}


def encoder(path: str, pieces: str | None, end_id: int = 2, remembered: int = 0) -> Encoder:
    """One for each Python worker; it forgets its pieces when a task begins, unless so many are to be `remembered`."""
    key = (path, pieces, end_id, remembered)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, pieces, end_id, remembered or KNOWN)
    if not remembered:
        _encoders[key].forget()
    return _encoders[key]


def public_tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))
