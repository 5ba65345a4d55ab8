"""Whole texts to token ids with the tokenizers library, each distinct piece of a slice encoded once.

The byte-level pre-tokenizer always cuts before a single space or line feed between two other characters, after
such a line feed, and between an ASCII letter or digit and ASCII punctuation. Texts are cut there, where the
characters are surely of that kind; the ids of a text are those of its pieces, one after another. The
pieces are found and told apart with numpy (two 64-bit hashes), so the library sees each of them once: many in
a row, joined at those same cuts, and told apart again by the bytes that their ids stand for. Other tokenizers
get whole texts.
"""

from __future__ import annotations

import os

import numpy as np

from talkloom.llm import words as W

KNOWN = 800_000  # pieces remembered from slice to slice; a full memory is emptied
JOINED = 1 << 14  # bytes of pieces to a call
_BYTE = np.arange(256)
_ALNUM = (_BYTE >= 48) & (_BYTE < 58) | (_BYTE >= 65) & (_BYTE < 91) | (_BYTE >= 97) & (_BYTE < 123)
_PUNCT = (_BYTE > 32) & (_BYTE < 127) & ~_ALNUM
_MAY_BE_SPACE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file; Spark's Python workers keep it, and the pieces it knows, from task to task."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        pre, added = self.tokenizer.pre_tokenizer, self.tokenizer.get_added_tokens_decoder().values()
        plain = self.tokenizer.normalizer is None and not any(set(t.content) & set(" \n") or t.lstrip or t.rstrip for t in added)
        self.by_piece = plain and isinstance(pre, ByteLevel) and not pre.add_prefix_space and pre.use_regex
        self.added = [t.content.encode() for t in added]
        self.size = self.tokenizer.get_vocab_size()
        self.bytes_of = self.byte_lengths()
        self._empty()

    def _empty(self) -> None:
        self.first, self.second = np.zeros(0, dtype=W.U64), np.zeros(0, dtype=W.U64)
        self.count, self.at, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def byte_lengths(self) -> np.ndarray:
        """The bytes that each id of a byte-level vocabulary stands for."""
        return np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.size)], dtype=np.int64)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*got, np.zeros(0, dtype=np.uint32)]), np.array([len(g) for g in got], dtype=np.int64)

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin with a space and end with a solid character, and each one's number of ids."""
        size = ends - starts
        stop = np.cumsum(size)
        joined = data[np.arange(stop[-1] if len(stop) else 0) + np.repeat(starts - (stop - size), size)].tobytes()
        cut = np.unique(np.append(stop[np.searchsorted(stop, np.arange(JOINED, len(joined), JOINED))], len(joined)))
        ids, _ = self._plain([joined[a:b].decode("utf-8") for a, b in zip([0, *cut[:-1]], cut, strict=True)])
        return ids, np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), stop, side="left") + 1, prepend=0)

    def encode(self, piece: W.Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a slice, and each text's first place (with the end as the last one)."""
        data, offsets = piece.data, piece.offsets
        if not self.by_piece or not len(data):
            return self._whole(piece)
        solid = data > 0x20
        solid &= data != 0x7F
        high = _MAY_BE_SPACE[data]
        before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        before[1:] = solid[:-1] & ~high[:-1]
        before[2:] &= ~high[:-2]
        before[3:] &= ~high[:-3]
        after[:-1] = (solid & ~high)[1:]
        feed = (data == 0x0A) & before & after
        cut = (data == 0x20) & before & after | feed
        cut[1:] |= feed[:-1]
        raw = data.tobytes()
        if not any(x in raw for x in self.added):  # those are matched before any cut
            cut[1:] |= _PUNCT[data[1:]] & _ALNUM[data[:-1]]
        inner = cut & (data == 0x20)
        edge = offsets[:-1][np.diff(offsets) > 0]
        inner[edge] = False
        cut[edge] = True
        starts = np.flatnonzero(cut)
        cut_before = inner[starts]
        ends = np.append(starts[1:], len(data))
        h1, h2 = W.FIRST.spans(data, starts, ends), W.SECOND.spans(data, starts, ends)
        keys, one, back = np.unique(h1, return_index=True, return_inverse=True)
        if not (h2 == h2[one][back]).all():
            return self._whole(piece)
        i = np.searchsorted(self.first, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = i < len(self.first)
        known[inside] = (self.first[i[inside]] == keys[inside]) & (self.second[i[inside]] == h2[one][inside])
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.first) + len(new) > KNOWN:
                self._empty()
                new = np.arange(len(keys))
            a, b = starts[one[new]], ends[one[new]]
            lone = ~cut_before[one[new]] | ~solid[b - 1] | high[np.maximum(b - 1, 0)] | high[np.maximum(b - 2, 0)] | high[np.maximum(b - 3, 0)]
            new = np.concatenate([new[~lone], new[lone]])
            ids, count = self._pieces(data, a[~lone], b[~lone])
            rest, more = self._plain([data[x:y].tobytes().decode("utf-8") for x, y in zip(a[lone], b[lone], strict=True)])
            ids, count = np.concatenate([ids, rest]), np.concatenate([count, more])
            at = len(self.ids) + np.cumsum(count) - count
            order = np.argsort(keys[new])
            new, count, at = new[order], count[order], at[order]
            # A piece whose first hash is known with another second hash stays out: its texts are encoded whole.
            taken = np.searchsorted(self.first, keys[new])
            if (self.first[np.minimum(taken, len(self.first) - 1)] == keys[new]).any() if len(self.first) else False:
                return self._whole(piece)
            self.first = np.insert(self.first, taken, keys[new])
            self.second = np.insert(self.second, taken, h2[one[new]])
            self.count, self.at = np.insert(self.count, taken, count), np.insert(self.at, taken, at)
            self.ids = np.concatenate([self.ids, ids])
            i = np.searchsorted(self.first, keys)
        count, at = self.count[i][back], self.at[i][back]
        ends_ids = np.cumsum(count)
        ids = self.ids[np.arange(ends_ids[-1]) + np.repeat(at - (ends_ids - count), count)]
        of = np.concatenate([[0], ends_ids])[np.searchsorted(starts, offsets)]
        return ids, of

    def _whole(self, piece: W.Slice) -> tuple[np.ndarray, np.ndarray]:
        raw = piece.data.tobytes()
        ids, count = self._plain([raw[a:b].decode("utf-8") for a, b in zip(piece.offsets[:-1], piece.offsets[1:], strict=True)])
        return ids, np.concatenate([[0], np.cumsum(count)])
