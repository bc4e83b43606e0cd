"""Subword lattices over a fixed public vocabulary.

A word is a blank followed by its UTF-8 bytes.  An arc spans the bytes of one vocabulary
piece; every single byte is an arc, too (the vocabulary's byte fallback), so each word has a
segmentation.  forward() sums over all of them in log space; expected() adds the backward
pass and gives the expected number of uses of each piece.  Words of one length are handled
together, as arrays.

Words of more than BLOCK bytes are parted where no piece of more than a byte spans the place.
Every segmentation has an end there, so the parts' sums multiply to the word's, and nothing is
lost; between two such places a part is as long as it is.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

BLOCK = 1024
#: The sentencepiece vocabulary with byte fallback; where it lies is a parameter.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """The pieces as bytes (the word mark is a blank) and their log weights by the existing scores.

    The scores of this vocabulary fall by one from piece to piece, so they are ranks; as
    weights they follow Zipf's law, 1 / (10 - score), normalised.  Bytes get the last rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    worst = min(model.get_score(i) for i in range(model.get_piece_size()) if model.get_score(i) > -1e8)
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        if model.is_byte(i):
            found.setdefault(bytes([int(model.id_to_piece(i)[3:5], 16)]), worst)
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:]:
            found[piece] = max(found.get(piece, worst), model.get_score(i))
    pieces = sorted(found)
    weight = np.array([1.0 / (10.0 - found[p]) for p in pieces])
    return pieces, np.log(weight / weight.sum())


class Lattice:
    def __init__(self, pieces: list[bytes]) -> None:
        self.size = len(pieces)
        by_length = defaultdict(list)
        for i, p in enumerate(pieces):
            by_length[len(p)].append((p, i))
        self.tables = {}
        for n, own in by_length.items():
            keys = self._keys(np.frombuffer(b"".join(p for p, _ in own), np.uint8).reshape(len(own), n), n)[:, 0]
            order = np.argsort(keys)
            self.tables[n] = keys[order], np.array([i for _, i in own], np.int32)[order]

    @staticmethod
    def _keys(rows: np.ndarray, n: int) -> np.ndarray:
        """A key for each run of n bytes in each row: the bytes themselves up to 8, else 64 bits mixed of all of them."""

        def packed(at: int, k: int) -> np.ndarray:
            width = rows.shape[1] - n + 1
            out = np.zeros((rows.shape[0], width), np.uint64)
            for j in range(k):
                out = (out << np.uint64(8)) | rows[:, at + j : at + j + width]
            return out

        if n <= 8:
            return packed(0, n)
        key = packed(0, 8)
        for at in range(8, n, 8):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) ^ packed(at, min(8, n - at))
        return key

    def _arcs(self, rows: np.ndarray) -> dict[int, np.ndarray]:
        """For each piece length, the piece at each row and place, or self.size."""
        out = {}
        for n, (keys, ids) in self.tables.items():
            if n <= rows.shape[1]:
                want = self._keys(rows, n)
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                got = np.where(keys[at] == want, ids[at], np.int32(self.size))
                if n == 1 or (got != self.size).any():
                    out[n] = got
        return out

    def _parts(self, word: bytes) -> list[bytes]:
        """A long word in parts of at most BLOCK bytes, where places that no piece spans allow it."""
        row = np.frombuffer(word, np.uint8)[None, :]
        spanned = np.zeros(len(word) + 1, np.int64)
        for n, ids in self._arcs(row).items():
            if n > 1:
                begin = np.nonzero(ids[0] != self.size)[0]
                np.add.at(spanned, begin + 1, 1)
                np.add.at(spanned, begin + n, -1)
        free = np.append(np.nonzero(np.cumsum(spanned)[1:-1] == 0)[0] + 1, len(word)).tolist()
        out, begin, last = [], 0, 0
        for place in free:
            if place - begin > BLOCK and last > begin:
                out.append(word[begin:last])
                begin = last
            last = place
        return [*out, word[begin:]]

    def _grouped(self, words: list[bytes]):
        """(places in words, byte rows) for words, or parts of them, of the same length, a blank before each word."""
        groups = defaultdict(list)
        for i, w in enumerate(words):
            w = b" " + w
            for part in [w] if len(w) <= BLOCK else self._parts(w):
                groups[len(part)].append((i, part))
        for n, own in groups.items():
            step = max(1, 400_000 // (n * 8))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                yield np.array([i for i, _ in part]), np.frombuffer(b"".join(w for _, w in part), np.uint8).reshape(len(part), n)

    def _alpha(self, arcs: dict[int, np.ndarray], logp: np.ndarray, rows: int, n: int) -> np.ndarray:
        alpha = np.full((n + 1, rows, logp.shape[1]), -np.inf)
        alpha[0] = 0.0
        # By end: the lengths of which some row has a piece there.
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for k, ids in arcs.items():
            for begin in np.nonzero((ids != self.size).any(0))[0].tolist():
                ending[begin + k].append(k)
        for i in range(1, n + 1):
            terms = [alpha[i - k] + logp[arcs[k][:, i - k]] for k in ending[i]]
            if len(terms) == 1:
                alpha[i] = terms[0]
                continue
            top = terms[0].copy()
            for t in terms[1:]:
                np.maximum(top, t, out=top)
            total = np.zeros_like(top)
            for t in terms:
                t -= top
                total += np.exp(t, out=t)
            alpha[i] = top + np.log(total)
        return alpha

    def forward(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        """log marginal probability of each word under each column of logp (pieces, columns)."""
        logp = np.vstack([logp, np.full((1, logp.shape[1]), -np.inf)])
        out = np.zeros((len(words), logp.shape[1]))
        for places, rows in self._grouped(words):
            np.add.at(out, places, self._alpha(self._arcs(rows), logp, *rows.shape)[-1])
        return out

    def expected(self, words: list[bytes], weights: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over words weighted by each column of weights; logp has one column."""
        full = np.vstack([logp, np.full((1, 1), -np.inf)])
        out = np.zeros((self.size + 1, weights.shape[1]))
        for places, rows in self._grouped(words):
            arcs, n = self._arcs(rows), rows.shape[1]
            alpha = self._alpha(arcs, full, *rows.shape)[:, :, 0]
            # The backward pass is the forward pass of the reversed lattice.
            flipped = {k: ids[:, ::-1] for k, ids in arcs.items()}
            beta = self._alpha(flipped, full, *rows.shape)[::-1, :, 0]
            own = weights[places]
            for k, ids in arcs.items():
                hit, at = np.nonzero(ids != self.size)
                piece = ids[hit, at]
                post = np.exp(alpha[at, hit] + full[piece, 0] + beta[at + k, hit] - alpha[n, hit])
                for g in range(weights.shape[1]):
                    out[:, g] += np.bincount(piece, post * own[hit, g], minlength=self.size + 1)
        return out[:-1]
