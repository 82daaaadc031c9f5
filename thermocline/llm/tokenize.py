"""Token ids of texts with a public byte-level vocabulary; every distinct stretch between spaces is encoded once per worker."""

from __future__ import annotations

import os
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The vocabulary's own split pattern, and its stand-ins for bytes.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space that is not a single space between two other characters.
ODD_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]{2}|^[\s\x0B\x1C-\x1F\x{85}\p{Z}]|[\s\x0B\x1C-\x1F\x{85}\p{Z}]$|<\|"
MARKS = ".,!?;:"
# Characters that are letters in every version of Unicode in use; words with others go by the split pattern.
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{400}-\x{481}\x{4E00}-\x{9FA5}"
PLAIN, PLAIN_MARKED = rf"^\n?[{LETTERS}]+$", rf"^\n?[{LETTERS}]+[{MARKS}]$"
MOST_KNOWN, MOST_BYTES = 1_000_000, 64 << 20  # stretches held, and their bytes
MOST_PIECES = 50_000
LEARNT = 1 << 15  # new stretches held as Python strings at once


def _byte_letters() -> dict[int, str]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    The vocabulary splits a text before each single space or line end between two other characters, so the stretches in between
    are encoded independently; a line's first stretch is kept with its line end. Texts with other white space go through the library's own
    encoder. New stretches are found for a whole batch of texts at once. Of more than ``MOST_KNOWN`` stretches or ``MOST_BYTES`` those met
    in the fewest batches are forgotten, down to half, which bounds the memory and changes no id.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.split = regex.compile(PIECES)
        self.letters = _byte_letters()
        (self.line_end,) = self._piece_ids("\n")
        self.marks = np.array([self._piece_ids(m)[0] for m in MARKS], dtype=np.uint16)
        self.pieces: dict[str, list[int]] = {}  # piece of the split pattern -> its ids
        self.known = pa.array([], pa.large_string())  # stretches, without the mark after a plain word
        self.starts, self.sizes = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)  # where their ids stand in ``flat``
        self.met = np.zeros(0, dtype=np.int32)  # in how many batches
        self.flat = np.zeros(0, dtype=np.uint16)

    def _piece_ids(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]

    def _unit_ids(self, unit: str) -> list[int]:
        """Ids of a stretch, put together from its pieces."""
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
        found: list[int] = []
        for piece in self.split.findall(unit):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.pieces[piece] = self._piece_ids(piece)
            found += ids
        return found

    def _learn(self, new: pa.Array) -> None:
        """Encodes new stretches. They take most of the time, so plain words take one call of the library each and no other."""
        tokenize, line_end, found, ends = self.model.tokenize, self.line_end, array("H"), array("i")
        for at in range(0, len(new), LEARNT):
            some = new.slice(at, LEARNT)
            for unit, is_plain in zip(some.to_pylist(), pc.match_substring_regex(some, PLAIN).to_pylist()):
                if not is_plain:
                    found.extend(self._unit_ids(unit if unit[:1] == "\n" else " " + unit))
                elif unit[0] == "\n":
                    found.append(line_end)
                    found.extend([t.id for t in tokenize(unit[1:])] if unit.isascii() else self._piece_ids(unit[1:]))
                elif unit.isascii():
                    found.extend([t.id for t in tokenize("\u0120" + unit)])
                else:
                    found.extend(self._piece_ids(" " + unit))
                ends.append(len(found))
        stops = np.array(ends, dtype=np.int32)
        sizes = np.diff(stops, prepend=np.int32(0))
        self.known = pa.concat_arrays([self.known, new])
        self.starts = np.concatenate([self.starts, stops - sizes + np.int32(len(self.flat))])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.met = np.concatenate([self.met, np.zeros(len(new), dtype=np.int32)])
        self.flat = np.concatenate([self.flat, np.array(found, dtype=np.uint16)])

    def _forget(self) -> None:
        order = np.argsort(-self.met, kind="stable")
        held = np.cumsum(np.asarray(pc.binary_length(self.known))[order])
        kept = np.sort(order[: min(MOST_KNOWN // 2, int(np.searchsorted(held, MOST_BYTES // 2, side="right")))])
        self.known = self.known.take(pa.array(kept))
        starts, self.sizes, self.met = self.starts[kept], self.sizes[kept], self.met[kept]
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        source = np.repeat(starts - self.starts, self.sizes)
        self.flat = self.flat[source + np.arange(len(source), dtype=np.int32)]

    def _places(self, units: pa.Array) -> np.ndarray:
        """Numbers of distinct stretches, old or new."""
        held = len(self.known)
        coded = pa.concat_arrays([self.known, units]).dictionary_encode()
        if len(coded.dictionary) > held:
            self._learn(coded.dictionary.slice(held))
        places = np.asarray(coded.indices)[held:]
        self.met[np.unique(places)] += 1
        return places

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of texts whose white space is single and inside."""
        if len(self.known) > MOST_KNOWN or self.known.nbytes > MOST_BYTES:
            self._forget()
        if not len(texts):
            return np.zeros(0, dtype=np.uint16), np.zeros(0, dtype=np.int64)
        start, nothing = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
        lines = pc.binary_join_element_wise(start, pc.replace_substring(texts, "\n", " \n"), nothing)  # a text starts like a line
        split = pc.split_pattern(lines, " ")
        offsets = np.asarray(split.offsets)
        coded = split.flatten().dictionary_encode()
        codes, words = np.asarray(coded.indices), coded.dictionary
        marked = pc.match_substring_regex(words, PLAIN_MARKED)
        places = self._places(pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words))
        has_mark = np.asarray(marked.to_numpy(zero_copy_only=False), dtype=bool)
        last = pc.index_in(pc.utf8_slice_codeunits(words.filter(marked), -1), value_set=pa.array(list(MARKS), pa.large_string()))
        mark = np.zeros(len(words), dtype=np.uint16)
        mark[has_mark] = self.marks[np.asarray(last)]
        starts, sizes = self.starts[places][codes], (self.sizes[places] + has_mark)[codes]
        heads = offsets[:-1]
        starts[heads] += 1  # without the line end put before the text
        sizes[heads] -= 1
        ends = np.cumsum(sizes, dtype=np.int32)
        flat = np.append(self.flat, np.uint16(0))  # a mark's place may lie one past the end
        source = np.repeat(starts - (ends - sizes), sizes)
        source += np.arange(len(source), dtype=np.int32)
        ids = flat[source]
        at = np.flatnonzero(has_mark[codes])
        ids[ends[at] - 1] = mark[codes[at]]
        return ids, np.diff(ends[offsets[1:] - 1].astype(np.int64), prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (16 bits each), and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False), dtype=bool)
        if not odd.any():
            return self._plain(texts)
        ids, plain_counts = self._plain(texts.filter(pa.array(~odd)))
        other = [np.array(e.ids, dtype=np.uint16) for e in self.whole.encode_batch(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        counts = np.zeros(len(texts), dtype=np.int64)
        counts[~odd], counts[odd] = plain_counts, [len(o) for o in other]
        merged = np.empty(int(counts.sum()), dtype=np.uint16)
        from_plain = np.repeat(~odd, counts)
        merged[from_plain], merged[~from_plain] = ids, np.concatenate(other)
        return merged, counts


def worker_encoder(path: str) -> Encoder:
    """The worker's encoder, kept between its tasks: only a cache, so a lost worker costs time and nothing else."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str = "/opt/tokenizers") -> str:
    """Where the public vocabulary lies; it is installed on every machine and never copied."""
    if "public_tokenizers" not in sys.modules:
        try:
            import public_tokenizers
        except ModuleNotFoundError:
            return f"{folder}/{name}"
    else:
        public_tokenizers = sys.modules["public_tokenizers"]
    return public_tokenizers.path(name)
