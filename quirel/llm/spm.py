"""SentencePiece encoding with source offsets, and decoding.

A text is normalised by the longest prefix that the model's compiled character map knows, which
records for each normalised byte where it comes from. Pieces then follow each
other over the normalised bytes, so each one maps to a span of the original text's bytes.

Merges of these models never join a character to a space mark behind it, so a text is encoded by its
words (a run of space marks with what follows) and a task encodes each different word once.
"""

from __future__ import annotations

import re
import struct
from array import array as int_array
from functools import lru_cache

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import columns, map_texts, text_or_empty

MARK = "▁"
#: Different words that a task remembers.
WORDS = 50_000
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall


class CharMap:
    """A compiled character map: a double-array trie of prefixes with the places of their replacements."""

    def __init__(self, blob: bytes):
        self.units, self.strings = (), b""
        if blob:
            n = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
            self.strings = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[at:] and its replacement."""
        units, best = self.units, None
        if not units:
            return None
        unit = units[0]
        place = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            byte = data[i]
            place ^= byte
            unit = units[place]
            if unit & 0x800000FF != byte:
                break
            place ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                best = i + 1 - at, units[place] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.strings[best[1] : self.strings.index(b"\0", best[1])]


def _width(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class OffsetEncoder:
    """Encodes texts into ids and the begins and ends of their pieces in the text's UTF-8 bytes."""

    def __init__(self, model_file: str, end_id: bool = True):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.tail = [self.processor.eos_id()] if end_id else []
        if not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in model.pieces):
            raise ValueError("models without escaped spaces, with marks as suffixes or with own symbols are not supported")
        #: Whether no piece joins a character to a space mark behind it.
        self.by_word = not any(MARK in p.piece.lstrip(MARK) for p in model.pieces)
        self.sizes = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], np.int32)
        self.marks = np.array([p.piece.count(MARK) for p in model.pieces], np.int32)
        self.unknown = self.processor.unk_id()
        self.words: dict[str, bytes] = {}
        self.decimal = [str(i) for i in range(len(model.pieces))]

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The text as the model sees it, and for each of its bytes and its end the original byte; None where only marks differ."""
        if not self.map.units and not self.squeeze:
            return (MARK if self.prefix and text else "") + text.replace(" ", MARK), None
        data, out, source = text.encode(), [], []
        at = 0
        while at < len(data):
            found = self.map.longest(data, at)
            n, new = found or (w := _width(data[at]), data[at : at + w])
            out.append(new)
            source.append((at, n, len(new)))
            at += n
        joined = b"".join(out)
        places = np.repeat([s[0] for s in source], [s[2] for s in source]).astype(np.int32) if source else np.zeros(0, np.int32)
        end = len(data)
        if self.squeeze:
            blank = np.frombuffer(joined, np.uint8) == 32
            keep = ~(blank & np.concatenate(([True], blank[:-1])))
            kept = np.flatnonzero(keep)
            if len(kept) and blank[kept[-1]]:
                end, kept = int(places[kept[-1]]), kept[:-1]
            joined, places = np.frombuffer(joined, np.uint8)[kept].tobytes(), places[kept]
        if self.prefix and joined:
            joined, places = b" " + joined, np.concatenate((places[:1], places))
        lengths = np.where(np.frombuffer(joined, np.uint8) == 32, 3, 1)
        return joined.decode().replace(" ", MARK), np.append(np.repeat(places, lengths), end).astype(np.int32)

    def _split(self, normal: str) -> list[str]:
        """Words of a normalised text: a run of marks with what follows."""
        if not self.by_word:
            return [normal] if normal else []
        return _WORDS(normal)

    def _learn(self, words: set[str]) -> None:
        """Ids of normalised words, as int32 bytes; the library adds the first mark where the model does, so that one is left out."""
        known = self.words
        if len(known) > WORDS:
            known.clear()
        new = [w for w in words if w not in known and w != MARK]
        if self.prefix and any(w[0] != MARK for w in new):
            raise ValueError("a normalised text begins with a mark")
        raw = [w[self.prefix :].replace(MARK, " ") for w in new]
        known.update(zip(new, [int_array("i", ids).tobytes() for ids in self.processor.encode(raw, num_threads=1)]))
        if MARK in words:
            alone, spaced = self.processor.encode("a"), self.processor.encode("a ")
            known[MARK] = int_array("i", spaced[len(alone) :]).tobytes()

    def encode(self, texts: list[str], spans: bool = True) -> dict[str, list]:
        """ids as text and as int32 bytes; with spans begins and ends as int32 bytes, one for each id; an end id spans nothing."""
        out = {"n_tokens": [], "ids_text": [], "ids": [], "begins": [], "ends": []}
        tail = np.array(self.tail, "<i4").tobytes()
        normal = [self.normalise(t) for t in texts]
        split = [self._split(n) for n, _ in normal]
        self._learn(set().union(*split))
        for text, words, (_, source) in zip(texts, split, normal):
            ids = b"".join(map(self.words.__getitem__, words)) + tail
            array = np.frombuffer(ids, "<i4")
            out["n_tokens"].append(len(array))
            out["ids_text"].append(" ".join(map(self.decimal.__getitem__, array.tolist())))
            out["ids"].append(ids)
            if spans:
                for name, places in zip(("begins", "ends"), self._project(text, array, source)):
                    out[name].append(None if places is None else places.tobytes())
        return out

    def _project(self, text: str, ids: np.ndarray, source: np.ndarray | None) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Begins and ends; None where an unknown piece stands for what it doesn't spell, so that places can't be told."""
        sizes, lead = self.sizes[ids], 0
        if source is None and MARK not in text:
            # Only spaces change, each into a mark; the added one stands before the text.
            sizes, lead = sizes - 2 * self.marks[ids], int(self.prefix and text != "")
        if self.tail:
            sizes[-1] = 0
        stops = np.cumsum(sizes, dtype=np.int64)
        data = text.encode()
        if source is None and MARK in text:
            raw = np.frombuffer(data, np.uint8)
            source = np.append(np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1)), len(raw))
            if self.prefix:
                source = np.concatenate(([0, 0, 0], source))
        if (ids == self.unknown).any() or (len(stops) and stops[-1] != (len(data) + lead if source is None else len(source) - 1)):
            return None, None
        if source is not None:
            return source[stops - sizes].astype("<i4"), source[stops].astype("<i4")
        return np.maximum(stops - sizes - lead, 0).astype("<i4"), np.maximum(stops - lead, 0).astype("<i4")


@lru_cache(maxsize=2)
def _encoder(model_file: str, end_id: bool) -> OffsetEncoder:
    """Kept by a Python worker for its later tasks, with the words it has seen."""
    return OffsetEncoder(model_file, end_id)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: bool = True, spans: bool = True, decoded: bool = False) -> DataFrame:
    """One row per input row: id, n_tokens, ids_text (decimal, joined by a space), ids, begins, ends (little-endian int32 arrays as bytes).

    begins and ends are byte offsets in the text's UTF-8, end exclusive; null without spans, and for a text with pieces that the model
    doesn't know. With decoded, a column has the text that the ids decode to, by the same Python worker. model_file is read on
    every executor. Null text counts as empty and has the end id only; long texts are encoded whole. Rows that repeat are
    encoded alike, ids may be null. Other columns are ignored, whatever their names. No rows give no rows.
    """
    rows = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("body"))

    def make():
        encoder = _encoder(model_file, end_id)

        def apply(texts):
            found = encoder.encode(texts, spans)
            if decoded:
                found["decoded"] = _decoded(encoder.processor, found["ids"])
            return found if spans else found | {"begins": [None] * len(texts), "ends": [None] * len(texts)}

        return apply

    found = map_texts(rows, "body", make, "n_tokens long, ids_text string, ids binary, begins binary, ends binary" + ", decoded string" * decoded)
    return found.withColumnRenamed("id", id_col)


def _decoded(processor, ids: list[bytes | None]) -> list[str]:
    return [processor.decode(np.frombuffer(v or b"", "<i4").tolist()) for v in ids]


def decode(rows: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """rows with `decoded`, the text of int32 id bytes; null ids decode to the empty text. A column of that name is replaced."""
    rows = rows.drop("decoded") if ids_col != "decoded" else rows

    def make():
        processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        return lambda values: {"decoded": _decoded(processor, values)}

    return map_texts(rows, ids_col, make, "decoded string", drop=False)
