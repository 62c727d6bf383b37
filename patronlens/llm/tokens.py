"""Whole texts to token ids with a public tokenizer file.

A text is cut at spaces and line breaks and each piece is encoded once per Python worker and
then looked up. This gives the ids of encoding the whole text, as the tokenizers this suits
drop white space before they split, and no token spans it; `splits_at_space` verifies that of
a file, and for others whole texts are encoded.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The id that ends each document.
END_ID = 1
#: Pieces in a worker's table; a full one becomes the older table, out of which pieces that occur again
#: are taken over, so memory is bounded and frequent pieces stay.
CACHE_ENTRIES = 300_000
# Letters that keep their ids when they are put in lower case beforehand, and a sign after them.
WORD_AND_SIGN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,]?)").fullmatch


# The sign that byte-level tokenizers write for each byte: visible ones as they are, others in
# order from U+0100.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_SIGNS = dict(zip([b for b in range(256) if b not in _VISIBLE], range(0x100, 0x200)))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.by_piece = splits_at_space(content)
        self.simple = WORD_AND_SIGN if merges_simple_words(content) else lambda piece: None
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.signs = dict(zip(["", ".", ","], [b"", *self._ids([".", ","])]))

    def encode(self, text: str) -> bytes:
        if not self.by_piece:
            return self._ids([text])[0]
        pieces = text.replace("\n", " ").split(" ")
        cache = self.cache
        new = set(pieces).difference(cache)
        if new:
            if len(cache) > CACHE_ENTRIES:
                self.older, self.cache = cache, {"": b""}
                cache, new = self.cache, set(pieces) - {""}
            self._learn(new)
        return b"".join([cache[piece] for piece in pieces])

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, "<u4").tobytes() for x in found]

    def _learn(self, new: set[str]) -> None:
        # A word of simple letters goes to the merging step at once, and the sign after it follows;
        # all else goes through every step of the tokenizer.
        cache, older, simple = self.cache, self.older, self.simple
        merge, other = self.tokenizer.model.tokenize, []
        for piece in new:
            ids = older.get(piece)
            if ids is None:
                found = simple(piece)
                if found is None:
                    other.append(piece)
                    continue
                word, sign = found.groups()
                low = word.lower()
                if sign or low != piece:
                    ids = cache.get(low) or older.get(low)
                if ids is None:
                    letters = low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_SIGNS)
                    ids = cache[low] = array("I", [t.id for t in merge(letters)]).tobytes()
                ids += self.signs[sign]
            cache[piece] = ids
        if other:
            cache.update(zip(other, self._ids(other)))


def merges_simple_words(file: dict) -> bool:
    """Whether a word of plain letters only meets composition and lower case before bytes are merged."""
    steps = (file.get("normalizer") or {}).get("normalizers") or []
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    first, *rest = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    bytes_only = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    return (
        file["model"]["type"] == "BPE"
        and all(step == spaces or step in ({"type": "NFC"}, {"type": "Lowercase"}) for step in steps)
        and r"[\p{L}]+" in (first.get("pattern") or {}).get("Regex", "")
        and len(rest) == 1
        and all(rest[0].get(key) == value for key, value in bytes_only.items())
    )


def splits_at_space(file: dict) -> bool:
    """Whether no token of this tokenizer can hold white space or depend on text beyond it."""
    normal = json.dumps(file.get("normalizer") or {})
    first = ((file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", " ")
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and " " not in pattern
        and r"[^\s" in pattern
        and "Lowercase" in normal
        and "Prepend" not in normal
        and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"])
    )


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder; it stays over tasks, and so do the pieces it has learned."""
    return Encoder(path)


def piece_batches(
    batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int = END_ID
) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to pieces of at most `size` ids: doc_id, piece, start, length, ids_crc32."""
    encode, end = encoder(path).encode, np.asarray([end_id], "<u4").tobytes()
    for batch in batches:
        doc_ids, rows = batch.column("doc_id"), []
        for row, text in enumerate(batch.column("text").to_pylist()):
            ids = encode(text or "") + end
            for piece, at in enumerate(range(0, len(ids), 4 * size)):
                part = ids[at : at + 4 * size]
                rows.append((row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        row, piece, start, length, crc = np.asarray(rows, np.int64).reshape(-1, 5).T.copy()
        yield pa.RecordBatch.from_arrays(
            [doc_ids.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
             pa.array(length), pa.array(crc)],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )
